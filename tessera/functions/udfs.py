"""User-defined functions: the ways in which Python joins a query, fastest first where there is a choice.

Arrow-batched functions take whole columns; plain ones take a row at a time and are for rare use. Nulls stay nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.udf(T.StringType())
def initials(s):  # noqa: ANN001, ANN201
    """Row at a time: first letters of the words."""
    return None if s is None else "".join(w[0] for w in s.split())


@F.pandas_udf(T.DoubleType())
def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
    """Batch of columns: price after discount."""
    return price * (1 - discount)


@F.pandas_udf(T.DoubleType())
def scaled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Iterator of batches: work done once per task (here a table of weights)."""
    weights = np.sqrt(np.arange(1000))
    for s in batches:
        yield pd.Series(weights[s.clip(0, 999).fillna(0).astype(int)], index=s.index).where(s.notna())


@F.pandas_udf(T.DoubleType())
def geometric_mean(v: pd.Series) -> float:
    """Aggregate over a group (UDAF) or window."""
    v = v[v > 0]
    return float(np.exp(np.log(v).mean())) if len(v) else float("nan")


def registered(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    spark.udf.register("initials", initials)
    spark.udf.register("geometric_mean", geometric_mean)


@F.udtf(returnType="word string, position int")
class Words:
    """Table function: the words of a text."""

    def eval(self, s: str | None):  # noqa: ANN201
        for i, w in enumerate((s or "").split()):
            yield w, i


def normalised(df: DataFrame, key: str, value: str) -> DataFrame:
    """Group map: values less their group's mean. The group has to fit into a task; use a window where it may not."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(**{value: pdf[value] - pdf[value].mean()})

    return df.groupBy(key).applyInPandas(go, df.schema)


def batch_map(df: DataFrame, column: str, name: str) -> DataFrame:
    """Arrow map: the upper-case form of a text column, batch by batch, without pandas."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pc.utf8_upper(b.column(column))], names=[*b.schema.names, name])

    return df.mapInArrow(go, schema)


def custom_aggregate(value: Column, zero: Column, step, finish=None) -> Column:  # noqa: ANN001
    """An aggregate of one's own without Python in the rows: a fold over the group's collected values (bounded groups only)."""
    return F.aggregate(F.collect_list(value), zero, step, finish) if finish else F.aggregate(F.collect_list(value), zero, step)
