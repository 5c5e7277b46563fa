"""Column functions that Spark only has as internal expressions, out of public ones; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_least_n_non_nulls(n: int, *columns: Column | str) -> Column:
    """Whether at least n of the columns are neither null nor NaN."""
    total = F.lit(0)
    for c in columns:
        c = F.col(c) if isinstance(c, str) else c
        text = c.cast("string")
        total = total + F.when(c.isNull() | (text == "NaN"), 0).otherwise(1)
    return total >= n


def unscaled_value(c: Column | str, scale: int) -> Column:
    """A decimal's digits as a whole number; null if they exceed 64 bits."""
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast(f"decimal({38 - scale},{scale})") * F.lit(10**scale)).cast("decimal(38,0)").try_cast("bigint")


def make_decimal(c: Column | str, precision: int, scale: int) -> Column:
    """A whole number taken as the digits of a decimal; null if it has too many."""
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast("decimal(20,0)") * F.lit(f"{1 / 10**scale:.{scale}f}").cast(f"decimal({scale + 1},{scale})")).try_cast(f"decimal({precision},{scale})")


def normalised(c: Column | str) -> Column:
    """A float with one NaN and one zero, fit for a key that leaves Spark (inside Spark keys are normalised anyway)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(float("nan"))).when(c == 0, F.lit(0.0)).otherwise(c)


def replicate_rows(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column ``times`` says (null or below 1: not at all), without that column."""
    kept = [c for c in df.columns if c != times]
    return df.where(F.col(times) > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times).cast("bigint")))).select(*kept)


def array_fields(c: Column | str, field: str) -> Column:
    """One field of every struct in an array."""
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(c, lambda x: x[field])
