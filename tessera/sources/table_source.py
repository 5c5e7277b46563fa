"""Versioned tables as a data source of Spark: ``spark.read.format("tessera").load(path)``.

Schema, files and their statistics come from the table's log; filters on columns with statistics leave out files before any is
opened (and are applied by Spark as well); each file is a partition, read in Arrow batches of the columns that the table has. Options:
``version`` (the latest by default). ``tables.Table.read`` reads the same rows through Spark's own Parquet reader, which is
faster; this is the form for plain SQL and for tools that only know formats.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .paths import filesystem
from .tables import Table


def snapshot(path: str, version: int | None = None) -> dict:
    """Schema and files of a version, read without a session."""
    from pyarrow import fs

    where, base = filesystem(path.rstrip("/"))
    names = [i.base_name for i in where.get_file_info(fs.FileSelector(f"{base}/_log"))]
    found = sorted(int(n[:-5]) for n in names if n.endswith(".json"))
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"{path}: version {version}")
    last = found[-1] if version is None else version
    mark = max((int(n[:12]) for n in names if n.endswith(".checkpoint") and int(n[:12]) <= last), default=-1)

    def load(name: str) -> dict:
        with where.open_input_file(f"{base}/_log/{name}") as f:
            return json.loads(f.read())

    files = load(f"{mark:012d}.checkpoint")["files"] if mark >= 0 else {}
    for k in (x for x in found if mark < x <= last):
        entry = load(f"{k:012d}.json")
        files = {f: x for f, x in files.items() if f not in set(entry["remove"])} | entry["add"]
    return {"schema": load(f"{last:012d}.json")["schema"], "files": files}


class _Reader(DataSourceReader):
    def __init__(self, path: str, version: int | None, schema: T.StructType) -> None:
        self.path, self.version, self.schema, self.ranges = path, version, schema, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1:
                lo, hi = self.ranges.get(f.attribute[0], (None, None))
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    lo = f.value if lo is None else max(lo, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    hi = f.value if hi is None else min(hi, f.value)
                self.ranges[f.attribute[0]] = (lo, hi)
            yield f  # statistics only leave out files: Spark still filters the rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in sorted(Table.holding(snapshot(self.path, self.version)["files"], self.ranges))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        where, path = filesystem(f"{self.path}/{partition.value}")
        schema = to_arrow_schema(self.schema)
        with where.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(columns=self.schema.names):
                yield pa.RecordBatch.from_arrays([b.column(n).cast(schema.field(n).type) for n in schema.names], schema=schema)


class TableSource(DataSource):
    """The data source; ``register`` makes it known."""

    @classmethod
    def name(cls) -> str:
        return "tessera"

    def _at(self) -> tuple[str, int | None]:
        v = self.options.get("version")
        return self.options["path"].rstrip("/"), None if v is None else int(v)

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(snapshot(*self._at())["schema"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(*self._at(), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with push-down of filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TableSource)
