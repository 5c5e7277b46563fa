"""Tables with versions over plain Parquet: insert, update, delete, merge, optimize, vacuum, time travel.

A table is a folder of immutable data files and a log. A log entry names the files that its version adds (with size, rows, and
smallest and largest value of columns, out of the footers) and those that it removes; every ``CHECKPOINT`` versions the whole list
is written beside it, so a version is read from one checkpoint and a few entries. A change rewrites only the files that hold rows it
touches (copy on write) and then adds the next entry: it is written aside and renamed without overwriting, so a reader never
sees half an entry, and of two writers one fails and has to try again. The driver handles file names and their statistics only.

``cluster_by`` sorts rows into ranges of those columns when they are written, so that a filter on them skips files (``read`` with
``ranges``, by the log; nothing of such a file is opened) and row groups by their statistics. Nulls follow SQL: an update's or
delete's condition that is null doesn't hold; in ``merge`` null keys match nothing. Empty tables are allowed everywhere.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import filesystem, put_new

#: Versions after which the whole list of files is written.
CHECKPOINT = 10


class ConcurrentWrite(RuntimeError):
    """Another writer added the version first."""


class DuplicateMatch(ValueError):
    """A row of the table matches several source rows."""


def _as_column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def _comparable(v: Any) -> Any:
    """A value in the form in which the log holds ranges; None if it holds none of the kind."""
    if isinstance(v, dt.datetime) or isinstance(v, bool):
        return None
    return v.isoformat() if isinstance(v, dt.date) else v if isinstance(v, (int, float, str)) else None


def _footer_facts(meta) -> str:  # noqa: ANN001
    """Rows of a file, and the range of its columns of whole numbers, floats, dates and short texts, as JSON. Columns of which a row
    group has no statistics are left out."""
    ranges: dict[str, list] = {}
    without: set[str] = set()
    for g in range(meta.num_row_groups):
        for k in range(meta.num_columns):
            c = meta.row_group(g).column(k)
            name, x = c.path_in_schema, c.statistics
            if x is None or not x.has_min_max:
                if x is None or x.null_count != c.num_values:
                    without.add(name)
                continue
            lo, hi = _comparable(x.min), _comparable(x.max)
            if lo is None or hi is None or lo != lo or hi != hi or isinstance(hi, str) and len(hi) > 64:
                without.add(name)
                continue
            old = ranges.get(name, [lo, hi])
            ranges[name] = [min(old[0], lo), max(old[1], hi)]
    return json.dumps({"rows": meta.num_rows, "range": {c: r for c, r in ranges.items() if c not in without}})


class Table:
    """A versioned table at ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # --- log -----------------------------------------------------------------------------------------------------------
    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions in the log."""
        p, fs = self._fs(f"{self.path}/_log")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def _json(self, name: str) -> dict:
        p, fs = self._fs(f"{self.path}/_log/{name}")
        s = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8"))
        finally:
            s.close()

    def _put(self, name: str, content: dict) -> None:
        """Add a file to the log; fails if it exists."""
        try:
            put_new(self.spark, f"{self.path}/_log/{name}", json.dumps(content))
        except FileExistsError as e:
            raise ConcurrentWrite(f"{name} exists") from e

    def _entry(self, version: int | None = None) -> dict:
        """Schema, order and files (by name, with their statistics) of a version."""
        v = self.versions()
        if not v:
            raise FileNotFoundError(self.path)
        n = v[-1] if version is None else version
        if n not in v:
            raise FileNotFoundError(f"{self.path}: version {n}")
        p, fs = self._fs(f"{self.path}/_log")
        marks = [int(x.getPath().getName()[:12]) for x in fs.listStatus(p) if x.getPath().getName().endswith(".checkpoint")]
        base = max((m for m in marks if m <= n), default=None)
        files = self._json(f"{base:012d}.checkpoint")["files"] if base is not None else {}
        entry: dict = {}
        for k in [x for x in v if (base is None or x > base) and x <= n]:
            entry = self._json(f"{k:012d}.json")
            for f in entry["remove"]:
                files.pop(f, None)
            files |= entry["add"]
        return {x: (entry or self._json(f"{n:012d}.json"))[x] for x in ("what", "schema", "cluster_by")} | {"files": files}

    def _commit(self, before: Mapping[str, dict], after: Mapping[str, dict], schema: T.StructType, cluster_by: Sequence[str], what: str) -> int:
        v = self.versions()
        n = v[-1] + 1 if v else 0
        entry = {"what": what, "schema": schema.jsonValue(), "cluster_by": list(cluster_by)}
        self._put(f"{n:012d}.json", entry | {"add": {f: x for f, x in after.items() if f not in before}, "remove": [f for f in before if f not in after], "files": len(after)})
        if n % CHECKPOINT == CHECKPOINT - 1:
            self._put(f"{n:012d}.checkpoint", {"files": dict(after)})
        return n

    def history(self) -> list[tuple[int, str, int]]:
        """(version, what, files) of every version."""
        return [(v, e["what"], e["files"]) for v in self.versions() for e in [self._json(f"{v:012d}.json")]]

    # --- files ---------------------------------------------------------------------------------------------------------
    def _write(self, df: DataFrame, cluster_by: Sequence[str]) -> dict[str, dict]:
        folder = f"data/{uuid.uuid4().hex}"
        if cluster_by:
            df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
        df.write.parquet(f"{self.path}/{folder}")
        p, fs = self._fs(f"{self.path}/{folder}")
        sizes = {f"{folder}/{s.getPath().getName()}": s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")}
        return self._statistics(sizes)

    def _statistics(self, sizes: Mapping[str, int]) -> dict[str, dict]:
        """Size, rows and the range of columns of files, out of their footers, which tasks read."""
        root = self.path

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyarrow import parquet as pq

            for b in batches:
                out = []
                for name in b["name"]:
                    where, path = filesystem(f"{root}/{name}")
                    with where.open_input_file(path) as f:
                        out.append(_footer_facts(pq.ParquetFile(f).metadata))
                yield b.assign(facts=out)

        if not sizes:
            return {}
        names = self.spark.createDataFrame([(n,) for n in sizes], "name string")
        rows = names.repartition(min(len(sizes), self.spark.sparkContext.defaultParallelism)).mapInPandas(go, "name string, facts string").collect()
        return {r["name"]: {"size": sizes[r["name"]]} | json.loads(r["facts"]) for r in rows}

    def _read(self, files: Iterable[str], schema: T.StructType) -> DataFrame:
        files = list(files)
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self, version: int | None = None, ranges: Mapping[str, tuple] | None = None) -> DataFrame:
        """The rows of a version (the latest by default). ``ranges``: only rows whose columns lie between two values, both included
        (None: no limit); files that hold none by their statistics are left out."""
        e = self._entry(version)
        df = self._read(self.holding(e["files"], ranges or {}), T.StructType.fromJson(e["schema"]))
        for c, (lo, hi) in (ranges or {}).items():
            df = df.where(F.col(c) >= lo) if lo is not None else df
            df = df.where(F.col(c) <= hi) if hi is not None else df
        return df

    @staticmethod
    def holding(files: Mapping[str, dict], ranges: Mapping[str, tuple]) -> list[str]:
        """Files that may hold rows within the ranges."""
        out = []
        for f, x in files.items():
            for c, (lo, hi) in ranges.items():
                known = x.get("range", {}).get(c)
                lo, hi = _comparable(lo), _comparable(hi)
                if known and (lo is not None and known[1] < lo or hi is not None and known[0] > hi):
                    break
            else:
                out.append(f)
        return out

    def _touched(self, e: dict, rows: DataFrame) -> list[str]:
        """Files that hold any of the rows (of ``_scan``)."""
        names = {"/".join(r[0].rsplit("/", 3)[-3:]) for r in rows.select("_file").distinct().collect()}  # file names, not rows
        return [f for f in e["files"] if f in names]

    def _scan(self, e: dict) -> DataFrame:
        return self._read(e["files"], T.StructType.fromJson(e["schema"])).withColumn("_file", F.col("_metadata.file_path"))

    # --- changes -------------------------------------------------------------------------------------------------------
    def create(self, df: DataFrame, cluster_by: Sequence[str] = ()) -> int:
        """The first version."""
        if self.versions():
            raise FileExistsError(self.path)
        return self._commit({}, self._write(df, cluster_by), df.schema, cluster_by, "create")

    def insert(self, df: DataFrame, overwrite: bool = False) -> int:
        """Add rows (columns by name; missing ones are null), or replace all."""
        e = self._entry()
        schema = T.StructType.fromJson(e["schema"])
        new = self._write(df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]), e["cluster_by"])
        return self._commit(e["files"], new if overwrite else e["files"] | new, schema, e["cluster_by"], "overwrite" if overwrite else "insert")

    def _replace(self, e: dict, touched: Sequence[str], df: DataFrame, what: str) -> int:
        schema = T.StructType.fromJson(e["schema"])
        new = self._write(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]), e["cluster_by"])
        gone = set(touched)
        return self._commit(e["files"], {f: x for f, x in e["files"].items() if f not in gone} | new, schema, e["cluster_by"], what)

    def update(self, values: Mapping[str, Column | str], where: Column | str = "true") -> int:
        """Set columns of the rows that meet the condition."""
        e, cond = self._entry(), _as_column(where)
        schema = T.StructType.fromJson(e["schema"])
        touched = self._touched(e, self._scan(e).where(cond)) if e["files"] else []
        rows = self._read(touched, schema)
        hit = F.coalesce(cond, F.lit(False))
        return self._replace(e, touched, rows.select(*[F.when(hit, _as_column(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns]), "update")

    def delete(self, where: Column | str) -> int:
        """Remove the rows that meet the condition."""
        e, cond = self._entry(), _as_column(where)
        schema = T.StructType.fromJson(e["schema"])
        touched = self._touched(e, self._scan(e).where(cond)) if e["files"] else []
        return self._replace(e, touched, self._read(touched, schema).where(~F.coalesce(cond, F.lit(False))), "delete")

    def merge(self, source: DataFrame, on: Sequence[str], update: Mapping[str, Column | str] | None = None, delete_when: Column | str | None = None, insert: bool | Mapping[str, Column | str] = True,
              update_when: Column | str | None = None, insert_when: Column | str | None = None) -> int:
        """MERGE: rows whose keys match a source row are deleted if ``delete_when`` holds, or else updated (expressions over
        ``t.column`` and ``s.column``; by default all columns from the source) if ``update_when`` does; source rows without a match
        are inserted, with the values of ``insert`` if it names some."""
        e = self._entry()
        schema = T.StructType.fromJson(e["schema"])
        cols = [f.name for f in schema]
        keys = None
        for k in on:
            c = F.col(f"t.{k}") == F.col(f"s.{k}")
            keys = c if keys is None else keys & c
        source = source.withColumn("_source", F.lit(True))
        target = self._read(e["files"], schema)
        if source.groupBy(*on).count().where("count > 1").join(target.select(*on).distinct(), list(on), "left_semi").limit(1).count():
            raise DuplicateMatch(f"several source rows for one key of {list(on)}")
        touched = self._touched(e, self._scan(e).join(source.select(*on).distinct(), list(on), "left_semi")) if e["files"] else []
        values = update if update is not None else {c: F.col(f"s.{c}") for c in cols if c in source.columns}
        hit = F.col("s._source").isNotNull()
        change = hit if update_when is None else hit & F.coalesce(_as_column(update_when), F.lit(False))
        joined = self._read(touched, schema).alias("t").join(source.alias("s"), keys, "left")
        if delete_when is not None:
            joined = joined.where(~(hit & F.coalesce(_as_column(delete_when), F.lit(False))))
        out = joined.select(*[F.when(change, _as_column(values[c])).otherwise(F.col(f"t.{c}")).alias(c) if c in values else F.col(f"t.{c}").alias(c) for c in cols])
        if insert:
            fresh = source.alias("s").join(target.alias("t"), keys, "left_anti").alias("s")
            fresh = fresh if insert_when is None else fresh.where(_as_column(insert_when))
            new = insert if isinstance(insert, Mapping) else {c: F.col(f"s.{c}") for c in cols if c in source.columns}
            out = out.unionByName(fresh.select(*[(_as_column(new[f.name]) if f.name in new else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))
        return self._replace(e, touched, out, "merge")

    def optimize(self, cluster_by: Sequence[str] | None = None, small: int = 64 << 20) -> int:
        """Rewrite small files (all of them, if the order of rows is to change) as larger ones."""
        e = self._entry()
        schema = T.StructType.fromJson(e["schema"])
        order = e["cluster_by"] if cluster_by is None else list(cluster_by)
        if cluster_by is not None:
            touched = list(e["files"])
        else:
            touched = [f for f, x in e["files"].items() if x["size"] < small]
        e["cluster_by"] = order
        return self._replace(e, touched, self._read(touched, schema), "optimize")

    def vacuum(self, keep: int = 1) -> int:
        """Remove all versions but the last ``keep`` and the files that only they name; the number of files removed."""
        v = self.versions()
        old, kept = v[:-keep], v[-keep:]
        if not old:
            return 0
        before = [self._entry(n)["files"] for n in v]
        live = {f for x in before[-keep:] for f in x}
        gone = {f for x in before[:-keep] for f in x} - live
        log, fs = self._fs(f"{self.path}/_log")
        if not fs.exists(self._fs(f"{self.path}/_log/{kept[0]:012d}.checkpoint")[0]):
            self._put(f"{kept[0]:012d}.checkpoint", {"files": before[-keep]})  # what older entries said
        for f in [*gone, *(f"_log/{n:012d}.{k}" for n in old for k in ("json", "checkpoint"))]:
            p, fs = self._fs(f"{self.path}/{f}")
            fs.delete(p, False)
        return len(gone)
