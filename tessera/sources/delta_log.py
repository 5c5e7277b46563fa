"""Tables in the open Delta format, read and appended to by its public protocol, without its jar.

``read`` works out a version's files from the log (the last checkpoint and the commits after it) as a frame, so a log of millions
of actions is a job and only the names of live files reach the driver; they are read by Spark's own Parquet reader, partition
columns from the folders. ``write`` adds a commit. Reader version 1 of the protocol is covered; what a table may use beyond it (column
mapping, deletion vectors, other reader features) is refused, never misread.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import put_new

_FILE = "path string, deletionVector struct<storageType: string>"
_ACTIONS = f"protocol struct<minReaderVersion: int, readerFeatures: array<string>>, metaData struct<schemaString: string, partitionColumns: array<string>, configuration: map<string, string>>, add struct<{_FILE.replace(' ', ': ', 1).replace(', deletionVector ', ', deletionVector: ')}>, remove struct<path: string>"
#: Reader features that change nothing here: Spark reads such columns anyway.
_HARMLESS = {"timestampNtz", "vacuumProtocolCheck"}


class Unsupported(ValueError):
    """The table uses a feature of the format that isn't covered."""


def _log(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_delta_log")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _commits(names: list[str]) -> list[int]:
    return sorted(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit() and len(n) == 25)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that the log can give: those from its first checkpoint on, or all commits."""
    names = _log(spark, path)
    return sorted({*_commits(names), *(int(n[:20]) for n in names if ".checkpoint" in n and n.endswith(".parquet"))})


def _state(spark: SparkSession, path: str, version: int | None) -> tuple[DataFrame, T.StructType, list[str]]:
    """Live files (path), schema and partition columns of a version."""
    names = _log(spark, path)
    found = _commits(names)
    marks = {int(n[:20]) for n in names if ".checkpoint" in n and n.endswith(".parquet")}
    known = sorted({*found, *marks})
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path}: version {version}")
    last = known[-1] if version is None else version
    mark = max((m for m in marks if m <= last), default=-1)
    schema = T._parse_datatype_string(_ACTIONS)
    later = [f"{path}/_delta_log/{v:020d}.json" for v in found if mark < v <= last]
    parts = [spark.read.schema(schema).json(later).withColumn("_v", F.substring(F.col("_metadata.file_name"), 1, 20).cast("long"))] if later else []
    if mark >= 0:
        own = [f"{path}/_delta_log/{n}" for n in names if n.startswith(f"{mark:020d}.checkpoint") and n.endswith(".parquet")]
        parts.append(spark.read.schema(schema).parquet(*own).withColumn("_v", F.lit(mark).cast("long")))
    actions = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rules = actions.agg(F.max_by("protocol", F.when(F.col("protocol").isNotNull(), F.col("_v"))).alias("p"), F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.col("_v"))).alias("m")).first()
    wanted = set(rules["p"]["readerFeatures"] or []) - _HARMLESS
    mapped = (rules["m"]["configuration"] or {}).get("delta.columnMapping.mode", "none") != "none"
    if wanted or mapped or rules["p"]["minReaderVersion"] == 2:
        raise Unsupported(f"{path}: {sorted(wanted) or 'column mapping'}")
    each = F.coalesce("add.path", "remove.path").alias("path")
    # Of a file's actions the latest counts; a commit that removes and adds one leaves it.
    files = actions.where("add IS NOT NULL OR remove IS NOT NULL").select(each, F.struct("_v", F.col("add").isNotNull().alias("_in")).alias("_at"), F.col("add.deletionVector").isNotNull().alias("_cut"))
    files = files.groupBy("path").agg(F.max("_at").alias("_at"), F.max_by("_cut", "_at").alias("_cut")).where("_at._in")
    return files, T.StructType.fromJson(json.loads(rules["m"]["schemaString"])), list(rules["m"]["partitionColumns"] or [])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the latest by default)."""
    path = path.rstrip("/")
    files, schema, parts = _state(spark, path, version)
    rows = files.collect()
    if any(r["_cut"] for r in rows):
        raise Unsupported(f"{path}: deletion vectors")
    names = [unquote(r["path"]) for r in rows]
    if not names:
        return spark.createDataFrame([], schema)
    if any([x.split("=")[0] for x in n.split("/")[:-1]] != parts for n in names):
        raise Unsupported(f"{path}: files outside their partitions' folders")
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{n}" for n in names]).select(*schema.names)


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), overwrite: bool = False) -> int:
    """Append to a table (made by the first write), or overwrite it; the new version. FileExistsError: another writer was first."""
    spark, path = df.sparkSession, path.rstrip("/")
    old = versions(spark, path)
    n = old[-1] + 1 if old else 0
    now, actions = int(time.time() * 1000), []
    if old:
        files, schema, parts = _state(spark, path, None)
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        if overwrite:
            actions += [{"remove": {"path": r["path"], "deletionTimestamp": now, "dataChange": True}} for r in files.select("path").collect()]
    else:
        parts = list(partition_by)
        meta = {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": df.schema.json(), "partitionColumns": parts, "configuration": {}, "createdTime": now}
        actions += [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": meta}]
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    (df.write.partitionBy(*parts) if parts else df.write).parquet(draft)
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(draft)).toString()
    found = fs.listFiles(jvm.org.apache.hadoop.fs.Path(draft), True)
    while found.hasNext():
        s = found.next()
        name = s.getPath().toString()[len(root) + 1 :]
        if not name.endswith(".parquet"):
            continue
        to = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs.mkdirs(to.getParent())
        fs.rename(s.getPath(), to)
        values = {k: None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, _, v in (x.partition("=") for x in name.split("/")[:-1])}
        actions.append({"add": {"path": quote(name, safe="/="), "partitionValues": values, "size": s.getLen(), "modificationTime": now, "dataChange": True}})
    fs.delete(jvm.org.apache.hadoop.fs.Path(draft), True)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/_delta_log"))
    put_new(spark, f"{path}/_delta_log/{n:020d}.json", "\n".join(json.dumps(a) for a in [{"commitInfo": {"timestamp": now, "operation": "WRITE"}}, *actions]))
    return n
