"""Problem 4: far too many small files.

``files`` reads write reports (several per file, spelled in several ways) as one row per file. ``plan`` says which files of a
partition are rewritten together, in groups of about a target size. ``compact`` does it for a directory of Parquet files:
every group is one task that copies encoded column blocks into a larger file and rewrites the footer
(``sources.parquet_blocks``), so no page is decoded; it checks schema, number of blocks and number of rows of what it wrote.

Defined cases: a report without path or name denotes no file and doesn't count; a null partition is the unpartitioned place;
a file whose size no report gives, or without records, is left alone; a partition with one small file is left alone; files of
different signatures (schema, writer, keys by which readers take values) are never joined; files are told apart by their whole
paths; empty tables and directories give no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import written
from ..sources import parquet_blocks
from ..sources.listing import listing
from ..sources.paths import filesystem

#: Name of the place of unpartitioned files (a fixed value of the format).
NO_PARTITION = "__NO_PARTITION_ID__"
SMALL = 16 << 20
TARGET = 128 << 20
#: Files, on average, of a hash bucket: the share of a partition that one task orders.
SHARD_FILES = 100_000
#: Bytes that one task copies, or so.
TASK_BYTES = 1 << 30


def _place(c: Column) -> Column:
    """A path in one spelling: decoded, without scheme, empty or '.' steps, outer spaces and letter case."""
    c = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    c = F.lower(F.regexp_replace(F.trim(c), r"^(?i)file:/*", "/"))
    c = F.regexp_replace(F.regexp_replace(c, r"/(\.?/)+", "/"), r"^\./", "")
    return F.regexp_replace(c, r"/\.?$", "")


def files(reports: DataFrame) -> DataFrame:
    """One row per file out of reports (write_id, table_path, partition_id, part_name, record_count, size_in_bytes): columns
    table, partition, name, write_id (the smallest), records (the largest) and bytes (the positive one given, or null)."""
    r = reports.where(F.col("table_path").isNotNull() & F.col("part_name").isNotNull()).select(
        _place(F.col("table_path")).alias("table"),
        F.regexp_replace(_place(F.coalesce(F.col("partition_id"), F.lit(NO_PARTITION))), "^/+", "").alias("partition"),
        F.regexp_replace(_place(F.col("part_name")), "^/+", "").alias("name"),
        "write_id",
        F.col("record_count").alias("records"),
        F.when(F.col("size_in_bytes") > 0, F.col("size_in_bytes")).alias("bytes"),
    )
    inside = F.startswith(F.col("name"), F.concat("partition", F.lit("/")))
    r = r.withColumn("name", F.when(inside, F.expr("substring(name, length(partition) + 2)")).otherwise(F.col("name")))
    return r.groupBy("table", "partition", "name").agg(F.min("write_id").alias("write_id"), F.max("records").alias("records"), F.max("bytes").alias("bytes"))


def sharded(items: DataFrame, keys: list[str], by: Column, rows: int, shard_rows: int = SHARD_FILES) -> DataFrame:
    """Adds ``shard``: groups of more than about shard_rows rows are split by a hash. ``rows``: how many rows ``items`` has.

    Rows are dealt out over hash buckets that grow in number with the rows, the rows of every (group, bucket) are counted, and
    buckets of a group are strung together until a shard is full. What is joined back has the bucket in its key, so a hot group
    is nowhere gathered, however large it is."""
    if rows <= shard_rows:
        return items.withColumn("shard", F.lit(0).cast("bigint"))
    x = items.withColumn("_bucket", F.pmod(F.xxhash64(by), F.lit(-(-4 * rows // shard_rows))))
    upto = F.sum("_rows").over(W.partitionBy(*keys).orderBy("_bucket"))
    b = x.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows")).withColumn("shard", F.floor((upto - F.col("_rows")) / shard_rows).cast("bigint"))
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_of"), "shard")
    on = F.col("_bucket") == F.col("_of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return x.join(b, on).drop("_bucket", "_of", *[f"_{k}" for k in keys])


def assigned(f: DataFrame, keys: Sequence[str], identity: str, small: int = SMALL, target: int = TARGET) -> DataFrame:
    """``f`` with the number of the ``output`` within its partition that each small file goes to; null: the file is left alone.
    ``f``: columns keys (not null), identity (unique), records, bytes. It is computed once and written; everything else comes
    from that table. Columns called output, or beginning with an underscore, are left out.

    The small files of a partition stand in a row (by hash bucket, then identity) which is cut into outputs of even size. Bytes
    are summed within (partition, bucket) and the buckets' sums within the partition, so a hot partition is never gathered."""
    keys = list(keys)
    f = written(f.select(*[c for c in f.columns if c != "output" and not c.startswith("_")]), "files")
    few = F.coalesce((F.col("records") > 0) & (F.col("bytes") < small), F.lit(False))
    s = f.withColumn("_bytes", F.when(few, F.col("bytes"))).withColumn("_bucket", F.pmod(F.xxhash64(identity), F.lit(max(1, -(-f.count() // SHARD_FILES)))))
    of = W.partitionBy(*keys)
    b = s.where("_bytes IS NOT NULL").groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_bytes").alias("_sum"))
    b = b.withColumn("_total", F.sum("_sum").over(of)).withColumn("_files", F.sum("_n").over(of)).withColumn("_before", F.sum("_sum").over(of.orderBy("_bucket")) - F.col("_sum"))
    b = b.where("_files > 1").select(*keys, "_bucket", "_before", "_total")
    inside = F.sum("_bytes").over(W.partitionBy(*keys, "_bucket").orderBy(identity).rowsBetween(W.unboundedPreceding, 0)) - F.col("_bytes")
    outputs = F.greatest(F.lit(1), F.round(F.col("_total") / target)).cast("bigint")
    at = F.floor((F.col("_before") + F.col("_inside")) / (F.col("_total") / outputs))
    x = s.withColumn("_inside", inside).join(b, [*keys, "_bucket"], "left")
    x = x.withColumn("output", F.when(F.col("_bytes").isNotNull() & F.col("_total").isNotNull(), F.least(outputs - 1, at).cast("bigint")))
    return x.select(*f.columns, "output")


def plan(f: DataFrame, small: int = SMALL, target: int = TARGET, keys: Sequence[str] = ("table", "partition"), identity: str = "write_id") -> DataFrame:
    """The files to rewrite, with the number of their ``output`` within the partition. Outputs are of even size near the target
    and hold two files or more. ``f``: columns keys, identity, records, bytes."""
    return assigned(f, keys, identity, small, target).where("output IS NOT NULL")


def _join_group(src: str, out_dir: str, partition: str, output: int | None, small: list[tuple[str, int]]) -> list[dict]:
    """Write one output per signature of a group's files (name, length)."""
    from pyarrow import parquet as pq

    source, root = filesystem(src)
    where, base = filesystem(out_dir)
    inside = lambda n: f"{root}/{partition}/{n}".replace("//", "/")
    by_signature: dict[bytes, list[tuple[str, int]]] = {}
    for name, size in sorted(small):
        with source.open_input_file(inside(name)) as f:
            meta, _ = parquet_blocks.read_footer(f, size)
        by_signature.setdefault(parquet_blocks.signature(meta), []).append((name, size))
    made = []
    folder = f"{base}/{partition}".rstrip("/")
    where.create_dir(folder, recursive=True)
    for k, (_, members) in enumerate(sorted(by_signature.items())):
        name = f"{folder}/" + (f"joined-{output:06d}-{k}.parquet" if output is not None else f"copied-{members[0][0]}")
        draft = f"{folder}/_{uuid.uuid4().hex}"  # a task that is run again, or twice, never shows half a file
        with where.open_output_stream(draft) as o:
            j = parquet_blocks.Joiner(o)
            for n, size in members:
                with source.open_input_file(inside(n)) as f:
                    j.add(f, size)
            got = j.close()
        with where.open_input_file(draft) as f:
            check = pq.ParquetFile(f).metadata
        if (check.num_rows, check.num_row_groups) != (got["rows"], got["row_groups"]):
            raise parquet_blocks.IncompatibleFiles(f"{name}: rows or blocks differ from the inputs'")
        where.move(draft, name)
        made.append({"partition": partition, "path": name} | got)
    return made


def compact(spark: SparkSession, src: str, out: str, small: int = SMALL, target: int = TARGET) -> DataFrame:
    """Join the small Parquet files below ``src`` into files below ``out``, directory by directory; files that are large or
    alone are copied by the same means, so ``out`` is the whole table. Gives a row per file written, with the number of the
    ``task`` that wrote it. The source is left as it is; to be run as an action (it writes when the result is computed; a file
    that is written again replaces itself)."""
    f = listing(spark, src).select("partition", "name", "length", F.concat_ws("/", "partition", "name").alias("path"), F.lit(1).alias("records"), F.col("length").alias("bytes"))
    g = assigned(f, ["partition"], "path", small, target)
    # One row per output: its names are bounded by the target size, so a task never holds more than a few outputs' names.
    alone = F.when(F.col("output").isNull(), F.col("path"))
    g = written(g.groupBy("partition", "output", alone.alias("alone")).agg(F.sort_array(F.collect_list(F.struct("name", "length"))).alias("members"), F.sum("length").alias("bytes")), "outputs")
    n, size = g.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    # The rows to deal out are names and hardly have a size, so their number of tasks follows from the bytes they stand for. It is
    # given expressly: left to itself, adaptive execution would fold them into one task.
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-(size or 0) // TASK_BYTES))))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for b in batches:
            for r in b.itertuples(index=False):
                made = _join_group(src, out, r.partition, None if pd.isna(r.output) else int(r.output), [(x["name"], int(x["length"])) for x in r.members])
                yield pd.DataFrame(made).assign(task=task)[["partition", "path", "files", "row_groups", "rows", "bytes", "task"]]

    return g.select("partition", "output", "members").repartition(tasks).mapInPandas(go, "partition string, path string, files long, row_groups long, rows long, bytes long, task int")
