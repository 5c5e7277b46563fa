"""File systems of paths, for work on whole files in tasks."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def filesystem(uri: str):  # noqa: ANN201
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:") or ":/" not in uri:
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", uri).lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_new(spark: SparkSession, path: str, content: str) -> None:
    """Write a small file aside, then rename it, so that readers see all of it or nothing; FileExistsError if it exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(to.getParent(), f"_{uuid.uuid4().hex}")
    fs = to.getFileSystem(conf)
    out = fs.create(aside, False)
    out.write(bytearray(content.encode()))
    out.close()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(to), options)
    except Exception as e:
        fs.delete(aside, False)
        if "AlreadyExists" not in str(e):
            raise
        raise FileExistsError(path) from e
