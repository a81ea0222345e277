"""Small files beside tables, through the file system that the session's paths name."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return hadoop, fs, fs.makeQualified(where)


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file that is there whole or not at all; one that exists is left alone, and that is an error."""
    hadoop, fs, where = _at(spark, path)
    part = hadoop.Path(where.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(part, where, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, without hidden ones, in order; none if it isn't there."""
    _, fs, where = _at(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(n for n in (x.getPath().getName() for x in fs.listStatus(where)) if not n.startswith((".", "_")))


def text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def remove(spark: SparkSession, path: str) -> None:
    _, fs, where = _at(spark, path)
    fs.delete(where, True)
