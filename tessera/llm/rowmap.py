"""Runs a function over the text column of a table inside Arrow tasks, keeping the other columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one is set only where none is and all runs in one process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def folder(path: str):
    """The file system and the path there of a URI that pyarrow can reach, or of a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends there, and nothing is computed twice.

    Nothing reads the shuffles of the write after it, so they are removed when it ends.
    """
    path = scratch(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)


def kept(df: DataFrame, path: str) -> DataFrame:
    """The table in the folder `path`, a URI or a local path; written first, unless a whole one is there."""
    spark, (fs, folder_) = df.sparkSession, folder(path)
    path = path if "://" in path else f"file://{path}"
    if fs.get_file_info(f"{folder_}/_SUCCESS").type.name != "File":
        _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def with_columns_from_text(docs: DataFrame, added: str, compute: Callable[[pa.Array], list[pa.Array]], replace: dict[str, int] | None = None) -> DataFrame:
    """docs with the columns of the DDL `added`, which `compute` makes from the text column of a batch.

    A column of docs whose name clashes with an added one is replaced by it.
    """
    new = T._parse_datatype_string(added) if isinstance(added, str) else added
    names = {f.name.lower() for f in new.fields}
    kept = [c for c in docs.columns if c.lower() not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + new.fields)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.column(at))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + made
            yield pa.RecordBatch.from_arrays(columns, kept + [f.name for f in new.fields])

    return docs.mapInArrow(run, schema)


def set_aside(docs: DataFrame, *kept: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column but doc_id, text and `kept` under a name that clashes with nothing, and what gives the names back."""
    kept = {"doc_id", "text", *kept}
    names = [(c if c in kept else f"_own_{i}", c) for i, c in enumerate(docs.columns)]
    return docs.toDF(*[a for a, _ in names]), lambda found: found.select(*[F.col(a).alias(c) for a, c in names])


def text_batches(spark: SparkSession, rows: int = 2000, size: int = 64 << 20) -> None:
    """Rows of text are wide: fewer of them, and so many bytes, go to a task's Python worker at once, which bounds its memory.

    The session keeps these settings, since tables are computed later than they are declared; smaller ones stay.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.match(r"\d+$", spark.conf.get(key))
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, most)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[F.col(c) for c in columns or ("doc_id", "text")])
