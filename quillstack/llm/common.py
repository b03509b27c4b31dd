"""What the operators share: materialised tables and Arrow text buffers."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/quillstack/{name}-{uuid.uuid4().hex}"


def kept_path(spark: SparkSession, name: str) -> str:
    """Where a table that outlives a run is kept: the session's setting ``quillstack.<name>``, else a fresh path."""
    return spark.conf.get(f"quillstack.{name}", None) or shared_path(spark, name)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that nothing refers to any more.

    Its cleaner acts when the driver collects garbage, which a quiet driver may put off until disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation beyond its running tasks.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` has written for ``df``, which nothing may read any more."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        delete_path(df.sparkSession, folder)


@contextmanager
def arrow_batch_rows(spark: SparkSession, rows: int):
    """Within this, Python gets at most so many rows in an Arrow batch: for rows that are large each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hadoop_path(spark: SparkSession, path: str):
    """``(file system, path)`` of Hadoop for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, as Spark's parser wants it."""
    return "`" + name.replace("`", "``") + "`"


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return bool(fs.exists(p))


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; nulls count as empty strings.  No copy is made of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 19):
    """Row ranges whose bytes come to about ``limit``; a row over it stands alone, whole."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end
