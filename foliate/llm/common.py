"""What the operators of this subpackage share: tables, the shared folder, batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliate.sources.batches import BATCH_BYTES, BATCH_ROWS, small_batches, trimmed  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; one is set only where there is none, in local mode, as in tests."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not configured and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or os.path.join(tempfile.gettempdir(), f"foliate-{uuid.uuid4().hex}"))
    return configured or context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/foliate-{uuid.uuid4().hex}/{name}"
    jvm = spark._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def on_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``make()`` runs once in each task; what it returns maps batches."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(trimmed(run), schema)


def free(name: str, columns: list[str]) -> str:
    """``name``, or the first of its longer forms that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes or characters of a piece of text that a cache keeps, so that its entries bound its size.
LONGEST = 256


def forget_long(known: dict, new: Iterable) -> None:
    """Drops those of ``new`` from a cache that are too long to be kept."""
    for x in new:
        if len(x) > LONGEST:
            known.pop(x, None)


def texts(column: pa.Array) -> list[str]:
    """Nulls become empty texts."""
    return [x or "" for x in column.to_pylist()]


def id_hash(n: int) -> int:
    import zlib

    return zlib.crc32(str(n).encode())
