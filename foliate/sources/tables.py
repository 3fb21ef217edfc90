"""Snapshot tables: reading, storing between steps, swapping state."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables that it names in braces."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where the session has none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    context = spark.sparkContext
    if not folder and not (context.master == "local" or context.master.startswith("local[")) and not context._jsc.sc().getCheckpointDir().isDefined():
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"foliate-{uuid.uuid4().hex}"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/foliate-{uuid.uuid4().hex}/{name}"
    parent = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage and outlives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Levels:
    """Tables of one kind, stored one after the other and read as one, so a plan doesn't grow with their number."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.paths, self.schema = spark, [], None
        self.root = new_path(spark, name)

    def add(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.root}/{len(self.paths)}")
        self.schema = self.schema or df.schema
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


#: Seconds after which a marker without content is that of a writer that died.
PATIENCE = 60


class Snapshots:
    """State tables as numbered snapshots; a run becomes visible when its marker is written, all tables at once."""

    def __init__(self, spark: SparkSession, root: str, patience: float = PATIENCE):
        self.spark, self.root, self.patience = spark, root.rstrip("/"), patience

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int | None:
        path, fs = self._path("done")
        return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getLen()), default=None) if fs.exists(path) else None

    def _next(self) -> int:
        """The number after the last run's; numbers of writers that died between marker and content are passed over."""
        path, fs = self._path("done")
        n = (self.latest() or 0) + 1
        held = {int(s.getPath().getName()): s for s in fs.listStatus(path)} if fs.exists(path) else {}
        while n in held and not held[n].getLen():
            if time.time() - held[n].getModificationTime() / 1000 < self.patience:
                raise RuntimeError(f"another writer is at run {n}")
            n += 1
        return n

    def _folder(self, n: int) -> str:
        """The folder of a run, which its marker names."""
        path, fs = self._path(f"done/{n}")
        held = fs.open(path)
        try:
            return held.readUTF()
        finally:
            held.close()

    def names(self) -> list[str]:
        """The tables of the last run."""
        n = self.latest()
        if n is None:
            return []
        path, fs = self._path(self._folder(n))
        return sorted(s.getPath().getName() for s in fs.listStatus(path))

    def read(self, name: str) -> DataFrame | None:
        n = self.latest()
        return None if n is None or name not in self.names() else self.spark.read.parquet(f"{self.root}/{self._folder(n)}/{name}")

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes all tables of a run, then its marker; readers see the whole run or nothing of it.

        Every writer has a folder of its own. Of two that follow the same run, the marker lets only the first
        one through and the other fails, so no run is lost or mixed.
        """
        n = self._next()
        folder = f"run={n}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}/{name}")
        path, fs = self._path(f"done/{n}")
        marker = fs.create(path, False)
        marker.writeUTF(folder)
        marker.close()
        return n

    def migrate(self, steps: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]) -> list[int]:
        """Applies the steps that ``schema_migrations`` doesn't hold, by version; returns theirs.

        A step gets all tables and returns those that it changes; they and its version become visible as one
        run, so a ladder that stopped goes on where it stood and a finished one changes nothing.
        """
        done = []
        for version in sorted(steps):
            held = self.read("schema_migrations")
            if held is not None and not held.filter(F.col("version") == version).isEmpty():
                continue
            tables = {name: self.read(name) for name in self.names()}
            row = self.spark.createDataFrame([(version,)], "version long")
            self.commit(tables | steps[version](dict(tables)) | {"schema_migrations": row if held is None else held.unionByName(row)})
            done.append(version)
        return done


def paged(pages: DataFrame) -> DataFrame:
    """Rows of cursor pages ``(collection, page_no, results, has_more, next_cursor)`` up to each collection's last page, in order."""
    last = pages.filter("not has_more").groupBy("collection").agg(F.min("page_no").alias("last"))
    kept = pages.join(last, "collection", "left").filter(F.col("last").isNull() | (F.col("page_no") <= F.col("last")))
    return kept.select("collection", "page_no", F.posexplode("results").alias("place", "item"))


def page_violations(pages: DataFrame) -> DataFrame:
    """Pages that break the contract: no results, or more to come without a cursor."""
    reason = F.when(F.col("results").isNull(), "malformed").when(F.col("has_more") & F.col("next_cursor").isNull(), "no_cursor")
    return pages.withColumn("reason", reason).filter("reason is not null").select("collection", "page_no", "reason")


def invalid_rows(rows: DataFrame) -> DataFrame:
    """Rows of a data source that are no pages with a string id."""
    return rows.filter(~(F.coalesce(F.col("object") == "page", F.lit(False)) & F.col("id").isNotNull()))
