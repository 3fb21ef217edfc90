"""Assets of pages matched to the blocks that hold them, and what follows from downloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occurrences(assets: DataFrame, page: str = "page", kind: str = "kind", place: str = "place") -> DataFrame:
    """``assets`` with ``occurrence``, the number of assets of the kind before it on its page."""
    return assets.withColumn("occurrence", (F.row_number().over(Window.partitionBy(page, kind).orderBy(place)) - 1).cast("long"))


class _Page:
    """One page's blocks that are still free, by each key, and the blocks that its URLs have taken."""

    def __init__(self) -> None:
        self.free: dict[tuple, dict[str, None]] = {}
        self.keys: dict[str, list[tuple]] = {}
        self.by_url: dict[str, str] = {}

    def add(self, row: dict) -> None:
        self.keys[row["block"]] = keys = [("url_path", row["url_key"]), ("filename", row["name_key"]), ("position_caption", row["kind"], row["occurrence"], row["caption"])]
        for key in keys:
            self.free.setdefault(key, {})[row["block"]] = None

    def take(self, row: dict) -> tuple[str, str | None, str | None]:
        """Status, block and strategy of an asset: the first key with a free block decides, alone or ambiguously."""
        if row["url_key"] and row["url"] in self.by_url:
            return "matched", self.by_url[row["url"]], "url_path"
        for key in (("url_path", row["url_key"]), ("filename", row["name_key"]), ("position_caption", row["kind"], row["occurrence"], row["caption"])):
            found = self.free.get(key) if len(key) > 2 or key[1] else None
            if not found:
                continue
            if len(found) > 1:
                return "ambiguous", None, key[0]
            block = next(iter(found))
            for other in self.keys[block]:
                self.free[other].pop(block, None)
            if key[0] == "url_path":
                self.by_url[row["url"]] = block
            return "matched", block, key[0]
        return "unmatched", None, None


def match(assets: DataFrame, blocks: DataFrame) -> DataFrame:
    """``page, place, status, block, strategy`` of each asset: each takes, in order, a block that those before it left.

    By equal URL taken before, by unique URL path, by unique file name, by kind, occurrence and caption. Rows stream in
    order, a page's blocks before its assets; a task holds one page's blocks, and each asset takes constant time.
    """
    columns = ["page", "side", "place", "url", "url_key", "name_key", "kind", "occurrence", "caption", "block"]
    rows = assets.withColumns({"side": F.lit(1), "block": F.lit(None).cast("string")}).select(columns).unionByName(blocks.withColumn("side", F.lit(0)).select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, page = object(), _Page()
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["page"] != now:
                    now, page = row["page"], _Page()
                if row["side"]:
                    out.append((row["page"], row["place"], *page.take(row)))
                else:
                    page.add(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["page", "place", "status", "block", "strategy"])

    n = int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = rows.repartition(n, "page").sortWithinPartitions("page", "side", "place")
    return stream.mapInArrow(run, "page string, place long, status string, block string, strategy string")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a partial minimum, not a sort."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("f")).select(*keys, *(F.col(f"f.{c}").alias(c) for c in others))


def best_outcome(outcomes: DataFrame) -> DataFrame:
    """``key, outcome``: downloaded before verified before remote, the earliest of equal ones."""
    rank = F.when(F.col("outcome") == "downloaded", 2).when(F.col("outcome") == "verified", 1).otherwise(0)
    return outcomes.groupBy("key").agg(F.max_by(F.struct("outcome", "place"), F.struct(rank, -F.col("place"))).alias("o")).select("key", "o.outcome", "o.place")


def fingerprint(assets: DataFrame) -> DataFrame:
    """``page, fingerprint`` of the usable assets of each page, in order of their JSON."""
    usable = assets.filter("cache_status <> 'unverified'")
    return usable.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("key", "url", "hash")))), "|").alias("fingerprint"))


def commit_decision(present, hash_now, hash_new, hash_old):
    """What to do with a downloaded file where its target may be there already."""
    return F.when(~present, "claim").when(hash_now == hash_new, "adopt").when(F.coalesce(hash_now == hash_old, F.lit(False)), "replace").otherwise("conflict")


def target_state(present, managed):
    return F.when(~present, "ready").when(managed, "deferred").otherwise("conflict")


def sidecar_conflicts(sidecars: DataFrame) -> DataFrame:
    """Keys with several contents; equal ones collapse."""
    return sidecars.groupBy("key").agg(F.min("content").alias("a"), F.max("content").alias("b")).filter("a <> b").select("key")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Two lists by key, the second one's rows before the first's."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
