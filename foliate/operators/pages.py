"""Page texts through the Markdown kernels, an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import destinations, markdown, texts
from foliate.sources.batches import over
from foliate.sources.tables import store

BROADCAST_ROWS = 100_000


def rewrite(pages: DataFrame, kernel: Callable[[str], str], only: str | None = None) -> DataFrame:
    """``pages`` (``id, text``) with ``kernel`` over the texts that match ``only``; the others never leave the JVM's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else kernel(t) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    rows = pages.select("id", "text")
    kind = f"id {dict(pages.dtypes)['id']}, text string"
    if only is None:
        return over(rows, run, kind)
    touched = F.coalesce(F.col("text").rlike(only), F.lit(False))
    return over(rows.filter(touched), run, kind).unionByName(rows.filter(~touched))


def linked(pages: DataFrame, targets: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Links to known pages as wiki links; ``targets`` (``target, path``) may be of any size: each page gets the paths that it asks for."""
    kind = dict(pages.dtypes)["id"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Asked(dict):
            def get(self, key, default=None):
                self[key] = None
                return default

        for batch in batches:
            found = [Asked() for _ in range(batch.num_rows)]
            for t, own in zip(batch.column(1).to_pylist(), found, strict=True):
                markdown.links(t, own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[x for x in own if x] for own in found], pa.list_(pa.string()))], names=["id", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [markdown.links(t, {x["target"]: x["path"] for x in own or ()}) for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["id", "text"])

    rows = pages.select("id", "text")
    touched = F.coalesce(F.col("text").rlike(r"(?i)notion\.so"), F.lit(False))
    known = store(targets.groupBy("target").agg(F.min("path").alias("path")), "link_targets")
    few = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    each = over(rows.filter(touched), asked, f"id {kind}, asked array<string>").select("id", F.explode("asked").alias("target")).distinct()
    held = each.join(F.broadcast(known) if few else known, "target").groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("target", "path")).alias("held"))
    joined = rows.filter(touched).join(held, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", "held")
    return over(joined, run, f"id {kind}, text string").unionByName(rows.filter(~touched))


def stabilised(pages: DataFrame) -> DataFrame:
    """``id, text, replaced, unsafe``: signed URLs cut, and how many can't be."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [destinations.signed_urls(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([len(m[2]) for m in made], pa.int64())], names=["id", "text", "replaced", "unsafe"])

    return over(pages.select("id", "text"), run, f"id {dict(pages.dtypes)['id']}, text string, replaced long, unsafe long")


def assets(pages: DataFrame) -> DataFrame:
    """``id, kind, url, caption, occurrence`` of each page's images and links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *a) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a in markdown.assets(t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["id", "kind", "url", "caption", "occurrence"])

    return over(pages.select("id", "text"), run, f"id {dict(pages.dtypes)['id']}, kind string, url string, caption string, occurrence long")


def occurrences(pages: DataFrame) -> DataFrame:
    """``id, context, outcome, digest`` of each signed URL of a page, where its destination ends for certain or not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, context, outcome, digest) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, _, context, outcome, digest, _ in destinations.occurrences(t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["id", "context", "outcome", "digest"])

    touched = pages.select("id", "text").filter(F.col("text").rlike("(?i)https?://"))
    return over(touched, run, f"id {dict(pages.dtypes)['id']}, context string, outcome string, digest string")


def same_occurrences(planned: DataFrame, applied: DataFrame) -> DataFrame:
    """``id, equal``: whether a page's signed URLs are, as a multiset, the same in both versions, wherever they stand."""
    each = occurrences(planned).withColumn("n", F.lit(1)).unionByName(occurrences(applied).withColumn("n", F.lit(-1)))
    surplus = each.groupBy("id", "context", "outcome", "digest").agg(F.sum("n").alias("n"))
    return surplus.groupBy("id").agg(F.every(F.col("n") == 0).alias("equal"))


def with_local_assets(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """``id, text`` with destinations of each page's own assets (``page, url, path``; the smallest path of a URL) made local.

    The maps come by a join, a page's own entries at a time; pages without any never reach Python.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [destinations.asset_urls(t, {x["url"]: x["path"] for x in own}) for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["id", "text"])

    own = assets.groupBy("page", "url").agg(F.min("path").alias("path")).groupBy("page").agg(F.collect_list(F.struct("url", "path")).alias("held"))
    joined = pages.select("id", "text").join(own, F.col("id") == F.col("page"), "left")
    touched = F.col("held").isNotNull() & F.col("text").isNotNull()
    return over(joined.filter(touched).select("id", "text", "held"), run, f"id {dict(pages.dtypes)['id']}, text string").unionByName(joined.filter(~touched).select("id", "text"))


UNKNOWN = r"<unknown(?:\s[^>]*)?/?>"


def substituted(pages: DataFrame, rendered: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """``id, text, source, placeholders``: each token of an unknown block replaced by what the block in its place was rendered as.

    ``pages``: ``id, text``. ``rendered``: ``page, place, block, status, text``, a row for each unknown block; a status of 404
    leaves a placeholder, any other than 200 or a null text fails the page. A page whose tokens and blocks differ in number,
    or that fails, becomes its text of ``fallbacks`` (``page, text``; its own if there is none). Tokens in code don't count.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([markdown.around_tokens(t or "", UNKNOWN) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["id", "parts"])

    kind = dict(pages.dtypes)["id"]
    held = F.coalesce(F.col("text").rlike(UNKNOWN), F.lit(False))
    parts = over(pages.filter(held).select("id", "text"), cut, f"id {kind}, parts array<string>")
    parts = parts.unionByName(pages.filter(~held).select("id", F.array(F.coalesce("text", F.lit(""))).alias("parts")))
    tokens = parts.select("id", F.posexplode(F.expr("slice(parts, 2, size(parts))")).alias("place", "after"))
    numbered = rendered.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("place")) - 1)
    missing = F.col("status") == 404
    text = F.when(missing, texts.placeholder(F.lit("unavailable"), F.col("block"))).when(F.col("status") == 200, F.col("text"))
    met = tokens.join(numbered.select(F.col("page").alias("id"), "place", text.alias("text"), missing.alias("missing")), ["id", "place"], "full")
    made = met.groupBy("id").agg(
        F.every(F.col("text").isNotNull() & F.col("after").isNotNull()).alias("whole"), F.count_if("missing").alias("placeholders"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("text", "after").alias("x")))), lambda x: x["x"]), "").alias("rest"),
    )
    own = fallbacks.groupBy("page").agg(F.min("text").alias("fallback"))
    rows = pages.select("id", "text").join(parts.select("id", F.get("parts", F.lit(0)).alias("first")), "id").join(made, "id", "left").join(own.withColumnRenamed("page", "id"), "id", "left")
    whole = F.coalesce("whole", F.lit(True))
    out = F.when(whole, F.concat("first", F.coalesce("rest", F.lit("")))).otherwise(F.coalesce("fallback", "text"))
    return rows.select("id", out.alias("text"), F.when(whole, "markdown").otherwise("block").alias("source"), F.when(whole, F.coalesce("placeholders", F.lit(0))).otherwise(0).cast("long").alias("placeholders"))
