"""Census snapshots as a stream: each micro-batch is a run against the state that the last one left.

A run is planned as one table, checked as a whole, and refused before anything of it is written. The state tables live
in ``Snapshots``, so a batch that is repeated after a failure finds its run number taken and changes nothing, and a run
is visible as a whole or not at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliate.functions import markup
from foliate.operators import diff, pages
from foliate.sources.tables import Snapshots, store

#: Part of each page's fingerprint: texts are rewritten anew when the rules change.
TRANSFORM = "1"


@dataclass(frozen=True)
class Limits:
    """When a resource that isn't seen is trashed, and how much a run may trash."""

    grace: int = 2
    most_ratio: float = 0.2
    most_count: int = 50
    allow_large: bool = False


def plan(census: DataFrame, old: DataFrame, roots: DataFrame, limits: Limits, confirmed: DataFrame | None = None, unmanaged: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The actions of a run (``kind`` NONE where nothing is to be done), and what it counts as missing (``diff.missing``).

    ``roots``: ``root_id, complete``, the configured roots and whether each census went through; roots of ``old`` that
    aren't among them are removed ones. ``unmanaged``: ``path`` of files that the engine doesn't own.
    """
    actions = diff.reconcile(census, old.filter("status <> 'tombstoned'"), [("title", "title"), ("root_id", "root")] + [("content_hash", "content")] * ("content_hash" in census.columns and "content_hash" in old.columns))
    seen = census.select("id", "in_trash")
    removed = old.select("root_id").distinct().join(roots.select("root_id"), "root_id", "left_anti")
    lost = diff.missing(old, seen, seen.select("id").limit(0), roots.filter("complete"), limits.grace, confirmed=confirmed, removed=removed)
    gone = lost.filter("to_trash")
    alive = actions.join(gone.select("id"), "id", "left_anti").join(census.select("id", "expected_path"), "id").join(old.select("id", "local_path"), "id", "left")
    held = F.lit(False)
    if unmanaged is not None:
        alive = alive.join(unmanaged.select(F.col("path").alias("expected_path"), F.lit(True).alias("held")).distinct(), "expected_path", "left")
        held = F.coalesce("held", F.lit(False))
    kind = F.when(F.col("action") == "MOVE", "MOVE").when(F.col("action").isin("CREATE", "UPDATE"), "WRITE").otherwise("NONE")
    state = F.when(held, "unmanaged").when(F.col("action") == "CREATE", "absent").otherwise("managed")
    writes = alive.select("action", kind.alias("kind"), "id", F.when(kind == "MOVE", F.col("local_path")).alias("source_path"), F.col("expected_path").alias("target_path"), state.alias("target_state"), F.lit(True).alias("managed"), F.array_join("reasons", ",").alias("reason"))
    trash = gone.join(old.select("id", "local_path"), "id").select(F.lit("TRASH").alias("action"), F.lit("TRASH").alias("kind"), "id", F.col("local_path").alias("source_path"), F.lit(None).cast("string").alias("target_path"), F.lit(None).cast("string").alias("target_state"), F.lit(True).alias("managed"), "reason")
    return writes.unionByName(trash), lost


def bodies(census: DataFrame, old: DataFrame | None) -> DataFrame:
    """``id, fingerprint, body, fresh``: texts whose fingerprint the state holds keep their body; only the others are rewritten."""
    now = census.select("id", "markdown", F.sha2(F.concat_ws("\x00", F.lit(TRANSFORM), F.coalesce("markdown", F.lit(""))), 256).alias("fingerprint"))
    if old is None:
        old = now.select("id", "fingerprint", F.col("markdown").alias("body")).limit(0)
    both = now.join(old.select("id", F.col("fingerprint").alias("was"), F.col("body").alias("had")), "id", "left")
    same = F.col("fingerprint").eqNullSafe(F.col("was"))
    made = pages.rewrite(both.filter(~same).select("id", F.coalesce("markdown", F.lit("")).alias("text")), markup.enhanced, "<|```|~~~")
    fresh = made.join(both.filter(~same).select("id", "fingerprint"), "id").select("id", "fingerprint", F.col("text").alias("body"), F.lit(True).alias("fresh"))
    return fresh.unionByName(both.filter(same).select("id", "fingerprint", F.col("had").alias("body"), F.lit(False).alias("fresh")))


def apply_run(state: Snapshots, census: DataFrame, batch: int, limits: Limits | int = Limits(), roots: DataFrame | None = None, confirmed: DataFrame | None = None, unmanaged: DataFrame | None = None) -> bool:
    """One run; ``census``: ``id, root_id, title, expected_path, in_trash`` (and ``content_hash, markdown``).  Whether it was a new one.

    ``roots``: ``root_id, complete``; those of the census, all complete, if not given. A plan that breaks a rule raises
    ``diff.Refused``, and the state stays as it was.
    """
    limits = Limits(grace=limits) if isinstance(limits, int) else limits
    done = state.read("runs")
    if done is not None and not done.filter(F.col("batch") == batch).isEmpty():
        return False
    columns = ["id", "root_id", "title", "local_path", "status", "missing_count"] + ["content_hash"] * ("content_hash" in census.columns)
    new = census.withColumns({"local_path": F.col("expected_path"), "status": F.lit("active"), "missing_count": F.lit(0)}).select(columns)
    old = state.read("resources")
    if old is None:
        old = new.limit(0)
    if roots is None:
        roots = census.select("root_id").distinct().withColumn("complete", F.lit(True))
    actions, lost = plan(census, old, roots, limits, confirmed, unmanaged)
    actions, lost = store(actions, "run_plan"), store(lost, "run_missing")
    complete = roots.filter("not complete").isEmpty()
    diff.raise_on(diff.violations(actions, complete, old.count(), limits.allow_large, limits.most_ratio, limits.most_count))
    merged = diff.upsert(old.select(columns), new, "id")
    counted = merged.join(lost.select("id", F.col("missing_count").alias("n"), "to_trash"), "id", "left")
    kept = [c for c in columns if c not in ("status", "missing_count")]
    after = counted.select(*kept, F.when(F.col("to_trash"), "tombstoned").when(F.col("n") > 0, "missing").otherwise(F.col("status")).alias("status"), F.coalesce("n", "missing_count").alias("missing_count"))
    kinds = diff.counts(actions)
    tables = {"resources": after, "plan": actions.filter("kind <> 'NONE'").withColumn("batch", F.lit(batch).cast("long"))}
    if "markdown" in census.columns:
        texts = store(bodies(census, state.read("bodies")), "run_bodies")
        kinds = kinds.join(texts.agg(F.count_if("fresh").alias("n_rewritten")))
        tables["bodies"] = texts.drop("fresh")
    runs = kinds.withColumn("batch", F.lit(batch).cast("long"))
    state.commit(tables | {"runs": runs if done is None else done.unionByName(runs)})
    return True


def follow(censuses: DataFrame, state: Snapshots, checkpoint: str, limits: Limits | int = Limits(), roots: DataFrame | None = None) -> StreamingQuery:
    """A streaming query over a stream of census rows; ``availableNow`` batches them by arrival; a refused run stops it."""
    def run(df: DataFrame, batch: int) -> None:
        held = df.persist()
        try:
            apply_run(state, held, batch, limits, roots)
        finally:
            held.unpersist()

    return censuses.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
