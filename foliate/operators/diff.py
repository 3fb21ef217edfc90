"""Snapshot against snapshot: what to create, update, move or trash, and the state after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import names

#: Compared fields and the reasons that they give, in order.
COMPARED = [("title", "title"), ("parent_id", "parent"), ("root_id", "root"), ("resolved_filename", "collision"), ("last_edited_time", "last_edited_time"), ("content_hash", "content"), ("structure_hash", "structure"), ("config_hash", "config"), ("transform_version", "transform_version"), ("api_version", "api_version"), ("asset_fingerprint", "asset")]


def reconcile(current: DataFrame, stored: DataFrame, compared: list[tuple[str, str]] = COMPARED) -> DataFrame:
    """``id, action, reasons``: CREATE, MOVE if the path differs, UPDATE for any other difference, else UNCHANGED."""
    fields = [(f, r) for f, r in compared if f in current.columns]
    old = stored.select(F.col("id"), F.col("local_path").alias("_local"), F.lit(True).alias("_known"), *(F.col(f).alias(f"_{f}") for f, _ in fields))
    both = current.join(old, "id", "left")
    differs = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), r) for f, r in fields)), lambda x: x.isNotNull())
    moved = ~F.col("_local").eqNullSafe(F.col("expected_path"))
    reasons = F.when(F.col("_known").isNull(), F.array().cast("array<string>")).when(moved, F.concat(differs, F.array(F.lit("local_path")))).otherwise(differs)
    action = F.when(F.col("_known").isNull(), "CREATE").when(moved, "MOVE").when(F.size(differs) > 0, "UPDATE").otherwise("UNCHANGED")
    return both.select("id", action.alias("action"), reasons.alias("reasons"))


def override(action: Column, full: Column, missing: Column, edited: Column, unmanaged: Column) -> Column:
    """An unchanged resource is still written on a full run, or where its file isn't as it was left."""
    return F.when((action == "UNCHANGED") & (full | missing | edited | unmanaged), "UPDATE").otherwise(action)


def regenerates(action: Column, reasons: Column) -> Column:
    return action.isin("CREATE", "UPDATE") | ((action == "MOVE") & (F.size(reasons) > 1))


def missing(stored: DataFrame, seen: DataFrame, elsewhere: DataFrame, complete: DataFrame, grace: int = 2, mode: str = "full", confirmed: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """``id, missing_count, to_trash, reason`` of stored resources (``id, root_id, status, missing_count``) of complete roots.

    ``seen``: ``id, in_trash`` of this run; ``elsewhere``: ids seen under another root;
    ``complete``: root ids whose census allows deletion.  Nothing on a page run.
    ``confirmed``: ``id, reason`` (moved_out_of_scope, manual_reconcile) of what goes at once; ``removed``: root ids that
    are no longer configured, whose resources are missing for that reason.
    """
    if mode == "page":
        return stored.limit(0).select("id", F.lit(0).alias("missing_count"), F.lit(False).alias("to_trash"), F.lit("").alias("reason"))
    roots = complete.select("root_id") if removed is None else complete.select("root_id").unionByName(removed.select("root_id"))
    rows = stored.filter("status <> 'tombstoned'").join(roots, "root_id", "left_semi")
    rows = rows.join(seen.select("id", "in_trash", F.lit(True).alias("seen")), "id", "left").join(elsewhere.select("id", F.lit(True).alias("other")).distinct(), "id", "left")
    n, is_seen = F.col("missing_count"), F.col("seen").isNotNull()
    trashed = F.coalesce("in_trash", F.lit(False))
    gone = F.lit("not_found")
    if removed is not None:
        rows = rows.join(removed.select("root_id", F.lit(True).alias("removed")).distinct(), "root_id", "left")
        gone = F.when(F.col("removed"), "root_removed").otherwise("not_found")
    count = F.when(trashed, n + 1).when(~is_seen & F.col("other").isNotNull(), None).when(is_seen, F.when(n > 0, 0)).otherwise(n + 1)
    to_trash, reason = (trashed | (~is_seen & F.col("other").isNull())) & (n + 1 >= grace), F.when(trashed, "in_trash").otherwise(gone)
    if confirmed is not None:
        rows = rows.join(confirmed.groupBy("id").agg(F.min("reason").alias("confirmed")), "id", "left")
        at_once = F.col("confirmed").isNotNull()
        count, to_trash, reason = F.when(at_once, n).otherwise(count), at_once | to_trash, F.coalesce("confirmed", reason)
    out = rows.select("id", count.cast("int").alias("missing_count"), to_trash.alias("to_trash"), reason.alias("reason"))
    return out.filter("missing_count is not null")


def trash_limits(trash: int | Column, managed: int | Column, most_ratio: float = 0.2, most_count: int = 50) -> Column:
    """Whether a plan trashes too much; all of nothing is too much."""
    trash, managed = (x if isinstance(x, Column) else F.lit(x) for x in (trash, managed))
    ratio = F.when(managed == 0, F.when(trash > 0, float("inf")).otherwise(0.0)).otherwise(trash / managed)
    return (trash > most_count) | (ratio > most_ratio)


def upsert(old: DataFrame, new: DataFrame, key: str, kept: list[str] = (), frozen: list[str] = ()) -> DataFrame:
    """``old`` overwritten by ``new`` on ``key``: a null leaves ``kept`` columns as they were, ``frozen`` ones never change."""
    columns = old.columns
    joined = old.select(key, F.lit(True).alias("_o"), *(F.col(c).alias(f"_o_{c}") for c in columns if c != key)).join(new.select(key, F.lit(True).alias("_n"), *(F.col(c).alias(f"_n_{c}") for c in columns if c != key)), key, "full_outer")

    def one(c: str) -> Column:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in frozen:
            return F.when(F.col("_o").isNotNull(), o).otherwise(n)
        if c in kept:
            return F.coalesce(n, o)
        return F.when(F.col("_n").isNotNull(), n).otherwise(o)

    return joined.select(key, *(one(c).alias(c) for c in columns if c != key))


def violations(actions: DataFrame, complete: bool, managed: int, allow_large: bool = False, most_ratio: float = 0.2, most_count: int = 50) -> DataFrame:
    """``rule, id`` of a plan's actions (``kind, id, source_path, target_path, target_state, managed``) that break a safety rule."""
    kind, trash = F.col("kind"), F.col("kind") == "TRASH"
    rules = {
        "unmanaged_write": (kind == "WRITE") & (F.col("target_state") == "unmanaged"),
        "outside_root": F.exists(F.array("source_path", "target_path"), lambda p: p.isNotNull() & ~names.within_root(p)),
        "unmanaged_destructive": kind.isin("MOVE", "TRASH") & ~F.col("managed"),
        "root_removal": trash & F.col("source_path").isin("", "."),
        "partial_trash": trash & F.lit(not complete),
    }
    # One reading gives each row its broken rules; one aggregate finds shared outputs, one row the trash of all.
    broken = F.filter(F.array(*(F.when(condition, name) for name, condition in rules.items())), lambda x: x.isNotNull())
    rows = actions.select(F.explode(broken).alias("rule"), "id")
    outputs = actions.filter(kind.isin("WRITE", "MOVE")).select("id", names.collision_key(F.col("target_path")).alias("k"))
    shared = outputs.groupBy("k", "id").agg(F.lit("shared_output").alias("rule"))
    several = shared.groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("k")
    out = rows.unionByName(shared.join(several, "k", "left_semi").select("rule", "id").distinct())
    if not allow_large:
        total = actions.agg(F.count_if(trash).alias("n"))
        out = out.unionByName(total.filter(trash_limits(F.col("n"), managed, most_ratio, most_count)).select(F.lit("too_much_trash").alias("rule"), F.lit(None).cast("string").alias("id")))
    return out


class Refused(ValueError):
    """A plan that breaks safety rules: nothing of its run was written."""


def raise_on(broken: DataFrame, message: str = "the plan breaks safety rules") -> None:
    """The one eager step of a run: nothing is written if there is a violation."""
    some = [r.asDict() for r in broken.limit(20).collect()]
    if some:
        raise Refused(f"{message}: {some}")


def counts(actions: DataFrame) -> DataFrame:
    """One row: actions by kind, warnings not counted."""
    return actions.agg(*(F.count_if(F.col("action") == k).alias(f"n_{k.lower()}") for k in ("CREATE", "UPDATE", "MOVE", "TRASH", "UNCHANGED", "ERROR")))


def allocate(planned: DataFrame, stored: DataFrame, existing: DataFrame) -> DataFrame:
    """``id, path, fell_back`` of planned paths (``id, path, ordinal``): a move whose target is taken goes beside it.

    Taken: planned for another resource, or there already (``existing``: ``path``).
    A fallback that is taken itself is found by ``blocked_fallbacks``.
    """
    keyed = planned.withColumn("k", names.collision_key(F.col("path")))
    owners = keyed.groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    rows = keyed.join(stored.select("id", F.col("local_path").alias("now")), "id", "left").join(owners, "k", "left").join(existing.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    moves = F.coalesce((F.col("now") != "") & (F.col("now") != F.col("path")), F.lit(False))
    taken = (F.col("a") != F.col("b")) | F.col("there").isNotNull()
    fell = moves & taken
    return rows.select("id", F.when(fell, names.beside(F.col("path"), F.col("id"))).otherwise(F.col("path")).alias("path"), fell.alias("fell_back"))


def blocked_fallbacks(allocated: DataFrame, planned: DataFrame, stored: DataFrame, existing: DataFrame) -> DataFrame:
    """``id, path`` of fallbacks (of ``allocate``) that are taken too, for which a run must stop.

    Taken: planned for another resource, the fallback of another one, or there already, unless the resource itself is stored there.
    """
    def owned(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(names.collision_key(F.col("path")).alias("k")).agg(F.min("id").alias(f"{name}_a"), F.max("id").alias(f"{name}_b"))

    fell = allocated.filter("fell_back").select("id", "path", names.collision_key(F.col("path")).alias("k"))
    rows = fell.join(owned(planned, "plan"), "k", "left").join(owned(fell, "fall"), "k", "left")
    rows = rows.join(stored.select("id", F.col("local_path").alias("now")), "id", "left").join(existing.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    others = [F.coalesce(F.col(c) != F.col("id"), F.lit(False)) for c in ("plan_a", "plan_b", "fall_a", "fall_b")]
    there = F.col("there").isNotNull() & ~F.col("path").eqNullSafe(F.col("now"))
    return rows.filter(others[0] | others[1] | others[2] | others[3] | there).select("id", "path")
