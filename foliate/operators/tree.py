"""Hierarchies: traversal with cycle guards, paths, reachability.

Where each node has one parent, ancestors come by pointer doubling: a round joins the table with itself and doubles how
far each row sees, so a chain of a hundred thousand nodes takes seventeen. Walks that may find a node more than once go
level by level; a level is stored before the next, and all levels are read as one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import names
from foliate.sources.tables import Levels, store


def climb(nodes: DataFrame, label: str | None = None) -> DataFrame:
    """``id, top, depth, stem, state`` of nodes (``id, parent_id``, the smallest parent of an id that has several).

    ``top`` is the last ancestor that a node's chain reaches, ``depth`` the steps to it, ``stem`` the chain's values of the
    column ``label`` from there on, joined by slashes (null without one). ``state``: rooted where the top has no parent,
    missing where the next ancestor isn't there (it is the top then), cycle where the chain never ends (it has no stem then).
    Joins are by shuffles: what a round holds is as large as the input.
    """
    value = F.col(label) if label else F.lit(None).cast("string")
    one = nodes.select("id", "parent_id", value.alias("stem")).groupBy("id").agg(F.min(F.struct("parent_id", "stem")).alias("x")).select("id", "x.*")
    root = F.col("parent_id").isNull()
    now = store(one.select("id", F.coalesce("parent_id", "id").alias("top"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), F.col("id").alias("least"), "stem", F.when(root, "rooted").alias("state")), "climb")
    while not now.filter("state is null").isEmpty():
        # Rows without a state have seen equally many steps, so two spans in a row share their smallest id only where the chain comes back.
        up = now.select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), F.col("least").alias("_least"), F.col("stem").alias("_stem"), F.coalesce("state", F.lit("")).alias("_state"))
        far = now.filter("state is null").join(up.hint("merge"), "top", "left")
        gone = F.col("_state").isNull()
        again = (F.col("_state") == "cycle") | ((F.col("_state") == "") & F.coalesce(F.col("least") == F.col("_least"), F.lit(False)))
        state = F.when(gone, "missing").when(again, "cycle").otherwise(F.nullif("_state", F.lit("")))
        stem = F.when(gone, F.col("stem")).when(~again, F.concat("_stem", F.lit("/"), "stem"))
        far = far.select("id", F.when(gone, F.col("top")).otherwise(F.col("_top")).alias("top"), F.when(gone, F.col("depth")).otherwise(F.col("depth") + F.col("_depth")).alias("depth"), F.least("least", "_least").alias("least"), stem.alias("stem"), state.alias("state"))
        now = store(now.filter("state is not null").unionByName(far), "climb")
    return now.drop("least")


def descend(nodes: DataFrame, start: str = "parent_id is null") -> DataFrame:
    """``id, parent_id, depth, trail`` of nodes reachable from the roots; ``nodes``: ``id, parent_id``.

    ``trail`` holds the ids from the root on; a node on its own trail isn't entered again, and one that several parents
    lead to is found once for each way.
    """
    levels = Levels(nodes.sparkSession, "walk")
    frontier = levels.add(nodes.filter(start).select("id", "parent_id", F.lit(0).alias("depth"), F.array("id").alias("trail")))
    while not frontier.isEmpty():
        up = frontier.select(F.col("id").alias("parent_id"), F.col("depth").alias("above"), F.col("trail").alias("over"))
        below = nodes.select("id", "parent_id").join(up, "parent_id").filter(~F.array_contains("over", F.col("id")))
        frontier = levels.add(below.select("id", "parent_id", (F.col("above") + 1).alias("depth"), F.concat("over", F.array("id")).alias("trail")))
    return levels.all()


def first_discovery(found: DataFrame) -> DataFrame:
    """One row for each id: the shallowest discovery, then the first trail."""
    best = F.min(F.struct("depth", "trail", "parent_id")).alias("b")
    return found.groupBy("id").agg(best).select("id", "b.parent_id", "b.depth", "b.trail")


def paths(resources: DataFrame) -> DataFrame:
    """``id, depth, path`` from ``id, parent_id, filename``: parents' names as folders, then the file."""
    return climb(resources, "filename").filter("state = 'rooted'").select("id", F.col("depth").cast("int").alias("depth"), F.concat("stem", F.lit(".md")).alias("path"))


def unplanned(resources: DataFrame, planned: DataFrame) -> DataFrame:
    """Resources that no path reaches: members or descendants of a cycle, or of a missing parent."""
    return resources.join(planned.select("id").hint("merge"), "id", "left_anti").select("id", "parent_id")


def missing_parents(resources: DataFrame) -> DataFrame:
    return resources.filter("parent_id is not null").join(resources.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


def reach(candidates: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """``id, reachability``: inside, outside, or unknown for a cycle or a missing ancestor.

    ``links``: ``id, parent_id``, where an id that isn't there can't be looked up; chains end at ``root``.
    """
    ends = links.sparkSession.range(1).select(F.lit(root).alias("id"), F.lit(None).cast("string").alias("parent_id"))
    known = climb(links.filter(F.col("id") != root).select("id", "parent_id").unionByName(ends)).select("id", "top", "state")
    inside = (F.col("state") == "rooted") & (F.col("top") == root)
    found = candidates.select("id").join(known.hint("merge"), "id", "left")
    return found.select("id", F.when(inside, "inside").when(F.col("state") == "rooted", "outside").otherwise("unknown").alias("reachability"))


def not_among(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``asked`` whose ``id`` a search didn't find; both may be as large as the input."""
    return asked.join(found.select("id").hint("merge"), "id", "left_anti")


def index_path(path, has_source):
    """A database with a source is a folder with an index page."""
    return F.when(has_source, F.regexp_replace(path, r"\.md$", "/_index.md")).otherwise(path)


def expand_sources(resources: DataFrame, rows: DataFrame) -> DataFrame:
    """Resources with the rows of their data sources as pages below them; a title falls back to the id."""
    owners = resources.filter("data_source_id is not null").groupBy("data_source_id").agg(F.min(F.struct("ordinal", "id", "root_id")).alias("o"))
    pages = rows.join(owners, "data_source_id").select(F.col("row_id").alias("id"), F.col("o.id").alias("parent_id"), F.coalesce(F.nullif("title", F.lit("")), "row_id").alias("title"), F.col("o.root_id").alias("root_id"))
    return resources.select("id", "parent_id", "title", "root_id").unionByName(pages)


def completeness(roots: DataFrame, warnings: DataFrame) -> DataFrame:
    """``root_id, status, deletion_allowed``: a root with a warning that stops traversal is partial."""
    broken = warnings.filter(F.col("type") != "multiple_data_sources").select("root_id").distinct().withColumn("broken", F.lit(True))
    ok = F.col("broken").isNull()
    return roots.join(broken, "root_id", "left").select("root_id", F.when(ok, "complete").otherwise("partial").alias("status"), ok.alias("deletion_allowed"))


def empty_folders(paths_left: DataFrame, removed: DataFrame) -> DataFrame:
    """Folders of removed files that hold nothing any more (one level)."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")
    left = paths_left.join(removed, "path", "left_anti").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("folder")).distinct()
    return removed.select(folder).filter("folder <> ''").distinct().join(left, "folder", "left_anti")


def filenames(resources: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """``id, parent_id, filename``: names within a folder differ in more than case.

    Of equal names the smallest id keeps the bare one, but a stored name that is the
    bare one or the bare one with a suffix comes first (``previous``: ``id, stored``).
    """
    # Names are made once: what follows reads them many times, which would not compile as one expression.
    base = store(resources.select("id", "parent_id", names.segment(F.col("title"), F.col("id")).alias("base")), "names")
    if previous is not None:
        base = base.join(store(previous.select("id", names.segment(F.col("stored"), F.col("id")).alias("stored")), "stored_names"), "id", "left")
    else:
        base = base.withColumn("stored", F.lit(None).cast("string"))
    valid = F.when((F.col("stored") == F.col("base")) | F.col("stored").startswith(F.concat("base", F.lit("--"))), F.col("stored"))
    keyed = base.select("id", "parent_id", "base", F.coalesce("parent_id", F.lit("<root>")).alias("folder"), F.lower("base").alias("bk"), valid.alias("vs"))
    # Only groups of equal names need an order, so names that stand alone are never sorted.
    firsts = keyed.filter("vs is not null").groupBy("folder", "bk", F.lower("vs").alias("vk")).agg(F.min("id").alias("keeper"))
    kept = keyed.join(firsts.select("keeper", F.col("vk").alias("kept_key")), (F.col("id") == F.col("keeper")) & (F.lower("vs") == F.col("kept_key")), "left").withColumn("keep", F.when(F.col("keeper").isNotNull(), F.col("vs"))).drop("keeper", "kept_key")
    state = kept.groupBy("folder", "bk").agg(F.max(F.lower("keep") == F.col("bk")).alias("taken"), F.min(F.when(F.col("keep").isNull(), F.col("id"))).alias("first"))
    placed = kept.join(state, ["folder", "bk"])
    bare = ~F.coalesce("taken", F.lit(False)) & (F.col("id") == F.col("first"))
    return placed.select("id", "parent_id", F.coalesce("keep", F.when(bare, F.col("base")).otherwise(names.with_suffix(F.col("base"), F.col("id")))).alias("filename"))


def ordered(planned: DataFrame) -> DataFrame:
    """``planned`` (``id, path``) with ``place``, its place from 1 in the order of locale ``en``; paths that it holds equal go by their bytes, then by id.

    Sorted by ranges and numbered within each, so no task holds all paths.
    """
    keys = [F.expr("path collate UNICODE"), F.col("path"), F.col("id")]
    n = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = planned.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    held = store(numbered, "ordered_paths").withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    # One row for each range bounds the broadcast and the window.
    base = held.groupBy("_part").agg(F.count("*").alias("n")).select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_base"))
    return held.join(F.broadcast(base), "_part").select(*planned.columns, (F.col("_base") + F.col("_row") + 1).alias("place"))
