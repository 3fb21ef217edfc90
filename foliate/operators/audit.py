"""Stored state against the files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify(files: DataFrame, resources: DataFrame, assets: DataFrame, asset_files: DataFrame) -> DataFrame:
    """``type, path, id`` of each issue, and of unmanaged files.

    ``files``: ``path, symlink, marker_id, body_hash`` (no marker: unmanaged);
    ``resources``: ``id, local_path, expected_path, status, content_hash``.
    """
    stored = resources.select(F.col("id").alias("marker_id"), "local_path", F.col("content_hash").alias("stored_hash"), F.lit(True).alias("known"))
    own = files.join(stored, "marker_id", "left")
    placed = F.coalesce(F.col("local_path") == F.col("path"), F.lit(False))
    kind = (
        F.when(F.col("symlink"), "symlink").when(F.col("marker_id").isNull(), "unmanaged").when(F.col("known").isNull(), "orphan_managed_file")
        .when(~placed, "state_mismatch").when(F.col("stored_hash").isNotNull() & ~F.col("stored_hash").eqNullSafe(F.col("body_hash")), "content_mismatch")
    )
    judged = own.withColumn("type", kind)
    seen = judged.filter((F.col("type").isNull() | (F.col("type") == "content_mismatch"))).select(F.col("marker_id").alias("id")).distinct()
    lost = resources.filter("status = 'active'").join(seen, "id", "left_anti").select(F.lit("missing_file").alias("type"), F.coalesce("local_path", "expected_path").alias("path"), "id")
    gone = assets.join(asset_files.select(F.col("path").alias("local_path")), "local_path", "left_anti").select(F.lit("missing_asset").alias("type"), F.col("local_path").alias("path"), F.col("page_id").alias("id"))
    return judged.filter("type is not null").select("type", "path", F.col("marker_id").alias("id")).unionByName(lost).unionByName(gone)


def recover(files: DataFrame, resources: DataFrame) -> DataFrame:
    """``type, id, path``: findings after a crash, the first matching rule of each resource.

    ``files``: ``path, id, temporary, content_hash, inode``; ``resources``: ``id, local_path, expected_path, content_hash``.
    """
    stable = files.filter("not temporary").withColumnRenamed("path", "at").withColumnRenamed("content_hash", "file_hash")
    rows = resources.join(stable, "id", "left")
    pick = lambda c: F.min(F.when(c, F.struct("at", "file_hash", "inode")))
    in_trash = F.col("at").startswith(".trash/")
    facts = rows.groupBy("id", "local_path", "expected_path", "content_hash").agg(
        pick(F.col("at") == F.col("expected_path")).alias("expected"), pick(F.col("at") == F.col("local_path")).alias("local"), pick(in_trash).alias("trashed"),
        F.collect_list(F.when(in_trash, F.struct("inode", "at"))).alias("trash"),
    )
    linked = F.get(F.filter("trash", lambda t: t["inode"] == F.col("local.inode")), F.lit(0))["at"]
    at_home = F.col("local").isNotNull() & (F.col("local_path") == F.col("expected_path"))
    out = lambda kind, path: F.struct(F.lit(kind).alias("type"), path.alias("path"))
    none = F.array().cast("array<struct<type:string,path:string>>")
    found = (
        F.when(F.col("trashed").isNotNull() & F.col("expected").isNull() & F.col("local").isNull(), F.array(out("trash_relinked", F.col("trashed.at"))))
        .when(at_home & linked.isNotNull(), F.array(out("trash_relinked", linked), out("duplicate_removed", F.col("local.at"))))
        .when(F.col("expected").isNotNull() & ~F.col("local_path").eqNullSafe(F.col("expected_path")), F.concat(F.array(out("move_relinked", F.col("expected.at"))), F.when(F.col("local").isNotNull(), F.array(out("duplicate_removed", F.col("local.at")))).otherwise(none)))
        .when(F.col("local").isNotNull(), F.when(F.col("local.file_hash").isNotNull() & ~F.col("local.file_hash").eqNullSafe(F.col("content_hash")), F.array(out("content_relinked", F.col("local.at")))).otherwise(none))
        .otherwise(F.array(out("missing_file", F.coalesce("local_path", "expected_path"))))
    )
    own = facts.select("id", F.explode(found).alias("f")).select("f.type", "id", "f.path")
    known = resources.select("id")
    temporary = files.filter("temporary").join(known, "id", "left_semi").select(F.lit("tmp_removed").alias("type"), "id", "path")
    orphans = files.filter("not temporary").join(known, "id", "left_anti").select(F.lit("orphan_managed_file").alias("type"), "id", "path")
    return own.unionByName(temporary).unionByName(orphans)


def status(resources: DataFrame) -> DataFrame:
    return resources.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("active", "missing", "tombstoned")))
