"""Trees of blocks as Markdown: each level's texts are put in order into the level above, from the deepest up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import texts
from foliate.operators.tree import climb
from foliate.sources.tables import Levels, store

#: Kinds whose children stand below them, indented or not; those of all others but a table's rows aren't shown.
INDENTED, BELOW = ("bulleted_list_item", "numbered_list_item", "to_do"), ("paragraph",)
FIELDS = {"page": "string", "id": "string", "parent": "string", "place": "long", "type": "string", "text": "string", "checked": "boolean", "language": "string", "url": "string", "width": "int", "header": "boolean", "cells": "array<string>", "payload": "string"}


def _indented(text: Column) -> Column:
    return F.concat(F.lit("  "), F.replace(text, F.lit("\n"), F.lit("\n  ")))


def _table(kids: Column, width: Column, header: Column) -> Column:
    """Rows of one width as a table, null for anything else."""
    right = F.forall(kids, lambda k: (k["type"] == "table_row") & F.coalesce(F.size(k["cells"]) == width, F.lit(False)) & ~F.exists(k["cells"], lambda c: c.isNull()))
    return F.when((width > 0) & (F.size(kids) > 0) & right, texts.table_text(F.transform(kids, lambda k: k["cells"]), F.coalesce(header, F.lit(False))))


def _rendered(rows: DataFrame) -> DataFrame:
    """``page, id, parent, place, type, cells, text, kept``: rows with ``kids`` as Markdown; ``kept`` is what a placeholder stands for."""
    kids = F.coalesce("kids", F.array().cast("array<struct<place:long,id:string,type:string,cells:array<string>,text:string>>"))
    below = F.array_join(F.filter(F.transform(kids, lambda k: k["text"]), lambda t: t != ""), "\n")
    kind, own = F.col("type"), F.coalesce("text", F.lit(""))
    line = texts.block_line(kind, own, F.col("checked"), F.col("language"), F.col("url"), F.col("id"))
    nested = F.when(below == "", "").otherwise(F.concat(F.lit("\n"), F.when(kind.isin(*INDENTED), _indented(below)).otherwise(below)))
    table = _table(kids, F.col("width"), F.col("header"))
    text = F.when(kind.isin(*INDENTED, *BELOW), F.concat(line, nested)).when(kind == "table", F.coalesce(table, line)).otherwise(line)
    unsupported = (kind != "table_row") & (line == texts.placeholder(kind, F.col("id"))) & F.when(kind == "table", table.isNull()).otherwise(True)
    return rows.select("page", "id", "parent", "place", "type", "cells", text.alias("text"), F.when(unsupported, F.coalesce("payload", F.lit(""))).alias("kept"))


def render(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``page, text``; and ``page, id, type, payload`` of blocks that a placeholder stands for.

    ``blocks``: the columns of ``FIELDS``, ids unique, ``parent`` null at the top of a page. A list item's children are
    indented by two, a paragraph's follow it, a table's rows of cells make it; a table whose rows aren't all of its width
    is kept as it is. Blocks whose parents are missing or go round in a circle are left out. The tree's height in jobs,
    each over one level.
    """
    spark = blocks.sparkSession
    height = climb(blocks.select("id", F.col("parent").alias("parent_id"))).filter("state = 'rooted'").select("id", "depth")
    rows = store(blocks.select(*FIELDS).join(height, "id"), "render_blocks")
    levels = Levels(spark, "rendered")
    below = None
    for depth in range(rows.agg(F.max("depth")).first()[0] or 0, -1, -1):
        own = rows.filter(F.col("depth") == depth)
        if below is None:
            own = own.withColumn("kids", F.lit(None).cast("array<struct<place:long,id:string,type:string,cells:array<string>,text:string>>"))
        else:
            kids = below.groupBy(F.col("parent").alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", "id", "type", "text"))).alias("sorted"), F.collect_list(F.struct("id", "cells")).alias("cells_of"))
            # cells can't be compared, so they are put back after the sort
            cells = F.map_from_entries("cells_of")
            kids = kids.select("of", F.transform("sorted", lambda k: F.struct(k["place"].alias("place"), k["id"].alias("id"), k["type"].alias("type"), F.try_element_at(cells, k["id"]).alias("cells"), k["text"].alias("text"))).alias("kids"))
            own = own.join(kids, F.col("id") == F.col("of"), "left").drop("of")
        below = levels.add(_rendered(own))
    made = levels.all()
    tops = made.filter("parent is null and text <> ''").groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "text"))), lambda k: k["text"]), "\n\n").alias("text"))
    pages = blocks.select("page").distinct().join(tops, "page", "left").select("page", F.coalesce("text", F.lit("")).alias("text"))
    return pages, made.filter("kept is not null").select("page", "id", "type", F.col("kept").alias("payload"))
