"""The six read calls of a document API as exported JSON-lines entities, read with fixed schemas.

A crawl folder holds one sub-folder for each entity.  Spark reads them from any store;
malformed lines become violations instead of failing a scan half-way.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import texts

#: Property maps stay JSON text: the order of their keys is part of the data.
SCHEMAS = {
    "pages": "object string, id string, parent struct<type:string,page_id:string,database_id:string>, properties string, last_edited_time string, in_trash boolean, archived boolean, url string",
    "databases": "id string, data_sources array<struct<id:string>>",
    "blocks": "id string, page_id string, parent_block_id string, ordinal long, type string, has_children boolean, last_edited_time string, in_trash boolean, archived boolean, url string, payload string",
    "markdown": "page_id string, markdown string, truncated boolean, unknown_block_ids array<string>",
    "data_source_rows": "data_source_id string, cursor long, has_more boolean, next_cursor string, results array<struct<object:string,id:string,properties:string>>",
    "search": "cursor long, has_more boolean, next_cursor string, results array<struct<object:string,id:string>>",
}


def entity(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An entity's rows; what can't be parsed is in ``_broken``."""
    return spark.read.schema(f"{SCHEMAS[name]}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(f"{root.rstrip('/')}/{name}")


def broken(rows: DataFrame) -> DataFrame:
    """Lines that aren't the entity's JSON."""
    return rows.select(F.lit(1).alias("one"), *rows.columns).filter("_broken is not null").select("_broken")


def log(level: str = "info", secrets: list[str] = ()) -> logging.Logger:
    """A logger with a threshold; secrets and the queries of URLs never reach its handlers."""
    import re

    class Redact(logging.Filter):
        def filter(self, record: logging.LogRecord) -> bool:
            text = record.getMessage()
            for s in filter(None, secrets):
                text = text.replace(s, "[REDACTED]")
            record.msg, record.args = re.sub(r"(https?://[^\s?]+)\?\S+", r"\1?[REDACTED]", text), ()
            return True

    logger = logging.getLogger("foliate")
    logger.setLevel(level.upper())
    logger.filters[:] = [Redact()]
    return logger


def redacted(events: DataFrame, secrets: list[str]) -> DataFrame:
    """``name, value`` log fields as they may be kept."""
    return events.select("name", texts.redact_value(F.col("name"), texts.redact(F.col("value"), secrets)).alias("value"))
