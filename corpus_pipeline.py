"""Documents to token ids: quality, near duplicates, decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. In all of them further columns, of
whatever names, go through unchanged (but for ``n_chars``, the length of the text as it is now), an empty table gives an
empty one, ids may be null or repeated, and texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import bpe, common, decontam, neardup, pii, quality

#: Documents that score less go; so do those of which more than half of the words are benchmark passages.
LEAST_QUALITY, MOST_CONTAMINATED = 0.3, 0.5


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of characters of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    Null and empty texts are scored as texts without words are; repeated rows get one score, so they stay or go together;
    without labels every document has the same score, which is above the limit.
    """
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"), LEAST_QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest id, nulls first.

    Null texts and texts without words are near nothing, so they all stay; of equal ids with different texts in a group
    the smallest hash stays; rows repeated as a whole stay or go together.
    """
    return neardup.deduplicate(docs, percent=75)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out benchmark passages; drops documents of which more than half of the words are such.

    Null and empty texts hold no words and stay; a passage is cut wherever it stands; items without words match nothing.
    """
    return _counted(decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"), window=10, most_share=MOST_CONTAMINATED))


def surrogate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; no row is dropped.

    Null and empty texts stay as they are; repeated rows get equal texts; who appears in several documents has one surrogate.
    """
    aside = {c: common.free(f"{c}_kept", docs.columns) for c in ("n_entities", "entities") if c in docs.columns}
    return _counted(pii.replace(docs.withColumnsRenamed(aside)).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns)))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the ids of the text and their number, for each row.

    A null or empty text has no ids; repeated rows are encoded alike.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_decode(docs, path, lambda ids, _: (ids.astype("i4"), len(ids)), "ids array<int>, n_tokens long", cached=100_000)  # workers of other stages need their memory


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("surrogates", surrogate_stage),
    ("encoding", encoding_stage),
]

#: A trained network and surrogates keyed by digest don't go into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = common.store(out, f"pipeline_{k}_{name}") if k + 1 < len(STAGES) else out
    return docs
