"""Source divergence audit: every group of a language against every other, by systolic rotation.

Groups (language, source) are dealt into blocks, kept terms of a language into segments. Each block of a segment is
resident in one partition. The others of its language visit it as compressed vectors, in the order of a round-robin
tournament, so each two blocks meet once: one of them is host, and a meeting evaluates both directions. Visitors are
streamed, so a task holds the residents of one block (``GROUPS`` by ``TERMS`` numbers) and one visitor. Distances of
segments are whole numbers that a sum brings together. The language's own vector comes first; each resident keeps its
leading terms in a local heap, and the heaps of segments are ranked together.

Edge cases: null text, language and source are ''; groups without terms take part with counts of 0; a language without
kept terms has pairs of value 0; repeated rows count again; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.common import partitions, small_batches, store

#: Parameters: groups of a block (about) and terms of a segment (about), which bound what a task holds.
GROUPS, TERMS = 16, 1 << 15
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_HELD, _WORDS = 2_000_000, 300_000
SCALE, PRIOR = 10**9, 5


def terms(text: bytes) -> list[bytes]:
    return text.lower().translate(_LETTERS).split()


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first, axis=0)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` (occurrences, and documents of the group that hold it); a null term for each group itself."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: defaultdict[bytes, int] = defaultdict(lambda: len(words))
        groups: defaultdict[tuple, int] = defaultdict(lambda: len(groups))
        keys: list[np.ndarray] = []
        values: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            names, own = list(words), list(groups)
            k, v = _sums(np.concatenate(keys), np.concatenate(values)) if keys else (np.empty(0, np.int64), np.empty((0, 2), np.int64))
            g, w = (k >> 32).tolist(), (k & 0xFFFFFFFF).tolist()
            out = pa.RecordBatch.from_arrays([
                pa.array([own[i][0] for i in g] + [x[0] for x in own], pa.string()), pa.array([own[i][1] for i in g] + [x[1] for x in own], pa.string()),
                pa.array([names[i] for i in w] + [None] * len(own), pa.binary()).cast(pa.string()), pa.array(v[:, 0].tolist() + [0] * len(own), pa.int64()), pa.array(v[:, 1].tolist() + [0] * len(own), pa.int64()),
            ], names=["lang", "source", "term", "n", "docs"])
            words.clear(), groups.clear(), keys.clear(), values.clear()
            return out

        for batch in batches:
            each = [terms(x or b"") for x in batch.column(0).cast(pa.binary()).to_pylist()]
            lengths = np.array([len(e) for e in each], np.int64)
            ids = np.fromiter((words[w] for e in each for w in e), np.int64, int(lengths.sum()))
            own = np.fromiter((groups[x] for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), np.int64, len(each))
            pairs, n = np.unique(np.repeat(np.arange(len(each)), lengths) << 32 | ids, return_counts=True)  # a document's terms
            if len(pairs):
                k, v = _sums(own[pairs >> 32] << 32 | pairs & 0xFFFFFFFF, np.stack([n, np.ones_like(n)], axis=1))
                keys.append(k), values.append(v)
            if sum(map(len, keys)) > _HELD or len(words) > _WORDS:
                yield flush()
        if groups:
            yield flush()

    small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), by long division, so that counts up to 9 * 10^15 stay exact."""
    divisor, rest = np.int64(total + PRIOR * kept), count + np.int64(PRIOR)
    out = rest // divisor
    rest = rest % divisor
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // divisor
        rest = rest % divisor
    return out + 1


def _vector(place: list[int], count: list[int]) -> bytes:
    order = np.argsort(place)
    return zstandard.compress(np.array(place, "<u4")[order].tobytes() + np.array(count, "<u8")[order].tobytes(), 1)


def _dense(blob: bytes | None, total: int, kept: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts, and their probabilities, of a segment's ``size`` terms."""
    count = np.zeros(size, np.int64)
    if blob is not None:
        raw = zstandard.decompress(blob)
        n = len(raw) // 12
        count[np.frombuffer(raw, "<u4", n)] = np.frombuffer(raw, "<u8", n, 4 * n).astype(np.int64)
    return count, probability(count, total, kept) if kept else count


def _opponents(blocks: Column, block: Column) -> Column:
    """``(round, host)`` of the meetings that ``block`` goes to as a visitor: the circle method, with an idle place if blocks are odd in number."""
    places = blocks + blocks % 2
    ring = places - 1
    each = F.sequence(F.lit(0), F.greatest(F.lit(0), ring - 1))

    def other(r: Column) -> Column:
        mirrored = F.pmod(2 * r - block, ring)
        return F.when(block == ring, r).when(mirrored == block, ring).otherwise(mirrored)

    meetings = F.transform(each, lambda r: F.struct(r.cast("int").alias("round"), other(r).cast("int").alias("host")))
    away = lambda m: (m["host"] < blocks) & F.when((block + m["host"]) % 2 == 0, block > m["host"]).otherwise(block < m["host"])  # noqa: E731  each block is host about as often as visitor
    return F.when(blocks > 1, F.filter(meetings, away)).otherwise(F.array().cast("array<struct<round:int,host:int>>"))


def _meet(top: int):
    """Streams a host's rows: the language, the residents, then the visitors round by round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, residents, names = None, None, [], []
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)], names=["lang", "source", "is_term", "item", "value"])
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                key = row["lang"], row["segment"], row["host"]
                if key != now:
                    now, residents, own = key, [], np.empty(0, np.int64)  # a segment may hold no term
                size = row["size"]
                count, p = _dense(row["vector"], row["total"], row["kept"], size)
                if row["kind"] == 0:
                    own, names = p, zstandard.decompress(row["terms"]).decode().split("\n") if row["terms"] else []
                    continue
                for source, q in residents:
                    value = int(np.abs(q - p).sum())
                    out += [(row["lang"], source, False, row["source"], value), (row["lang"], row["source"], False, source, value)]
                if row["kind"] == 1:
                    residents.append((row["source"], p))
                    if row["kept"]:
                        at = np.flatnonzero((count > 0) & (p > own))
                        best = heapq.nsmallest(top, zip((own[at] - p[at]).tolist(), at.tolist(), strict=True))
                        out += [(row["lang"], row["source"], True, names[i], -v) for v, i in best]
                if len(out) > 10_000:
                    yield emit()
        if out:
            yield emit()

    return run


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, groups: int = GROUPS, segment_terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``."""
    spark = docs.sparkSession
    counts = store(term_counts(docs), "audit_counts")
    lexicon = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    lexicon = store(lexicon.select("lang", "term", "n"), "audit_terms")
    sources = counts.filter("term IS NULL").select("lang", "source")
    of_lang = sources.groupBy("lang").agg(F.count("*").alias("n_sources")).join(lexicon.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total")), "lang", "left")
    of_lang = store(of_lang.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.ceil(F.col("n_sources") / groups).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) / segment_terms)).cast("int").alias("segments")), "audit_languages")
    cells = Window.partitionBy("lang", "segment").orderBy("term")
    placed = lexicon.join(of_lang.select("lang", "segments"), "lang").withColumn("segment", F.pmod(F.xxhash64("term"), F.col("segments")).cast("int"))
    placed = store(placed.withColumn("place", F.row_number().over(cells) - 1).select("lang", "term", "n", "segment", "place"), "audit_places")
    held = counts.filter("term IS NOT NULL").select("lang", "source", "term", F.col("n").alias("own")).join(placed.drop("n"), ["lang", "term"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, names = [], []
            for x in batch.column("x").to_pylist():
                vectors.append(_vector([e["place"] for e in x], [e["n"] for e in x]))
                names.append(zstandard.compress("\n".join(e["term"] for e in sorted(x, key=lambda e: e["place"])).encode(), 1) if x and x[0]["term"] is not None else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "segment", "source", "own_total")), pa.array(vectors, pa.binary()), pa.array(names, pa.binary())], names=["lang", "segment", "source", "own_total", "vector", "terms"])

    def packed(rows: DataFrame, *by: str) -> DataFrame:
        """A group's cell of a segment: at most a segment's terms."""
        grouped = rows.groupBy("lang", "segment", *by).agg(F.collect_list(F.struct("place", "n", "term")).alias("x"), F.sum("n").alias("own_total"))
        return grouped.select("lang", "segment", *(by or (F.lit(None).cast("string").alias("source"),)), "own_total", "x").mapInArrow(pack, "lang string, segment int, source string, own_total long, vector binary, terms binary")

    mine = store(packed(held.select("lang", "segment", "source", "place", F.col("own").alias("n"), F.lit(None).cast("string").alias("term")), "source"), "audit_vectors")
    totals = mine.groupBy("lang", "source").agg(F.sum("own_total").alias("total"))
    spread = sources.join(of_lang, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).join(totals, ["lang", "source"], "left").select("*", F.explode(F.expr("sequence(0, segments - 1)")).alias("segment"))
    sizes = placed.groupBy("lang", "segment").agg(F.count("*").cast("int").alias("size"))
    spread = spread.join(sizes, ["lang", "segment"], "left").join(mine.select("lang", "segment", "source", "vector"), ["lang", "segment", "source"], "left")
    spread = store(spread.select("lang", "segment", "source", "block", "blocks", "kept", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size"), "vector"), "audit_cells")
    columns = ["lang", "segment", "host", "kind", "round", "source", "total", "kept", "size", "vector", "terms"]
    none = F.lit(None).cast("binary").alias("terms")
    residents = spread.select("lang", "segment", F.col("block").alias("host"), F.lit(1).alias("kind"), F.lit(-1).alias("round"), "source", "total", "kept", "size", "vector", none)
    visitors = spread.withColumn("m", F.explode(_opponents(F.col("blocks"), F.col("block")))).select("lang", "segment", "m.host", F.lit(2).alias("kind"), "m.round", "source", "total", "kept", "size", "vector", none)
    whole = packed(placed.select("lang", "segment", "place", "n", "term")).join(of_lang, "lang").join(sizes, ["lang", "segment"])
    whole = whole.select("lang", "segment", F.explode(F.expr("sequence(0, blocks - 1)")).alias("host"), F.lit(0).alias("kind"), F.lit(-1).alias("round"), "source", F.col("lang_total").alias("total"), "kept", "size", "vector", "terms")
    stream = whole.select(columns).unionByName(residents.select(columns)).unionByName(visitors.select(columns))
    stream = stream.repartition(partitions(spark), "lang", "segment", "host").sortWithinPartitions("lang", "segment", "host", "kind", "round", "source")
    met = stream.mapInArrow(_meet(top), "lang string, source string, is_term boolean, item string, value long")
    summed = store(met.groupBy("lang", "source", "is_term", "item").agg(F.sum("value").alias("value")), "audit_values")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked(summed.filter(~F.col("is_term"))).withColumn("part", F.lit("pair"))
    leading = ranked(summed.filter("is_term")).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(leading).select("lang", "source", "part", "item", "value", "rank")
