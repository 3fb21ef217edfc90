"""Quality classification on random-indexing word vectors.

Tokens (runs of letters, of digits, or of other marks, in their own case) are hashed to
``BUCKETS`` rows.  A row's vector is the sum, over all occurrences in all documents, of
the index vectors of the tokens within two places; an index vector has a few +1 and -1
among ``WIDTH`` places, both told by the token's hash.  The table has a fixed size
however many words the corpus holds, so it is broadcast.  Each task sums its own table
and sends only the rows it touched; those are added up in two levels.

A document is the mean and the spread of its tokens' vectors, rarer ones weighing more,
with its length and how alike neighbouring vectors are.  A two-layer network in numpy is fit on ``most_docs`` labelled
documents at most (those with the smallest hashes, which bounds what the driver holds),
a quarter of which only calibrates the temperature of its probabilities.

Defined results: null and empty texts are zero vectors; rows without a label teach
nothing; of several labels or texts of one id the smallest teaches; with a class missing
every score is the class's share; equal texts get equal scores, wherever they stand; an
empty table gives no rows; further columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm import common

BUCKETS, WIDTH, NEAR, SIGNS = 1 << 15, 48, 2, 4
#: Rows of the table that travel together when tasks' tables are added up.
CHUNK = 32
_TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


class Tokens:
    """Texts to bucket numbers, white-space chunk by chunk through a bounded cache."""

    def __init__(self, cached: int = 150_000):
        self.cached, self.known = cached, {}

    def __call__(self, text: str | None) -> np.ndarray:
        chunks, known = text.split() if text else [], self.known
        try:
            raw = b"".join(map(known.__getitem__, chunks))
        except KeyError:
            if len(known) > self.cached:
                known.clear()
            new = set(chunks).difference(known)
            for c in new:
                known[c] = np.array([zlib.crc32(t.encode()) % BUCKETS for t in _TOKEN.findall(c)], "<i4").tobytes()
            raw = b"".join(map(known.__getitem__, chunks))
            common.forget_long(known, new)
        return np.frombuffer(raw, "<i4")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    n = np.arange(BUCKETS * SIGNS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n = (n ^ (n >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    n ^= n >> np.uint64(29)
    return ((n >> np.uint64(8)) % np.uint64(WIDTH)).astype(np.int64).reshape(BUCKETS, SIGNS), np.where(n & np.uint64(1), 1.0, -1.0).reshape(BUCKETS, SIGNS)


def contexts(ids: list[np.ndarray]) -> np.ndarray:
    """Each bucket's summed contexts within documents, and its count in the last column."""
    places, signs = index_vectors()
    out = np.zeros(BUCKETS * WIDTH)
    flat = np.concatenate(ids).astype(np.int64)
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    for step in range(1, NEAR + 1):
        same = owner[step:] == owner[:-step]
        a, b = flat[:-step][same], flat[step:][same]
        for word, near in ((a, b), (b, a)):
            base = word * WIDTH
            for k in range(SIGNS):
                out += np.bincount(base + places[near, k], signs[near, k], minlength=len(out))
    return np.concatenate([out.reshape(BUCKETS, WIDTH), np.bincount(flat, minlength=BUCKETS)[:, None]], 1)


def train_vectors(docs: DataFrame) -> np.ndarray:
    """The table of all documents' contexts: BUCKETS rows, a few megabytes."""
    spark = docs.sparkSession
    levels = max(1, math.isqrt(common.partitions(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % levels
        tokens, total, held, n = Tokens(), np.zeros((BUCKETS, WIDTH + 1)), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(tokens(text))
                n += len(held[-1])
                if n > 250_000:
                    total += contexts(held)
                    held, n = [], 0
        if n:
            total += contexts(held)
        rows = total.astype("<i8").reshape(-1, CHUNK, WIDTH + 1)  # whole numbers: their sums don't depend on the order
        used = np.flatnonzero(rows.any((1, 2)))
        for k in range(0, len(used), 256):
            at = used[k : k + 256]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), part, np.int32)), pa.array([zlib.compress(rows[i].tobytes(), 1) for i in at], pa.binary())], names=["chunk", "part", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((CHUNK, WIDTH + 1), "<i8")
        for raw in pdf["sums"]:
            total += np.frombuffer(zlib.decompress(raw), "<i8").reshape(total.shape)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "part": [0], "sums": [zlib.compress(total.tobytes(), 1)]})

    common.small_batches(spark)
    kind = "chunk int, part int, sums binary"
    tables = docs.select(F.col("text").cast("string")).mapInArrow(common.trimmed(run), kind)
    summed = tables.groupBy("chunk", "part").applyInPandas(add, kind).groupBy("chunk").applyInPandas(add, kind)
    table = np.zeros((BUCKETS // CHUNK, CHUNK, WIDTH + 1), np.float32)
    for row in summed.select("chunk", "sums").toLocalIterator():
        table[row.chunk] = np.frombuffer(zlib.decompress(bytes(row.sums)), "<i8").reshape(CHUNK, WIDTH + 1)
    return table.reshape(BUCKETS, WIDTH + 1)


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Unit vectors about the mean context, scaled by a weight that falls with frequency, and the weight itself."""
    count, sums = table[:, -1], table[:, :-1]
    mean = sums.sum(0) / max(count.sum(), 1)
    v = sums / np.maximum(count, 1)[:, None] - mean
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    share = count / max(count.sum(), 1)
    weight = 1e-3 / (1e-3 + share)
    return np.concatenate([v * weight[:, None], weight[:, None]], 1).astype(np.float32)


def pooled(ids: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """A row of features for each document: mean and spread of its vectors, its length, its mean weight, and how alike neighbours are."""
    out = np.zeros((len(ids), 2 * WIDTH + 3))
    for k, own in enumerate(ids):
        if not len(own):
            continue
        total, squares, alike, n = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), 0.0, len(own)
        for at in range(0, n, 4096):
            x = vectors[own[at : at + 4097]]  # one more, for the pair across the seam
            alike += float((np.einsum("ij,ij->i", x[:-1, :-1], x[1:, :-1]) / np.maximum(x[:-1, -1] * x[1:, -1], 1e-12)).sum())
            x = x[:4096]
            total += x.sum(0)
            squares += np.einsum("ij,ij->j", x, x)
        mean = total[:-1] / max(total[-1], 1e-9)
        spread = np.sqrt(np.maximum(squares[:-1] / n - (total[:-1] / n) ** 2, 0))
        out[k] = [*mean, *spread, math.log1p(n), total[-1] / n, alike / max(n - 1, 1)]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Row by row: a product of matrices may round a row by its place among others."""
        z = (np.asarray(x, float) - self.mean) / self.scale
        return np.array([float(np.maximum(row @ self.w1 + self.b1, 0) @ self.w2) + self.b2 for row in np.ascontiguousarray(z)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, hidden: int = 64, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = 7) -> Network | float:
    """Adam on the cross entropy of rows that aren't ``held``; those calibrate the temperature."""
    train = ~held
    if len(set(y[train].tolist())) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    random = np.random.default_rng(seed)
    xt, yt = x[train], y[train]
    mean, scale = xt.mean(0), xt.std(0) + 1e-6
    z = (xt - mean) / scale
    p = [random.normal(0, math.sqrt(2 / z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), random.normal(0, math.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = random.permutation(len(z))
        for k in range(0, len(z), 128):
            a, b = z[order[k : k + 128]], yt[order[k : k + 128]]
            h = np.maximum(a @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - b) / len(b)
            dh = np.outer(d, p[2]) * (h > 0)
            t += 1
            for i, g in enumerate((a.T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], d.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if held.any():
        logit, truth = net.logit(x[held]), y[held]
        net.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda s: np.logaddexp(0, np.where(truth == 1, -logit, logit) / s).mean())
    return net


def _features(docs: DataFrame, vectors, keep: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)

    def make():
        tokens, table = Tokens(), vectors.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = pooled([tokens(t) for t in batch.column(len(keep)).to_pylist()], table)
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=[*keep, "features"])

        return each

    return common.on_batches(docs.select(*keep, "text"), make, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", features array<float>")


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, most_docs: int = 20_000, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` with the score as column ``name`` (which ``docs`` doesn't have), learnt from labels outside the held-out fold."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(train_vectors(docs)))
    known = labels.filter(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % folds != 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taught = own.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))  # most_docs rows at most
    rows = sorted((r.doc_id, r._label, r.features) for r in _features(taught, vectors, ["doc_id", "_label"]).collect())
    if rows:
        held = np.array([common.id_hash(i) // folds % 4 == 0 for i, _, _ in rows])
        net = fit(np.array([f for _, _, f in rows], float), np.array([y for _, y, _ in rows]), held)
    else:
        net = 0.5
    shared = spark.sparkContext.broadcast(net)
    columns, text_at = docs.columns, docs.columns.index("text")

    def make():
        tokens, table, net = Tokens(), vectors.value, shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(text_at).to_pylist()
            s = net.score(pooled([tokens(t) for t in texts], table)) if isinstance(net, Network) else np.full(len(texts), net)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*columns, name])

        return each

    return common.on_batches(docs, make, ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + f", `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, least: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, folds)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all columns."""
    name = common.free("quality_score", docs.columns)
    return score(docs, labels, name=name).filter(F.col(name) >= least).select(*docs.columns)
