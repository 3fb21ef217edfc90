"""Toxicity by compression distance with two zstandard dictionaries.

A window is one word between fixed carriers.  It is compressed with two dictionaries,
one of toxic and one of ordinary text, and its distance is the difference of the two
lengths.  Zstandard's own trainer ranks segments by frequency, which in toxic documents
is ordinary text too (it tells the classes apart with an AUC of 0.58 to 0.66 here), so a
toxic dictionary holds the word beginnings that most set its documents apart and the
ordinary one the most frequent words of ordinary documents, each after the carrier: a
word that begins so is one match with the carrier before it and costs no literals.  The
first four letters stand twice, so that each matched one counts for two bytes.  A document's
score is a logistic function of how many of its windows reach each distance, with a
temperature and a threshold calibrated on documents that the fit didn't see.

The fit takes ``most_docs`` labelled documents of each class at most, those with the
smallest hashes among texts of ``most_chars`` characters at most, which bounds what
the driver holds.  Scores cover whole texts.

Defined results: null and empty texts have no windows and get the score of zero counts;
rows without a label or with a null id teach nothing; of several labels or texts of one id
the smallest teaches; with a class missing every score
is the class's share; repeated rows get equal scores; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm import common

#: Distances that are counted apart, in bytes; windows at or beyond the last share its count.
DISTANCES = 16
#: What stands before and after a window's word; both are in either dictionary, since zstandard finds no match in a block's last bytes.
_BEFORE, _AFTER = b"\x01before this word: ", b" and after this word\x02"


def words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def segments(own: list[str], other: list[str], least_z: float = 6.0, odds: float = 4.0, least_share: float = 0.01, most: int = 400) -> list[str]:
    """Word beginnings of 4 to 12 letters whose document frequency sets the classes apart, strongest first.

    ``least_share`` of the own documents hold them, a share ``odds`` times that of the
    others and ``least_z`` standard deviations above it; no shorter beginning is as good.
    Its first four letters alone must be twice as frequent, as they match alone too.
    """
    counts = []
    for texts in (own, other):
        c: Counter = Counter()
        for t in texts:
            c.update({w[:n] for w in {x + " " for x in words(t)} for n in range(4, min(len(w), 12) + 1)})
        counts.append(c)
    a, b, n_a, n_b = *counts, len(own), len(other)

    def z(s: str) -> float:
        p = (a[s] + b[s]) / (n_a + n_b)
        return (a[s] / n_a - b[s] / n_b) / math.sqrt(p * (1 - p) * (1 / n_a + 1 / n_b) + 1e-12)

    share = lambda s, times: a[s] / n_a >= times * (b[s] + 0.5) / n_b
    pure = {s: v for s in a if a[s] >= max(4, least_share * n_a) and share(s, odds) and share(s[:4], 2) and (v := z(s)) >= least_z}
    kept: dict[str, float] = {}
    for s in sorted(pure, key=lambda s: (len(s), s)):
        if not any(s[:n] in kept for n in range(4, len(s))):
            kept[s] = pure[s]
    return sorted(kept, key=lambda s: (-kept[s], s))[:most]


def usual(texts: list[str], without: list[str], most: int = 50) -> list[str]:
    """The most frequent words that don't share three letters with the beginning of a segment of ``without``."""
    c = Counter(w + " " for t in texts for w in words(t))
    apart = {s[:3] for s in without}
    return [s for s, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])) if s[:3] not in apart][:most]


def _bytes(word: str) -> bytes:
    """A byte for each Latin letter, so that accented ones share nothing, and two for the first ones."""
    return ("".join([c * 2 for c in word[:4]]) + word[4:]).encode("latin-1", "xmlcharrefreplace")


class Distance:
    """Distances of words, by two compressors."""

    def __init__(self, ordinary: list[str], toxic: list[str], cached: int = 400_000):
        import zstandard

        def compressor(own: list[str]):
            content = b"".join([*(_BEFORE + _bytes(s) + b"\n" for s in own), _AFTER, _BEFORE, b"\n"])
            how = zstandard.ZstdCompressionParameters.from_level(3, min_match=6, strategy=zstandard.STRATEGY_BTLAZY2, search_log=9, hash_log=14, chain_log=15, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=15)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress

        self.ordinary, self.toxic = compressor(ordinary), compressor([*ordinary, *reversed(toxic)])
        self.cached, self.known = cached, {}

    def __call__(self, word: str) -> int:
        window = _BEFORE + _bytes(word) + _AFTER
        return min(max(len(self.ordinary(window)) - len(self.toxic(window)), 0), DISTANCES)

    def counts(self, text: str | None) -> np.ndarray:
        """How many of a text's windows are at each distance."""
        own, known = words(text), self.known
        try:
            found = bytes(map(known.__getitem__, own))
        except KeyError:
            if len(known) > self.cached:
                known.clear()
            new = set(own).difference(known)
            for w in new:
                known[w] = self(w)
            found = bytes(map(known.__getitem__, own))
            common.forget_long(known, new)
        return np.bincount(np.frombuffer(found, np.uint8), minlength=DISTANCES + 1)


def features(counts: np.ndarray) -> np.ndarray:
    """Counts reaching each distance, damped, and their share of the text."""
    reach = counts[..., ::-1].cumsum(-1)[..., ::-1][..., 1:]
    return np.concatenate([np.log1p(reach), np.sqrt(reach / np.maximum(counts.sum(-1, keepdims=True), 1))], -1).astype(float)


@dataclass
class Model:
    ordinary: list[str]
    toxic: list[str]
    weights: np.ndarray
    bias: float
    temperature: float
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0.5 is the calibrated threshold."""
        return 1 / (1 + np.exp(-np.clip(((x * self.weights).sum(-1) + self.bias) / self.temperature - self.shift, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge * len(x)] * x.shape[1] + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(h, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str, int, int]]) -> Model | float:
    """``rows``: text, label and a number below 4 that tells a quarter for calibration (0) from the rest."""
    toxic, ordinary = ([t for t, y, k in rows if y == c and k] for c in (1, 0))
    if not toxic or not ordinary:
        return (sum(y for _, y, _ in rows) + 1) / (len(rows) + 2)
    found = segments(toxic, ordinary)
    known = usual(ordinary, found)
    measure = Distance(known, found)
    x = features(np.array([measure.counts(t) for t, _, _ in rows]))
    y, part = np.array([y for _, y, _ in rows]), np.array([k for _, _, k in rows])
    weights, bias = _logistic(x[part > 0], y[part > 0])
    held = part == 0 if min((y[part == 0] == c).sum() for c in (0, 1)) >= 30 else part >= 0  # too few to calibrate on alone
    logit, truth = x[held] @ weights + bias, y[held]
    loss = lambda t: np.logaddexp(0, np.where(truth == 1, -logit, logit) / t).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    cuts = np.unique(logit)
    middle = np.concatenate([[0.0], (cuts[1:] + cuts[:-1]) / 2])
    right = np.array([((logit >= c) == truth).mean() for c in middle])
    best = middle[right >= right.max() - 1e-12]
    return Model(known, found, weights, bias, temperature, float(best[np.abs(best).argmin()]) / temperature)


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, most_docs: int, most_chars: int) -> DataFrame:
    """``doc_id, text, label`` of the labelled rows outside the held-out fold, bounded by class as the module says."""
    known = labels.filter(F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % folds != 0)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    one = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs) for c in (0, 1)]
    drawn = one[0].union(one[1])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") <= most_chars)
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # 2 * most_docs rows at most


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, most_docs: int = 2000, most_chars: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted, windows`` (the windows at each distance) of each row."""
    drawn = sample(docs, labels, "toxic", folds, most_docs, most_chars)
    rows = sorted((r.doc_id, r.text, r.label) for r in drawn.collect())
    model = fit([(t, y, common.id_hash(i) // folds % 4) for i, t, y in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        measure = Distance(model.ordinary, model.toxic) if isinstance(model, Model) else Distance([], [])

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = np.array([measure.counts(t) for t in batch.column(1).to_pylist()])
            score = model.score(features(counts)) if isinstance(model, Model) else np.full(len(counts), model)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(counts.tolist(), pa.list_(pa.int64()))], names=["doc_id", "score", "windows"])

        return each

    scored = common.on_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, score double, windows array<long>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows")
