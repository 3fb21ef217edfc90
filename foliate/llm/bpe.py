"""Byte-level BPE by speculation: greedy longest matches, checked, mended where wrong.

For each distinct pre-token, the longest vocabulary entries from left to right are
proposed.  A sequence of tokens is what BPE makes of a text exactly when each token
is what BPE makes of its own bytes and each adjacent pair is compatible, that is,
BPE never merges across their seam.  All pairs of a batch are checked at once in
numpy, by undoing the later merge of the two again and again; only words with a
failing pair are merged exactly.

Defined results: a null text is empty, an empty text has no ids, and repeated rows
give repeated results; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import gc
import json
from array import array
from collections.abc import Callable
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm import common

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files: itself where Latin-1 prints it, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(spare)) for b in range(256)}


_NONE = 1 << 60


class SpeculativeBpe:
    def __init__(self, path: str, cached: int = 350_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = {v: k for k, v in byte_letters().items()}
        raw = lambda s: bytes(letter[c] for c in s)
        self.vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n = 1 + max([*self.vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * self.n
        for b, i in self.vocab.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([self.vocab[raw(a)] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[raw(b)] for _, b in pairs], np.int64)
        made = np.array([self.vocab[raw(a + b)] for a, b in pairs], np.int64)
        key = left * self.n + right
        order = np.argsort(key)
        self.keys, self.key_rank = key[order], order + 1  # ranks from 1 on; 0: a single byte
        # A pair's rank and token in one number, so that the least number is the first merge.
        self.merges = dict(zip(key.tolist(), ((np.arange(1, len(key) + 1) << 20) | made).tolist(), strict=True))
        self.byte_ids = [self.vocab[bytes([b])] for b in range(256)]
        self.rank, self.left, self.right = np.zeros(self.n, np.int64), np.full(self.n, -1, np.int64), np.full(self.n, -1, np.int64)
        first = np.unique(made, return_index=True)[1]
        self.rank[made[first]], self.left[made[first]], self.right[made[first]] = first + 1, left[first], right[first]
        self.longest = max(map(len, self.vocab))
        self.whole = np.zeros(self.n, np.int8)  # is a token what BPE makes of its bytes: 0 not known, 1 yes, 2 no
        self.known: dict[int, bool] = {}
        self.cached, self.cache = cached, {}
        self.words = regex.compile(PATTERN).findall
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.proposed = self.failed = 0

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps each pair apart."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 40)
        while len(live):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crosses = (self.keys[at] == key) & (self.key_rank[at] < limit)
            good[live[crosses]] = False
            ra, rb = self.rank[a], self.rank[b]
            done = crosses | ((ra == 0) & (rb == 0))
            undo_a = ra > rb  # the later merge is undone first; of equal ones the right one came later
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            go = ~done
            live, limit, a, b = live[go], limit[go], a[go], b[go]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one pre-token: the lowest-ranked pair first, the leftmost of equal ones."""
        ids = list(map(self.byte_ids.__getitem__, word))
        if len(ids) > 256:
            return self._merge_long(ids)
        get, n = self.merges.get, self.n
        ranks = [get(a * n + b, _NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) != _NONE:
            k = ranks.index(best)
            token = ids[k] = best & 0xFFFFF
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] * n + token, _NONE)
            if k < len(ranks):
                ranks[k] = get(token * n + ids[k + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for very long words."""
        import heapq

        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        get, n, heap = self.merges.get, self.n, []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (m := get(ids[k] * n + ids[after[k]])):
                heapq.heappush(heap, (m >> 20, k, m & 0xFFFFF, ids[k], ids[after[k]]))

        for k in range(len(ids)):
            offer(k)
        while heap:
            _, k, token, a, b = heapq.heappop(heap)
            j = after[k]
            if j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = token, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            offer(k)
            offer(before[k])
        return [x for x in ids if x >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Longest matches from left to right."""
        if (whole := self.vocab.get(word)) is not None:
            return [whole]
        out, at, n, vocab, longest = [], 0, len(word), self.vocab, self.longest
        while at < n:
            end = min(n, at + longest)
            while (token := vocab.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        guesses = [self.propose(b) for b in raw]
        size = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((x for g in guesses for x in g), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(words)), size)
        for t in np.unique(flat[self.whole[flat] == 0]).tolist():
            self.whole[t] = 1 if self.merge(self.bytes_of[t]) == [t] else 2
        bad = np.zeros(len(words), bool)
        bad[owner[self.whole[flat] == 2]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        key, back = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        good = self.compatible(key // self.n, key % self.n)
        bad[owner[inner[~good[back]]]] = True
        self.proposed += len(words)
        self.failed += int(bad.sum())
        for w, b, g, wrong in zip(words, raw, guesses, bad.tolist(), strict=True):
            self.cache[w] = array("I", self.merge(b) if wrong else g).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        words: list[str] = []
        ends = []
        for t in texts:
            if self.splitter and "<|" in t:
                words += [w for k, s in enumerate(self.splitter.split(t)) for w in ([s] if k % 2 else self.words(s))]
            else:
                words += self.words(t)
            ends.append(len(words))
        found = list(map(self.cache.get, words))
        missing = list(compress(range(len(found)), map(is_, found, repeat(None))))
        if missing:
            new = set(map(words.__getitem__, missing))
            if len(self.cache) + len(new) > self.cached:
                self.cache = {w: ids for w, ids in zip(words, found, strict=True) if ids is not None}
            for s in self.special.keys() & new:
                self.cache[s] = array("I", [self.special[s]]).tobytes()
            self.learn([w for w in new if w not in self.special])
            get = self.cache.__getitem__
            for k in missing:
                found[k] = get(words[k])
            common.forget_long(self.cache, new)
        return [np.frombuffer(b"".join(found[a:b]), "<u4") for a, b in zip([0, *ends], ends)]  # noqa: B905

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


#: Words that a worker remembers, some 250 bytes each.
CACHED = 350_000
_loaded: dict[str, SpeculativeBpe] = {}


def loaded(path: str, cached: int = CACHED) -> SpeculativeBpe:
    """One for each worker process: later tasks find its cache filled."""
    if path not in _loaded:
        _loaded[path] = SpeculativeBpe(path)
        gc.freeze()  # the vocabulary stays; collections needn't trace it
    _loaded[path].cached = cached
    return _loaded[path]


def encode_decode(docs: DataFrame, vocabulary: str, derive: Callable[[np.ndarray, str], tuple] | None = None, columns: str = "ids array<long>, decoded string", cached: int = CACHED) -> DataFrame:
    """``doc_id`` and, of each whole text, the ids and the text decoded from them, or what ``derive(ids, decoded)`` makes of the two."""
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]

    def make():
        bpe = loaded(vocabulary, cached)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [(ids, bpe.decode(ids)) for ids in bpe.encode(common.texts(batch.column(1)))]
            rows = [derive(*x) if derive else (x[0].tolist(), x[1]) for x in out]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c)) for c in zip(*rows, strict=True))], names=["doc_id", *names])

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.on_batches(rows, make, f"doc_id long, {columns}")
