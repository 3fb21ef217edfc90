"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items form one automaton.  Each document's words stream
through it; at each word it holds the longest run of words ending there that some
item also holds.  Runs of ``window`` words or more, and whole items shorter than
that, are hits.  Word pairs that no item holds end every run, so stretches without
enough adjacent item pairs are passed over in numpy before the automaton sees them.

Words: ASCII letters lower-cased, digits and all characters beyond ASCII; everything
else parts them.  Items are dealt out as groups of ``group_words`` words at most, each a
broadcast of its own that the driver drops once it is sent, so neither the driver nor a
worker ever holds more than one group.  With several groups, one job searches the texts
for each; only hits (a digest of the text, spans and items) leave it, and they join the
documents once.

Defined results: null texts and items have no words; an item without words matches
nothing; equal items both count; empty tables give no rows, or documents without
hits; columns of ``docs`` other than those named are ignored or, in
``decontaminate``, kept as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm import common

#: Columns of what is found, and rows of hits up to which they are broadcast.
FOUND, BROADCAST_ROWS = ("spans", "items", "n_words"), 100_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton over items' words."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = 10):
        self.window, self.ids = window, {}
        self.length, self.link = [0], [-1]
        self.step: dict[int, int] = {}  # state << 32 | word -> state
        self.out: list[list[int]] = [[]]
        kept = [(k, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for k, ws in items if ws]
        for _, seq in kept:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.shortest = min((min(len(s), window) for _, s in kept), default=window)
        self._mark(kept)
        width = max(len(self.ids), 1)
        pairs = {a * width + b for _, s in kept for a, b in zip(s, s[1:])}  # noqa: B905
        self.width, self.pairs = width, np.array(sorted(pairs), np.int64)

    def _new(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.out.append([])
        return len(self.length) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        """Parts the strings of ``q`` that end the way ``p`` does from its longer ones."""
        c = self._new(self.length[p] + 1)
        self.link[c], self.link[q] = self.link[q], c
        self.out[c] = list(self.out[q])
        for x in self.out[q]:
            self.step[c << 32 | x] = self.step[q << 32 | x]
        while p != -1 and self.step.get(p << 32 | w) == q:
            self.step[p << 32 | w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.step.get(last << 32 | w)
        if q is not None:  # an earlier item holds this prefix
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new, p = self._new(self.length[last] + 1), last
        while p != -1 and (q := self.step.get(p << 32 | w)) is None:
            self.step[p << 32 | w] = new
            self.out[p].append(w)
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        elif self.length[q] == self.length[p] + 1:
            self.link[new] = q
        else:
            self.link[new] = self._clone(p, q, w)
        return new

    def _mark(self, kept: list[tuple[str, list[int]]]) -> None:
        n, window = len(self.length), self.window
        order = sorted(range(n), key=self.length.__getitem__)
        # The state that holds the last `window` words of each state's strings.
        self.top = list(range(n))
        for v in order:
            if self.link[v] >= 0 and self.length[self.link[v]] >= window:
                self.top[v] = self.top[self.link[v]]
        self.holders: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for key, seq in kept:
            v = 0
            for i, w in enumerate(seq):
                v = self.step[v << 32 | w]
                while self.length[self.link[v]] > i:  # pragma: no cover - whole prefixes are never shorter
                    v = self.link[v]
                if i + 1 >= window:
                    self.holders.setdefault(self.top[v], set()).add(key)
            if len(seq) < window:
                self.short.setdefault(v, []).append((len(seq), key))
        # The nearest state up the links, itself first, at which a short item ends.
        self.near = [-1] * n
        for v in order:
            self.near[v] = v if v in self.short else self.near[self.link[v]] if v else -1
        del self.out

    def stretches(self, ids: np.ndarray) -> Iterable[tuple[int, int]]:
        """Where runs of at least ``shortest`` words can lie."""
        if len(ids) < self.shortest:
            return []
        known = ids >= 0
        if self.shortest == 1:
            inner = known[1:] & known[:-1]
        else:
            key = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
            inner = (self.pairs[at] == key) & known[1:] & known[:-1] if len(self.pairs) else np.zeros(len(key), bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inner.view(np.int8), [0]])))
        found = [(a, b + 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b + 1 - a >= self.shortest]
        if self.shortest == 1:
            covered = np.zeros(len(ids), bool)
            for a, b in found:
                covered[a:b] = True
            found += [(i, i + 1) for i in np.flatnonzero(known & ~covered).tolist()]
        return found

    def search(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans, merged and ascending, and the items that hit."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        step, link, length, window = self.step, self.link, self.length, self.window
        for a, b in self.stretches(ids):
            v = held = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while (to := step.get(v << 32 | w)) is None and v:
                    v = link[v]
                    held = length[v]
                if to is None:
                    held = 0
                    continue
                v, held = to, held + 1
                if held >= window:
                    spans.append((i - window + 1, i + 1))
                    items |= self.holders[self.top[v]]
                s = self.near[v]
                while s > 0:
                    for n, key in self.short[s]:
                        if n <= held:
                            spans.append((i - n + 1, i + 1))
                            items.add(key)
                    s = self.near[link[s]]
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_groups(benchmark: DataFrame, group_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in groups of ``group_words`` words at most (an item longer than that alone), one group at a time; one empty group without items."""
    group: list[tuple[str, list[bytes]]] = []
    held, some = 0, False
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        ws = words(row[1])
        if group and held + len(ws) > group_words:
            yield group
            group, held, some = [], 0, True
        group.append((row[0] if row[0] is not None else "", ws))
        held += len(ws)
    if group or not some:
        yield group


_built: dict[str, ItemAutomaton] = {}


def _automaton(name: str, shared, window: int) -> ItemAutomaton:
    """The automaton of a broadcast group; a worker keeps the last one for its later tasks."""
    if name not in _built:
        _built.clear()
        _built[name] = ItemAutomaton(shared.value, window)
    return _built[name]


def _searched(docs: DataFrame, shared, names: list[str], window: int, clean: bool) -> DataFrame:
    """``docs`` with ``spans, items, n_words`` of one group; with ``clean``, without the spans in ``text``."""
    name, text_at = uuid.uuid4().hex, names.index("text")

    def make():
        automaton = _automaton(name, shared, window)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, all_spans, all_items, texts = [], [], [], []
            for text in batch.column(text_at).to_pylist():
                tokens = words(text)
                spans, items = automaton.search(tokens)
                counts.append(len(tokens))
                all_spans.append([x for s in spans for x in s])
                all_items.append(sorted(items))
                texts.append(cut(text, all_spans[-1]) if clean and spans else text)
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string()) if clean else columns[text_at]
            return pa.RecordBatch.from_arrays([*columns, pa.array(all_spans, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string())), pa.array(counts, pa.int64())], names=[*names, *FOUND])

        return each

    kinds = dict(docs.dtypes)
    return common.on_batches(docs.select(*names), make, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", spans array<int>, items array<string>, n_words long")


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, group_words: int = 200_000, clean: bool = False) -> DataFrame:
    """``docs`` with ``n_words long``, ``spans array<int>`` (starts and ends of hit word spans in turn) and ``items array<string>`` (items that hit, sorted).

    With ``clean``, the texts are without the spans: in the same pass as the search where
    there is one group, so that a task needs one Python worker.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in FOUND]
    groups = [spark.sparkContext.broadcast(g) for g in item_groups(benchmark, group_words)]
    if len(groups) == 1:
        return _searched(docs, groups[0], names, window, clean)
    of = F.sha1(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = docs.select(of.alias("of"), F.col("text").cast("string").alias("text"))
    # Equal texts hit alike, so that each group's hits of a text are one row.
    passes = [_searched(texts, g, ["of", "text"], window, False).filter("size(items) > 0").select("of", F.lit(k).alias("k"), "spans", "items") for k, g in enumerate(groups)]
    each = reduce(DataFrame.union, passes).groupBy("of", "k").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
    hits = each.groupBy("of").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = common.store(hits, "benchmark_hits")
    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    packed = docs.select(F.struct(*names).alias("row"), of.alias("of")).join(F.broadcast(hits) if few else hits, "of", "left").select("row.*", "spans", "items")
    text_at = names.index("text")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, spans = batch.column(text_at).to_pylist(), []
            for own in batch.column(len(names)).to_pylist():
                own = own or []
                spans.append([x for s in merged(list(zip(own[::2], own[1::2], strict=True))) for x in s])
            columns = list(batch.columns[: len(names)])
            if clean:
                columns[text_at] = pa.array([cut(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
            items = [x or [] for x in batch.column(len(names) + 1).to_pylist()]
            return pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array([len(words(t)) for t in texts], pa.int64())], names=[*names, *FOUND])

        return each

    kinds = dict(docs.dtypes)
    return common.on_batches(packed, make, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", spans array<int>, items array<string>, n_words long")


def cut(text: str, spans: list[int]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    import re

    at = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    out, done = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join([*out, text[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_share: float = 0.5, group_words: int = 200_000) -> DataFrame:
    """``docs`` without the spans that the benchmark also holds; documents of which more than ``most_share`` of the words were hit are dropped whole."""
    names = docs.columns
    # Columns of the same names as the search's own step aside for it.
    aside = {c: common.free(f"{c}_kept", names) for c in ("n_words", "spans", "items") if c in names}
    found = find_hits(docs.withColumnsRenamed(aside), benchmark, window, group_words, clean=True)
    hit = F.aggregate(F.expr("transform(spans, (x, i) -> if(i % 2 = 0, -x, x))"), F.lit(0), lambda a, x: a + x)
    kept = found.filter(F.coalesce(hit, F.lit(0)) <= F.lit(most_share) * F.col("n_words"))
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in names))
