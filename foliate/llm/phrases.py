"""Phrase collocation mining: exact phrase counts by minimal perfect hashing, cuts read by slot.

Three passes over the texts. (1) A sieve: windows of one to four words are hashed to buckets whose counts are added up;
a phrase in a bucket of fewer than ``least`` can't be frequent. (2) Candidates: a window is one only if its own bucket and
those of all its parts pass, so no frequent phrase is lost (the Apriori rule, which the sieve can only weaken). Their
64-bit keys go to the shards of a minimal perfect hash, built on the executors; keys are stored by slot, so a window
that is no candidate is told from one that is, and so is the first task that has the phrase. (3) Mappers ``bincount``
slots into numpy arrays, which are added up by blocks as a tree; the slot's own task gives the phrase's text. Cuts and
covers of candidates then are lookups of slots.

While all slots fit ``broadcast_slots``, every mapper holds the hash. Beyond that, keys have 128 bits, windows go to the
shards of the hash (counted before the shuffle), which stay in one task each, and cuts are joins on texts: the same rows.

Edge cases: a null text is empty, a null language is ``und`` (as is a language of that name); repeated rows count
again; an empty table gives no rows; other columns are never read; ties go by phrase in UTF-8 byte order.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm.common import on_batches, partitions, small_batches, store

LONGEST_PHRASE = 4
#: Parameters: candidates that a mapper may hold (24 bytes each), slots of a shard, of a block of counts, arrays added up by a task.
BROADCAST_SLOTS, SHARD_SLOTS, BLOCK, FAN = 1 << 22, 1 << 18, 1 << 14, 32
_BREAK = b"."
_SEPARATORS = bytes.maketrans(b".,;:!?\n\v\f\r", _BREAK * 10)
_LOW, _HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HELD = 4_000_000  # windows that a task holds before it adds them up
_WORDS = 400_000  # words that a task remembers


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with a break for each separator."""
    return text.lower().translate(_SEPARATORS).replace(_BREAK, b" . ").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digest(word: bytes) -> bytes:
    return hashlib.blake2b(word, digest_size=16).digest()


def _lanes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_digest, words)), "<u8").reshape(-1, 2)


def _seeds(languages: list[str]) -> np.ndarray:
    """Digests of languages, apart from those of words, which hold no line feed."""
    return _lanes([b"\n" + x.encode() for x in languages])


class Words:
    """A task's memory of the digests of words."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict(lambda: len(self.ids))
        self.lanes = np.empty((0, 2), np.uint64)
        self.ids[_BREAK]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (0: a break) of a batch's words; and the digests of ids."""
        if len(self.ids) > _WORDS:
            self.__init__()
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > len(self.lanes):
            from itertools import islice

            self.lanes = np.concatenate([self.lanes, _lanes(list(islice(self.ids, len(self.lanes), None)))])
        return ids, self.lanes


def windows(ids: np.ndarray, lanes: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For windows of 1, 2, ... words: where they hold no break, and both halves of their keys."""
    low, high = lanes[:, 0][ids], lanes[:, 1][ids]
    ok, a, b = ids != 0, low, high
    for k in range(1, LONGEST_PHRASE + 1):
        if k > 1:
            ok, a, b = ok[:-1] & (ids[k - 1 :] != 0), a[:-1] * _LOW + low[k - 1 :], b[:-1] * _HIGH + high[k - 1 :]
        n = len(ok)
        yield ok, _mix(a + seeds[:n, 0] + np.uint64(k)), b + seeds[:n, 1] + np.uint64(k)


def keys_of(languages: list[str], phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of whole phrases, as ``windows`` gives them."""
    split = [p.split(b" ") for p in phrases]
    sizes = np.array([len(s) for s in split], np.int64)
    lanes, starts = _lanes([w for s in split for w in s]), np.cumsum(sizes) - sizes
    seeds = _seeds(languages)
    a, b = lanes[starts, 0], lanes[starts, 1]
    for k in range(1, LONGEST_PHRASE):
        more = np.flatnonzero(sizes > k)
        a[more], b[more] = a[more] * _LOW + lanes[starts[more] + k, 0], b[more] * _HIGH + lanes[starts[more] + k, 1]
    return _mix(a + seeds[:, 0] + sizes.astype(np.uint64)), b + seeds[:, 1] + sizes.astype(np.uint64)


class Slots:
    """A minimal perfect hash: levels of bits, a key at the first level where it stands alone; slots are ranks of bits.

    Keys are stored by slot, so ``find`` gives -1 for others; ``high`` is left out of 64-bit keys, ``owner`` is a number that goes with each.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray | None = None, owner: np.ndarray | None = None) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        left, base, order = np.arange(len(low)), 0, []
        while len(left):
            if len(self.levels) > 60:
                raise ValueError("two phrases have one key")
            m = max(64, (2 * len(left) + 63) // 64 * 64)
            at = self._at(low[left], len(self.levels), m)
            alone = np.bincount(at, minlength=m) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((bits, ranks, m, base))
            placed = alone[at]
            order.append(left[placed][np.argsort(at[placed])])
            base += int(placed.sum())
            left = left[~placed]
        self.order = np.concatenate(order) if order else np.empty(0, np.int64)
        self.low, self.high, self.owner = low[self.order], *(None if x is None else x[self.order] for x in (high, owner))

    @staticmethod
    def _at(low: np.ndarray, level: int, m: int) -> np.ndarray:
        return (_mix(low + np.uint64(0xC2B2AE3D27D4EB4F * (level + 1) % (1 << 64))) % np.uint64(m)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(low), -1, np.int64), np.arange(len(low))
        for level, (bits, ranks, m, base) in enumerate(self.levels):
            if not len(left):
                break
            at = self._at(low[left], level, m)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[left[hit]] = (base + ranks[at >> 6] + below)[hit]
            left = left[~hit]
        found = np.flatnonzero(slots >= 0)
        wrong = self.low[slots[found]] != low[found]
        wrong = found[wrong if self.high is None else wrong | (self.high[slots[found]] != high[found])]
        slots[wrong] = -1
        return slots

    def packed(self) -> bytes:
        import pickle

        return zstandard.compress(pickle.dumps((self.levels, self.low, self.high, self.owner), protocol=5), 1)

    @classmethod
    def unpacked(cls, blob: bytes) -> Slots:
        import pickle

        self = cls.__new__(cls)
        self.levels, self.low, self.high, self.owner = pickle.loads(zstandard.decompress(blob))
        return self


class Index:
    """The shards of a hash as one: slot numbers run on from shard to shard."""

    def __init__(self, shards: list[Slots]) -> None:
        self.shards = shards
        self.starts = np.cumsum([0, *(len(s.low) for s in shards)])
        self.owners = np.concatenate([s.owner for s in shards])

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(self.shards) == 1:
            return self.shards[0].find(low, high)
        slots, own = np.full(len(low), -1, np.int64), shard_of(low, len(self.shards))
        for k, shard in enumerate(self.shards):
            mine = np.flatnonzero(own == k)
            found = shard.find(low[mine], high[mine])
            slots[mine] = np.where(found >= 0, found + self.starts[k], -1)
        return slots


def shard_of(low: np.ndarray, n: int) -> np.ndarray:
    return ((low >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _seen(batch: pa.RecordBatch, words: Words) -> tuple[list[bytes], list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch with a break after each text, their languages, ids, digests, and the seeds of their languages."""
    texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
    languages = batch.column("lang").to_pylist()
    each = [tokens(t) for t in texts]
    for e in each:
        e.append(_BREAK)
    flat = [w for e in each for w in e]
    known = sorted(set(languages))
    own = np.repeat(np.searchsorted(np.array(known), np.array(languages)), [len(e) for e in each])
    ids, lanes = words.of(flat)
    return flat, known, own, ids, lanes, _seeds(known)[own]


def _passing(found, bits: list[np.ndarray], shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows that pass the sieve with all their parts: their length, place and key."""
    before = None
    for k, (ok, low, high) in enumerate(found, 1):
        if before is not None:
            ok = ok & before[:-1] & before[1:]
        at = np.flatnonzero(ok)
        bucket = (low[at] >> np.uint64(shift)).astype(np.int64)
        at = at[(bits[k - 1][bucket >> 3] >> (bucket & 7)) & 1 == 1]
        before = np.zeros(len(ok), bool)
        before[at] = True
        yield k, at, low[at], high[at]


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys)
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])) if len(all_keys) else np.empty(0, np.int64)
    return all_keys[first], np.add.reduceat(all_counts, first) if len(first) else all_counts


def _sieve(docs: DataFrame, least: int, bits: int) -> list[np.ndarray]:
    """For each length the buckets with ``least`` windows or more, as bits: 2^bits of each, a fixed size."""
    block = min(bits, 18)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        held: list[list[np.ndarray]] = [[] for _ in range(LONGEST_PHRASE)]

        def flush(k: int) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held[k]), return_counts=True)
            held[k].clear()
            ends = np.searchsorted(found >> block, np.arange((1 << bits - block) + 1))
            out = []
            for b, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if j > i:
                    own = (found[i:j] & ((1 << block) - 1)).astype("<u4")
                    out.append(((k << 20) + b, zstandard.compress(np.diff(own, prepend=np.uint32(0)).tobytes() + np.minimum(n[i:j], least).astype("<u4").tobytes(), 3)))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["block", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            _, _, _, ids, lanes, seeds = _seen(batch, words)
            for k, (ok, low, _) in enumerate(windows(ids, lanes, seeds)):
                held[k].append((low[ok] >> np.uint64(64 - bits)).astype(np.uint32))
                if sum(map(len, held[k])) > _HELD:
                    yield flush(k)
        for k in range(LONGEST_PHRASE):
            if any(map(len, held[k])):
                yield flush(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for b, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now:
                    if now is not None:
                        yield done()
                    now, total = b, np.zeros(1 << block, np.int64)
                x = np.frombuffer(zstandard.decompress(sums), "<u4")
                total[np.cumsum(x[: len(x) // 2])] += x[len(x) // 2 :]
        if now is not None:
            yield done()

    passed = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(LONGEST_PHRASE)]
    spark = docs.sparkSession
    sums = docs.mapInArrow(count, "block int, sums binary").repartition(partitions(spark), "block").sortWithinPartitions("block").mapInArrow(add, "block int, bits binary")
    for b, own in sums.collect():
        at = (b & ((1 << 20) - 1)) << (block - 3)
        passed[b >> 20][at : at + (1 << block) // 8] = np.frombuffer(own, np.uint8)
    return passed


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _slots(docs: DataFrame, sieve, shift: int, shards: int) -> DataFrame:
    """``shard, n, hash`` over the keys of windows that pass; each key's owner is the first task that has it."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words, held, known = sieve.value, Words(), [], np.empty(0, np.uint64)

        def compact() -> np.ndarray:
            out = np.unique(np.concatenate([known, *held]))
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            _, _, _, ids, lanes, seeds = _seen(batch, words)
            held += [low for _, _, low, _ in _passing(windows(ids, lanes, seeds), bits, shift)]
            if sum(map(len, held)) > _HELD:
                known = compact()
                if len(known) > _HELD:
                    yield dealt(known)
                    known = np.empty(0, np.uint64)
        known = compact()
        if len(known):
            yield dealt(known)

    def dealt(known: np.ndarray) -> pa.RecordBatch:
        own = shard_of(known, shards)
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(shards + 1))
        full = np.flatnonzero(np.diff(ends)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_task()] * len(full), pa.int32()), pa.array([zstandard.compress(np.diff(known[order[ends[k] : ends[k + 1]]], prepend=np.uint64(0)).tobytes(), 3) for k in full], pa.binary())], names=["shard", "owner", "keys"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, owners = None, [], []

        def compact() -> None:
            found, first = np.unique(np.concatenate(keys), return_index=True)
            owners[:], keys[:] = [np.concatenate(owners)[first]], [found]

        def done() -> pa.RecordBatch:
            compact()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(keys[0])], pa.int64()), pa.array([Slots(keys[0], owner=owners[0]).packed()], pa.binary())], names=["shard", "n", "hash"])

        for batch in batches:
            for shard, owner, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, keys, owners = shard, [], []
                keys.append(np.cumsum(np.frombuffer(zstandard.decompress(data), "<u8")))
                owners.append(np.full(len(keys[-1]), owner, np.int32))
                if sum(map(len, keys[1:])) > max(_HELD, len(keys[0])):
                    compact()
        if now is not None:
            yield done()

    rows = docs.mapInArrow(find, "shard int, owner int, keys binary").repartition(max(shards, partitions(docs.sparkSession)), "shard").sortWithinPartitions("shard", "owner")
    return store(rows.mapInArrow(build, "shard int, n long, hash binary"), "phrase_slots")


def _candidates(docs: DataFrame, held, shift: int) -> DataFrame:
    """Distinct ``lang, phrase`` of windows that pass."""
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
        bits, words, seen = held.value, Words(), set()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            flat, known, own, ids, lanes, seeds = _seen(batch, words)
            if len(seen) > 500_000:
                seen.clear()
            languages, phrases = [], []
            for k, at, low, _ in _passing(windows(ids, lanes, seeds), bits, shift):
                keys, first = np.unique(low, return_index=True)
                for key, i in zip(keys.tolist(), at[first].tolist(), strict=True):
                    if key not in seen:
                        seen.add(key)
                        languages.append(known[own[i]])
                        phrases.append(b" ".join(flat[i : i + k]))
            if not phrases:
                return None
            return pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string())], names=["lang", "phrase"])

        return each

    return on_batches(docs, make, "lang string, phrase string").distinct()


def _hashed(candidates: DataFrame, shards: int) -> DataFrame:
    """``shard, slot, lang, phrase``, and for each shard a row with its hash."""
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, _ = keys_of(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()) if batch.num_rows else (np.empty(0, np.uint64), None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard_of(low, shards), pa.int32())], names=["lang", "phrase", "shard"])

    def build(group: pa.Table) -> pa.Table:
        languages, phrases = group.column("lang").to_pylist(), group.column("phrase").cast(pa.binary()).to_pylist()
        slots = Slots(*keys_of(languages, phrases))
        n = len(phrases)
        return pa.table({
            "shard": pa.array([group.column("shard")[0].as_py()] * (n + 1), pa.int32()), "slot": pa.array([-1, *range(n)], pa.int64()),
            "lang": pa.array([None, *(languages[i] for i in slots.order)], pa.string()), "phrase": pa.array([None, *(phrases[i] for i in slots.order)], pa.binary()).cast(pa.string()), "hash": pa.array([slots.packed(), *[None] * n], pa.binary()),
        })

    sharded = candidates.mapInArrow(own, "lang string, phrase string, shard int")
    return store(sharded.groupBy("shard").applyInArrow(build, "shard int, slot long, lang string, phrase string, hash binary"), "phrase_slots")


def _counted_by_slot(docs: DataFrame, sieve, shift: int, index, n: int) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Counts by slot, each mapper's arrays added up block by block, ``FAN`` at a time; ``slot, lang, phrase``; and ``lang, n``."""
    names, types = ["block", "part", "counts", "slot", "lang", "phrase", "n"], [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def rows_of(**columns: list) -> pa.RecordBatch:
        many = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(many, t) for c, t in zip(names, types, strict=True)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, find, part, words, totals = sieve.value, index.value.find, _task(), Words(), defaultdict(int)
        mine = index.value.owners == part  # those whose texts this task still owes
        total, held = np.zeros(n, np.int64), []
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, known, own, ids, lanes, seeds = _seen(batch, words)
            for name, words_of in zip(known, np.bincount(own[ids != 0], minlength=len(known)).tolist(), strict=True):
                totals[name] += words_of
            slots_of, languages, phrases = [], [], []
            for k, at, low, high in _passing(windows(ids, lanes, seeds), bits, shift):
                slots = find(low, high)
                at, slots = at[slots >= 0], slots[slots >= 0]
                held.append(slots)
                new = np.flatnonzero(mine[slots])
                found, first = np.unique(slots[new], return_index=True)
                mine[found] = False
                for slot, i in zip(found.tolist(), at[new[first]].tolist(), strict=True):
                    slots_of.append(slot)
                    languages.append(known[own[i]])
                    phrases.append(b" ".join(flat[i : i + k]).decode())
            if slots_of:
                yield rows_of(slot=slots_of, lang=languages, phrase=phrases)
            if sum(map(len, held)) > _HELD:
                total += np.bincount(np.concatenate(held), minlength=n)
                held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=n)
        full = [b for b in range(0, n, BLOCK) if total[b : b + BLOCK].any()]
        yield rows_of(block=[b // BLOCK for b in full], part=[part] * len(full), counts=[zstandard.compress(total[b : b + BLOCK].tobytes(), 1) for b in full])
        yield rows_of(lang=list(totals), n=list(totals.values()))

    def add(group: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(zstandard.decompress(x), np.int64) for x in group.column("counts").to_pylist()]
        return pa.table({"block": group.column("block")[:1], "part": group.column("part")[:1], "counts": pa.array([zstandard.compress(np.sum(arrays, axis=0).tobytes(), 1)], pa.binary())})

    made = store(docs.mapInArrow(count, "block int, part int, counts binary, slot long, lang string, phrase string, n long"), "phrase_counts")
    rows = made.filter("block IS NOT NULL").select("block", "part", "counts")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("block", "part").applyInArrow(add, "block int, part int, counts binary")
        parts = -(-parts // FAN)
        if parts > 1:
            rows = store(rows, "phrase_counts")
    total = np.zeros(n, np.int64)
    for b, _, counts in rows.collect():  # n numbers, of checked size
        own = np.frombuffer(zstandard.decompress(counts), np.int64)
        total[b * BLOCK : b * BLOCK + len(own)] = own
    texts = made.filter("slot IS NOT NULL").select("slot", "lang", "phrase")
    return total, texts, made.filter("n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))


def _words_of_languages(docs: DataFrame) -> DataFrame:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [sum(w != _BREAK for w in tokens(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n, pa.int64())], names=["lang", "n"])

        return each

    return on_batches(docs, make, "lang string, n long").filter("n > 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _counted_by_shard(docs: DataFrame, hashed: DataFrame, sieve, shift: int, shards: int) -> DataFrame:
    """``lang, phrase, a`` where no mapper can hold the hash: windows, counted by the task first, go to their shard's slots."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words, kind = sieve.value, Words(), np.dtype([("low", "<u8"), ("high", "<u8")])
        keys, counts = [], []

        def flush() -> pa.RecordBatch:
            all_keys, n = _sums(keys, counts)
            keys.clear(), counts.clear()
            own, out = shard_of(all_keys["low"], shards), []
            order = np.argsort(own, kind="stable")
            ends = np.searchsorted(own[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(ends)).tolist():
                x = order[ends[s] : ends[s + 1]]
                out.append((s, zstandard.compress(all_keys["low"][x].tobytes() + all_keys["high"][x].tobytes() + n[x].astype("<u8").tobytes(), 1)))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([1] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["shard", "kind", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            _, _, _, ids, lanes, seeds = _seen(batch, words)
            for _, _, low, high in _passing(windows(ids, lanes, seeds), bits, shift):
                own = np.empty(len(low), kind)
                own["low"], own["high"] = low, high
                found, n = np.unique(own, return_counts=True)
                keys.append(found), counts.append(n)
            if sum(map(len, keys)) > _HELD // 4:
                yield flush()
        if any(map(len, keys)):
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slots, total = None, None, np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now] * len(total), pa.int32()), pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.int64())], names=["shard", "slot", "a"])

        for batch in batches:
            for shard, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if now is not None:
                        yield done()
                    now, slots = shard, Slots.unpacked(data)
                    total = np.zeros(len(slots.low), np.int64)
                elif shard == now:
                    x = np.frombuffer(zstandard.decompress(data), "<u8").reshape(3, -1)
                    at = slots.find(x[0], x[1])
                    np.add.at(total, at[at >= 0], x[2][at >= 0].astype(np.int64))
        if now is not None:
            yield done()

    spark = docs.sparkSession
    dealt = docs.mapInArrow(deal, "shard int, kind int, data binary")
    hashes = hashed.filter("slot < 0").select("shard", F.lit(0).alias("kind"), F.col("hash").alias("data"))
    sums = hashes.unionByName(dealt).repartition(max(shards, partitions(spark)), "shard").sortWithinPartitions("shard", "kind").mapInArrow(add, "shard int, slot long, a long")
    return hashed.filter("slot >= 0").select("shard", "slot", "lang", "phrase").join(sums, ["shard", "slot"]).select("lang", "phrase", "a")


def _cut_by_slot(texts: DataFrame, index, counts, least: int, cover: int) -> DataFrame:
    """``slot, lang, phrase, a, l, r, score, covers`` of candidates: cuts and covered phrases are read by slot."""
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
        found, count = index.value, counts.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            slots = np.array(batch.column("slot"))
            a = count[slots]
            phrases = batch.column("phrase").cast(pa.binary()).to_pylist()
            split = [p.split(b" ") for p in phrases]
            keep = [i for i in np.flatnonzero(a >= least).tolist() if len(split[i]) > 1]
            languages = batch.column("lang").to_pylist()
            asked, names = [], []
            for i in keep:
                w, k = split[i], len(split[i])
                each_part = [b" ".join(w[x : x + n]) for n in range(1, k) for x in range(k - n + 1)]
                asked += each_part
                names += [languages[i]] * len(each_part)
            if not keep:
                return None
            n_of = dict(zip(zip(names, asked, strict=True), zip((at := found.find(*keys_of(names, asked))).tolist(), count[at].tolist(), strict=True), strict=True))
            out = []
            for i in keep:
                w, own, n = split[i], languages[i], int(a[i])
                cuts = [(2_000_000 * n // (l + r), k, l, r) for k in range(1, len(w)) for l, r in [(n_of[own, b" ".join(w[:k])][1], n_of[own, b" ".join(w[k:])][1])]]
                score, _, l, r = min(cuts)
                inner = {n_of[own, b" ".join(w[x : x + m])] for m in range(2, len(w)) for x in range(len(w) - m + 1)}
                out.append((int(slots[i]), own, phrases[i].decode(), n, l, r, score, [s for s, f in inner if 100 * n >= cover * f]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["slot", "lang", "phrase", "a", "l", "r", "score", "covers"])

        return each

    rows = store(on_batches(texts, make, "slot long, lang string, phrase string, a long, l long, r long, score long, covers array<long>"), "phrase_cuts")
    return rows.join(rows.select(F.explode("covers").alias("slot")).distinct(), "slot", "left_anti").drop("slot", "covers")


def _cut_by_text(counted: DataFrame, least: int, cover: int) -> DataFrame:
    """The same by joins on texts."""
    frequent = store(counted.filter(F.col("a") >= least).withColumn("words", F.split("phrase", " ")), "phrase_frequent")
    known = frequent.select("lang", "phrase", "a")
    long = frequent.filter(F.size("words") > 1)
    cut = long.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("left"), F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("rest"))
    cut = cut.join(known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(20,0)) * CAST(a AS DECIMAL(18,0)) div CAST(l + r AS DECIMAL(20,0)) AS LONG)")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("x")).select("lang", "phrase", "x.*")
    inner = long.select("lang", F.col("a").alias("longer"), F.explode(F.expr("filter(flatten(transform(sequence(2, greatest(2, size(words) - 1)), m -> transform(sequence(1, size(words)), i -> struct(m AS m, i AS i, array_join(slice(words, i, m), ' ') AS part)))), x -> x.i + x.m - 1 <= size(words) AND x.m < size(words))")).alias("x"))
    gone = inner.select("lang", "longer", F.col("x.part").alias("phrase")).join(known, ["lang", "phrase"]).filter(F.expr(f"CAST(100 AS DECIMAL(20,0)) * CAST(longer AS DECIMAL(18,0)) >= CAST({cover} AS DECIMAL(20,0)) * CAST(a AS DECIMAL(18,0))")).select("lang", "phrase").distinct()
    return best.join(gone, ["lang", "phrase"], "left_anti")


def mine(docs: DataFrame, least: int = 30, cover: int = 80, most: int = 2000, bits: int | None = None, broadcast_slots: int = BROADCAST_SLOTS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``most`` phrases.

    ``bits``: 2^bits buckets of the sieve for each length, by default one for each two words or so, from 2^20 to 2^26.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    if bits is None:
        bits = min(26, max(20, int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0).bit_length() - 4))
    passed = _sieve(docs, least, bits)
    shards = 1 + sum(int(np.bitwise_count(p).sum()) for p in passed) // shard_slots
    sieve = spark.sparkContext.broadcast(passed)
    hashes = _slots(docs, sieve, 64 - bits, shards)
    n = hashes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scored = None
    if n <= broadcast_slots:
        own = dict(hashes.select("shard", "hash").collect())  # at most broadcast_slots keys
        none = Slots(np.empty(0, np.uint64), owner=np.empty(0, np.int32))
        index = spark.sparkContext.broadcast(Index([Slots.unpacked(own[s]) if s in own else none for s in range(shards)]))
        counts, texts, totals = _counted_by_slot(docs, sieve, 64 - bits, index, n)
        if texts.count() == n:  # not so if rows came in other partitions than before, as after an unstable shuffle
            scored = _cut_by_slot(texts, index, spark.sparkContext.broadcast(counts), least, cover)
    if scored is None:
        candidates, shards = _candidates(docs, sieve, 64 - bits), max(1, -(-n // shard_slots))
        scored = _cut_by_text(_counted_by_shard(docs, _hashed(candidates, shards), sieve, 64 - bits, shards), least, cover)
        totals = _words_of_languages(docs)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return first.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
