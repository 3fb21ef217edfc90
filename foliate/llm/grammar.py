"""Re-Pair grammars over token ids, and the binary shard format that holds them.

A shard is one byte string, readable by itself (integers little-endian, packed ones in
as few bits as the largest of them needs, most significant bit first):

    b"RPG2", uint32 first_nonterminal, uint32 n_docs, uint32 n_null, uint32 n_rules, uint64 n_symbols
    uint8 bits of: token lengths, symbol lengths, rules, expansion lengths, symbols
    int64 doc_ids[n_docs] (the first n_null stand for null)
    packed: tokens and symbols of each document, both symbols of each rule, expansion lengths, symbols

Symbols below ``first_nonterminal`` are token ids.  Symbol ``first_nonterminal + k``
stands for the two symbols of rule ``k``; rules only refer to earlier rules.  No
symbol crosses a document's end.  A window of a document's tokens is found by the
stored expansion lengths: symbols before it are passed over whole, and only rules that
reach into it are descended.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"RPG2"
_HEAD = struct.Struct("<4sIIIIQ5B")


def bits_of(values: np.ndarray) -> int:
    return int(values.max()).bit_length() if len(values) else 0


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """``bits`` bits of each value, one after the other."""
    if not bits or not len(values):
        return b""
    wide = ">u4" if bits <= 32 else ">u8"
    part = 1 << 16  # a multiple of 8, so that parts end with a byte

    def one(x: np.ndarray) -> bytes:
        ones = np.unpackbits(x.astype(wide).view(np.uint8).reshape(len(x), -1), axis=1)
        return np.packbits(ones[:, ones.shape[1] - bits :]).tobytes()

    return b"".join(one(values[k : k + part]) for k in range(0, len(values), part))


def packed_bytes(n: int, bits: int) -> int:
    return (n * bits + 7) // 8


def unpack_bits(raw: np.ndarray, bits: int, start: int, stop: int) -> np.ndarray:
    """Values ``start:stop`` of packed bytes."""
    if not bits or start >= stop:
        return np.zeros(max(stop - start, 0), np.int64)
    first = start * bits // 8
    own = np.concatenate([raw[first : (stop * bits + 7) // 8], np.zeros(8, np.uint8)])
    # Each value lies within the eight bytes from that of its first bit: 57 bits at most.
    words = np.ndarray(len(own) - 7, ">u8", own, strides=(1,))
    out = np.empty(stop - start, np.int64)
    for k in range(start, stop, 1 << 16):
        at = np.arange(k, min(stop, k + (1 << 16)), dtype=np.int64) * bits - 8 * first
        out[k - start : k - start + len(at)] = (words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)) >> np.uint64(64 - bits)
    return out


def _slots(left: np.ndarray, right: np.ndarray, bits: int, turn: int) -> np.ndarray:
    """A slot for each pair, dealt differently in each turn."""
    odd = np.random.default_rng(turn).integers(1, 1 << 31, 3, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty(len(left), np.int64)
    for k in range(0, len(left), 1 << 15):  # parts that stay in a processor's cache
        mixed = left[k : k + (1 << 15)] * odd[0] + right[k : k + (1 << 15)] * odd[1]
        mixed ^= mixed >> np.uint32(15)
        mixed *= odd[2]
        out[k : k + (1 << 15)] = mixed >> np.uint32(32 - bits)
    return out


def _tally(slot: np.ndarray, across: np.ndarray, bits: int) -> np.ndarray:
    """Pairs in each slot, without those at ``across``."""
    return np.bincount(slot, minlength=1 << bits) - np.bincount(slot[across], minlength=1 << bits)


def _chosen(marked: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Non-overlapping positions to replace: of two overlapping pairs the more
    frequent one wins, and within a run of equally frequent ones every second one."""
    place = np.arange(len(marked))
    near = np.diff(marked) == 1
    gap = np.ones(len(marked), bool)
    gap[1:] = ~near | (count[1:] != count[:-1])
    first = np.maximum.accumulate(np.where(gap, place, 0))
    weight = count * 2 + (1 - ((place - first) & 1))
    win = np.ones(len(marked), bool)
    win[1:] &= ~near | (weight[1:] > weight[:-1])
    win[:-1] &= ~near | (weight[:-1] >= weight[1:])
    return win


def _by_slots(seq: np.ndarray, across: np.ndarray, turn: int, per_round: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, numbers and keys of the pairs that stand for the ``per_round`` fullest slots.

    Pairs at ``across`` cross a document's end.  Of the pairs that share a slot, that which a second dealing counts highest stands for it.
    """
    bits = int(np.clip(np.ceil(np.log2(max(len(seq), 2))), 10, 18))
    left, right = seq[:-1], seq[1:]
    slot = _slots(left, right, bits, 2 * turn)
    tally = _tally(slot, across, bits)
    full = np.flatnonzero(tally >= least)
    if not len(full):
        return full, full, np.empty(0, np.uint64)
    full = np.sort(full[np.argpartition(-tally[full], min(per_round, len(full)) - 1)[:per_round]])
    rank = np.full(1 << bits, -1, np.int32)
    rank[full] = np.arange(len(full))
    of = rank[slot]
    of[across] = -1
    at = np.flatnonzero(of >= 0)
    number = of[at]
    key = (left[at].astype(np.uint64) << np.uint64(32)) | right[at]
    second = _slots(left[at], right[at], bits, 2 * turn + 1)
    best = np.zeros(len(full), np.int64)
    np.maximum.at(best, number, (np.bincount(second, minlength=1 << bits)[second] << 32) | np.arange(len(at)))
    own = key[best & 0xFFFFFFFF]
    same = own[number] == key
    return at[same], number[same], own


def _exactly(seq: np.ndarray, across: np.ndarray, turn: int, per_round: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the ``per_round`` most frequent pairs, counted by sorting those whose slots hold ``least`` pairs: no other is frequent."""
    bits = int(np.clip(np.ceil(np.log2(max(len(seq), 2))), 10, 20))
    slot = _slots(seq[:-1], seq[1:], bits, 2 * turn)
    full = (_tally(slot, across, bits) >= least)[slot]
    full[across] = False
    at = np.flatnonzero(full)
    key = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
    own, back, count = np.unique(key, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count >= least)
    if len(often) > per_round:
        often = often[np.argpartition(-count[often], per_round - 1)[:per_round]]
    rank = np.full(len(own), -1, np.int64)
    rank[often] = np.arange(len(often))
    number = rank[back]
    hit = number >= 0
    return at[hit], number[hit], own[often]


def build(ids: np.ndarray, ends: np.ndarray, first: int, per_round: int = 4096, least: int = 8, slot_gain: float = 0.001) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules, expansion lengths and each document's end in symbols.

    ``ends``: each document's end in ids, ascending.  A round takes the ``per_round``
    most frequent adjacent pairs, gives each a nonterminal and replaces them at once;
    of overlapping ones the more frequent wins.  Rounds go on until no pair within a
    document occurs ``least`` times beside itself; while a round shortens the sequence by
    ``slot_gain`` or more, pairs are counted by slots, and after that exactly.
    """
    seq, ends = ids.astype(np.uint32), ends.astype(np.int64)
    rules, lengths = [np.empty((0, 2), np.uint32)], [np.empty(0, np.uint32)]
    made, length_of, turn, slots = 0, np.ones(first, np.uint32), 0, True
    while len(seq) > 1:
        across = np.unique(ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(seq))] - 1)  # documents without ids share an end
        at, number, own = _by_slots(seq, across, turn, per_round, least) if slots else _exactly(seq, across, turn, per_round, least)
        turn += 1
        # A pair that loses its places to others is no rule, so each round either shortens the sequence or is the last of its kind.
        count = np.bincount(number, minlength=len(own))
        win = _chosen(at, count[number]) if len(at) else np.ones(0, bool)
        at, number = at[win], number[win]
        keep = np.bincount(number, minlength=len(own)) >= least
        live = keep[number]
        at, number = at[live], (np.cumsum(keep) - 1)[number[live]]
        if not len(at):
            if not slots:
                break
            slots = False
            continue
        new = own[keep]
        pair = np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        slots = slots and len(at) >= slot_gain * len(seq)
        seq[at] = (number + first + made).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        gone = np.searchsorted(at, ends, "left")  # a pair lies within its document, so before its end
        seq, ends = seq[stay], ends - gone
        length = length_of[pair[:, 0]] + length_of[pair[:, 1]]
        length_of = np.concatenate([length_of, length])
        rules.append(pair)
        lengths.append(length)
        made += len(pair)
    return seq, np.concatenate(rules), np.concatenate(lengths), ends


def flat_rules(rules: np.ndarray, lengths: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules' expansions one after the other, and where each begins; rules only refer to earlier ones."""
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    flat, done = np.empty(int(starts[-1]), np.uint32), 0
    pair = rules.astype(np.int64) - first
    while done < len(rules):
        # The longest run of rules that refer to finished ones alone.
        ahead = np.flatnonzero((pair[done:] >= done).any(1))
        stop = done + int(ahead[0]) if len(ahead) else len(rules)
        part = rules[done:stop].ravel()
        flat[starts[done] : starts[stop]] = expand(part, flat, starts, lengths, first)
        done = stop
    return flat, starts


def expand(symbols: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    big = np.flatnonzero(symbols >= first)
    if not len(big):
        return symbols.astype(np.uint32)
    rule = symbols[big].astype(np.int64) - first
    size = lengths[rule].astype(np.int64)
    n = np.ones(len(symbols), np.int64)
    n[big] = size
    end = np.cumsum(n)
    out = np.empty(int(end[-1]), np.uint32)
    small = np.ones(len(symbols), bool)
    small[big] = False
    out[end[small] - 1] = symbols[small]
    # Rules' ids: their places in `flat` and in `out` move together.
    total = np.cumsum(size)
    within = np.arange(int(total[-1])) - np.repeat(total - size, size)
    out[np.repeat(end[big] - size, size) + within] = flat[np.repeat(starts[rule], size) + within]
    return out


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, first: int, nulls: int = 0, **how) -> bytes:
    """A shard of documents, whose ids stand one after the other in ``ids``; the first ``nulls`` have no id."""
    symbols, rules, expansions, symbol_ends = build(ids, np.cumsum(lengths, dtype=np.int64), first, **how)
    parts = [np.asarray(lengths), np.diff(symbol_ends, prepend=0), rules.ravel(), expansions, symbols]
    bits = [bits_of(x) for x in parts]
    return b"".join((_HEAD.pack(MAGIC, first, len(doc_ids), nulls, len(rules), len(symbols), *bits), np.asarray(doc_ids, "<i8").tobytes(), *map(pack_bits, parts, bits)))


class Shard:
    """Reads a packed shard; a window expands nothing but the symbols that reach into it."""

    def __init__(self, blob: bytes):
        if len(blob) < _HEAD.size:
            raise ValueError("a damaged grammar shard")
        magic, self.first, docs, self.nulls, rules, symbols, *bits = _HEAD.unpack_from(blob)
        sizes = [packed_bytes(n, b) for n, b in zip((docs, docs, 2 * rules, rules, symbols), bits, strict=True)]
        if magic != MAGIC:
            raise ValueError("not a grammar shard")
        if len(blob) != _HEAD.size + 8 * docs + sum(sizes):
            raise ValueError("a damaged grammar shard")
        self.doc_ids = np.frombuffer(blob, "<i8", docs, _HEAD.size)
        raw, at = np.frombuffer(blob, np.uint8), _HEAD.size + 8 * docs
        parts = []
        for n in sizes:
            parts.append(raw[at : at + n])
            at += n
        starts = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        self.token_starts, self.symbol_starts = starts(unpack_bits(parts[0], bits[0], 0, docs)), starts(unpack_bits(parts[1], bits[1], 0, docs))
        self.n_rules, self._parts, self._bits = rules, parts, bits
        if self.symbol_starts[-1] != symbols:
            raise ValueError("a damaged grammar shard")

    def symbols(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        return unpack_bits(self._parts[4], self._bits[4], start, int(self.symbol_starts[-1]) if stop is None else stop)

    def rule(self, k: int) -> list[int]:
        return unpack_bits(self._parts[2], self._bits[2], 2 * k, 2 * k + 2).tolist()

    def length(self, symbol: int) -> int:
        """Tokens that a symbol stands for."""
        return 1 if symbol < self.first else int(unpack_bits(self._parts[3], self._bits[3], symbol - self.first, symbol - self.first + 1)[0])

    def all_ids(self) -> np.ndarray:
        """All documents' ids; this alone expands all rules."""
        lengths = unpack_bits(self._parts[3], self._bits[3], 0, self.n_rules)
        flat, starts = flat_rules(unpack_bits(self._parts[2], self._bits[2], 0, 2 * self.n_rules).reshape(-1, 2), lengths, self.first)
        return expand(self.symbols(), flat, starts, lengths, self.first)

    def window(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start:stop`` of the ``k``-th document."""
        total = int(self.token_starts[k + 1] - self.token_starts[k])
        stop = total if stop is None else min(stop, total)
        out: list[int] = []
        at = 0
        # Symbols still to be read, the next one last; those before the window are passed over by their lengths.
        for own in self.symbols(int(self.symbol_starts[k]), int(self.symbol_starts[k + 1])).tolist():
            if at >= stop:
                break
            stack = [own]
            while stack and at < stop:
                symbol = stack.pop()
                size = self.length(symbol)
                if at + size <= start:
                    at += size
                elif symbol < self.first:
                    out.append(symbol)
                    at += 1
                else:
                    stack += reversed(self.rule(symbol - self.first))
        return np.array(out, np.uint32)
