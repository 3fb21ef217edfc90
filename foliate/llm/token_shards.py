"""Token ids as Re-Pair compressed shards, in ascending document order.

``write_shards`` range-partitions documents by id, encodes whole texts and packs runs
of documents into grammar shards (see ``grammar``).  Shards are rows of a Parquet
table, so Spark's commit protocol makes the write whole on any store, also when
tasks are retried.  ``read_shards`` decodes them again.

Defined results: a null text is empty and holds the end id alone; an empty table
gives no shards; rows with equal ids stand side by side, ordered by a hash of the text,
each a document of its own; null ids come first and are read back as null; columns other
than ``doc_id`` and ``text`` are ignored.  A document longer than ``shard_tokens``
is a shard of its own.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import compress, pairwise, repeat
from operator import is_
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm import common, grammar

SHARDS = "part int, seq int, part_start long, first_doc long, n_docs long, n_tokens long, shard binary"
#: Marks that are a pre-token of their own after a letter or digit; an apostrophe may not be.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Such marks at a chunk's end, after a letter that no normaliser turns into anything but a letter.
LAST_MARKS = r"([A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~]+)([\t-\r ]|$)"


class ChunkEncoder:
    """Encodes texts with a word-end BPE tokenizer whose pre-tokens never hold white space.

    Texts fall into chunks at ASCII white space; each distinct chunk of a batch is looked
    up once, in a bounded cache of two halves: a full half becomes the old one, out of which
    chunks that are met again move to the new one.  Of new chunks, runs of marks after letters are encoded on
    their own, as pre-tokens of their own; letters in the form that the normaliser
    gives them go through a pipeline without it, many at a time, and are told apart by
    the tokens that end a pre-token.  The others are encoded together, parted by a
    control character whose id nothing else yields.
    """

    PART = "\x02"

    def __init__(self, path: str, cached: int = 900_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        # For letters that are lower-case and composed, the normaliser and the split change nothing.
        self.lean = Tokenizer.from_file(path)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.lean.normalizer, self.lean.pre_tokenizer = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        self.ascii = Tokenizer.from_file(path)
        self.ascii.normalizer, self.ascii.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.tokenizer, self.cached, self.cache, self.old = Tokenizer.from_file(path), cached, {}, {}
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        (self.part,) = self.tokenizer.encode(self.PART, add_special_tokens=False).ids
        self.closes = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.tails: dict[bytes, bytes] = {}

    def _batch(self, tokenizer, chunks: list[bytes], part: bytes, group: int = 256) -> list[tuple[list[bytes], np.ndarray]]:
        groups = [chunks[k : k + group] for k in range(0, len(chunks), group)]
        encoded = tokenizer.encode_batch_fast([part.join(g).decode() for g in groups], add_special_tokens=False)
        return [(g, np.array(e.ids, "<u4")) for g, e in zip(groups, encoded, strict=True)]

    def _keep(self, chunks: list[bytes], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        raw = ids.tobytes()
        for chunk, a, b in zip(chunks, starts, ends, strict=True):
            self.cache[chunk] = raw[4 * a : 4 * b]

    def _tail(self, tail: bytes) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = np.array(self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return self.tails[tail]

    def _encode(self, chunks: set[bytes], strange: bool = True) -> None:
        plain = [c for c in chunks if c.isalpha()]
        odd = [c for c in chunks if b"<|" in c or b"\x02" in c] if strange else []
        rest = [c for c in chunks if not c.isalpha()] if not odd else [c for c in chunks.difference(odd) if not c.isalpha()]
        bare = [c.rstrip(MARKS) for c in rest]
        # After an ASCII letter or digit, marks are a pre-token of their own.
        marked = [(c, b) for c, b in zip(rest, bare, strict=True) if len(b) < len(c) and b[-1:].isalnum()]
        lean = [c for c, b in zip(rest, bare, strict=True) if len(b) == len(c) or not b[-1:].isalnum()]
        bases, other = {b for _, b in marked}, []
        self.cache |= {c: self.old[c] for c in bases if c in self.old}
        missing = [c for c in bases if c not in self.cache and c not in chunks]
        plain += [c for c in missing if c.isalpha()]
        lean += [c for c in missing if not c.isalpha()]
        simple = []
        for c, t in zip(lean, [c.decode() for c in lean], strict=True):
            (simple if t.isalpha() and t == t.lower() and is_normalized("NFC", t) else other).append(c)
        for own, ids in [*self._batch(self.ascii, plain, b" "), *self._batch(self.lean, simple, b" ")]:
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(own):  # each chunk has one pre-token at least, so each has one
                self._keep(own, ids, [0, *ends[:-1].tolist()], ends.tolist())
            else:
                other += own
        for own, ids in self._batch(self.tokenizer, other, f" {self.PART} ".encode()):
            at = np.flatnonzero(ids == self.part).tolist()
            self._keep(own, ids, [0, *(k + 1 for k in at)], [*at, len(ids)])
        for chunk, e in zip(odd, self.tokenizer.encode_batch_fast([c.decode() for c in odd], add_special_tokens=False), strict=True):
            self.cache[chunk] = np.array(e.ids, "<u4").tobytes()
        for c, base in marked:
            self.cache[c] = self.cache[base] + self._tail(c[len(base) :])

    def _found(self, chunks: list[bytes], special: bool) -> list[bytes]:
        """Each chunk's ids; ``chunks`` are distinct.  What both halves of the cache lack is encoded."""
        found = list(map(self.cache.get, chunks))
        missing = list(compress(range(len(found)), map(is_, found, repeat(None))))
        if missing:
            old, new = self.old, set()
            if len(self.cache) + len(missing) > self.cached // 2:
                self.old, self.cache = self.cache, {}
            for k in missing:
                if (ids := old.get(chunks[k])) is None:
                    new.add(chunks[k])
                else:
                    found[k] = self.cache[chunks[k]] = ids
            self._encode(new, special)
            for k in missing:
                if found[k] is None:
                    found[k] = self.cache[chunks[k]]
            common.forget_long(self.cache, new)
        return found

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 strings one after the other, and the bounds of each string's ids."""
        # ASCII case is lost to the normaliser anyway; special tokens keep theirs, and their marks, until they are told apart.
        opens = pc.match_substring(texts, "<|")
        opened = pc.any(opens).as_py()
        parted = pc.replace_substring_regex(texts, LAST_MARKS, r"\1 \2\3")
        if opened:
            parted = pc.if_else(opens, texts, parted)
        split = pc.ascii_split_whitespace(pc.ascii_lower(parted))
        chunks, ends = split.flatten(), split.offsets.to_numpy()
        if opened:
            own = pc.ascii_split_whitespace(parted).flatten()
            chunks = pc.if_else(pc.match_substring(own, "<|"), own, chunks)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = self._found(distinct, opened or pc.any(pc.match_substring(texts, self.PART)).as_py())
        bounds = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, dtype=np.int32)
        of = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), bounds])), pa.array(np.frombuffer(b"".join(found), "<u4")))
        ids = of.take(coded.indices)
        return ids.flatten().to_numpy(), ids.offsets.to_numpy()[ends].astype(np.int64)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each UTF-8 text's ids as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_array(pa.array(texts, pa.binary()).cast(pa.string()))
        return [ids[a:b].tobytes() for a, b in pairwise(bounds.tolist())]


_loaded: dict[str, ChunkEncoder] = {}


def loaded(path: str) -> ChunkEncoder:
    """One for each worker process: later tasks find its cache filled."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


def grouped(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``most`` bytes, so that a chunk is looked up less often; a larger one stays alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, shard_tokens: int = 1 << 21, per_round: int = 4096) -> None:
    """Writes ``docs``' ids to ``path``; ``end_id`` ends each document."""
    spark = docs.sparkSession
    common.small_batches(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        encoder = loaded(tokenizer)
        ids: list[int] = []
        runs: list[np.ndarray] = []
        held = nulls = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, held, nulls
            lengths = np.fromiter(map(len, runs), np.int64, len(runs))
            blob = grammar.pack(np.array(ids, np.int64), lengths, np.concatenate(runs), encoder.size, nulls, per_round=per_round)
            row = (part, seq, before, ids[0], len(ids), held, blob)
            seq, before, held, nulls = seq + 1, before + held, 0, 0
            ids.clear()
            runs.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)], names=["part", "seq", "part_start", "first_doc", "n_docs", "n_tokens", "shard"])

        gc.disable()  # millions of byte strings and no cycles: tracing them is a tenth of the work
        try:
            for batch in grouped(batches):
                found, bounds = encoder.encode_array(batch.column(1).cast(pa.string()).fill_null(""))
                found = np.insert(found, bounds[1:], end_id)
                bounds += np.arange(len(bounds))
                for key, (a, b) in zip(batch.column(0).to_pylist(), pairwise(bounds.tolist()), strict=True):
                    run = found[a:b]
                    if runs and held + len(run) > shard_tokens:
                        yield flush()
                    nulls += key is None  # they come first
                    ids.append(key or 0)
                    runs.append(run)
                    held += len(run)
            if runs:
                yield flush()
        finally:
            gc.enable()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.withColumn("key", F.xxhash64("text")).repartitionByRange(common.partitions(spark), "doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    ordered.select("doc_id", "text").mapInArrow(common.trimmed(pack), SHARDS).write.option("compression", "zstd").parquet(path)


def read_shards(spark, path: str, derive: Callable[[np.ndarray], tuple] | None = None, columns: str = "ids array<long>") -> DataFrame:
    """``doc_id, start, n_tokens`` and what ``derive`` makes of each document's ids (the ids themselves, if it isn't given)."""
    common.small_batches(spark)
    shards = spark.read.schema(SHARDS).parquet(path)
    # One row for each range partition of the write, which bounds the broadcast and the window.
    base = shards.groupBy("part").agg(F.sum("n_tokens").alias("held")).select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("base"))
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = grammar.Shard(blob.as_py())
                ids, bounds = shard.all_ids(), shard.token_starts
                more = [(derive or (lambda x: (x.tolist(),)))(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                keys = shard.doc_ids
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=np.arange(len(keys)) < shard.nulls), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), *(pa.array(list(x)) for x in zip(*more, strict=True))], names=["doc_id", "start", "n_tokens", *names])

    rows = shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("part_start")).alias("start"), "shard")
    return rows.mapInArrow(common.trimmed(decode), f"doc_id long, start long, n_tokens long, {columns}")
