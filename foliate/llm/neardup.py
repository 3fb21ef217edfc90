"""Near-duplicate groups by SetSketch registers, verified on full shingle sets.

1. Each document becomes its set of five-word shingles (64-bit hashes), a digest of the
   set and a SetSketch: for each of ``M`` registers the minimum over the shingles of
   independent exponential variates, truncated to a power of ``BASE``.  Registers of a
   union are the larger of each pair, and equal registers are as likely as the sets'
   Jaccard similarity.
2. Documents with equal digests are one class; what follows works on classes alone.
3. Runs of ``ROWS`` registers are band values.  Classes that share one are linked to the
   smallest class there, its pivot, if the joint likelihood of their registers doesn't
   rule out the threshold and the full sets then confirm it.
4. Bands whose classes are not one component by then are worked through in blocks: their
   pairs across components are estimated, each in the first band that its two share, and
   the members of likely pairs are compared exactly, block by block, through an index of
   shingles.  A block reports one link for two components, so no candidate is lost and a
   large group's pairs are never emitted.  Blocks of a band of very many dissimilar
   classes grow with the square; they are spread over all tasks and none is left out.
5. Components come from alternating large and small stars over the confirmed links.

Hot bands, hubs and classes are handled by partial aggregates and by joins of two
stored tables, whose large partitions Spark splits.  All tables between steps are
written to the shared folder.

Defined results: null and empty texts have no shingles and are linked with nothing; a
text of one to four words is one shingle; repeated rows are one class; rows with equal
ids and different texts are documents of their own; rows with null ids are compared
like others, but a null is never a component's smallest id unless the component has no
other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm import common

M, ROWS, BASE, SCALE = 128, 4, 1.02, 20.0
#: Log-likelihood by which the threshold may fall short of the best fit, about 4.9 standard deviations.
SLACK = 12.0
#: Elements whose variates are drawn at once.
DRAWN = 100_000
#: Classes of a block of step 4, and rows up to which a table of ids is broadcast.
BLOCK, BROADCAST_ROWS = 256, 500_000
#: Shingles that a task of step 4 holds as an index (or one text's), and hits that it counts at once.
INDEXED, HITS = 2_000_000, 500_000
_MIX, _STEP = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, size: int = 5, cached: int = 150_000):
        import xxhash

        self.hash, self.size, self.cached, self.known = xxhash.xxh3_64_intdigest, size, cached, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.cached:
                known.clear()
            new = set(words).difference(known)
            for w in new:
                known[w] = self.hash(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            common.forget_long(known, new)
        k = min(self.size, len(words))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = out * _STEP + h[j : len(h) - k + 1 + j]
        return np.unique(mix(out))


def registers(sets: list[np.ndarray], reach: float = 8.0) -> np.ndarray:
    """A row of M registers for each set; empty sets have zeros.

    The variates of an element are the arrivals of a Poisson process over all
    registers, drawn in order up to ``reach`` divided by the set's size; sets that
    leave a register empty are drawn again further.
    """
    size = np.array([len(s) for s in sets])
    if len(sets) > 1 and size.sum() > DRAWN:  # large batches in parts of a bounded size
        cut = int(np.clip(np.searchsorted(np.cumsum(size), DRAWN), 1, len(sets) - 1))
        return np.concatenate([registers(sets[:cut], reach), registers(sets[cut:], reach)])
    out = np.zeros((len(sets), M), np.uint16)
    todo = np.flatnonzero(size)
    while len(todo):
        n = np.array([len(sets[i]) for i in todo])
        element = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), n)
        most = (reach / n)[owner]
        x, lowest = np.zeros(len(element)), np.full(len(todo) * M, np.inf)
        state = element.copy()
        while len(state):
            state = state + _STEP
            h = mix(state)
            x = x - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / M
            near = x < most
            state, x, owner, most, h = state[near], x[near], owner[near], most[near], h[near]
            np.minimum.at(lowest, owner * M + (h & np.uint64(M - 1)).astype(np.int64), x)
        lowest = lowest.reshape(-1, M)
        full = np.isfinite(lowest).all(1)
        value = np.floor(1 - np.log(lowest[full] / SCALE) / math.log(BASE))
        out[todo[full]] = np.clip(value, 0, 65535).astype(np.uint16)
        todo, reach = todo[~full], reach * 2
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """Each set's band values as 64-bit hashes that also hold the band's number."""
    r = regs.astype(np.uint64).reshape(len(regs), M // ROWS, ROWS)
    h = np.broadcast_to(np.arange(M // ROWS, dtype=np.uint64), r.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * _STEP + r[:, :, k])
    return h.view(np.int64)


def likely(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether a Jaccard similarity of ``least`` or more is likely, jointly by the numbers of larger and smaller registers and the sets' sizes."""
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    equal, u = M - above - below, n_a / (n_a + n_b)
    top = np.minimum(n_a / n_b, n_b / n_a)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
        more, less = p(u - (1 - u) * j), p((1 - u) - u * j)
        log = lambda x: np.log(np.maximum(x, 1e-12))
        return above * log(more) + below * log(less) + equal * log(1 - more - less)

    best = np.full(len(u), -np.inf)
    within = np.full(len(u), -np.inf)
    for step in np.linspace(0, 1, 41):
        best = np.maximum(best, log_likelihood(top * step))
        within = np.maximum(within, log_likelihood(np.minimum(least + (top - least) * step, top)))
    best = np.maximum(best, within)
    return (top >= least - 1e-12) & (within >= best - SLACK)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text``: the first two tell rows apart, null ids too."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _of_row(left: DataFrame, right: DataFrame, how: str, few: bool) -> DataFrame:
    """``left`` joined to ``right`` (``_id, _key, ...``) by row."""
    right = F.broadcast(right) if few else right
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), how)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, key`` (a hash of the text), ``n_shingles, digest`` (null without shingles) and ``regs``."""

    def make():
        shingle = Shingler()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle(t) for t in batch.column(2).to_pylist()]
            regs = registers(sets)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "key", "n_shingles", "digest", "regs"])

        return each

    return common.on_batches(_keyed(docs), make, "doc_id long, key long, n_shingles long, digest binary, regs binary")


def memberships(classes: DataFrame) -> DataFrame:
    """``band, digest`` of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, M)
                yield pa.RecordBatch.from_arrays([pa.array(bands(regs).ravel()), pa.array([d for d in batch.column(0).to_pylist() for _ in range(M // ROWS)], pa.binary())], names=["band", "digest"])

    return classes.select("digest", "regs").mapInArrow(common.trimmed(run), "band long, digest binary")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those of the stored pairs ``a, b`` that are likely."""
    side = lambda k: classes.select(F.col("digest").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("regs").alias(f"regs_{k}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, M) for k in (4, 5))
                good = likely((a > b).sum(1), (a < b).sum(1), batch.column(2).to_numpy(), batch.column(3).to_numpy(), least)
                yield batch.select([0, 1]).filter(pa.array(good))

    return joined.mapInArrow(common.trimmed(run), "a binary, b binary")


def _texts(digests: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``digest, text`` of one document of each class."""
    wanted = common.store(digests.join(classes.select("digest", "top"), "digest").select(F.col("top.id").alias("_id"), F.col("top.key").alias("_key"), "digest"), "neardup_wanted")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = _of_row(_keyed(docs), wanted, "inner", few).select("digest", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            keep = [hashlib.blake2b(shingle(t).tobytes(), digest_size=16).digest() == d for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    common.small_batches(docs.sparkSession)
    return common.store(found.mapInArrow(common.trimmed(same), "digest binary, text string").dropDuplicates(["digest"]), "neardup_texts")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the stored pairs whose full sets hold ``100 * intersection >= percent * union``."""
    texts = _texts(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct(), docs, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        recent: dict[bytes, np.ndarray] = {}

        def of(digest: bytes, text: str) -> np.ndarray:
            if digest not in recent:
                if len(recent) >= 64 or sum(map(len, recent.values())) > INDEXED:
                    recent.clear()
                recent[digest] = shingle(text)
            return recent[digest]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, t = of(a, x), shingle(y)
                common_n = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * common_n >= percent * (len(s) + len(t) - common_n))
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: texts.select(F.col("digest").alias(k), F.col("text").alias(f"text_{k}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(common.trimmed(run), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of each node of the stored edges ``a, b``; the root is the smallest node of its component."""
    oriented = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, mark = common.store(oriented, "neardup_edges"), None
    while True:
        both = now.union(now.select("v", "u"))
        # Large star: each node's larger neighbours go to its smallest one.
        least = common.store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "neardup_least")
        grown = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = common.store(grown, "neardup_edges")
        # Small star: each node and its smaller neighbours go to the smallest of them.
        least = common.store(now.groupBy("u").agg(F.min("v").alias("m")), "neardup_least")
        joined = now.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = common.store(small, "neardup_edges")
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if new == mark:
            break
        mark = new
    return common.store(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct()), "neardup_components")


def _by_task(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows sorted by their first ``keys`` columns, in runs of equal ones."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    yield from groupby(rows, key=lambda r: r[:keys])


def _open(placed: DataFrame, block: int) -> DataFrame:
    """Bands of several components: the largest one and both sides' numbers of blocks."""
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    held = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("held")).filter("held > n_major")
    return held.select("band", "major", F.ceil(F.col("n_major") / block).cast("int").alias("majors"), F.ceil((F.col("held") - F.col("n_major")) / block).cast("int").alias("rests"))


def _residual_links(members: DataFrame, docs: DataFrame, classes: DataFrame, roots: DataFrame, percent: int, block: int) -> DataFrame:
    """Links across components within bands that hold several (``members``: stored ``band, digest``), one for two components of a task at most.

    A group's largest component is cut into blocks, and so are the rest of its members;
    each block of the rest meets each block of the largest and of the rest, however many
    there are: a pair may share no other band.
    """
    least = percent / 100
    named = roots.select(F.col("node").alias("digest"), "root")
    placed = common.store(members.join(named, "digest", "left").select("band", "digest", F.coalesce("root", "digest").alias("root")), "neardup_placed")
    open_bands = common.store(_open(placed, block), "neardup_open")
    left = placed.join(open_bands, ["band"]).withColumn("is_major", F.col("root") == F.col("major"))
    of = lambda n: F.pmod(F.xxhash64("digest"), n).cast("int")
    # A task is (x, y): blocks of the rest are 0, 1, ..., and those of the largest component -1, -2, ...
    spread = left.withColumn("own", F.when(F.col("is_major"), -1 - of(F.col("majors"))).otherwise(of(F.col("rests"))))
    other = F.when(F.col("is_major"), F.sequence(F.lit(0), F.col("rests") - 1)).otherwise(F.concat(F.sequence(-F.col("majors"), F.lit(-1)), F.sequence(F.lit(0), F.col("rests") - 1)))
    tasks = spread.withColumn("other", F.explode(other)).select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "digest", "root")
    n = common.partitions(classes.sparkSession)
    key = ["band", "x", "y"]
    rows = common.store(tasks, "neardup_blocks").join(classes.select("digest", "n_shingles", "regs"), "digest")
    rows = rows.select(*key, "own", "digest", "root", "n_shingles", "regs").repartition(n, *key).sortWithinPartitions(*key)
    common.small_batches(classes.sparkSession)
    #: A pair at the threshold has so few equal registers in one of 10 ** 12 cases.
    fewest = int(M * least - 7 * math.sqrt(M * least * (1 - least)))
    kinds = (pa.int64(), pa.int32(), pa.int32())

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that are in a likely pair."""
        for (band, x, y), group in _by_task(batches, 3):
            held = list(group)
            if len(held) < 2:
                continue
            *_, own, digests, own_roots, sizes, regs = zip(*held, strict=True)
            number = {r: k for k, r in enumerate(dict.fromkeys(own_roots))}
            root, size, side = np.array([number[r] for r in own_roots]), np.array(sizes), np.array(own)
            r = np.frombuffer(b"".join(regs), np.uint16).reshape(-1, M)
            at = int(np.flatnonzero(bands(r[:1])[0] == band)[0])  # this band's number
            a, b = np.flatnonzero(side == x), np.flatnonzero(side == y)
            hit = np.zeros(len(held), bool)
            for k in range(0, len(a), 32):  # 32 of a block at a time
                part = a[k : k + 32]
                equal = r[part][:, None, :] == r[b][None, :, :]
                near = (equal.sum(2) >= fewest) & (root[part][:, None] != root[b][None, :])
                i, j = np.nonzero(near)
                first = equal[i, j].reshape(-1, M // ROWS, ROWS).all(2).argmax(1) == at  # each pair in the first band that it shares
                i, j = i[first], j[first]
                i, j = part[i], b[j]
                if len(i):
                    good = likely((r[i] > r[j]).sum(1), (r[i] < r[j]).sum(1), size[i], size[j], least)
                    hit[i[good]] = hit[j[good]] = True
            if hit.any():
                keep = np.flatnonzero(hit).tolist()
                columns = [*(pa.array([v] * len(keep), t) for v, t in zip((band, x, y), kinds, strict=True)), pa.array([own[k] for k in keep], pa.int32()), *(pa.array([c[k] for k in keep], pa.binary()) for c in (digests, own_roots)), pa.array([sizes[k] for k in keep], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*key, "own", "digest", "root", "n_shingles"])

    flagged = common.store(rows.mapInArrow(common.trimmed(estimate), "band long, x int, y int, own int, digest binary, root binary, n_shingles long"), "neardup_flagged")
    texts = _texts(flagged.select("digest").distinct(), docs, classes)
    # Block y is an index, cut into slices of INDEXED shingles at most (or one text), that block x streams past, a copy for each slice.
    before = Window.partitionBy(*key).orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    index = flagged.filter("own = y").withColumn("slice", F.floor(F.coalesce(F.sum("n_shingles").over(before), F.lit(0)) / INDEXED).cast("int"))
    index = common.store(index.select(*key, "slice", "digest", "root"), "neardup_index")
    slices = index.groupBy(*key).agg(F.array_distinct(F.collect_list("slice")).alias("slices"))
    stream = flagged.filter("own = x").join(slices, key).select(*key, F.explode("slices").alias("slice"), F.lit(True).alias("second"), "digest", "root")
    both = index.select(*key, "slice", F.lit(False).alias("second"), "digest", "root").union(stream)
    full = both.join(texts, "digest").select(*key, "slice", "second", "digest", "root", "text")
    full = full.repartition(n, *key, "slice").sortWithinPartitions(*key, "slice", "second")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact links."""
        shingle = Shingler()
        for _, group in _by_task(batches, 4):
            parent: dict[bytes, bytes] = {}
            links: list[tuple[bytes, bytes]] = []
            names, own_roots, sets, index = [], [], [], None

            def top(r: bytes, parent=parent) -> bytes:
                while (p := parent.get(r, r)) != r:
                    r = p
                return r

            for *_, second, digest, root, text in group:
                s = shingle(text)
                if not second:
                    names.append(digest)
                    own_roots.append(root)
                    sets.append(s)
                    continue
                if index is None:
                    sizes = np.array([len(x) for x in sets], np.int64)
                    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                    order = np.argsort(values, kind="stable")
                    index = values[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes
                    sets.clear()
                values, owners, sizes = index
                lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                n_hit = hi - lo
                if not n_hit.any():
                    continue
                shared = np.zeros(len(sizes), np.int64)
                ends = np.searchsorted(np.cumsum(n_hit), np.arange(0, n_hit.sum(), HITS), "left").tolist()
                for i, j in zip(ends, [*ends[1:], len(n_hit)], strict=True):  # so many hits at once, or one shingle's
                    part, total = n_hit[i:j], np.cumsum(n_hit[i:j])
                    if len(total):
                        shared += np.bincount(owners[np.repeat(lo[i:j] - (total - part), part) + np.arange(total[-1])], minlength=len(sizes))
                for k in np.flatnonzero(100 * shared >= percent * (len(s) + sizes - shared)).tolist():
                    p, q = top(root), top(own_roots[k])
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        links.append((digest, names[k]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return full.mapInArrow(common.trimmed(compare), "a binary, b binary")


def _grouped(docs: DataFrame, percent: int, block: int) -> DataFrame:
    """``doc_id, key, n_shingles, digest, top`` of each row; ``top`` is the ``id`` and ``key`` of the row that stands for its component."""
    least = percent / 100
    signed = common.store(signatures(docs), "neardup_signatures")
    held = signed.filter("digest is not null")
    # Null ids come last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key"))
    classes = common.store(held.groupBy("digest").agg(first.alias("top"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")), "neardup_classes")
    member = memberships(classes)
    pivots = common.store(member.groupBy("band").agg(F.min("digest").alias("pivot"), F.count("*").alias("held")).filter("held > 1"), "neardup_pivots")
    members = common.store(member.join(pivots, "band"), "neardup_members")
    stars = common.store(members.filter("digest <> pivot").select(F.col("pivot").alias("a"), F.col("digest").alias("b")).distinct(), "neardup_stars")
    likely_pairs = common.store(_estimated(stars, classes, least), "neardup_likely")
    edges = common.store(_verified(likely_pairs, docs, classes, percent), "neardup_links")
    roots = components(edges)
    more = common.store(_residual_links(members.select("band", "digest"), docs, classes, roots, percent, block), "neardup_links")
    if not more.isEmpty():
        roots = components(edges.union(more))
    named = classes.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").select("digest", "top", F.coalesce("root", "digest").alias("root"))
    named = common.store(named, "neardup_named")
    smallest = common.store(named.groupBy("root").agg(F.min("top").alias("top")), "neardup_smallest")
    final = common.store(named.select("digest", "root").join(smallest, "root").select("digest", "top"), "neardup_final")
    return signed.select("doc_id", "key", "n_shingles", "digest").join(final, "digest", "left")


def group(docs: DataFrame, percent: int = 75, block: int = BLOCK, pairs: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``; ``pairs`` has no effect, as bands of any size are worked through whole."""
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("top.id"))
    return _grouped(docs, percent, block).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all columns.

    Of rows with equal ids and different texts in one group, that with the smallest hash
    of its text stays; repeated rows stay or go together.
    """
    of_top = F.col("doc_id").eqNullSafe(F.col("top.id")) & (F.col("key") == F.col("top.key"))
    gone = _grouped(docs, percent, block).filter(F.col("digest").isNotNull() & ~of_top)
    dropped = common.store(gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "neardup_dropped")
    few = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    return _of_row(packed, dropped, "left_anti", few).select("row.*")
