"""Language-model scores, divergence of sources and collocations against brute force, exact posteriors and odd inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliate.llm import divergence, phrases, pitman_yor, queries

KIND = "doc_id long, text string, lang string, source string, n_chars long, n long, slot long, word string, chunk long, place int, rank int, value long"
ODD = ["", None, " \n\t ", "one", "a b. a b! a b; c", "A b, a B\x0bA b\ta b", "Ünï cødé 日本語 📝 é ́ ünï", "x\x02y \x1c z w " * 3, "word " * 3000, "a b c d " * 60, "same text here for all of us", "same text here for all of us", "İ ß Ǆ A B"]


@pytest.fixture(scope="module")
def docs(spark):
    extra = (1, 2, 3, "w", 4, 5, 6, 7)
    rows = [(k, t, [None, "en", "und", "de", ""][k % 5], [None, "s", "", "t"][k % 4], *extra) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[9], (None, "no id here a b", None, None, *[None] * 8)], KIND).repartition(3)


def small(docs):
    return [(r.doc_id, r.text or "", r.lang, r.source) for r in docs.collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# 11. Language model ------------------------------------------------------------------------------


def seatings(c, d):
    """By tables, the weight of all ways to seat c customers, counted one by one."""
    held = Counter({(1,): 1.0})
    for _ in range(c - 1):
        new = Counter()
        for sizes, w in held.items():
            new[(*sizes, 1)] += w
            for k, s in enumerate(sizes):
                new[(*sizes[:k], s + 1, *sizes[k + 1 :])] += w * (s - d)
        held = new
    out = Counter()
    for sizes, w in held.items():
        out[len(sizes)] += w
    return out


def test_stirling_numbers_count_seatings():
    table = pitman_yor.stirling(0.3, 8)
    for c in range(1, 7):
        for t, w in seatings(c, 0.3).items():
            assert math.isclose(math.exp(table[c, t]), w, rel_tol=1e-9)


def posterior(counts, base, d, strength):
    """Of the numbers of tables of a restaurant's dishes, by enumeration."""
    weights = {(): 1.0}
    for c in counts:
        weights = {(*k, t): w * v for k, w in weights.items() for t, v in seatings(c, d).items()}
    for k in weights:
        for i in range(sum(k)):
            weights[k] *= strength + d * i
        for t, p in zip(k, base, strict=True):
            weights[k] *= p**t
    whole = sum(weights.values())
    return {k: w / whole for k, w in weights.items()}


@pytest.mark.parametrize("exact", [1024, 1])
def test_gibbs_has_the_exact_posterior(exact):
    """Sweeps, with table counts from their conditional and with customers moved one by one, visit seatings as often as they weigh."""
    counts, base = [5, 3, 2], [0.5, 0.2, 0.3]
    want, random, seen = posterior(counts, base, 0.4, 1.5), np.random.default_rng(3), Counter()
    t, sizes = np.ones(3, np.int64), {k: [c] for k, c in enumerate(counts)}
    for _ in range(12_000):
        t = pitman_yor.reseat(np.zeros(3, np.int64), np.array(counts), t, sizes if exact == 1 else {}, np.array(base), 0.4, 1.5, random, exact=exact, moves=5)
        assert exact > 1 or all(sum(sizes[k]) == c for k, c in enumerate(counts))
        seen[tuple(t.tolist())] += 1
    assert sum(abs(seen[k] / 12_000 - p) for k, p in want.items()) < 0.06


def test_first_tables_seat_everyone():
    random = np.random.default_rng(1)
    for c in (2000, 10**9):
        tables = pitman_yor.first_tables(c, 5.0, 0.6, random)
        assert sum(tables) == c and min(tables) >= 1


def test_lm_base_scores(docs):
    got = pitman_yor.score(docs, lexicon=3, shards=2, burn_in=1, samples=2).collect()
    rows = small(docs)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    c = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t, *_ in rows)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_probabilities_sum_to_one(spark):
    """Over every word that training has, and one that it hasn't, after a known and an unknown context."""
    training = ["a b a b c", "a c", "b a d e f g", "a b", "h i a b"]
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 10]
    rows = [(i, t) for i, t in zip(ids, training, strict=False)]
    held = [i for i in range(400) if not zlib.crc32(str(i).encode()) % 10]
    words = ["a", "b", "c", "d", "e", "f", "g", "h", "i", "new"]
    asked = [f"{u} {w}" for u in ("a", "zzz") for w in words] + ["a", "zzz"]
    docs = spark.createDataFrame([*rows, *zip(held, asked, strict=False)], "doc_id long, text string")
    score = {r.doc_id: 10**r.score for r in pitman_yor.score(docs, lexicon=4, shards=2).collect()}
    of = dict(zip(asked, (score[i] for i in held), strict=False))
    # a text's probability is P(u) P(w | u) P(end | w): the end's share is taken from the texts of w alone
    ends = {r.text: r.p for r in _end_shares(spark, rows, words)}
    for u in ("a", "zzz"):
        first = of[u] / ends[u]
        assert math.isclose(sum(of[f"{u} {w}"] / first / ends[w] for w in words) + ends[u], 1, rel_tol=1e-6)


def _end_shares(spark, rows, words):
    """P(end | w), from texts of one word against those of the word alone as a beginning: P(w end) / P(w)."""
    held = [i for i in range(4000) if not zlib.crc32(str(i).encode()) % 10]
    # P(w w') summed over everything else isn't needed: P(w end) and P(w) = P(w end) / P(end | w) differ by a third text
    asked = [w for w in [*words, "zzz"]] + [f"{w} {w} {w}" for w in [*words, "zzz"]] + [f"{w} {w}" for w in [*words, "zzz"]]
    docs = spark.createDataFrame([*rows, *zip(held, asked, strict=False)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in pitman_yor.score(docs, lexicon=4, shards=2).collect()}
    of = dict(zip(asked, (score[i] for i in held), strict=False))
    out = []
    for w in [*words, "zzz"]:
        again = 10 ** (of[f"{w} {w} {w}"] - of[f"{w} {w}"])  # P(w | w)
        first = 10 ** of[f"{w} {w}"] / again  # P(w) P(end | w)
        assert math.isclose(first, 10 ** of[w], rel_tol=1e-9)
        out.append(type("Row", (), {"text": w, "p": None, "both": first})())
    # P(end | w) itself: the model gives it as the only factor of the empty text after w; take it from the operator's parts
    seated = _model(docs)
    for r in out:
        r.p = seated(r.text)
    return out


def _model(docs):
    """P(end | word) read from the restaurants that ``score`` seats."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 10 == 0).alias("held_out"))
    known = pitman_yor.word_counts(docs)
    first = known.filter("word <> ''").orderBy(F.desc("c"), "word").limit(4).collect()
    ids = {b"": 0} | {w.encode(): 2 + k for k, (w, _) in enumerate(first)}
    counts = np.array([known.filter("word = ''").first().c, 0, *(c for _, c in first)], np.int64)
    passages = pitman_yor._passages(docs, spark.sparkContext.broadcast((ids, counts)), 2)
    restaurants = pitman_yor.store(pitman_yor._restaurants(passages, spark), "test_restaurants")
    every = np.concatenate([np.frombuffer(pitman_yor.zstandard.decompress(r.c), "<u8") for r in restaurants.collect()])
    discount = pitman_yor.discount_of((every == 1).sum(), (every == 2).sum())
    seated, roots = pitman_yor._seated(restaurants, len(counts), discount, 1.0, 2, 3, 1)
    tables = {}
    for r in seated.collect():
        pair, c = np.cumsum(pitman_yor._unpack(r.pairs)), np.frombuffer(pitman_yor.zstandard.decompress(r.c), "<u8").astype(np.int64)
        seen, contexts, left = pitman_yor._predictive(pair, c, [pitman_yor._unpack(s) for s in r.samples], roots, discount, 1.0)
        for k, u in enumerate(contexts.tolist()):
            row = np.array([(left[:, k] * roots[:, w]).mean() for w in range(len(counts))])
            row[pair[pair >> 16 == u] & 0xFFFF] = 10 ** seen[pair >> 16 == u]
            tables[u] = row
            assert math.isclose(row.sum(), 1, rel_tol=1e-9)  # over all classes
    return lambda w: tables.get(ids.get(w.encode(), 1), roots.mean(axis=0))[0]


def test_lm_scores_unseen_texts_better_than_single_words(spark, sf):
    rows = [r for r in queries.op11_lm_scores(spark, sf).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)


def test_lm_nothing(docs):
    assert pitman_yor.score(docs.limit(0)).count() == 0
    alone = docs.filter("doc_id IS NULL")
    row = pitman_yor.score(alone).first()
    assert (row.held_out, row.n_known, row.train_tokens, row.base_score) == (True, 0, 0, 0.0) and row.score < 0


# 12. Divergence ----------------------------------------------------------------------------------


def audited(rows, least, top):
    counts, kept, groups = defaultdict(Counter), defaultdict(Counter), set()
    df = defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        counts[lang, source].update(found)
        df[lang].update(set(found))
    for (lang, _), c in counts.items():
        for w, n in c.items():
            if df[lang][w] >= least:
                kept[lang][w] += n
    out = []
    for lang, source in groups:
        own = kept[lang]
        p = lambda c, own=own: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in own) + 5 * len(own)) for w in own}
        mine, whole = p(counts[lang, source]), p(own)
        pairs = [(-sum(abs(mine[w] - theirs[w]) for w in own), other.encode()) for la, other in groups if la == lang and other != source for theirs in [p(counts[lang, other])]]
        terms = [(whole[w] - mine[w], w.encode()) for w in own if counts[lang, source][w] and mine[w] > whole[w]]
        out += [(lang, source, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(sorted(found), 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize(("groups", "terms"), [(16, 1 << 15), (1, 2), (2, 3)])
def test_divergence(docs, groups, terms):
    got = divergence.audit(docs, least_docs=2, top=3, groups=groups, segment_terms=terms)
    assert sorted(map(tuple, got.collect())) == audited(small(docs), 2, 3)


def test_divergence_without_kept_terms(docs):
    got = sorted(map(tuple, divergence.audit(docs, least_docs=99).collect()))
    assert got == audited(small(docs), 99, 50) and {r[4] for r in got} == {0}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_probabilities_are_exact_for_large_counts():
    counts = [0, 1, 10**9, 9 * 10**12, 10**13]
    total, kept = sum(counts) + 10**14, 10**6
    assert divergence.probability(np.array(counts, np.int64), total, kept).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in counts]


def test_tournament_meets_each_pair_once(spark):
    for n in range(1, 9):
        met = spark.range(n).select(F.col("id").cast("int").alias("b")).select("b", F.explode(divergence._opponents(F.lit(n), F.col("b"))).alias("m")).select("b", "m.*").collect()
        assert sorted(tuple(sorted((r.b, r.host))) for r in met) == [(i, j) for i in range(n) for j in range(i + 1, n)]
        for k in {r.round for r in met}:
            places = [x for r in met if r.round == k for x in (r.b, r.host)]
            assert len(set(places)) == len(places)


# 13. Collocations --------------------------------------------------------------------------------


def mined(rows, least, cover, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        known = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        gone = {p[i : i + m] for p, a in known.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= cover * c[p[i : i + m]]}
        found = []
        for p, a in known.items():
            if p not in gone:
                score, _, left, rest = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, rest))
        out += [(lang, k, p.decode(), -a, left, rest, n[lang], -s) for k, (s, a, p, left, rest) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("few", [{}, {"broadcast_slots": 0, "shard_slots": 5}, {"shard_slots": 3, "bits": 8}])
def test_phrases(docs, few):
    got = phrases.mine(docs, least=3, cover=80, most=4, **few)
    assert sorted(map(tuple, got.collect())) == mined(small(docs), 3, 80, 4)


def test_phrases_of_nothing(docs):
    assert phrases.mine(docs.limit(0)).count() == 0 and phrases.mine(docs, least=10**6).count() == 0


def test_languages_apart_from_words(spark):
    """A language's name as a word of another language doesn't share counts with it."""
    docs = spark.createDataFrame([(1, "es es es en", "en"), (2, "en en en es", "es")], "doc_id long, text string, lang string")
    got = phrases.mine(docs, least=2, most=9)
    assert sorted(map(tuple, got.collect())) == mined([(r.doc_id, r.text, r.lang, None) for r in docs.collect()], 2, 80, 9)


def test_slots_are_minimal_and_perfect():
    random = np.random.default_rng(5)
    low, high = (np.unique(random.integers(0, 1 << 63, 5000, dtype=np.uint64)) for _ in range(2))
    n = min(len(low), len(high)) - 1000
    for keys in (low[:n], low[:1], low[:0]):
        slots = phrases.Slots.unpacked(phrases.Slots(keys, high[: len(keys)]).packed())
        assert sorted(slots.find(keys, high[: len(keys)]).tolist()) == list(range(len(keys)))
        assert (slots.find(low[n:], high[n : len(low)][: len(low) - n]) == -1).all()
        assert not len(keys) or (slots.find(keys, high[: len(keys)] + np.uint64(1)) == -1).all()


def test_registered_phrases_and_audit(spark, sf, same):
    same(queries.op12_divergence(spark, sf), queries.ORACLES["op12_divergence"])
    same(queries.op13_phrases(spark, sf), queries.ORACLES["op13_phrases"])
