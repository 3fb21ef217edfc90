"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import bpe, common, decontam, divergence, html_diff, line_rules, neardup, phrases, pii, pitman_yor, quality, token_shards, toxicity, warc
from foliate.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids written as Re-Pair shards and read back."""
    path = common.new_path(spark, "token_shards")
    token_shards.write_shards(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), path, end_id=1)
    return token_shards.read_shards(spark, path, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), "ids_crc32 long")


_DECIMAL = [str(k) for k in range(1 << 16)]


def _bpe_digests(ids: np.ndarray, decoded: str) -> tuple:
    return len(ids), hashlib.sha256(",".join(map(_DECIMAL.__getitem__, ids.tolist())).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores by compression distance."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("windows")


def op3_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speculate-and-verify BPE, there and back."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _bpe_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return pii.replace(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities", "entities")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores by a network on random-indexing vectors."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A line of three documents of one host is boilerplate there: copied lines and passages are spread over hosts (at sf0.1, in
#: 10,000 documents, none stands in more than 66 of a host, and passages of over 50 words in 5 at most). Of the 845
#: lines that it finds there, 21 have over 50 words and 192 have three or fewer, which carry few words.
LINE_LIMIT, MOST_REMOVED = 2, 0.5


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality rules and cross-document line frequency."""
    return line_rules.judge(table(spark, sf_dir, "documents"), LINE_LIMIT, MOST_REMOVED)


def op6_lines_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines above the limit, and the verdict on what is left."""
    return line_rules.cut(table(spark, sf_dir, "documents"), LINE_LIMIT, MOST_REMOVED)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of pages."""
    return html_diff.extract(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents."""
    found = decontam.find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate(F.expr("transform(spans, (x, i) -> if(i % 2 = 0, -x, x))"), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated")
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups at a Jaccard similarity of 0.75 on five-word shingles."""
    return neardup.group(table(spark, sf_dir, "documents"), percent=75)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives with revisit records, and read back."""
    path = common.new_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path, least=1000)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under a hierarchical Pitman-Yor model."""
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source against the others of its language, and its leading terms."""
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of each language by minimal perfect hashing."""
    return phrases.mine(table(spark, sf_dir, "documents"), least=30, cover=80, most=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_toxicity": op2_toxicity,
    "op3_speculative_bpe": op3_speculative_bpe,
    "op4_surrogates": op4_surrogates,
    "op5_quality": op5_quality,
    "op6_line_rules": op6_line_rules,
    "op6_lines_cut": op6_lines_cut,
    "op7_html_extraction": op7_html_extraction,
    "op8_decontamination": op8_decontamination,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_lm_scores": op11_lm_scores,
    "op12_divergence": op12_divergence,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {
    "op6_line_rules": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, source IS NULL AS no_host, coalesce(text, '') AS t FROM documents
        ), w AS (
            SELECT r, unnest(x) AS word, generate_subscripts(x, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS x FROM d)
        ), base AS (
            SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY r
        ), three AS (
            SELECT r, i, (word, lead(word) OVER p, lead(word, 2) OVER p)::VARCHAR AS win, lead(word, 2) OVER p AS last FROM w WINDOW p AS (PARTITION BY r ORDER BY i)
        ), again AS (
            SELECT r, i FROM three WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, win) > 1
        ), rep AS (
            SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY r
        ), raw AS (
            SELECT r, unnest(string_split(t, chr(10))) AS line FROM d
        ), dup AS (
            SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
        ), norm AS (
            SELECT r, trim(regexp_replace(regexp_replace(lower(line), '[1-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw
        ), lines AS (
            SELECT r, host, no_host, line, len(string_split(line, ' ')) AS n FROM norm JOIN d USING (r) WHERE line <> ''
        ), often AS (
            SELECT host, no_host, line FROM lines GROUP BY ALL HAVING count(DISTINCT r) > {LINE_LIMIT}
        ), gone AS (
            SELECT r, sum(n)::BIGINT AS n_removed FROM lines SEMI JOIN often USING (host, no_host, line) GROUP BY r
        ), m AS (
            SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed, 0) AS n_removed
            FROM d LEFT JOIN base USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)
        )
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed <= {MOST_REMOVED} * n_words AS kept
        FROM m
    """,
    "op10_warc_revisits": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), o AS (
            SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
               CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN original <> page_id THEN original END AS refers_to
        FROM p LEFT JOIN o USING (payload_digest)
    """,
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), w AS (
            SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), kept AS (
            SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), v AS (
            SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
        ), own AS (
            SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), total AS (
            SELECT lang, source, sum(n)::HUGEINT AS total FROM own GROUP BY ALL
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 5)) // (coalesce(total.total, 0) + 5 * v.v) AS p,
                   1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS q
            FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
        ), f AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pair AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        ), both_parts AS (
            SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
        )
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts
        QUALIFY part = 'pair' OR rank <= 50
    """,
    "op13_phrases": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), p AS (
            SELECT r, lang, unnest(x) AS piece, generate_subscripts(x, 1) AS p FROM (SELECT r, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS x FROM d)
        ), w AS (
            SELECT r, lang, p, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT r, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS x FROM p)
        ), g AS (
            SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY r, p ORDER BY i)
        ), f AS (
            SELECT lang, phrase, count(*) AS a FROM (
                SELECT lang, w1 AS phrase FROM g UNION ALL SELECT lang, w1 || ' ' || w2 FROM g WHERE w2 IS NOT NULL
                UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 FROM g WHERE w3 IS NOT NULL
                UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM g WHERE w4 IS NOT NULL
            ) GROUP BY ALL HAVING count(*) >= 30
        ), n AS (
            SELECT lang, count(*) AS n FROM w GROUP BY lang
        ), c AS (
            SELECT lang, phrase, a, string_split(phrase, ' ') AS x FROM f WHERE contains(phrase, ' ')
        ), cut AS (
            SELECT lang, phrase, a, x, unnest(range(1, len(x))) AS k FROM c
        ), scored AS (
            SELECT cut.lang, cut.phrase, cut.a, k, f.a AS l, g.a AS r, ((2000000::HUGEINT * cut.a) // (f.a + g.a))::BIGINT AS score
            FROM cut JOIN f ON f.lang = cut.lang AND f.phrase = array_to_string(x[1:k], ' ') JOIN f g ON g.lang = cut.lang AND g.phrase = array_to_string(x[k + 1:], ' ')
        ), best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inside AS (
            SELECT lang, a, array_to_string(x[i:i + m - 1], ' ') AS phrase
            FROM (SELECT lang, a, x, m, unnest(range(1, len(x) - m + 2)) AS i FROM (SELECT lang, a, x, unnest(range(2, len(x))) AS m FROM c))
        ), gone AS (
            SELECT DISTINCT inside.lang, inside.phrase FROM inside JOIN f USING (lang, phrase) WHERE 100::HUGEINT * inside.a >= 80::HUGEINT * f.a
        )
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN gone USING (lang, phrase)) JOIN n USING (lang)
        WHERE rank <= 2000
    """,
}
