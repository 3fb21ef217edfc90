"""Quality rules with cross-document line frequency, in Spark functions alone.

Base rules look at each text by itself: length, symbols, repeated lines, and words in
three-word windows that occur again.  Lines are then normalised (lower case, digits to
0, white space to one space) and hashed; a line held by more than ``limit`` documents of
one host is boilerplate there.  A document of which more than ``most_removed`` of the
words stand in such lines is depleted.

Shuffles carry hashes: one row for each distinct line of a document, counted before the
shuffle, so a line that a third of all rows hold is a row for each task.  Frequent lines
are stored; they join the documents' lines by broadcast up to ``BROADCAST_ROWS`` rows,
and else as two stored tables whose large partitions Spark splits.

Window repeats are found within the row: each window's hash and place share a long, the
longs are sorted, and neighbours with equal hashes and equal words are repeats.

Defined results: a null text has no words; a null host is one host; every row is a
document of its own, also among repeated rows; an empty table gives no rows; further
columns are ignored by ``judge`` and kept by ``cut``, which returns the texts without their
boilerplate lines and judges what is left of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm import common

#: Fixed values of the rules: what parts words, and what counts as a symbol.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "[#*$%&|<>]"
_TRIM = " \t\n\x0b\f\r"
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def normal(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), SPACE, " "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, whatever the optimiser does."""
    return F.transform(F.array(value), use)[0]


def _repeats(words: Column, shift: Column) -> Column:
    """Places of three-word windows found twice or more, ascending."""
    n = F.size(words)
    keyed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftright(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), 1).bitwiseAND(F.lit(-1) * shift).bitwiseOR(i.cast("long")))

    def found(s: Column) -> Column:
        at = lambda x: x.bitwiseAND(shift - 1).cast("int")
        head = lambda x: x.bitwiseAND(F.lit(-1) * shift)

        def same(x: Column, y: Column) -> Column:
            return (head(x) == head(y)) & (F.get(words, at(x)) == F.get(words, at(y))) & (F.get(words, at(x) + 1) == F.get(words, at(y) + 1)) & (F.get(words, at(x) + 2) == F.get(words, at(y) + 2))

        twice = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, at))

    return _let(F.sort_array(keyed), found)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``base_failed``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.withColumn("_words", words(text))
    n = F.size("_words")
    # The least power of two that is no less than n: places take the bits below it.
    shift = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(2))))).cast("long")
    step = step.withColumn("_places", F.when(n >= 4, _let(shift, lambda k: _let(F.col("_words"), lambda w: _repeats(w, k)))).otherwise(F.array().cast("array<int>")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    covered = _let(F.col("_places"), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x))
    step = step.select(
        *docs.columns, n.cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
    )
    return step.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _lines(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``host, line`` (its hash), ``n`` (its words, all of its occurrences in the document) for each distinct line of a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.transform(F.filter(F.transform(F.split(text, "\n"), normal), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).cast("long").alias("n")))
    rows = docs.select(*keep, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.col("source").isNull().alias("no_host"), hashed.alias("_lines"))
    return rows.select(*keep, "host", "no_host", "_lines")


def frequent_lines(docs: DataFrame, limit: int) -> DataFrame:
    """``host, no_host, line, docs`` of lines that more than ``limit`` documents of a host hold."""
    each = _lines(docs, []).select("host", "no_host", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["line"]))).alias("line"))
    return each.groupBy("host", "no_host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > limit)


def judge(docs: DataFrame, limit: int = 100, most_removed: float = 0.5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``n_removed`` (words in boilerplate lines) and ``kept`` for each row."""
    frequent = common.store(frequent_lines(docs, limit), "frequent_lines")
    few = frequent.limit(broadcast_rows + 1).count() <= broadcast_rows
    # Rows are told apart by id, text and host: equal ones have equal lines, so one of them stands for all.
    key = ["doc_id", "_text", "_host"]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", F.xxhash64("text").alias("_text"), F.xxhash64("source").alias("_host"))
    each = _lines(keyed, key).select(*key, "host", "no_host", F.posexplode("_lines").alias("place", "_line")).select(*key, "host", "no_host", "place", "_line.*")
    if few:
        held = each.join(F.broadcast(frequent.drop("docs")), ["host", "no_host", "line"])
    else:
        held = common.store(each, "document_lines").join(frequent.drop("docs"), ["host", "no_host", "line"])
    # A row's lines lie in one task before the shuffle, so this is partly summed there; repeated rows count once.
    removed = held.groupBy(*key, "place").agg(F.first("n").alias("n")).groupBy(*key).agg(F.sum("n").alias("n_removed"))
    removed = common.store(removed, "removed_words").select(F.col("doc_id").alias("_of"), F.col("_text").alias("_of_text"), F.col("_host").alias("_of_host"), "n_removed")
    base = measured(keyed).drop("text", "source")
    joined = base.join(removed, base.doc_id.eqNullSafe(removed._of) & (base._text == removed._of_text) & (base._host == removed._of_host), "left")
    n_removed = F.coalesce("n_removed", F.lit(0).cast("long"))
    kept = ~F.col("base_failed") & (n_removed <= F.lit(most_removed) * F.col("n_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", n_removed.alias("n_removed"), kept.alias("kept"))


def cut(docs: DataFrame, limit: int, most_removed: float = 0.5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without boilerplate lines in ``text``, ``n_removed`` (words cut) and ``kept``.

    All rows and columns stay, but for columns of the two names, which are replaced.
    ``kept``: what is left passes the base rules, and no more than ``most_removed`` of the words went.
    """
    columns = [c for c in docs.columns if c not in ("n_removed", "kept")]
    frequent = common.store(frequent_lines(docs, limit), "frequent_lines").drop("docs")
    few = frequent.limit(broadcast_rows + 1).count() <= broadcast_rows
    # Equal ids, texts and hosts have equal lines, so one row's places stand for all.
    key = {"_of": F.col("doc_id").cast("string"), "_of_text": F.sha1(F.col("text").cast("string")), "_of_host": F.sha1(F.col("source").cast("string"))}
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    hashed = F.transform(lines, lambda x: _let(normal(x), lambda y: F.when(y != "", F.struct(F.xxhash64(y).alias("line"), F.size(F.split(y, " ")).cast("long").alias("n")))))
    keyed = docs.select(*[k.alias(name) for name, k in key.items()], F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.col("source").isNull().alias("no_host"), hashed.alias("_lines"))
    each = keyed.select(*key, "host", "no_host", F.posexplode("_lines").alias("place", "_line")).filter("_line is not null").select(*key, "host", "no_host", "place", "_line.*")
    held = each.join(F.broadcast(frequent), ["host", "no_host", "line"]) if few else common.store(each, "document_lines").join(frequent, ["host", "no_host", "line"])
    gone = held.groupBy(*key, "place").agg(F.first("n").alias("n")).groupBy(*key).agg(F.collect_list("place").alias("_gone"), F.sum("n").alias("_removed"))
    gone = common.store(gone, "cut_lines").select(*[F.col(name).alias(f"_at{name}") for name in key], "_gone", "_removed")
    packed = docs.select(F.struct(*columns).alias("_row"), F.col("text").cast("string").alias("text"), *[k.alias(name) for name, k in key.items()])
    joined = packed.join(gone, [packed[name].eqNullSafe(gone[f"_at{name}"]) for name in key], "left")
    left = _let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_gone"), lambda i: F.get(x, i)), "\n"))
    texts = joined.select("_row", F.when(F.col("_gone").isNotNull(), left).otherwise(F.col("text")).alias("text"), F.coalesce("_removed", F.lit(0).cast("long")).alias("_removed"))
    kept = ~F.col("base_failed") & (F.col("_removed") <= F.lit(most_removed) * (F.col("n_words") + F.col("_removed")))
    return measured(texts).select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns], F.col("_removed").alias("n_removed"), kept.alias("kept"))
