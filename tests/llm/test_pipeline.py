"""Each stage of the pipeline on odd rows: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

NAMES = ["lang", "source", "n_chars", "digest", "spans", "n_words", "items", "number", "label", "features", "quality_score", "ids", "n_tokens", "entities", "__pii_row", "key", "row", "top", "component_id", "_id", "text_"]
PROSE = "The committee met on Monday to read the long report about water and roads in the northern valley and agreed to print it"
ITEM = "which of these seven rivers reaches the sea first after the snow melts in spring every year"
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, PROSE), (5, PROSE), (6, PROSE), (7, PROSE + " today"), (8, (PROSE + ". ") * 900), (None, PROSE + " without any id at all here now"), (None, None),
    (9, f"{PROSE} {ITEM} {PROSE[::-1]}"), (10, ITEM), (11, "Write to Mr. John Smith, john@smith.example, or +44 20 7946 0958; Smith answers."), (11, "Write to Mr. John Smith, john@smith.example, or +44 20 7946 0958; Smith answers."), (12, "日本語 📝 é \x02 <|endoftext|>"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 13)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="module")
def docs(spark):
    kind = "doc_id long, text string, " + ", ".join(f"`{n}` {'long' if n == 'n_chars' else 'string'}" for n in NAMES)
    return spark.createDataFrame([(i, t, *(len(t or "") if n == "n_chars" else n for n in NAMES)) for i, t in ROWS], kind)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables_and_columns(spark, docs, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs.limit(0), tables)
    assert out.count() == 0
    if name != "encoding":
        assert out.columns == docs.columns
        rows = stage(spark, docs, tables).collect()
        assert rows and all(r[n] == n for r in rows for n in NAMES if n != "n_chars")
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None and name in ("decontamination", "surrogates"))


def test_quality_stage(spark, docs, tables):
    kept = texts(corpus_pipeline.quality_stage(spark, docs, tables))
    assert set(kept) <= set(texts(docs)) and kept.count((5, PROSE)) in (0, 2)


def test_near_duplicate_stage(spark, docs, tables):
    kept = texts(corpus_pipeline.near_duplicate_stage(spark, docs, tables))
    for row in [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, None), (10, ITEM)]:
        assert row in kept
    assert (6, PROSE) not in kept and (7, PROSE + " today") not in kept
    assert kept.count((11, ROWS[-2][1])) == 2


def test_decontamination_stage(spark, docs, tables):
    kept = dict(texts(corpus_pipeline.decontamination_stage(spark, docs, tables)))
    assert 10 not in kept and ITEM not in kept[9] and kept[9].startswith(PROSE) and kept[9].endswith(PROSE[::-1])
    assert kept[1] is None and kept[2] == "" and kept[8] == (PROSE + ". ") * 900 and kept[11] == ROWS[-2][1]


def test_surrogate_stage(spark, docs, tables):
    out = texts(corpus_pipeline.surrogate_stage(spark, docs, tables))
    assert len(out) == len(ROWS)
    mine = [t for i, t in out if i == 11]
    assert mine[0] == mine[1] and not any(x in mine[0] for x in ("John", "Smith", "john@smith", "7946 0958"))
    assert [r for r in out if r[0] != 11] == [r for r in texts(docs) if r[0] != 11]


def test_encoding_stage(spark, docs, tables):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.no_truncation(), plain.no_padding()
    got = sorted(((r.doc_id, list(r.ids), r.n_tokens) for r in corpus_pipeline.encoding_stage(spark, docs, tables).collect()), key=repr)
    want = [(i, plain.encode(t or "", add_special_tokens=False).ids) for i, t in ROWS]
    assert got == sorted(((i, ids, len(ids)) for i, ids in want), key=repr)
