"""Cursor-paged collections: there and back, contract errors, a chain that grows, pruned collections."""

import json

import pytest
from pyspark.sql import functions as F

from foliate.sources import cursors


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    cursors.register(spark)


def write(root, collection, cursor, page):
    folder = root / "messages" / f"collection={collection}" / f"cursor={cursor}"
    folder.mkdir(parents=True)
    (folder / "part.json").write_text(page if isinstance(page, str) else json.dumps(page))


def read(spark, root):
    return spark.read.format("cursors").option("entity", "messages").option("partitions", "2").load(str(root))


def item(k):
    return {"turn": k, "role": "user", "text": f"t{k}\n\"é\""}


def test_pages_in_order_with_odd_items(spark, tmp_path):
    write(tmp_path, "a b", "start", {"results": [item(0), {"turn": "x", "more": [1]}, None, 7], "has_more": True, "next_cursor": "c/1"} | {})
    (tmp_path / "messages/collection=a b/cursor=start/_SUCCESS").touch()
    write(tmp_path, "a b", "c", {"results": [], "has_more": False})
    with pytest.raises(Exception, match="no page at cursor c/1"):
        read(spark, tmp_path).collect()
    write(tmp_path, "b", "start", {"results": [item(1)], "has_more": False, "next_cursor": "left"})
    rows = read(spark, tmp_path).filter(F.col("collection") == "b").collect()
    assert [(r.page_no, r.place, r.turn, r.role, r.text, json.loads(r.item)) for r in rows] == [(0, 0, 1, "user", 't1\n"é"', item(1))]


@pytest.mark.parametrize(("page", "error"), [({"has_more": False}, "without results"), ({"results": [], "has_more": True}, "no cursor"), ({"results": [], "has_more": True, "next_cursor": "start"}, "comes again")])
def test_contract(spark, tmp_path, page, error):
    write(tmp_path, "a", "start", page)
    write(tmp_path, "good", "start", {"results": [item(0)], "has_more": False})
    with pytest.raises(Exception, match=error):
        read(spark, tmp_path).collect()
    assert read(spark, tmp_path).filter("collection = 'good'").count() == 1  # the others aren't read


def test_filters_reach_the_source(spark, tmp_path):
    for name in "abc":
        write(tmp_path, name, "start", {"results": [item(0)], "has_more": False})
    some = read(spark, tmp_path).filter("collection IN ('a', 'b') AND collection = 'b' AND turn = 0")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "collection" not in plan.split("Filter", 1)[1].split("\n", 1)[0]
    assert [r.collection for r in some.collect()] == ["b"]


def test_a_stream_goes_on_at_its_cursor(spark, tmp_path):
    write(tmp_path, "a", "start", {"results": [item(0), item(1)], "has_more": True, "next_cursor": "c1"})

    def run():
        rows = spark.readStream.format("cursors").option("entity", "messages").load(str(tmp_path))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return [(r.collection, r.page_no, r.turn) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("collection", "page_no", "place").collect()]

    assert run() == [("a", 0, 0), ("a", 0, 1)]
    assert run() == [("a", 0, 0), ("a", 0, 1)]
    write(tmp_path, "a", "c1", {"results": [item(2)], "has_more": False})
    write(tmp_path, "b", "start", {"results": [item(3)], "has_more": False})
    assert run() == [("a", 0, 0), ("a", 0, 1), ("a", 1, 2), ("b", 0, 3)]


def test_export_and_read(spark, tmp_path):
    rows = [("x=y/z", k, k, None if k == 3 else "r", f"t{k}") for k in range(7)] + [("é", 0, 0, "r", "")]
    df = spark.createDataFrame(rows, "collection string, place long, turn long, role string, text string")
    cursors.export(df, str(tmp_path), "messages", 3)
    got = read(spark, tmp_path).orderBy("collection", "page_no", "place").collect()
    assert [(r.collection, r.page_no * 3 + r.place, r.turn, r.role, r.text) for r in got] == rows
    with pytest.raises(Exception, match="entity must be one of"):
        spark.read.format("cursors").option("entity", "x").load(str(tmp_path))


def test_bundles_hold_many_pages(spark, tmp_path):
    """Two thousand collections make a few files; a filter leaves the other bundles unread; a stream reads new files alone."""
    df = spark.range(6000).selectExpr("cast(id % 2000 AS string) AS collection", "id div 2000 AS place", "id AS turn", "'r' AS role", "concat('t', id) AS text")
    cursors.export(df, str(tmp_path), "messages", 2)
    files = sorted((tmp_path / "messages").glob("bundle=*/part-*"))
    assert 0 < len(files) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {(str(k % 2000), k // 4000, k // 2000 % 2, k) for k in range(6000)}
    assert {(r.collection, r.page_no, r.place, r.turn) for r in read(spark, tmp_path).collect()} == want
    some = read(spark, tmp_path).filter("collection IN ('7', '8')")
    for f in files:
        if not any(f'"collection":"{k}"' in f.read_text() for k in (7, 8)):
            f.write_text("broken\n")
            (f.parent / f".{f.name}.crc").unlink()
    assert {r.turn for r in some.collect()} == {7, 8, 2007, 2008, 4007, 4008}

    def run():
        rows = spark.readStream.format("cursors").option("entity", "messages").load(f"{tmp_path}/grown")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted((r.collection, r.page_no, r.turn) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    line = lambda number, cursor, k, after: json.dumps({"collection": "a", "page_no": number, "cursor": cursor, "page": {"results": [item(k)], "has_more": bool(after), "next_cursor": after}}) + "\n"
    folder = tmp_path / "grown/messages/bundle=0-of-1"
    folder.mkdir(parents=True)
    (folder / "part-1.txt").write_text(line(0, "start", 0, "x"))
    assert run() == [("a", 0, 0)]
    (folder / "part-2.txt").write_text(line(1, "x", 1, None))
    assert run() == run() == [("a", 0, 0), ("a", 1, 1)]
    assert sorted(r.turn for r in read(spark, tmp_path / "grown").collect()) == [0, 1]


@pytest.mark.parametrize(("lines", "error"), [
    ([(0, "start", "x")], "no page at cursor x"), ([(0, "start", "x"), (1, "y", None)], "no page at cursor x"), ([(0, "start", "start")], "comes again"),
    ([(0, "start", None), (0, "start", None)], "comes again"), ([(1, "x", None)], "no page at cursor start"),
])
def test_contract_in_bundles(spark, tmp_path, lines, error):
    folder = tmp_path / "messages/bundle=0-of-1"
    folder.mkdir(parents=True)
    made = [{"collection": "a", "page_no": n, "cursor": c, "page": {"results": [], "has_more": bool(after), "next_cursor": after}} for n, c, after in lines]
    (folder / "part.txt").write_text("".join(json.dumps(x) + "\n" for x in made))
    with pytest.raises(Exception, match=error):
        read(spark, tmp_path).collect()
