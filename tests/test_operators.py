"""Operators over small rows that the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from foliate.functions import destinations, markdown, markup, names, props, texts, urls
from foliate.operators import diff, match, pages, tree
from foliate.sources.tables import Snapshots


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("title", "want"), [("a/b:c", "a-b-c"), ("  x. . ", "x"), ("..", "Untitled--12345678"), ("", "Untitled--12345678"), ("CON", "_CON"), ("com1.txt", "_com1.txt"), ("console", "console"), ("é", "é"), ("t" * 201, "t" * 190 + "--12345678"), ("a\x07b", "a-b"), ("日本 📝", "日本 📝")])
def test_segment(spark, title, want):
    assert one(spark, title, lambda x: names.segment(x, F.lit("1234-5678-9"), composed=False)) == want


def test_relative_and_root(spark):
    assert one(spark, "a/b/c.md", lambda x: names.relative(x, F.lit("a/d/e.png"))) == "../d/e.png"
    assert one(spark, "c.md", lambda x: names.relative(x, F.lit("d.png"))) == "d.png"
    assert [one(spark, p, names.within_root) for p in ("a/../b", "../b", "a/../../b", "/a", "")] == [True, False, False, False, True]


def test_urls(spark):
    assert one(spark, "HTTPS://H.example:443/A?x#y", lambda x: urls.stable(x, F.lit("notion"))) == "https://h.example/A"
    assert one(spark, "https://h/x?y", lambda x: urls.stable(x, F.lit("external"))) == "https://h/x?y"
    assert [one(spark, ip, urls.blocked_v4) for ip in ("8.8.8.8", "172.32.0.1", "172.31.0.1", "224.0.0.1", "01.2.3.400", "192.0.1.1")] == [False, False, True, True, True, False]


def test_redaction(spark):
    assert one(spark, "see https://h.example/a?s=1), Bearer abc; /etc/x", texts.redact_failure) == "see https://h.example/a?[REDACTED]), Bearer [REDACTED]; [REDACTED_PATH]"


def test_cells(spark):
    assert one(spark, "a|b\\|c\\\\|d", texts.escape_cell) == "a\\|b\\|c\\\\\\|d"


@pytest.mark.parametrize(("prop", "want"), [
    ('{"type":"title","title":[{"plain_text":"A"},{"text":{"content":"b\\"c"}}]}', '"Ab\\"c"'),
    ('{"type":"title","title":{}}', '{"type":"title","raw":{"type":"title","title":{}}}'),
    ('{"type":"number","number":1.5}', "1.5"), ('{"type":"number"}', '{"type":"number","raw":{"type":"number"}}'),
    ('{"type":"status","status":{"name":"x"}}', '"x"'), ('{"type":"select","select":null}', "null"),
    ('{"type":"rollup","rollup":{"type":"date","date":{"start":"s"}}}', '{"value":"s","raw":{"type":"date","date":{"start":"s"}}}'),
    ('{"type":"relation","relation":[{"id":"1"}],"has_more":true}', '{"value":["1"],"raw":[{"id":"1"}],"hasMore":true}'),
    ('{"type":"last_edited_by","last_edited_by":{"id":"u"}}', '{"id":"u"}'), ('{"type":"files","files":[{"name":"n","type":"file","file":{"url":"u"}}]}', '[{"name":"n","url":"u"}]'),
    ('{"type":"future","future":1}', '{"type":"future","raw":{"type":"future","future":1}}'), ("{}", '{"type":"unknown","raw":{}}'),
])
def test_properties(spark, prop, want):
    assert one(spark, prop, props.convert) == want


def test_filenames_reuse_stored_names(spark):
    rows = spark.createDataFrame([("a", None, "Memo"), ("b", None, "memo"), ("c", "a", "Memo"), ("d", None, "MEMO")], "id string, parent_id string, title string")
    before = spark.createDataFrame([("b", "memo"), ("d", "other")], "id string, stored string")
    assert {r.id: r.filename for r in tree.filenames(rows, before).collect()} == {"a": "Memo--a", "b": "memo", "c": "Memo", "d": "MEMO--d"}
    assert {r.id: r.filename for r in tree.filenames(rows).collect()} == {"a": "Memo", "b": "memo--b", "c": "Memo", "d": "MEMO--d"}


def test_a_second_run_does_nothing(spark):
    """Idempotence: the same input twice gives no actions."""
    current = spark.createDataFrame([("1", "t", "p.md", "h")], "id string, title string, expected_path string, content_hash string")
    stored = current.withColumnRenamed("expected_path", "local_path")
    assert [r.action for r in diff.reconcile(current, stored.limit(0)).collect()] == ["CREATE"]
    assert [r.action for r in diff.reconcile(current, stored).collect()] == ["UNCHANGED"]


def test_grace_over_runs(spark):
    """Unseen twice: counted, then trashed; a partial census changes nothing."""
    stored = spark.createDataFrame([("1", "R", "active", 0), ("2", "R", "active", 1), ("3", "R", "tombstoned", 5)], "id string, root_id string, status string, missing_count int")
    seen = spark.createDataFrame([], "id string, in_trash boolean")
    none = seen.select("id")
    whole = spark.createDataFrame([("R",)], "root_id string")
    first = {r.id: (r.missing_count, r.to_trash) for r in diff.missing(stored, seen, none, whole).collect()}
    assert first == {"1": (1, False), "2": (2, True)}
    assert diff.missing(stored, seen, none, whole.limit(0)).count() == 0
    assert diff.missing(stored, seen, none, whole, mode="page").count() == 0
    back = spark.createDataFrame([("2", False)], "id string, in_trash boolean")
    assert {r.id: r.missing_count for r in diff.missing(stored, back, none, whole).collect()} == {"1": 1, "2": 0}


def test_limits(spark):
    row = spark.range(1).select(*(diff.trash_limits(t, m).alias(f"c{k}") for k, (t, m) in enumerate([(0, 0), (1, 0), (2, 10), (3, 10), (51, 10_000)]))).first()
    assert list(row) == [False, True, False, True, True]


def test_violations_stop_a_run(spark):
    plan = spark.createDataFrame([("TRASH", "1", "a.md", None, None, True)], "kind string, id string, source_path string, target_path string, target_state string, managed boolean")
    diff.raise_on(diff.violations(plan, True, 100))
    with pytest.raises(ValueError, match="partial_trash"):
        diff.raise_on(diff.violations(plan, False, 100))


def test_cycles_and_reach(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "c"), ("c", "b"), ("d", "gone")], "id string, parent_id string")
    assert {r.id for r in tree.descend(nodes).collect()} == {"r", "a"}
    ask = spark.createDataFrame([(x,) for x in "rabd"], "id string")
    assert {r.id: r.reachability for r in tree.reach(ask, nodes, "r").collect()} == {"r": "inside", "a": "inside", "b": "unknown", "d": "unknown"}


def in_order(assets, blocks):
    """One page, step by step: the plain reading of what ``match.match`` streams."""
    free, by_url, out = list(blocks), {}, []
    for a in assets:
        steps = [("url_path", a["url_key"], lambda b, a=a: b["url_key"] == a["url_key"]), ("filename", a["name_key"], lambda b, a=a: b["name_key"] == a["name_key"]), ("position_caption", True, lambda b, a=a: (b["kind"], b["occurrence"], b["caption"]) == (a["kind"], a["occurrence"], a["caption"]))]
        row = ("unmatched", None, None)
        if a["url_key"] and a["url"] in by_url:
            row, steps = ("matched", by_url[a["url"]], "url_path"), []
        for name, present, test in steps:
            found = [b for b in free if test(b)] if present else []
            if len(found) == 1:
                free.remove(found[0])
                row = ("matched", found[0]["block"], name)
                if name == "url_path":
                    by_url[a["url"]] = found[0]["block"]
            elif found:
                row = ("ambiguous", None, name)
            if found:
                break
        out.append((a["place"], *row))
    return out


def test_match_in_order(spark):
    import random

    draw = random.Random(4)
    kind = "page string, place long, url string, url_key string, name_key string, kind string, occurrence long, caption string"
    assets, blocks, want = [], [], []
    for page in range(30):
        one = lambda k, page=page: {"page": f"p{page}", "place": k, "url": f"https://h/{draw.randint(0, 4)}?{draw.randint(0, 1)}", "url_key": draw.choice(["/1", "/2", "/3", None, ""]), "name_key": draw.choice(["a", "b", None]), "kind": draw.choice(["image", "file"]), "occurrence": draw.randint(0, 2), "caption": draw.choice(["", "c"])}
        mine, own = [one(k) for k in range(draw.randint(0, 12))], [one(k) | {"block": f"b{k}"} for k in range(draw.randint(0, 12))]
        assets += mine
        blocks += own
        want += [(f"p{page}", *r) for r in in_order(mine, own)]
    got = match.match(spark.createDataFrame(assets, kind), spark.createDataFrame(blocks, kind + ", block string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_long_chains(spark):
    """A chain of 20,000 nodes, a cycle and what hangs below it, a missing parent: fifteen rounds."""
    chain = spark.range(20_000).selectExpr("cast(id AS string) AS id", "CASE WHEN id > 0 THEN cast(id - 1 AS string) END AS parent_id")
    odd = spark.createDataFrame([("x", "y"), ("y", "x"), ("below", "x"), ("d", "gone"), ("e", "d"), ("self", "self")], "id string, parent_id string")
    got = {r.id: (r.top, r.depth, r.state) for r in tree.climb(chain.unionByName(odd)).collect()}
    assert all(got[str(k)] == ("0", k, "rooted") for k in range(20_000))
    assert {k: got[k][2] for k in ("x", "y", "below", "self", "d", "e")} == {"x": "cycle", "y": "cycle", "below": "cycle", "self": "cycle", "d": "missing", "e": "missing"}
    assert got["e"][:2] == ("gone", 2) and got["d"][:2] == ("gone", 1)


def test_cycles_hold_no_stems(spark, monkeypatch):
    """What is stored for a cycle and what hangs below it doesn't double from round to round."""
    sizes, kept = [], tree.store

    def measured(df, name):
        held = kept(df, name)
        sizes.append(held.agg(F.max(F.length("stem"))).first()[0])
        return held

    monkeypatch.setattr(tree, "store", measured)
    around = spark.range(2000).selectExpr("concat('n', id) AS id", "CASE WHEN id < 3 THEN concat('n', (id + 1) % 3) ELSE 'n0' END AS parent_id")
    rows = tree.climb(around.withColumn("label", F.lit("x" * 20)), "label").select("state", "stem").distinct().collect()
    assert [tuple(r) for r in rows] == [("cycle", None)]
    assert len(sizes) <= 5 and max(filter(None, sizes)) < 100


def test_runs_refuse(spark, tmp_path):
    """Too much trash, a partial census with trash, an unmanaged target, two pages at one path: nothing is written."""
    from foliate.streaming import runs

    kind = "id string, root_id string, title string, expected_path string, in_trash boolean"
    rows = [(str(k), "R" if k < 90 else "S", f"t{k}", f"{k}.md", False) for k in range(100)]
    census = lambda keep: spark.createDataFrame([r for r in rows if keep(int(r[0]))], kind)
    roots = lambda r, s: spark.createDataFrame([("R", r), ("S", s)], "root_id string, complete boolean")
    state = Snapshots(spark, str(tmp_path))
    read = lambda: {r.id: (r.status, r.missing_count) for r in state.read("resources").collect()}
    assert runs.apply_run(state, census(lambda k: True), 0, roots=roots(True, True))
    assert runs.apply_run(state, census(lambda k: k >= 30), 1, roots=roots(True, True))
    held = read()
    with pytest.raises(diff.Refused, match="too_much_trash"):
        runs.apply_run(state, census(lambda k: k >= 30), 2, roots=roots(True, True))
    assert read() == held and held["3"] == ("missing", 1)
    with pytest.raises(diff.Refused, match="partial_trash"):
        runs.apply_run(state, census(lambda k: k >= 5), 2, roots=roots(True, False))
    with pytest.raises(diff.Refused, match="unmanaged_write"):
        runs.apply_run(state, spark.createDataFrame([*rows, ("new", "R", "n", "n.md", False)], kind), 2, roots=roots(True, True), unmanaged=spark.createDataFrame([("n.md",)], "path string"))
    with pytest.raises(diff.Refused, match="shared_output"):
        runs.apply_run(state, spark.createDataFrame([*rows, ("n1", "R", "n", "n.md", False), ("n2", "R", "n", "N.md", False)], kind), 2, roots=roots(True, True))
    assert read() == held
    # a root that vanishes as a whole counts its pages missing; one that isn't configured any more removes them for that reason
    assert runs.apply_run(state, census(lambda k: k < 90), 2, roots=roots(True, True))
    assert read()["95"] == ("missing", 1) and read()["3"] == ("active", 0)
    only = spark.createDataFrame([("R", True)], "root_id string, complete boolean")
    assert runs.apply_run(state, census(lambda k: k < 90), 3, roots=only)
    assert read()["95"] == ("tombstoned", 2) and {r.reason for r in state.read("plan").collect()} == {"root_removed"}
    gone = spark.createDataFrame([("4", "moved_out_of_scope")], "id string, reason string")
    assert runs.apply_run(state, census(lambda k: k < 90), 4, roots=only, confirmed=gone)
    assert read()["4"][0] == "tombstoned" and [(r.id, r.reason) for r in state.read("plan").collect()] == [("4", "moved_out_of_scope")]


def test_markers_of_dead_writers(spark, tmp_path):
    """A writer that dies between marker and content blocks others for a while, not for good."""
    state = Snapshots(spark, str(tmp_path))
    state.commit({"t": spark.range(1)})
    (tmp_path / "done/2").touch()
    with pytest.raises(RuntimeError, match="run 2"):
        state.commit({"t": spark.range(2)})
    late = Snapshots(spark, str(tmp_path), patience=0)
    assert late.latest() == 1 and late.commit({"t": spark.range(3)}) == 3 and late.read("t").count() == 3


def test_snapshots_swap_whole_runs(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path))
    assert state.read("t") is None
    state.commit({"t": spark.range(3)})
    assert state.commit({"t": state.read("t").union(spark.range(1))}) == 2
    assert state.read("t").count() == 4 and state.latest() == 2


CALLOUT = '<callout type="warning">\nMind **this**\n</callout>'


def test_markdown_kernels():
    assert markup.enhanced(CALLOUT) == "> [!warning]\n> Mind **this**"
    assert markup.enhanced(f"```\n{CALLOUT}\n```") == f"```\n{CALLOUT}\n```"
    assert markup.enhanced("`<table><tr><td>x</td></tr></table>`") == "`<table><tr><td>x</td></tr></table>`"
    assert markup.enhanced('<table header-row="true"><tr><td>Fruit</td><td>Count</td></tr><tr><td>Apple</td><td>3</td></tr></table>') == "| Fruit | Count |\n| ----- | ----- |\n| Apple | 3     |"
    kept = "<table><tr><th>Raw</th></tr><tr><td>HTML table</td></tr></table>"
    assert markup.enhanced(kept) == kept
    assert markup.enhanced('<synced_block url="o">\n<synced_block url="i">\nInner block\n</synced_block>\n</synced_block>\n## Between blocks\n<synced_block url="s">\nSecond block\n</synced_block>\nAfter blocks\n') == "Inner block\n\n## Between blocks\n\nSecond block\n\nAfter blocks\n"
    assert markup.enhanced("<columns>\n<column>\nFirst\n</column>\n<column>\nSecond\n</column>\n</columns>") == "First\n\nSecond"
    assert markdown.columns("<columns>stray<column>x</column></columns>") == "<columns>stray<column>x</column></columns>"
    assert markdown.callouts("<callout>open") == "<callout>open"


def test_links():
    ident = "1" * 32
    paths = {ident: "Root/Memo.md", "3" * 32: "Other/Page.md"}
    text = f"[First](https://www.notion.so/{ident}) `https://www.notion.so/{ident}` [No](https://www.notion.so/{'4' * 32})\n| [a|b](https://notion.so/x-{ident}) |\n<mention-page url=\"https://www.notion.so/33333333-3333-3333-3333-333333333333\">Target</mention-page>"
    assert markdown.links(text, paths) == f"[[Root/Memo|First]] `https://www.notion.so/{ident}` [No](https://www.notion.so/{'4' * 32})\n| [[Root/Memo\\|a\\|b]] |\n[[Other/Page|Target]]"


def test_signed_urls():
    url = "https://prod-files-secure.s3.us-west-2.amazonaws.com/a/b.png?X-Amz-Signature=1&amp;X-Amz-Date=2"
    text, replaced, unsafe = destinations.signed_urls(f"![x]({url}) <{url}> bare {url} <img src=\"{url}\">")
    bare = url.split("?")[0]
    assert text == f"![x]({bare}) <{bare}> bare {url} <img src=\"{bare}\">" and replaced == 3 and unsafe == [url]


def test_empty_blocks():
    assert markdown.empty_blocks("<empty-block/>\na\n\n<empty-block/>\n\nb\n<empty-block/>") == "a\n\nb"
    assert markdown.empty_blocks("a\n\n\nb") == "a\n\n\nb"
    assert markdown.empty_blocks("a\r\n<empty-block/>\r\nb") == "a\r\n\r\nb"


def test_streamed_runs(spark, tmp_path):
    """Three census files, one batch each; the last is repeated and changes nothing."""
    from foliate.streaming import runs

    kind = "id string, root_id string, title string, expected_path string, in_trash boolean"
    rows = [("1", "R", "a", "a.md", False), ("2", "R", "b", "b.md", False)]
    for k, census in enumerate([rows, rows[:1], [("1", "R", "A", "A.md", False)]]):
        spark.createDataFrame(census, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    state = Snapshots(spark, f"{tmp_path}/state")
    for k in range(3):
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/{k}")
        runs.follow(stream, Snapshots(spark, f"{tmp_path}/one{k}"), f"{tmp_path}/cp{k}").awaitTermination()
        assert runs.apply_run(state, spark.read.parquet(f"{tmp_path}/in/{k}"), k, runs.Limits(allow_large=True))
    assert not runs.apply_run(state, spark.read.parquet(f"{tmp_path}/in/2"), 2)
    assert {r.id: (r.title, r.local_path, r.status, r.missing_count) for r in state.read("resources").collect()} == {"1": ("A", "A.md", "active", 0), "2": ("b", "b.md", "tombstoned", 2)}
    assert [tuple(r)[:5] for r in state.read("runs").orderBy("batch").select("n_create", "n_update", "n_move", "n_trash", "n_unchanged").collect()] == [(2, 0, 0, 0, 0), (0, 0, 0, 0, 1), (0, 0, 1, 1, 0)]
    assert Snapshots(spark, f"{tmp_path}/one0").read("resources").count() == 2


@pytest.mark.parametrize(("ip", "want"), [("2606:4700::1", False), ("::1", True), ("fe80::1%eth0", True), ("2001:db8::1", True), ("2001:1::1", False), ("2001:2::1", True), ("2002::1", True), ("::ffff:8.8.8.8", False), ("::ffff:10.0.0.1", True), ("8.8.4.4", False), ("x", True)])
def test_addresses(spark, ip, want):
    assert one(spark, ip, urls.blocked_address) is want


def test_settings(spark, tmp_path):
    from foliate.sources.config import Root, Settings, doctor

    good = Settings("/v", "/v/m", (Root("1", "One"),))
    assert good.problems() == [] and Settings("/v", "/v", (Root("1"), Root("1"))).problems() == ["duplicate root 1", "managed folder is unsafe"]
    assert good.digest() == Settings("/v", "/v/m", (Root("1", "One"),), log_level="debug").digest() != Settings("/v", "/v/m").digest()
    assert {r.name: r.ok for r in doctor(spark, good, str(tmp_path)).collect()} == {"python": True, "spark": True, "settings": True, "roots": True, "state": True}


def test_crawl_entities(spark, tmp_path):
    from foliate.sources import crawl

    (tmp_path / "markdown").mkdir()
    (tmp_path / "markdown/a.json").write_text('{"page_id":"1","markdown":"x","truncated":false,"unknown_block_ids":[]}\nnot json\n{"page_id":"2"}\n')
    rows = crawl.entity(spark, str(tmp_path), "markdown").cache()
    assert [r.page_id for r in rows.filter("_broken is null").orderBy("page_id").collect()] == ["1", "2"]
    assert [r._broken for r in crawl.broken(rows).collect()] == ["not json"]


def test_log_redaction(caplog):
    from foliate.sources import crawl

    logger = crawl.log("info", ["s3cret"])
    with caplog.at_level("INFO", logger="foliate"):
        logger.info("got %s from https://h/x?sig=1 now", "s3cret")
        logger.debug("hidden")
    assert [r.getMessage() for r in caplog.records] == ["got [REDACTED] from https://h/x?[REDACTED] now"]


def test_crossed_tags_stay():
    crossed = '<span color="red">a<u>b</span></u>\n\n<span color="red">c</span>'
    assert markup.enhanced(crossed) == '<span color="red">a<u>b</span></u>\n\n==c=='


def test_stabilised_json():
    url = "https://prod-files-secure.s3.amazonaws.com/a?Signature=1"
    value = {"a": [f"<{url}>", f"bare {url}"], "external": {"url": url, "n": 1}, "file": {"url": "https://h/x?y"}, "n": None}
    made, done, unsafe = props.stabilised(value)
    assert made == {"a": [f"<{url.split('?')[0]}>", f"bare {url}"], "external": {"url": url, "n": 1}, "file": {"url": "https://h/x"}, "n": None} and (done, unsafe) == (2, 1)


@pytest.mark.parametrize("broadcast_rows", [100_000, 5])
def test_links_to_more_targets_than_fit_a_limit(spark, broadcast_rows):
    """All of 12,000 targets are rewritten, wherever they are joined; code, unknown links, null texts and equal rows stay."""
    n = 12_000
    link = "concat('[t', i, '](https://www.notion.so/P-', md5(string(i)), ')')"
    rows = spark.range(n).withColumnRenamed("id", "i").selectExpr("i as id", f"concat({link}, ' `', {link}, '` [u](https://www.notion.so/P-', md5('none'), ')') as text")
    rows = rows.union(rows.filter("id = 1")).union(spark.createDataFrame([(-1, None), (None, "plain")], "id long, text string"))
    targets = spark.range(n).selectExpr("md5(string(id)) as target", "concat('Root/', id, '.md') as path")
    out = pages.linked(rows, targets, broadcast_rows).collect()
    want = rows.selectExpr("id", "if(id >= 0, concat('[[Root/', id, '|t', id, ']]', substr(text, instr(text, ' `'))), text) as text").collect()
    assert sorted(map(repr, out)) == sorted(map(repr, want)) and len(out) == n + 3


def test_paths_in_locale_order(spark):
    """Locale order sets small letters before their capitals and accents beside their letters; binary order doesn't."""
    want = ["a.md", "A.md", "ä.md", "b.md", "B.md", "e/x.md", "é/x.md", "z.md"]
    df = spark.createDataFrame([(str(k), p) for k, p in enumerate(sorted(want))], "id string, path string")
    assert [r.path for r in sorted(tree.ordered(df).collect(), key=lambda r: r.place)] == want != sorted(want)
    assert sorted(r.place for r in tree.ordered(df.union(df)).collect()) == list(range(1, 17)) and tree.ordered(df.limit(0)).count() == 0


def test_two_writers_of_one_run(spark, tmp_path):
    """The second writer that follows the same run fails and leaves the first one's tables as they are."""
    one, two = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    one.commit({"t": spark.range(1)})
    two.latest = lambda: None  # it looked before the first one finished
    with pytest.raises(Exception, match="exist"):
        two.commit({"t": spark.range(5)})
    assert one.read("t").count() == 1 and one.latest() == 1 and one.names() == ["t"] and one.read("u") is None


def test_migrations_go_on_where_they_stood(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path))
    state.commit({"t": spark.range(2)})

    def broken(tables):
        raise ValueError("stop")

    first = {1: lambda t: {"t": t["t"].selectExpr("id", "id + 1 AS more")}}
    with pytest.raises(ValueError, match="stop"):
        state.migrate(first | {2: broken})
    assert state.latest() == 2 and state.read("t").columns == ["id", "more"]
    assert state.migrate(first | {2: lambda t: {"u": t["t"].select("more")}}) == [2]
    assert state.migrate(first | {2: broken}) == [] and state.names() == ["schema_migrations", "t", "u"]


def test_fallbacks_that_are_taken(spark):
    """Another one's plan, another one's fallback (equal short ids) and a file block; the resource's own file doesn't."""
    planned = spark.createDataFrame([("1", "a.md"), ("2", "a.md"), ("3", "A--1.md"), ("123456789", "b.md"), ("12345678x", "b.md"), ("4", "c.md"), ("5", "c.md")], "id string, path string")
    stored = spark.createDataFrame([("1", "o1"), ("2", "o2"), ("123456789", "o3"), ("12345678x", "o4"), ("4", "o5"), ("5", "c--5.md")], "id string, local_path string")
    there = spark.createDataFrame([("c--4.md",), ("c--5.md",)], "path string")
    out = diff.blocked_fallbacks(diff.allocate(planned, stored, there), planned, stored, there)
    assert {r.id for r in out.collect()} == {"1", "123456789", "12345678x", "4"}


def test_block_trees(spark):
    """Against a walk of each tree: nested lists and paragraphs, headings with children, tables, ties, lost parents and cycles."""
    import random

    from foliate.operators import render

    draw = random.Random(8)
    rows = []
    for page in range(6):
        ids = []
        for k in range(40):
            kind = draw.choice(["bulleted_list_item", "numbered_list_item", "to_do", "paragraph", "paragraph", "heading_2", "quote", "divider", "code", "image", "odd", "table", "table_row"])
            parent = draw.choice([None, None, *ids]) if ids else None
            ids.append(f"{page}-{k}")
            rows.append((f"p{page}", ids[-1], parent, draw.randint(0, 3), kind, draw.choice(["a", "", "b\nc", None]), draw.random() < 0.5, "py", draw.choice([None, "https://x/i"]), draw.choice([None, 1, 2]), draw.random() < 0.5, draw.choice([None, ["x", "y|"], ["z", None], ["w"]]) if kind == "table_row" else None, "raw"))
    rows += [("p0", "lost", "nowhere", 0, "paragraph", "lost", *[None] * 7), ("p1", "c1", "c2", 0, "paragraph", "c", *[None] * 7), ("p1", "c2", "c1", 0, "paragraph", "c", *[None] * 7), ("empty", "e", None, 0, "paragraph", "", *[None] * 7)]
    below = {}
    for r in rows:
        below.setdefault((r[0], r[2]), []).append(r)

    def made(r):
        _, ident, _, _, kind, text, checked, language, url, width, header, _, _ = r
        kids = sorted(below.get((r[0], ident), []), key=lambda k: (k[3], k[1]))
        text = text or ""
        parts = [m for m in map(made, kids) if m]
        inner = "\n".join(parts)
        marks = {"bulleted_list_item": "- ", "numbered_list_item": "1. ", "to_do": f"- [{'x' if checked else ' '}] "}
        if kind in marks:
            return marks[kind] + text + ("\n" + "\n".join("  " + x for x in inner.split("\n")) if inner else "")
        if kind == "paragraph":
            return text + ("\n" + inner if inner else "")
        if kind == "table":
            if width and kids and all(k[4] == "table_row" and k[11] is not None and len(k[11]) == width and None not in k[11] for k in kids):
                cells = [[c.replace("|", "\\|") for c in k[11]] for k in kids]
                head, body = (cells[0], cells[1:]) if header else ([""] * width, cells)
                return "\n".join("| " + " | ".join(x) + " |" for x in [head, ["---"] * width, *body])
            return f"[Unsupported block: table]\n<!-- foliate: unsupported block type=table id={ident} -->"
        flat = {"heading_2": f"## {text}", "quote": "> " + text.replace("\n", "\n> "), "divider": "---", "code": f"```{language}\n{text}\n```", "table_row": ""}
        if kind == "image" and url:
            return f"![{text}]({url})"
        return flat.get(kind, f"[Unsupported block: {kind}]\n<!-- foliate: unsupported block type={kind} id={ident} -->")

    want = {p: "\n\n".join(m for r in sorted(below.get((p, None), []), key=lambda k: (k[3], k[1])) if (m := made(r))) for p in {r[0] for r in rows}}
    blocks = spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in render.FIELDS.items()))
    pages_, kept = render.render(blocks)
    assert {r.page: r.text for r in pages_.collect()} == want
    assert all(r.payload == "raw" and r.type in ("odd", "image", "table") for r in kept.collect())


def test_reach_broadcasts_nothing(spark):
    nodes = spark.range(3000).selectExpr("concat('n', id) AS id", "CASE WHEN id > 0 THEN concat('n', id div 10) END AS parent_id")
    found = tree.reach(nodes.select("id"), nodes, "n0")
    assert {tuple(r) for r in found.groupBy("reachability").count().collect()} == {("inside", 3000)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_search_gap_broadcasts_nothing(spark):
    asked, found = spark.range(20).select(F.col("id").cast("string")), spark.range(5, 50).select(F.col("id").cast("string"))
    left = tree.not_among(asked, found)
    assert sorted(r.id for r in left.collect()) == ["0", "1", "2", "3", "4"]
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()


def test_names_of_long_paths(spark):
    """The last part of a long path takes one pass; an ending before a line break isn't one."""
    import time

    long = "a" * 400_000
    df = spark.createDataFrame([(f"{long}/b.md", f"https://h/{long}/b//"), (f"{long}/", f"https://h/{long}"), ("x/y.md\n", "https://h//")], "p string, u string")
    start = time.monotonic()
    got = [tuple(r) for r in df.select(texts.wiki_link(F.col("p"), F.lit(" "), F.lit(False)), urls.file_name(F.col("u"))).collect()]
    assert got == [(f"[[{long}/b|b]]", "b"), (f"[[{long}/|{long}/]]", long), ("[[x/y.md\n|y.md ]]", None)]
    assert time.monotonic() - start < 30


@pytest.mark.parametrize("build", [pages.stabilised, lambda df: pages.rewrite(df, str.upper), lambda df: pages.rewrite(df, str.upper, "t"), lambda df: pages.with_local_assets(df, df.selectExpr("id AS page", "text AS url", "text AS path"))])
def test_pages_come_in_small_batches(spark, build):
    """A worker holds a batch, whatever the size of the table: at most 1,000 rows and 4 MB."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
    for key in keys:
        spark.conf.set(key, str(1 << 30))
    assert build(spark.range(2500, numPartitions=1).selectExpr("id", "concat('t', id) AS text")).count() == 2500
    assert all(int(spark.conf.get(key)) <= most for key, most in keys.items())
