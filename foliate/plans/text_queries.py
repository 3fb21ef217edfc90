"""Queries of typed properties and page texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions import flanking, markdown, markup, props, texts
from foliate.operators import pages, render
from foliate.plans.registry import register

c = F.col
O, Q, E = "chr(123)", "chr(34)", "chr(125)"


def _prop(kind: str, value: str) -> str:
    """SQL of a property's JSON; braces come from chr(), since sources name tables in braces."""
    return f"concat({O}, '\"type\":\"{kind}\",\"{kind}\":', {value}, {E})"


def prop(name: str, table: str, key: str, kind: str, value: str, want: str) -> None:
    """A property of each row converted; ``want`` is DuckDB's SQL of the result."""
    register(name, {"src": f"SELECT {key} AS k, *, {_prop(kind, value)} AS j FROM {{{table}}}"}, lambda src: src.select("k", props.convert(c("j")).alias("out")), f"SELECT k, {want} AS out FROM src")


_S = lambda x: f"concat('\"', {x}, '\"')"
_OBJ = lambda *kv: "concat(" + O + ", " + ", ',', ".join(f"'\"{k}\":', {v}" for k, v in kv) + f", {E})"
_RAW = lambda kind: f"'{{\"type\":\"{kind}\",\"raw\":' || j || '}}'"
prop("P1_rich_text", "nation", "n_nationkey", "rich_text", f"CASE WHEN n_nationkey % 5 = 0 THEN 'null' ELSE concat('[', {_OBJ(('plain_text', _S('n_name')))}, ',', {_OBJ(('text', _OBJ(('content', _S("'!'")))))}, ']') END", f"CASE WHEN k % 5 = 0 THEN {_RAW('rich_text')} ELSE '\"' || n_name || '!\"' END")
prop("P2_number", "events", "event_id", "number", "CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN CAST(user_id AS STRING) ELSE '\"x\"' END", f"CASE k % 3 WHEN 0 THEN 'null' WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE {_RAW('number')} END")
prop("P3_select", "customer", "c_custkey", "select", f"CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE {_OBJ(('name', _S('c_mktsegment')))} END", "CASE WHEN k % 4 = 0 THEN 'null' ELSE '\"' || c_mktsegment || '\"' END")
prop("P4_multi_select", "orders", "o_orderkey", "multi_select", f"concat('[', {_OBJ(('name', _S('o_orderstatus')))}, ',', {_OBJ(('id', _S("'1'")))}, ',', {_OBJ(('name', _S('o_orderpriority')))}, ']')", "'[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]'")
prop("P5_date", "events", "event_id", "date", f"CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN {_OBJ(('start', _S("'2024-01-01'")), ('end', "'null'"))} WHEN 2 THEN {_OBJ(('start', _S("'2024-01-01'")), ('end', _S('event_type')))} ELSE {_OBJ(('start', _S("'a'")), ('time_zone', _S("'UTC'")))} END", "CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN '\"2024-01-01\"' WHEN 2 THEN '{\"start\":\"2024-01-01\",\"end\":\"' || event_type || '\"}' ELSE '{\"start\":\"a\",\"timeZone\":\"UTC\"}' END")
prop("P6_people", "supplier", "s_suppkey", "people", f"concat('[', {_OBJ(('id', _S('s_name')), ('name', _S("'n'")))}, ',', {_OBJ(('name', _S("'no id'")))}, ',', {_OBJ(('id', _S("'2'")))}, ']')", "'[{\"id\":\"' || s_name || '\",\"name\":\"n\"},{\"id\":\"2\"}]'")
prop("P7_files", "part", "p_partkey", "files", f"concat('[', {_OBJ(('name', _S('p_brand')), ('type', _S("'external'")), ('external', _OBJ(('url', _S("'https://x'")))))}, ',', {_OBJ(('name', _S("'z'")), ('type', _S("'file'")))}, ']')", "'[{\"name\":\"' || p_brand || '\",\"url\":\"https://x\"}]'")
prop("P8_checkbox", "events", "event_id", "checkbox", "CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '\"yes\"' END", f"CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE {_RAW('checkbox')} END")
prop("P9_email", "customer", "c_custkey", "email", f"CASE c_custkey % 3 WHEN 0 THEN 'null' ELSE {_S('c_name')} END", "CASE k % 3 WHEN 0 THEN 'null' ELSE '\"' || c_name || '\"' END")
prop("P10_formula", "orders", "o_orderkey", "formula", f"CASE o_orderkey % 3 WHEN 0 THEN {_OBJ(('type', _S("'string'")), ('string', _S('o_orderstatus')))} WHEN 1 THEN {_OBJ(('type', _S("'number'")), ('number', 'CAST(o_custkey AS STRING)'))} ELSE {_OBJ(('type', _S("'boolean'")), ('boolean', "'true'"))} END", "'{\"value\":' || CASE k % 3 WHEN 0 THEN '\"' || o_orderstatus || '\"' WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE 'true' END || ',\"raw\":' || substr(j, 29, length(j) - 29) || '}'")
prop("P11_relation", "orders", "o_orderkey", "relation", f"concat('[', {_OBJ(('id', _S('CAST(o_custkey AS STRING)')))}, ']')", "'{\"value\":[\"' || o_custkey || '\"],\"raw\":[{\"id\":\"' || o_custkey || '\"}]}'")
prop("P12_created_by", "supplier", "s_suppkey", "created_by", f"CASE WHEN s_suppkey % 2 = 0 THEN {_OBJ(('id', _S('s_name')))} ELSE '[]' END", f"CASE WHEN k % 2 = 0 THEN '{{\"id\":\"' || s_name || '\"}}' ELSE {_RAW('created_by')} END")
prop("P13_unique_id", "nation", "n_nationkey", "unique_id", f"CASE WHEN n_nationkey % 2 = 0 THEN {_OBJ(('prefix', _S('n_name')), ('number', 'CAST(n_nationkey AS STRING)'))} ELSE {_OBJ(('prefix', "'null'"), ('number', 'CAST(n_nationkey AS STRING)'))} END", "'\"' || CASE WHEN k % 2 = 0 THEN n_name || '-' ELSE '' END || k || '\"'")
prop("P14_unknown", "events", "event_id", "future_type", "props", _RAW("future_type"))
register("P16_row_titles", {"src": "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS t FROM {supplier}"}, lambda src: src.select("k", F.coalesce(F.nullif("t", F.lit("")), c("k").cast("string")).alias("title")), "SELECT k, coalesce(nullif(t, ''), k::VARCHAR) AS title FROM src")
_TITLED = f"SELECT c_custkey AS k, concat({O}, '\"a\":', {O}, '\"type\":\"number\",\"number\":1', {E}, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(',\"z\":', {_prop('title', f"concat('[', {_OBJ(('plain_text', _S('c_name')))}, ',', {_OBJ(('plain_text', _S(chr(39) + '!' + chr(39))))}, ']')")}) END, {E}) AS j, c_name FROM {{customer}}"
register("B4_page_title", {"src": _TITLED}, lambda src: src.select("k", props.page_title(c("j")).alias("title")), "SELECT k, CASE WHEN k % 4 = 0 THEN '' ELSE c_name || '!' END AS title FROM src")
_RAWS = f"SELECT doc_id AS k, source, concat({O}, '\"file\":', {_OBJ(('url', _S("concat('https://h/', source, '?s=1')")))}, ',\"external\":', {_OBJ(('url', _S("'https://h/x?s=1'")))}, ',\"l\":[\"', CASE WHEN doc_id % 2 = 0 THEN '<https://prod-files-secure.s3.amazonaws.com/a?Signature=1>' ELSE 'plain' END, '\"]', {E}) AS j FROM {{documents}}"
register("P15_stabilised_json", {"src": _RAWS}, lambda src: props.stabilise(src.select("k", "j"), "j"), f"SELECT k, {O} || '\"file\":' || {O} || '\"url\":\"https://h/' || source || '\"' || {E} || ',\"external\":' || {O} || '\"url\":\"https://h/x?s=1\"' || {E} || ',\"l\":[\"' || CASE WHEN k % 2 = 0 THEN '<https://prod-files-secure.s3.amazonaws.com/a>' ELSE 'plain' END || '\"]' || {E} AS j, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS replaced, 0::BIGINT AS unsafe FROM src")
#: Documents with markup around, before or after their whole texts.
_N = "chr(10)"
_SIGNED = "https://prod-files-secure.s3.amazonaws.com/"
PAGES = f"""SELECT doc_id AS id, CASE doc_id % 8
    WHEN 0 THEN concat('<callout type="tip">', {_N}, text, {_N}, '</callout>')
    WHEN 1 THEN concat('<columns>', {_N}, '<column>', {_N}, 'a', {_N}, '</column>', {_N}, '<column>', {_N}, 'b', {_N}, '</column>', {_N}, '</columns>', {_N}, {_N}, text)
    WHEN 2 THEN concat('<table header-row="true"><tr><td>', source, '</td><td>b</td></tr><tr><td>1|2</td><td>', lang, '</td></tr></table>', {_N}, {_N}, text)
    WHEN 3 THEN concat('<synced_block url="x">', {_N}, source, {_N}, '</synced_block>', {_N}, {_N}, text)
    WHEN 4 THEN concat('[', source, '](https://www.notion.so/P-', md5(source), ') `[c](https://www.notion.so/', md5(source), ')` ', text)
    WHEN 5 THEN concat('![i]({_SIGNED}', source, '?X-Amz-Signature=1) bare {_SIGNED}', source, '?X-Amz-Signature=2 ', text)
    WHEN 6 THEN concat('x', {_N}, {_N}, '<empty-block/>', {_N}, {_N}, 'y', {_N}, '```', {_N}, '<empty-block/>', {_N}, '```', {_N}, text)
    ELSE concat('<span color="red">', source, '</span> <span underline="true">u</span> ', text) END AS text, source, lang, text AS head FROM {{documents}}"""


def page(name: str, build, sql: str | None) -> None:
    register(name, {"src": PAGES}, build, sql)


page("G1_empty_blocks", lambda s: pages.rewrite(s, markdown.empty_blocks, "(?i)<empty-block"), f"SELECT id, CASE WHEN id % 8 = 6 THEN 'x' || {_N} || {_N} || 'y' || {_N} || '```' || {_N} || '<empty-block/>' || {_N} || '```' || {_N} || head ELSE text END AS text FROM src")
#: A callout ends at a blank line, so a text with one keeps its tags.
_BLANK = f"regexp_matches(head, '\n[ \t\r]*(\n|$)') OR regexp_matches(head, '^[ \t\r]*\n') OR trim(head, ' ' || chr(9) || chr(13) || {_N}) = ''"
page("G2_enhanced", lambda s: pages.rewrite(s, markup.enhanced, "<|```|~~~"), f"""SELECT id, CASE id % 8
    WHEN 0 THEN CASE WHEN {_BLANK} THEN text ELSE '> [!tip]' || {_N} || '> ' || replace(trim(head, ' ' || chr(9) || chr(13)), {_N}, {_N} || '> ') END
    WHEN 1 THEN 'a' || {_N} || {_N} || 'b' || {_N} || {_N} || head
    WHEN 2 THEN '| ' || rpad(source, greatest(length(source), 4)::INTEGER, ' ') || ' | b' || repeat(' ', length(lang) - 1) || ' |' || {_N} || '| ' || repeat('-', greatest(length(source), 4)) || ' | ' || repeat('-', length(lang)) || ' |' || {_N} || '| 1' || chr(92) || '|2' || repeat(' ', greatest(length(source), 4) - 4) || ' | ' || lang || ' |' || {_N} || {_N} || head
    WHEN 3 THEN source || {_N} || {_N} || head
    WHEN 7 THEN '==' || source || '== <u>u</u> ' || head
    ELSE text END AS text FROM src""")
page("G3_callouts", lambda s: pages.rewrite(s, markdown.callouts, "(?i)<callout"), f"SELECT id, CASE WHEN id % 8 = 0 THEN '> [!tip]' || {_N} || regexp_replace('> ' || replace(trim(head, {_N}), {_N}, {_N} || '> '), '[ ]+(\n|$)', '\1', 'g') ELSE text END AS text FROM src")
page("G4_columns", lambda s: pages.rewrite(s, markdown.columns, "(?i)<columns"), f"SELECT id, CASE WHEN id % 8 = 1 THEN 'a' || {_N} || {_N} || 'b' || {_N} || {_N} || head ELSE text END AS text FROM src")
page("G5_tables", lambda s: pages.rewrite(s, markdown.tables, "(?i)<table"), f"SELECT id, CASE WHEN id % 8 = 2 THEN '| ' || source || ' | b |' || {_N} || '| --- | --- |' || {_N} || '| 1' || chr(92) || '|2 | ' || lang || ' |' || {_N} || {_N} || head ELSE text END AS text FROM src")
page("G7_synced", lambda s: pages.rewrite(s, markdown.synced, "(?i)<synced_block"), f"SELECT id, CASE WHEN id % 8 = 3 THEN source || {_N} || {_N} || ltrim(head, {_N}) ELSE text END AS text FROM src")
page("G8_small_tags", lambda s: pages.rewrite(s, markdown.small_tags, "(?i)<(span|table_of_contents)"), "SELECT id, CASE WHEN id % 8 = 7 THEN '==' || source || '== <u>u</u> ' || head ELSE text END AS text FROM src")
page("G9_signed_urls", pages.stabilised, f"SELECT id, CASE WHEN id % 8 = 5 THEN '![i]({_SIGNED}' || source || ') bare {_SIGNED}' || source || '?X-Amz-Signature=2 ' || head ELSE text END AS text, CASE WHEN id % 8 = 5 THEN 1 ELSE 0 END::BIGINT AS replaced, CASE WHEN id % 8 = 5 THEN 1 ELSE 0 END::BIGINT AS unsafe FROM src")
page("G9_occurrences", pages.occurrences, f"""SELECT id, 'markdown-image' AS context, 'replaced' AS outcome, sha256('{_SIGNED}' || source || '?X-Amz-Signature=1') AS digest FROM src WHERE id % 8 = 5
    UNION ALL SELECT id, 'bare-url', 'boundary-undetermined', sha256('{_SIGNED}' || source || '?X-Amz-Signature=2') FROM src WHERE id % 8 = 5""")
#: The same page later: its URLs stand elsewhere, and one in three has another signature.
_LATER = lambda s: s.withColumn("text", F.concat(F.lit("# Head\n\n"), F.when(c("id") % 3 == 0, F.replace("text", F.lit("Signature=1"), F.lit("Signature=3"))).otherwise(c("text"))))
page("H13_replacement_sets", lambda s: pages.same_occurrences(s, _LATER(s)), "SELECT id, id % 3 <> 0 AS equal FROM src WHERE id % 8 = 5")
page("E6_replacement_totals", lambda s: pages.stabilised(s).agg(F.sum("replaced").alias("replaced"), F.sum("unsafe").alias("unsafe")), "SELECT count(*) FILTER (id % 8 = 5) AS replaced, count(*) FILTER (id % 8 = 5) AS unsafe FROM src")
#: Code that a numbered list loses: its end as a fence that opens all that follows, or as the end of the paragraph.
_BROKEN = lambda: F.concat(F.when(c("id") % 4 == 0, "1. item\n   ```py\nx = 1\n```\n").otherwise("1. item\n\t```py\nx = **1**\n\t```\n"), F.lit("z\n\n"), "head")
page("G10_fences", lambda s: pages.rewrite(s.withColumn("text", F.when(c("id") % 2 == 0, _BROKEN()).otherwise(c("text"))), markup.fences, "```|~~~"), f"SELECT id, CASE WHEN id % 2 = 0 THEN '1. item' || {_N} || '   ```py' || {_N} || CASE WHEN id % 4 = 0 THEN '   x = 1' ELSE '   x = **1**' END || {_N} || '   ```' || {_N} || {_N} || 'z' || {_N} || {_N} || head ELSE text END AS text FROM src")
#: Callouts that a blank line, or the end of a list, parts from their closing tags.
_SPLIT = lambda: F.concat(F.when(c("id") % 4 == 0, 'Before\n<callout type="tip">\nA\n\n</callout>\n').otherwise('- one\n- two\n  <callout type="tip">\n  A\n</callout>\n'), F.lit("z\n\n"), "head")
page("G11_split_callouts", lambda s: pages.rewrite(s.withColumn("text", F.when(c("id") % 2 == 0, _SPLIT()).otherwise(c("head"))), markup.split_callouts, "(?i)</callout>"), f"SELECT id, CASE WHEN id % 4 = 0 THEN 'Before' || {_N} || {_N} || '> [!tip]' || {_N} || '> A' || {_N} || {_N} || 'z' || {_N} || {_N} || head WHEN id % 4 = 2 THEN '- one' || {_N} || '- two' || {_N} || '  > [!tip]' || {_N} || '  > A' || {_N} || {_N} || 'z' || {_N} || {_N} || head ELSE head END AS text FROM src")
page("G12_inline_tags", lambda s: pages.rewrite(s.withColumn("text", F.when(c("id") % 2 == 0, F.concat(F.lit('<span color="red"><u>'), "source", F.lit("</span></u>\n\n"), "head")).otherwise(c("text"))), markup.inline_tags, "(?i)<span"), f"SELECT id, CASE WHEN id % 2 = 0 THEN '<span color=\"red\"><u>' || source || '</span></u>' || {_N} || {_N} || head WHEN id % 8 = 7 THEN '==' || source || '== <u>u</u> ' || head ELSE text END AS text FROM src")
page("G12_inline_blocks", lambda s: pages.rewrite(s.withColumn("text", F.concat(F.lit("Before <callout>See <synced_block url='u'>"), "source", F.lit("</synced_block></callout> after\n\n"), "head")), markup.inline_tags, "(?i)<callout"), f"SELECT id, 'Before' || {_N} || {_N} || '> [!note]' || {_N} || '> See' || {_N} || '>' || {_N} || '> ' || source || {_N} || {_N} || 'after' || {_N} || {_N} || head AS text FROM src")
page("G13_bold", lambda s: pages.rewrite(s.withColumn("text", F.concat(F.lit("x**(a)**y "), "source", F.lit("\n\n"), "head")), lambda t: flanking.bold(t)[0], r"\*\*"), f"SELECT id, 'x**' || chr(8203) || '(a)' || chr(8203) || '**y ' || source || {_N} || {_N} || head AS text FROM src")
#: The author's own zero-width spaces outlast the way there and back.
page("G13_plain_again", lambda s: pages.rewrite(s.withColumn("text", F.concat(F.lit("\u200b x**(a)**y \u200b"), "head")), lambda t: flanking.plain(*flanking.bold(t)), r"\*\*"), "SELECT id, chr(8203) || ' x**(a)**y ' || chr(8203) || head AS text FROM src")
page("G17_links", lambda s: pages.linked(s, s.select(F.md5("source").alias("target"), F.concat(F.lit("Root/"), "source", F.lit(".md")).alias("path")).distinct()), "SELECT id, CASE WHEN id % 8 = 4 THEN '[[Root/' || source || '|' || source || ']] `[c](https://www.notion.so/' || md5(source) || ')` ' || head ELSE text END AS text FROM src")
#: Destinations in three forms, some with a copy of their own page alone.
_ASSETS = "SELECT doc_id AS page, concat('https://x/', source) AS url, concat('_assets/', CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN ' a' ELSE '(a)' END, '.png') AS path FROM {documents} WHERE doc_id % 3 > 0"
register("G18_asset_urls", {"src": "SELECT doc_id AS id, source, text AS head, concat('![a](https://x/', source, ') [b](<https://x/', source, '> \"t\") <https://x/', source, '> `![c](https://x/', source, ')` ![d](https://x/other)', chr(10), chr(10), text) AS text FROM {documents}", "own": _ASSETS}, pages.with_local_assets, f"""SELECT id, CASE WHEN path IS NULL THEN text ELSE '![a](' || raw || ') [b](<' || path || '> "t") [' || label || '](' || raw || ') `![c](https://x/' || source || ')` ![d](https://x/other)' || {_N} || {_N} || head END AS text FROM (
    SELECT src.*, path, CASE WHEN contains(path, ' ') THEN '<' || path || '>' ELSE replace(replace(path, '(', chr(92) || '('), ')', chr(92) || ')') END AS raw, replace(path, '_', chr(92) || '_') AS label FROM src LEFT JOIN own ON page = id)""")
#: Unknown blocks: as many as tokens, too few, failed, or not found.
_TOKENS = "SELECT doc_id AS id, text AS head, concat('a <unknown id=\"1\"/> `<unknown/>` b <unknown/> ', text) AS text FROM {documents}"
_RENDERED = "SELECT doc_id AS page, k AS place, concat('b', CAST(k AS STRING)) AS block, CASE WHEN doc_id % 5 = 3 AND k = 2 THEN 404 WHEN doc_id % 5 = 4 AND k = 2 THEN 500 ELSE 200 END AS status, concat('[', source, CAST(k AS STRING), ']') AS text FROM {documents} CROSS JOIN (SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 3) WHERE k > 0 AND (doc_id % 5 <> 1 OR k = 1)"
register("G21_tokens", {"src": _TOKENS, "r": _RENDERED, "fb": "SELECT doc_id AS page, concat('blocks of ', source) AS text FROM {documents} WHERE doc_id % 2 = 0"}, pages.substituted, """SELECT src.id, CASE WHEN id % 5 IN (0, 2) THEN 'a ' || one.text || ' `<unknown/>` b ' || two.text || ' ' || head
    WHEN id % 5 = 3 THEN 'a ' || one.text || ' `<unknown/>` b ' || '[Unsupported block: unavailable]' || chr(10) || '<!-- foliate: unsupported block type=unavailable id=b2 -->' || ' ' || head ELSE coalesce(fb.text, src.text) END AS text,
    CASE WHEN id % 5 IN (1, 4) THEN 'block' ELSE 'markdown' END AS source, CASE WHEN id % 5 = 3 THEN 1 ELSE 0 END::BIGINT AS placeholders
    FROM src LEFT JOIN r one ON one.page = id AND one.place = 1 LEFT JOIN r two ON two.page = id AND two.place = 2 LEFT JOIN fb ON fb.page = id""")
page("G23_assets", pages.assets, f"SELECT id, CASE WHEN id % 8 = 5 THEN 'image' ELSE 'file' END AS kind, CASE WHEN id % 8 = 5 THEN '{_SIGNED}' || source || '?X-Amz-Signature=1' ELSE 'https://www.notion.so/P-' || md5(source) END AS url, CASE WHEN id % 8 = 5 THEN 'i' ELSE source END AS caption, 0::BIGINT AS occurrence FROM src WHERE id % 8 IN (4, 5)")
page("G15_front_matter", lambda s: pages.rewrite(s.withColumn("text", F.concat_ws("\n", "source", "head")), lambda t: markdown.front_matter([("managed_by", "foliate"), ("title", t.split("\n", 1)[0]), ("parent", None)]) + t.split("\n", 1)[1]), f"SELECT id, '---' || {_N} || 'managed_by: foliate' || {_N} || 'title: ' || source || {_N} || '---' || {_N} || head AS text FROM src")
register("G16_source_index", {"src": "SELECT n_regionkey AS source, n_nationkey AS place, n_name AS title, concat('d', CAST(n_nationkey AS STRING), '.md') AS path FROM {nation}"}, lambda src: src.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- [["), texts.index_path(c("path")), F.lit("|"), texts.index_alias(c("title")), F.lit("]]")).alias("line")))), lambda x: x["line"]), "\n").alias("out")), f"SELECT source, string_agg('- [[d' || place || '|' || title || ']]', {_N} ORDER BY place) AS out FROM src GROUP BY source")
register("G24_block_assets", {"src": "SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS block, conv_id AS page, turn AS place, CASE turn % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' ELSE 'paragraph' END AS type, CASE WHEN turn % 4 = 3 THEN NULL ELSE 'https://x' END AS url FROM {conversations}"}, lambda src: pages_assets(src), "SELECT page, block, kind, row_number() OVER (PARTITION BY page, kind ORDER BY place) - 1 AS occurrence FROM (SELECT *, CASE WHEN type = 'image' THEN 'image' ELSE 'file' END AS kind FROM src WHERE type IN ('image', 'file', 'pdf', 'video', 'audio') AND url IS NOT NULL)")

#: Conversations as pages: every four turns are a list three deep with a paragraph in it, and each page ends with a table.
_NESTED = """SELECT CAST(conv_id AS STRING) AS page, concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, CASE WHEN turn % 4 > 0 THEN concat(CAST(conv_id AS STRING), '-', CAST(turn - 1 AS STRING)) END AS parent, CAST(turn AS BIGINT) AS place,
        CASE turn % 4 WHEN 0 THEN 'bulleted_list_item' WHEN 1 THEN 'numbered_list_item' WHEN 2 THEN 'to_do' ELSE 'paragraph' END AS type, text, role = 'user' AS checked, CAST(NULL AS STRING) AS language, CAST(NULL AS STRING) AS url, CAST(NULL AS INT) AS width, CAST(NULL AS BOOLEAN) AS header, CAST(NULL AS STRING) AS cell, CAST(NULL AS STRING) AS payload FROM {conversations}
    UNION ALL SELECT CAST(conv_id AS STRING), concat(CAST(conv_id AS STRING), '-t'), NULL, 1000, 'table', NULL, NULL, NULL, NULL, CASE WHEN conv_id % 3 = 0 THEN 3 ELSE 2 END, conv_id % 2 = 0, NULL, concat('rows of ', CAST(conv_id AS STRING)) FROM {conversations} WHERE turn = 0
    UNION ALL SELECT CAST(conv_id AS STRING), concat(CAST(conv_id AS STRING), '-r', CAST(turn AS STRING)), concat(CAST(conv_id AS STRING), '-t'), CAST(turn AS BIGINT), 'table_row', NULL, NULL, NULL, NULL, NULL, NULL, role, NULL FROM {conversations}"""
_cells = lambda b: b.withColumn("cells", F.when(c("type") == "table_row", F.array(c("cell"), F.concat(c("cell"), F.lit("|"))))).drop("cell")
_IN = lambda x: f"'  ' || replace({x}, {_N}, {_N} || '  ')"
register("G19_nested_blocks", {"src": _NESTED}, lambda src: render.render(_cells(src))[0], f""", t AS (SELECT page, place, text, CASE WHEN checked THEN '- [x] ' ELSE '- [ ] ' END AS box FROM src WHERE type NOT IN ('table', 'table_row')),
    q AS (SELECT page, place // 4 AS g, max(CASE WHEN place % 4 = 0 THEN text END) AS a, max(CASE WHEN place % 4 = 1 THEN text END) AS b, max(CASE WHEN place % 4 = 2 THEN box || text END) AS d, max(CASE WHEN place % 4 = 3 THEN text END) AS e FROM t GROUP BY ALL),
    r AS (SELECT *, d || CASE WHEN e <> '' THEN {_N} || {_IN('e')} ELSE '' END AS dd FROM q), s AS (SELECT *, '1. ' || b || coalesce({_N} || {_IN('dd')}, '') AS bb FROM r),
    u AS (SELECT page, string_agg('- ' || a || coalesce({_N} || {_IN('bb')}, ''), {_N} || {_N} ORDER BY g) AS x FROM s GROUP BY page),
    w AS (SELECT page, string_agg('| ' || cell || ' | ' || cell || chr(92) || '| |', {_N} ORDER BY place) AS body, min(cell) FILTER (place = 0) AS first, string_agg('| ' || cell || ' | ' || cell || chr(92) || '| |', {_N} ORDER BY place) FILTER (place > 0) AS later FROM src WHERE type = 'table_row' GROUP BY page)
    SELECT page, x || {_N} || {_N} || CASE WHEN CAST(page AS BIGINT) % 3 = 0 THEN '[Unsupported block: table]' || {_N} || '<!-- foliate: unsupported block type=table id=' || page || '-t -->'
        WHEN CAST(page AS BIGINT) % 2 = 0 THEN '| ' || first || ' | ' || first || chr(92) || '| |' || {_N} || '| --- | --- |' || coalesce({_N} || later, '') ELSE '|  |  |' || {_N} || '| --- | --- |' || {_N} || body END AS text FROM u JOIN w USING (page)""")
register("G19_sidecars", {"src": _NESTED}, lambda src: render.render(_cells(src))[1], "SELECT page, id, type, payload FROM src WHERE type = 'table' AND CAST(page AS BIGINT) % 3 = 0")


def pages_assets(blocks):
    from foliate.operators.match import occurrences

    held = blocks.filter(c("type").isin("image", "file", "pdf", "video", "audio") & c("url").isNotNull())
    return occurrences(held.withColumn("kind", F.when(c("type") == "image", "image").otherwise("file"))).select("page", "block", "kind", "occurrence")
