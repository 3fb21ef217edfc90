"""Queries of the name, URL and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions import names, texts, urls
from foliate.plans.registry import register

_HEX = "md5(c_name)"
_DASH = f"concat(substr({_HEX}, 1, 8), '-', substr({_HEX}, 9, 4), '-', substr({_HEX}, 13, 4), '-', substr({_HEX}, 17, 4), '-', substr({_HEX}, 21, 12))"
#: Identifiers in all forms that occur, and some that are none.
IDS = f"SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN {_HEX} WHEN 1 THEN upper({_DASH}) WHEN 2 THEN concat('Page-', {_HEX}) WHEN 3 THEN {_DASH} ELSE c_name END AS v FROM {{customer}}"
#: Titles with characters that paths can't hold, odd ends, reserved names and great lengths.
TITLES = """SELECT p_partkey AS k, concat('id-', md5(p_name)) AS id, CASE p_partkey % 9
    WHEN 0 THEN concat(p_name, '/', p_brand, ':*') WHEN 1 THEN concat('  ', p_name, '. . ') WHEN 2 THEN concat('con.', p_name) WHEN 3 THEN '..'
    WHEN 4 THEN concat(repeat(p_name, 30), '?') WHEN 5 THEN concat(p_type, chr(10), '<', p_name, '>') WHEN 6 THEN 'LPT1' WHEN 7 THEN '' ELSE p_name END AS title FROM {part}"""
URLS = "SELECT page_id AS k, CASE page_id % 7 WHEN 0 THEN replace(url, 'http', 'HTTP') WHEN 1 THEN concat(url, '%20a+b') WHEN 2 THEN 'not a url' ELSE url END AS u FROM {pages}"
LINKS = f"SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN concat('https://www.notion.so/Title-', {_HEX}) WHEN 1 THEN concat('https://notion.so/', {_DASH}, '?v=1') WHEN 2 THEN concat('http://notion.so/', {_HEX}) WHEN 3 THEN concat('https://notion.so.example.com/', {_HEX}) WHEN 4 THEN concat('https://TEAM.notion.so/a/b-', {_HEX}, '/#x') ELSE c_name END AS u FROM {{customer}}"
WORDS = "SELECT doc_id AS k, concat(text, CASE doc_id % 5 WHEN 0 THEN ' <b> & | ]' WHEN 1 THEN '.MD' WHEN 2 THEN concat(chr(92), 'x.md') WHEN 3 THEN ' -- > ' ELSE '' END) AS t FROM {documents}"

_NORMAL = "CASE WHEN regexp_full_match(v, '[0-9a-f]{32}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', 'i') THEN lower(replace(v, '-', '')) END"
_TRAIL = "lower(replace(nullif(regexp_extract({x}, '(?:[0-9a-f]{{32}}|[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})$', 0, 'i'), ''), '-', ''))"


def _segment_sql(title: str, ident: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace(translate({title}, '/\:*?" + '"' + r"<>|', '---------'), '[\x00-\x1F\x7F]', '-', 'g'), '^\s+|\s+$', '', 'g'), '[. ]+$', '')"
    short = f"coalesce(nullif(substr(replace({ident}, '-', ''), 1, 8), ''), 'unknown')"
    safe = rf"CASE WHEN regexp_matches({bare}, '^(con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|$)', 'i') THEN '_' || {bare} ELSE {bare} END"
    return f"CASE WHEN {bare} = '' THEN 'Untitled--' || {short} WHEN length({safe}) > 200 THEN substr({safe}, 1, 200 - 2 - length({short})) || '--' || {short} ELSE {safe} END"


def one(name: str, source: str, column, sql: str, key: str = "k") -> None:
    """A function of a row: what ``column()`` and ``sql`` make is ``out``."""
    register(name, {"src": source}, lambda src: src.select(key, column().alias("out")), f"SELECT {key}, {sql} AS out FROM src")


c = F.col
one("F1_normal_id", IDS, lambda: names.normal_id(c("v")), _NORMAL)
one("F2_trailing_id", IDS, lambda: names.trailing_id(c("v")), _TRAIL.format(x="v"))
one("F3_is_dashed", IDS, lambda: names.is_dashed(c("v")), "regexp_full_match(v, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', 'i')")
one("F4_segment", TITLES, lambda: names.segment(c("title"), c("id"), composed=False), _segment_sql("nfc_normalize(title)", "id"))
one("F5_short_id", IDS, lambda: names.short_id(c("v")), "coalesce(nullif(substr(replace(v, '-', ''), 1, 8), ''), 'unknown')")
one("F6_collision_key", WORDS, lambda: names.collision_key(c("t"), composed=False), "lower(nfc_normalize(replace(t, chr(92), '/')))")
_WEB = "^(https?)://([^/?#]+)([^?#]*)"
_PATH = f"CASE WHEN regexp_matches(u, '{_WEB}', 'i') THEN coalesce(nullif(regexp_extract(u, '{_WEB}', 3, 'i'), ''), '/') END"
one("F7_stable_url", URLS, lambda: urls.stable(c("u"), F.lit("notion")), f"CASE WHEN regexp_matches(u, '{_WEB}', 'i') THEN lower(regexp_extract(u, '{_WEB}', 1, 'i')) || '://' || lower(regexp_extract(u, '{_WEB}', 2, 'i')) || {_PATH} ELSE u END")
one("F8_file_name", URLS, lambda: urls.file_name(c("u")), rf"url_decode(nullif(regexp_extract({_PATH}, '([^/]+)/*$', 1), ''))")
one("F9_path_key", URLS, lambda: urls.path_key(c("u")), f"url_decode({_PATH})")
_ASSETS = "SELECT p_partkey AS k, concat('page-', CAST(p_size AS STRING)) AS page, md5(p_name) AS block, CASE p_partkey % 5 WHEN 0 THEN concat(p_name, '.PNG') WHEN 1 THEN p_name WHEN 2 THEN concat(p_name, '.t_x') WHEN 3 THEN '.hidden' ELSE concat(p_brand, '/x.tar.gz') END AS name, CASE p_partkey % 3 WHEN 0 THEN 'image/JPEG' WHEN 1 THEN 'application/pdf' ELSE 'text/x' END AS mime, concat('https://x.example/', p_name) AS u FROM {part}"
_EXT = r"regexp_extract(name, '[^/](\.[^./]*)$', 1)"
_MIME = "CASE lower(mime) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.EXTENSIONS.items()) + " ELSE '' END"
one("F10_asset_path", _ASSETS, lambda: names.asset_path(c("page"), c("block"), c("name"), c("mime")), rf"'_assets/' || {_segment_sql('page', 'page')} || '/' || {_segment_sql('block', 'block')} || '--' || {_segment_sql(f'''coalesce(nullif(substr(name, 1, length(name) - length({_EXT})), ''), 'asset')''', 'block')} || CASE WHEN regexp_matches({_EXT}, '^\.[a-z0-9]{{1,10}}$', 'i') THEN lower({_EXT}) ELSE {_MIME} END")
one("F11_asset_key", _ASSETS, lambda: names.asset_key(c("page"), c("block")), "page || ':' || block")
one("F12_external_block", _ASSETS, lambda: names.external_block(c("u")), "'external-' || substr(sha256(u), 1, 16)")
one("F13_content_hash", "SELECT doc_id AS k, text FROM {documents}", lambda: F.sha2("text", 256), "sha256(text)")
_NODES = "SELECT c_custkey AS k, concat('R', CAST(c_nationkey % 5 AS STRING)) AS root, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('N', CAST(c_nationkey AS STRING)) END AS parent, concat(c_name, '.md') AS path FROM {customer}"
one("F14_structure_hash", _NODES, lambda: names.structure_hash(c("root"), c("parent"), c("path")), """sha256('{"rootId":"' || root || CASE WHEN parent IS NULL THEN '' ELSE '","parentId":"' || parent END || '","expectedPath":"' || path || '"}')""")
_LOGS = "SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN 'Authorization' WHEN 1 THEN 'api_token' ELSE event_type END AS name, CASE event_id % 4 WHEN 0 THEN concat('https://h.example/p?sig=', props) WHEN 1 THEN concat('secret-1 ', event_type) ELSE event_type END AS v FROM {events}"
one("F16_redact_value", _LOGS, lambda: texts.redact_value(c("name"), texts.redact(c("v"), ["secret-1"])), r"CASE WHEN regexp_matches(name, 'authorization|token', 'i') THEN '[REDACTED]' WHEN regexp_full_match(replace(v, 'secret-1', '[REDACTED]'), '[a-z][a-z0-9+.-]*://\S+', 'i') THEN regexp_replace(replace(v, 'secret-1', '[REDACTED]'), '\?[^#]+', '?[REDACTED]') ELSE replace(v, 'secret-1', '[REDACTED]') END")
_FAILS = "SELECT event_id AS k, CASE event_id % 5 WHEN 0 THEN 'get https://h.example/a?sig=1&x=2, failed' WHEN 1 THEN concat('Bearer ab', CAST(event_id AS STRING), '; token: xyz') WHEN 2 THEN 'open /var/lib/x.db failed (/tmp/a)' WHEN 3 THEN concat('at C:', chr(92), 'Users', chr(92), 'x.txt now') ELSE concat('plain ', event_type) END AS t FROM {events}"
one("F17_redact_failure", _FAILS, lambda: texts.redact_failure(c("t")), "CASE k % 5 WHEN 0 THEN 'get https://h.example/a?[REDACTED], failed' WHEN 1 THEN 'Bearer [REDACTED]; token=[REDACTED]' WHEN 2 THEN 'open [REDACTED_PATH] failed ([REDACTED_PATH])' WHEN 3 THEN 'at [REDACTED_PATH] now' ELSE t END")
_WAYS = "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, '/', p_type, '/page.md') WHEN 1 THEN 'page.md' ELSE concat(p_brand, '/page.md') END AS a, CASE p_partkey % 2 WHEN 0 THEN concat(p_brand, '/x/y.png') ELSE '_assets/z.png' END AS b FROM {part}"
one("F18_relative", _WAYS, lambda: names.relative(c("a"), c("b")), "CASE WHEN k % 2 = 1 THEN repeat('../', length(a) - length(replace(a, '/', ''))) || b WHEN k % 3 = 1 THEN b WHEN k % 3 = 2 THEN 'x/y.png' WHEN split_part(a, '/', 2) = 'x' THEN 'y.png' ELSE '../x/y.png' END")
_SEG = r"url_decode(nullif(regexp_extract(coalesce(nullif(regexp_extract(u, '^(https?)://([^/?#]+)([^?#]*)', 3, 'i'), ''), '/'), '([^/]+)/*$', 1), ''))"
one("F19_page_id", LINKS, lambda: urls.page_id(c("u")), rf"CASE WHEN regexp_matches(u, '^https://(?:[^/?#:]+\.)?notion\.so(?:[/?#:]|$)', 'i') THEN {_TRAIL.format(x=_SEG)} END")
_RESULTS = "SELECT event_id AS k, CASE event_id % 7 WHEN 0 THEN 'safety' WHEN 1 THEN 'network' ELSE NULL END AS kind, CASE event_id % 2 WHEN 0 THEN 'Lock is held' ELSE 'limit' END AS message, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 3 = 0 END AS ok, event_id % 5 = 0 AS a, event_id % 4 = 0 AS b, event_id % 6 = 0 AS d, event_id % 8 = 0 AS e FROM {events}"
one("F20_exit_code", _RESULTS, lambda: texts.exit_code(c("kind"), c("message"), c("ok"), {"lock_failed": c("a"), "verify_mismatch": c("b"), "safety_stopped": c("d"), "partial": c("e")}).cast("long"), "CAST(CASE WHEN kind = 'safety' AND message ILIKE '%lock%' THEN 5 WHEN kind = 'safety' THEN 3 WHEN kind IS NOT NULL THEN 1 WHEN ok IS NULL OR (NOT ok AND a) THEN 5 WHEN NOT ok AND b THEN 4 WHEN NOT ok AND d THEN 3 WHEN NOT ok AND e THEN 2 WHEN ok THEN 0 ELSE 1 END AS BIGINT)")
one("F21_sync_mode", "SELECT event_id AS k, CASE WHEN event_id % 5 = 0 THEN 'p' END AS page, CASE WHEN event_id % 3 = 0 THEN 'r' END AS root, event_id % 2 = 0 AS full_run FROM {events}", lambda: texts.sync_mode(c("page"), c("root"), c("full_run")), "CASE WHEN page IS NOT NULL THEN 'page' WHEN root IS NOT NULL THEN 'root' WHEN full_run THEN 'full' ELSE 'incremental' END")
one("F22_sidecar_path", TITLES, lambda: names.sidecar_path(c("title"), c("id")), f"'_unsupported/' || {_segment_sql('title', 'title')} || '/' || {_segment_sql('id', 'id')} || '.json'")
_WIKI = r"regexp_replace(replace(t, chr(92), '/'), '\.md$', '', 'i')"
one("F23_wiki_link", WORDS, lambda: texts.wiki_link(c("t"), F.when(c("k") % 2 == 0, c("t")).otherwise(" "), c("k") % 3 == 0), rf"'[[' || {_WIKI} || CASE WHEN k % 3 = 0 THEN chr(92) || '|' ELSE '|' END || replace(replace(replace(coalesce(nullif(trim(CASE WHEN k % 2 = 0 THEN t ELSE ' ' END), ''), nullif(regexp_extract({_WIKI}, '([^/]*)$', 1), ''), {_WIKI}), chr(10), ' '), '|', chr(92) || '|'), ']', chr(92) || ']') || ']]'")
_INLINE = "replace(replace(replace(trim(regexp_replace(t, '[\\r\\n]+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
one("F24_inline", WORDS, lambda: texts.inline(c("t")), _INLINE)
one("F25_comment_safe", WORDS, lambda: texts.comment_safe(c("t")), "replace(replace(t, '--', '-'), '>', '')")
one("F26_retry_delay", "SELECT event_id AS k, CAST(1 + event_id % 9 AS INT) AS n, CASE event_id % 4 WHEN 0 THEN '7' WHEN 1 THEN '-1' WHEN 2 THEN 'soon' ELSE NULL END AS after_s FROM {events}", lambda: texts.retry_delay(c("n"), c("after_s"), F.lit(0.5)), "CASE WHEN TRY_CAST(after_s AS DOUBLE) >= 0 THEN TRY_CAST(after_s AS DOUBLE) * 1000 ELSE least(30000.0::DOUBLE, 500 * pow(2, n - 1)) * 0.75::DOUBLE END")
one("F27_attribute", "SELECT nullif(page_id, -1) AS k, concat('<page url = \"', url, '\" data-x=1>') AS tag FROM {pages}", lambda: texts.attribute(c("tag"), "url"), """regexp_extract(tag, 'url = "([^"]*)"', 1)""")
one("A7_retry_schedule", "SELECT n_nationkey AS k, CAST(1 + n_nationkey AS INT) AS n FROM {nation}", lambda: F.least(F.lit(30000.0), 500 * F.pow(F.lit(2.0), c("n") - 1)), "least(30000.0::DOUBLE, 500 * pow(2, n - 1))")
_STATUS = "SELECT event_id AS k, CAST(element AS INT) AS status FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 400 WHEN 3 THEN 404 WHEN 4 THEN 429 WHEN 5 THEN 500 WHEN 6 THEN 529 WHEN 7 THEN 418 ELSE NULL END AS element FROM {events}) x"
one("A8_error_category", _STATUS, lambda: texts.error_category(c("status")), "CASE WHEN status = 401 THEN 'authentication' WHEN status IN (403, 404) THEN 'permission' WHEN status = 400 THEN 'validation' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'service_unavailable' ELSE 'network' END")
one("A7_retryable", _STATUS, lambda: texts.retryable(c("status"), F.when(c("k") % 2 == 0, "ECONNRESET")), "coalesce(status IN (429, 529, 500, 502, 503, 504), false) OR k % 2 = 0")
one("B7_may_download", "SELECT event_id AS k, CASE event_id % 2 WHEN 0 THEN 'notion' ELSE 'external' END AS s, event_id % 3 = 0 AS e FROM {events}", lambda: urls.may_download(c("s"), c("e")), "s = 'notion' OR e")
one("B8_allowed_type", _ASSETS.replace("'text/x'", "' Image/PNG ; q=1'"), lambda: urls.allowed_type(c("name"), c("mime"), [".png", ".gz"], ["image/png", "image/jpeg"]), rf"lower({_EXT}) IN ('.png', '.gz') AND lower(trim(split_part(mime, ';', 1))) IN ('image/png', 'image/jpeg')")
_IPS = "SELECT event_id AS k, CASE event_id % 11 WHEN 0 THEN '300.1.1.1' WHEN 1 THEN 'x' ELSE concat(CAST((event_id * 37) % 256 AS STRING), '.', CAST((event_id * 11) % 256 AS STRING), '.', CAST(event_id % 3 AS STRING), '.', CAST(event_id % 250 AS STRING)) END AS ip FROM {events}"
_A, _B, _C = ("CAST(split_part(ip, '.', 1) AS INT)", "CAST(split_part(ip, '.', 2) AS INT)", "CAST(split_part(ip, '.', 3) AS INT)")
_BLOCKED = f"({_A} < 1 OR {_A} > 223 OR {_A} IN (10, 127) OR ({_A} = 100 AND {_B} BETWEEN 64 AND 127) OR ({_A} = 169 AND {_B} = 254) OR ({_A} = 172 AND {_B} BETWEEN 16 AND 31) OR ({_A} = 192 AND ({_B} = 168 OR ({_B} = 0 AND {_C} IN (0, 2)) OR ({_B} = 88 AND {_C} = 99))) OR ({_A} = 198 AND ({_B} IN (18, 19) OR ({_B} = 51 AND {_C} = 100))) OR ({_A} = 203 AND {_B} = 0 AND {_C} = 113))"
one("B9_blocked_v4", _IPS, lambda: urls.blocked_v4(c("ip")), f"CASE WHEN k % 11 IN (0, 1) THEN true ELSE {_BLOCKED} END")
_FETCH = "SELECT page_id AS k, CASE page_id % 8 WHEN 0 THEN 'http://localhost/x' WHEN 1 THEN 'https://10.1.2.3/a' WHEN 2 THEN 'https://8.8.8.8/a' WHEN 3 THEN 'https://u:p@h.example/' WHEN 4 THEN 'ftp://h.example/' ELSE url END AS u FROM {pages}"
one("B11_safe_url", _FETCH, lambda: urls.safe(c("u")), "k % 8 NOT IN (0, 1, 3, 4)")
_SIGNED = "SELECT page_id AS k, CASE page_id % 5 WHEN 0 THEN concat('https://files.example.com/a?x=1&amp;X-Amz-Signature=', CAST(page_id AS STRING)) WHEN 1 THEN 'https://files.example.com/a?x=1' WHEN 2 THEN 'https://other.example/a?signature=1' WHEN 3 THEN 'https://FILES.example.com/a?Sig%6Eature=2' ELSE url END AS u FROM {pages}"
one("B13_signed_url", _SIGNED, lambda: urls.signed(c("u"), ["files.example.com"], ["x-amz-signature", "signature", "expires"]), "k % 5 IN (0, 3)")
_RELATIVE = "SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN concat(p_brand, '/../x.md') WHEN 1 THEN '../x.md' WHEN 2 THEN 'a/../../b' WHEN 3 THEN '/abs' WHEN 4 THEN 'a/./b//c' ELSE concat(p_brand, '/', p_name) END AS p FROM {part}"
one("B14_within_root", _RELATIVE, lambda: names.within_root(c("p")), "k % 7 NOT IN (1, 2, 3)")
one("B19_cached", "SELECT event_id AS k, event_id % 2 = 0 AS had, CASE WHEN event_id % 3 = 0 THEN 'unverified' ELSE 'usable' END AS s, event_id % 5 = 0 AS forced, event_id % 7 <> 0 AS there FROM {events}", lambda: c("had") & (c("s") != "unverified") & ~c("forced") & c("there"), "had AND s <> 'unverified' AND NOT forced AND there")
_META = "SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS e1, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END AS e2, CASE WHEN event_id % 2 = 0 THEN NULL ELSE user_id END AS n1, CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS n2 FROM {events}"
one("B20_redownload", _META, lambda: F.coalesce(c("e1") != c("e2"), F.lit(False)) | F.coalesce(c("n1") != c("n2"), F.lit(False)) | (F.coalesce(c("e1"), c("e2")).isNull() | c("e1").isNull() | c("e2").isNull()) & (c("n1").isNull() | c("n2").isNull()), "coalesce(e1 <> e2, false) OR coalesce(n1 <> n2, false) OR ((e1 IS NULL OR e2 IS NULL) AND (n1 IS NULL OR n2 IS NULL))")
one("G22_placeholder", WORDS, lambda: texts.placeholder(c("t"), F.lit("id--1")), "'[Unsupported block: ' || replace(replace(t, '--', '-'), '>', '') || ']' || chr(10) || '<!-- foliate: unsupported block type=' || replace(replace(t, '--', '-'), '>', '') || ' id=id-1 -->'")
_CONTENT = f"SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN concat('---', chr(10), 'managed_by: foliate', chr(10), 'notion_id: ', {_DASH}, chr(10), 'content_hash: ', md5(c_mktsegment), chr(10), '---', chr(10), 'body ', c_name) WHEN 1 THEN concat('---', chr(10), 'managed_by: other', chr(10), 'notion_id: ', {_DASH}, chr(10), '---', chr(10)) WHEN 2 THEN concat('---', chr(10), 'managed_by: foliate', chr(10), 'notion_id: \"', {_DASH}, '\"', chr(10), '---', chr(10)) ELSE c_name END AS f, {_DASH} AS d, md5(c_mktsegment) AS h FROM {{customer}}"
register("G14_marker", {"src": _CONTENT}, lambda src: src.select("k", texts.marker(c("f")).alias("m"), texts.body(c("f")).alias("body")).select("k", "m.id", "m.content_hash", "body"), "SELECT k, CASE WHEN k % 4 IN (0, 2) THEN d END AS id, CASE WHEN k % 4 = 0 THEN h END AS content_hash, CASE k % 4 WHEN 0 THEN substr(f, strpos(f, 'body ')) WHEN 3 THEN NULL ELSE '' END AS body FROM src")
_CELLS = "SELECT c_nationkey AS k, count(*) AS n, min(c_mktsegment) AS a, max(c_name) AS b FROM {customer} GROUP BY c_nationkey"
register("G6_table_text", {"src": _CELLS}, lambda src: src.select("k", texts.table_text(F.array(F.array("a", F.concat("b", F.lit("|x"))), F.array(F.lit("1\n2"), F.col("n").cast("string"))), c("k") % 2 == 0).alias("out")),
         "SELECT k, CASE WHEN k % 2 = 0 THEN '| ' || a || ' | ' || b || chr(92) || '|x |' || chr(10) || '| --- | --- |' || chr(10) || '| 1<br>2 | ' || n || ' |' ELSE '|  |  |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || a || ' | ' || b || chr(92) || '|x |' || chr(10) || '| 1<br>2 | ' || n || ' |' END AS out FROM src")
_BLOCKS = "SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS k, CASE turn % 12 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'heading_1' WHEN 2 THEN 'heading_2' WHEN 3 THEN 'bulleted_list_item' WHEN 4 THEN 'numbered_list_item' WHEN 5 THEN 'to_do' WHEN 6 THEN 'quote' WHEN 7 THEN 'divider' WHEN 8 THEN 'code' WHEN 9 THEN 'image' WHEN 10 THEN 'file' ELSE 'odd--kind' END AS kind, text AS t, role, turn FROM {conversations}"
register("G19_flat_blocks", {"src": _BLOCKS}, lambda src: src.select("k", texts.block_line(c("kind"), c("t"), c("role") == "user", c("role"), F.when(c("turn") % 2 == 1, F.lit("https://x.example/i")), c("k")).alias("out")), """
    SELECT k, CASE kind WHEN 'paragraph' THEN t WHEN 'heading_1' THEN '# ' || t WHEN 'heading_2' THEN '## ' || t WHEN 'bulleted_list_item' THEN '- ' || t WHEN 'numbered_list_item' THEN '1. ' || t
        WHEN 'to_do' THEN CASE WHEN role = 'user' THEN '- [x] ' ELSE '- [ ] ' END || t WHEN 'quote' THEN '> ' || replace(t, chr(10), chr(10) || '> ') WHEN 'divider' THEN '---'
        WHEN 'code' THEN '```' || role || chr(10) || t || chr(10) || '```'
        ELSE CASE WHEN kind = 'image' AND turn % 2 = 1 THEN '![' || t || '](https://x.example/i)' WHEN kind = 'file' AND turn % 2 = 1 THEN '[' || coalesce(nullif(t, ''), 'File') || '](https://x.example/i)'
            ELSE '[Unsupported block: ' || replace(kind, '--', '-') || ']' || chr(10) || '<!-- foliate: unsupported block type=' || replace(kind, '--', '-') || ' id=' || replace(k, '--', '-') || ' -->' END END AS out FROM src""")
_RICH = "SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS k, text AS t, turn % 2 = 0 AS b, turn % 3 = 0 AS i, conv_id % 2 = 0 AS cd, CASE WHEN conv_id % 3 = 0 THEN 'https://x.example' END AS href FROM {conversations}"
register("G20_rich_text", {"src": _RICH}, lambda src: src.select("k", texts.rich_text(F.array(F.struct(c("t").alias("plain"), c("cd").alias("code"), c("b").alias("bold"), c("i").alias("italic"), F.lit(None).cast("boolean").alias("strike"), c("href")), F.struct(F.lit("!").alias("plain"), F.lit(False).alias("code"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(True).alias("strike"), F.lit(None).cast("string").alias("href")))).alias("out")),
         "SELECT k, CASE WHEN href IS NULL THEN x ELSE '[' || x || '](' || href || ')' END || '~~!~~' AS out FROM (SELECT *, CASE WHEN i THEN '*' || y || '*' ELSE y END AS x FROM (SELECT *, CASE WHEN b THEN '**' || z || '**' ELSE z END AS y FROM (SELECT *, CASE WHEN cd THEN '`' || t || '`' ELSE t END AS z FROM src)))")
_SIX = "SELECT event_id AS k, CASE event_id % 8 WHEN 0 THEN '::1' WHEN 1 THEN '2606:4700::1' WHEN 2 THEN '2001:db8::7' WHEN 3 THEN '2001:20::5' WHEN 4 THEN '::ffff:10.0.0.1' WHEN 5 THEN '::ffff:8.8.8.8' WHEN 6 THEN 'nothing' ELSE '2002::1' END AS ip FROM {events}"
one("B10_blocked_v6", _SIX, lambda: urls.blocked_address(c("ip")), "k % 8 NOT IN (1, 3, 5)")
