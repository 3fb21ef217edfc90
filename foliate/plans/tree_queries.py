"""Queries over hierarchies, joins and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.functions import names, texts, urls
from foliate.operators import diff, match, tree
from foliate.plans.registry import ORACLES, plain, register
from foliate.sources import cursors, tables

c = F.col
#: Regions, nations, customers and orders as one forest of resources.
TREE = """SELECT concat('R', CAST(r_regionkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent_id, r_name AS title FROM {region}
    UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), concat('R', CAST(n_regionkey AS STRING)), n_name FROM {nation}
    UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), concat('N', CAST(c_nationkey AS STRING)), c_name FROM {customer}"""
#: The same with a cycle of two nations that no root reaches, and customers below them.
CYCLIC = TREE.replace("concat('R', CAST(n_regionkey AS STRING)), n_name FROM {nation}", "CASE n_nationkey WHEN 3 THEN 'N4' WHEN 4 THEN 'N3' ELSE concat('R', CAST(n_regionkey AS STRING)) END, n_name FROM {nation}")
_WALK = "walk AS (SELECT id, parent_id, 0 AS depth, [id] AS trail FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.id, n.parent_id, depth + 1, list_append(trail, n.id) FROM nodes n JOIN walk w ON n.parent_id = w.id WHERE NOT list_contains(trail, n.id))"


def with_walk(sql: str, extra: str = "") -> str:
    return f", {_WALK}{extra} {sql}"


register("D1g_census_walk", {"nodes": CYCLIC}, lambda nodes: tree.first_discovery(tree.descend(nodes)).select("id", "depth", F.array_join("trail", ">").alias("trail")), with_walk("SELECT id, depth, array_to_string(trail, '>') AS trail FROM walk"))
register("A4_block_preorder", {"nodes": TREE}, lambda nodes: tree.descend(nodes).select("id", F.array_join("trail", "/").alias("preorder"), c("depth")), with_walk("SELECT id, array_to_string(trail, '/') AS preorder, depth FROM walk"))
_PLANNED = "names AS (SELECT id, parent_id, replace(title, '/', '-') AS filename FROM nodes), walk AS (SELECT id, 0 AS depth, filename AS stem FROM names WHERE parent_id IS NULL UNION ALL SELECT n.id, depth + 1, stem || '/' || n.filename FROM names n JOIN walk w ON n.parent_id = w.id)"
_paths = lambda nodes: tree.paths(nodes.select("id", "parent_id", names.segment(c("title"), c("id")).alias("filename")))
register("D2g_paths", {"nodes": TREE}, _paths, f", {_PLANNED} SELECT id, depth, stem || '.md' AS path FROM walk")
register("D2g_cycles", {"nodes": CYCLIC}, lambda nodes: tree.unplanned(nodes, tree.climb(nodes).filter("state = 'rooted'")), f", {_PLANNED} SELECT id, parent_id FROM nodes ANTI JOIN walk USING (id)")
_ASK = "SELECT concat('C', CAST(c_custkey AS STRING)) AS id FROM {customer} UNION ALL SELECT 'nowhere'"
register("D3g_reachability", {"nodes": CYCLIC, "ask": _ASK}, lambda nodes, ask: tree.reach(ask, nodes, "R1"), """
    , up AS (SELECT id, id AS cur, [id] AS seen FROM ask UNION ALL SELECT u.id, n.parent_id, list_append(seen, n.parent_id) FROM up u JOIN nodes n ON n.id = u.cur WHERE u.cur <> 'R1' AND n.parent_id IS NOT NULL AND NOT list_contains(seen, n.parent_id))
    , last AS (SELECT id, arg_max(cur, len(seen)) AS cur FROM up GROUP BY id)
    SELECT l.id, CASE WHEN cur = 'R1' THEN 'inside' WHEN n.id IS NULL THEN 'unknown' WHEN n.parent_id IS NULL THEN 'outside' ELSE 'unknown' END AS reachability FROM last l LEFT JOIN nodes n ON n.id = l.cur""")
register("D4g_index_path", {"src": "SELECT p_partkey AS k, concat(p_brand, '/', p_name, '.md') AS p, p_size % 2 = 0 AS s FROM {part}"}, lambda src: src.select("k", tree.index_path(c("p"), c("s")).alias("out")), r"SELECT k, CASE WHEN s THEN regexp_replace(p, '\.md$', '/_index.md') ELSE p END AS out FROM src")
_DBS = "SELECT concat('N', CAST(n_nationkey AS STRING)) AS id, concat('R', CAST(n_regionkey AS STRING)) AS parent_id, n_name AS title, CAST(n_nationkey AS BIGINT) AS ordinal, concat('R', CAST(n_regionkey AS STRING)) AS root_id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE concat('ds', CAST(n_nationkey % 7 AS STRING)) END AS data_source_id FROM {nation}"
_ROWS = "SELECT concat('row', CAST(s_suppkey AS STRING)) AS row_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS title, concat('ds', CAST(s_nationkey % 9 AS STRING)) AS data_source_id FROM {supplier}"
register("D5g_expand_sources", {"dbs": _DBS, "row_pages": _ROWS}, lambda dbs, row_pages: tree.expand_sources(dbs, row_pages), """
    , own AS (SELECT * FROM dbs WHERE data_source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY data_source_id ORDER BY ordinal, id) = 1)
    SELECT id, parent_id, title, root_id FROM dbs UNION ALL SELECT row_id, o.id, coalesce(nullif(r.title, ''), row_id), o.root_id FROM row_pages r JOIN own o USING (data_source_id)""")
register("C16_source_owner", {"dbs": _DBS}, lambda dbs: match.first_of(dbs.filter("data_source_id is not null").select("data_source_id", "ordinal", "id"), ["data_source_id"], ["ordinal", "id"]).select("data_source_id", "id"), "SELECT data_source_id, id FROM dbs WHERE data_source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY data_source_id ORDER BY ordinal, id) = 1")
register("D6g_first_source", {"src": "SELECT o_custkey AS k, CAST(o_orderkey AS STRING) AS ds, o_orderkey AS place FROM {orders}"}, lambda src: src.groupBy("k").agg(F.min_by("ds", "place").alias("first"), (F.count("*") > 1).alias("several")), "SELECT k, arg_min(ds, place) AS first, count(*) > 1 AS several FROM src GROUP BY k")
register("D8g_distinct_sources", {"src": "SELECT o_custkey AS ds, o_orderkey AS place FROM {orders}"}, lambda src: src.groupBy("ds").agg(F.min("place").alias("place")), "SELECT ds, place FROM src QUALIFY row_number() OVER (PARTITION BY ds ORDER BY place) = 1")
_WARN = "SELECT concat('R', CAST(user_id % 5 AS STRING)) AS root_id, CASE WHEN event_id % 2 = 0 THEN 'multiple_data_sources' ELSE 'child_list_incomplete' END AS type FROM {events} WHERE event_type = 'error' AND user_id % 3 = 0 AND user_id % 5 < 3"
_ROOTS = "SELECT concat('R', CAST(r_regionkey AS STRING)) AS root_id FROM {region}"
register("D7g_completeness", {"roots": _ROOTS, "warnings": _WARN}, tree.completeness, "SELECT root_id, CASE WHEN b THEN 'partial' ELSE 'complete' END AS status, NOT b AS deletion_allowed FROM (SELECT root_id, root_id IN (SELECT root_id FROM warnings WHERE type <> 'multiple_data_sources') AS b FROM roots)")
_FILES = "SELECT concat(p_brand, '/', p_type, '/', p_name, CAST(p_partkey AS STRING), '.md') AS path FROM {part}"
_GONE = _FILES + " WHERE p_size % 3 > 0"
register("D9g_empty_folders", {"files": _FILES, "gone": _GONE}, tree.empty_folders, r"""SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]+$', 1) AS folder FROM gone WHERE NOT EXISTS (SELECT 1 FROM files f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.path = f.path) AND (regexp_extract(f.path, '^(.*)/[^/]+$', 1) = regexp_extract(gone.path, '^(.*)/[^/]+$', 1)))""")
#: Parts as pages in their brand's folder: many names differ in case alone, and some had another name before.
_NAMED = "SELECT md5(CAST(p_partkey AS STRING)) AS id, p_brand AS parent_id, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) ELSE p_name END AS title FROM {part}"
_BEFORE = "SELECT md5(CAST(p_partkey AS STRING)) AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, '--old') ELSE 'unrelated' END AS stored FROM {part} WHERE p_partkey % 2 = 0"
_W1 = """, j AS (SELECT id, parent_id, title AS base, coalesce(parent_id, '<root>') AS folder, lower(title) AS bk, CASE WHEN stored = title OR starts_with(stored, title || '--') THEN stored END AS vs FROM pages LEFT JOIN before USING (id)),
    k AS (SELECT *, CASE WHEN vs IS NOT NULL AND row_number() OVER (PARTITION BY folder, bk, lower(vs) ORDER BY id) = 1 THEN vs END AS keep FROM j),
    l AS (SELECT *, max(CASE WHEN lower(keep) = bk THEN 1 ELSE 0 END) OVER (PARTITION BY folder, bk) AS taken, CASE WHEN keep IS NULL THEN row_number() OVER (PARTITION BY folder, bk, keep IS NULL ORDER BY id) END AS rn FROM k)
    SELECT id, parent_id, CASE WHEN keep IS NOT NULL THEN keep WHEN taken = 0 AND rn = 1 THEN base ELSE base || '--' || substr(id, 1, 8) END AS filename FROM l"""
register("W1_filenames", {"pages": _NAMED, "before": _BEFORE}, lambda pages, before: tree.filenames(pages, before), _W1.replace("pages LEFT", "pages LEFT"))
_PATHS = "SELECT CAST(p_partkey AS STRING) AS id, concat(p_brand, '/', p_name, '.md') AS path, p_partkey AS ordinal FROM {part}"
_STORED = "SELECT CAST(p_partkey AS STRING) AS id, CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, '/', p_name, '.md') WHEN 1 THEN concat('old/', p_name, '.md') END AS local_path FROM {part} WHERE p_partkey % 5 > 0"
_THERE = "SELECT concat(p_brand, '/', p_name, '.md') AS path FROM {part} WHERE p_partkey % 10 = 0"
register("W2_allocation", {"planned": _PATHS, "stored": _STORED, "there": _THERE}, lambda planned, stored, there: diff.allocate(planned, stored, there), """
    , x AS (SELECT p.id, p.path, coalesce(s.local_path <> p.path AND s.local_path <> '', false) AND (count(DISTINCT p.id) OVER (PARTITION BY lower(p.path)) > 1 OR p.path IN (SELECT path FROM there)) AS fell FROM planned p LEFT JOIN stored s USING (id))
    SELECT id, CASE WHEN fell THEN regexp_replace(path, '\\.md$', '') || '--' || substr(id, 1, 8) || '.md' ELSE path END AS path, fell AS fell_back FROM x""")
_FALL = "concat('f/', CAST({k} % 20 AS STRING), '--', CAST({k} AS STRING), '.md')"
_FALL_PLANNED = "SELECT CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 7 = 0 THEN upper(" + _FALL.replace("{k}", "(p_partkey - 1)") + ") ELSE concat('f/', CAST(p_partkey % 20 AS STRING), '.md') END AS path FROM {part}"
_FALL_STORED = "SELECT CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 11 = 0 THEN " + _FALL.replace("{k}", "p_partkey") + " WHEN p_partkey % 3 > 0 THEN concat('old/', CAST(p_partkey AS STRING), '.md') END AS local_path FROM {part}"
_FALL_THERE = "SELECT CASE WHEN p_partkey % 5 = 0 THEN " + _FALL.replace("{k}", "p_partkey") + " ELSE concat('old/', CAST(p_partkey AS STRING), '.md') END AS path FROM {part}"
register("W2_blocked_fallbacks", {"planned": _FALL_PLANNED, "stored": _FALL_STORED, "there": _FALL_THERE}, lambda planned, stored, there: diff.blocked_fallbacks(diff.allocate(planned, stored, there), planned, stored, there), """
    , x AS (SELECT p.id, p.path, s.local_path AS now, coalesce(s.local_path <> p.path AND s.local_path <> '', false) AND (count(DISTINCT p.id) OVER (PARTITION BY lower(p.path)) > 1 OR p.path IN (SELECT path FROM there)) AS fell FROM planned p LEFT JOIN stored s USING (id)),
    f AS (SELECT id, now, regexp_replace(path, '[.](md|MD)$', '') || '--' || substr(id, 1, 8) || regexp_extract(path, '[.](md|MD)$') AS path FROM x WHERE fell)
    SELECT id, path FROM f WHERE EXISTS (SELECT 1 FROM planned p WHERE lower(p.path) = lower(f.path) AND p.id <> f.id) OR (path IN (SELECT path FROM there) AND path IS DISTINCT FROM now)""")
register("W3_unique_outputs", {"planned": _PATHS}, lambda planned: planned.groupBy(names.collision_key(c("path")).alias("k")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).filter("a <> b").select("k", "n"), "SELECT lower(path) AS k, count(*) AS n FROM planned GROUP BY 1 HAVING count(DISTINCT id) > 1")
_MIXED = "SELECT n_name AS id, concat(CASE n_nationkey % 4 WHEN 0 THEN 'e' WHEN 1 THEN 'E' WHEN 2 THEN 'é' ELSE 'É' END, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END, '.md') AS path FROM {nation} UNION ALL SELECT r_name, concat(lower(r_name), '.md') FROM {region}"
register("W4_locale_order", {"src": _MIXED}, tree.ordered, "SELECT id, path, row_number() OVER (ORDER BY path COLLATE en, path, id) AS place FROM src")
register("W4_path_order", {"nodes": TREE}, lambda nodes: tree.ordered(_paths(nodes).select("id", "path")), f", {_PLANNED} SELECT id, path, row_number() OVER (ORDER BY path COLLATE en, path, id) AS place FROM (SELECT id, stem || '.md' AS path FROM walk)")
_OCC = "SELECT CAST(conv_id AS STRING) AS page, role AS kind, turn AS place FROM {conversations}"
register("W5_occurrences", {"src": _OCC}, match.occurrences, "SELECT page, kind, place, row_number() OVER (PARTITION BY page, kind ORDER BY place) - 1 AS occurrence FROM src")
_DOWN = "SELECT CAST(l_orderkey AS STRING) AS key, l_returnflag AS path, l_linestatus AS url, l_partkey AS place, l_suppkey AS s, l_quantity AS q FROM {lineitem}"
register("W6_planned_downloads", {"src": _DOWN}, lambda src: src.groupBy("key", "path", "url").agg(F.min("place").alias("place")), "SELECT key, path, url, min(place) AS place FROM src GROUP BY ALL")
register("W7_conflicting_urls", {"src": _DOWN}, lambda src: src.groupBy("key").agg(F.min("path").alias("a"), F.max("path").alias("b")).filter("a <> b").select("key"), "SELECT key FROM src GROUP BY key HAVING count(DISTINCT path) > 1")
_SIDE = "SELECT concat(p_brand, lower(p_type)) AS key, CASE WHEN p_size > 40 THEN p_type ELSE 'same' END AS content FROM {part}"
register("W8_sidecars", {"src": _SIDE}, match.sidecar_conflicts, "SELECT key FROM src GROUP BY key HAVING count(DISTINCT content) > 1")
register("W9_trash_path", {"src": _PATHS, "there": _THERE}, lambda src, there: src.select("id", F.concat(F.lit(".trash/2024-01-01/"), "path").alias("path")).join(there.select(F.concat(F.lit(".trash/2024-01-01/"), "path").alias("path"), F.lit(True).alias("there")).distinct(), "path", "left").select("id", F.when(c("there"), names.beside(c("path"), c("id"))).otherwise(c("path")).alias("path")), "SELECT id, CASE WHEN path IN (SELECT path FROM there) THEN '.trash/2024-01-01/' || regexp_replace(path, '\\.md$', '') || '--' || substr(id, 1, 8) || '.md' ELSE '.trash/2024-01-01/' || path END AS path FROM src")
_OLD = "SELECT o_orderkey AS key, 'old' AS v FROM {orders} WHERE o_orderkey % 3 > 0"
_NEW = "SELECT o_orderkey AS key, o_orderstatus AS v FROM {orders} WHERE o_orderkey % 3 < 2"
register("W10_merge", {"old": _OLD, "new": _NEW}, lambda old, new: match.merged(old, new, "key"), "SELECT key, coalesce(n.v, o.v) AS v FROM old o FULL JOIN new n USING (key)")
register("W11_top", {"src": "SELECT o_orderkey AS k, o_totalprice AS v FROM {orders}"}, lambda src: src.orderBy(F.desc("v"), "k").limit(10), "SELECT k, v FROM src ORDER BY v DESC, k LIMIT 10")
_RES = "SELECT concat('C', CAST(c_custkey AS STRING)) AS id, concat('N', CAST(c_nationkey AS STRING)) AS parent_id, c_name AS title FROM {customer}"
_NAT = "SELECT concat('N', CAST(n_nationkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent_id, n_name AS title FROM {nation} WHERE n_nationkey % 6 > 0"
register("C1_stored_lookup", {"a": _RES, "s": "SELECT concat('C', CAST(c_custkey AS STRING)) AS id, c_mktsegment AS seg FROM {customer} WHERE c_custkey % 3 > 0"}, lambda a, s: a.join(s, "id", "left").select("id", "seg"), "SELECT id, seg FROM a LEFT JOIN s USING (id)")
register("C2_planned_lookup", {"a": _RES, "p": "SELECT concat('C', CAST(c_custkey AS STRING)) AS id, concat(c_name, '.md') AS path FROM {customer} WHERE c_custkey % 4 > 0"}, lambda a, p: a.join(p, "id").select("id", "path"), "SELECT id, path FROM a JOIN p USING (id)")
register("C3_missing_parents", {"nodes": _RES + " UNION ALL " + _NAT}, tree.missing_parents, "SELECT id, parent_id FROM nodes n WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.id = n.parent_id)")
_REL = "SELECT o_custkey AS k, o_orderkey AS place, CASE WHEN o_orderkey % 5 = 0 THEN 'gone' ELSE CAST(o_orderkey % 50 AS STRING) END AS ref FROM {orders}"
register("C4_relations", {"rel": _REL, "map": "SELECT CAST(p_partkey AS STRING) AS ref, concat(p_brand, '/', p_name, '.md') AS path FROM {part} WHERE p_partkey % 3 > 0"}, lambda rel, map: rel.join(map, "ref", "left").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce(F.concat(F.lit("[["), texts.index_path(c("path")), F.lit("]]")), "ref").alias("x")))).alias("l")).select("k", F.array_join(F.transform("l", lambda x: x["x"]), ",").alias("out")), r"SELECT k, string_agg(coalesce('[[' || regexp_replace(path, '\.md$', '') || ']]', ref), ',' ORDER BY place) AS out FROM rel LEFT JOIN map USING (ref) GROUP BY k")
from foliate.plans.names_queries import _SEG, _TRAIL, LINKS  # noqa: E402

register("C5_link_targets", {"links": LINKS, "map": "SELECT md5(c_name) AS id, concat(c_mktsegment, '/', c_name) AS path FROM {customer} WHERE c_custkey % 2 = 0"}, lambda links, map: links.withColumn("id", urls.page_id(c("u"))).join(map, "id", "left").select("k", F.coalesce("path", "u").alias("out")), rf"SELECT k, coalesce(path, u) AS out FROM (SELECT *, CASE WHEN regexp_matches(u, '^https://(?:[^/?#:]+\.)?notion\.so(?:[/?#:]|$)', 'i') THEN {_TRAIL.format(x=_SEG)} END AS id FROM links) LEFT JOIN map USING (id)")
_SEEN, _KEPT = "SELECT o_custkey AS id, CONCAT('R', CAST(o_orderkey % 3 AS STRING)) AS root FROM {orders}", "SELECT c_custkey AS id FROM {customer}"
register("C6_unseen", {"kept": _KEPT, "seen": _SEEN}, lambda kept, seen: kept.join(seen, "id", "left_anti"), "SELECT id FROM kept ANTI JOIN seen USING (id)")
register("C7_seen_elsewhere", {"kept": _KEPT, "seen": _SEEN}, lambda kept, seen: kept.join(seen.filter("root <> 'R0'"), "id", "left_semi"), "SELECT id FROM kept SEMI JOIN (SELECT * FROM seen WHERE root <> 'R0') USING (id)")
register("C8_removed_roots", {"stored": _ROOTS, "configured": _ROOTS + " WHERE r_regionkey % 2 = 0"}, lambda stored, configured: stored.join(configured, "root_id", "left_anti").select("root_id", F.lit("complete").alias("status"), F.lit(True).alias("deletion_allowed")), "SELECT root_id, 'complete' AS status, true AS deletion_allowed FROM stored ANTI JOIN configured USING (root_id)")
register("C9_shared_ids", {"seen": _SEEN}, lambda seen: seen.groupBy("id").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("id"), "SELECT id FROM seen GROUP BY id HAVING count(DISTINCT root) > 1")
register("C10_conflicting_paths", {"src": "SELECT CASE doc_id % 2 WHEN 0 THEN upper(md5(text)) ELSE md5(text) END AS id, source AS path FROM {documents}"}, lambda src: src.groupBy(names.normal_id(c("id")).alias("id")).agg(F.min("path").alias("a"), F.max("path").alias("b")).filter("a <> b").select("id"), "SELECT lower(id) AS id FROM src GROUP BY 1 HAVING count(DISTINCT path) > 1")
_MD = "SELECT CAST(conv_id AS STRING) AS page, turn AS place, concat('https://h/', role, '/', CAST(turn % 3 AS STRING), '?', CAST(turn AS STRING)) AS url, concat('/', role, '/', CAST(turn % 3 AS STRING)) AS url_key, CAST(turn % 3 AS STRING) AS name_key, CASE WHEN turn % 2 = 0 THEN 'image' ELSE 'file' END AS kind, text AS caption FROM {conversations}"
register("C11_greedy_match", {"md": _MD, "bl": _MD.replace("turn AS place", "turn AS place, concat('b', CAST(turn AS STRING)) AS block").replace("'/', CAST(turn % 3 AS STRING)) AS url_key", "'/', CAST(turn % 5 AS STRING)) AS url_key")}, lambda md, bl: match.match(match.occurrences(md), match.occurrences(bl)), """
    , b AS (SELECT page, list(struct_pack(block, url_key, name_key, kind, occurrence, caption) ORDER BY place) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY place) - 1 AS occurrence FROM bl) GROUP BY page),
    a AS (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY place) - 1 AS occurrence, row_number() OVER (PARTITION BY page ORDER BY place) AS n FROM md),
    w AS (
        SELECT DISTINCT page, 0::BIGINT AS n, NULL::BIGINT AS place, []::VARCHAR[] AS used, []::VARCHAR[] AS urls, []::VARCHAR[] AS held, NULL::VARCHAR AS status, NULL::VARCHAR AS block, NULL::VARCHAR AS strategy FROM a
        UNION ALL
        SELECT page, n, place, CASE WHEN k > 0 THEN list_append(used, found) ELSE used END, CASE WHEN k = 1 THEN list_append(urls, url) ELSE urls END, CASE WHEN k = 1 THEN list_append(held, found) ELSE held END,
            CASE WHEN hit > 0 OR k > 0 THEN 'matched' WHEN m > 0 THEN 'ambiguous' ELSE 'unmatched' END, CASE WHEN hit > 0 THEN held[hit] WHEN k > 0 THEN found END, CASE WHEN hit > 0 OR m = 1 THEN 'url_path' WHEN m = 2 THEN 'filename' WHEN m = 3 THEN 'position_caption' END
        FROM (
            SELECT *, CASE WHEN hit > 0 THEN 0 WHEN m = 1 AND len(c1) = 1 THEN 1 WHEN m = 2 AND len(c2) = 1 THEN 2 WHEN m = 3 AND len(c3) = 1 THEN 3 ELSE 0 END AS k, CASE m WHEN 1 THEN c1[1].block WHEN 2 THEN c2[1].block WHEN 3 THEN c3[1].block END AS found
            FROM (SELECT *, CASE WHEN hit > 0 THEN 0 WHEN len(c1) > 0 THEN 1 WHEN len(c2) > 0 THEN 2 WHEN len(c3) > 0 THEN 3 ELSE 0 END AS m FROM (
                SELECT a.page, a.n, a.place, a.url, used, urls, held, coalesce(list_position(urls, a.url), 0) AS hit,
                    list_filter(free, lambda x: x.url_key = a.url_key) AS c1, list_filter(free, lambda x: x.name_key = a.name_key) AS c2, list_filter(free, lambda x: x.kind = a.kind AND x.occurrence = a.occurrence AND x.caption = a.caption) AS c3
                FROM (SELECT w.page, w.n, used, urls, held, list_filter(coalesce(blocks, []), lambda x: NOT list_contains(used, x.block)) AS free FROM w LEFT JOIN b ON b.page = w.page) w JOIN a ON a.page = w.page AND a.n = w.n + 1
            ))
        )
    ) SELECT page, place, status, block, strategy FROM w WHERE n > 0""")
_FILE_ROWS = "SELECT CAST(p_partkey AS STRING) AS id, concat(p_name, '.md') AS path FROM {part} WHERE p_partkey % 4 > 0"
_STATE_ROWS = "SELECT CAST(p_partkey AS STRING) AS id, concat(CASE WHEN p_size > 30 THEN lower(p_name) ELSE p_name END, '.md') AS local_path FROM {part} WHERE p_partkey % 5 > 0"
register("C12_files_and_state", {"f": _FILE_ROWS, "s": _STATE_ROWS}, lambda f, s: f.join(s, "id", "full_outer").select("id", F.when(c("local_path").isNull(), "orphan").when(c("path").isNull(), "missing").when(c("path") != c("local_path"), "mismatch").otherwise("ok").alias("out")), "SELECT id, CASE WHEN local_path IS NULL THEN 'orphan' WHEN path IS NULL THEN 'missing' WHEN path <> local_path THEN 'mismatch' ELSE 'ok' END AS out FROM f FULL JOIN s USING (id)")
register("C13_orphans", {"f": _FILE_ROWS, "s": _STATE_ROWS}, lambda f, s: f.join(s, "id", "left_anti"), "SELECT id, path FROM f ANTI JOIN s USING (id)")
_INODE = "SELECT l_partkey AS dev, l_suppkey AS ino, l_orderkey AS f FROM {lineitem} WHERE l_linenumber = 1"
register("C14_same_file", {"a": _INODE, "b": "SELECT l_partkey AS dev, l_suppkey AS ino, l_orderkey AS t FROM {lineitem} WHERE l_linenumber = 2"}, lambda a, b: a.join(b, ["dev", "ino"]).select("f", "t"), "SELECT f, t FROM a JOIN b USING (dev, ino)")
register("C15_search_gap", {"nodes": CYCLIC, "ask": _ASK, "found": "SELECT concat('C', CAST(c_custkey AS STRING)) AS id FROM {customer} WHERE c_custkey % 4 > 0"}, lambda nodes, ask, found: tree.reach(tree.not_among(ask, found), nodes, "R1").filter("reachability <> 'outside'"), """
    , up AS (SELECT id, id AS cur, [id] AS seen FROM ask WHERE id NOT IN (SELECT id FROM found) UNION ALL SELECT u.id, n.parent_id, list_append(seen, n.parent_id) FROM up u JOIN nodes n ON n.id = u.cur WHERE u.cur <> 'R1' AND n.parent_id IS NOT NULL AND NOT list_contains(seen, n.parent_id))
    , last AS (SELECT id, arg_max(cur, len(seen)) AS cur FROM up GROUP BY id), r AS (SELECT l.id, CASE WHEN cur = 'R1' THEN 'inside' WHEN n.id IS NULL THEN 'unknown' WHEN n.parent_id IS NULL THEN 'outside' ELSE 'unknown' END AS reachability FROM last l LEFT JOIN nodes n ON n.id = l.cur)
    SELECT * FROM r WHERE reachability <> 'outside'""")
register("C17_warnings_per_id", {"a": _KEPT, "w": "SELECT o_custkey AS id, o_orderpriority AS message FROM {orders} WHERE o_orderstatus = 'F'"}, lambda a, w: a.join(w.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("messages")), "id", "left"), "SELECT id, messages FROM a LEFT JOIN (SELECT id, string_agg(message, '; ' ORDER BY message) AS messages FROM w GROUP BY id) USING (id)")
_PAGED = "SELECT user_id % 7 AS collection, event_id AS page_no, CASE WHEN event_id % 97 = 0 THEN NULL ELSE array(event_type, CAST(user_id AS STRING)) END AS results, event_id % 13 <> 0 AS has_more, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'c' END AS next_cursor FROM {events}"
register("A1_cursor_pages", {"src": _PAGED}, lambda src: tables.paged(src), None)
ORACLES["A1_cursor_pages"] = f"""WITH src AS ({plain(_PAGED).replace("array(", "list_value(")}), last AS (SELECT collection, min(page_no) AS last FROM src WHERE NOT has_more GROUP BY collection)
    SELECT collection, page_no, generate_subscripts(results, 1) - 1 AS place, unnest(results) AS item FROM src LEFT JOIN last USING (collection) WHERE last IS NULL OR page_no <= last"""
register("A1_page_contract", {"src": _PAGED.replace("CASE WHEN event_id % 97 = 0 THEN NULL ELSE array(event_type, CAST(user_id AS STRING)) END", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_type END")}, tables.page_violations, "SELECT collection, page_no, CASE WHEN results IS NULL THEN 'malformed' ELSE 'no_cursor' END AS reason FROM src WHERE results IS NULL OR (has_more AND next_cursor IS NULL)")
register("A3_invalid_rows", {"src": "SELECT CASE WHEN event_id % 5 = 0 THEN 'database' WHEN event_id % 7 = 0 THEN NULL ELSE 'page' END AS object, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS id FROM {events}"}, tables.invalid_rows, "SELECT * FROM src WHERE NOT coalesce(object = 'page', false) OR id IS NULL")
register("A5_page_scan", {"src": "SELECT doc_id AS id, text AS markdown, doc_id % 5 = 0 AS truncated, CASE WHEN doc_id % 7 = 0 THEN 'b1' END AS unknown_block FROM {documents}"}, lambda src: src.select("id", F.length("markdown").cast("long").alias("n"), (~c("truncated") & c("unknown_block").isNull()).alias("complete")), "SELECT id, length(markdown) AS n, NOT truncated AND unknown_block IS NULL AS complete FROM src")
register("A6_fallback_choice", {"src": "SELECT doc_id AS id, text AS markdown, source AS rendered, doc_id % 5 = 0 AS truncated, doc_id % 7 = 0 AS unresolved FROM {documents}"}, lambda src: src.select("id", F.when(c("truncated") | c("unresolved"), c("rendered")).otherwise(c("markdown")).alias("body")), "SELECT id, CASE WHEN truncated OR unresolved THEN rendered ELSE markdown END AS body FROM src")
register("A9_request_slots", {"src": "SELECT user_id AS client, event_id AS n, epoch_s FROM (SELECT user_id, event_id, CAST(event_id % 1000 AS DOUBLE) AS epoch_s FROM {events}) x"}, lambda src: src.selectExpr("client", "n", "max(epoch_s - 0.4 * (rn - 1)) over (partition by client order by rn) + 0.4 * (rn - 1) as slot") if "rn" in src.columns else src.selectExpr("client", "n", "epoch_s", "row_number() over (partition by client order by n) as rn").selectExpr("client", "n", "max(epoch_s - 0.4d * (rn - 1)) over (partition by client order by rn rows between unbounded preceding and current row) + 0.4d * (rn - 1) as slot"), "SELECT client, n, max(epoch_s - 0.4::DOUBLE * (rn - 1)) OVER (PARTITION BY client ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 0.4::DOUBLE * (rn - 1) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY n) AS rn FROM src)")
register("A10_ordered_scan", {"src": "SELECT o_orderkey AS k, o_orderstatus AS s FROM {orders}"}, lambda src: src.orderBy("k"), "SELECT k, s FROM src ORDER BY k")
register("A11_point_lookup", {"src": "SELECT o_orderkey AS k, o_orderstatus AS s FROM {orders}"}, lambda src: src.filter(c("k") == 7), "SELECT k, s FROM src WHERE k = 7")
register("A14_managed_files", {"src": "SELECT CAST(p_partkey AS STRING) AS id, concat(p_name, CASE p_size % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.tmp' ELSE '.txt' END) AS path, p_size % 5 = 0 AS symlink FROM {part}"}, lambda src: src.filter(~c("symlink") & c("path").rlike(r"\.(md|tmp)$")).select("id", "path", c("path").endswith(".tmp").alias("temporary")), r"SELECT id, path, path LIKE '%.tmp' AS temporary FROM src WHERE NOT symlink AND regexp_matches(path, '\.(md|tmp)$')")
register("A16_duplicate_roots", {"src": "SELECT CAST(s_nationkey AS STRING) AS page_id FROM {supplier}"}, lambda src: src.groupBy("page_id").count().filter("count > 1").select("page_id", c("count").alias("n")), "SELECT page_id, count(*) AS n FROM src GROUP BY 1 HAVING count(*) > 1")
register("B1_root_projection", {"src": _RES.replace("c_name AS title", "c_name AS title, c_custkey % 3 = 0 AS in_trash, c_custkey % 7 = 0 AS archived, CASE WHEN c_custkey % 5 = 0 THEN 'database' ELSE 'page' END AS object")}, lambda src: src.filter("object = 'page'").select("id", F.lit("workspace").alias("parent_type"), "title", (c("in_trash") | c("archived")).alias("in_trash")), "SELECT id, 'workspace' AS parent_type, title, in_trash OR archived AS in_trash FROM src WHERE object = 'page'")
register("B2_child_projection", {"src": "SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN 'child_page' WHEN 1 THEN 'child_database' ELSE 'toggle' END AS type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS title FROM {events}"}, lambda src: src.filter(c("type").isin("child_page", "child_database")).select("k", F.when(c("type") == "child_page", "page").otherwise("database").alias("object_type"), F.coalesce("title", F.lit("")).alias("title")), "SELECT k, CASE type WHEN 'child_page' THEN 'page' ELSE 'database' END AS object_type, coalesce(title, '') AS title FROM src WHERE type IN ('child_page', 'child_database')")
register("B3_parent_union", {"src": "SELECT event_id AS k, CASE event_id % 4 WHEN 0 THEN 'page_id' WHEN 1 THEN 'database_id' WHEN 2 THEN 'workspace' ELSE 'block_id' END AS t, CAST(user_id AS STRING) AS ref FROM {events}"}, lambda src: src.select("k", F.when(c("t") == "page_id", "page").when(c("t") == "database_id", "database").when(c("t") == "workspace", "workspace").otherwise("unknown").alias("parent_type"), F.when(c("t").isin("page_id", "database_id"), c("ref")).alias("parent_id")), "SELECT k, CASE t WHEN 'page_id' THEN 'page' WHEN 'database_id' THEN 'database' WHEN 'workspace' THEN 'workspace' ELSE 'unknown' END AS parent_type, CASE WHEN t IN ('page_id', 'database_id') THEN ref END AS parent_id FROM src")
register("B5_scope", {"nodes": TREE}, lambda nodes: _paths(nodes).join(nodes.filter("parent_id = 'N3'").select("id"), "id", "left_semi").select("id", "path"), f", {_PLANNED} SELECT id, stem || '.md' AS path FROM walk WHERE id IN (SELECT id FROM nodes WHERE parent_id = 'N3')")
register("B6_root_titles", {"nodes": TREE, "conf": "SELECT concat('R', CAST(r_regionkey AS STRING)) AS id, 'Local' AS local_name FROM {region} WHERE r_regionkey < 2"}, lambda nodes, conf: nodes.join(F.broadcast(conf), "id", "left").select("id", F.coalesce("local_name", "title").alias("title")), "SELECT id, coalesce(local_name, title) AS title FROM nodes LEFT JOIN conf USING (id)")
register("B12_redirects", {"hops": "SELECT CAST(p_partkey AS STRING) AS u, CAST(p_partkey + 1 + p_size % 3 AS STRING) AS t FROM {part} WHERE p_size % 5 > 0", "start": "SELECT CAST(s_suppkey AS STRING) AS u FROM {supplier}"}, lambda hops, start: _redirects(start, hops), ", w AS (SELECT u AS start_url, u, 0 AS hops FROM start UNION ALL SELECT start_url, h.t, w.hops + 1 FROM w JOIN hops h USING (u) WHERE w.hops < 5) SELECT start_url, arg_max(u, hops) AS final_url, max(hops)::BIGINT AS n FROM w GROUP BY start_url")
register("B15_ownership", {"f": _FILE_ROWS, "s": _STATE_ROWS}, lambda f, s: f.join(s, "id", "left").select("id", F.coalesce(c("path") == c("local_path"), F.lit(False)).alias("managed")), "SELECT id, coalesce(path = local_path, false) AS managed FROM f LEFT JOIN s USING (id)")
register("B16_sidecar_owner", {"src": "SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN concat(chr(123), '\"type\":\"x\",\"id\":\"', CAST(event_id AS STRING), '\",\"payload\":null', chr(125)) WHEN 1 THEN concat(chr(123), '\"id\":\"1\"', chr(125)) ELSE 'no' END AS j FROM {events}"}, lambda src: src.select("k", (F.coalesce(F.array_sort(F.json_object_keys("j")) == F.array(F.lit("id"), F.lit("payload"), F.lit("type")), F.lit(False)) & F.coalesce(F.get_json_object("j", "$.id") == c("k").cast("string"), F.lit(False))).alias("owned")), "SELECT k, k % 3 = 0 AS owned FROM src")
register("B18_asset_identity", {"src": "SELECT p_partkey AS k, concat(p_brand, ':', md5(p_name)) AS key, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS page, md5(p_name) AS block FROM {part}"}, lambda src: src.select("k", (c("key") == names.asset_key(c("page"), c("block"))).alias("ok")), "SELECT k, key = page || ':' || block AS ok FROM src")


def _redirects(start: DataFrame, hops: DataFrame, most: int = 5) -> DataFrame:
    """Where each URL leads after at most ``most`` redirects."""
    now = start.select(c("u").alias("start_url"), "u", F.lit(0).cast("long").alias("n"))
    for k in range(most):
        now = now.join(hops, "u", "left").select("start_url", F.coalesce("t", "u").alias("u"), F.when(c("t").isNotNull() & (c("n") == k), c("n") + 1).otherwise(c("n")).alias("n"))
    return now.select("start_url", c("u").alias("final_url"), "n")


def _exported(turns: DataFrame) -> str:
    """Conversations as cursor pages of three turns, in the shared folder."""
    path = tables.new_path(turns.sparkSession, "cursors")
    cursors.export(turns.select("collection", "place", "turn", "role", "text"), path, "messages", 3)
    cursors.register(turns.sparkSession)
    return path


def _read_back(turns: DataFrame) -> DataFrame:
    path = _exported(turns)
    return turns.sparkSession.read.format("cursors").option("entity", "messages").load(path).select("collection", "page_no", "place", "turn", "role", "text")


def _streamed_back(turns: DataFrame) -> DataFrame:
    """The same pages as a stream that stops when it has read them all."""
    spark, path = turns.sparkSession, _exported(turns)
    to = tables.new_path(spark, "stream")
    rows = spark.readStream.format("cursors").option("entity", "messages").load(path)
    rows.writeStream.format("parquet").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start(f"{to}/rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{to}/rows").select("collection", "page_no", "place", "turn", "role", "text")


_TURNS = "SELECT CAST(conv_id AS STRING) AS collection, turn AS place, turn, role, text FROM {conversations}"
_PAGED_BACK = "SELECT collection, (row_number() OVER o - 1) // 3 AS page_no, (row_number() OVER o - 1) % 3 AS place, turn, role, text FROM src WINDOW o AS (PARTITION BY collection ORDER BY place)"
register("A1_cursor_source", {"src": _TURNS}, _read_back, _PAGED_BACK)
register("A1_cursor_stream", {"src": _TURNS}, _streamed_back, _PAGED_BACK)
register("A2_collection_filter", {"src": _TURNS}, lambda src: _read_back(src).filter(c("collection").isin("1", "3", "12")), f"SELECT * FROM ({_PAGED_BACK}) WHERE collection IN ('1', '3', '12')")
