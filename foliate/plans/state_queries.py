"""Queries of snapshot diffs, lifecycle, state, aggregates and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import urls
from foliate.operators import audit, diff, match, tree
from foliate.plans.registry import ORACLES, QUERIES, register
from foliate.plans.tree_queries import TREE
from foliate.sources.tables import Snapshots, new_path
from foliate.streaming import runs

c = F.col
#: Documents as resources, and the state that an earlier run could have left of them.
CURRENT = "SELECT CAST(doc_id AS STRING) AS id, concat(source, '-', CAST(doc_id AS STRING)) AS title, source AS root_id, lang AS parent_id, concat(source, '/', CAST(doc_id AS STRING), '.md') AS expected_path, sha2(text, 256) AS content_hash, 'v20' AS transform_version FROM {documents}"
STORED = """SELECT CAST(doc_id AS STRING) AS id, concat(source, '-', CAST(doc_id AS STRING), CASE WHEN doc_id % 7 = 0 THEN ' old' ELSE '' END) AS title, source AS root_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS parent_id,
    CASE WHEN doc_id % 10 = 0 THEN concat('old/', CAST(doc_id AS STRING), '.md') WHEN doc_id % 23 = 0 THEN NULL ELSE concat(source, '/', CAST(doc_id AS STRING), '.md') END AS local_path,
    CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE sha2(text, 256) END AS content_hash, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 'v20' END AS transform_version FROM {documents} WHERE doc_id % 5 > 0"""
_DUCK = {"cur": CURRENT.replace("sha2(text, 256)", "sha256(text)"), "old": STORED.replace("sha2(text, 256)", "sha256(text)")}
_DIFF = """, d AS (SELECT c.id, o.id IS NOT NULL AS known, o.local_path IS DISTINCT FROM c.expected_path AS moved,
        list_filter([CASE WHEN o.title IS DISTINCT FROM c.title THEN 'title' END, CASE WHEN o.parent_id IS DISTINCT FROM c.parent_id THEN 'parent' END, CASE WHEN o.root_id IS DISTINCT FROM c.root_id THEN 'root' END,
            CASE WHEN o.content_hash IS DISTINCT FROM c.content_hash THEN 'content' END, CASE WHEN o.transform_version IS DISTINCT FROM c.transform_version THEN 'transform_version' END], lambda x: x IS NOT NULL) AS r FROM cur c LEFT JOIN old o USING (id)),
    e AS (SELECT id, CASE WHEN NOT known THEN 'CREATE' WHEN moved THEN 'MOVE' WHEN len(r) > 0 THEN 'UPDATE' ELSE 'UNCHANGED' END AS action, CASE WHEN NOT known THEN [] WHEN moved THEN list_append(r, 'local_path') ELSE r END AS r FROM d)"""


def both(name: str, build, sql: str) -> None:
    """A query of the current and the stored snapshot; hashes have other names in DuckDB."""
    register(name, {"cur": CURRENT, "old": STORED}, build, None)
    ORACLES[name] = "WITH " + ", ".join(f"{k} AS ({v.replace('{', '').replace('}', '')})" for k, v in _DUCK.items()) + _DIFF + sql


def _flat(r: DataFrame) -> DataFrame:
    return r.select("id", "action", F.array_join("reasons", ",").alias("reasons"))


both("H6_reconcile", lambda cur, old: _flat(diff.reconcile(cur, old)), " SELECT id, action, array_to_string(r, ',') AS reasons FROM e")
both("H7_stored_provenance", lambda cur, old: _flat(diff.reconcile(cur, old.withColumn("transform_version", F.coalesce("transform_version", F.lit(""))))), " SELECT id, action, array_to_string(r, ',') AS reasons FROM e")
both("H8_overrides", lambda cur, old: diff.reconcile(cur, old).withColumn("n", c("id").cast("long")).select("id", diff.override(c("action"), F.lit(False), c("n") % 3 == 0, c("n") % 4 == 0, F.lit(False)).alias("action")), " SELECT id, CASE WHEN action = 'UNCHANGED' AND (CAST(id AS BIGINT) % 3 = 0 OR CAST(id AS BIGINT) % 4 = 0) THEN 'UPDATE' ELSE action END AS action FROM e")
both("H9_regenerates", lambda cur, old: diff.reconcile(cur, old).select("id", diff.regenerates(c("action"), c("reasons")).alias("out")), " SELECT id, action IN ('CREATE', 'UPDATE') OR (action = 'MOVE' AND len(r) > 1) AS out FROM e")
both("H19_census_plan", lambda cur, old: cur.join(old.select("id", "local_path", F.lit(True).alias("known")), "id", "left").select("id", F.when(c("known").isNull(), "CREATE").when(c("local_path").eqNullSafe(c("expected_path")), "UNCHANGED").otherwise("UPDATE").alias("action")), " SELECT id, CASE WHEN NOT known THEN 'CREATE' WHEN moved THEN 'UPDATE' ELSE 'UNCHANGED' END AS action FROM d")
both("H25_asset_plan", lambda cur, old: diff.reconcile(cur, old).filter(diff.regenerates(c("action"), c("reasons"))).select("id", F.arrays_overlap("reasons", F.array(*map(F.lit, ("content", "last_edited_time", "asset")))).alias("force")), " SELECT id, list_has_any(r, ['content', 'last_edited_time', 'asset']) AS force FROM e WHERE action IN ('CREATE', 'UPDATE') OR (action = 'MOVE' AND len(r) > 1)")
both("E1_action_counts", lambda cur, old: diff.counts(diff.reconcile(cur, old)), " SELECT count(*) FILTER (action = 'CREATE') AS n_create, count(*) FILTER (action = 'UPDATE') AS n_update, count(*) FILTER (action = 'MOVE') AS n_move, count(*) FILTER (action = 'TRASH') AS n_trash, count(*) FILTER (action = 'UNCHANGED') AS n_unchanged, count(*) FILTER (action = 'ERROR') AS n_error FROM e")
_PRIOR = "SELECT o_orderkey AS id, concat('R', CAST(o_custkey % 3 AS STRING)) AS root_id, CASE o_orderkey % 9 WHEN 0 THEN 'tombstoned' WHEN 1 THEN 'missing' ELSE 'active' END AS status, CAST(o_orderkey % 3 AS INT) AS missing_count FROM {orders}"
_SEEN = "SELECT o_orderkey AS id, o_orderkey % 19 = 0 AS in_trash FROM {orders} WHERE o_orderkey % 4 > 0"
_ELSE = "SELECT o_orderkey AS id FROM {orders} WHERE o_orderkey % 8 = 0"
_DONE = "SELECT concat('R', CAST(r_regionkey AS STRING)) AS root_id FROM {region} WHERE r_regionkey <> 1"
_H10 = """, x AS (SELECT p.id, missing_count AS m, coalesce(in_trash, false) AS t, s.id IS NOT NULL AS seen, p.id IN (SELECT id FROM other) AS o FROM prior p LEFT JOIN seen_now s USING (id) WHERE status <> 'tombstoned' AND root_id IN (SELECT root_id FROM done)),
    y AS (SELECT id, CASE WHEN t THEN m + 1 WHEN NOT seen AND o THEN NULL WHEN seen THEN CASE WHEN m > 0 THEN 0 END ELSE m + 1 END AS missing_count, CASE WHEN t OR (NOT seen AND NOT o) THEN m + 1 >= 2 ELSE false END AS to_trash, CASE WHEN t THEN 'in_trash' ELSE 'not_found' END AS reason FROM x)"""
_LIFE = {"prior": _PRIOR, "seen_now": _SEEN, "other": _ELSE, "done": _DONE}
register("H10_missing", _LIFE, lambda p, s, o, d: diff.missing(p, s, o, d), _H10 + " SELECT id, missing_count::INT AS missing_count, to_trash, reason FROM y WHERE missing_count IS NOT NULL")
register("H11_trash_reasons", _LIFE, lambda p, s, o, d: diff.missing(p, s, o, d).filter("to_trash").groupBy("reason").agg(F.count("*").alias("n")), _H10 + " SELECT reason, count(*) AS n FROM y WHERE to_trash AND missing_count IS NOT NULL GROUP BY reason")
register("H4_missing_state", _LIFE, lambda p, s, o, d: p.join(diff.missing(p, s, o, d).select("id", c("missing_count").alias("n"), "to_trash"), "id", "left").select("id", F.coalesce("n", "missing_count").alias("missing_count"), F.when(c("n") > 0, "missing").otherwise(c("status")).alias("status")), _H10 + " SELECT p.id, coalesce(y.missing_count, p.missing_count)::INT AS missing_count, CASE WHEN y.missing_count > 0 THEN 'missing' ELSE status END AS status FROM prior p LEFT JOIN y USING (id)")
register("E3_trash_ratio", _LIFE, lambda p, s, o, d: diff.missing(p, s, o, d).agg(F.count_if("to_trash").alias("trash")).crossJoin(p.agg(F.count("*").alias("managed"))).select("trash", "managed", diff.trash_limits(c("trash"), c("managed")).alias("too_much")), _H10 + ", z AS (SELECT (SELECT count(*) FROM y WHERE to_trash AND missing_count IS NOT NULL) AS trash, (SELECT count(*) FROM prior) AS managed) SELECT trash, managed, trash > 50 OR trash / managed > 0.2 AS too_much FROM z")
_OLD_STATE = "SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS local_path, 'run1' AS created_at, CASE WHEN c_custkey % 5 = 0 THEN 'trashed' END AS trash_reason FROM {customer} WHERE c_custkey % 4 > 0"
_NEW_STATE = "SELECT c_custkey AS id, upper(c_name) AS title, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'new' END AS local_path, 'run2' AS created_at, CAST(NULL AS STRING) AS trash_reason FROM {customer} WHERE c_custkey % 6 > 0"
_UPSERT = {"old": _OLD_STATE, "new": _NEW_STATE}
register("H1_resource_upsert", _UPSERT, lambda o, n: diff.upsert(o, n, "id", kept=["local_path", "trash_reason"], frozen=["created_at"]), "SELECT id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(n.local_path, o.local_path) AS local_path, CASE WHEN o.id IS NOT NULL THEN o.created_at ELSE n.created_at END AS created_at, coalesce(n.trash_reason, o.trash_reason) AS trash_reason FROM old o FULL JOIN new n USING (id)")
register("H2_root_upsert", _UPSERT, lambda o, n: diff.upsert(o, n, "id", kept=["local_path"]).select("id", "title", "local_path"), "SELECT id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(n.local_path, o.local_path) AS local_path FROM old o FULL JOIN new n USING (id)")
register("H3_asset_upsert", _UPSERT, lambda o, n: diff.upsert(o, n, "id", frozen=["created_at"]), "SELECT id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.id IS NOT NULL THEN n.local_path ELSE o.local_path END AS local_path, CASE WHEN o.id IS NOT NULL THEN o.created_at ELSE n.created_at END AS created_at, CASE WHEN n.id IS NOT NULL THEN n.trash_reason ELSE o.trash_reason END AS trash_reason FROM old o FULL JOIN new n USING (id)")
_RUNS = "SELECT event_id AS run_id, CAST(event_id % 500 AS STRING) AS started_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'x' END AS finished_at, event_type AS mode, event_id % 2 = 0 AS ok FROM {events}"
register("H5_warning_append", {"old": "SELECT event_id AS ordinal, event_type AS message FROM {events} WHERE event_type = 'error'", "new": "SELECT event_id + 1000000 AS ordinal, event_type AS message FROM {events} WHERE event_type = 'view'"}, lambda o, n: o.unionByName(n), "SELECT * FROM old UNION ALL SELECT * FROM new")
register("E8_latest_run", {"runs": _RUNS}, lambda r: r.agg(F.max_by(F.struct("run_id", "started_at"), F.struct("started_at", "run_id")).alias("r")).select("r.*"), "SELECT run_id, started_at FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1")
register("E9_unfinished_runs", {"runs": _RUNS}, lambda r: r.filter("finished_at is null").select("run_id"), "SELECT run_id FROM runs WHERE finished_at IS NULL")
register("E10_schema_version", {"m": "SELECT CAST(n_nationkey AS BIGINT) AS version FROM {nation}"}, lambda m: m.agg(F.max("version").alias("version")), "SELECT max(version) AS version FROM m")
register("E2_status_counts", {"r": _PRIOR}, audit.status, "SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'tombstoned') AS tombstoned FROM r")
register("H21_missing_list", {"r": _PRIOR}, lambda r: r.filter("status = 'missing'").select("id", "missing_count"), "SELECT id, missing_count FROM r WHERE status = 'missing'")
_ASSET = "SELECT o_custkey AS page, CAST(o_orderkey AS STRING) AS key, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS url, o_orderstatus AS hash, CASE WHEN o_orderkey % 5 = 0 THEN 'unverified' ELSE 'usable' END AS cache_status FROM {orders}"
register("E4_asset_fingerprint", {"a": _ASSET}, match.fingerprint, """SELECT page, string_agg(j, '|' ORDER BY j) AS fingerprint FROM (SELECT page, chr(123) || '"key":"' || key || '"' || CASE WHEN url IS NULL THEN '' ELSE ',"url":"' || url || '"' END || ',"hash":"' || hash || '"' || chr(125) AS j FROM a WHERE cache_status <> 'unverified') GROUP BY page""")
_LEFT, _RIGHT = "SELECT l_returnflag AS x, l_linestatus AS y FROM {lineitem} WHERE l_orderkey % 2 = 0", "SELECT l_returnflag AS x, l_linestatus AS y FROM {lineitem} WHERE l_orderkey % 2 = 1"
register("E5_multiset_difference", {"a": _LEFT, "b": _RIGHT}, lambda a, b: _signed_counts(a, b), "SELECT x, y, sum(n)::BIGINT AS surplus FROM (SELECT x, y, 1 AS n FROM a UNION ALL SELECT x, y, -1 FROM b) GROUP BY ALL HAVING sum(n) <> 0")
_PLANNED_SET = "SELECT l_orderkey AS page, l_returnflag AS x, l_linestatus AS y FROM {lineitem}"
_APPLIED_SET = "SELECT l_orderkey AS page, l_returnflag AS x, CASE WHEN l_partkey % 50 = 0 THEN 'Z' ELSE l_linestatus END AS y FROM {lineitem}"
register("H13_plan_apply_equality", {"a": _PLANNED_SET, "b": _APPLIED_SET}, lambda a, b: _equal_sets(a, b), "SELECT page, bool_and(s = 0) AS equal FROM (SELECT page, x, y, sum(n) AS s FROM (SELECT page, x, y, 1 AS n FROM a UNION ALL SELECT page, x, y, -1 FROM b) GROUP BY ALL) GROUP BY page")
register("E7_warning_totals", {"w": "SELECT user_id AS root, event_type AS t, user_id % 2 = 0 AS strict FROM {events}"}, lambda w: w.groupBy("root", "strict").agg(F.count_if(c("t") == "error").alias("n")).select("root", "n", (c("strict") & (c("n") > 0)).alias("failed")), "SELECT root, count(*) FILTER (t = 'error') AS n, bool_and(strict) AND count(*) FILTER (t = 'error') > 0 AS failed FROM w GROUP BY root")
register("E11_owner_sets", {"p": "SELECT p_brand AS path, p_partkey AS id, p_type AS t FROM {part}"}, lambda p: p.groupBy(F.lower(F.concat("path", F.lit("/"), "t")).alias("k")).agg(F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("owners")), "SELECT lower(path || '/' || t) AS k, string_agg(id::VARCHAR, ',' ORDER BY id) AS owners FROM (SELECT DISTINCT path, t, id FROM p) GROUP BY 1")
register("E12_best_outcome", {"o": "SELECT user_id AS key, CASE event_id % 3 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'verified' ELSE 'remote' END AS outcome, event_id AS place FROM {events} WHERE event_id % 4 > 0 OR user_id % 2 = 0"}, match.best_outcome, "SELECT key, outcome, place FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE outcome WHEN 'downloaded' THEN 2 WHEN 'verified' THEN 1 ELSE 0 END DESC, place) = 1")
register("E13_smallest_reason", {"o": "SELECT user_id AS key, event_type AS reason FROM {events}"}, lambda o: o.groupBy("key").agg(F.min("reason").alias("reason")), "SELECT key, min(reason) AS reason FROM o GROUP BY key")
register("E14_all_ok", {"r": _RUNS}, lambda r: r.groupBy("mode").agg(F.bool_and("ok").alias("ok")), "SELECT mode, bool_and(ok) AS ok FROM r GROUP BY mode")
_TICKS = "SELECT user_id AS run, event_id AS n, CAST(event_id * 7 % 1000 AS BIGINT) AS d FROM {events}"
register("E15_progress", {"t": _TICKS}, lambda t: _progress(t), None)
_SETS = {"a": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'", "b": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'O'"}
register("S1_concatenation", _SETS, lambda a, b: a.unionByName(b), "SELECT k FROM a UNION ALL SELECT k FROM b")
register("S2_difference", _SETS, lambda a, b: a.subtract(b), "SELECT k FROM a EXCEPT SELECT k FROM b")
register("S3_multiset", _SETS, lambda a, b: a.exceptAll(b), "SELECT k FROM a EXCEPT ALL SELECT k FROM b")
_PLAN = "SELECT CAST(l_orderkey AS STRING) AS id, CASE l_linenumber % 3 WHEN 0 THEN 'WRITE' WHEN 1 THEN 'MOVE' ELSE 'TRASH' END AS kind, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_partkey % 97 = 0 THEN '../x.md' ELSE concat(l_returnflag, CAST(l_orderkey AS STRING), '.md') END AS source_path, CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE concat(CASE WHEN l_partkey % 2 = 0 THEN 'A' ELSE 'a' END, CAST(l_partkey AS STRING), '.md') END AS target_path, CASE WHEN l_partkey % 89 = 0 THEN 'unmanaged' ELSE 'managed' END AS target_state, l_suppkey % 50 > 0 AS managed FROM {lineitem}"
register("H12_violations", {"p": _PLAN}, lambda p: diff.violations(p, False, 100_000).groupBy("rule").agg(F.count("*").alias("n")), """, v AS (SELECT 'unmanaged_write' AS rule FROM p WHERE kind = 'WRITE' AND target_state = 'unmanaged' UNION ALL SELECT 'outside_root' FROM p WHERE source_path LIKE '../%' UNION ALL SELECT 'unmanaged_destructive' FROM p WHERE kind IN ('MOVE', 'TRASH') AND NOT managed
    UNION ALL SELECT 'partial_trash' FROM p WHERE kind = 'TRASH' UNION ALL SELECT 'shared_output' FROM (SELECT DISTINCT id FROM p WHERE kind IN ('WRITE', 'MOVE') AND lower(target_path) IN (SELECT lower(target_path) FROM p WHERE kind IN ('WRITE', 'MOVE') GROUP BY 1 HAVING count(DISTINCT id) > 1))
    UNION ALL SELECT 'too_much_trash' WHERE (SELECT count(*) FROM p WHERE kind = 'TRASH') > 50) SELECT rule, count(*) AS n FROM v GROUP BY rule""")
_OUT = "SELECT event_id AS k, event_id % 2 = 0 AS present, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS now, CASE event_id % 5 WHEN 0 THEN 'a' ELSE 'b' END AS new, CASE event_id % 7 WHEN 0 THEN NULL ELSE 'c' END AS old, event_id % 11 > 5 AS managed FROM {events}"
register("H15_commit_decision", {"o": _OUT}, lambda o: o.select("k", match.commit_decision(c("present"), c("now"), c("new"), c("old")).alias("out")), "SELECT k, CASE WHEN NOT present THEN 'claim' WHEN now = new THEN 'adopt' WHEN coalesce(now = old, false) THEN 'replace' ELSE 'conflict' END AS out FROM o")
register("A13_write_decision", {"o": _OUT}, lambda o: o.select("k", F.when(c("present") & (c("now") == c("new")), "unchanged").when(c("present"), "replace").otherwise("claim").alias("out")), "SELECT k, CASE WHEN present AND now = new THEN 'unchanged' WHEN present THEN 'replace' ELSE 'claim' END AS out FROM o")
_FETCHED = "SELECT p_partkey AS k, concat(p_name, CASE p_size % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.PDF' ELSE '.exe' END) AS name, CASE p_size % 4 WHEN 0 THEN 'image/png; q=1' WHEN 1 THEN 'APPLICATION/pdf' ELSE '' END AS mime, CAST(p_partkey * 100000 AS BIGINT) AS size, p_size % 5 > 0 AS hosted FROM {part}"
register("A15_download_policy", {"o": _FETCHED}, lambda o: o.select("k", F.when(~urls.may_download(F.when(c("hosted"), "notion").otherwise("external"), F.lit(False)), "not_eligible").when(~urls.allowed_type(c("name"), c("mime"), [".png", ".pdf"], ["image/png", "application/pdf"]), "type").when(c("size") > 100 << 20, "size").otherwise("ok").alias("out")), "SELECT k, CASE WHEN NOT hosted THEN 'not_eligible' WHEN NOT (regexp_matches(name, '[.](png|pdf)$', 'i') AND lower(trim(split_part(mime, ';', 1))) IN ('image/png', 'application/pdf')) THEN 'type' WHEN size > 104857600 THEN 'size' ELSE 'ok' END AS out FROM o")
register("H16_target_state", {"o": _OUT}, lambda o: o.select("k", match.target_state(c("present"), c("managed")).alias("out")), "SELECT k, CASE WHEN NOT present THEN 'ready' WHEN managed THEN 'deferred' ELSE 'conflict' END AS out FROM o")
register("H14_apply_outcome", {"o": _OUT}, lambda o: o.select("k", F.when(c("present") & (c("now") == c("new")), "verified").when(c("managed"), "downloaded").otherwise("remote").alias("outcome"), F.when(~c("managed") & ~(c("present") & (c("now") == c("new"))), "unverified").otherwise("usable").alias("cache_status")), "SELECT k, CASE WHEN present AND now = new THEN 'verified' WHEN managed THEN 'downloaded' ELSE 'remote' END AS outcome, CASE WHEN NOT managed AND NOT (present AND now = new) THEN 'unverified' ELSE 'usable' END AS cache_status FROM o")
_VF = "SELECT concat(p_brand, '/', CAST(p_partkey AS STRING), '.md') AS path, p_size % 25 = 0 AS symlink, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('x', CAST(p_partkey AS STRING)) ELSE CAST(p_partkey AS STRING) END AS marker_id, CASE WHEN p_partkey % 7 = 0 THEN 'edited' ELSE p_type END AS body_hash FROM {part} WHERE p_partkey % 8 > 0"
_VR = "SELECT CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 9 = 0 THEN 'elsewhere.md' ELSE concat(p_brand, '/', CAST(p_partkey AS STRING), '.md') END AS local_path, 'e.md' AS expected_path, CASE WHEN p_partkey % 10 = 0 THEN 'tombstoned' ELSE 'active' END AS status, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS content_hash FROM {part}"
_VA = "SELECT concat('_assets/', CAST(s_suppkey AS STRING)) AS local_path, CAST(s_nationkey AS STRING) AS page_id FROM {supplier}"
_VAF = "SELECT concat('_assets/', CAST(s_suppkey AS STRING)) AS path FROM {supplier} WHERE s_suppkey % 3 > 0"
_VERIFY = {"f": _VF, "r": _VR, "a": _VA, "af": _VAF}
_VSQL = """, j AS (SELECT f.path, marker_id AS id, CASE WHEN symlink THEN 'symlink' WHEN marker_id IS NULL THEN 'unmanaged' WHEN r.id IS NULL THEN 'orphan_managed_file' WHEN local_path <> f.path THEN 'state_mismatch' WHEN content_hash IS NOT NULL AND content_hash <> body_hash THEN 'content_mismatch' END AS type FROM f LEFT JOIN r ON r.id = f.marker_id),
    v AS (SELECT type, path, id FROM j WHERE type IS NOT NULL UNION ALL SELECT 'missing_file', coalesce(local_path, expected_path), id FROM r WHERE status = 'active' AND id NOT IN (SELECT id FROM j WHERE id IS NOT NULL AND (type IS NULL OR type = 'content_mismatch')) UNION ALL SELECT 'missing_asset', local_path, page_id FROM a WHERE local_path NOT IN (SELECT path FROM af))"""
register("H17_verify", _VERIFY, audit.verify, _VSQL + " SELECT * FROM v")
register("H17_verify_summary", _VERIFY, lambda *x: audit.verify(*x).groupBy("type").agg(F.count("*").alias("n")), _VSQL + " SELECT type, count(*) AS n FROM v GROUP BY type")
_CF = "SELECT CASE l_linenumber % 3 WHEN 0 THEN concat('.trash/', CAST(l_partkey AS STRING), '.md') WHEN 1 THEN concat('e/', CAST(l_partkey AS STRING), '.md') ELSE concat('l/', CAST(l_partkey AS STRING), '.md') END AS path, CAST(l_partkey AS STRING) AS id, l_quantity > 48 AS temporary, CASE WHEN l_suppkey % 2 = 0 THEN 'h' ELSE 'g' END AS content_hash, l_suppkey % 3 AS inode FROM {lineitem}"
_CR = "SELECT CAST(p_partkey AS STRING) AS id, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('l/', CAST(p_partkey AS STRING), '.md') ELSE concat('e/', CAST(p_partkey AS STRING), '.md') END AS local_path, concat('e/', CAST(p_partkey AS STRING), '.md') AS expected_path, 'h' AS content_hash FROM {part} WHERE p_partkey % 7 > 0"
register("H18_crash_findings", {"f": _CF.replace("SELECT CASE", "SELECT DISTINCT CASE"), "r": _CR}, lambda f, r: audit.recover(match.first_of(f, ["path", "id"], ["temporary", "content_hash", "inode"]), r).groupBy("type").agg(F.count("*").alias("n")), """
    , g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY path, id ORDER BY temporary, content_hash, inode) = 1), s AS (SELECT * FROM g WHERE NOT temporary),
    x AS (SELECT r.*, (SELECT min(path) FROM s WHERE s.id = r.id AND path = r.expected_path) AS e, (SELECT min(path) FROM s WHERE s.id = r.id AND path = r.local_path) AS l, (SELECT min(content_hash) FROM s WHERE s.id = r.id AND path = r.local_path) AS lh, (SELECT min(inode) FROM s WHERE s.id = r.id AND path = r.local_path) AS li, (SELECT min(path) FROM s WHERE s.id = r.id AND path LIKE '.trash/%') AS t FROM r),
    y AS (SELECT *, (SELECT min(path) FROM s WHERE s.id = x.id AND path LIKE '.trash/%' AND inode = x.li) AS lt FROM x),
    z AS (SELECT CASE WHEN t IS NOT NULL AND e IS NULL AND l IS NULL THEN ['trash_relinked'] WHEN l IS NOT NULL AND local_path = expected_path AND lt IS NOT NULL THEN ['trash_relinked', 'duplicate_removed'] WHEN e IS NOT NULL AND local_path IS DISTINCT FROM expected_path THEN CASE WHEN l IS NOT NULL THEN ['move_relinked', 'duplicate_removed'] ELSE ['move_relinked'] END WHEN l IS NOT NULL THEN CASE WHEN lh <> content_hash THEN ['content_relinked'] ELSE [] END ELSE ['missing_file'] END AS k FROM y),
    w AS (SELECT unnest(k) AS type FROM z UNION ALL SELECT 'tmp_removed' FROM g WHERE temporary AND id IN (SELECT id FROM r) UNION ALL SELECT 'orphan_managed_file' FROM s WHERE id NOT IN (SELECT id FROM r)) SELECT type, count(*) AS n FROM w GROUP BY type""")
register("H23_tombstones", _LIFE, lambda p, s, o, d: diff.missing(p, s, o, d).filter("to_trash").select("id", F.concat(F.lit(".trash/2024-01-01/"), c("id").cast("string"), F.lit(".md")).alias("path"), "reason"), _H10 + " SELECT id, '.trash/2024-01-01/' || id || '.md' AS path, reason FROM y WHERE to_trash AND missing_count IS NOT NULL")
both("H24_moves", lambda cur, old: diff.reconcile(cur, old).filter("action = 'MOVE'").join(old.select("id", "local_path"), "id").join(cur.select("id", "expected_path"), "id").select("id", c("local_path").alias("source_path"), c("expected_path").alias("target_path")), " SELECT e.id, o.local_path AS source_path, c.expected_path AS target_path FROM e JOIN old o USING (id) JOIN cur c USING (id) WHERE action = 'MOVE'")
register("H26_migrations", {"m": "SELECT CAST(n_nationkey AS BIGINT) AS version, n_name AS name FROM {nation}", "done": "SELECT CAST(r_regionkey AS BIGINT) AS version FROM {region}"}, lambda m, done: m.join(done, "version", "left_anti"), "SELECT version, name FROM m ANTI JOIN done USING (version)")
register("A12_state_swap", _UPSERT, lambda o, n: diff.upsert(o, n, "id", kept=["local_path"]).agg(F.count("*").alias("n"), F.count("local_path").alias("placed")), "SELECT count(*) AS n, count(coalesce(n.local_path, o.local_path)) AS placed FROM old o FULL JOIN new n USING (id)")


def _equal_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """``page, equal``: whether both sides hold the same ``x, y`` of a page equally often."""
    marked = a.withColumn("n", F.lit(1)).unionByName(b.withColumn("n", F.lit(-1)))
    return marked.groupBy("page", "x", "y").agg(F.sum("n").alias("s")).groupBy("page").agg(F.bool_and(c("s") == 0).alias("equal"))


def _new_state(spark: SparkSession) -> Snapshots:
    return Snapshots(spark, new_path(spark, "state"))


def _committed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The resources as read back after two runs: the old ones, then the new ones merged into what the first left."""
    state = _new_state(old.sparkSession)
    state.commit({"resources": old})
    state.commit({"resources": diff.upsert(state.read("resources"), new, "id", kept=["local_path"])})
    return state.read("resources").select("id", "title", "local_path", F.lit(state.latest()).cast("long").alias("run"))


def _migrated(old: DataFrame) -> DataFrame:
    """A ladder of two steps, given in the wrong order and climbed twice; the second needs what the first adds."""
    state = _new_state(old.sparkSession)
    state.commit({"resources": old.select("id", "title")})
    steps = {
        2: lambda t: {"resources": t["resources"].withColumn("label", F.concat("status", F.lit("-"), "title"))},
        1: lambda t: {"resources": t["resources"].withColumn("status", F.lit("active"))},
    }
    state.migrate(steps)
    state.migrate(steps)
    versions = state.read("schema_migrations").agg(F.count("*").alias("versions"), F.max("version").alias("version"))
    return state.read("resources").select("id", "label", F.lit(state.latest()).cast("long").alias("run")).crossJoin(F.broadcast(versions))


#: Parameters of the runs below: any number may go, but a fifth at most.
LIMITS = runs.Limits(grace=2, most_ratio=0.2, most_count=1 << 40)


def _censuses(src: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A whole census, and the one in which some pages have other titles."""
    whole = src.select("k", "id", "root_id", "title", F.concat("root_id", F.lit("/"), "title", F.lit(".md")).alias("expected_path"), F.lit(False).alias("in_trash"), F.col("text").alias("markdown"))
    renamed = whole.withColumn("title", F.when(F.col("k") % 10 == 4, F.concat("title", F.lit(" new"))).otherwise(c("title"))).withColumn("expected_path", F.concat("root_id", F.lit("/"), "title", F.lit(".md")))
    return whole, renamed


def _four_runs(src: DataFrame) -> DataFrame:
    """The state after four censuses: whole, with some pages gone, some of them back and others renamed, and the same again; a tombstone isn't counted on."""
    state = _new_state(src.sparkSession)
    digit = F.col("k") % 10
    whole, renamed = _censuses(src)
    for n, census in enumerate([whole, whole.filter(~digit.isin(3, 5)), renamed.filter(digit != 3), renamed.filter(digit != 3)]):
        runs.apply_run(state, census.drop("k", "markdown"), n, LIMITS)
    return state.read("resources").select("id", "title", "local_path", "status", c("missing_count").cast("long").alias("missing_count"))


def _refused_run(src: DataFrame) -> DataFrame:
    """The state after a third of all pages was missing twice: the second run would trash too much, so it leaves what the first one left."""
    state = _new_state(src.sparkSession)
    whole, renamed = _censuses(src)
    runs.apply_run(state, whole.drop("k"), 0, LIMITS)
    runs.apply_run(state, whole.filter("k % 3 > 0").drop("k"), 1, LIMITS)
    try:
        runs.apply_run(state, renamed.filter("k % 3 > 0").drop("k"), 2, LIMITS)
        refused = False
    except diff.Refused:
        refused = True
    return state.read("resources").select("id", "title", "status", c("missing_count").cast("long").alias("missing_count"), F.lit(refused).alias("refused"))


def _rewritten_pages(src: DataFrame) -> DataFrame:
    """The bodies after two runs, the second with one text in ten changed: only those are rewritten."""
    state = _new_state(src.sparkSession)
    whole, _ = _censuses(src)
    marked = whole.withColumn("markdown", F.concat(F.lit('<callout type="tip">A</callout>\n\n'), "markdown"))
    runs.apply_run(state, marked.drop("k"), 0, LIMITS)
    changed = marked.withColumn("markdown", F.when(F.col("k") % 10 == 7, F.concat(F.lit("<synced_block>B</synced_block>\n\n"), "markdown")).otherwise(c("markdown")))
    runs.apply_run(state, changed.drop("k"), 1, LIMITS)
    rewritten = state.read("runs").filter("batch = 1").select("n_rewritten")
    return state.read("bodies").select("id", "body").join(F.broadcast(rewritten))


register("A12_commit_read_back", _UPSERT, _committed, "SELECT id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(n.local_path, o.local_path) AS local_path, 2::BIGINT AS run FROM old o FULL JOIN new n USING (id)")
register("H26_ladder", {"old": _OLD_STATE}, _migrated, "SELECT id, 'active-' || title AS label, 3::BIGINT AS run, 2::BIGINT AS versions, 2::BIGINT AS version FROM old")
_PAGES = "SELECT doc_id AS k, CAST(doc_id AS STRING) AS id, lang AS root_id, concat(source, '-', CAST(doc_id AS STRING)) AS title, text FROM {documents}"
register("runs_over_snapshots", {"src": _PAGES}, _four_runs, """, x AS (SELECT *, CASE WHEN k % 10 = 4 THEN title || ' new' ELSE title END AS t FROM src)
    SELECT id, t AS title, root_id || '/' || t || '.md' AS local_path, CASE WHEN k % 10 = 3 THEN 'tombstoned' ELSE 'active' END AS status, (CASE WHEN k % 10 = 3 THEN 2 ELSE 0 END)::BIGINT AS missing_count FROM x""")
register("runs_refused", {"src": _PAGES}, _refused_run, "SELECT id, title, CASE WHEN k % 3 = 0 THEN 'missing' ELSE 'active' END AS status, (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS missing_count, true AS refused FROM src")
register("runs_rewritten", {"src": _PAGES}, _rewritten_pages, "SELECT id, CASE WHEN k % 10 = 7 THEN 'B' || chr(10) || chr(10) ELSE '' END || '> [!tip]' || chr(10) || '> A' || chr(10) || chr(10) || text AS body, (SELECT count(*) FROM src WHERE k % 10 = 7) AS n_rewritten FROM src")


def _signed_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the surplus of the first; a hot row is one row of each task."""
    marked = a.withColumn("n", F.lit(1)).unionByName(b.withColumn("n", F.lit(-1)))
    return marked.groupBy("x", "y").agg(F.sum("n").alias("surplus")).filter("surplus <> 0")


def _progress(ticks: DataFrame, gap: int = 500) -> DataFrame:
    """Of each run, the ticks at which at least ``gap`` has passed since the last one that counted."""
    def run(pdf):
        keep, last = [], 0
        now = 0
        for n, d in zip(pdf["n"], pdf["d"], strict=True):
            now += d
            if now - last >= gap:
                keep.append(n)
                last = now
        return pdf[pdf["n"].isin(keep)][["run", "n"]]

    return ticks.groupBy("run").applyInPandas(lambda pdf: run(pdf.sort_values("n")), "run long, n long")


def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: census walk, paths, diff against the stored snapshot, and the counts of its actions."""
    from foliate.sources.tables import select

    nodes = select(spark, sf_dir, TREE)
    planned = tree.paths(tree.filenames(nodes))
    current = nodes.join(planned, "id").select("id", "title", "parent_id", c("path").alias("expected_path"))
    key = F.substring("id", 2, 20).cast("long")
    stored = current.filter(key % 11 != 0).select("id", F.when(key % 7 == 0, F.concat("title", F.lit(" old"))).otherwise(c("title")).alias("title"), "parent_id", F.when(key % 10 == 0, F.concat(F.lit("old/"), "expected_path")).otherwise(c("expected_path")).alias("local_path"))
    return diff.reconcile(current, stored).groupBy("action").agg(F.count("*").alias("n"))


QUERIES["minimum_slice"] = minimum_slice
ORACLES["minimum_slice"] = "WITH RECURSIVE nodes AS (" + TREE.replace("{", "").replace("}", "") + """), walk AS (SELECT id, title, parent_id, title AS stem FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.id, n.title, n.parent_id, stem || '/' || n.title FROM nodes n JOIN walk w ON n.parent_id = w.id),
    x AS (SELECT CAST(substr(id, 2) AS BIGINT) AS k FROM walk) SELECT CASE WHEN k % 11 = 0 THEN 'CREATE' WHEN k % 10 = 0 THEN 'MOVE' WHEN k % 7 = 0 THEN 'UPDATE' ELSE 'UNCHANGED' END AS action, count(*) AS n FROM x GROUP BY 1"""
