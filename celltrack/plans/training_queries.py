"""Queries pN_ of the general data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrack.operators import anomalies, compaction, drift, hierarchy, proximity, regular_grid
from celltrack.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
GRID_VALUES = ("size", "mean", "max")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.proximity_report(table(spark, d, "trackingtable"), table(spark, d, "regions"))


def p3_series(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_grid(table(spark, d, "trackingtable"), "uid", "timestamp", GRID_VALUES)


def p3_readings(spark: SparkSession, d: str) -> DataFrame:
    """The slots of the series that have readings, which filling must leave alone."""
    s = p3_series(spark, d).filter("NOT filled")
    return s.select("uid", "slot_epoch", "readings", *(F.round(F.col(v) + 1e-9, 6).alias(v) for v in GRID_VALUES))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_series(spark, d).filter("filled").select("uid", "slot_epoch")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.Hierarchy(hierarchy.parent_links(table(spark, d, "linked"))).pairs()


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    linked = table(spark, d, "linked")
    return hierarchy.Hierarchy(hierarchy.parent_links(linked), hierarchy.usable_uids(linked)).report()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "spatial_files"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "spatial_files"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return drift.path_changes(table(spark, d, "spatial_files"))


def p5_renames(spark: SparkSession, d: str) -> DataFrame:
    return drift.rename_proposals(table(spark, d, "spatial_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.track_anomalies(table(spark, d, "spatial"), table(spark, d, "linked"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.merged_records(table(spark, d, "features"), table(spark, d, "linked"))


def p7_files(spark: SparkSession, d: str) -> DataFrame:
    return compaction.consolidation(table(spark, d, "features"), table(spark, d, "linked"))


def p7_once(spark: SparkSession, d: str) -> DataFrame:
    return compaction.consolidated(table(spark, d, "features"), table(spark, d, "linked"))


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    return compaction.small_file_plan(table(spark, d, "stored_files"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p3_found, p3_series, p3_readings, p4_found, p4_nodes, p5_found, p5_table, p5_paths, p5_renames, p6_found, p7_found, p7_files, p7_once, p7_plan)}

# The names under which each quantity appears.
NAMES = """('u_opt','u_opt'),('U_OPT','u_opt'),('u-opt','u_opt'),('opt_u','u_opt'),('u_optical','u_opt'),
       ('uOpt','u_opt'),('u_optflow','u_opt'),('u_spl','u_spl'),('u_split','u_spl'),('U_SPL','u_spl'),('uSpl','u_spl'),('u-spl','u_spl'),
       ('spl_u','u_spl'),('method','method'),('vec_method','method'),('best_method','method'),('mtd','method'),('Method','method'),
       ('far','far'),('fa_ratio','far'),('FAR','far'),('farRatio','far'),('false_alarm_ratio','far')"""

P4_LINKS = """
WITH RECURSIVE x AS (
       SELECT uid AS c, unnest(list_concat(coalesce(prv_mrg_uids, []), [CAST(prv_spl_uid AS BIGINT)])) AS p FROM linked),
     e AS (SELECT DISTINCT p, c FROM x WHERE c > 0 AND p > 0 AND p <> c),
     r(a, u) AS (SELECT p, c FROM e UNION SELECT r.a, e.c FROM r JOIN e ON r.u = e.p)"""

SQL: dict[str, str] = {
    "p4_found": P4_LINKS + """
SELECT a AS ancestor_uid, u AS uid FROM r""",
    "p4_nodes": P4_LINKS + """,
     n AS (SELECT p AS v FROM e UNION SELECT c FROM e UNION SELECT uid FROM linked WHERE uid > 0),
     t0 AS (SELECT c AS v, max(p) AS p FROM e GROUP BY c),
     step(v, u) AS (SELECT v, p FROM t0 UNION SELECT step.v, t0.p FROM step JOIN t0 ON step.u = t0.v),
     lead(v) AS (SELECT v FROM step WHERE v IN (SELECT v FROM step WHERE v = u) GROUP BY v HAVING min(u) = v),
     t AS (SELECT v, p FROM t0 WHERE v NOT IN (SELECT v FROM lead)),
     w(v, root, depth, path) AS (
       SELECT v, v, CAST(0 AS BIGINT), CAST(v AS VARCHAR) FROM n WHERE v NOT IN (SELECT v FROM t)
       UNION ALL SELECT t.v, w.root, w.depth + 1, w.path || '/' || t.v FROM w JOIN t ON t.p = w.v),
     tr(a, u) AS (SELECT p, v FROM t UNION ALL SELECT tr.a, t.v FROM tr JOIN t ON t.p = tr.u)
SELECT w.v AS uid, t.p AS parent_uid, w.root AS root_uid, w.depth, w.path,
       (SELECT count(*) FROM tr WHERE tr.a = w.v) AS n_tree, (SELECT count(*) FROM r WHERE r.u = w.v) AS n_ancestors,
       (SELECT count(*) FROM r WHERE r.a = w.v) AS n_descendants, w.v IN (SELECT a FROM r WHERE a = u) AS in_cycle
FROM w LEFT JOIN t ON t.v = w.v""",
    "p3_found": """
WITH s AS (SELECT DISTINCT uid, CAST(floor((epoch(timestamp) + 300) / 600) AS BIGINT) AS k
           FROM trackingtable WHERE uid IS NOT NULL AND timestamp IS NOT NULL),
     g AS (SELECT uid, k, lead(k) OVER (PARTITION BY uid ORDER BY k) AS n FROM s)
SELECT uid, unnest(range(k + 1, n)) * 600 AS slot_epoch FROM g WHERE n > k + 1""",
    "p5_found": """
WITH names(name, field) AS (VALUES """ + NAMES + """),
     k AS (SELECT file, payload, unnest(json_keys(payload)) AS name FROM spatial_files),
     t AS (SELECT file, field, name, CASE json_type(payload, '$."' || name || '"') WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string'
                  WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type FROM k JOIN names USING (name)),
     s AS (SELECT file, field, list_sort(list(DISTINCT name)) AS names,
                  list_sort(list(DISTINCT type) FILTER (type IS NOT NULL)) AS types FROM t GROUP BY ALL),
     f AS (SELECT DISTINCT producer, file, file_ts FROM spatial_files),
     e AS (SELECT f.*, q.field FROM f, (SELECT DISTINCT field FROM names) q),
     j AS (SELECT e.*, s.names, s.types, s.file IS NOT NULL AS present FROM e LEFT JOIN s USING (file, field)),
     l AS (SELECT *, lag(names) OVER w AS pn, lag(types) OVER w AS pt, lag(present) OVER w AS pp FROM j
           WINDOW w AS (PARTITION BY producer, field ORDER BY file_ts, file))
SELECT file, field, 'added' AS change FROM l WHERE present AND NOT pp
UNION ALL SELECT file, field, 'removed' FROM l WHERE NOT present AND pp
UNION ALL SELECT file, field, 'renamed' FROM l WHERE present AND pp AND names <> pn
UNION ALL SELECT file, field, 'retyped' FROM l WHERE present AND pp AND len(types) > 0 AND len(pt) > 0 AND types <> pt""",
    "p7_found": """
SELECT DISTINCT stage, frame, cidx FROM (
  SELECT 'features' AS stage, frame, cidx FROM features
  GROUP BY frame, cidx, list_sort(list_distinct(list_zip(array_y, array_x, array_values))) HAVING count(*) > 1
  UNION ALL
  SELECT 'linked', frame, cidx FROM linked
  GROUP BY frame, cidx, cindex, uid, iuid, threshold_level, lifetime, list_sort(prv_mrg_uids),
           list_sort(prv_mrg_iuids), prv_spl_uid, prv_spl_iuid HAVING count(*) > 1)""",
    "p7_once": """
SELECT 'features' AS stage, frame, cidx, count(DISTINCT list_sort(list_distinct(list_zip(coalesce(array_y, []), coalesce(array_x, []), coalesce(array_values, []))))) AS records FROM features GROUP BY frame, cidx
UNION ALL SELECT 'linked', frame, cidx, count(*) FROM (SELECT DISTINCT frame, cidx, cindex, uid, iuid, threshold_level, lifetime, list_sort(prv_mrg_uids) AS a, list_sort(prv_mrg_iuids) AS b, prv_spl_uid, prv_spl_iuid FROM linked) GROUP BY frame, cidx""",
    "p7_plan": """
SELECT stage, coalesce(nullif(regexp_extract(file, '([0-9]{8})_[0-9]{6}', 1), ''), 'none') AS day,
       count(*) AS n_files, count(*) FILTER (coalesce(n_bytes, 0) < 33554432) AS small_files,
       CAST(sum(coalesce(n_rows, 0)) AS BIGINT) AS n_rows, CAST(sum(coalesce(n_bytes, 0)) AS BIGINT) AS n_bytes,
       CAST(greatest(1, ceil(sum(coalesce(n_bytes, 0)) / 134217728)) AS BIGINT) AS target_files,
       count(*) FILTER (coalesce(n_bytes, 0) < 33554432) > 8 AS rewrite
FROM stored_files GROUP BY ALL""",
    "p3_readings": """
SELECT uid, CAST(floor((epoch(timestamp) + 300) / 600) AS BIGINT) * 600 AS slot_epoch, count(*) AS readings,
       round(avg(CASE WHEN isfinite(CAST(size AS DOUBLE)) THEN size END) + 1e-9, 6) AS size, round(avg(CASE WHEN isfinite(CAST(mean AS DOUBLE)) THEN mean END) + 1e-9, 6) AS mean, round(avg(CASE WHEN isfinite(CAST(max AS DOUBLE)) THEN max END) + 1e-9, 6) AS max
FROM trackingtable WHERE uid IS NOT NULL AND timestamp IS NOT NULL GROUP BY ALL""",
    "p5_paths": """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY file_ts, file) AS n FROM (SELECT DISTINCT producer, file, file_ts FROM spatial_files)),
  t AS (SELECT file, t.fullkey[3:] AS path, CASE t.type WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS type
        FROM spatial_files, json_tree(payload) t WHERE t.parent IS NOT NULL AND NOT contains(t.fullkey, '[')),
  s AS (SELECT file, path, coalesce(array_to_string(list_sort(list(DISTINCT type) FILTER (type IS NOT NULL)), '+'), '') AS types FROM t GROUP BY ALL),
  a AS (SELECT f.producer, f.n, f.file, replace(path, '"', '') AS path, types FROM s JOIN f USING (file)),
  b AS (SELECT *, lag(n) OVER w AS pn, lag(types) OVER w AS pt, lead(n) OVER w AS nn FROM a WINDOW w AS (PARTITION BY producer, path ORDER BY n))
SELECT file, path, 'added' AS change, CAST(NULL AS VARCHAR) AS was FROM b WHERE n > 1 AND (pn IS NULL OR pn < n - 1)
UNION ALL SELECT file, path, 'retyped', pt FROM b WHERE pn = n - 1 AND types <> '' AND pt <> '' AND types <> pt
UNION ALL SELECT f.file, path, 'removed', NULL FROM b JOIN f ON f.producer = b.producer AND f.n = b.n + 1 WHERE nn IS NULL OR nn > b.n + 1""",
    "p5_table": """
WITH names(name, field) AS (VALUES """ + NAMES + """),
  s AS MATERIALIZED (SELECT row_number() OVER () AS id, producer, file, file_ts, rec_no, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM spatial_files),
  k AS (SELECT id, j, unnest(json_keys(j)) AS name FROM s WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'),
  v AS (SELECT id, field, name, json_extract(j, '$."' || name || '"') AS x FROM k JOIN names USING (name)),
  t AS (SELECT id, field, name, trim(CASE json_type(x) WHEN 'ARRAY' THEN json_extract_string(x, '$[0]') WHEN 'OBJECT' THEN json_extract_string(x, '$.value') WHEN 'NULL' THEN NULL ELSE json_extract_string(x, '$') END) AS txt FROM v),
  f AS (SELECT id, field, arg_min(struct_pack(t := txt), name).t AS txt FROM t GROUP BY id, field),
  c AS (SELECT id, field, txt, CASE WHEN field <> 'method' THEN TRY_CAST(trim(replace(replace(txt, '%', ''), ',', '.')) AS DOUBLE) / CASE WHEN txt LIKE '%\\%' ESCAPE '\\' THEN 100 ELSE 1 END END AS num,
        CASE WHEN field = 'method' THEN CASE WHEN TRY_CAST(txt AS INTEGER) IS NOT NULL THEN ['noc','spl','mrg','inc','opt','elp'][TRY_CAST(txt AS INTEGER) + 1] WHEN lower(txt) IN ('noc','spl','mrg','inc','opt','elp') THEN lower(txt) END END AS word FROM f)
SELECT s.producer, s.file, s.file_ts, s.rec_no, max(num) FILTER (field = 'u_opt') AS u_opt, max(num) FILTER (field = 'u_spl') AS u_spl, max(word) FILTER (field = 'method') AS method, max(num) FILTER (field = 'far') AS far,
  CASE WHEN any_value(j) IS NULL THEN ['payload'] ELSE list(field || '=' || txt ORDER BY list_position(['u_opt','u_spl','method','far'], field)) FILTER (txt IS NOT NULL AND num IS NULL AND word IS NULL) END AS failed
FROM s LEFT JOIN c USING (id) GROUP BY s.id, s.producer, s.file, s.file_ts, s.rec_no""",
    "p1_found": r"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS id, cindex, timestamp, threshold_level, region, geometry FROM trackingtable WHERE cindex IS NOT NULL AND geometry IS NOT NULL),
     g AS (SELECT id, geometry FROM t UNION ALL SELECT -region_id, geometry FROM regions WHERE geometry IS NOT NULL),
     b AS (SELECT id, regexp_replace(regexp_replace(geometry, '\(\s*\(\s*\(', '(@', 'g'), '\(\s*\(', '(@', 'g') AS s FROM g),
     r AS (SELECT id, ring, k FROM (SELECT id, unnest(regexp_extract_all(s, '\(\s*[^()]+\)')) AS ring, generate_subscripts(regexp_extract_all(s, '\(\s*[^()]+\)'), 1) AS k FROM b)),
     p AS (SELECT id, k, contains(ring, '@') AS shell, unnest(pts) AS pt, generate_subscripts(pts, 1) AS i, len(pts) AS n
           FROM (SELECT id, k, ring, string_split(trim(regexp_replace(ring, '[()@]', '', 'g')), ',') AS pts FROM r)),
     c AS (SELECT id, k, shell, i, n, TRY_CAST(q[1] AS DOUBLE) AS x, TRY_CAST(q[2] AS DOUBLE) AS y FROM (SELECT *, string_split_regex(trim(pt), '\s+') AS q FROM p)),
     c1 AS (SELECT *, first_value(x) OVER (PARTITION BY id ORDER BY k, i) AS ax FROM c WHERE x IS NOT NULL AND y IS NOT NULL),
     v AS MATERIALIZED (SELECT id, k, shell, i, n, x AS rawx, x - 360 * round_even((x - ax) / 360, 0) AS x, y FROM c1),
     o AS (SELECT id, arg_min(x, k * 1000000 + i) AS ox, arg_min(y, k * 1000000 + i) AS oy FROM v GROUP BY id),
     e AS MATERIALIZED (SELECT v.id, k, shell, rawx, x - ox AS x, y - oy AS y, ox, oy, coalesce(lead(v.x) OVER w, first_value(v.x) OVER w) - ox AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) - oy AS y2,
            coalesce(lead(rawx) OVER w, first_value(rawx) OVER w) AS rawx2 FROM v JOIN o USING (id) WINDOW w AS (PARTITION BY v.id, k ORDER BY i)),
     a AS (SELECT id, k, shell, any_value(ox) AS ox, any_value(oy) AS oy, sum(x * y2 - x2 * y) / 2 AS area, sum((x + x2) * (x * y2 - x2 * y)) / 6 AS sx, sum((y + y2) * (x * y2 - x2 * y)) / 6 AS sy, sum(x) AS tx, sum(y) AS ty, count(*) AS m FROM e GROUP BY id, k, shell HAVING count(*) >= 3),
     m AS (SELECT id, any_value(ox) AS ox, any_value(oy) AS oy, sum(f * area) AS area, sum(f * sx) AS sx, sum(f * sy) AS sy, sum(tx) / sum(m) AS mx, sum(ty) / sum(m) AS my FROM (SELECT *, CASE WHEN area < 0 THEN -1 ELSE 1 END * CASE WHEN shell THEN 1 ELSE -1 END AS f FROM a) GROUP BY id),
     l AS MATERIALIZED (SELECT t.*, ox + CASE WHEN abs(area) < 1e-12 THEN mx ELSE sx / area END AS lon0, oy + CASE WHEN abs(area) < 1e-12 THEN my ELSE sy / area END AS lat FROM m JOIN t USING (id)),
     l2 AS MATERIALIZED (SELECT *, lon0 - 360 * floor((lon0 + 180) / 360) AS lon FROM l),
     bx AS (SELECT id, k, min(rawx) AS x0, max(rawx) AS x1, min(y + oy) AS y0, max(y + oy) AS y1 FROM e WHERE id < 0 GROUP BY id, k),
     h AS (SELECT s.id AS pid, s.cindex, s.region, -s.rid AS region_id FROM (SELECT l2.id, l2.cindex, l2.region, bx.id AS rid, bx.k, bx.x0 + (l2.lon - bx.x0) - 360 * floor((l2.lon - bx.x0) / 360) AS px, l2.lat AS py FROM l2 JOIN bx ON l2.lat BETWEEN bx.y0 AND bx.y1 AND (l2.lon - bx.x0) - 360 * floor((l2.lon - bx.x0) / 360) <= bx.x1 - bx.x0) s
           JOIN e ON e.id = s.rid AND e.k = s.k WHERE ((e.y + oy) > py) <> ((e.y2 + oy) > py) AND px < (rawx2 - rawx) * (py - (e.y + oy)) / (e.y2 - e.y) + rawx GROUP BY s.id, s.cindex, s.region, s.rid HAVING count(*) % 2 = 1)
SELECT DISTINCT 'near' AS kind, least(a.cindex, b.cindex) AS a_id, greatest(a.cindex, b.cindex) AS b_id FROM l2 a JOIN l2 b ON a.timestamp = b.timestamp AND a.threshold_level = b.threshold_level AND a.cindex < b.cindex AND abs(a.lat - b.lat) < 0.55
WHERE 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 60.0
UNION ALL SELECT DISTINCT 'region', h.region_id, h.cindex FROM h JOIN regions r USING (region_id) WHERE h.region IS DISTINCT FROM r.name""",
}
