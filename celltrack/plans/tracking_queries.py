"""Queries of the tracking engine over the event grid, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from celltrack.operators import tracking as T
from celltrack.plans.fixture import Grid, grid, prelude
from celltrack.runtime import table
from celltrack.sources import frames as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
P = prelude()
GAP = prelude("10, 11, 30", "20")
DB = prelude(radius=2, floor=3)
K = T.KEY


def query(sql: str | None = None, pre: str = P, fixture: str = "plain"):
    """Register a query over the grid; ``sql`` is the final SELECT after the prelude."""

    def put(f: Callable[[Grid], DataFrame]) -> Callable[[Grid], DataFrame]:
        QUERIES[f.__name__] = lambda spark, d: f(grid(spark, d, fixture))
        if sql is not None:
            SQL[f.__name__] = pre + sql
        return f

    return put


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


def off(*cols: str) -> list:
    """Rounded a little off the halves that short decimals average to, where the order of a sum would decide."""
    return [F.round(F.col(c) + 1e-9, 6).alias(c) for c in cols]


@query("SELECT frame, ts, count(value) AS n_cells, max(value) AS peak FROM fr LEFT JOIN cell USING (frame) GROUP BY ALL")
def src_frames(g: Grid) -> DataFrame:
    return g.frames.join(g.cells, "frame", "left").groupBy("frame", "ts").agg(F.count("value").alias("n_cells"), F.max("value").alias("peak"))


@query("SELECT frame, count(*) AS n FROM cell JOIN fr USING (frame) WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10' GROUP BY ALL")
def src_interval(g: Grid) -> DataFrame:
    f = g.frames.filter(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-10").cast("timestamp_ntz")))
    return g.cells.join(f.select("frame"), "frame").groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT frame, ts FROM fr WHERE ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC LIMIT 5")
def src_last(g: Grid) -> DataFrame:
    return S.last_frames(g.frames, 5, "2024-01-20")


PATTERNS = ((r"(\d{8}_\d{6})", "yyyyMMdd_HHmmss"), (r"(\d{4}/\d{2}/\d{2}/\d{6})", "yyyyMMddHHmmss"))


def src_timestamp(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "frames").select("frame", "file").distinct()
    return f.select("frame", "file", F.unix_seconds(S.file_timestamp(F.col("file"), PATTERNS)).alias("epoch"))


QUERIES["src_timestamp"] = src_timestamp
SQL["src_timestamp"] = r"""
SELECT DISTINCT frame, file, CAST(epoch(coalesce(try_strptime(regexp_extract(file, '(\d{8}_\d{6})', 1), '%Y%m%d_%H%M%S'),
  try_strptime(replace(regexp_extract(file, '(\d{4}/\d{2}/\d{2}/\d{6})', 1), '/', ''), '%Y%m%d%H%M%S'))) AS BIGINT) AS epoch FROM frames"""


def _seg(name: str, op: str, sql_op: str, threshold: float) -> None:
    def run(g: Grid) -> DataFrame:
        return g.cells.filter(T.passes(F.col("value"), op, threshold)).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * g.width + F.col("x")).alias("code"))

    run.__name__ = name
    query(f"SELECT frame, count(*) AS n, CAST(sum(CAST(y AS BIGINT) * w + x) AS BIGINT) AS code FROM cell, w WHERE value {sql_op} {threshold} GROUP BY frame")(run)


for _n, _o, _s, _t in (("seg_ge", ">=", ">=", 80.0), ("seg_le", "<=", "<=", 80.0), ("seg_gt", ">", ">", 120.0), ("seg_lt", "<", "<", 120.0), ("seg_eq", "==", "=", 100.0), ("seg_ne", "!=", "<>", 100.0)):
    _seg(_n, _o, _s, _t)


@query("SELECT frame, level, count(*) AS n FROM px GROUP BY ALL")
def seg_multi(g: Grid) -> DataFrame:
    return g.pixels.groupBy("frame", "level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT frame, level, label, y, x FROM lab")
def cc_ndimage(g: Grid) -> DataFrame:
    return g.labelled.select(*K, "y", "x")


@query("SELECT frame, level, label, y, x FROM lab", DB, "dbscan")
def cc_dbscan(g: Grid) -> DataFrame:
    return g.labelled.select(*K, "y", "x")


@query("SELECT frame, level, count(*) AS clusters, min(size) AS smallest, max(size) AS largest FROM clus GROUP BY ALL")
def cc_minsize(g: Grid) -> DataFrame:
    return g.feats.groupBy("frame", "level").agg(F.count(F.lit(1)).alias("clusters"), F.min("size").alias("smallest"), F.max("size").alias("largest"))


@query("SELECT frame, level, label, size, min, round(mean + 1e-9, 6) AS mean, max, round(std + 1e-9, 6) AS std, xmin, xmax, ymin, ymax FROM clus")
def features(g: Grid) -> DataFrame:
    return g.feats.select(*K, "size", "min", *off("mean"), "max", *off("std"), "xmin", "xmax", "ymin", "ymax")


@query("SELECT frame, level, label, list(y ORDER BY y, x) AS array_y, list(x ORDER BY y, x) AS array_x, list(value ORDER BY y, x) AS array_values FROM lab GROUP BY ALL")
def features_arrays(g: Grid) -> DataFrame:
    return T.pixel_arrays(g.labelled)


@query("SELECT frame, level, label, round(cx, 6) AS cx, round(cy, 6) AS cy FROM clus")
def centroid(g: Grid) -> DataFrame:
    return g.feats.select(*K, *r6("cx", "cy"))


@query("SELECT frame, prev_frame, gap_min FROM fp")
def frame_pairs(g: Grid) -> DataFrame:
    return g.pairs


@query("SELECT frame, level, label, prev_frame, prev_label, shared, size, prev_size, round(overlap, 6) AS overlap FROM ov")
def overlay(g: Grid) -> DataFrame:
    return g.edges.select(*K, "prev_frame", "prev_label", "shared", "size", "prev_size", *r6("overlap"))


def _status(name: str, where: str) -> None:
    cols = "frame, level, label, status, prev_frame, past_label, merge_labels, split_parent"

    def run(g: Grid) -> DataFrame:
        return g.ev.select(*cols.split(", ")).filter(where)

    run.__name__ = name
    query(f"SELECT {cols} FROM ev WHERE {where}")(run)


for _n, _w in (("evt_con", "status = 'CON'"), ("evt_merge", "merge_labels IS NOT NULL"), ("evt_split", "status = 'SPL'"), ("evt_newspl", "status = 'NEW/SPL'"), ("evt_mrgspl", "status = 'MRG/SPL'"), ("spatial", "frame >= 0")):
    _status(_n, _w)


@query("SELECT frame, level, status, count(*) AS n FROM ev GROUP BY ALL")
def evt_all(g: Grid) -> DataFrame:
    return g.ev.groupBy("frame", "level", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT frame, level, status, count(*) AS n FROM ev GROUP BY ALL", GAP, "gap")
def evt_gap(g: Grid) -> DataFrame:
    return g.ev.groupBy("frame", "level", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT frame, level, label, count(*) AS n, list_sort(list(in_label)) AS inner_labels FROM ins GROUP BY ALL")
def inside(g: Grid) -> DataFrame:
    return g.nested.groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("in_label")).alias("inner_labels"))


def _vec(name: str, u: str, v: str, su: str, sv: str) -> None:
    def run(g: Grid) -> DataFrame:
        plain = lambda c: F.when(F.round(c, 6) == 0, 0.0).otherwise(F.round(c, 6)).alias(c)  # no negative zero
        return g.vecs.filter(F.col(u).isNotNull()).select(*K, plain(u), plain(v))

    run.__name__ = name
    z = lambda c: f"CASE WHEN round({c}, 6) = 0 THEN CAST(0 AS DOUBLE) ELSE round({c}, 6) END"
    query(f"SELECT frame, level, label, {z(su)} AS {u}, {z(sv)} AS {v} FROM vec WHERE {su} IS NOT NULL")(run)


for _n, _u, _v, _su, _sv in (("vec_uv", "u_", "v_", "u_", "v_"), ("vec_spl", "u_spl", "v_spl", "u_spl", "v_spl"), ("vec_mrg", "u_mrg", "v_mrg", "u_mrg", "v_mrg"), ("vec_inc", "u_inc", "v_inc", "u_inc", "v_inc"), ("vec_elp", "u_elp", "v_elp", "u_", "v_")):
    _vec(_n, _u, _v, _su, _sv)


@query("SELECT frame, level, label, round(expansion, 6) AS expansion FROM vec WHERE expansion IS NOT NULL")
def expansion(g: Grid) -> DataFrame:
    return g.vecs.filter("expansion IS NOT NULL").select(*K, *r6("expansion"))


@query(", one AS (SELECT e.frame, e.level, e.label, c.size, e.prev_frame, e.past_label, p.size AS psize, (SELECT sum(m.size) FROM clus m WHERE m.frame = e.prev_frame AND m.level = e.level AND list_contains(e.merge_labels, m.label)) AS ms FROM ev e JOIN clus c USING (frame, level, label) JOIN clus p ON p.frame = e.prev_frame AND p.level = e.level AND p.label = e.past_label), nw AS (SELECT e.prev_frame, e.level, e.split_parent, sum(c.size) AS ns FROM ev e JOIN clus c USING (frame, level, label) WHERE e.status = 'NEW/SPL' GROUP BY ALL), z AS (SELECT o.frame, o.level, o.label, o.size, coalesce(ms, psize) - coalesce(ns, 0) AS p FROM one o LEFT JOIN nw ON nw.prev_frame = o.prev_frame AND nw.level = o.level AND nw.split_parent = o.past_label) SELECT frame, level, label, round(1e6 * ((size - p) / 43200.0) / ((size + p) / 2.0), 6) AS expansion FROM z WHERE size + p <> 0", fixture="expansion")
def expansion_events(g: Grid) -> DataFrame:
    return g.vecs.filter("expansion IS NOT NULL").select(*K, *r6("expansion"))


@query("SELECT frame, level, label, uid FROM ua")
def link_uid(g: Grid) -> DataFrame:
    return g.links.select(*K, "uid")


@query("SELECT frame, level, label, lifetime, n_points FROM ua")
def link_lifetime(g: Grid) -> DataFrame:
    return g.links.select(*K, "lifetime", "n_points")


@query("SELECT frame, level, label, uid, lifetime FROM ua", GAP, "gap")
def link_gap(g: Grid) -> DataFrame:
    return g.links.select(*K, "uid", "lifetime")


@query("""
, e2 AS (SELECT e.frame, e.level, e.label, e.prev_frame, CASE WHEN past_label IS NOT NULL AND NOT contains(status, 'NEW') THEN past_label END AS cp, split_parent FROM ev e),
lf(frame, level, label, life) AS (SELECT frame, level, label, 0 FROM e2 WHERE cp IS NULL AND split_parent IS NULL
  UNION ALL SELECT e2.frame, e2.level, e2.label, lf.life + CASE WHEN cp IS NOT NULL THEN 720 ELSE 0 END FROM lf JOIN e2 ON e2.prev_frame = lf.frame AND e2.level = lf.level AND coalesce(cp, split_parent) = lf.label)
SELECT frame, level, label, CAST(life + 720 AS BIGINT) AS lifetime FROM lf""", fixture="split")
def link_preserve_split(g: Grid) -> DataFrame:
    return g.links.select(*K, "lifetime")


@query("SELECT frame, level, label, uid, inner_rank, iuid FROM ia WHERE level > 0")
def link_iuid(g: Grid) -> DataFrame:
    return g.links.filter("level > 0").select(*K, "uid", F.col("inner").alias("inner_rank"), "iuid")


@query("""
, n AS (SELECT frame, ts, (SELECT count(*) FROM clus c WHERE c.frame = fr.frame) AS n FROM fr),
o AS (SELECT frame, coalesce(sum(greatest(n, 1)) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM n)
SELECT c.frame, c.level, c.label, CAST(s + row_number() OVER (PARTITION BY c.frame ORDER BY c.level, c.label) AS BIGINT) AS cindex FROM clus c JOIN o USING (frame)""", GAP, "gap")
def link_cindex(g: Grid) -> DataFrame:
    return g.links.select(*K, "cindex")


PREV = """
, pm AS (SELECT e.frame, e.level, e.label, list(p.uid ORDER BY e.m) AS prv_mrg_uids, list(p.iuid ORDER BY e.m) AS prv_mrg_iuids FROM (SELECT *, unnest(merge_labels) AS m FROM ev) e JOIN ia p ON p.frame = e.prev_frame AND p.level = e.level AND p.label = e.m GROUP BY ALL),
ps AS (SELECT e.frame, e.level, e.label, p.uid AS prv_spl_uid, p.iuid AS prv_spl_iuid FROM ev e JOIN ia p ON p.frame = e.prev_frame AND p.level = e.level AND p.label = e.split_parent)"""


@query(PREV + " SELECT * FROM pm")
def link_prev_uids(g: Grid) -> DataFrame:
    return g.previous.filter("prv_mrg_uids IS NOT NULL").select(*K, "prv_mrg_uids", "prv_mrg_iuids")


@query(PREV + " SELECT * FROM ps")
def link_prev_split(g: Grid) -> DataFrame:
    return g.previous.filter("prv_spl_uid IS NOT NULL").select(*K, "prv_spl_uid", "prv_spl_iuid")


TRAJECTORY = """
, tj(frame, level, label, pts) AS (SELECT frame, level, label, printf('%.4f %.4f', cx, cy) FROM ev JOIN clus USING (frame, level, label) WHERE past_label IS NULL OR contains(status, 'NEW')
  UNION ALL SELECT e.frame, e.level, e.label, tj.pts || ', ' || printf('%.4f %.4f', c.cx, c.cy) FROM tj JOIN ev e ON e.level = tj.level AND e.prev_frame = tj.frame AND e.past_label = tj.label AND NOT contains(e.status, 'NEW') JOIN clus c ON c.level = e.level AND c.frame = e.frame AND c.label = e.label),
pj AS (SELECT frame, level, label, [[round(CAST(string_split(p, ' ')[1] AS DOUBLE), 3), round(CAST(string_split(p, ' ')[2] AS DOUBLE), 3)] FOR p IN string_split(pts, ', ')] AS points FROM tj WHERE contains(pts, ','))"""


def points() -> Column:
    """Every point of a trajectory, to three decimals."""
    body = F.split(F.regexp_extract("trajectory", r"\((.*)\)", 1), ", ")
    return F.transform(body, lambda p: F.transform(F.split(p, " "), lambda v: F.round(v.cast("double"), 3)))


@query(TRAJECTORY + " SELECT * FROM pj")
def link_trajectory(g: Grid) -> DataFrame:
    return g.links.filter("trajectory IS NOT NULL").select(*K, points().alias("points"))


TT = "tt AS MATERIALIZED (SELECT fr.ts, u.frame, u.level, u.label, u.uid, u.iuid, u.lifetime, c.size, c.min, c.mean, c.max, c.cx, c.cy, c.xmin, c.xmax, c.ymin, c.ymax, e.status FROM ia u JOIN clus c USING (frame, level, label) JOIN ev e USING (frame, level, label) JOIN fr ON fr.frame = u.frame)"


@query(f", {TT} SELECT ts, frame, level, label, uid, iuid, lifetime, size, min, round(mean + 1e-9, 6) AS mean, max, status FROM tt")
def tracking_table(g: Grid) -> DataFrame:
    return g.tracks.select("ts", *K, "uid", "iuid", "lifetime", "size", "min", *off("mean"), "max", "status")


@query(PREV + f""", {TT}, n AS (SELECT frame, level, label, count(*) AS k FROM ins GROUP BY ALL)
SELECT frame, level, label, CAST(row_number() OVER (PARTITION BY frame, level ORDER BY label) AS BIGINT) AS cluster_id, CAST(CASE level WHEN 0 THEN 80.0 ELSE 120.0 END AS DOUBLE) AS threshold, coalesce(k, 0) AS inside_clusters,
  false AS board, prv_mrg_uids, prv_mrg_iuids, prv_spl_uid, prv_spl_iuid, strftime(ts, '%Y%m%d_%H%M%S') || '.parquet' AS file,
  (SELECT list(y ORDER BY y, x) FROM lab l WHERE l.frame = tt.frame AND l.level = tt.level AND l.label = tt.label) AS array_y,
  (SELECT list(x ORDER BY y, x) FROM lab l WHERE l.frame = tt.frame AND l.level = tt.level AND l.label = tt.label) AS array_x,
  round(sqrt(u_ * u_ + v_ * v_), 6) AS speed, round(CASE WHEN degrees(atan2(v_, u_)) < 0 THEN degrees(atan2(v_, u_)) + 360 ELSE degrees(atan2(v_, u_)) END, 6) AS dir
FROM tt LEFT JOIN pm USING (frame, level, label) LEFT JOIN ps USING (frame, level, label) LEFT JOIN n USING (frame, level, label) JOIN vec USING (frame, level, label)""")
def tracking_columns(g: Grid) -> DataFrame:
    """The columns of the whole table that ``tracking_table`` does not show."""
    return g.table().select(*K, "cluster_id", "threshold", "inside_clusters", "board", "prv_mrg_uids", "prv_mrg_iuids", "prv_spl_uid", "prv_spl_iuid", "file", "array_y", "array_x", *r6("speed", "dir"))


@query(f", {TT}, d AS (SELECT iuid, min(ts) AS t0, max(ts) AS t1, date_diff('minute', min(ts), max(ts)) AS duration FROM tt GROUP BY iuid) SELECT frame, level, label, iuid, CAST(duration AS BIGINT) AS duration, CASE WHEN duration > 0 AND ts = t1 THEN -1 WHEN duration > 0 AND ts = t0 THEN 1 ELSE 0 END AS genesis FROM tt JOIN d USING (iuid)")
def duration(g: Grid) -> DataFrame:
    w = Window.partitionBy("iuid")
    t = g.tracks.select(*K, "iuid", "ts", F.min("ts").over(w).alias("t0"), F.max("ts").over(w).alias("t1"))
    t = t.withColumn("duration", F.timestamp_diff("MINUTE", F.col("t0"), F.col("t1")))
    lives = F.col("duration") > 0
    return t.select(*K, "iuid", "duration", F.when(lives & (F.col("ts") == F.col("t1")), -1).when(lives & (F.col("ts") == F.col("t0")), 1).otherwise(0).alias("genesis"))


@query(f", {TT} SELECT level, uid, count(*) AS n, CAST(date_diff('hour', min(ts), max(ts)) AS BIGINT) AS hours, max(size) AS max_size, round(avg(cy), 6) AS clat, round(avg(cx), 6) AS clon, coalesce(max(max), -999.99) AS peak FROM tt GROUP BY level, uid")
def family_table(g: Grid) -> DataFrame:
    return g.tracks.groupBy("level", "uid").agg(F.count(F.lit(1)).alias("n"), F.timestamp_diff("HOUR", F.min("ts"), F.max("ts")).alias("hours"), F.max("size").alias("max_size"), F.round(F.avg("cy"), 6).alias("clat"), F.round(F.avg("cx"), 6).alias("clon"), F.coalesce(F.max("max"), F.lit(-999.99)).alias("peak"))


FARS = """, lm AS (SELECT frame, level, label, unnest(['noc', 'spl', 'mrg', 'inc', 'elp']) AS method, unnest([u_, u_spl, u_mrg, u_inc, u_]) AS u, unnest([v_, v_spl, v_mrg, v_inc, v_]) AS v FROM vec),
mv AS (SELECT m.frame, m.level, m.label, m.method, m.u, m.v, p.y + CAST(round_even(m.v, 0) AS INTEGER) AS y, p.x + CAST(round_even(m.u, 0) AS INTEGER) AS x FROM lm m JOIN ev e USING (frame, level, label)
  JOIN lab p ON p.frame = e.prev_frame AND p.level = e.level AND p.label = e.past_label WHERE m.u IS NOT NULL AND m.v IS NOT NULL),
fc AS (SELECT mv.frame, mv.level, mv.label, method, u, v, count(l.label) AS hit, count(*) - count(l.label) AS false_alarm, (count(*) - count(l.label)) / count(*) AS far FROM mv
  LEFT JOIN lab l ON (l.frame, l.level, l.label, l.y, l.x) = (mv.frame, mv.level, mv.label, mv.y, mv.x) GROUP BY ALL)"""


@query(FARS + " SELECT frame, level, label, method, hit, false_alarm, round(far, 6) AS far FROM fc")
def far_counts(g: Grid) -> DataFrame:
    return g.fars.select(*K, "method", "hit", "false_alarm", *r6("far"))


@query(FARS + ", b AS (SELECT frame, level, label, arg_min(method, far * 10 + list_position(['noc','spl','mrg','inc','opt','elp'], method) * 1e-9) AS method, min(far) AS far FROM fc GROUP BY ALL) SELECT c.frame, c.level, c.label, coalesce(method, 'noc') AS method, round(coalesce(far, 1), 6) AS far FROM clus c LEFT JOIN b USING (frame, level, label)")
def far_best(g: Grid) -> DataFrame:
    return T.far_best(g.fars, g.feats).select(*K, "method", *r6("far"))


@query(FARS + " SELECT frame, level, label, " + ", ".join(f"round(max(far) FILTER (method = '{m}'), 6) AS far_{m}, max(hit) FILTER (method = '{m}') AS hit_{m}" for m in ("noc", "spl", "mrg", "inc", "elp")) + " FROM fc GROUP BY ALL")
def far_scores(g: Grid) -> DataFrame:
    return g.fars.groupBy(*K).agg(*(x for m in ("noc", "spl", "mrg", "inc", "elp") for x in (F.round(F.max(F.when(F.col("method") == m, F.col("far"))), 6).alias(f"far_{m}"), F.max(F.when(F.col("method") == m, F.col("hit"))).alias(f"hit_{m}"))))


@query(fixture="opt")
def far_counts_opt(g: Grid) -> DataFrame:
    return g.fars.select(*K, "method", "hit", "false_alarm", *r6("far"))


@query(fixture="opt")
def far_best_opt(g: Grid) -> DataFrame:
    return T.far_best(g.fars, g.feats).select(*K, "method", *r6("far", "u_", "v_"))


@query(fixture="opt")
def tracks_validated(g: Grid) -> DataFrame:
    return g.tracks.select("ts", *K, "uid", "method", *r6("far", "u_", "v_"))


@query(f", {TT} SELECT count(DISTINCT uid) AS tracks, min(ts) AS first_ts, max(ts) AS last_ts FROM tt WHERE size >= 5")
def ana_count_distinct(g: Grid) -> DataFrame:
    return g.tracks.filter("size >= 5").agg(F.count_distinct("uid").alias("tracks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f", {TT} SELECT uid, max(size) AS max_size FROM tt GROUP BY uid ORDER BY max_size DESC, uid LIMIT 10")
def ana_top_size(g: Grid) -> DataFrame:
    return g.tracks.groupBy("uid").agg(F.max("size").alias("max_size")).orderBy(F.col("max_size").desc(), "uid").limit(10)


@query(f", {TT} SELECT uid, max(lifetime) AS max_lifetime FROM tt GROUP BY uid ORDER BY max_lifetime DESC, uid LIMIT 10")
def ana_top_lifetime(g: Grid) -> DataFrame:
    return g.tracks.groupBy("uid").agg(F.max("lifetime").alias("max_lifetime")).orderBy(F.col("max_lifetime").desc(), "uid").limit(10)


@query(f", {TT}, k AS (SELECT uid FROM tt GROUP BY uid ORDER BY count(*) DESC, uid LIMIT 5) SELECT frame, level, label, uid, size FROM tt WHERE uid IN (SELECT uid FROM k)")
def ana_nlargest(g: Grid) -> DataFrame:
    t = g.tracks.select(*K, "uid", "size")
    top = t.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "uid").limit(5)
    return t.join(top, "uid", "left_semi").select(*K, "uid", "size")


@query(f", {TT}, a AS (SELECT uid, status, count(*) AS n, max(size) AS mx, avg(size) AS me FROM tt GROUP BY ALL) SELECT status, count(*) AS groups, round(avg(n), 6) AS mean_n, round(stddev_samp(n), 6) AS std_n, max(mx) AS max_size, round(avg(me), 6) AS mean_size FROM a GROUP BY status")
def ana_two_level(g: Grid) -> DataFrame:
    a = g.tracks.groupBy("uid", "status").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("mx"), F.avg("size").alias("me"))
    return a.groupBy("status").agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.stddev_samp("n"), 6).alias("std_n"), F.max("mx").alias("max_size"), F.round(F.avg("me"), 6).alias("mean_size"))


@query(f", {TT} SELECT frame, level, label, uid, lifetime FROM tt WHERE uid IN (1, 2, 3, 5, 8)")
def ana_filter_uid(g: Grid) -> DataFrame:
    return g.tracks.filter("uid IN (1, 2, 3, 5, 8)").select(*K, "uid", "lifetime")


@query("SELECT frame, level, label FROM clus, w WHERE xmin <= w // 2 AND ymin <= w // 2 AND xmax >= w // 4 AND ymax >= w // 4")
def ana_bbox(g: Grid) -> DataFrame:
    a, b = g.width // 4, g.width // 2
    return g.feats.filter(f"xmin <= {b} AND ymin <= {b} AND xmax >= {a} AND ymax >= {a}").select(*K)


@query("SELECT frame, y, x, CASE WHEN value BETWEEN 50 AND 200 THEN value END AS masked FROM cell")
def ana_mask(g: Grid) -> DataFrame:
    return g.cells.select("frame", "y", "x", F.when(F.col("value").between(50, 200), F.col("value")).alias("masked"))


@query(", t AS (SELECT (SELECT max(frame) FROM clus) AS f) SELECT y, x, max(value) AS value, max(level) AS level FROM lab, t WHERE frame = f GROUP BY y, x")
def ana_image(g: Grid) -> DataFrame:
    last = g.feats.agg(F.max("frame").alias("frame"))
    return g.labelled.join(last, "frame").groupBy("y", "x").agg(F.max("value").alias("value"), F.max("level").alias("level"))


@query("SELECT frame, level, label, 'cluster' AS kind, CAST(size AS DOUBLE) AS amount FROM clus UNION ALL SELECT frame, level, label, 'merge', CAST(len(merge_labels) AS DOUBLE) FROM ev WHERE merge_labels IS NOT NULL")
def ana_union(g: Grid) -> DataFrame:
    a = g.feats.select(*K, F.lit("cluster").alias("kind"), F.col("size").cast("double").alias("amount"))
    return a.unionByName(g.ev.filter("merge_labels IS NOT NULL").select(*K, F.lit("merge").alias("kind"), F.size("merge_labels").cast("double").alias("amount")))


@query("SELECT frame, y, x FROM lab WHERE level = 0 INTERSECT SELECT frame, y, x FROM lab WHERE level = 1")
def ana_intersect(g: Grid) -> DataFrame:
    return g.labelled.filter("level = 0").select("frame", "y", "x").intersect(g.labelled.filter("level = 1").select("frame", "y", "x"))


@query("SELECT frame, y, x FROM px WHERE level = 0 EXCEPT SELECT frame, y, x FROM lab WHERE level = 0")
def ana_except(g: Grid) -> DataFrame:
    return g.pixels.filter("level = 0").select("frame", "y", "x").subtract(g.labelled.filter("level = 0").select("frame", "y", "x"))


@query("SELECT frame, level, label, size FROM (SELECT *, row_number() OVER (PARTITION BY frame, level ORDER BY size DESC, label) AS r FROM clus) WHERE r = 1")
def win_argmax(g: Grid) -> DataFrame:
    w = Window.partitionBy("frame", "level").orderBy(F.col("size").desc(), "label")
    return g.feats.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*K, "size")


@query("SELECT p.frame, p.level, p.y, p.x, u.iuid AS value FROM lab p JOIN ia u USING (frame, level, label)")
def raster_labels(g: Grid) -> DataFrame:
    """uid at level 0, iuid above."""
    return g.labelled.join(g.links.select(*K, "uid", "iuid"), K).select("frame", "level", "y", "x", F.when(F.col("level") == 0, F.col("uid").cast("double")).otherwise(F.col("iuid")).alias("value"))


@query("SELECT frame, level, y, x, size AS value FROM lab JOIN clus USING (frame, level, label)")
def raster_column(g: Grid) -> DataFrame:
    return g.labelled.select(*K, "y", "x").join(g.feats.select(*K, "size"), K).select("frame", "level", "y", "x", F.col("size").alias("value"))


@query("SELECT frame, level, CAST(floor(cy) AS INTEGER) AS y, CAST(floor(cx) AS INTEGER) AS x, round(max(u_), 6) AS u, round(max(v_), 6) AS v FROM vec JOIN clus USING (frame, level, label) WHERE u_ IS NOT NULL GROUP BY ALL")
def raster_vectors(g: Grid) -> DataFrame:
    c = g.vecs.filter("u_ IS NOT NULL").join(g.feats.select(*K, "cx", "cy"), K)
    return c.groupBy("frame", "level", F.floor("cy").cast("int").alias("y"), F.floor("cx").cast("int").alias("x")).agg(F.round(F.max("u_"), 6).alias("u"), F.round(F.max("v_"), 6).alias("v"))


@query("SELECT frame, level, label, round(CASE WHEN degrees(atan2(v_, u_)) < 0 THEN degrees(atan2(v_, u_)) + 360 ELSE degrees(atan2(v_, u_)) END, 6) AS ang_ FROM vec WHERE u_ IS NOT NULL")
def conv_boundaries(g: Grid) -> DataFrame:
    a = F.degrees(F.atan2("v_", "u_"))
    return g.vecs.filter("u_ IS NOT NULL").select(*K, F.round(F.when(a < 0, a + 360).otherwise(a), 6).alias("ang_"))


SEAM = """
, s AS (SELECT DISTINCT l.frame, l.label AS a, r.label AS b FROM lab l JOIN lab r ON r.frame = l.frame AND l.level = 0 AND r.level = 0 AND abs(l.y - r.y) <= 1, w WHERE l.x = 0 AND r.x = w - 1 AND l.label <> r.label),
t AS (SELECT s.frame, CASE WHEN ca.size < cb.size OR (ca.size = cb.size AND a > b) THEN a ELSE b END AS label, CASE WHEN ca.size < cb.size OR (ca.size = cb.size AND a > b) THEN b ELSE a END AS other, greatest(ca.size, cb.size) AS z
  FROM s JOIN clus ca ON ca.level = 0 AND ca.frame = s.frame AND ca.label = a JOIN clus cb ON cb.level = 0 AND cb.frame = s.frame AND cb.label = b),
bo AS (SELECT frame, label, arg_min(other, -z * 1e9 + other) AS board_label FROM t GROUP BY ALL)"""


@query(SEAM + " SELECT frame, label, board_label FROM bo")
def edges(g: Grid) -> DataFrame:
    return g.partners


@query(SEAM + f", {TT} SELECT tt.frame, tt.level, tt.label, coalesce(o.uid, tt.uid) AS uid, coalesce(o.status, tt.status) AS status, bo.label IS NOT NULL AS board FROM tt LEFT JOIN bo ON tt.level = 0 AND bo.frame = tt.frame AND bo.label = tt.label LEFT JOIN tt o ON o.level = 0 AND o.frame = bo.frame AND o.label = bo.board_label")
def link_edges(g: Grid) -> DataFrame:
    return g.joined_tracks.select(*K, "uid", "status", "board")
