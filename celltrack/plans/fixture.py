"""The sliding-window event grid on which the tracking queries run, and its SQL counterpart.

Frames are 48-hour windows every 12 hours over ``events``; cells take the largest value. The relations that every
query shares are computed once for each table folder of an application and kept as tables in the shared folder.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrack.api import Tracker
from celltrack.config import GridSpec, Level, TrackConfig
from celltrack.runtime import cut, table
from celltrack.sources import frames as S

START, COUNT, STEP, SPAN = "2024-01-01 00:00:00", 57, 12, 48
LEVELS = (Level(0, 80.0, 3), Level(1, 120.0, 2))


class Grid(Tracker):
    def __init__(self, spark: SparkSession, sf_dir: str, skip: tuple[int, ...] = (), empty: tuple[int, ...] = (), **settings):
        self.spark, self.dir, self.skip, self.empty = spark, sf_dir, skip, empty
        self.events = table(spark, sf_dir, "events")
        self.width = max(1, math.ceil(math.sqrt(self.events.count() / 25)))
        self.cfg = TrackConfig(GridSpec(self.width, self.width, **settings.pop("bounds", {})), LEVELS, STEP * 60, **settings)

    @cached_property
    def frames(self) -> DataFrame:
        f = S.sliding_frames(self.spark, START, COUNT, STEP)
        return f.filter(~F.col("frame").isin(list(self.skip))) if self.skip else f

    @cached_property
    def cells(self) -> DataFrame:
        c = S.window_cells(self.events, START, COUNT, STEP, SPAN, self.width)
        gone = [*self.skip, *self.empty]
        return cut(c.filter(~F.col("frame").isin(gone)) if gone else c)


_grids: dict[tuple, Grid] = {}


def grid(spark: SparkSession, sf_dir: str, name: str = "plain") -> Grid:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _grids:
        settings: dict = {"gap": {"skip": (10, 11, 30), "empty": (20,)}, "dbscan": {"cluster_method": "dbscan", "eps": 2.0}, "split": {"preserv_split": True}, "expansion": {"mrg_expansion": True, "spl_expansion": True}, "opt": {"opt_correction": True, "validation": True}, "hull": {"convex_hull": True}}.get(name, {})
        _grids[key] = Grid(spark, sf_dir, **settings)
    return _grids[key]


def prelude(skip: str = "", empty: str = "", radius: int = 1, floor: int = 1) -> str:
    """The same relations in SQL; a component's label is the least root that reaches a pixel."""
    gone = ", ".join(x for x in (skip, empty) if x)
    near = f"abs(b.y - r.y) <= {radius} AND abs(b.x - r.x) <= {radius}"
    return f"""
WITH RECURSIVE w AS (SELECT CAST(ceil(sqrt(count(*) / 25.0)) AS INTEGER) AS w FROM events),
fr AS (SELECT CAST(i AS INTEGER) AS frame, TIMESTAMP '2024-01-01' + to_hours(CAST(12 * i AS BIGINT)) AS ts FROM range(57) t(i) {f'WHERE i NOT IN ({skip})' if skip else ''}),
cell AS MATERIALIZED (SELECT frame, CAST(event_id % w AS INTEGER) AS y, CAST(user_id % w AS INTEGER) AS x, max(value) AS value
  FROM events, w, fr WHERE events.ts >= fr.ts AND events.ts < fr.ts + INTERVAL 48 HOUR {f'AND frame NOT IN ({gone})' if gone else ''} GROUP BY ALL),
lv(level, threshold, min_size) AS (VALUES (0, 80.0, 3), (1, 120.0, 2)),
px AS MATERIALIZED (SELECT frame, level, y, x, value, CAST(y AS BIGINT) * w + x AS id FROM cell, lv, w WHERE value >= threshold),
seed AS (SELECT * FROM px r WHERE NOT EXISTS (SELECT 1 FROM px b WHERE b.frame = r.frame AND b.level = r.level AND {near} AND b.id < r.id)),
reach AS (SELECT frame, level, id AS root, id, y, x FROM seed
  UNION SELECT r.frame, r.level, r.root, b.id, b.y, b.x FROM reach r JOIN px b ON b.frame = r.frame AND b.level = r.level AND {near}),
lab0 AS (SELECT frame, level, id, min(root) AS label FROM reach GROUP BY ALL),
lab AS MATERIALIZED (SELECT frame, level, label, y, x, value FROM (SELECT p.frame, p.level, l.label, p.y, p.x, p.value, v.min_size,
  count(*) OVER (PARTITION BY p.frame, p.level, l.label) AS n FROM px p JOIN lab0 l USING (frame, level, id) JOIN lv v USING (level)) WHERE n >= greatest(min_size, {floor})),
clus AS MATERIALIZED (SELECT frame, level, label, count(*) AS size, min(value) AS min, avg(value) AS mean, max(value) AS max, stddev_pop(value) AS std,
  avg(x) AS cx, avg(y) AS cy, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM lab GROUP BY ALL),
fp AS (SELECT frame, prev_frame, CAST(gap AS BIGINT) AS gap_min FROM (SELECT frame, lag(frame) OVER (ORDER BY ts) AS prev_frame,
  date_diff('minute', lag(ts) OVER (ORDER BY ts), ts) AS gap FROM fr) WHERE gap <= 720),
ov AS MATERIALIZED (SELECT o.*, c.size, p.size AS prev_size, 100.0 * shared / p.size AS overlap FROM
  (SELECT a.frame, a.level, a.label, fp.prev_frame, b.label AS prev_label, count(*) AS shared FROM lab a JOIN fp ON fp.frame = a.frame
    JOIN lab b ON b.frame = fp.prev_frame AND b.level = a.level AND b.y = a.y AND b.x = a.x GROUP BY ALL) o
  JOIN clus c USING (frame, level, label) JOIN clus p ON p.frame = o.prev_frame AND p.level = o.level AND p.label = o.prev_label
  WHERE 100.0 * shared / p.size >= 10),
rk AS (SELECT *, count(*) OVER (PARTITION BY frame, level, prev_label) AS n_cur,
  row_number() OVER (PARTITION BY frame, level, prev_label ORDER BY size DESC, label) AS rank FROM ov),
fact AS (SELECT frame, level, label, count(*) AS n_prev, max(n_cur) AS n_cur, bool_or(n_cur > 1 AND rank = 1) AS major, bool_or(n_cur > 1 AND rank > 1) AS minor,
  max(prev_frame) AS prev_frame, arg_min(prev_label, -prev_size * 1e9 + prev_label) AS largest, list_sort(list(prev_label)) AS prevs,
  max(prev_label) FILTER (n_cur > 1 AND rank > 1) AS split_parent FROM rk GROUP BY ALL),
ev AS MATERIALIZED (SELECT c.frame, c.level, c.label, CASE WHEN n_prev > 1 AND major THEN 'MRG/SPL' WHEN minor THEN 'NEW/SPL' WHEN major THEN 'SPL'
    WHEN n_prev > 1 THEN 'MRG' WHEN n_prev = 1 THEN 'CON' ELSE 'NEW' END AS status, prev_frame,
  CASE WHEN n_prev > 1 OR major OR (n_prev = 1 AND n_cur = 1) THEN largest END AS past_label, CASE WHEN n_prev > 1 THEN prevs END AS merge_labels, split_parent
  FROM clus c LEFT JOIN fact f USING (frame, level, label)),
ins AS MATERIALIZED (SELECT i.frame, i.level, i.label, in_level, in_label FROM (SELECT a.frame, a.level, a.label, b.level AS in_level, b.label AS in_label, count(*) AS n
  FROM lab a JOIN lab b ON a.frame = b.frame AND a.y = b.y AND a.x = b.x AND b.level > a.level GROUP BY ALL) i
  JOIN clus c ON c.frame = i.frame AND c.level = i.in_level AND c.label = i.in_label WHERE n = c.size),
spl AS (SELECT e.frame, e.level, e.label, avg(a.x) AS sx, avg(a.y) AS sy FROM ev e JOIN lab a USING (frame, level, label)
  JOIN lab b ON b.frame = e.prev_frame AND b.level = e.level AND b.label = e.split_parent AND b.y = a.y AND b.x = a.x GROUP BY ALL),
mrg AS (SELECT e.frame, e.level, e.label, sum(c.cx - p.cx) AS u_mrg, sum(c.cy - p.cy) AS v_mrg FROM (SELECT *, unnest(merge_labels) AS m FROM ev) e
  JOIN clus c ON (c.frame, c.level, c.label) = (e.frame, e.level, e.label) JOIN clus p ON p.frame = e.prev_frame AND p.level = e.level AND p.label = e.m GROUP BY ALL),
uv AS MATERIALIZED (SELECT e.frame, e.level, e.label, e.status, c.cx - p.cx AS u_, c.cy - p.cy AS v_, 1e6 * ((c.size - p.size) / 43200.0) / ((c.size + p.size) / 2.0) AS expansion,
  CASE WHEN status = 'NEW/SPL' THEN c.cx - sx END AS u_spl, CASE WHEN status = 'NEW/SPL' THEN c.cy - sy END AS v_spl, u_mrg, v_mrg
  FROM ev e JOIN clus c USING (frame, level, label) LEFT JOIN clus p ON p.frame = e.prev_frame AND p.level = e.level AND p.label = e.past_label
  LEFT JOIN spl USING (frame, level, label) LEFT JOIN mrg USING (frame, level, label)),
inn AS (SELECT i.frame, i.level, i.label, sum(u.u_) AS su, count(u.u_) AS nu, sum(u.v_) AS sv, count(u.v_) AS nv FROM ins i
  JOIN uv u ON u.frame = i.frame AND u.level = i.in_level AND u.label = i.in_label GROUP BY ALL),
vec AS MATERIALIZED (SELECT u.*, CASE WHEN nu IS NOT NULL THEN (u_ + coalesce(su, 0)) / (1 + nu) END AS u_inc,
  CASE WHEN nv IS NOT NULL THEN (v_ + coalesce(sv, 0)) / (1 + nv) END AS v_inc FROM uv u LEFT JOIN inn USING (frame, level, label)),
ch(frame, level, label, rf, rl, n_points) AS (SELECT frame, level, label, frame, label, 1 FROM ev WHERE past_label IS NULL OR contains(status, 'NEW')
  UNION ALL SELECT e.frame, e.level, e.label, ch.rf, ch.rl, ch.n_points + 1 FROM ch JOIN ev e ON e.prev_frame = ch.frame AND e.level = ch.level AND e.past_label = ch.label AND NOT contains(e.status, 'NEW')),
rt AS (SELECT rf, rl, row_number() OVER (ORDER BY rf, rl) AS uid FROM (SELECT DISTINCT rf, rl FROM ch WHERE level = 0)),
u0 AS MATERIALIZED (SELECT frame, label, uid, n_points, date_diff('minute', r.ts, f.ts) + 720 AS lifetime FROM ch JOIN rt USING (rf, rl) JOIN fr f USING (frame) JOIN fr r ON r.frame = ch.rf WHERE level = 0),
l1 AS (SELECT ch.*, u0.uid AS uid0 FROM ch LEFT JOIN ins i ON i.level = 0 AND i.frame = ch.frame AND i.in_level = ch.level AND i.in_label = ch.label LEFT JOIN u0 ON u0.frame = i.frame AND u0.label = i.label WHERE ch.level > 0),
lo AS (SELECT frame AS rf, level, label AS rl, (SELECT coalesce(max(uid), 0) FROM u0) + row_number() OVER (ORDER BY frame, level, label) AS uid FROM l1 WHERE frame = rf AND label = rl AND uid0 IS NULL),
ua AS MATERIALIZED (SELECT frame, 0 AS level, label, uid, n_points, CAST(lifetime AS BIGINT) AS lifetime FROM u0
  UNION ALL SELECT c.frame, c.level, c.label, coalesce(c.uid0, lo.uid, r.uid0), c.n_points, CAST(date_diff('minute', a.ts, f.ts) + 720 AS BIGINT) FROM l1 c LEFT JOIN lo USING (rf, level, rl)
    JOIN l1 r ON r.frame = c.rf AND r.level = c.level AND r.label = c.rl JOIN fr f ON f.frame = c.frame JOIN fr a ON a.frame = c.rf),
pa AS (SELECT e.frame, e.level, e.label, e.prev_frame, e.past_label, p.uid = c.uid AS same FROM ev e JOIN ua c USING (frame, level, label) JOIN ua p ON p.frame = e.prev_frame AND p.level = e.level AND p.label = e.past_label
  WHERE e.level > 0 AND NOT contains(e.status, 'NEW')),
co(frame, level, label, cf, cl) AS (SELECT frame, level, label, frame, label FROM ua WHERE level > 0 AND (frame, level, label) NOT IN (SELECT (frame, level, label) FROM pa WHERE same)
  UNION ALL SELECT p.frame, p.level, p.label, co.cf, co.cl FROM co JOIN pa p ON p.same AND p.prev_frame = co.frame AND p.level = co.level AND p.past_label = co.label),
ir AS (SELECT cf, level, cl, row_number() OVER (PARTITION BY uid ORDER BY cf, level, cl) AS k FROM (SELECT DISTINCT co.cf, co.level, co.cl, ua.uid FROM co JOIN ua ON ua.frame = co.cf AND ua.level = co.level AND ua.label = co.cl)),
ia AS MATERIALIZED (SELECT ua.*, ir.k AS inner_rank, CASE WHEN level = 0 THEN CAST(uid AS DOUBLE) ELSE CAST(uid || '.' || repeat('0', level - 1) || lpad(CAST(ir.k AS VARCHAR), 4, '0') AS DOUBLE) END AS iuid FROM ua LEFT JOIN co USING (frame, level, label) LEFT JOIN ir USING (cf, level, cl))
"""
