"""Queries of enrichment, forecast, functions, imaging, outlines, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrack.functions import outline
from celltrack.functions import physics as ph
from celltrack.operators import convert, enrich, forecast as fc, imaging
from celltrack.operators import tracking as T
from celltrack.plans import tracking_queries as tq
from celltrack.plans.fixture import Grid
from celltrack.plans.tracking_queries import K, P, TT, off, r6
from celltrack.runtime import new_path, table
from celltrack.sources import frames as S
from celltrack.streaming import live

QUERIES: dict[str, tq.Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, pre: str = P):
    def put(f):
        tq.query(sql, pre)(f)
        QUERIES[f.__name__] = tq.QUERIES.pop(f.__name__)
        if sql is not None:
            SQL[f.__name__] = tq.SQL.pop(f.__name__)
        return f

    return put


def plain(sql: str | None = None):
    """A query on the tables themselves."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


RASTER = """, ra AS MATERIALIZED (SELECT TIMESTAMP '2024-01-01' + to_days(CAST(3 * (l_linenumber - 1) AS INTEGER)) AS ts, CAST(l_partkey % w AS INTEGER) AS y, CAST(l_suppkey % w AS INTEGER) AS x, max(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem, w GROUP BY ALL),
rt0 AS (SELECT DISTINCT ts FROM ra)"""


def raster(g: Grid) -> DataFrame:
    li = table(g.spark, g.dir, "lineitem")
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_interval(days=(F.col("l_linenumber") * 3 - 3).cast("int"))
    return li.select(at.alias("ts"), (F.col("l_partkey") % g.width).cast("int").alias("y"), (F.col("l_suppkey") % g.width).cast("int").alias("x"), F.col("l_quantity").cast("double").alias("value")).groupBy("ts", "y", "x").agg(F.max("value").alias("value"))


def near_sql(limit: str) -> str:
    return RASTER + f", m AS (SELECT fr.frame, fr.ts, (SELECT r.ts FROM rt0 r {limit} ORDER BY abs(epoch_us(r.ts) - epoch_us(fr.ts)), r.ts LIMIT 1) AS match_ts FROM fr)"


@query(near_sql("") + " SELECT frame, match_ts FROM m")
def asof_nearest(g: Grid) -> DataFrame:
    return enrich.asof(g.frames, raster(g), "nearest").select("frame", "match_ts")


@query(near_sql("WHERE abs(epoch_us(r.ts) - epoch_us(fr.ts)) <= CAST(720 AS BIGINT) * 60000000") + " SELECT frame, match_ts FROM m")
def asof_tolerance(g: Grid) -> DataFrame:
    return enrich.asof(g.frames, raster(g), "nearest", 720).select("frame", "match_ts")


@query(RASTER + " SELECT frame, r.ts AS match_ts FROM fr LEFT JOIN rt0 r ON r.ts = fr.ts")
def asof_fixed(g: Grid) -> DataFrame:
    return enrich.asof(g.frames, raster(g), "fixed").select("frame", "match_ts")


ZONAL = near_sql("") + """, zz AS (SELECT l.frame, l.level, l.label, r.value FROM lab l JOIN m USING (frame) JOIN ra r ON r.ts = m.match_ts AND r.y = l.y AND r.x = l.x),
zm AS (SELECT frame, level, label, value, count(*) AS n FROM zz GROUP BY ALL), zo AS (SELECT frame, level, label, arg_min(value, -n * 1e6 + value) AS mode FROM zm GROUP BY ALL)"""


@query(ZONAL + " SELECT frame, level, label, count(*) AS count, round(avg(value), 6) AS mean, median(value) AS median, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS percentile_25, round(quantile_cont(value, 0.9), 6) AS percentile_90, any_value(mode) AS mode FROM zz JOIN zo USING (frame, level, label) GROUP BY ALL")
def zonal_statistics(g: Grid) -> DataFrame:
    px = g.labelled.join(enrich.asof(g.frames, raster(g)).select("frame", "match_ts"), "frame").select(*K, "match_ts", "y", "x")
    return enrich.zonal(px, raster(g), K).select(*K, "count", *r6("mean"), "median", *r6("std"), "min", "max", *r6("percentile_25", "percentile_90"), "mode")


@query(ZONAL + " SELECT frame, level, label, list_sort(list(value)) AS values FROM zz GROUP BY ALL")
def zonal_values(g: Grid) -> DataFrame:
    px = g.labelled.join(enrich.asof(g.frames, raster(g)).select("frame", "match_ts"), "frame").select(*K, "match_ts", "y", "x")
    return enrich.zonal(px, raster(g), K).select(*K, "values")


BOXES = ", bx AS (SELECT n_nationkey AS k, n_name, (n_nationkey % 5) * w / 5.0 AS x0, (n_nationkey % 5 + 1) * w / 5.0 AS x1, (n_nationkey // 5) * w / 5.0 AS y0, (n_nationkey // 5 + 1) * w / 5.0 AS y1 FROM nation, w)"


def boxes(g: Grid) -> DataFrame:
    k, step = F.col("n_nationkey"), g.width / 5.0
    return table(g.spark, g.dir, "nation").select(k.cast("int").alias("box_id"), "n_name", (k % 5 * step).alias("x0"), ((k % 5 + 1) * step).alias("x1"), (F.floor(k / 5) * step).alias("y0"), ((F.floor(k / 5) + 1) * step).alias("y1"))


@query(BOXES + ", h AS (SELECT frame, level, label, k, count(*) AS share FROM lab JOIN bx ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL) SELECT frame, level, label, CAST(arg_min(k, -share * 1000 + k) AS INTEGER) AS box_id, max(share) AS share FROM h GROUP BY ALL")
def enrich_vector(g: Grid) -> DataFrame:
    return enrich.largest_box(g.labelled.select(*K, "y", "x"), boxes(g), K)


@query(BOXES + f", {TT} SELECT n_name, count(DISTINCT (l.frame, l.level, l.label)) AS clusters, count(*) AS cells FROM lab l JOIN bx ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY n_name")
def ana_spatial_join(g: Grid) -> DataFrame:
    b = boxes(g).withColumn("y", F.explode(F.sequence(F.ceil("y0").cast("int"), (F.ceil("y1") - 1).cast("int")))).withColumn("x", F.explode(F.sequence(F.ceil("x0").cast("int"), (F.ceil("x1") - 1).cast("int"))))
    return g.labelled.join(b.select("n_name", "y", "x"), ["y", "x"]).groupBy("n_name").agg(F.count_distinct("frame", "level", "label").alias("clusters"), F.count(F.lit(1)).alias("cells"))


@query(f", {TT}, v AS (SELECT tt.*, vec.u_, vec.v_ FROM tt JOIN vec USING (frame, level, label)), al AS (SELECT DISTINCT level, iuid FROM v WHERE frame = 56 AND u_ IS NOT NULL) SELECT frame, level, label, uid FROM v SEMI JOIN al USING (level, iuid) WHERE frame > 51")
def forecast_semi(g: Grid) -> DataFrame:
    return fc.history(g.tracks, 56, 5).select(*K, "uid")


FV = f", {TT}, v AS (SELECT tt.*, vec.u_, vec.v_ FROM tt JOIN vec USING (frame, level, label)), al AS (SELECT DISTINCT level, iuid FROM v WHERE frame = 56 AND u_ IS NOT NULL), mv AS (SELECT level, iuid, avg(u_) AS um, avg(v_) AS vm FROM v SEMI JOIN al USING (level, iuid) WHERE frame > 51 GROUP BY level, iuid)"


@query(FV + " SELECT level, iuid, round(um, 6) AS u_mean, round(vm, 6) AS v_mean FROM mv")
def forecast_vectors(g: Grid) -> DataFrame:
    return fc.mean_vectors(fc.history(g.tracks, 56, 5)).select("level", "iuid", *r6("u_mean", "v_mean"))


@query(FV + ", im AS (SELECT greatest(0, least(w - 1, CAST(round_even(l.y + vm, 0) AS INTEGER))) AS y, greatest(0, least(w - 1, CAST(round_even(l.x + um, 0) AS INTEGER))) AS x, l.value FROM v JOIN mv USING (level, iuid) JOIN lab l ON l.level = v.level AND l.frame = 56 AND l.label = v.label, w WHERE v.frame = 56) SELECT y, x, round(avg(value), 6) AS value FROM im GROUP BY ALL")
def forecast_image(g: Grid) -> DataFrame:
    return fc.image(g.tracks, g.labelled, 56, 5, g.cfg).select("y", "x", *r6("value"))


def _lead_sql(k: int, last: int = 56, window: int = 5) -> str:
    """One step of the forecast: image, clusters, events and identities from the step before."""
    f, t, lb = last + k - 1, f"tr{k - 1}", f"lb{k - 1}"
    near = "abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1"
    return f""", al{k} AS (SELECT DISTINCT level, iuid FROM {t} WHERE frame = {f} AND u_ IS NOT NULL AND v_ IS NOT NULL),
mv{k} AS (SELECT level, iuid, avg(u_) AS um, avg(v_) AS vm FROM {t} SEMI JOIN al{k} USING (level, iuid) WHERE frame > {f - window} AND frame <= {f} GROUP BY level, iuid),
im{k} AS MATERIALIZED (SELECT y, x, avg(value) AS value FROM (SELECT greatest(0, least(w - 1, CAST(round_even(l.y + vm, 0) AS INTEGER))) AS y, greatest(0, least(w - 1, CAST(round_even(l.x + um, 0) AS INTEGER))) AS x, l.value
  FROM {t} t JOIN mv{k} USING (level, iuid) JOIN {lb} l ON l.level = t.level AND l.label = t.label, w WHERE t.frame = {f}) GROUP BY y, x),
px{k} AS MATERIALIZED (SELECT level, min_size, y, x, value, CAST(y AS BIGINT) * w + x AS id FROM im{k}, lv, w WHERE value >= threshold),
re{k} AS (SELECT level, id AS root, id, y, x FROM px{k} r WHERE NOT EXISTS (SELECT 1 FROM px{k} b WHERE b.level = r.level AND {near} AND b.id < r.id) UNION SELECT r.level, r.root, b.id, b.y, b.x FROM re{k} r JOIN px{k} b ON b.level = r.level AND {near}),
lb{k} AS MATERIALIZED (SELECT level, label, y, x, value FROM (SELECT p.*, m.label, count(*) OVER (PARTITION BY p.level, m.label) AS n FROM px{k} p JOIN (SELECT level, id, min(root) AS label FROM re{k} GROUP BY ALL) m USING (level, id)) WHERE n >= min_size),
cl{k} AS MATERIALIZED (SELECT level, label, count(*) AS size, avg(x) AS cx, avg(y) AS cy FROM lb{k} GROUP BY ALL),
ov{k} AS (SELECT o.*, c.size, p.size AS prev_size FROM (SELECT a.level, a.label, b.label AS prev_label, count(*) AS shared FROM lb{k} a JOIN {lb} b USING (level, y, x) GROUP BY ALL) o JOIN cl{k} c USING (level, label)
  JOIN (SELECT level, label AS prev_label, count(*) AS size FROM {lb} GROUP BY ALL) p USING (level, prev_label) WHERE 100.0 * shared / p.size >= 10),
fa{k} AS (SELECT level, label, count(*) AS n_prev, max(n_cur) AS n_cur, bool_or(n_cur > 1 AND rank = 1) AS major, bool_or(n_cur > 1 AND rank > 1) AS minor, arg_min(prev_label, -prev_size * 1e9 + prev_label) AS largest
  FROM (SELECT *, count(*) OVER (PARTITION BY level, prev_label) AS n_cur, row_number() OVER (PARTITION BY level, prev_label ORDER BY size DESC, label) AS rank FROM ov{k}) GROUP BY level, label),
fo{k} AS MATERIALIZED (SELECT c.level, c.label, c.size, c.cx, c.cy, CASE WHEN n_prev > 1 AND major THEN 'MRG/SPL' WHEN minor THEN 'NEW/SPL' WHEN major THEN 'SPL' WHEN n_prev > 1 THEN 'MRG' WHEN n_prev = 1 THEN 'CON' ELSE 'NEW' END AS status,
  p.uid, p.iuid, c.cx - p.cx AS u_, c.cy - p.cy AS v_ FROM cl{k} c LEFT JOIN fa{k} a USING (level, label) LEFT JOIN {t} p ON p.frame = {f} AND p.level = c.level AND p.label = CASE WHEN n_prev > 1 OR major OR (n_prev = 1 AND n_cur = 1) THEN largest END),
tr{k} AS MATERIALIZED (SELECT * FROM {t} WHERE frame > {f + 1 - window} UNION ALL SELECT {f + 1}, level, label, uid, iuid, u_, v_, cx, cy FROM fo{k})"""


def _zero(c: str) -> str:
    return f"CASE WHEN round({c}, 6) = 0 THEN 0::DOUBLE ELSE round({c}, 6) END AS {c}"


LEADS = f""", {TT}, tr0 AS MATERIALIZED (SELECT tt.frame, tt.level, tt.label, tt.uid, tt.iuid, vec.u_, vec.v_, tt.cx, tt.cy FROM tt JOIN vec USING (frame, level, label)),
lb0 AS MATERIALIZED (SELECT level, label, y, x, value FROM lab WHERE frame = 56)""" + "".join(map(_lead_sql, (1, 2, 3)))


@query(LEADS + " UNION ALL".join(f" SELECT TIMESTAMP '2024-01-29' AS issue_ts, TIMESTAMP '2024-01-29' + INTERVAL {12 * k} HOUR AS ts, {k} AS lead, {56 + k} AS frame, level, label, uid, iuid, status, size, round(cx, 6) AS cx, round(cy, 6) AS cy, {_zero('u_')}, {_zero('v_')} FROM fo{k}" for k in (1, 2, 3)))
def forecast(g: Grid) -> DataFrame:
    zero = lambda c: F.when(F.round(c, 6) == 0, 0.0).otherwise(F.round(c, 6)).alias(c)
    f = fc.forecast(g.tracks, g.labelled, 56, 5, 3, g.cfg)
    return f.select("issue_ts", "ts", "lead", "frame", "level", "label", "uid", "iuid", "status", "size", *r6("cx", "cy"), zero("u_"), zero("v_"))


MEASURE = """, ed AS (SELECT a.frame, a.level, a.label, count(b.label) AS n FROM lab a LEFT JOIN lab b ON b.frame = a.frame AND b.level = a.level AND b.label = a.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL),
me AS (SELECT frame, level, label, CAST(size AS DOUBLE) AS area, CAST(4 * size - n AS DOUBLE) AS perimeter, CAST(xmin AS DOUBLE) - 0.5 AS x0, CAST(xmax AS DOUBLE) + 0.5 AS x1, CAST(ymin AS DOUBLE) - 0.5 AS y0, CAST(ymax AS DOUBLE) + 0.5 AS y1 FROM clus JOIN ed USING (frame, level, label))"""


@query(MEASURE + " SELECT * FROM me")
def geom_boundary(g: Grid) -> DataFrame:
    """Area, length and bounds of the drawn outlines, which must be those of the pixels."""
    from celltrack.functions import wkt

    def measure(batches):
        for b in batches:
            m = wkt.measures(b["geometry"])
            yield b[["frame", "level", "label"]].assign(**m)

    drawn = outline.outlines(T.pixel_arrays(g.labelled), g.cfg.grid)
    out = drawn.mapInPandas(measure, "frame int, level int, label bigint, area double, perimeter double, x0 double, x1 double, y0 double, y1 double")
    return out.select(*K, *r6("area", "perimeter", "x0", "x1", "y0", "y1"))


HULL = """, ro AS (SELECT frame, level, label, y, min(x) AS a, max(x) + 1 AS b FROM (SELECT frame, level, label, y, x FROM lab UNION ALL SELECT frame, level, label, y + 1, x FROM lab) GROUP BY ALL),
pt AS MATERIALIZED (SELECT frame, level, label, y, a AS x FROM ro UNION SELECT frame, level, label, y, b FROM ro),
pq AS (SELECT p.frame, p.level, p.label, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM pt p JOIN pt q USING (frame, level, label) WHERE (p.x, p.y) <> (q.x, q.y)),
hu AS (SELECT pq.frame, pq.level, pq.label, px * qy - qx * py AS cr FROM pq JOIN pt r USING (frame, level, label)
  GROUP BY pq.frame, pq.level, pq.label, px, py, qx, qy HAVING bool_and((qx - px) * (r.y - py) - (qy - py) * (r.x - px) > 0 OR ((qx - px) * (r.y - py) - (qy - py) * (r.x - px) = 0 AND (r.x - px) * (r.x - qx) + (r.y - py) * (r.y - qy) <= 0)))"""


@query(HULL + " SELECT frame, level, label, sum(cr) / 2.0 AS hull_area FROM hu GROUP BY ALL")
def geom_hull(g: Grid) -> DataFrame:
    return outline.outlines(T.pixel_arrays(g.labelled), g.cfg.grid).select(*K, "hull_area")


@query("SELECT frame, level, label, size AS area FROM clus")
def geom_area(g: Grid) -> DataFrame:
    """Areas of the drawn polygons, which must be the pixel counts."""
    from celltrack.functions import wkt

    drawn = outline.outlines(T.pixel_arrays(g.labelled), g.cfg.grid)

    def areas(batches):
        import numpy as np

        for b in batches:
            r = wkt.rings(b["geometry"])
            nxt = np.arange(1, len(r.x) + 1)
            nxt[r.start + r.length - 1] = r.start
            ring = np.abs(np.add.reduceat(r.x * r.y[nxt] - r.x[nxt] * r.y, r.start) / 2) * np.where(r.shell, 1, -1)
            yield b[["frame", "level", "label"]].assign(area=np.rint(np.bincount(r.row, ring, len(b))).astype("int64"))

    return drawn.mapInPandas(areas, "frame int, level int, label bigint, area bigint")


@query(tq.TRAJECTORY + f", {TT} SELECT ts, uid, iuid, level, points FROM pj JOIN tt USING (frame, level, label)")
def conv_trajectories(g: Grid) -> DataFrame:
    return g.tracks.filter("trajectory IS NOT NULL").select("ts", "uid", "iuid", "level", tq.points().alias("points"))


@query(MEASURE + " SELECT me.frame, me.level, ua.uid, perimeter, 'Feature' AS type FROM me JOIN ua USING (frame, level, label)")
def sink_geojson(g: Grid) -> DataFrame:
    """One GeoJSON feature a line, polygons with their holes, written to the shared folder; read again and measured."""
    path = new_path(g.spark, "geojson")
    d = outline.outlines(T.pixel_arrays(g.labelled), g.cfg.grid).join(g.links.select(*K, "uid"), K)
    convert.write_geojson(d, path, ("frame", "level", "uid"))
    shape = "type string, geometry struct<type string, coordinates array<array<array<array<double>>>>>, properties struct<frame int, level int, uid bigint>"
    f = g.spark.read.text(path).select(F.from_json("value", shape).alias("f")).select("f.*")
    side = lambda ring: F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda t, i: t + F.abs(ring[i][0] - ring[i - 1][0]) + F.abs(ring[i][1] - ring[i - 1][1]))
    length = F.aggregate(F.flatten("geometry.coordinates"), F.lit(0.0), lambda t, r: t + side(r))
    return f.select("properties.frame", "properties.level", "properties.uid", F.round(length, 6).alias("perimeter"), "type")


@query(f", {TT} SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM tt GROUP BY ALL")
def sink_parquet(g: Grid) -> DataFrame:
    """The tracking table written by day with gzip, and read again."""
    path = new_path(g.spark, "tracks")
    g.tracks.withColumn("day", F.to_date("ts")).drop("merge_labels").write.option("compression", "gzip").partitionBy("day").parquet(path)
    return g.spark.read.option("mergeSchema", True).parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT frame, level, label, round(CASE WHEN degrees(atan2(v_, u_)) < 0 THEN degrees(atan2(v_, u_)) + 360 ELSE degrees(atan2(v_, u_)) END, 6) AS dir, round(sqrt(u_ * u_ + v_ * v_), 6) AS speed, round(sqrt(u_ * u_ + v_ * v_) * 111.32 / 12, 6) AS kmh FROM vec WHERE u_ IS NOT NULL")
def fn_angle(g: Grid) -> DataFrame:
    u, v = F.col("u_"), F.col("v_")
    m = ph.magnitude(u, v)
    return g.vecs.filter("u_ IS NOT NULL").select(*K, F.round(ph.angle(u, v), 6).alias("dir"), F.round(m, 6).alias("speed"), F.round(ph.velocity(m, 720, "km/h"), 6).alias("kmh"))


@plain("SELECT event_id, round(value * cos(radians(user_id % 360)), 6) AS u, round(value * sin(radians(user_id % 360)), 6) AS v FROM events")
def fn_polar(spark: SparkSession, d: str) -> DataFrame:
    u, v = ph.polar_to_uv(F.col("user_id") % 360, F.col("value"))
    return table(spark, d, "events").select("event_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@plain("SELECT event_id, round(value * 111320 / 600, 6) AS ms, round(value * 69.17 * 6, 6) AS mph, round(value * sqrt(4.0) * 6, 6) AS px_kmh FROM events")
def fn_velocity(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(ph.velocity(v, 10, "m/s"), 6).alias("ms"), F.round(ph.velocity(v, 10, "mp/h"), 6).alias("mph"), F.round(ph.velocity_from_pixels(v, 4.0, 10, "km/h"), 6).alias("px_kmh"))


@plain("SELECT event_id, round(pow(10, value / 100), 6) AS z, round(10 * log10(value), 6) AS dbz, round(pow(pow(10, value / 100) / 200, 1 / 1.6), 6) AS rain, round(10 * log10(200 * pow(value, 1.6)), 6) AS back FROM events")
def fn_dbz(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(ph.dbz_to_z(v / 10), 6).alias("z"), F.round(ph.z_to_dbz(v), 6).alias("dbz"), F.round(ph.dbz_to_rain(v / 10), 6).alias("rain"), F.round(ph.rain_to_dbz(v), 6).alias("back"))


@plain("SELECT event_id, CAST(round((user_id % 360) * 0.1 - 180, 6) AS DOUBLE) AS lon, CAST(floor((value - 0.5) / 0.25) AS BIGINT) AS cell FROM events")
def fn_affine(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(ph.cell_to_map(F.col("user_id") % 360, -180.0, 0.1), 6).alias("lon"), ph.map_to_cell(F.col("value"), 0.5, 0.25).alias("cell"))


Q = "((1 - {e}*{e}) * (sin(radians({l})) / (1 - {e}*{e}*sin(radians({l}))*sin(radians({l}))) - ln((1 - {e}*sin(radians({l}))) / (1 + {e}*sin(radians({l})))) / (2*{e})))"


@plain(f"SELECT DISTINCT user_id, round(radians(0.1) * 6378137.0 * 6378137.0 / 2 * ({Q.format(e=0.0818191908426215, l='(user_id % 60 + 0.1)')} - {Q.format(e=0.0818191908426215, l='(user_id % 60)')}) / 1e6, 4) AS km2, CAST(floor((user_id % 360) / 6) % 60 + 1 AS INTEGER) AS zone, CAST(greatest(0, floor(log2(360.0 / (1 + user_id % 90)))) AS INTEGER) AS zoom FROM events")
def fn_area_km2(spark: SparkSession, d: str) -> DataFrame:
    lat = (F.col("user_id") % 60).cast("double")
    return table(spark, d, "events").select("user_id", F.round(ph.equal_area_km2(lat, lat + 0.1, 0.1), 4).alias("km2"), ph.utm_zone(F.col("user_id") % 360 - 180).alias("zone"), ph.map_zoom(1 + F.col("user_id") % 90).alias("zoom")).distinct()


@query("SELECT frame, level, label, CASE WHEN n_points < 3 THEN n_points ELSE 2 * n_points END AS n_smooth FROM ua")
def fn_chaikin(g: Grid) -> DataFrame:
    body = F.split(F.regexp_extract(F.coalesce("trajectory", F.lit("LINESTRING (0 0)")), r"\((.*)\)", 1), ", ")
    pts = F.transform(body, lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("x"), F.split(p, " ")[1].cast("double").alias("y")))
    return g.links.select(*K, F.size(ph.chaikin(pts)).alias("n_smooth"))


NEAR = "FROM cell a JOIN cell b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.frame, a.y, a.x"
for _name, _f, _sql in (
    ("img_median", imaging.median, f"SELECT a.frame, a.y, a.x, round(median(b.value), 6) AS value {NEAR}"),
    ("img_dilate", imaging.dilate, f"SELECT a.frame, a.y, a.x, round(max(b.value), 6) AS value {NEAR}"),
    ("img_erode", imaging.erode, f"SELECT a.frame, a.y, a.x, round(min(b.value), 6) AS value {NEAR}"),
    ("img_blur", imaging.gaussian_blur, f"SELECT a.frame, a.y, a.x, round(sum(b.value * exp(-(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / 2)) / sum(exp(-(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / 2)) + 1e-9, 6) AS value {NEAR}"),
    ("img_sharpen", imaging.sharpen, f"SELECT a.frame, a.y, a.x, round(sum(CASE abs(a.y - b.y) + abs(a.x - b.x) WHEN 0 THEN 5 WHEN 1 THEN -1 ELSE 0 END * b.value), 6) AS value {NEAR}"),
    ("img_normalize", imaging.normalize, "SELECT frame, y, x, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) * 255 ELSE 0 END, 6) AS value FROM cell JOIN (SELECT frame, min(value) AS lo, max(value) AS hi FROM cell GROUP BY frame) USING (frame)"),
    ("img_zscore", imaging.zscore, "SELECT frame, y, x, round((value - mu) / sd, 6) AS value FROM cell JOIN (SELECT frame, avg(value) AS mu, stddev_pop(value) AS sd FROM cell GROUP BY frame) USING (frame)"),
    ("img_threshold", lambda c: imaging.binarize(c, 100.0), "SELECT frame, y, x, CAST(CASE WHEN value > 100 THEN 255 ELSE 0 END AS DOUBLE) AS value FROM cell"),
    ("img_equalize", imaging.equalize, "SELECT frame, y, x, round(CASE WHEN total > c0 THEN (cdf - c0) * 255.0 / (total - c0) ELSE 0 END, 6) AS value FROM (SELECT frame, y, x, cdf, total, min(cdf) OVER (PARTITION BY frame) AS c0 FROM (SELECT frame, y, x, count(*) OVER (PARTITION BY frame ORDER BY bin) AS cdf, count(*) OVER (PARTITION BY frame) AS total FROM (SELECT frame, y, x, floor(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) * 255 ELSE 0 END) AS bin FROM cell JOIN (SELECT frame, min(value) AS lo, max(value) AS hi FROM cell GROUP BY frame) USING (frame))))"),
):
    def _img(g: Grid, f=_f) -> DataFrame:
        return f(g.cells).select("frame", "y", "x", *(off if f is imaging.gaussian_blur else r6)("value"))

    _img.__name__ = _name
    query(_sql)(_img)


@query()
def vec_opt(g: Grid) -> DataFrame:
    return imaging.flow_vectors(imaging.normalize(g.cells), g.labelled, g.pairs, g.width, g.width)


@query()
def vec_farneback(g: Grid) -> DataFrame:
    return imaging.flow_vectors(imaging.normalize(g.cells), g.labelled, g.pairs, g.width, g.width, method="farneback")


CANNY = """, im AS MATERIALIZED (SELECT frame, y, x, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) * 255 ELSE 0 END AS value FROM cell JOIN (SELECT frame, min(value) AS lo, max(value) AS hi FROM cell GROUP BY frame) USING (frame)),
sh AS (SELECT frame, max(y) AS my, max(x) AS mx FROM im GROUP BY frame),
al AS MATERIALIZED (SELECT frame, my, mx, y, x, coalesce(value, 0) AS v FROM (SELECT frame, my, mx, unnest(range(my + 1)) AS y FROM sh) s JOIN (SELECT frame, unnest(range(mx + 1)) AS x FROM sh) t USING (frame) LEFT JOIN im USING (frame, y, x)),
gr AS MATERIALIZED (SELECT a.frame, a.y, a.x, CASE WHEN least(a.my, a.mx) = 0 THEN 0 ELSE (coalesce(d.v, a.v) - coalesce(u.v, a.v)) / (CASE WHEN d.v IS NULL OR u.v IS NULL THEN 1 ELSE 2 END) END AS gy,
  CASE WHEN least(a.my, a.mx) = 0 THEN 0 ELSE (coalesce(r.v, a.v) - coalesce(l.v, a.v)) / (CASE WHEN r.v IS NULL OR l.v IS NULL THEN 1 ELSE 2 END) END AS gx FROM al a LEFT JOIN al u ON u.frame = a.frame AND u.y = a.y - 1 AND u.x = a.x LEFT JOIN al d ON d.frame = a.frame AND d.y = a.y + 1 AND d.x = a.x
  LEFT JOIN al l ON l.frame = a.frame AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN al r ON r.frame = a.frame AND r.y = a.y AND r.x = a.x + 1),
mg AS MATERIALIZED (SELECT frame, y, x, sqrt(gx * gx + gy * gy) AS m, (CAST(round_even(atan2(gy, gx) / (pi() / 4), 0) AS INTEGER) + 8) % 4 AS k FROM gr),
ri AS MATERIALIZED (SELECT a.frame, a.y, a.x, a.m FROM mg a JOIN (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) s(k, dy, dx) ON s.k = a.k LEFT JOIN mg p ON p.frame = a.frame AND p.y = a.y + dy AND p.x = a.x + dx
  LEFT JOIN mg q ON q.frame = a.frame AND q.y = a.y - dy AND q.x = a.x - dx WHERE a.m >= coalesce(p.m, 0) - 1e-9 AND a.m >= coalesce(q.m, 0) - 1e-9 AND a.m >= 20),
ke AS (SELECT frame, y, x FROM ri WHERE m >= 60 UNION SELECT r.frame, r.y, r.x FROM ke JOIN ri r ON r.frame = ke.frame AND abs(r.y - ke.y) <= 1 AND abs(r.x - ke.x) <= 1)"""


@query(CANNY + " SELECT frame, y, x, CASE WHEN ke.frame IS NULL THEN 0.0::DOUBLE ELSE 255.0::DOUBLE END AS value FROM im LEFT JOIN (SELECT * FROM ke) ke USING (frame, y, x)")
def img_canny(g: Grid) -> DataFrame:
    return imaging.canny(imaging.normalize(g.cells), 20.0, 60.0)


@query("SELECT a.frame, a.y, a.x, round(sum(b.value * exp(-(pow(b.x - a.x, 2) + 0.25 * pow(b.y - a.y, 2)) / 8) * cos(2 * pi() * (b.x - a.x) / 5)) + 1e-9, 6) AS value FROM cell a JOIN cell b ON a.frame = b.frame AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 GROUP BY a.frame, a.y, a.x")
def img_gabor(g: Grid) -> DataFrame:
    return imaging.gabor(g.cells).select("frame", "y", "x", *off("value"))


@query()
def img_noise(g: Grid) -> DataFrame:
    return imaging.noise(g.cells)


@query("SELECT frame, y, x, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END, 6) AS value FROM cell JOIN (SELECT frame, min(value) AS lo, max(value) AS hi FROM cell GROUP BY frame) USING (frame)")
def img_scale(g: Grid) -> DataFrame:
    return imaging.scale(g.cells).select("frame", "y", "x", *r6("value"))


@plain("SELECT CAST(vec_id AS INTEGER) AS frame, sum(CASE WHEN e >= 0.05 THEN 1 ELSE 0 END) :: BIGINT AS warm, sum(CASE WHEN e <= -0.05 THEN 1 ELSE 0 END) :: BIGINT AS cold, round(max(e), 6) AS peak FROM (SELECT vec_id, unnest(embedding) :: DOUBLE AS e FROM embeddings) GROUP BY vec_id")
def src_arrays(spark: SparkSession, d: str) -> DataFrame:
    c = S.array_cells(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    hit = lambda op, t: F.count(F.when(T.passes(F.col("value"), op, t), 1))
    return c.groupBy("frame").agg(hit(">=", 0.05).alias("warm"), hit("<=", -0.05).alias("cold"), F.round(F.max("value"), 6).alias("peak"))


def _bubble_sql(frames: int, size: int) -> str:
    rows = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in spec) + ")" for spec in S.bubble_specs(size))
    return f"""WITH b(cx, cy, vx, vy, rx, ry, phase) AS (VALUES {rows}), f AS (SELECT CAST(i AS INTEGER) AS frame FROM range({frames}) t(i)),
m AS (SELECT frame, cx + frame * vx + 2 * sin(frame / 5.0 + phase) AS mx, cy + frame * vy + 2 * cos(frame / 7.0 + phase) AS my, rx * (1 + 0.3 * sin(frame / 4.0 + phase)) AS ax, ry * (1 + 0.3 * cos(frame / 4.0 + phase)) AS ay FROM b, f),
g AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM range({size}) s(y), range({size}) t(x))
SELECT frame, y, x, round(max(50 * (1 - (pow((x - mx) / ax, 2) + pow((y - my) / ay, 2))) + 10), 6) AS value FROM m, g WHERE pow((x - mx) / ax, 2) + pow((y - my) / ay, 2) <= 1 GROUP BY frame, y, x"""


@plain(_bubble_sql(40, 96))
def src_bubbles(spark: SparkSession, d: str) -> DataFrame:
    return S.bubbles(spark, 40, 96).select("frame", "y", "x", *r6("value"))


@plain("SELECT date_trunc('day', ts) AS day, count(*) AS n, round(avg(size), 6) AS mean_size FROM (SELECT timestamp AS ts, size FROM trackingtable WHERE timestamp IS NOT NULL) GROUP BY ALL")
def src_catalog(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trackingtable").filter("timestamp IS NOT NULL").select(F.date_trunc("day", "timestamp").alias("day"), "size")
    return t.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("size"), 6).alias("mean_size"))


@plain("SELECT ws AS start, count(value) AS n_events, max(value) AS peak FROM (SELECT value, unnest([to_timestamp(CAST((floor(epoch(ts) / 43200) - k) * 43200 AS BIGINT)) AT TIME ZONE 'UTC' FOR k IN [0, 1, 2, 3]]) AS ws FROM events) GROUP BY ws")
def stream_frames(spark: SparkSession, d: str) -> DataFrame:
    """The windows as a stream over the event files, driven to the end of the input.

    Complete mode, as the last windows are never passed by a watermark; the result lies in files.
    """
    src = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    windows = live.window_counts(src.withColumn("ts", F.col("ts").cast("timestamp")))
    out = live.run_to_table(windows, new_path(spark, "windows"), new_path(spark, "ckpt"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(", ro AS (SELECT level, rf, rl, row_number() OVER (PARTITION BY level ORDER BY rf, rl) AS uid FROM (SELECT DISTINCT level, rf, rl FROM ch)) SELECT 'grid' AS source, level, frame, label, CAST(uid AS BIGINT) AS uid, CAST(size AS INTEGER) AS size FROM ch JOIN ro USING (level, rf, rl) JOIN clus USING (frame, level, label)")
def stream_link(g: Grid) -> DataFrame:
    path = new_path(g.spark, "cells")
    cells = g.cells.select(F.lit("grid").alias("source"), "frame", (F.col("frame") * 720).cast("bigint").alias("ts_min"), "y", "x", "value")
    cells.unionByName(live.end_marks(cells, g.cfg.delta_time)).orderBy("frame").coalesce(1).write.parquet(path)
    src = g.spark.readStream.schema(cells.schema).parquet(path)
    return live.run_to_table(live.link_stream(src, g.cfg, g.width), new_path(g.spark, "links"), new_path(g.spark, "ckpt"))
