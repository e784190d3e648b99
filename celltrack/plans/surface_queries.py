"""Queries of files, stored tables, converters and enrichment, and their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrack import api
from celltrack.functions import components_udtf
from celltrack.functions import physics as ph
from celltrack.operators import convert, enrich, imaging, proximity
from celltrack.operators import tracking as T
from celltrack.plans import more_queries as mq
from celltrack.plans import tracking_queries as tq
from celltrack.plans import training_queries
from celltrack.plans.fixture import Grid
from celltrack.plans.tracking_queries import K, P, TT, off, r6
from celltrack.runtime import new_path, table
from celltrack.sources import catalog
from celltrack.sources import frames as S

QUERIES: dict[str, tq.Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, pre: str = P, fixture: str = "plain"):
    def put(f):
        tq.query(sql, pre, fixture)(f)
        QUERIES[f.__name__] = tq.QUERIES.pop(f.__name__)
        if sql is not None:
            SQL[f.__name__] = tq.SQL.pop(f.__name__)
        return f

    return put


def plain(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def flat(c: str, digits: int) -> Column:
    """Rounded, without a negative zero."""
    return F.when(F.round(c, digits) == 0, 0.0).otherwise(F.round(c, digits)).alias(c)


BAD = 7


def frame_files(g: Grid) -> str:
    """A folder of text files, one for each frame, named by its time; frame ``BAD`` cannot be read."""
    path = new_path(g.spark, "frames")
    at = F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp")
    lines = g.frames.join(g.cells, "frame", "left").select(at, F.when(F.col("frame") == BAD, "?").otherwise(F.coalesce(F.concat_ws(" ", "y", "x", "value"), F.lit(""))).alias("value"))
    lines.repartition("stamp").write.partitionBy("stamp").text(path)
    return path


def text_grid(width: int):
    def read(content: bytes) -> np.ndarray:
        a = np.full((width, width), np.nan)
        for y, x, v in (line.split() for line in content.decode().splitlines() if line.strip()):
            a[int(y), int(x)] = float(v)
        return a

    return read


FILES = ((r"stamp=(\d{8}_\d{6})", "yyyyMMdd_HHmmss"),)


@query(f"SELECT ts, CASE WHEN frame = {BAD} THEN 0 ELSE count(value) END AS n_cells, CASE WHEN frame = {BAD} THEN NULL ELSE round(sum(value), 4) END AS total, frame = {BAD} AS failed FROM fr LEFT JOIN cell USING (frame) GROUP BY ts, frame HAVING count(value) > 0 OR frame = {BAD}")
def src_bad_frame(g: Grid) -> DataFrame:
    """Frames from files; one that cannot be read stays known, without cells. Frames without cells have empty files and no row here."""
    f = S.read_frames(g.spark, frame_files(g), text_grid(g.width), FILES)
    return f.groupBy(F.col("ts").cast("timestamp_ntz").alias("ts")).agg(F.count("value").alias("n_cells"), F.round(F.sum("value"), 4).alias("total"), F.max("failed").alias("failed"))


@query(f"SELECT CAST(epoch(ts) AS BIGINT) AS epoch, y, x, value FROM cell JOIN fr USING (frame) WHERE frame <> {BAD}")
def src_files(g: Grid) -> DataFrame:
    f = S.read_frames(g.spark, frame_files(g), text_grid(g.width), FILES)
    return f.filter("NOT failed").select(F.unix_seconds("ts").alias("epoch"), "y", "x", "value")


@query(f", {TT} SELECT mode, CAST(ts AS DATE) AS day, count(*) AS n FROM tt, (VALUES ('forecast'), ('track')) m(mode) WHERE mode = 'track' OR level = 0 GROUP BY ALL")
def src_catalog_modes(g: Grid) -> DataFrame:
    """Two modes stored side by side, each read again through its directories; every listed day must hold rows."""
    root = new_path(g.spark, "catalog")
    t = g.tracks.drop("merge_labels")
    catalog.store(t, root, "track")
    catalog.store(t.filter("level = 0").drop("max"), root, "forecast")
    both = catalog.read(g.spark, root, "track").unionByName(catalog.read(g.spark, root, "forecast"))
    listed = catalog.catalog(g.spark, root).filter("n_files > 0 AND n_bytes > 0").select("mode", "day")
    return both.groupBy("mode", "day").agg(F.count(F.lit(1)).alias("n")).join(listed, ["mode", "day"])


@query(f", {TT} SELECT frame, ts FROM fr WHERE ts NOT IN (SELECT ts FROM tt WHERE frame % 3 > 0)")
def src_resume(g: Grid) -> DataFrame:
    return catalog.remaining(g.frames, g.tracks.filter("frame % 3 > 0"))


@query("SELECT frame, level, y, x, value FROM lab")
def raster_lists(g: Grid) -> DataFrame:
    return convert.raster_lists(T.pixel_arrays(g.labelled), "array_values")


@query("SELECT frame, level, y, x, size, round(mean + 1e-9, 6) AS mean, max FROM lab JOIN clus USING (frame, level, label)".replace("lab JOIN clus", "(SELECT frame, level, label, y, x FROM lab) lab JOIN (SELECT frame, level, label, size, mean, max FROM clus) clus"))
def raster_columns(g: Grid) -> DataFrame:
    return convert.raster_columns(g.labelled, g.tracks, ("size", "mean", "max")).select("frame", "level", "y", "x", "size", *off("mean"), "max")


LONG = """, lv1 AS (SELECT frame, level, label, unnest(['noc', 'spl', 'mrg', 'inc', 'elp']) AS method, unnest([u_, u_spl, u_mrg, u_inc, u_]) AS u, unnest([v_, v_spl, v_mrg, v_inc, v_]) AS v FROM vec)"""


@query(LONG + " SELECT frame, level, method, CAST(floor(cy) AS INTEGER) AS y, CAST(floor(cx) AS INTEGER) AS x, CASE WHEN round(max(u), 6) = 0 THEN 0::DOUBLE ELSE round(max(u), 6) END AS u, CASE WHEN round(max(v), 6) = 0 THEN 0::DOUBLE ELSE round(max(v), 6) END AS v FROM lv1 JOIN clus USING (frame, level, label) WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY ALL")
def raster_method_vectors(g: Grid) -> DataFrame:
    return convert.vector_cells(g.tracks).select("frame", "level", "method", "y", "x", flat("u", 6), flat("v", 6))


def _ang(u: str, v: str, name: str) -> str:
    return f"round(CASE WHEN degrees(atan2({v}, {u})) < 0 THEN degrees(atan2({v}, {u})) + 360 ELSE degrees(atan2({v}, {u})) END, 6) AS {name}"


@query(mq.MEASURE + ", a AS (SELECT frame, level, label, " + ", ".join(_ang(u, v, n) for u, v, n in (("u_", "v_", "ang_"), ("u_spl", "v_spl", "ang_spl"), ("u_mrg", "v_mrg", "ang_mrg"), ("u_inc", "v_inc", "ang_inc"), ("u_", "v_", "ang_elp"))) + " FROM vec) SELECT a.*, perimeter FROM a JOIN me USING (frame, level, label)")
def conv_boundaries_full(g: Grid) -> DataFrame:
    """Every vector pair's angle, and the length of the outline that goes with it."""
    from celltrack.functions import wkt

    b = convert.boundaries(g.tracks, g.outlines())
    ang = ["ang_", "ang_spl", "ang_mrg", "ang_inc", "ang_elp"]

    def length(batches):
        for x in batches:
            yield x.drop(columns="geometry").assign(perimeter=wkt.measures(x["geometry"])["perimeter"])

    kinds = "frame int, level int, label bigint, " + ", ".join(f"{a} double" for a in ang) + ", perimeter double"
    return b.select(*K, *ang, "geometry").mapInPandas(length, kinds).select(*K, *(F.round(F.when(~F.isnan(a), F.col(a)), 6).alias(a) for a in ang), "perimeter")


@query("SELECT frame, level, label, y, x, printf('LINESTRING (%.6f %.6f, %.6f %.6f)', 10 + x * 0.5, 20 + y * 0.25, 10 + x * 0.5 + round(u_, 3) * 0.5, 20 + y * 0.25 + round(v_, 3) * 0.25) AS geometry FROM lab JOIN vec USING (frame, level, label) WHERE u_ IS NOT NULL")
def conv_vectorfield(g: Grid) -> DataFrame:
    points = g.labelled.join(g.vecs.filter("u_ IS NOT NULL").select(*K, F.round("u_", 3).alias("u"), F.round("v_", 3).alias("v")), K)
    return convert.vectorfield(points, (10.0, 20.0), (0.5, 0.25)).select(*K, "y", "x", "geometry")


@query("SELECT frame, level, y, x, CAST(label AS DOUBLE) AS value FROM lab")
def sink_grid(g: Grid) -> DataFrame:
    """Rows of the grid written in Parquet and read again as cells."""
    path = new_path(g.spark, "grid")
    convert.write_grid(g.labelled.select("frame", "level", "y", "x", F.col("label").alias("value")), path, g.width, g.width)
    return convert.read_grid(g.spark, path, "frame int, level int")


FAMILY = f""", {TT}, q AS (SELECT tt.uid, tt.ts, tt.level, tt.label, tt.size, tt.cx, tt.cy, tt.mean, tt.max, coalesce(v.expansion, -999.99) AS expansion FROM tt JOIN vec v USING (frame, level, label))"""


@query(FAMILY + """ SELECT uid, CAST(row_number() OVER (PARTITION BY uid ORDER BY ts, level, label) AS BIGINT) AS k, printf('%s %2d %8d', strftime(ts, '%Y%m%d %H%M'), level, size) AS head, CAST(printf('%.3f', expansion) AS DOUBLE) AS expansion FROM q
UNION ALL SELECT uid, 0, printf('FAMILY %8d %6d %s %s %8.2f', uid, count(*), strftime(min(ts), '%Y%m%d %H%M'), strftime(max(ts), '%Y%m%d %H%M'), date_diff('minute', min(ts), max(ts)) / 60.0), NULL FROM q GROUP BY uid""")
def sink_report(g: Grid) -> DataFrame:
    """The family report as text lines, written and read again; long decimals are compared as numbers."""
    path = new_path(g.spark, "report")
    convert.family_report(g.tracks).select(F.concat_ws("|", "uid", "k", "line").alias("value")).write.text(path)
    part = F.split("value", r"\|")
    t = g.spark.read.text(path).select(part[0].cast("bigint").alias("uid"), part[1].cast("bigint").alias("k"), part[2].alias("line"))
    return t.select("uid", "k", F.when(F.col("k") == 0, F.col("line")).otherwise(F.substring("line", 1, 25)).alias("head"), F.when(F.col("k") > 0, F.element_at(F.split("line", " +"), -1).cast("double")).alias("expansion"))


@query(FAMILY + " SELECT uid, count(*) AS n, max(size) AS max_size, round(min(expansion), 3) AS least FROM q GROUP BY uid")
def sink_csv(g: Grid) -> DataFrame:
    """Semicolon-separated rows with undefined values marked, written and read again."""
    path = new_path(g.spark, "csv")
    convert.clean(g.tracks.select("uid", "size", "expansion")).write.option("sep", ";").option("header", True).csv(path)
    t = g.spark.read.option("sep", ";").option("header", True).schema("uid double, size double, expansion double").csv(path)
    return t.groupBy(F.col("uid").cast("bigint").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.max("size").cast("bigint").alias("max_size"), F.round(F.min("expansion"), 3).alias("least"))


@query(mq.ZONAL + f", {TT} SELECT tt.frame, tt.level, tt.label, tt.uid, round(avg(value), 6) AS rain_mean, max(value) AS rain_max, count(value) AS n FROM tt LEFT JOIN zz USING (frame, level, label) GROUP BY ALL")
def enrich_raster(g: Grid) -> DataFrame:
    t = enrich.add_raster(g.tracks.select(*K, "uid"), g.labelled, g.frames, mq.raster(g), "rain", ("mean", "max"), values=True)
    return t.select(*K, "uid", *r6("rain_mean"), "rain_max", F.coalesce(F.size("rain_values"), F.lit(0)).cast("bigint").alias("n"))


@query(mq.RASTER + ", w2 AS (SELECT i AS k FROM range((SELECT w FROM w)) t(i)) SELECT ra.ts, CAST(b.k AS INTEGER) AS y, CAST(a.k AS INTEGER) AS x, value FROM w2 a, w2 b JOIN ra ON ra.y = CAST(floor((b.k * 0.5 + 0.25 + 1) / 0.75) AS INTEGER) JOIN w2 a2 ON a2.k = a.k WHERE ra.x = CAST(floor((a.k * 0.5 + 0.25 + 1) / 0.75) AS INTEGER)".replace("FROM w2 a, w2 b JOIN ra ON ra.y", "FROM w2 a CROSS JOIN w2 b JOIN ra ON ra.y"))
def enrich_resample(g: Grid) -> DataFrame:
    """A raster of coarser cells and another corner, on the grid by its cells' centres."""
    return enrich.resample(mq.raster(g), (-1.0, -1.0), (0.75, 0.75), (0.0, 0.0), (0.5, 0.5), g.width, g.width)


@query("SELECT frame, level, label, y, (x + 5) % w AS x, CAST((x + 5) // w AS INTEGER) AS part FROM lab, w".replace("(x + 5) % w AS x", "CAST((x + 5) % w AS INTEGER) AS x"))
def fn_dateline(g: Grid) -> DataFrame:
    return convert.split_dateline(g.labelled.select(*K, "y", (F.col("x") + 5).alias("x")), g.width)


HULLS = mq.HULL.replace("px * qy - qx * py AS cr FROM", "px, py, qx, qy, px * qy - qx * py AS cr FROM") + """,
hp AS MATERIALIZED (SELECT c.frame, c.level, c.label, gy.y, gx.x FROM clus c JOIN (SELECT CAST(i AS INTEGER) AS y FROM range(0, (SELECT w FROM w)) t(i)) gy ON gy.y BETWEEN c.ymin AND c.ymax JOIN (SELECT CAST(i AS INTEGER) AS x FROM range(0, (SELECT w FROM w)) t(i)) gx ON gx.x BETWEEN c.xmin AND c.xmax
  JOIN hu e ON e.frame = c.frame AND e.level = c.level AND e.label = c.label GROUP BY ALL HAVING bool_and((qx - px) * (gy.y + 0.5 - py) - (qy - py) * (gx.x + 0.5 - px) >= 0)),
hs AS (SELECT frame, level, label, count(*) AS size FROM hp GROUP BY ALL)"""


@query(HULLS + " SELECT * FROM (SELECT a.frame, a.level, a.label, fp.prev_frame, b.label AS prev_label, count(*) AS shared, any_value(s.size) AS size, any_value(p.size) AS prev_size, round(100.0 * count(*) / any_value(p.size), 6) AS overlap FROM hp a JOIN fp ON fp.frame = a.frame JOIN hp b ON b.frame = fp.prev_frame AND b.level = a.level AND b.y = a.y AND b.x = a.x JOIN hs s ON (s.frame, s.level, s.label) = (a.frame, a.level, a.label) JOIN hs p ON (p.frame, p.level, p.label) = (b.frame, b.level, b.label) GROUP BY a.frame, a.level, a.label, fp.prev_frame, b.label) WHERE overlap >= 10", fixture="hull")
def overlay_hull(g: Grid) -> DataFrame:
    """Overlaps of convex hulls, by pixel centres."""
    return g.edges.select(*K, "prev_frame", "prev_label", "shared", "size", "prev_size", *r6("overlap"))


@query("SELECT frame, list(label ORDER BY level, label) AS label, list(size ORDER BY level, label) AS size FROM clus GROUP BY frame")
def ana_lists(g: Grid) -> DataFrame:
    return convert.lists_by_time(g.feats, ("label", "size"), ("level", "label"))


@query("SELECT p.frame, p.level, l.label, p.y, p.x FROM px p JOIN lab0 l USING (frame, level, id)")
def cc_udtf(g: Grid) -> DataFrame:
    """Components by the table function from SQL, before small ones are left out."""
    name = f"label_components_{uuid.uuid4().hex[:8]}"
    components_udtf.register(g.spark, name)
    g.pixels.select("frame", "level", "y", "x", F.lit(g.width).alias("x_dim"), F.lit(g.cfg.radius).alias("radius")).createOrReplaceTempView(f"{name}_cells")
    return g.spark.sql(f"SELECT frame, level, label, y, x FROM {name}(TABLE({name}_cells) PARTITION BY (frame, level))")


@query(f", {TT} SELECT tt.frame, tt.level, tt.label, u_, v_, u_spl, v_spl, u_mrg, v_mrg, u_inc, v_inc FROM tt JOIN vec USING (frame, level, label)".replace("u_, v_, u_spl, v_spl, u_mrg, v_mrg, u_inc, v_inc", ", ".join(f"CASE WHEN round({c}, 5) = 0 THEN 0::DOUBLE ELSE round({c}, 5) END AS {c}" for c in ("u_", "v_", "u_spl", "v_spl", "u_mrg", "v_mrg", "u_inc", "v_inc"))))
def track_wildcards(g: Grid) -> DataFrame:
    """Vector columns found by their beginnings."""
    found = [c for c in api.wildcards(g.tracks, ("u_*", "v_*")) if not c.endswith("elp")]
    return g.tracks.select(*K, *(flat(c, 5) for c in found))


_P1 = training_queries.SQL["p1_found"]
REGIONS = _P1[: _P1.index("SELECT DISTINCT 'near'")] + """, z AS (SELECT cindex, region_id, count(DISTINCT (lon, lat)) AS n FROM h JOIN l2 ON l2.id = h.pid AND l2.cindex = h.cindex GROUP BY ALL)
SELECT cindex, region_id, name AS region FROM (SELECT cindex, arg_min(region_id, -n * 100000 + region_id) AS region_id FROM z GROUP BY cindex) JOIN regions USING (region_id)"""


@plain(REGIONS.replace("count(DISTINCT (lon, lat)) AS n FROM h JOIN l2 ON l2.id = h.pid AND l2.cindex = h.cindex", "count(DISTINCT (lon, lat)) AS n FROM (SELECT pid, region_id FROM h) JOIN l2 ON l2.id = pid"))
def enrich_regions(spark: SparkSession, d: str) -> DataFrame:
    """``(cindex, region_id, region)`` of the rows of trackingtable whose centre lies in a region, by polygons."""
    at = proximity.locate(table(spark, d, "trackingtable").filter("cindex IS NOT NULL").select("cindex", "geometry"), keep=("cindex",)).filter("lon IS NOT NULL").distinct()
    rows = table(spark, d, "trackingtable").filter("cindex IS NOT NULL").select("cindex").distinct()
    return enrich.add_polygons(rows, at, table(spark, d, "regions"), ("cindex",)).filter("region_id IS NOT NULL")


def _planted(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two images of a smooth blob moved by a known step, for several steps: cells, labelled pixels and frame pairs."""
    size = 64
    place = F.explode(F.sequence(F.lit(0), F.lit(size * size - 1)))
    steps = spark.createDataFrame([(2 * k, 2 * k + j, u * j, v * j) for k, (u, v) in enumerate(STEPS) for j in (0, 1)], "pair int, frame int, u double, v double")
    blob = lambda cy, cx, r: F.exp(-(F.pow(F.col("y") - cy - F.col("v"), 2) + F.pow(F.col("x") - cx - F.col("u"), 2)) / (2 * r * r))
    grid = steps.withColumn("id", place).withColumns({"y": F.floor(F.col("id") / size).cast("int"), "x": (F.col("id") % size).cast("int")})
    cells = grid.select("frame", "pair", "y", "x", (200 * blob(30, 30, 7) + 60 * blob(34, 26, 3) + 40 * blob(27, 35, 3)).alias("value"))
    labelled = cells.filter("frame % 2 = 1 AND value > 60").select("frame", F.lit(0).alias("level"), F.lit(1).cast("bigint").alias("label"), "y", "x")
    pairs = steps.filter("frame = pair + 1").select("frame", F.col("pair").alias("prev_frame"))
    return cells.drop("pair"), labelled, pairs


STEPS = ((0.0, 0.0), (1.0, 0.0), (2.5, -1.5), (-4.0, 3.0), (12.0, -9.0), (-14.0, 5.0))
PLANTED = "SELECT CAST(2 * k + 1 AS INTEGER) AS frame, u, v FROM (VALUES " + ", ".join(f"({k}, {u}::DOUBLE, {v}::DOUBLE)" for k, (u, v) in enumerate(STEPS)) + ") t(k, u, v)"


def _flow(spark: SparkSession, method: str) -> DataFrame:
    cells, labelled, pairs = _planted(spark)
    f = imaging.flow_vectors(cells, labelled, pairs, 64, 64, method=method)
    near = lambda c: F.round(F.col(c) * 2) / 2 + 0.0
    return f.select("frame", near("u_opt").alias("u"), near("v_opt").alias("v"))


@plain(PLANTED)
def vec_opt_planted(spark: SparkSession, d: str) -> DataFrame:
    """Flow of images that move by known steps, to half a cell."""
    return _flow(spark, "lucas-kanade")


@plain(PLANTED + " WHERE u <> 0 OR v <> 0")
def vec_farneback_planted(spark: SparkSession, d: str) -> DataFrame:
    return _flow(spark, "farneback")
