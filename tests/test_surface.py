"""Converters, enrichment, stored tables and numbering on small cases."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_tracking import CFG, Run

from celltrack import api
from celltrack.functions import components_udtf
from celltrack.operators import convert, enrich, forecast, imaging
from celltrack.operators import tracking as T
from celltrack.sources import catalog

SPLIT_MERGE = [[(1, 4, 1, 9, 3)], [(1, 4, 1, 4, 3), (1, 4, 6, 9, 2)], [(1, 4, 1, 5, 3), (1, 4, 7, 9, 2)], [(1, 4, 1, 9, 3)]]


def test_numbers_follow_the_order_of_the_key(spark):
    keys = random.Random(1).sample(range(-(10**15), 10**15), 5000)
    df = spark.createDataFrame([(k,) for k in keys], "root bigint").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    got = {r.root: r.n for r in T.number_in_order(df, "root", "n").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    assert T.number_in_order(df.limit(0), "root", "n").count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trails_of_trees_with_several_heirs(spark):
    rng = random.Random(3)
    parent = {i: (rng.randrange(max(0, i - 4), i) if i and rng.random() < 0.85 else None) for i in range(120)}
    nodes = spark.createDataFrame([(i, p, None if p is None else i % 7) for i, p in parent.items()], "id bigint, parent bigint, weight bigint").withColumn("point", F.struct(F.col("id").alias("x")))
    for r in T.trails(nodes).collect():
        line, at = [r.id], r.id
        while parent[at] is not None:
            at = parent[at]
            line.append(at)
        assert (r.root, r.weight, [p.x for p in r.path]) == (at, sum(i % 7 for i in line[:-1]), line[::-1])


def test_inner_ranks_keep_all_their_digits(spark):
    """More than 10,000 inner tracks within one uid stay apart."""
    n = 10_050
    feats = spark.range(n).select(F.lit(0).alias("frame"), F.lit(1).alias("level"), (F.col("id") * 2).alias("label"), F.lit(1).cast("bigint").alias("size"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    feats = feats.unionByName(spark.createDataFrame([(0, 0, 10**7, 50000, 0.0, 0.0)], feats.schema))
    null = lambda t: F.lit(None).cast(t)
    ev = feats.select("frame", "level", "label", F.lit("NEW").alias("status"), null("int").alias("prev_frame"), null("bigint").alias("past_label"), null("array<bigint>").alias("merge_labels"), null("bigint").alias("split_parent"))
    nested = feats.filter("level = 1").select("frame", F.lit(0).alias("level"), F.lit(10**7).cast("bigint").alias("label"), F.lit(1).alias("in_level"), F.col("label").alias("in_label"))
    frames = spark.createDataFrame([(0, datetime(2024, 1, 1))], "frame int, ts timestamp_ntz")
    ids = T.link(feats, ev, nested, frames, CFG).filter("level = 1").select("uid", "iuid", "inner").collect()
    assert len({r.iuid for r in ids}) == n and {r.uid for r in ids} == {1} and {r.inner for r in ids} == set(range(1, n + 1))


def test_previous_ids(spark):
    run = Run(spark, SPLIT_MERGE)
    links, ev = T.link(run.feats, run.ev, run.nested, run.frames, CFG).cache(), run.ev
    prev = {(r.frame, r.label): r for r in T.previous_ids(links, ev).filter("level = 0").collect()}
    uid = {(r.frame, r.label): r.uid for r in links.filter("level = 0").collect()}
    for r in ev.filter("level = 0").collect():
        want = None if r.merge_labels is None else [uid[r.prev_frame, m] for m in r.merge_labels]
        assert prev[r.frame, r.label].prv_mrg_uids == want if want else (r.frame, r.label) not in prev or prev[r.frame, r.label].prv_mrg_uids is None
        if r.split_parent is not None:
            assert prev[r.frame, r.label].prv_spl_uid == uid[r.prev_frame, r.split_parent]
    assert T.previous_ids(links.limit(0), ev.limit(0)).count() == 0


@pytest.mark.parametrize("tolerance", [None, 90])
def test_asof_by_days_equals_brute_force(spark, tolerance):
    rng = random.Random(tolerance)
    start = datetime(2024, 2, 27)
    at = lambda: start + timedelta(minutes=rng.randrange(0, 9 * 24 * 60) // 7 * 7)
    asked, known = [at() for _ in range(60)] + [None, start - timedelta(days=40), start + timedelta(days=90)], [at() for _ in range(25)] + [None]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, ts timestamp_ntz")
    right = spark.createDataFrame([(t,) for t in known], "ts timestamp_ntz")
    got = {r.i: r.match_ts for r in enrich.asof(left, right, "nearest", tolerance).collect()}
    there = sorted({t for t in known if t})
    for i, t in enumerate(asked):
        best = None if t is None else min(there, key=lambda k: (abs(k - t), k))
        assert got[i] == (None if best is None or tolerance is not None and abs(best - t) > timedelta(minutes=tolerance) else best)
    assert {r.match_ts for r in enrich.asof(left, right.limit(0)).collect()} == {None}


def test_resampling_takes_the_cell_under_each_centre(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), y, x, float(10 * y + x)) for y in range(4) for x in range(5)], "ts timestamp_ntz, y int, x int, value double")
    got = {(r.y, r.x): r.value for r in enrich.resample(df, (-1.0, 0.5), (0.7, 1.3), (0.0, 0.0), (0.4, 0.25), 30, 9).collect()}
    want = {}
    for y in range(30):
        for x in range(9):
            ry, rx = int(np.floor((y * 0.25 + 0.125 - 0.5) / 1.3)), int(np.floor((x * 0.4 + 0.2 + 1) / 0.7))
            if 0 <= ry < 4 and 0 <= rx < 5:
                want[y, x] = float(10 * ry + rx)
    assert got == want
    with pytest.raises(ValueError):
        enrich.add_raster(df, df, df, df, "v", ("avg",))


def test_polygons_take_the_largest_share(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, region_name string")
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 1.5, 0.5), (1, 1.6, 0.5), (2, 1.0, 9.0), (2, None, 0.5), (3, 0.5, 0.5), (3, 1.5, 0.5)], "k int, lon double, lat double")
    polygons = spark.createDataFrame([(7, "left", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"), (8, "right", "POLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))"), (9, "none", None), (None, "x", "POLYGON ((0 0, 9 0, 9 9, 0 0))")], "region_id bigint, name string, geometry string")
    got = {r.k: (r.region_id, r.region) for r in enrich.add_polygons(table, points, polygons, ("k",)).collect()}
    assert got == {1: (8, "right"), 2: (None, None), 3: (7, "left")}


def test_grid_files_keep_every_cell(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 2, 3, 1.5), (0, 1, 0, 0, -2.0), (4, 0, 2, 4, 7.0), (4, 0, 2, 4, 6.0), (4, 0, 9, 0, 1.0), (4, 0, 1, -1, 1.0), (4, 0, None, 1, 1.0), (4, 0, 1, 1, None)], "frame int, level int, y int, x int, value double")
    convert.write_grid(cells, str(tmp_path / "g"), 5, 5)
    back = convert.read_grid(spark, str(tmp_path / "g"), "frame int, level int")
    assert rows(back) == {(0, 1, 2, 3, 1.5), (0, 1, 0, 0, -2.0), (4, 0, 2, 4, 7.0)}  # beyond the grid is left out


def test_undefined_values_become_one_mark(spark):
    df = spark.createDataFrame([(None, float("nan"), " null", True), (3, float("-inf"), "", None), (4, 2.5, "ok", False)], "a int, b double, c string, d boolean")
    assert rows(convert.clean(df)) == {(-999.99, -999.99, "-999.99", True), (3.0, -999.99, "-999.99", None), (4.0, 2.5, "ok", False)}


def test_geojson_coordinates_keep_holes(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 3 0, 3 3, 0 0), (1 1, 2 1, 2 2, 1 1))",), ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6.5 -5e-1, 6 6, 5 5)))",), (None,)], "g string")
    got = [r.c for r in df.select(convert.coordinates(F.col("g")).alias("c")).collect()]
    assert [[len(p) for p in g] if g else None for g in got] == [[2], [1, 1], None]
    assert got[0][0][1][1] == [2.0, 1.0] and got[1][1][0][1] == [6.5, -0.5]


def test_conversions_check_their_kind_and_bounds(spark):
    run = Run(spark, SPLIT_MERGE)
    tracker = api.Tracker(run.cells, run.frames, CFG)
    assert convert.convert(tracker, "clusters").count() == tracker.labelled.count()
    assert convert.convert(tracker, "clusters", end="1900-01-01").count() == 0
    for kind in ("boundaries", "trajectories", "vectorfield", "maps"):
        with pytest.raises(ValueError):
            convert.convert(tracker, kind)
    with pytest.raises(ValueError):
        convert.raster_columns(tracker.labelled, tracker.tracks, ("status",))
    with pytest.raises(ValueError):
        forecast.image_by("guess")


def test_wildcards(spark):
    df = spark.createDataFrame([], "u_ int, u_spl int, v_ int, size int")
    assert api.wildcards(df, ("u_*", "size", "u_", "x*")) == ["u_", "u_spl", "size"]
    with pytest.raises(KeyError):
        api.wildcards(df, ("speed",))


def test_stages_are_written_and_found_again(spark, tmp_path):
    run = Run(spark, SPLIT_MERGE)
    tracker = api.Tracker(run.cells, run.frames, CFG)
    root = str(tmp_path / "out")
    done = tracker.run(root, spat_ope=False, clean=True)
    assert set(done) == {"features", "linked", "durations", "tracks"}
    table = catalog.read(spark, done["tracks"], "track")
    assert table.count() == tracker.feats.count() and {"array_y", "geometry", "prv_mrg_uids", "speed", "file"} <= set(table.columns)
    days = catalog.catalog(spark, done["tracks"]).collect()
    assert {r.mode for r in days} == {"track"} and all(r.n_files for r in days)
    assert catalog.remaining(run.frames, table.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).count() == 0
    catalog.store(tracker.tracks.filter("frame < 0"), done["tracks"], "forecast")
    assert catalog.read(spark, done["tracks"]).count() == table.count()
    assert catalog.clear(spark, root) and not catalog.clear(spark, root)
    with pytest.raises(ValueError):
        catalog.store(tracker.tracks, root, "other")


def test_table_function_labels_each_partition(spark):
    components_udtf.register(spark, "label_components")
    spark.createDataFrame([(0, 0, 1, 1, 10, 1), (0, 0, 2, 2, 10, 1), (0, 0, 5, 5, 10, 1), (1, 0, 2, 2, 10, 1), (1, 0, None, 2, 10, 1)], "frame int, level int, y int, x int, x_dim int, radius int").createOrReplaceTempView("some_cells")
    got = rows(spark.sql("SELECT * FROM label_components(TABLE(some_cells) PARTITION BY (frame, level))"))
    assert got == {(0, 0, 11, 1, 1), (0, 0, 11, 2, 2), (0, 0, 55, 5, 5), (1, 0, 22, 2, 2)}


@pytest.mark.parametrize("method", ["lucas-kanade", "farneback"])
def test_flow_recovers_long_steps(method):
    y, x = np.mgrid[:64, :64]
    image = lambda u, v: 200 * np.exp(-((y - 30 - v) ** 2 + (x - 30 - u) ** 2) / 98) + 60 * np.exp(-((y - 34 - v) ** 2 + (x - 26 - u) ** 2) / 18)
    for u, v in ((1.5, -1), (-5, 4), (12, -9)):
        one, two = image(0, 0), image(u, v)
        fu, fv = imaging.lucas_kanade(one, two, 3)[:2] if method == "lucas-kanade" else imaging.polynomial_flow(one, two)
        inside = one > 60
        assert abs(fu[inside].mean() - u) < 0.5 and abs(fv[inside].mean() - v) < 0.5
    flat = np.zeros((5, 1))
    assert not imaging.lucas_kanade(flat, flat)[0].any()


def test_forecast_rows_tell_issue_and_lead(spark):
    frames = [[(1, 3, 1 + i, 4 + i, 3)] for i in range(4)]
    run = Run(spark, frames)
    tracker = api.Tracker(run.cells, run.frames, CFG)
    f = tracker.forecast(3, 2).filter("level = 0").collect()
    last = max(r.ts for r in run.frames.collect())
    step = timedelta(minutes=CFG.delta_time)
    assert {(r.issue_ts, r.ts, r.lead) for r in f} == {(last, last + step, 1), (last, last + 2 * step, 2)}
    assert {r.uid for r in f} == {1} and [r.u_ for r in sorted(f, key=lambda r: r.lead)] == [1.0, 1.0]


def test_stencils_equal_brute_force_over_tile_borders(spark):
    rng = random.Random(2)
    cells = {(f, rng.randrange(30), rng.randrange(30)): rng.uniform(-5, 5) for f in (0, 3) for _ in range(400)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()] + [(0, 2, 2, None), (3, 1, 1, float("nan"))], "frame int, y int, x int, value double").dropDuplicates(["frame", "y", "x"])
    there = {(r.frame, r.y, r.x): r.value for r in df.collect() if r.value is not None and r.value == r.value}
    weights = {(dy, dx): dy + 2.0 * dx + 0.5 for dy in (-2, 0, 1) for dx in (-1, 0, 3)} | {(0, 0): 1.0}
    got = {(r.frame, r.y, r.x): r.value for r in imaging._stencil(df, weights, lambda v, w: np.nansum(v * w, axis=1), tile=7).collect()}
    assert set(got) == set(there)
    for (f, y, x), v in got.items():
        assert v == pytest.approx(sum(w * there.get((f, y + dy, x + dx), 0.0) for (dy, dx), w in weights.items()))
    assert imaging.median(df.limit(0)).count() == 0
