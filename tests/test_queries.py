"""The registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.8g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    return c


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 3, 4, 5, 6, 7)} <= set(entry.queries())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p3_readings", "p4_found", "p4_nodes", "p5_found", "p5_table", "p5_paths", "p7_found", "p7_plan", "link_iuid", "link_trajectory", "tracking_columns", "geom_hull", "sink_geojson", "sink_report", "enrich_raster", "src_bad_frame", "stream_link", "overlay_hull", "evt_all", "link_uid", "features_arrays", "far_best", "asof_nearest", "img_equalize", "geom_area"])
def test_query_equals_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    got = df.collect()
    r = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(plain(x[c]) for c in cols) for x in got) == sorted(tuple(map(plain, x)) for x in r.fetchall())


def test_stream_links_agree_with_batch_on_plain_tracks(spark, tmp_path):
    from test_tracking import CFG, Run

    from celltrack.streaming import live

    frames = [[(1, 2, 1 + i, 2 + i, 1), (7, 8, 6, 7, 1)] for i in range(5)]
    run = Run(spark, frames)
    cells = run.cells.selectExpr("'a' AS source", "frame", "CAST(frame * 12 AS bigint) AS ts_min", "y", "x", "value")
    cells.orderBy("frame").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "in"))
    got = live.run_to_table(live.link_stream(stream, CFG, 12), str(tmp_path / "links"), str(tmp_path / "ckpt"))
    batch = {(k[0], k[2]): r.uid for k, r in run.links().items() if k[1] == 0}
    live_ = {(r.frame, r.label): r.uid for r in got.collect()}
    assert len(live_) == 8 and {k: batch[k] for k in live_} == live_  # the last frame is not closed yet


@pytest.mark.parametrize("operator", [">=", ">"])
def test_stream_links_every_frame_and_level_as_the_batch_does(spark, tmp_path, operator):
    from dataclasses import replace

    from test_tracking import CFG, Run

    from celltrack.config import Level
    from celltrack.streaming import live

    cfg = replace(CFG, operator=operator, levels=(Level(0, 1.0, 1), Level(1, 5.0, 1)))
    strong = [(1, 2, 1, 8, 2), (1, 2, 2, 3, 6), (7, 8, 6, 7, 5)]
    pieces = [(1, 2, 1, 4, 2), (1, 2, 6, 8, 2), (1, 2, 2, 3, 6), (7, 8, 6, 7, 5)]
    run = Run(spark, [strong, pieces, strong, pieces[1:], strong], cfg)
    cells = run.cells.selectExpr("'a' AS source", "frame", "CAST(frame * 12 AS bigint) AS ts_min", "y", "x", "value")
    cells.unionByName(live.end_marks(cells, 12)).orderBy("frame").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "in"))
    got = live.run_to_table(live.link_stream(stream, cfg, 12), str(tmp_path / "links"), str(tmp_path / "ckpt")).collect()
    batch = run.links()
    assert {(r.frame, r.level, r.label) for r in got} == set(batch) and len(got) == len(batch)
    assert {r.frame for r in got} == {0, 1, 2, 3, 4} and {r.level for r in got} == {0, 1}
    assert {(r.frame, r.label): r.uid for r in got if r.level == 0} == {(f, k): v.uid for (f, lv, k), v in batch.items() if lv == 0}
