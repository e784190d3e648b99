import numpy as np
from conftest import rows

from celltrack.operators import proximity as P


def brute(points, km):
    out = set()
    for i, (a, g, x, y) in enumerate(points):
        for b, h, u, v in points[i + 1 :]:
            if g == h and a != b and P.distance_km(np.float64(x), np.float64(y), np.float64(u), np.float64(v)) <= km:
                out.add((min(a, b), max(a, b)))
    return out


def test_near_pairs_match_brute_force_with_seams_poles_and_a_crowd(spark):
    rng = np.random.default_rng(1)
    pts = []
    for i in range(420):
        kind = i % 4
        x = {0: rng.uniform(179, 181), 1: rng.uniform(-180, 180), 2: rng.uniform(9.5, 10.5), 3: rng.uniform(-180, 180)}[kind]
        y = {0: rng.uniform(-2, 2), 1: rng.uniform(88, 90), 2: rng.uniform(2.0, 4.4), 3: rng.uniform(-90, -89)}[kind]
        pts.append((i, int(rng.integers(2)), float((x + 180) % 360 - 180), float(y)))
    pts += pts[:40]  # repeated rows
    df = spark.createDataFrame(pts, "id bigint, t int, lon double, lat double").withColumnRenamed("t", "when").selectExpr("*", "id AS home", "'x' AS strip")
    assert rows(P.near_pairs(df, 60.0, ("when",))) == brute(pts, 60.0)


def test_near_pairs_leave_out_nulls_and_accept_nothing(spark):
    schema = "id bigint, t int, lon double, lat double"
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, None, 0.0, 0.0), (None, 0, 0.0, 0.0), (3, 0, None, 0.0), (4, 0, 0.0, 0.0)], schema)
    assert rows(P.near_pairs(df, 1.0, ("t",))) == {(1, 4)}
    assert rows(P.near_pairs(spark.createDataFrame([], schema), 1.0, ("t",))) == set()


REGIONS = [(1, "west", "POLYGON ((-10 0, 0 0, 0 10, -10 10, -10 0))"), (2, "seam", "POLYGON ((175 0, 185 0, 185 10, 175 10, 175 0))"), (3, "none", None), (4, "bad", "POLYGON EMPTY")]


def test_regions_by_broadcast_and_by_cells_agree(spark):
    pts = spark.createDataFrame([(1, -5.0, 5.0), (2, -179.0, 5.0), (3, 50.0, 5.0), (4, None, 5.0), (5, 179.0, 9.9)], "id bigint, lon double, lat double")
    reg = spark.createDataFrame(REGIONS, "region_id bigint, name string, geometry string")
    want = {(1, 1, "west"), (2, 2, "seam"), (5, 2, "seam")}
    assert rows(P.containing_region(pts, reg, ("id",))) == want
    assert rows(P.containing_region(pts, reg, ("id",), region_bytes=-1)) == want


def test_region_search_equals_a_test_of_every_pair(spark, monkeypatch):
    from celltrack.functions import wkt

    rng = np.random.default_rng(4)
    texts = ["POLYGON ((-10 0, 0 0, 0 10, -10 10, -10 0), (-7 3, -3 3, -3 7, -7 7, -7 3))", "MULTIPOLYGON (((170 -9, 191.5 -9, 185 4.2, 170 -9)), ((20 20, 20.3 20, 20.1 20.4, 20 20)))", "POLYGON ((5 -5, 9 -5, 9 -1, 7 -3, 5 -1, 5 -5))"]
    reg = spark.createDataFrame([(i, f"r{i}", t) for i, t in enumerate(texts)] + [(0, "r0", texts[0])], "region_id bigint, name string, geometry string").distinct()
    lon, lat = np.r_[rng.uniform(-12, 12, 900), rng.uniform(168, 180, 300), rng.uniform(-180, -167, 300), rng.uniform(19.9, 20.4, 300)], np.r_[rng.uniform(-7, 12, 1500), rng.uniform(19.9, 20.5, 300)]
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat))], "id bigint, lon double, lat double")
    want = {(int(i), k, f"r{k}") for k, t in enumerate(texts) for i in np.flatnonzero(wkt.inside(wkt.rings([t]), lon, lat))}
    monkeypatch.setattr(P, "SHARES", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)  # polygons and their points in different batches
    assert rows(P.containing_region(pts, reg, ("id",))) == want
    assert rows(P.containing_region(pts, reg, ("id",), region_bytes=-1)) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert P.containing_region(pts.limit(0), reg, ("id",), region_bytes=-1).count() == P.containing_region(pts, reg.limit(0), ("id",)).count() == 0


def test_report(spark):
    sq = lambda x, y: f"POLYGON (({x} {y}, {x + 0.2} {y}, {x + 0.2} {y + 0.2}, {x} {y + 0.2}, {x} {y}))"
    t = "2020-01-01 00:00:00"
    data = [(1, t, 0, "west", sq(-5, 5)), (2, t, 0, "West", sq(-4.9, 5)), (3, None, 0, None, sq(-4.8, 5)), (4, t, 1, "west", sq(-5, 5)), (5, t, 0, None, None), (2, t, 0, "West", sq(-4.9, 5))]
    tt = spark.createDataFrame(data, "cindex bigint, timestamp string, threshold_level int, region string, geometry string").selectExpr("cindex", "CAST(timestamp AS timestamp) AS timestamp", "threshold_level", "region", "geometry", "1 AS id", "2 AS t")
    reg = spark.createDataFrame(REGIONS, "region_id bigint, name string, geometry string")
    assert rows(P.proximity_report(tt, reg)) == {("near", 1, 2), ("region", 1, 2), ("region", 1, 3)}
    assert P.proximity_report(tt.limit(0), reg).count() == 0
