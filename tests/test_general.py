"""The general data operators on small cases."""

import numpy as np
import pytest
from conftest import rows

from pyspark.sql import functions as F

from celltrack.operators import anomalies, compaction, drift, hierarchy, regular_grid


def test_ssa_fills_a_wave_and_keeps_readings():
    t = np.arange(60)
    wave = np.sin(2 * np.pi * t / 12) * 3 + 10
    holes = wave.copy()
    holes[[7, 8, 20, 33, 34, 35]] = np.nan
    out, settled = regular_grid.ssa_fill([holes, np.full(5, np.nan), np.array([1.0, np.nan, 3.0])])
    assert settled.all()
    assert np.abs(out[0] - wave).max() < 0.5 and (out[0][~np.isnan(holes)] == wave[~np.isnan(holes)]).all()
    assert np.isnan(out[1]).all() and out[2].tolist() == [1, 2, 3]


def test_grid_marks_every_empty_slot(spark):
    at = lambda s: f"2020-01-01 {s}"
    data = [(1, at("00:04:59"), 1.0), (1, at("00:05:00"), 3.0), (1, at("00:40:00"), 5.0), (1, at("00:41:00"), None), (2, at("00:00:00"), 1.0), (None, at("00:00:00"), 1.0), (3, None, 1.0), (1, at("00:05:00"), 3.0)]
    df = spark.createDataFrame(data, "uid bigint, timestamp string, size double").selectExpr("uid", "CAST(timestamp AS timestamp) AS timestamp", "size", "'n' AS n", "0 AS slot")
    g = regular_grid.regular_grid(df, "uid", "timestamp", ("size",)).collect()
    base = 1577836800
    assert {(r.uid, r.slot_epoch) for r in g if r.filled} == {(1, base + 600 * k) for k in (2, 3)}
    assert {(r.uid, r.slot_epoch, r.readings) for r in g if not r.filled} == {(1, base, 1), (1, base + 600, 2), (1, base + 2400, 2), (2, base, 1)}
    assert all(r.size is not None for r in g)
    assert regular_grid.regular_grid(df.limit(0), "uid", "timestamp", ("size",)).count() == 0


def test_long_and_far_gaps_come_out_once(spark):
    df = spark.range(6000).selectExpr("CAST(7 AS bigint) AS uid", "CAST(timestamp_seconds(id * 600 + CASE WHEN id >= 3000 THEN 600000 ELSE 0 END + CASE WHEN id >= 4000 THEN 1200 ELSE 0 END) AS timestamp) AS timestamp", "CAST(id % 9 AS double) AS size")
    g = regular_grid.regular_grid(df, "uid", "timestamp", ("size",)).toPandas()
    assert len(g) == len(set(g.slot_epoch)) == 6000 + 1000 + 2
    assert g.filled.sum() == 1002 and g[g.filled]["size"].notna().sum() == 2


def test_fills_do_not_depend_on_batches_or_company(spark):
    """One long source with gaps at every place of a stretch, among short ones."""
    df = spark.range(9000).filter("id % 7 NOT IN (2, 3) AND NOT id BETWEEN 2000 AND 2100 AND NOT id BETWEEN 4050 AND 4400").selectExpr(
        "CASE WHEN id >= 8000 THEN id div 40 ELSE 7 END AS uid", "timestamp_seconds(id * 600) AS timestamp", "sin(id / 5) + id % 3 AS size", "cos(id / 9) AS mean"
    )
    out = {}
    for n in (300, 1000, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        out[n] = sorted(map(tuple, regular_grid.regular_grid(df, "uid", "timestamp", ("size", "mean")).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[300] == out[1000] == out[10000]
    alone = sorted(map(tuple, regular_grid.regular_grid(df.filter("uid = 7"), "uid", "timestamp", ("size", "mean")).collect()))
    assert alone == [r for r in out[300] if r[0] == 7]
    assert len(alone) == 8000 and sum(r[2] for r in alone) == 8000 - df.filter("uid = 7").count()
    assert all((r[4] is None) == (4048 <= r[1] // 600 <= 4400) for r in alone)


def test_unsettled_fills_are_told():
    rng = np.random.default_rng(0)
    v = np.where(rng.random(200) < 0.5, np.nan, rng.normal(size=200).cumsum())
    old, regular_grid.ROUNDS = regular_grid.ROUNDS, 1
    try:
        assert not regular_grid.ssa_fill([v])[1][0]
    finally:
        regular_grid.ROUNDS = old


def series(values):
    return np.zeros(len(values), int), np.array(values, float)


@pytest.mark.parametrize(
    "values, flagged",
    [
        ([5, 5.1, 4.9, 5, 9, 5.1, 5, 4.9, 5.2, 5], [4]),
        ([5, 5.1, 4.9, 5, 9, 9.1, 8.9, 9, 9.2, 9], []),  # a lasting change
        ([5, 5.1, 4.9, 5, 5.2, 5.1, 4.8, 9], []),  # never returned
        ([5, np.inf, 4.9, 400, 5.2, np.nan], [1, 3, 5]),
        ([1, 2, 2, 2, 2, 2, 1.5], [1, 2, 3, 4, 5]),
        ([1, 2, 2, 2, 2, 1.5], []),
        ([], []),
        ([3], []),
    ],
)
def test_flags(values, flagged):
    assert np.flatnonzero(anomalies.flag_series(*series(values), 360.0)).tolist() == flagged


def test_flags_do_not_depend_on_chunks():
    rng = np.random.default_rng(0)
    v = rng.normal(0, 1, 3000)
    spikes = rng.choice(np.arange(20, 2980), 25, replace=False)
    v[spikes] += 40
    assert set(np.flatnonzero(anomalies.flag_series(*series(v), 360.0))) == set(spikes)


def test_flags_do_not_depend_on_batches(spark, monkeypatch):
    """Crowded sources in blocks of fixed rows, among small ones, whatever the batches."""
    df = spark.range(12000).selectExpr(
        "CASE WHEN id < 7000 THEN 1.0D WHEN id < 9500 THEN 2.0D ELSE double(id div 9) END AS iuid", "int(id div 6) AS frame", "int(id % 6) AS cidx",
        "sin(id) + CASE WHEN id % 977 = 11 THEN 400 WHEN id BETWEEN 500 AND 520 THEN 0 ELSE 0 END AS u", "CASE WHEN id % 1500 < 7 THEN 0.25D ELSE rand(3) END AS w",
    ).union(spark.createDataFrame([(1.0, 3, 2, None, 5.0)], "iuid double, frame int, cidx int, u double, w double"))
    monkeypatch.setattr(anomalies, "PIECE_FRAMES", 100000)
    out = {}
    for n, batch, block in ((300, 500, 1 << 17), (10000, 60000, 1 << 17), (300, 500, 700), (1000, 3000, 700), (10000, 60000, 700)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        monkeypatch.setattr(anomalies, "BATCH_ROWS", batch)
        monkeypatch.setattr(anomalies, "BLOCK_ROWS", block)
        monkeypatch.setattr(anomalies, "BLOCK_CONTEXT", 256)
        out[n, block] = rows(anomalies.flag_implausible(df, "iuid", ("frame", "cidx"), {"u": 1e3, "w": 1e3}))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[300, 1 << 17] == out[10000, 1 << 17] and out[300, 700] == out[1000, 700] == out[10000, 700]
    spikes = {(i // 6, i % 6, "u") for i in range(12000) if i % 977 == 11 and i < 9500}
    frozen = {(i // 6, i % 6, "w") for i in range(9500) if i % 1500 < 7}
    for got in out.values():
        assert spikes <= got and frozen <= got


def test_frozen_within_a_tolerance():
    v = np.r_[np.arange(5.0), 7 + np.arange(6) * 1e-10, np.nan, np.inf, np.inf, 3.0]
    s = np.zeros(len(v), int)
    assert not anomalies.stuck(v, s).any()
    assert np.flatnonzero(anomalies.stuck(v, s, tolerance=1e-9)).tolist() == [5, 6, 7, 8, 9, 10]
    assert np.flatnonzero(anomalies.stuck(np.full(6, 2.0), np.array([0, 1, 1, 1, 1, 1]))).tolist() == [1, 2, 3, 4, 5]


def plain_filter(v):
    """The filter of one short series, one reading after another."""
    n = len(v)
    if n < 3:
        return set()
    sd = 1.4826 * np.median(np.abs(np.diff(v))) / np.sqrt(2) * np.sqrt(1 + anomalies.FEW / n)
    sd = max(sd, 1e-6 * (1 + abs(np.median(v))))
    r, level, flags, away = sd**2, np.median(v[: anomalies.START]), set(), []
    p = r
    for t, y in enumerate(v):
        p += 0 if away else anomalies.GAIN_RATIO * r
        limit = anomalies.THRESHOLD**2 * (p + r)
        e = y - level
        if e * e > (limit / 4 if away else limit):
            if e * e > limit and len(away) < t:
                flags.add(t)
            away.append(t)
            if len(away) >= anomalies.LASTING:  # a lasting change
                flags -= set(away)
                level, p, away = np.median(v[away]), r, []
        else:
            level, p, away = level + p / (p + r) * e, p * (1 - p / (p + r)), []
    return flags - set(away)


def test_filter_side_by_side_equals_one_after_another():
    rng = np.random.default_rng(11)
    series_ = []
    for _ in range(300):
        v = rng.normal(0, 1, rng.integers(1, 60)).round(3) + rng.normal(0, 0.3, 1)
        for at in rng.integers(0, len(v), len(v) // 12):
            v[at] += rng.choice([-40, 25])
        if rng.random() < 0.2:
            v[len(v) // 2 :] += 30
        series_.append(v)
    number = np.repeat(np.arange(len(series_)), [len(v) for v in series_])
    got = anomalies.flag_series(number, np.concatenate(series_), 360.0)
    at = 0
    for v in series_:
        assert set(np.flatnonzero(got[at : at + len(v)])) == plain_filter(v)
        at += len(v)


def test_track_anomalies_in_tables(spark):
    v = [0.1, 0.11, 0.1, 0.09, 5.0, 0.1, 0.11, 0.1, 0.09, 0.1, None]
    sp = spark.createDataFrame([(i, 0, x, 500.0 if i == 2 else 0.1, float("nan") if i == 3 else float(i % 3)) for i, x in enumerate(v)], "frame int, cidx int, u_ double, v_ double, expansion double").selectExpr("*", "1 AS src", "2 AS piece")
    li = spark.createDataFrame([(i, 0, 3, 3.0) for i in range(11)] + [(0, 0, None, 3.0), (1, None, 3, 3.0)], "frame int, cidx int, uid bigint, iuid double")
    got = rows(anomalies.track_anomalies(sp.unionAll(sp.filter("frame = 2")), li))
    assert {(4, 0, "u_"), (2, 0, "v_"), (3, 0, "expansion")} <= got
    assert got - {(4, 0, "u_"), (2, 0, "v_"), (3, 0, "expansion")} == {(i, 0, "v_") for i in range(3, 11)}  # stuck at 0.1
    assert anomalies.track_anomalies(sp.limit(0), li).count() == 0


FEAT = "frame int, cidx int, array_values array<double>, array_y array<int>, array_x array<int>, std double, file string"
FROWS = [(1, 0, [1.0, 2.0], [0, 1], [5, 6], None, "features/20200101_000000_0.parquet"), (1, 0, [2.0, 1.0, 1.0], [1, 0, 0], [6, 5, 5], 3.0, "features/20200101_000000_1.parquet"), (1, 0, [2.0, 9.0], [1, 0], [6, 5], None, "features/20200101_000000_1.parquet"), (2, 0, None, None, None, None, None)]
LINK = "frame int, cidx int, cindex bigint, uid bigint, prv_mrg_uids array<bigint>, file string"
LROWS = [(1, 0, 7, 1, [2, 3], "linked/a"), (1, 0, 7, 1, [3, 2], "linked/b"), (1, 0, 7, 1, [3, 2, 2], "linked/b"), (1, 0, 7, 1, None, "linked/b"), (1, 0, 7, 1, [], "linked/b")]


def test_copies(spark):
    f, li = spark.createDataFrame(FROWS, FEAT), spark.createDataFrame(LROWS, LINK)
    assert rows(compaction.stored_twice(f, li)) == {("features", 1, 0), ("linked", 1, 0)}
    assert compaction.once("features", f).count() == 3 and compaction.once("linked", li).count() == 4
    assert compaction.stored_twice(f.limit(0), li.limit(0)).count() == 0


def small_table(spark, path):
    df = spark.createDataFrame([(i * 40, 0, i, i % 5, [1], f"linked/{i}") for i in range(60)] + [(120, 0, 3, 3, [1], "linked/again")], LINK)
    t = compaction.StoredTable(spark, str(path), df.schema)
    t.append(df.repartition(30))
    return t


def per_part(t):
    return {r["part"]: r["count"] for r in t.files().groupBy("part").count().collect()}


def test_compaction_keeps_each_record_once(spark, tmp_path):
    t = small_table(spark, tmp_path / "t")
    before, old = per_part(t), t.snapshot()
    untouched = [p for p, n in before.items() if n <= 3]
    done = compaction.compact(t, "linked", max_small=3).collect()
    assert {r["part"] for r in done} == {p for p, n in before.items() if n > 3 or p == 0}
    assert all(r["files_after"] == 1 and r["version"] == 2 and r["files_before"] == before[r["part"]] for r in done)
    assert t.read().count() == 60 and t.snapshot().version == 2
    assert {p: n for p, n in per_part(t).items() if p in untouched and p} == {p: before[p] for p in untouched if p}
    assert t.read(old).count() == 61  # the earlier snapshot can still be read
    assert compaction.compact(t, "linked", max_small=3).count() == 0 and t.snapshot().version == 2
    kept = sorted(map(str, t.read().collect()))
    assert t.vacuum(keep=1) == len(done) and sorted(map(str, t.read().collect())) == kept


def test_compaction_gives_way_to_another_writer(spark, tmp_path):
    t = small_table(spark, tmp_path / "t")
    late = spark.createDataFrame([(0, 9, 99, 9, [9], "linked/new")], LINK)
    with pytest.raises(compaction.Conflict):
        compaction.compact(t, "linked", max_small=3, before_publish=lambda: t.append(late))
    assert t.read().count() == 62 and t.snapshot().version == 2  # the appended record stays, nothing was rewritten
    assert t.vacuum() > 0 and t.read().count() == 62


def test_compaction_keeps_what_was_appended_elsewhere(spark, tmp_path):
    t = small_table(spark, tmp_path / "t")
    late = spark.createDataFrame([(99999, 9, 99, 9, [9], "linked/new")], LINK)
    done = compaction.compact(t, "linked", max_small=3, before_publish=lambda: t.append(late)).collect()
    assert done and all(r["version"] == 3 for r in done)
    assert t.read().count() == 61 and t.read().filter("frame = 99999").count() == 1


def test_a_crash_before_publishing_changes_nothing(spark, tmp_path):
    t = small_table(spark, tmp_path / "t")
    before = sorted(map(str, t.read().collect()))

    def crash():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        compaction.compact(t, "linked", max_small=3, before_publish=crash)
    assert t.snapshot().version == 1 and sorted(map(str, t.read().collect())) == before
    assert compaction.compact(t, "linked", max_small=3).count() > 0 and t.read().count() == 60


def test_compacted_files_have_the_size_asked_for(spark, tmp_path):
    df = spark.range(60000).selectExpr("cast(id % 200 as int) AS frame", "cast(id as int) AS cidx", "cast(hash(id) as bigint) AS cindex", "xxhash64(id) AS uid", "array(xxhash64(id, 1)) AS prv_mrg_uids", "concat('linked/', id % 7) AS file")
    t = compaction.StoredTable(spark, str(tmp_path / "t"), df.schema)
    t.append(df.repartition(20))
    target = 200_000
    compaction.compact(t, "linked", target_bytes=target)
    sizes = [(r["part"], r.file_size) for r in t.files().collect()]
    assert len(sizes) > 6 and t.read().count() == 60000
    assert all(target / 2 <= n <= target * 2 for _, n in sizes), sizes


def test_compaction_merges_copies_whatever_the_number_of_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1, 1, [1], "linked/a"), (1, 0, 1, 1, [1], "linked/b"), (300, 0, 2, 1, [1], "linked/a"), (None, 0, 3, None, None, None)], LINK)
    t = compaction.StoredTable(spark, str(tmp_path / "t"), df.schema)
    t.append(df.coalesce(1))
    assert [r["part"] for r in compaction.compact(t, "linked").collect()] == [0]
    assert t.read().count() == 3 and rows(t.merged()) == {(1, 0, 2)}
    t.append(df.limit(1))  # a copy that comes later is merged by the next rewrite
    assert [r["part"] for r in compaction.compact(t, "linked").collect()] == [0] and t.read().count() == 3


def test_found_copies_come_from_the_rewrite(spark, data):
    from celltrack.runtime import table

    features, linked = table(spark, data, "features"), table(spark, data, "linked")
    assert rows(compaction.merged_records(features, linked)) == rows(compaction.stored_twice(features, linked))
    for stage, df in (("features", features), ("linked", linked)):
        t, done = compaction.consolidate(stage, df)
        copies = compaction.record_copies(stage, df).cache()
        assert done.count() and t.snapshot().version == 2
        assert t.read().count() == copies.count() and compaction.record_copies(stage, t.read().drop("part")).filter("copies > 1").isEmpty()
    assert compaction.merged_records(features.limit(0), linked.limit(0)).isEmpty()


REC = "producer string, file string, file_ts timestamp, arrived_at timestamp, rec_no int, payload string"


def records(spark, files):
    out = [("p", f"f{k}", k, i, x) for k, recs in enumerate(files) for i, x in enumerate(recs)]
    df = spark.createDataFrame(out, "producer string, file string, s int, rec_no int, payload string")
    return df.selectExpr("producer", "file", "timestamp_seconds(s) AS file_ts", "rec_no", "payload", "'x' AS field", "'y' AS names")


def test_drift(spark):
    df = records(spark, [['{"u_opt":1.5,"far":"5 %"}', '{"far":"9,5 %"}'], ['{"uOpt":{"value":2,"unit":"deg"},"far":0.5,"method":3}', "nonsense", None], ['{"u_opt":[0.25],"method":"elp","far_opt":1}', '{"u_opt":null}'], ['{"opt_u":"x"}']])
    assert rows(drift.schema_changes(df)) == {
        ("f1", "u_opt", "renamed"), ("f1", "u_opt", "retyped"), ("f1", "far", "retyped"), ("f1", "method", "added"),
        ("f2", "u_opt", "renamed"), ("f2", "u_opt", "retyped"), ("f2", "far", "removed"), ("f2", "method", "retyped"),
        ("f3", "u_opt", "renamed"), ("f3", "u_opt", "retyped"), ("f3", "method", "removed"),
    }
    t = {(r.file, r.rec_no): r for r in drift.unified(df).collect()}
    assert t["f0", 0].u_opt == 1.5 and t["f0", 0].far == 0.05 and t["f0", 1].far == pytest.approx(0.095)
    assert t["f1", 0].u_opt == 2 and t["f1", 0].method == "inc" and t["f1", 1].failed == ["payload"] == t["f1", 2].failed
    assert t["f2", 0].u_opt == 0.25 and t["f2", 0].method == "elp" and t["f3", 0].failed == ["u_opt=x"] and len(t) == 8
    assert drift.schema_changes(df.limit(0)).count() == 0 and drift.unified(df.limit(0)).count() == 0


def test_part_of_an_alias_is_a_rename_and_long_arrays_fail(spark):
    df = records(spark, [['{"far":0.5,"far_opt":1}'], ['{"false_alarm":0.5,"u_opt":[1,2],"ratio":3}'], ['{"false_alarm_ratio":0.5,"u_opt":[1]}']])
    assert rows(drift.schema_changes(df)) == {("f1", "far", "renamed"), ("f1", "u_opt", "added"), ("f2", "far", "renamed")}
    t = {r.file: r for r in drift.unified(df).collect()}
    assert t["f1"].u_opt is None and t["f1"].failed == ["u_opt=[1,2]"] and t["f2"].u_opt == 1 and t["f2"].failed is None


def test_changes_of_every_path(spark):
    df = records(spark, [['{"a":1,"o":{"x":1,"p":{"q":true}}}', '{"a":"s"}', "no"], ['{"a":2,"o":{"x":"t"},"n":null}'], ["[1]"], ['{"a":2}']])
    assert rows(drift.path_changes(df)) == {
        ("f1", "a", "retyped", "number+string"), ("f1", "o.x", "retyped", "number"), ("f1", "o.p", "removed", None), ("f1", "o.p.q", "removed", None), ("f1", "n", "added", None),
        ("f2", "a", "removed", None), ("f2", "o", "removed", None), ("f2", "o.x", "removed", None), ("f2", "n", "removed", None), ("f3", "a", "added", None),
    }
    assert drift.path_changes(df.limit(0)).count() == 0


def test_proposed_renames(spark):
    df = records(spark, [['{"wind_speed":5.0,"level":1,"t":300.5}', '{"wind_speed":6.0,"level":1,"t":301.5}'], ['{"windSpeed":5.5,"depth":900,"temp":301.0}']])
    got = {(r.file, r.path): (r.was, r.shared) for r in drift.rename_proposals(df).collect()}
    assert got == {("f1", "windSpeed"): ("wind_speed", 2), ("f1", "temp"): ("t", 0)}


def test_names():
    assert len({drift.name_key(n) for n in ("u_opt", "uOpt", "U_OPT", "u-opt", "opt_u")}) == 1
    assert drift.name_key("far_opt") != drift.name_key("far")


def closure(links):
    out = set(links)
    while True:
        more = out | {(a, d) for a, b in out for c, d in links if b == c}
        if more == out:
            return out
        out = more


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    links = {(int(a), int(b)) for a, b in rng.integers(1, 40, (45, 2)) if a != b} | {(100 + i, 101 + i) for i in range(150)}
    h = hierarchy.Hierarchy(spark.createDataFrame(sorted(links) * 2, "p bigint, c bigint"))
    want = closure(links)
    assert rows(h.pairs()) == want
    if seed == 0:
        rep = {r.uid: r for r in h.report().collect()}
        assert {u for u, r in rep.items() if r.in_cycle} == {a for a, b in want if a == b}
        assert rep[250].depth == 150 and rep[250].root_uid == 100 and rep[250].path.startswith("100/101/")
        assert rep[100].n_tree == 150 and rep[250].n_ancestors == 150


def test_tree_parents_need_no_order_of_ids(spark):
    h = hierarchy.Hierarchy(spark.createDataFrame([(9, 5), (5, 3), (3, 1)], "p bigint, c bigint"))
    got = {r.uid: (r.root_uid, r.depth, r.path, r.parent_uid, r.n_tree) for r in h.report().collect()}
    assert got == {9: (9, 0, "9", None, 3), 5: (9, 1, "9/5", 9, 2), 3: (9, 2, "9/5/3", 5, 1), 1: (9, 3, "9/5/3/1", 3, 0)}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_only_leaders_of_cycles_lack_a_parent(spark, seed):
    rng = np.random.default_rng(seed)
    links = {(int(a), int(b)) for a, b in rng.integers(1, 60, (55, 2)) if a != b} | {(200, 201), (201, 202), (202, 200), (202, 203), (203, 204), (4 * 10**18 - 1, 4 * 10**18 - 3)}
    rep = {r.uid: r for r in hierarchy.Hierarchy(spark.createDataFrame(sorted(links), "p bigint, c bigint")).report().collect()}
    top = {c: max(p for p, x in links if x == c) for c in {c for _, c in links}}
    for uid, r in rep.items():
        line, at = [uid], uid
        while at in top and top[at] not in line:
            at = top[at]
            line.append(at)
        ring = line[line.index(top[at]) :] if at in top else []
        leads = uid in ring and uid == min(ring)
        assert r.parent_uid == (None if leads else top.get(uid)), uid
        assert (r.parent_uid is None) == (r.depth == 0) == (r.root_uid == uid) and r.path.endswith(str(uid))
        assert r.path.count("/") == r.depth and r.path.startswith(str(r.root_uid))


@pytest.mark.parametrize("seed", range(4))
def test_core_holds_every_cycle_and_no_tree(spark, seed):
    rng = np.random.default_rng(seed)
    links = {(int(a), int(b)) for a, b in rng.integers(1, 50, (60, 2)) if a != b} | {(1000 + i, 1001 + i) for i in range(40)} | {(300, 301), (301, 300)}
    reach = closure(links)
    core = {r.v for r in hierarchy.cyclic_core(spark.createDataFrame(sorted(links), "p bigint, c bigint")).collect()}
    cycle = {a for a, b in reach if a == b}
    between = {v for v in {x for e in links for x in e} if any((a, v) in reach for a in cycle) and any((v, a) in reach for a in cycle)}
    assert core == cycle | between


def test_children_of_one_parent_are_strung_together_in_pieces(spark):
    links = spark.range(2, 700).select(F.lit(1).cast("bigint").alias("p"), F.col("id").alias("v"))
    sib, first = hierarchy.siblings(links, pieces=8)
    after = {r.v: r.sib for r in sib.collect()}
    ((top, at),) = [tuple(r) for r in first.collect()]
    seen = []
    while at is not None:
        seen.append(at)
        at = after[at]
    assert top == 1 and sorted(seen) == list(range(2, 700))


def test_parent_links_leave_out_marks(spark):
    df = spark.createDataFrame([(1, [2, None, -999, 0, 1], float("nan")), (1, None, 3.0), (None, [5], None), (4, None, None), (0, [5], None)], "uid bigint, prv_mrg_uids array<bigint>, prv_spl_uid double").selectExpr("*", "9 AS p")
    assert rows(hierarchy.parent_links(df)) == {(2, 1), (3, 1)}
    assert hierarchy.Hierarchy(hierarchy.parent_links(df.limit(0))).pairs().count() == 0


def test_uids_without_links_are_nodes(spark):
    df = spark.createDataFrame([(1, [2], None), (7, None, None), (7, [], float("nan")), (0, None, None), (None, None, None)], "uid bigint, prv_mrg_uids array<bigint>, prv_spl_uid double")
    report = hierarchy.Hierarchy(hierarchy.parent_links(df), hierarchy.usable_uids(df)).report()
    assert {(r.uid, r.parent_uid, r.root_uid, r.depth, r.path, r.n_tree, r.n_ancestors, r.n_descendants, r.in_cycle) for r in report.collect()} == {
        (1, 2, 2, 1, "2/1", 0, 1, 0, False), (2, None, 2, 0, "2", 1, 0, 1, False), (7, None, 7, 0, "7", 0, 0, 0, False),
    }


def test_every_usable_uid_of_linked_has_a_row(spark, data):
    import __spark_entry__ as entry
    from celltrack.runtime import table

    linked = table(spark, data, "linked")
    got = [r.uid for r in entry.queries()["p4_nodes"](spark, data).collect()]
    assert len(got) == len(set(got)) and {r.v for r in hierarchy.usable_uids(linked).collect()} <= set(got)


def test_scratch_tables_go_but_for_those_kept(spark):
    import os

    from celltrack import runtime

    with runtime.scratch() as keep:
        a, b = runtime.cut(spark.range(3)), runtime.cut(spark.range(4))
        keep(b)
    assert not os.path.exists(a._celltrack_path) and b.count() == 4
    runtime.drop(b)
    assert not os.path.exists(b._celltrack_path)


def test_a_cluster_must_name_its_shared_folder():
    from celltrack import runtime

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            sc = staticmethod(lambda: type("Sc", (), {"getCheckpointDir": staticmethod(lambda: type("None_", (), {"isDefined": staticmethod(lambda: False)}))}))

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        runtime.shared_dir(Session)
