"""Hand-computed clusters, and the properties every run must have."""

import numpy as np
import pytest
from conftest import rows

from celltrack.config import GridSpec, Level, TrackConfig
from celltrack.operators import enrich, tracking as T

CFG = TrackConfig(GridSpec(12, 12), (Level(0, 1.0, 1), Level(1, 5.0, 1)), 12)


class Run:
    def __init__(self, spark, frames, cfg=CFG, minutes=None):
        cells = [(f, y, x, float(v)) for f, blocks in enumerate(frames) for y0, y1, x0, x1, v in blocks for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)]
        best = {}
        for f, y, x, v in cells:
            best[f, y, x] = max(v, best.get((f, y, x), v))
        self.cells = spark.createDataFrame([(*k, v) for k, v in best.items()], "frame int, y int, x int, value double")
        at = minutes or [12 * i for i in range(len(frames))]
        self.frames = spark.createDataFrame([(i, m) for i, m in enumerate(at)], "frame int, m int").selectExpr("frame", "CAST(timestamp_seconds(m * 60) AS timestamp_ntz) AS ts")
        self.lab = T.label_components(T.segment(self.cells, cfg), cfg).cache()
        self.feats = T.features(self.lab, cfg)
        self.edges = T.overlay(self.lab, T.frame_pairs(self.frames, cfg), cfg).cache()
        self.ev = T.events(self.feats, self.edges).cache()
        self.nested = T.inside(self.lab)
        self.vec = T.vectors(self.feats, self.ev, self.edges, self.lab, self.nested, cfg).cache()
        self.cfg = cfg

    def status(self, frame, level=0):
        return {r.label: r.status for r in self.ev.filter(f"frame = {frame} AND level = {level}").collect()}

    def links(self):
        return {(r.frame, r.level, r.label): r for r in T.link(self.feats, self.ev, self.nested, self.frames, self.cfg).collect()}

    def vector(self, frame, label):
        return self.vec.filter(f"frame = {frame} AND level = 0 AND label = {label}").first()


def test_continuing(spark):
    r = Run(spark, [[(1, 2, 1, 2, 1)], [(1, 2, 2, 3, 1)]])
    assert r.status(1) == {14: "CON"}
    v, li = r.vector(1, 14), r.links()
    assert (v.u_, v.v_, v.expansion) == (1, 0, 0)
    assert [(li[k].uid, li[k].lifetime) for k in sorted(li)] == [(1, 12), (1, 24)]
    far = lambda axis: [(x.hit, x.false_alarm, x.far) for x in T.far_counts(r.lab, r.ev, r.vec, CFG, axis).filter("method = 'noc'").collect()]
    assert far("corrected") == [(4, 0, 0.0)] and far("reference") == [(1, 3, 0.75)]


def test_optical_flow_is_scored_and_the_best_vector_written_back(spark):
    from dataclasses import replace

    from celltrack.api import Tracker

    # the core moves by one column; a new tail draws the centre, and so the plain vector, to two
    r = Run(spark, [[(2, 7, 2, 7, 2), (3, 6, 3, 6, 4)], [(2, 7, 3, 8, 2), (3, 6, 4, 7, 4), (4, 5, 9, 11, 1)]])
    plain = Tracker(r.cells, r.frames, CFG)
    full = Tracker(r.cells, r.frames, replace(CFG, opt_correction=True, validation=True))
    assert "opt" not in {x.method for x in plain.fars.collect()}
    fars = {x.method: x for x in full.fars.filter("level = 0").collect()}
    best, row, before = T.far_best(full.fars, full.feats).filter("frame = 1 AND level = 0").first(), full.tracks.filter("frame = 1 AND level = 0").first(), plain.tracks.filter("frame = 1 AND level = 0").first()
    assert fars["opt"].far == 0 < fars["noc"].far
    assert (row.method, row.far, row.u_, row.v_) == ("opt", 0.0, best.u_, best.v_) and row.u_ == fars["opt"].u
    assert before.method == "noc" and before.u_ == fars["noc"].u != row.u_


def test_split(spark):
    r = Run(spark, [[(1, 1, 1, 5, 1)], [(1, 1, 1, 2, 1), (1, 1, 4, 4, 1)]])
    assert r.status(1) == {13: "SPL", 16: "NEW/SPL"}
    a, b, li = r.vector(1, 13), r.vector(1, 16), r.links()
    assert (a.u_, a.v_) == (-1.5, 0) and a.expansion == pytest.approx(-1190.476190)
    assert (b.u_spl, b.v_spl) == (0, 0) and b.u_ is None
    assert li[1, 0, 13].uid == 1 and (li[1, 0, 16].uid, li[1, 0, 16].lifetime) == (2, 12)


def test_merge(spark):
    r = Run(spark, [[(1, 1, 1, 2, 1), (1, 1, 4, 4, 1)], [(1, 1, 1, 5, 1)]])
    e, v = r.ev.filter("frame = 1").first(), r.vector(1, 13)
    assert (e.status, e.past_label, e.merge_labels) == ("MRG", 13, [13, 16])
    assert (v.u_, v.u_mrg) == (1.5, 0.5) and v.expansion == pytest.approx(1190.476190)
    mean = Run(spark, [[(1, 1, 1, 2, 1), (1, 1, 4, 4, 1)], [(1, 1, 1, 5, 1)]], TrackConfig(CFG.grid, CFG.levels, 12, mrg_agg="mean"))
    assert mean.vector(1, 13).u_mrg == 0.25


def test_merge_and_split(spark):
    r = Run(spark, [[(1, 1, 1, 4, 1), (1, 1, 6, 7, 1)], [(1, 1, 3, 7, 1), (1, 1, 1, 1, 1)]])
    e = r.ev.filter("frame = 1 AND label = 15").first()
    assert (e.status, e.past_label) == ("MRG/SPL", 13) and r.status(1)[13] == "NEW/SPL"
    assert r.vector(1, 15).expansion == pytest.approx(308.641975) and r.links()[1, 0, 13].uid == 3


def test_expansion_without_a_mean_size_is_null(spark):
    from dataclasses import replace

    # five cells part into three pieces of five: 5 + (5 - 10) = 0
    r = Run(spark, [[(1, 1, 1, 5, 1)], [(1, 5, x, x, 1) for x in (1, 3, 5)]], replace(CFG, mrg_expansion=True, spl_expansion=True))
    assert r.status(1) == {13: "SPL", 15: "NEW/SPL", 17: "NEW/SPL"}
    assert (r.vector(1, 13).u_, r.vector(1, 13).expansion) == (-2, None)
    # with a smaller piece the mean is one half, and what is left of the earlier cluster is negative
    r = Run(spark, [[(1, 1, 1, 5, 1)], [(1, 5, 1, 1, 1), (1, 5, 3, 3, 1), (1, 4, 5, 5, 1)]], replace(CFG, mrg_expansion=True, spl_expansion=True))
    assert r.vector(1, 13).expansion == pytest.approx(1e6 * (5 + 4) / 720 / 0.5)


def test_new_and_small_overlap(spark):
    assert Run(spark, [[(0, 0, 0, 0, 1)], [(4, 4, 4, 4, 1)]]).status(1) == {52: "NEW"}
    assert Run(spark, [[(1, 1, 0, 10, 1)], [(1, 1, 10, 11, 1)]]).status(1) == {22: "NEW"}


def test_nested_identity(spark):
    blocks = [(1, 3, 1, 3, 1), (2, 2, 2, 2, 9)]
    r = Run(spark, [blocks, blocks])
    li = r.links()
    assert r.nested.count() == 2 and li[0, 1, 26].uid == li[0, 0, 13].uid == 1
    assert int(li[0, 1, 26].iuid) == 1 and li[0, 1, 26].iuid == li[1, 1, 26].iuid != 1


def test_gap(spark):
    three = [[(1, 2, 1, 2, 1)]] * 3
    assert Run(spark, three, minutes=[0, 12, 36]).status(2) == {13: "NEW"}
    wide = TrackConfig(CFG.grid, CFG.levels, 12, delta_tolerance=12)
    li = Run(spark, three, wide, [0, 12, 36]).links()
    assert [li[f, 0, 13].lifetime for f in range(3)] == [12, 24, 48]


def test_numbers_jump_over_empty_frames(spark):
    li = Run(spark, [[(1, 1, 1, 1, 1)], [], [(1, 1, 1, 1, 1)]]).links()
    assert [(r.cindex, r.uid) for _, r in sorted(li.items())] == [(1, 1), (3, 2)]


@pytest.mark.parametrize("eps, n", [(3, [3]), (2, [])])
def test_density_clusters(spark, eps, n):
    cfg = TrackConfig(CFG.grid, CFG.levels[:1], 12, cluster_method="dbscan", eps=eps)
    r = Run(spark, [[(0, 0, x, x, 1) for x in (0, 3, 6)]], cfg)
    assert [x["size"] for x in r.feats.collect()] == n


def test_diagonal_contact(spark):
    assert [x["size"] for x in Run(spark, [[(0, 0, 0, 0, 1), (1, 1, 1, 1, 1)]]).feats.collect()] == [2]


@pytest.mark.parametrize("op", [">=", "<=", ">", "<", "==", "!="])
def test_nan_passes_only_unequal(spark, op):
    df = spark.createDataFrame([(float("nan"),), (None,)], "v double")
    assert df.filter(T.passes(df["v"], op, 1.0)).count() == (1 if op == "!=" else 0)


def test_components_equal_brute_force():
    rng = np.random.default_rng(0)
    for radius in (1, 2, 3):
        for _ in range(30):
            y, x = np.nonzero(rng.random((12, 13)) < 0.18)
            if not len(y):
                continue
            want = y * 13 + x
            while True:
                near = (abs(y[:, None] - y) <= radius) & (abs(x[:, None] - x) <= radius)
                new = np.where(near, want, 10**9).min(1)
                if (new == want).all():
                    break
                want = new
            assert (T.component_labels(y, x, radius, 13) == want).all()


def test_tiles_merge_to_whole_clusters(spark):
    rng = np.random.default_rng(5)
    y, x = np.nonzero(rng.random((40, 40)) < 0.45)
    cfg = TrackConfig(GridSpec(40, 40), (Level(0, 1.0, 1),), 12)
    px = spark.createDataFrame([(0, 0, int(a), int(b), 1.0) for a, b in zip(y, x)], "frame int, level int, y int, x int, value double")
    whole, tiled = T.label_components(px, cfg), T.label_components(px, cfg, tile=8)
    assert rows(whole.select("label", "y", "x")) == rows(tiled.select("label", "y", "x"))


def test_asof_ties_and_emptiness(spark):
    ts = lambda *m: spark.createDataFrame([(k,) for k in m], "m int").selectExpr("CAST(timestamp_seconds(m * 60) AS timestamp_ntz) AS ts")
    minute = lambda df: [(r[0].hour * 60 + r[0].minute if r[0] else None, r[1].hour * 60 + r[1].minute if r[1] else None) for r in df.orderBy("ts").select("ts", "match_ts").collect()]
    left = ts(0, 5, 7, 30, 30, None)
    assert minute(enrich.asof(left, ts(0, 10))) == [(None, None), (0, 0), (5, 0), (7, 10), (30, 10), (30, 10)]
    assert minute(enrich.asof(left, ts(0, 10), tolerance_minutes=4)) == [(None, None), (0, 0), (5, None), (7, 10), (30, None), (30, None)]
    assert minute(enrich.asof(left, ts(5), "fixed"))[2] == (5, 5)
    assert all(b is None for _, b in minute(enrich.asof(left, ts(1).limit(0))))


def test_empty_input(spark):
    empty = spark.createDataFrame([], "frame int, y int, x int, value double")
    assert T.label_components(T.segment(empty, CFG), CFG).count() == 0


def test_settings_are_checked():
    with pytest.raises(ValueError):
        TrackConfig(CFG.grid, CFG.levels, 12, operator="~")
    with pytest.raises(ValueError):
        TrackConfig(CFG.grid, CFG.levels, 12, extra={"nonsense": 1})
    with pytest.warns(UserWarning):
        TrackConfig(CFG.grid, CFG.levels, 12, extra={"epsg": 4326})
