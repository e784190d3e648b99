"""From cells to linked clusters: thresholds, components, overlap, events, vectors, identities.

Clusters are sets of pixels; a cluster's label is the smallest ``y * x_dim + x`` of its pixels, so
geometry questions are equi-joins on (frame, level, y, x). "First" always means the smallest label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celltrack.config import TrackConfig
from celltrack.runtime import cut, drop

KEY = ["frame", "level", "label"]
TILE = 1024


def passes(value: Column, operator: str, threshold) -> Column:
    """Threshold test as the operator stands; NaN passes only !=, null passes nothing."""
    t = F.lit(threshold)
    if operator == "!=":
        return F.isnan(value) | (value != t)
    test = {">=": value >= t, "<=": value <= t, ">": value > t, "<": value < t, "==": value == t}[operator]
    return test & ~F.isnan(value)


def segment(cells: DataFrame, cfg: TrackConfig) -> DataFrame:
    """``(frame, level, y, x, value)`` of every cell at every level it passes, in one scan."""
    hits = F.array(*(F.when(passes(F.col("value"), cfg.operator, lv.threshold), F.lit(lv.level)) for lv in cfg.levels))
    return cells.select("frame", "y", "x", "value", F.explode(F.array_compact(hits)).alias("level")).select("frame", "level", "y", "x", "value")


def component_labels(y: np.ndarray, x: np.ndarray, radius: int, x_dim: int) -> np.ndarray:
    """Smallest y * x_dim + x of each pixel's component of Chebyshev distance ``radius``."""
    wide = int(x.max()) + 2 * radius + 2
    code = y.astype(np.int64) * wide + x
    order = np.argsort(code, kind="stable")
    code = code[order]
    a, b = [], []
    for dy in range(radius + 1):
        for dx in range(-radius, radius + 1):
            if dy == 0 and dx <= 0:
                continue
            want = code + dy * wide + dx
            at = np.searchsorted(code, want)
            hit = (at < len(code)) & (code[np.minimum(at, len(code) - 1)] == want)
            a.append(np.flatnonzero(hit)), b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(code))
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, lo, hi = a[live], b[live], np.minimum(ra, rb)[live], np.maximum(ra, rb)[live]
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    name = (y.astype(np.int64) * x_dim + x)[order]
    least = np.full(len(code), np.iinfo(np.int64).max)
    np.minimum.at(least, root, name)
    out = np.empty(len(code), np.int64)
    out[order] = least[root]
    return out


def label_components(pixels: DataFrame, cfg: TrackConfig, tile: int = TILE) -> DataFrame:
    """``(frame, level, label, y, x, value)`` of the clusters that are large enough.

    A frame larger than ``tile`` is labelled tile by tile; labels that meet across tile borders are then
    merged by spreading the smallest label over the border pairs, so no task ever holds more than a tile.
    """
    radius, x_dim = cfg.radius, cfg.grid.x_dim
    tiled = max(cfg.grid.x_dim, cfg.grid.y_dim) > tile
    keys = ["frame", "level"]
    if tiled:
        pixels = pixels.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
        keys += ["ty", "tx"]

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(label=component_labels(rows["y"].to_numpy(), rows["x"].to_numpy(), radius, x_dim))
        return rows[["frame", "level", "label", "y", "x", "value"]]

    out = pixels.groupBy(*keys).applyInPandas(label, "frame int, level int, label bigint, y int, x int, value double")
    if tiled:
        out = _merge_tiles(cut(out), radius, tile)
    least = F.coalesce(*(F.when(F.col("level") == lv.level, F.lit(max(cfg.floor_size, lv.min_size))) for lv in cfg.levels))
    w = Window.partitionBy(*KEY)
    return out.withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.col("__n") >= least).drop("__n")


def _merge_tiles(labelled: DataFrame, radius: int, tile: int) -> DataFrame:
    near = (F.col("y") % tile < radius) | (F.col("y") % tile >= tile - radius) | (F.col("x") % tile < radius) | (F.col("x") % tile >= tile - radius)
    rim = labelled.filter(near).select("frame", "level", "y", "x", "label")
    offsets = [(dy, dx) for dy in range(radius + 1) for dx in range(-radius, radius + 1) if dy or dx > 0]
    moved = rim.select("frame", "level", F.col("label").alias("other"), F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in offsets))).alias("p")).select("frame", "level", "other", "p.y", "p.x")
    pairs = moved.join(rim, ["frame", "level", "y", "x"]).filter("label <> other").select("frame", "level", "label", "other").distinct()
    pairs = cut(pairs.unionByName(pairs.select("frame", "level", F.col("other").alias("label"), F.col("label").alias("other"))))
    best = cut(pairs.select("frame", "level", "label", F.col("label").alias("low")).distinct())
    total = None
    while True:
        seen = pairs.join(best.withColumnRenamed("label", "other"), ["frame", "level", "other"]).groupBy(*KEY).agg(F.min("low").alias("heard"))
        hop = best.join(seen, KEY).select(*KEY, F.least("low", "heard").alias("low"))
        jump = hop.join(hop.select("frame", "level", F.col("label").alias("low"), F.col("low").alias("lower")), ["frame", "level", "low"], "left")
        before, best = best, cut(jump.select(*KEY, F.coalesce("lower", "low").alias("low")))
        drop(before)
        now = best.agg(F.sum("low")).first()[0]
        if now == total:
            break
        total = now
    return labelled.join(best, KEY, "left").select("frame", "level", F.coalesce("low", "label").alias("label"), "y", "x", "value")


def centre(cfg: TrackConfig, axis: str) -> Column:
    """Mean pixel centre in map units; without bounds the mean index itself."""
    g = cfg.grid
    if not g.geographic:
        return F.avg(axis)
    origin, res = (g.x0, g.x_res) if axis == "x" else (g.y0, g.y_res)
    return origin + (F.avg(axis) + 0.5) * res


def features(labelled: DataFrame, cfg: TrackConfig) -> DataFrame:
    """``(frame, level, label, size, min, mean, max, std, cx, cy, xmin, xmax, ymin, ymax)``; statistics skip NaN."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return labelled.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("size"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"),
        centre(cfg, "x").alias("cx"), centre(cfg, "y").alias("cy"),
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"),
    )


def pixel_arrays(labelled: DataFrame) -> DataFrame:
    p = F.array_sort(F.collect_list(F.struct("y", "x", "value")))
    return labelled.groupBy(*KEY).agg(p.alias("p")).select(*KEY, F.col("p.y").alias("array_y"), F.col("p.x").alias("array_x"), F.col("p.value").alias("array_values"))


def frame_pairs(frames: DataFrame, cfg: TrackConfig) -> DataFrame:
    """``(frame, prev_frame, gap_min)`` of frames whose predecessor is near enough in time.

    The window has no partition: ``frames`` is one row for each time step, never one for each cell.
    """
    w = Window.orderBy("ts")
    gap = F.timestamp_diff("MINUTE", F.col("__pts"), F.col("ts"))
    p = frames.select("frame", "ts", F.lag("frame").over(w).alias("prev_frame"), F.lag("ts").over(w).alias("__pts"))
    return p.withColumn("gap_min", gap).filter(F.col("gap_min") <= cfg.delta_time + cfg.delta_tolerance).select("frame", "prev_frame", "gap_min")


def overlay(labelled: DataFrame, pairs: DataFrame, cfg: TrackConfig) -> DataFrame:
    """``(frame, level, label, prev_frame, prev_label, shared, size, prev_size, overlap)``: edges of enough overlap."""
    px = labelled.select("frame", "level", "y", "x", "label")
    cur = px.join(pairs.select("frame", "prev_frame"), "frame")
    prev = px.select(F.col("frame").alias("prev_frame"), "level", "y", "x", F.col("label").alias("prev_label"))
    shared = cur.join(prev, ["prev_frame", "level", "y", "x"]).groupBy(*KEY, "prev_frame", "prev_label").agg(F.count(F.lit(1)).alias("shared"))
    size = labelled.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
    before = size.select(F.col("frame").alias("prev_frame"), "level", F.col("label").alias("prev_label"), F.col("size").alias("prev_size"))
    return (
        shared.join(before, ["prev_frame", "level", "prev_label"])
        .join(size, KEY)
        .withColumn("overlap", F.col("shared") * 100.0 / F.col("prev_size"))
        .filter(F.col("overlap") >= cfg.min_overlap)
        .select(*KEY, "prev_frame", "prev_label", "shared", "size", "prev_size", "overlap")
    )


def events(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """``(frame, level, label, status, prev_frame, past_label, merge_labels, split_parent)`` of every cluster."""
    of_prev = Window.partitionBy("frame", "level", "prev_label")
    e = edges.withColumns({"n_cur": F.count(F.lit(1)).over(of_prev), "rank": F.row_number().over(of_prev.orderBy(F.col("size").desc(), "label"))})
    facts = e.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_prev"),
        F.max("n_cur").alias("n_cur"),
        F.max((F.col("n_cur") > 1) & (F.col("rank") == 1)).alias("major"),
        F.max((F.col("n_cur") > 1) & (F.col("rank") > 1)).alias("minor"),
        F.max("prev_frame").alias("prev_frame"),
        F.min_by("prev_label", F.struct(-F.col("prev_size"), F.col("prev_label"))).alias("largest"),
        F.array_sort(F.collect_list("prev_label")).alias("prevs"),
        F.max(F.when((F.col("n_cur") > 1) & (F.col("rank") > 1), F.col("prev_label"))).alias("split_parent"),
    )
    mrg = F.col("n_prev") > 1
    con = (F.col("n_prev") == 1) & (F.col("n_cur") == 1)
    status = F.when(mrg & F.col("major"), "MRG/SPL").when(F.col("minor"), "NEW/SPL").when(F.col("major"), "SPL").when(mrg, "MRG").when(con, "CON")
    out = facts.select(
        *KEY, status.alias("status"), "prev_frame", F.when(mrg | F.col("major") | con, F.col("largest")).alias("past_label"),
        F.when(mrg, F.col("prevs")).alias("merge_labels"), "split_parent",
    )
    return clusters.select(*KEY).join(out, KEY, "left").withColumn("status", F.coalesce("status", F.lit("NEW")))


def inside(labelled: DataFrame) -> DataFrame:
    """``(frame, level, label, in_level, in_label)``: clusters of higher levels wholly inside a cluster."""
    inner = labelled.select("frame", "y", "x", F.col("level").alias("in_level"), F.col("label").alias("in_label"))
    both = labelled.select("frame", "y", "x", "level", "label").join(inner, ["frame", "y", "x"]).filter("in_level > level")
    n = both.groupBy(*KEY, "in_level", "in_label").agg(F.count(F.lit(1)).alias("n"))
    size = labelled.groupBy("frame", F.col("level").alias("in_level"), F.col("label").alias("in_label")).agg(F.count(F.lit(1)).alias("size"))
    return n.join(size, ["frame", "in_level", "in_label"]).filter("n = size").select(*KEY, "in_level", "in_label")


def vectors(feats: DataFrame, ev: DataFrame, edges: DataFrame, labelled: DataFrame, nested: DataFrame, cfg: TrackConfig) -> DataFrame:
    """``(frame, level, label, u_, v_, expansion, u_spl, v_spl, u_mrg, v_mrg, u_inc, v_inc, u_elp, v_elp)``.

    With ``spl_expansion`` the pieces can outgrow the earlier cluster; where the mean size is then 0, expansion is null.
    """
    me = feats.select(*KEY, "size", "cx", "cy")
    prev = lambda label: feats.select(F.col("frame").alias("prev_frame"), "level", F.col("label").alias(label), F.col("size").alias("psize"), F.col("cx").alias("pcx"), F.col("cy").alias("pcy"))
    sizes = feats.select(F.col("frame").alias("prev_frame"), "level", F.col("label").alias("m"), F.col("size").alias("msize"), F.col("cx").alias("mcx"), F.col("cy").alias("mcy"))
    merged = ev.filter("merge_labels IS NOT NULL").select(*KEY, "prev_frame", F.explode("merge_labels").alias("m")).join(sizes, ["prev_frame", "level", "m"]).join(me, KEY)
    agg = F.sum if cfg.mrg_agg == "sum" else F.avg
    mrg = merged.groupBy(*KEY).agg(agg(F.col("cx") - F.col("mcx")).alias("u_mrg"), agg(F.col("cy") - F.col("mcy")).alias("v_mrg"), F.sum("msize").alias("merged_size"))
    news = ev.filter("status = 'NEW/SPL'").select("level", "prev_frame", F.col("split_parent").alias("past_label"), *KEY[:1], "label").join(me, KEY).groupBy("prev_frame", "level", "past_label").agg(F.sum("size").alias("news_size"))
    base = ev.join(me, KEY).join(prev("past_label"), ["prev_frame", "level", "past_label"], "left").join(mrg, KEY, "left").join(news, ["prev_frame", "level", "past_label"], "left")
    p = F.col("psize")
    if cfg.mrg_expansion:
        p = F.coalesce("merged_size", p)
    if cfg.spl_expansion:
        p = p - F.coalesce("news_size", F.lit(0))
    rate = 1e6 * ((F.col("size") - p) / (60.0 * cfg.delta_time)) / (F.nullif(F.col("size") + p, F.lit(0)) / 2.0)
    px = labelled.select("frame", "level", "y", "x", "label")
    part = ev.filter("split_parent IS NOT NULL").select(*KEY, "prev_frame", "split_parent")
    cut_px = px.join(part, KEY).join(px.select(F.col("frame").alias("prev_frame"), "level", "y", "x", F.col("label").alias("split_parent")), ["prev_frame", "level", "y", "x", "split_parent"])
    spl = cut_px.groupBy(*KEY).agg(centre(cfg, "x").alias("sx"), centre(cfg, "y").alias("sy"))
    minor = F.col("status") == "NEW/SPL"
    uv = base.join(spl, KEY, "left").select(
        *KEY, "status", (F.col("cx") - F.col("pcx")).alias("u_"), (F.col("cy") - F.col("pcy")).alias("v_"), rate.alias("expansion"),
        F.when(minor, F.col("cx") - F.col("sx")).alias("u_spl"), F.when(minor, F.col("cy") - F.col("sy")).alias("v_spl"), "u_mrg", "v_mrg",
    )
    inner = nested.join(uv.select("frame", F.col("level").alias("in_level"), F.col("label").alias("in_label"), F.col("u_").alias("iu"), F.col("v_").alias("iv")), ["frame", "in_level", "in_label"])
    sums = inner.groupBy(*KEY).agg(F.sum("iu").alias("su"), F.count("iu").alias("nu"), F.sum("iv").alias("sv"), F.count("iv").alias("nv"))
    has = F.col("su").isNotNull() | F.col("nu").isNotNull()
    return uv.join(sums, KEY, "left").select(
        *KEY, "status", "u_", "v_", "expansion", "u_spl", "v_spl", "u_mrg", "v_mrg",
        F.when(has, (F.col("u_") + F.coalesce("su", F.lit(0.0))) / (1 + F.col("nu"))).alias("u_inc"),
        F.when(has, (F.col("v_") + F.coalesce("sv", F.lit(0.0))) / (1 + F.col("nv"))).alias("v_inc"),
        F.col("u_").alias("u_elp"), F.col("v_").alias("v_elp"),
    )


def far_counts(labelled: DataFrame, ev: DataFrame, vecs: DataFrame, cfg: TrackConfig, axis: str = "corrected") -> DataFrame:
    """``(frame, level, label, method, u, v, hit, false_alarm, far)`` for each vector of a cluster with a past.

    Vectors ``u_opt, v_opt`` (map units) are scored where ``vecs`` has them. The past cluster's pixels are moved by the vector, rounded half to even, and compared with the cluster's.
    ``axis='reference'`` adds u to rows and v to columns. Null vectors have no row.
    """
    g = cfg.grid
    m = [("noc", "u_", "v_"), ("spl", "u_spl", "v_spl"), ("mrg", "u_mrg", "v_mrg"), ("inc", "u_inc", "v_inc"), ("elp", "u_elp", "v_elp")]
    if "u_opt" in vecs.columns:
        m.append(("opt", "u_opt", "v_opt"))
    long = vecs.select(*KEY, F.explode(F.array(*(F.struct(F.lit(n).alias("method"), F.col(u).alias("u"), F.col(v).alias("v")) for n, u, v in m))).alias("m")).select(*KEY, "m.*").filter("u IS NOT NULL AND v IS NOT NULL")
    past = ev.filter("past_label IS NOT NULL").select(*KEY, "prev_frame", "past_label").join(long, KEY)
    du, dv = F.bround(F.col("u") / g.x_res).cast("int"), F.bround(F.col("v") / g.y_res).cast("int")
    dy, dx = (dv, du) if axis == "corrected" else (du, dv)
    px = labelled.select(F.col("frame").alias("prev_frame"), "level", F.col("label").alias("past_label"), "y", "x")
    moved = past.join(px, ["prev_frame", "level", "past_label"]).select(*KEY, "method", "u", "v", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))
    own = labelled.select(*KEY, "y", "x", F.lit(1).alias("hit"))
    n = moved.join(own, [*KEY, "y", "x"], "left").groupBy(*KEY, "method", "u", "v").agg(F.count("hit").alias("hit"), F.count(F.when(F.col("hit").isNull(), 1)).alias("false_alarm"))
    return n.withColumn("far", F.col("false_alarm") / (F.col("hit") + F.col("false_alarm")))


METHOD_ORDER = ["noc", "spl", "mrg", "inc", "opt", "elp"]


def far_best(counts: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(frame, level, label, method, far, u_, v_)``: the method of least far; unlinked rows are noc with far 1."""
    rank = F.array_position(F.array(*(F.lit(m) for m in METHOD_ORDER)), F.col("method"))
    best = counts.groupBy(*KEY).agg(F.min_by(F.struct("method", "far", "u", "v"), F.struct("far", rank)).alias("b"))
    return clusters.select(*KEY).join(best, KEY, "left").select(*KEY, F.coalesce("b.method", F.lit("noc")).alias("method"), F.coalesce("b.far", F.lit(1.0)).alias("far"), F.col("b.u").alias("u_"), F.col("b.v").alias("v_"))


def _code(frame: str, label: str) -> Column:
    return F.col(frame).cast("bigint") * (1 << 40) + F.col("level").cast("bigint") * (1 << 34) + F.col(label)


def follow(nodes: DataFrame) -> DataFrame:
    """``(id, root, weight, depth)`` of ``nodes(id, parent, weight)``: pointer doubling to the root.

    ``weight`` adds up over the ``depth`` steps. As many joins as the logarithm of the longest chain; rows stay narrow.
    """
    top = F.col("parent").isNull()
    state = cut(nodes.select("id", F.coalesce("parent", "id").alias("root"), F.when(top, F.lit(0)).otherwise(F.col("weight")).cast("bigint").alias("weight"), F.when(top, 0).otherwise(1).cast("bigint").alias("depth"), top.alias("done")))
    while not state.filter("NOT done").isEmpty():
        up = state.select(F.col("id").alias("root"), F.col("root").alias("r2"), F.col("weight").alias("w2"), F.col("depth").alias("n2"), F.col("done").alias("d2"))
        step = state.filter("NOT done").join(up, "root").select("id", F.col("r2").alias("root"), (F.col("weight") + F.col("w2")).alias("weight"), (F.col("depth") + F.col("n2")).alias("depth"), F.col("d2").alias("done"))
        before, state = state, cut(state.filter("done").unionByName(step))
        drop(before)
    return state.drop("done")


def trails(nodes: DataFrame) -> DataFrame:
    """``(id, root, weight, path)`` of ``nodes(id, parent, weight, point)``: what adds up and the points passed from the root.

    A parent's smallest heir carries its line on; the lines are ranked first and their points gathered once, in order. Lines
    that begin at another heir hang on a node of an earlier line and take over what lies before it, line upon line.
    """
    heirs = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.min("id").alias("heir"))
    ranked = follow(nodes.join(heirs, "parent", "left").select("id", F.when(F.col("heir") == F.col("id"), F.col("parent")).alias("parent"), "weight"))
    along = Window.partitionBy("line").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.select("id", F.col("root").alias("line"), F.col("weight").alias("sum"), "depth")
    placed = cut(nodes.join(ranked, "id").select("id", "parent", "weight", "line", "sum", F.collect_list("point").over(along).alias("path")))
    hung = cut(placed.filter("id = line AND parent IS NOT NULL").select("line", F.col("parent").alias("hang"), F.col("weight").alias("step")))
    if hung.isEmpty():
        return placed.select("id", F.col("line").alias("root"), F.col("sum").alias("weight"), "path")
    free = placed.filter("id = line AND parent IS NULL")
    known = cut(free.select("line", F.col("line").alias("root"), F.lit(0).cast("bigint").alias("before"), F.array_except("path", "path").alias("prefix")))
    while not hung.isEmpty():
        at = placed.select(F.col("id").alias("hang"), F.col("line").alias("up"), "sum", "path")
        new = hung.join(at, "hang").join(known.withColumnRenamed("line", "up"), "up")
        new = cut(new.select("line", "root", (F.col("before") + F.col("sum") + F.col("step")).alias("before"), F.concat("prefix", "path").alias("prefix")))
        if new.isEmpty():
            break  # parents that are no nodes
        known, hung = cut(known.unionByName(new)), cut(hung.join(new.select("line"), "line", "left_anti"))
    return placed.join(known, "line").select("id", "root", (F.col("before") + F.col("sum")).alias("weight"), F.concat("prefix", "path").alias("path"))


def number_in_order(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in ascending order of the distinct values of ``key``.

    Rows are spread by ranges of the key and numbered within each range; only the ranges' sizes meet in one task.
    """
    spread = cut(rows.repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row for each range
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = spread.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(key)))
    return ranked.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__k")).cast("bigint")).drop("__part", "__k", "__before")


def link(feats: DataFrame, ev: DataFrame, nested: DataFrame, frames: DataFrame, cfg: TrackConfig) -> DataFrame:
    """``(frame, level, label, cindex, uid, iuid, inner, lifetime, n_points, trajectory)`` of every cluster.

    A row inherits from its past unless its status says NEW. Level-0 roots are numbered by (frame, label). Higher
    levels take the uid of the level-0 cluster around them, or a number after all others where none is; their iuid adds
    ``inner``, the rank of their inner track within the uid, in digits enough for the largest rank (four at least), and
    lasts as long as the uid does. cindex has a gap for each empty frame. The one window without partition runs over frames.
    """
    ts = frames.select("frame", "ts")
    pts = ts.select(F.col("frame").alias("prev_frame"), F.col("ts").alias("__pts"))
    at = ev.join(feats.select(*KEY, "cx", "cy"), KEY).join(ts, "frame").join(pts, "prev_frame", "left")
    chained = F.col("past_label").isNotNull() & ~F.col("status").contains("NEW")
    gap = F.timestamp_diff("MINUTE", F.col("__pts"), F.col("ts"))
    parent = F.when(chained, _code("prev_frame", "past_label"))
    weight = F.when(chained, gap)
    if cfg.preserv_split:
        life_parent = F.coalesce(parent, F.when(F.col("split_parent").isNotNull(), _code("prev_frame", "split_parent")))
        lives = follow(at.select(_code("frame", "label").alias("id"), life_parent.alias("parent"), F.coalesce(weight, F.lit(0)).alias("weight"))).select("id", F.col("weight").alias("life"))
    point = F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))
    roots = cut(trails(at.select(_code("frame", "label").alias("id"), parent.alias("parent"), weight.cast("bigint").alias("weight"), point.alias("point"))))
    if not cfg.preserv_split:
        lives = roots.select("id", F.col("weight").alias("life"))
    rows = cut(at.select(*KEY, _code("frame", "label").alias("id"), parent.alias("parent")).join(roots.select("id", "root", "path"), "id").join(lives, "id"))
    base_roots = number_in_order(rows.filter("level = 0 AND id = root").select("root"), "root", "base_uid").withColumn("base_uid", F.col("base_uid") + (cfg.initial_uid - 1))
    base_roots = cut(base_roots)
    base = rows.filter("level = 0").select("frame", F.col("label").alias("b_label"), "root").join(base_roots, "root").select("frame", "b_label", F.col("base_uid").alias("uid0"))
    around = nested.filter("level = 0").select("frame", F.col("in_level").alias("level"), F.col("in_label").alias("label"), F.col("label").alias("b_label"))
    narrow = rows.select(*KEY, "id", "parent", "root").join(around, KEY, "left").withColumn("b_label", F.when(F.col("level") == 0, F.col("label")).otherwise(F.col("b_label"))).join(base, ["frame", "b_label"], "left")
    known = cut(narrow.select(*KEY, "id", "parent", "root", "uid0"))
    most = cfg.initial_uid - 1 + base_roots.count()
    loose = number_in_order(known.filter("uid0 IS NULL AND id = root").select("root"), "root", "loose_uid").withColumn("loose_uid", F.col("loose_uid") + most)
    known = cut(known.join(loose, "root", "left").withColumn("uid", F.coalesce("uid0", "loose_uid")))
    # a loose chain whose root was inside a base cluster keeps that root's uid
    rooted = known.filter("id = root").select("root", F.col("uid").alias("root_uid"))
    known = cut(known.join(rooted, "root").withColumn("uid", F.coalesce("uid", "root_uid")))
    up = known.select(F.col("id").alias("parent"), F.col("uid").alias("p_uid"))
    inner = cut(known.filter("level > 0").join(up, "parent", "left").select("id", "parent", "uid", "p_uid"))
    same = follow(inner.select("id", F.when(F.col("p_uid") == F.col("uid"), F.col("parent")).alias("parent"), F.lit(0).alias("weight"))).select("id", F.col("root").alias("core"))
    ids = inner.select("id", "uid").join(same, "id")
    cores = cut(ids.filter("id = core").withColumn("inner", F.row_number().over(Window.partitionBy("uid").orderBy("core")).cast("bigint")).select("core", "inner"))
    digits = max(4, len(str(cores.agg(F.max("inner")).first()[0] or 0)))
    ids = ids.join(cores, "core").select("id", "inner")
    frame_no = frames.join(feats.groupBy("frame").agg(F.count(F.lit(1)).alias("n")), "frame", "left").select("frame", "ts", F.coalesce("n", F.lit(0)).alias("n"))
    before = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    offset = frame_no.withColumn("start", F.coalesce(F.sum(F.greatest("n", F.lit(1))).over(before), F.lit(0))).select("frame", "start")
    number = F.row_number().over(Window.partitionBy("frame").orderBy("level", "label"))
    suffix = F.concat(F.col("uid").cast("string"), F.lit("."), F.repeat(F.lit("0"), F.col("level") - 1), F.lpad(F.col("inner").cast("string"), digits, "0")).cast("double")
    path = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("path", lambda p: F.format_string("%.4f %.4f", p["x"], p["y"])), ", "), F.lit(")"))
    return known.select(*KEY, "id", "uid").join(rows.select("id", "life", "path"), "id").join(ids, "id", "left").join(offset, "frame").select(
        *KEY, (F.col("start") + number).cast("bigint").alias("cindex"), F.col("uid").cast("bigint").alias("uid"),
        F.when(F.col("level") == 0, F.col("uid").cast("double")).otherwise(suffix).alias("iuid"), "inner", (F.col("life") + cfg.delta_time).cast("bigint").alias("lifetime"),
        F.size("path").alias("n_points"), F.when(F.size("path") > 1, path).alias("trajectory"),
    )


def previous_ids(links: DataFrame, ev: DataFrame) -> DataFrame:
    """``(frame, level, label, prv_mrg_uids, prv_mrg_iuids, prv_spl_uid, prv_spl_iuid)`` of clusters that merged or split off.

    The lists are in order of the earlier clusters' labels.
    """
    was = lambda label: links.select(F.col("frame").alias("prev_frame"), "level", F.col("label").alias(label), "uid", "iuid")
    m = ev.filter("merge_labels IS NOT NULL").select(*KEY, "prev_frame", F.explode("merge_labels").alias("m")).join(was("m"), ["prev_frame", "level", "m"])
    m = m.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("m", "uid", "iuid"))).alias("l")).select(*KEY, F.col("l.uid").alias("prv_mrg_uids"), F.col("l.iuid").alias("prv_mrg_iuids"))
    s = ev.filter("split_parent IS NOT NULL").select(*KEY, "prev_frame", "split_parent").join(was("split_parent"), ["prev_frame", "level", "split_parent"])
    s = s.select(*KEY, F.col("uid").alias("prv_spl_uid"), F.col("iuid").alias("prv_spl_iuid"))
    return m.join(s, KEY, "full")


def seam_partners(feats: DataFrame, labelled: DataFrame, cfg: TrackConfig) -> DataFrame:
    """``(frame, label, board_label)``: level-0 clusters meeting across the left and right border, smaller to larger."""
    rim = labelled.filter(f"level = 0 AND (x = 0 OR x = {cfg.grid.x_dim - 1})").select("frame", "y", "x", "label")
    left, right = rim.filter("x = 0"), rim.filter("x <> 0").select("frame", "y", F.col("label").alias("r_label"))
    near = left.withColumn("y", F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1))).join(right, ["frame", "y"]).select("frame", "label", "r_label").filter("label <> r_label").distinct()
    size = feats.filter("level = 0").select("frame", "label", "size")
    both = near.join(size, ["frame", "label"]).join(size.select("frame", F.col("label").alias("r_label"), F.col("size").alias("r_size")), ["frame", "r_label"])
    small_left = (F.col("size") < F.col("r_size")) | ((F.col("size") == F.col("r_size")) & (F.col("label") > F.col("r_label")))
    pair = both.select("frame", F.when(small_left, F.col("label")).otherwise(F.col("r_label")).alias("label"), F.when(small_left, F.col("r_label")).otherwise(F.col("label")).alias("other"), F.greatest("size", "r_size").alias("s"))
    return pair.groupBy("frame", "label").agg(F.min_by("other", F.struct(-F.col("s"), F.col("other"))).alias("board_label"))


def share_identity(tracks: DataFrame, partners: DataFrame) -> DataFrame:
    """Level-0 clusters with a partner across the border take its uid, iuid and status and are marked ``board``."""
    other = tracks.filter("level = 0").select("frame", F.col("label").alias("board_label"), F.col("uid").alias("__u"), F.col("iuid").alias("__i"), F.col("status").alias("__s"))
    pair = partners.join(other, ["frame", "board_label"]).withColumn("level", F.lit(0))
    out = tracks.join(pair, KEY, "left")
    return out.withColumns({"uid": F.coalesce("__u", "uid"), "iuid": F.coalesce("__i", "iuid"), "status": F.coalesce("__s", "status"), "board": F.col("board_label").isNotNull()}).drop("__u", "__i", "__s")
