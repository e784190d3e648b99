"""Persistence: clusters of the last frame carried on by their mean vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celltrack.config import TrackConfig
from celltrack.operators import tracking as T
from celltrack.runtime import cut


def history(tracks: DataFrame, last: int, window: int) -> DataFrame:
    """The last ``window`` frames' rows of the clusters that have a vector in frame ``last``."""
    past = tracks.filter((F.col("frame") > last - window) & (F.col("frame") <= last))
    alive = past.filter((F.col("frame") == last) & F.col("u_").isNotNull() & F.col("v_").isNotNull()).select("level", "iuid").distinct()
    return past.join(alive, ["level", "iuid"], "left_semi")


def mean_vectors(kept: DataFrame) -> DataFrame:
    return kept.groupBy("level", "iuid").agg(F.avg("u_").alias("u_mean"), F.avg("v_").alias("v_mean"))


def image(tracks: DataFrame, labelled: DataFrame, last: int, window: int, cfg: TrackConfig) -> DataFrame:
    """``(y, x, value)`` one step after frame ``last``: moved pixels, mean where they meet, clipped to the grid.

    With ``edges`` columns wrap around instead. Clusters without a vector are not carried on.
    """
    g = cfg.grid
    kept = history(tracks, last, window)
    move = kept.filter(F.col("frame") == last).select(*T.KEY, "iuid").join(mean_vectors(kept), ["level", "iuid"])
    px = labelled.filter(F.col("frame") == last).join(move, T.KEY)
    y = F.bround(F.col("y") + F.col("v_mean") / g.y_res).cast("int")
    x = F.bround(F.col("x") + F.col("u_mean") / g.x_res).cast("int")
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c))
    x = F.pmod(x, F.lit(g.x_dim)) if cfg.edges else clip(x, g.x_dim)
    return px.select(clip(y, g.y_dim).alias("y"), x.alias("x"), "value").groupBy("y", "x").agg(F.avg("value").alias("value"))


MODES = {"persistence": image}


def image_by(mode: str):
    """The forecast image of a mode; ValueError for an unknown one."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    return MODES[mode]


def forecast(tracks: DataFrame, labelled: DataFrame, last: int, window: int, leads: int, cfg: TrackConfig, mode: str = "persistence") -> DataFrame:
    """``(issue_ts, ts, lead, frame, level, label, uid, iuid, status, size, mean, max, cx, cy, u_, v_)`` for each lead step.

    Times are those of the last frame and of each step after it. A cluster without a past has no uid. Without a frame
    ``last`` there are no rows.

    Each step's image is segmented, labelled and classified against the step before; a cluster with a past keeps the
    vector and identity it moved with, so the next step carries it on.
    """
    draw, out = image_by(mode), None
    issued = F.lit(tracks.filter(F.col("frame") == last).agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    tracks = tracks.select(*T.KEY, "uid", "iuid", "u_", "v_", "cx", "cy")
    for lead in range(1, leads + 1):
        frame = last + lead
        img = cut(draw(tracks, labelled, frame - 1, window, cfg).withColumn("frame", F.lit(frame)))
        lab = cut(T.label_components(T.segment(img.select("frame", "y", "x", "value"), cfg), cfg))
        both = labelled.filter(F.col("frame") == frame - 1).unionByName(lab)
        pairs = tracks.sparkSession.createDataFrame([(frame, frame - 1)], "frame int, prev_frame int")
        edges = cut(T.overlay(both, pairs, cfg))
        feats = T.features(lab, cfg)
        ev = T.events(feats, edges)
        prev = tracks.filter(F.col("frame") == frame - 1).select("level", F.col("label").alias("past_label"), "uid", "iuid", F.col("cx").alias("pcx"), F.col("cy").alias("pcy"))
        here = cut(feats.join(ev.select(*T.KEY, "status", "past_label"), T.KEY).join(prev, ["level", "past_label"], "left"))
        moved = {"u_": F.col("cx") - F.col("pcx"), "v_": F.col("cy") - F.col("pcy")}
        rows = here.select(F.lit(lead).alias("lead"), *T.KEY, "uid", "iuid", "status", "size", "mean", "max", "cx", "cy", *(c.alias(n) for n, c in moved.items()))
        out = rows if out is None else out.unionByName(rows)
        new = here.select(*T.KEY, "uid", "iuid", *(c.alias(n) for n, c in moved.items()), "cx", "cy")
        tracks = cut(tracks.filter(F.col("frame") > frame - window).unionByName(new))
        labelled = cut(labelled.filter(F.col("frame") == frame - 1).unionByName(lab).filter(F.col("frame") == frame))
    step = F.make_interval(mins=F.col("lead") * F.lit(int(cfg.delta_time)))
    return out.select(issued.alias("issue_ts"), (issued + step).cast("timestamp_ntz").alias("ts"), *rows.columns)
