"""The engine as one object: every stage of a tracking run as a DataFrame, computed on first use.

    t = Tracker(cells, frames, TrackConfig(...))
    t.tracks.createOrReplaceTempView("tracks")

``cells(frame, y, x, value)`` and ``frames(frame, ts)`` may come from any table, from ``sources.frames.read_frames``
or from a generator; an empty frame has a row in ``frames`` and none in ``cells``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celltrack.config import TrackConfig
from celltrack.functions import outline
from celltrack.functions import physics as ph
from celltrack.operators import forecast as fc
from celltrack.operators import imaging
from celltrack.operators import tracking as T
from celltrack.runtime import cut, scratch
from celltrack.sources import catalog


def wildcards(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Columns by name or by a beginning that ends in ``*``, each once; an unknown plain name is an error."""
    out: list[str] = []
    for n in names:
        found = [c for c in df.columns if c.startswith(n[:-1])] if n.endswith("*") else [n]
        if found == [n] and n not in df.columns:
            raise KeyError(n)
        out += [c for c in found if c not in out]
    return out


class Tracker:
    def __init__(self, cells: DataFrame, frames: DataFrame, cfg: TrackConfig):
        self.cells, self.frames, self.cfg = cells, frames, cfg

    @cached_property
    def pixels(self) -> DataFrame:
        return T.segment(self.cells, self.cfg)

    @cached_property
    def labelled(self) -> DataFrame:
        return cut(T.label_components(self.pixels, self.cfg))

    @cached_property
    def feats(self) -> DataFrame:
        return cut(T.features(self.labelled, self.cfg))

    @cached_property
    def pairs(self) -> DataFrame:
        return T.frame_pairs(self.frames, self.cfg)

    @cached_property
    def edges(self) -> DataFrame:
        shapes = cut(outline.hull_pixels(self.labelled)) if self.cfg.convex_hull else self.labelled
        return cut(T.overlay(shapes, self.pairs, self.cfg))

    @cached_property
    def ev(self) -> DataFrame:
        return cut(T.events(self.feats, self.edges))

    @cached_property
    def nested(self) -> DataFrame:
        return cut(T.inside(self.labelled))

    @cached_property
    def flow_points(self) -> DataFrame:
        """Optical-flow vectors at the points of clusters, in cells."""
        g = self.cfg.grid
        return cut(imaging.flow_points(imaging.normalize(self.cells), self.labelled, self.pairs, g.y_dim, g.x_dim, method=self.cfg.opt_mtd))

    @cached_property
    def vecs(self) -> DataFrame:
        v = T.vectors(self.feats, self.ev, self.edges, self.labelled, self.nested, self.cfg)
        if self.cfg.opt_correction:
            g = self.cfg.grid
            flow = self.flow_points.groupBy(*T.KEY).agg(F.avg("u").alias("u_opt"), F.avg("v").alias("v_opt"))
            v = v.join(flow.select(*T.KEY, (F.col("u_opt") * g.x_res).alias("u_opt"), (F.col("v_opt") * g.y_res).alias("v_opt")), T.KEY, "left")
        return cut(v)

    @cached_property
    def links(self) -> DataFrame:
        parts = self.feats, self.ev, self.nested, self.frames  # before the block, so that they stay
        with scratch() as keep:
            out = cut(T.link(*parts, self.cfg))
            keep(out)
        return out

    @cached_property
    def previous(self) -> DataFrame:
        """The ids that clusters merged or split off from."""
        return T.previous_ids(self.links, self.ev)

    @cached_property
    def fars(self) -> DataFrame:
        return cut(T.far_counts(self.labelled, self.ev, self.vecs, self.cfg))

    @cached_property
    def tracks(self) -> DataFrame:
        """The tracking table without pixel lists; with ``validation`` u_ and v_ are those of the method of least far."""
        n = self.nested.groupBy(*T.KEY).agg(F.count(F.lit(1)).alias("inside_clusters"))
        level = F.coalesce(*(F.when(F.col("level") == lv.level, F.lit(lv.threshold)) for lv in self.cfg.levels))
        best = T.far_best(self.fars, self.feats).withColumnsRenamed({"u_": "__u", "v_": "__v"})
        t = self.links.join(self.feats, T.KEY).join(self.ev.select(*T.KEY, "status", "past_label", "merge_labels", "split_parent"), T.KEY)
        t = t.join(self.vecs.drop("status"), T.KEY).join(best, T.KEY).join(n, T.KEY, "left").join(self.frames.select("frame", "ts"), "frame")
        if self.cfg.validation:
            t = t.withColumns({"u_": F.coalesce("__u", "u_"), "v_": F.coalesce("__v", "v_")})
        return cut(t.drop("__u", "__v").withColumns({"threshold": level, "inside_clusters": F.coalesce("inside_clusters", F.lit(0))}))

    @cached_property
    def partners(self) -> DataFrame:
        """Clusters that meet across the left and right border."""
        return T.seam_partners(self.feats, self.labelled, self.cfg)

    @cached_property
    def joined_tracks(self) -> DataFrame:
        """The tracking table after partners across the border share uid, iuid and status."""
        return T.share_identity(self.tracks, self.partners)

    def table(self, columns: tuple[str, ...] | None = None, file_pattern: str = "yyyyMMdd_HHmmss'.parquet'") -> DataFrame:
        """The whole tracking table: pixel lists, outline, speed and direction, previous ids and border marks besides ``tracks``.

        ``columns`` picks some; a name that ends in ``*`` stands for every column that begins so. Clusters of a frame and
        level are numbered from 1 in order of their labels in ``cluster_id``; ``file`` is the frame's time by ``file_pattern``.
        """
        t = self.joined_tracks if self.cfg.edges else self.tracks.withColumn("board", F.lit(False))
        u, v = F.col("u_"), F.col("v_")
        t = t.join(self.previous, T.KEY, "left").join(T.pixel_arrays(self.labelled), T.KEY).join(self.outlines().select(*T.KEY, "geometry"), T.KEY)
        t = t.withColumns({
            "cluster_id": F.row_number().over(Window.partitionBy("frame", "level").orderBy("label")).cast("bigint"),
            "file": F.date_format("ts", file_pattern), "speed": ph.magnitude(u, v), "dir": ph.angle(u, v),
        })
        return t if columns is None else t.select(*wildcards(t, columns))

    def outlines(self) -> DataFrame:
        return outline.outlines(T.pixel_arrays(self.labelled), self.cfg.grid)

    def run(self, root: str, feat_ext: bool = True, spat_ope: bool = True, clst_lnk: bool = True, concat: bool = True, duration: bool = True, clean: bool = False) -> dict[str, str]:
        """Write the stages that are switched on below ``root``; where each lies. ``clean`` clears the folder first.

        Every stage is computed from the one before whether or not that is written. The tracking table goes by mode and day.
        """
        spark = self.cells.sparkSession
        if clean:
            catalog.clear(spark, root)
        done = {}
        for name, wanted, stage in (("features", feat_ext, lambda: self.feats), ("spatial", spat_ope, lambda: self.ev.join(self.vecs.drop("status"), T.KEY)), ("linked", clst_lnk, lambda: self.links.join(self.previous, T.KEY, "left")), ("durations", duration, self.durations)):
            if wanted:
                done[name] = f"{root}/{name}"
                stage().write.mode("overwrite").parquet(done[name])
        if concat:
            done["tracks"] = f"{root}/tracks"
            catalog.store(self.table(), done["tracks"], "track")
        return done

    def durations(self) -> DataFrame:
        """``(iuid, first_ts, last_ts, duration)`` in whole minutes."""
        d = self.tracks.groupBy(F.coalesce("iuid", F.col("uid").cast("double")).alias("iuid")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        return d.withColumn("duration", F.timestamp_diff("MINUTE", F.col("first_ts"), F.col("last_ts")))

    def forecast(self, window: int, leads: int) -> DataFrame:
        last = self.frames.agg(F.max("frame")).first()[0]
        return fc.forecast(self.tracks, self.labelled, last, window, leads, self.cfg)
