"""Live frames: windows over an event stream, and clusters linked as frames arrive."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from celltrack.config import TrackConfig
from celltrack.operators.tracking import component_labels, passes


def window_counts(events: DataFrame, step: str = "12 hours", span: str = "48 hours", late: str = "1 hour") -> DataFrame:
    """``(start, cells, peak)`` of sliding windows with a watermark; works on a stream and on a table."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", span, step).alias("w"))
        .agg(F.count("value").alias("n_events"), F.max("value").alias("peak"))
        .select(F.col("w.start").alias("start"), "n_events", "peak")
    )


def link_stream(cells: DataFrame, cfg: TrackConfig, width: int) -> DataFrame:
    """``(source, level, frame, label, uid, size)`` of ``cells(source, frame, ts_min, y, x, value)``, frames in order within a source.

    State of a source and level: the pixels of its last closed frame by label, and the next uid: bounded by one frame. A
    frame is closed when a later one arrives; cells of closed frames are dropped. A row with null y and x is a frame
    without that cell: as ``end_marks`` it closes the last frame of an input that ends. Clusters are linked by the rules of
    ``events``; uids count up within a source and level.
    """
    out = "source string, level int, frame int, label bigint, uid bigint, size int"
    kept = "last int, last_min bigint, next_uid bigint, frame int, frame_min bigint, oy array<int>, ox array<int>, olabel array<bigint>, ouid array<bigint>, osize array<int>, ny array<int>, nx array<int>"
    least = {lv.level: max(cfg.floor_size, lv.min_size) for lv in cfg.levels}

    def close(s: dict, level: int) -> pd.DataFrame:
        y, x = pd.Series(s["ny"], dtype="int64"), pd.Series(s["nx"], dtype="int64")
        fresh: dict[tuple[int, int], tuple[int, int, int]] = {}
        rows = []
        if len(y):
            label = component_labels(y.to_numpy(), x.to_numpy(), cfg.radius, width)
            near = s["last"] is not None and s["frame_min"] - s["last_min"] <= cfg.delta_time + cfg.delta_tolerance
            old = dict(zip(zip(s["oy"], s["ox"]), s["olabel"])) if near else {}
            uids, sizes = dict(zip(s["olabel"], s["ouid"])), dict(zip(s["olabel"], s["osize"]))
            members = {int(k): list(g.index) for k, g in pd.Series(label).groupby(label) if len(g) >= least[level]}
            before: dict[int, list[int]] = {}  # cluster -> earlier clusters it overlaps enough
            after: dict[int, list[int]] = {}
            for k, idx in members.items():
                shared = Counter(old[at] for i in idx if (at := (int(y[i]), int(x[i]))) in old)
                before[k] = [p for p, n in shared.items() if 100.0 * n / sizes[p] >= cfg.min_overlap]
                for p in before[k]:
                    after.setdefault(p, []).append(k)
            major = {p: min(ks, key=lambda k: (-len(members[k]), k)) for p, ks in after.items()}
            for k in sorted(members):
                lost = any(major[p] != k for p in before[k])  # the smaller piece of a split
                led = any(major[p] == k and len(after[p]) > 1 for p in before[k])
                if before[k] and (not lost or led and len(before[k]) > 1):
                    uid = uids[min(before[k], key=lambda p: (-sizes[p], p))]
                else:
                    uid, s["next_uid"] = s["next_uid"], s["next_uid"] + 1
                rows.append((s["frame"], k, uid, len(members[k])))
                for i in members[k]:
                    fresh[int(y[i]), int(x[i])] = (k, uid, len(members[k]))
        parts = list(zip(*fresh.values())) or [(), (), ()]
        s.update(last=s["frame"], last_min=s["frame_min"], oy=[p[0] for p in fresh], ox=[p[1] for p in fresh], olabel=list(parts[0]), ouid=list(parts[1]), osize=list(parts[2]), ny=[], nx=[])
        return pd.DataFrame(rows, columns=["frame", "label", "uid", "size"])

    names = [c.split()[0] for c in kept.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(names, state.get)) if state.exists else dict(last=None, last_min=None, next_uid=cfg.initial_uid, frame=None, frame_min=None, oy=[], ox=[], olabel=[], ouid=[], osize=[], ny=[], nx=[])
        s = {k: list(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0) else v for k, v in s.items()}
        done = []
        rows = pd.concat(list(batches), ignore_index=True)
        for frame, part in rows.sort_values("frame", kind="stable").groupby("frame"):
            if s["frame"] is not None and frame < s["frame"] or s["last"] is not None and frame <= s["last"]:
                continue
            if s["frame"] is not None and frame > s["frame"]:
                done.append(close(s, int(key[1])))
            s["frame"], s["frame_min"] = int(frame), int(part["ts_min"].iat[0])
            part = part[part["hit"].astype(bool)].drop_duplicates(["y", "x"])
            have = set(zip(s["ny"], s["nx"]))
            for a, b in zip(part["y"].astype("int64").tolist(), part["x"].astype("int64").tolist()):
                if (a, b) not in have:
                    s["ny"].append(a), s["nx"].append(b)
        state.update(tuple(s[n] for n in names))
        for d in done:
            if len(d):
                yield d.assign(source=key[0], level=key[1])[["source", "level", "frame", "label", "uid", "size"]]

    # every level sees every frame, so that a frame without its cells still comes between two others
    hit = lambda lv: F.coalesce(passes(F.col("value"), cfg.operator, lv.threshold) & F.col("y").isNotNull() & F.col("x").isNotNull(), F.lit(False))
    each = F.explode(F.array(*(F.struct(F.lit(lv.level).alias("level"), hit(lv).alias("hit")) for lv in cfg.levels)))
    at_level = cells.select("source", "frame", "ts_min", "y", "x", each.alias("l")).select("source", "l.level", "frame", "ts_min", "y", "x", "l.hit")
    return at_level.groupBy("source", "level").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def end_marks(cells: DataFrame, step_min: int) -> DataFrame:
    """Rows like ``cells``, one for each source: an empty frame ``step_min`` minutes after its last, which closes that."""
    last = cells.groupBy("source").agg(F.max("frame").alias("f"), F.max("ts_min").alias("t"))
    mark = {"source": F.col("source"), "frame": (F.col("f") + 1).cast("int"), "ts_min": (F.col("t") + step_min).cast("bigint")}
    return last.select(*(mark.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in cells.schema))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over the input there is, its rows going to Parquet files, and read what it gave.

    In complete mode each batch replaces the files by the whole result.
    """
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").option("path", path)
    else:
        w = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    w.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
