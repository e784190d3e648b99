"""Pairwise matches into groups.

Vertices of degree one are stripped and chains of degree-two vertices compressed by list
ranking (pointer doubling on arcs), again and again, each removed vertex remembering where it hangs.
The core that is left is solved by alternating stars, then labels are restored to the removed
vertices in reverse order. Every step is an equi-join or an aggregate with partial sums, so hubs
cost a skew-joined partition and never a collected group. Each step's table is cut to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celltrack.runtime import cut, drop

WORTHWHILE = 0.3  # stripping goes on while a round removes this share of the vertices


def _simple(edges: DataFrame) -> DataFrame:
    """Distinct edges a < b; nulls and loops go."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*")


def rank_chains(arcs: DataFrame) -> DataFrame:
    """List ranking: follow every arc to where its chain ends.

    ``arcs(v, w, fin, end, core, nv, nw, low)``: heading from v to w, with the following arc nv -> nw
    where not ``fin``. Each doubling joins arcs to the arcs they point at. A closed ring never
    ends; there ``low`` becomes its smallest vertex, and doubling stops once nothing finishes or sinks.
    """
    arcs = cut(arcs)
    state = None
    while True:
        now = arcs.agg(F.count(F.when(~F.col("fin"), 1)), F.sum(F.when(~F.col("fin"), F.col("low").cast("decimal(38,0)")))).first()
        if not now[0] or state == tuple(now):
            return arcs
        state = tuple(now)
        a = arcs.filter("NOT fin").select("v", "w", "nv", "nw", "low")
        b = arcs.select(F.col("v").alias("nv"), F.col("w").alias("nw"), "fin", "end", "core", F.col("nv").alias("nv2"), F.col("nw").alias("nw2"), F.col("low").alias("low2"))
        on = a.join(b, ["nv", "nw"]).select("v", "w", "fin", "end", "core", F.col("nv2").alias("nv"), F.col("nw2").alias("nw"), F.least("low", "low2").alias("low"))
        before, arcs = arcs, cut(arcs.filter("fin").unionByName(on))
        drop(before)


def reduce_once(edges: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Remove all vertices of degree one and two: ``(edges left, removed(v, p), removed, vertices)``."""
    adj = _both_ways(edges)
    degree = adj.groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.min("w").alias("w0"), F.max("w").alias("w1"))
    degree = cut(degree)
    seen = degree.agg(F.count(F.lit(1)), F.count(F.when(F.col("d") <= 2, 1))).first()
    low = degree.filter("d <= 2")
    arcs = low.select("v", F.explode(F.array_distinct(F.array("w0", "w1"))).alias("w"))
    ahead = degree.select(F.col("v").alias("w"), F.col("d").alias("dw"), F.col("w0").alias("x0"), F.col("w1").alias("x1"))
    arcs = arcs.join(ahead, "w").select(
        "v", "w", (F.col("dw") != 2).alias("fin"), F.col("w").alias("end"), (F.col("dw") > 2).alias("core"),
        F.col("w").alias("nv"), F.when(F.col("x0") == F.col("v"), F.col("x1")).otherwise(F.col("x0")).alias("nw"),
        F.least("v", "w").alias("low"),
    )
    ranked = rank_chains(arcs)
    core_end = F.when(F.col("fin") & F.col("core"), F.col("end"))
    leaf_end = F.when(F.col("fin") & ~F.col("core"), F.col("end"))
    of = ranked.groupBy("v").agg(
        F.min(core_end).alias("c0"), F.max(core_end).alias("c1"), F.min(leaf_end).alias("l0"), F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.min("fin").alias("fin")
    )
    # without a core end the whole component is a path (its smaller leaf leads) or a ring (its smallest vertex)
    path = F.when(F.col("n") == 1, F.least("l0", "v")).otherwise(F.col("l0"))
    of = cut(of.withColumn("p", F.coalesce(F.col("c0"), F.when(F.col("fin"), path).otherwise(F.col("low")))))
    gone = degree.filter("d <= 2").select(F.col("v").alias("x"))
    bridged = of.filter("c0 < c1").select(F.col("c0").alias("a"), F.col("c1").alias("b"))
    kept = edges.join(gone.withColumnRenamed("x", "a"), "a", "left_anti").join(gone.withColumnRenamed("x", "b"), "b", "left_anti")
    left = cut(_simple(kept.select("a", "b").unionByName(bridged)))
    drop(degree)
    drop(ranked)
    return left, of.select("v", "p"), seen[1], seen[0]


def solve_core(edges: DataFrame) -> DataFrame:
    """``(v, p)``: every vertex with its component's smallest, by alternating large and small stars."""
    state = None
    while True:
        adj = _both_ways(edges)
        small = adj.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("m"))
        large = adj.join(small, "v").filter("w > v").select(F.col("w").alias("a"), F.col("m").alias("b"))
        edges = _simple(large)
        down = edges.groupBy("b").agg(F.min("a").alias("m"))
        linked = edges.join(down, "b").select("a", "b", "m")
        before, edges = edges, cut(_simple(linked.select("a", F.col("m").alias("b")).unionByName(linked.select(F.col("b").alias("a"), F.col("m").alias("b")))))
        drop(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("v"), F.col("a").alias("p")).unionByName(edges.select(F.col("a").alias("v"), F.col("a").alias("p"))).distinct()


def groups(edges: DataFrame, worthwhile: float = WORTHWHILE) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges(a, b)``; equal roots are linked directly or indirectly.

    Null ends, loops and repeated pairs are allowed and change nothing, though a vertex that occurs only in
    loops or beside a null has no row. No edges give no rows. Stripping goes on while a round removes a share of
    ``worthwhile`` of the vertices (0: to the end); what is left is the core. The groups do not depend on it. The root is some vertex of the group.
    """
    left = cut(_simple(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))))
    removed: list[DataFrame] = []
    while not left.isEmpty():
        before = left
        left, gone, n_gone, n = reduce_once(before)
        drop(before)
        removed.append(gone)
        if n_gone < worthwhile * n or not n_gone:
            break
    labels = solve_core(left) if not left.isEmpty() else left.select(F.col("a").alias("v"), F.col("b").alias("p"))
    labels = labels.select("v", F.col("p").alias("root"))
    for gone in reversed(removed):
        up = labels.select(F.col("v").alias("p"), "root")
        hung = gone.join(up, "p", "left").select("v", F.coalesce("root", "p").alias("root"))
        alone = hung.select(F.col("root").alias("v")).distinct().join(labels.select("v"), "v", "left_anti").join(gone.select("v"), "v", "left_anti")
        before, labels = labels, cut(labels.unionByName(hung).unionByName(alone.select("v", F.col("v").alias("root"))))
        drop(before)
    return labels


def _id(c: Column) -> Column:
    """A usable positive whole id, else null."""
    d = c.cast("double")
    return F.when((d > 0) & ~F.isnan(d) & (d < 4e18), c.cast("bigint"))


def record_groups(linked: DataFrame, spatial: DataFrame) -> DataFrame:
    """``(group_id, cindex)``: each distinct cindex of ``linked`` with the smallest cindex tied to it.

    Tied are rows of equal uid, a row and the row its past_idx names one frame before, and a row and all
    rows of the uids in its prv lists; an id no row carries ties those that name it. Ids are below 2**62. Rows without
    cindex have no row of their own but tie what they name. Null, zero, negative and NaN ids are none.
    """
    uid_node = lambda c: _id(c) * 2 + 1
    rows = linked.select(
        F.col("cindex").cast("bigint").alias("cindex"), "frame", "cidx", uid_node(F.col("uid")).alias("u"),
        F.array_distinct(F.array_compact(F.transform(F.concat(F.coalesce("prv_mrg_uids", F.array().cast("array<bigint>")), F.array(_id(F.col("prv_spl_uid")))), lambda x: uid_node(x)))).alias("named"),
    )
    own = F.coalesce("u", F.col("cindex") * 2, F.get("named", F.lit(0)))
    rows = rows.withColumn("anchor", own).filter("anchor IS NOT NULL")
    named = rows.filter(F.size("named") > 0).select(F.col("anchor").alias("a"), F.explode("named").alias("b"))
    ident = rows.filter("cindex IS NOT NULL").groupBy("cindex").agg(F.min("anchor").alias("anchor"), F.max("anchor").alias("other"))
    ident = cut(ident)
    # a cindex stored under several uids ties them all, through its own vertex
    several = ident.filter("anchor <> other").select("cindex")
    torn = rows.join(several, "cindex", "left_semi").select((F.col("cindex") * 2).alias("a"), F.col("anchor").alias("b"))
    at = rows.select("frame", "cidx", "anchor").filter("frame IS NOT NULL AND cidx IS NOT NULL")
    steps = spatial.select("frame", "cidx", "past_idx").filter("frame IS NOT NULL AND cidx IS NOT NULL AND past_idx IS NOT NULL")
    now = steps.join(at, ["frame", "cidx"]).select((F.col("frame") - 1).alias("frame"), F.col("past_idx").alias("cidx"), F.col("anchor").alias("a"))
    past = now.join(at, ["frame", "cidx"]).select("a", F.col("anchor").alias("b"))
    labels = groups(reduce(DataFrame.unionByName, [named, torn, past]))
    first = ident.groupBy("anchor").agg(F.min("cindex").alias("m"))
    placed = cut(first.join(labels.withColumnRenamed("v", "anchor"), "anchor", "left").select("anchor", "m", F.coalesce("root", "anchor").alias("root")))
    least = placed.groupBy("root").agg(F.min("m").alias("group_id"))
    final = placed.join(least, "root").select("anchor", "group_id")
    return ident.select("cindex", "anchor").join(final, "anchor").select("group_id", "cindex")
