"""Parent-child links to full hierarchies, with several parents and cycles.

Nodes without a parent or a child are peeled off and chains contracted, round by round, which leaves the cyclic core.
Each node's largest parent is its tree parent; in a cycle that such links close inside the core the smallest node leads
and has none, so the tree links form a forest. All other links are cross links, and every cycle runs through one. The
forest is laid out as Euler tours ranked by pointer doubling. A node's interval of
ranks gives its root, depth and subtree; intervals are cut into blocks of fixed length and joined
block by block, which lists ancestors without a range join and without gathering a tree. Cross links
are then closed over those intervals by doubling, which also exposes the nodes that descend from themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celltrack.runtime import cut, drop, scratch

BLOCK = 64
PEELS = 2
PIECES = 256  # parts into which one parent's children are cut


def _valid(c: Column) -> Column:
    d = c.cast("double")
    return F.when((d > 0) & ~F.isnan(d) & (d < 4e18), c.cast("bigint"))


def parent_links(linked: DataFrame) -> DataFrame:
    """Distinct ``(p, c)``: the uids a uid came from.

    Null, zero, negative and NaN ids and the uid itself are no parents; rows without a usable uid make no link.
    """
    named = F.concat(F.coalesce("prv_mrg_uids", F.array().cast("array<bigint>")), F.array(_valid(F.col("prv_spl_uid"))))
    return (
        linked.filter(F.col("prv_mrg_uids").isNotNull() | F.col("prv_spl_uid").isNotNull())
        .select(_valid(F.col("uid")).alias("c"), F.explode(named).alias("p"))
        .select(_valid(F.col("p")).alias("p"), "c")
        .filter("p IS NOT NULL AND c IS NOT NULL AND p <> c")
        .distinct()
    )


def usable_uids(linked: DataFrame) -> DataFrame:
    """Distinct ``v``: every uid that a row of linked carries, with or without a link."""
    return linked.select(_valid(F.col("uid")).alias("v")).filter("v IS NOT NULL").distinct()


def rank_list(arcs: DataFrame) -> DataFrame:
    """``(id, nxt, dist, last)`` with every ``dist`` the number of steps to the list's end, by doubling."""
    arcs = cut(arcs)
    while not arcs.filter("nxt IS NOT NULL").isEmpty():
        a = arcs.filter("nxt IS NOT NULL").select("id", F.col("nxt").alias("k"), "dist")
        b = arcs.select(F.col("id").alias("k"), "nxt", F.col("dist").alias("more"), "last")
        onward = a.join(b, "k").select("id", "nxt", (F.col("dist") + F.col("more")).alias("dist"), "last")
        before, arcs = arcs, cut(arcs.filter("nxt IS NULL").unionByName(onward))
        drop(before)
    return arcs


def _ends(links: DataFrame) -> DataFrame:
    """``(v, parents, children, p, c)`` of every node of ``links(p, c)``; p and c are its only parent and child where it has one."""
    both = links.select(F.explode(F.array(
        F.struct(F.col("p").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"), F.lit(None).cast("bigint").alias("p"), F.col("c").alias("c")),
        F.struct(F.col("c").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down"), F.col("p").alias("p"), F.lit(None).cast("bigint").alias("c")),
    )).alias("e")).select("e.*")
    return both.groupBy("v").agg(F.sum("up").alias("parents"), F.sum("down").alias("children"), F.max("p").alias("p"), F.max("c").alias("c"))


def _hop(at: DataFrame) -> DataFrame:
    """Chains' pointers doubled, up and down."""
    on = at.join(at.select(F.col("v").alias("b"), F.col("b").alias("b2"), F.col("down").alias("d2")), "b", "left")
    on = on.join(at.select(F.col("v").alias("a"), F.col("a").alias("a2"), F.col("up").alias("u2")), "a", "left")
    return on.select(
        "v", F.when(F.col("up"), F.col("a2")).otherwise(F.col("a")).alias("a"), (F.col("up") & F.col("u2")).alias("up"),
        F.when(F.col("down"), F.col("b2")).otherwise(F.col("b")).alias("b"), (F.col("down") & F.col("d2")).alias("down"),
    )


def _contract(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of nodes with one parent and one child made single links: ``(links, inner(v, a, b))`` with the ends a and b of v's chain.

    The ends are found by list ranking, downwards and upwards at once; what never ends is a ring, and its nodes are their own ends.
    """
    mid = cut(_ends(links).filter("parents = 1 AND children = 1 AND p <> v").select("v", "p", "c"))
    n = mid.count()
    if not n:
        return links, mid.select("v", F.col("p").alias("a"), F.col("c").alias("b"))
    inner = mid.select("v", F.lit(True).alias("m"))
    below = mid.join(inner.withColumnsRenamed({"v": "c", "m": "mc"}), "c", "left").join(inner.withColumnsRenamed({"v": "p", "m": "mp"}), "p", "left")
    at = cut(below.select("v", F.col("p").alias("a"), F.col("mp").isNotNull().alias("up"), F.col("c").alias("b"), F.col("mc").isNotNull().alias("down")))
    for _ in range(n.bit_length()):
        if at.filter("up OR down").isEmpty():
            break
        before, at = at, cut(_hop(at))
        drop(before)
    ring = at.filter("up AND down").select("v", F.col("v").alias("a"), F.col("v").alias("b"))
    chain = at.filter("NOT up").select("v", "a", "b")
    gone = mid.select("v")
    left = links.join(gone.withColumnRenamed("v", "p"), "p", "left_anti").join(gone.withColumnRenamed("v", "c"), "c", "left_anti")
    out = cut(left.select("p", "c").unionByName(chain.select(F.col("a").alias("p"), F.col("b").alias("c"))).distinct())
    return out, cut(chain.unionByName(ring))


def cyclic_core(links: DataFrame) -> DataFrame:
    """``v``: the nodes that peeling leaves, which are all nodes on cycles and those on ways from one cycle to another.

    Nodes without a parent or without a child are peeled off ``PEELS`` times, then chains contracted, until neither is
    left; chains between nodes of the core are put back.
    """
    live = cut(links.select("p", "c"))
    chains: list[DataFrame] = []
    size = live.count()
    while size:
        peeled = live
        for _ in range(PEELS):
            peeled = peeled.join(peeled.select(F.col("c").alias("p")), "p", "left_semi").join(peeled.select(F.col("p").alias("c")), "c", "left_semi")
        peeled = cut(peeled.select("p", "c"))
        drop(live)
        short, inner = _contract(peeled)
        chains.append(inner)
        live, now = short, short.count()
        if now == size:
            break
        size = now
    core = live.select(F.explode(F.array("p", "c")).alias("v")).distinct()
    for inner in reversed(chains):
        both = inner.join(core.withColumnRenamed("v", "a"), "a", "left_semi").join(core.withColumnRenamed("v", "b"), "b", "left_semi")
        core = cut(core.unionByName(both.select("v")).unionByName(inner.filter("a = v").select("v")).distinct())
    return core


def tree_parents(links: DataFrame) -> DataFrame:
    """``(c, p)``: each node's largest parent, so that the links chosen form a forest.

    Links chosen so can close a cycle only inside the cyclic core. Each such cycle's smallest node leads it and has no
    parent; the cycles are found by pointer doubling over the core.
    """
    best = cut(links.groupBy("c").agg(F.max("p").alias("p")))
    core = cyclic_core(links)
    walk = cut(best.join(core.withColumnRenamed("v", "c"), "c", "left_semi").join(core.withColumnRenamed("v", "p"), "p", "left_semi").select(F.col("c").alias("v"), F.col("p").alias("at"), F.least("c", "p").alias("low")))
    for _ in range(walk.count().bit_length()):
        on = walk.select(F.col("v").alias("at"), F.col("at").alias("further"), F.col("low").alias("lower"))
        before, walk = walk, cut(walk.join(on, "at").select("v", F.col("further").alias("at"), F.least("low", "lower").alias("low")))
        drop(before)  # ways that end are gone, the others have reached their cycle
    leaders = walk.filter("v = low").join(walk.select(F.col("at").alias("v")).distinct(), "v", "left_semi").select(F.col("v").alias("c"))
    return best.join(leaders, "c", "left_anti")


def siblings(links: DataFrame, pieces: int = PIECES) -> tuple[DataFrame, DataFrame]:
    """``(v, p, sib)`` and ``(v, child)``: each child's next sibling and each parent's first child.

    A parent's children are strung together in pieces by hash, then the pieces, so that no task holds one parent's children.
    """
    cut_up = links.withColumn("piece", F.pmod(F.xxhash64("v"), F.lit(pieces)))
    inside = cut_up.withColumn("sib", F.lead("v").over(Window.partitionBy("p", "piece").orderBy("v")))
    heads = cut_up.groupBy("p", "piece").agg(F.min("v").alias("head"), F.max("v").alias("tail"))
    row = Window.partitionBy("p").orderBy("piece")  # at most ``pieces`` rows for each parent
    heads = heads.select("p", "head", F.col("tail").alias("v"), F.lead("head").over(row).alias("next"), F.row_number().over(row).alias("k"))
    strung = inside.join(heads.filter("next IS NOT NULL").select("p", "v", "next"), ["p", "v"], "left")
    return strung.select("v", "p", F.coalesce("sib", "next").alias("sib")), heads.filter("k = 1").select(F.col("p").alias("v"), F.col("head").alias("child"))


def euler_intervals(forest: DataFrame) -> DataFrame:
    """``(v, p, root, high, low)`` of ``forest(v, p)``: a's subtree holds d iff a.low <= d.low and d.high <= a.high.

    Ranks count down to the end of the tree's tour. Every p must be a v; roots have null p.
    """
    sib, first = siblings(forest.filter("p IS NOT NULL"))
    at = sib.unionByName(forest.filter("p IS NULL").withColumn("sib", F.lit(None).cast("bigint"))).join(first, "v", "left")
    down, up = F.col("v") * 2, F.col("v") * 2 + 1
    arcs = at.select(
        F.explode(
            F.array(
                F.struct(down.alias("id"), F.coalesce(F.col("child") * 2, up).alias("nxt")),
                F.struct(up.alias("id"), F.coalesce(F.col("sib") * 2, F.col("p") * 2 + 1).alias("nxt")),
            )
        ).alias("a")
    ).select("a.id", "a.nxt", F.when(F.col("a.nxt").isNotNull(), 1).otherwise(0).cast("bigint").alias("dist"), F.when(F.col("a.nxt").isNull(), F.col("a.id")).alias("last"))
    ranked = rank_list(arcs)
    both = ranked.groupBy(F.shiftright("id", 1).alias("v")).agg(F.max("dist").alias("high"), F.min("dist").alias("low"), F.shiftright(F.max("last"), 1).alias("root"))
    return forest.join(both, "v").select("v", "p", "root", "high", "low")


def interval_pairs(nodes: DataFrame) -> DataFrame:
    """``(a, d)``: proper ancestors by interval containment, joined within blocks of ranks."""
    block = lambda c: F.floor(c / BLOCK)
    above = nodes.filter("high > low + 1").select(
        F.col("v").alias("a"), "root", F.col("high").alias("ah"), F.col("low").alias("al"), F.explode(F.sequence(block(F.col("low")), block(F.col("high")))).alias("block")
    )
    below = nodes.filter("p IS NOT NULL").select(F.col("v").alias("d"), "root", "high", block(F.col("high")).alias("block"))
    return above.join(below, ["root", "block"]).filter("al < high AND high < ah").select("a", "d")


class Hierarchy:
    """The forest, its intervals and the cross links of one set of ``links(p, c)``.

    ``uids(v)`` names further nodes; those without a link are their own roots.
    """

    def __init__(self, links: DataFrame, uids: DataFrame | None = None):
        with scratch() as keep:
            links = cut(links.select(F.col("p").cast("bigint").alias("p"), F.col("c").cast("bigint").alias("c")).filter("p <> c").distinct())
            best = cut(tree_parents(links))
            nodes = links.select(F.explode(F.array("p", "c")).alias("v"))
            nodes = (nodes if uids is None else nodes.unionByName(uids.select(F.col("v").cast("bigint").alias("v")))).distinct()
            forest = cut(nodes.join(best.withColumnRenamed("c", "v"), "v", "left").select("v", "p"))
            self.nodes = cut(euler_intervals(forest))
            self.tree = cut(interval_pairs(self.nodes))
            self.cross = cut(links.join(best, ["p", "c"], "left_anti"))
            keep(self.nodes, self.tree, self.cross)

    def _cross_pairs(self) -> DataFrame:
        """Pairs that need at least one cross link."""
        selfs = self.cross.select(F.explode(F.array("p", "c")).alias("a")).distinct().select("a", F.col("a").alias("d"))
        under = self.tree.unionByName(selfs)
        link = self.cross.select(F.xxhash64("p", "c").alias("e"), "p", "c")
        step = link.select("e", F.col("c").alias("a")).join(under, "a").join(link.select(F.col("e").alias("f"), F.col("p").alias("d")), "d").select("e", "f")
        reach = cut(step.unionByName(link.select("e", F.col("e").alias("f"))).distinct())
        size = reach.count()
        while size:
            wider = reach.join(reach.select(F.col("e").alias("f"), F.col("f").alias("g")), "f").select("e", F.col("g").alias("f")).distinct()
            before, reach = reach, cut(wider)
            drop(before)
            now = reach.count()
            if now == size:
                break
            size = now
        out = reach.join(link.select(F.col("e").alias("f"), F.col("c").alias("a")), "f").join(under, "a").select("e", F.col("d").alias("u")).distinct()
        into = link.select("e", F.col("p").alias("d")).join(under, "d").select("e", F.col("a").alias("ancestor"))
        return into.join(out, "e").select("ancestor", F.col("u").alias("uid")).distinct()

    def pairs(self) -> DataFrame:
        """``(ancestor_uid, uid)``: uid is reached from ancestor_uid over one or more links."""
        tree = self.tree.select(F.col("a").alias("ancestor_uid"), F.col("d").alias("uid"))
        cross = self._cross_pairs().withColumnRenamed("ancestor", "ancestor_uid")
        return tree.unionByName(cross).distinct()

    def report(self) -> DataFrame:
        """``(uid, parent_uid, root_uid, depth, path, n_tree, n_ancestors, n_descendants, in_cycle)`` for every uid named by a link or in ``uids``.

        Path, depth and root follow the tree parent, the largest parent of a uid; a uid without any parent is a root, and so
        is the smallest uid of a cycle that these links close. The path is root/.../uid. The counts of ancestors and
        descendants are over all links; in_cycle marks uids that descend from themselves.
        """
        up = self.tree.join(self.nodes.select(F.col("v").alias("a"), F.col("high").alias("h")), "a")
        lines = up.groupBy(F.col("d").alias("v")).agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "a")), asc=False), lambda s: s["a"]).alias("line"))
        pairs = cut(self.pairs())
        anc = pairs.groupBy(F.col("uid").alias("v")).agg(F.count(F.lit(1)).alias("n_ancestors"), F.max(F.col("uid") == F.col("ancestor_uid")).alias("cyc"))
        desc = pairs.groupBy(F.col("ancestor_uid").alias("v")).agg(F.count(F.lit(1)).alias("n_descendants"))
        every = self.nodes.join(lines, "v", "left").join(anc, "v", "left").join(desc, "v", "left")
        line = F.coalesce("line", F.array().cast("array<bigint>"))
        return every.select(
            F.col("v").alias("uid"), F.col("p").alias("parent_uid"), F.col("root").alias("root_uid"), F.size(line).cast("bigint").alias("depth"),
            F.array_join(F.concat(line, F.array("v")).cast("array<string>"), "/").alias("path"),
            ((F.col("high") - F.col("low") - 1) / 2).cast("bigint").alias("n_tree"),
            F.coalesce("n_ancestors", F.lit(0)).alias("n_ancestors"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"),
            F.coalesce("cyc", F.lit(False)).alias("in_cycle"),
        )
