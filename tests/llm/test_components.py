import random
from collections import defaultdict

import pytest

from celltrack.llm import components as C


def union_find(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


def classes(labels):
    out = defaultdict(set)
    for v, r in labels.items():
        out[r].add(v)
    return sorted(map(sorted, out.values()))


def shapes(rng):
    base, out = 0, []
    for _ in range(14):
        n = rng.randint(2, 24)
        v = list(range(base, base + n))
        base += n
        rng.shuffle(v)
        kind = rng.choice(["path", "ring", "tree", "dense", "star", "ladder", "tailed"])
        out += {
            "path": list(zip(v, v[1:])),
            "ring": list(zip(v, v[1:] + v[:1])),
            "tree": [(v[i], v[rng.randrange(i)]) for i in range(1, n)],
            "dense": [(rng.choice(v), rng.choice(v)) for _ in range(3 * n)],
            "star": [(v[0], x) for x in v[1:]],
            "ladder": list(zip(v, v[1:])) + [(v[i], v[i + 3]) for i in range(0, n - 3, 2)],
            "tailed": list(zip(v, v[1:])) + [(v[0], v[n // 2])],
        }[kind]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_groups_match_union_find(spark, seed):
    edges = shapes(random.Random(seed))
    df = spark.createDataFrame(edges + edges[:9] + [(None, 1), (2, None), (3, 3)], "a bigint, b bigint").selectExpr("*", "'x' AS v", "1 AS w")
    got = {r.v: r.root for r in C.groups(df).collect()}
    assert classes(got) == classes(union_find([e for e in edges if e[0] != e[1]]))


@pytest.mark.parametrize("worthwhile", [0.0, 1.1])
def test_groups_do_not_depend_on_how_far_stripping_goes(spark, worthwhile):
    edges = shapes(random.Random(77))
    got = {r.v: r.root for r in C.groups(spark.createDataFrame(edges, "a bigint, b bigint"), worthwhile).collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert classes(got) == classes(want)


def test_nothing(spark):
    assert C.groups(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_record_groups(spark):
    li = spark.createDataFrame(
        [
            (1, 0, 10, 1, None, None), (2, 0, 11, 1, None, None), (2, 1, 12, 2, [1], None), (3, 0, 13, None, None, 77.0), (3, 1, 14, 5, [77, 0, -1, None], float("nan")),
            (4, 0, 15, 6, None, None), (5, 0, 16, 7, None, None), (9, 0, 17, None, None, -999.0), (9, 1, None, 8, [6], None), (9, 2, 18, 8, None, None), (1, 0, 10, 1, None, None),
        ],
        "frame int, cidx int, cindex bigint, uid bigint, prv_mrg_uids array<bigint>, prv_spl_uid double",
    ).selectExpr("*", "1 AS anchor", "2 AS root")
    sp = spark.createDataFrame([(5, 0, 0), (6, 0, 0), (4, 0, 9), (None, 0, 0)], "frame int, cidx int, past_idx int")
    got = {(r.group_id, r.cindex) for r in C.record_groups(li, sp).collect()}
    assert got == {(10, 10), (10, 11), (10, 12), (13, 13), (13, 14), (15, 15), (15, 16), (17, 17), (15, 18)}
    assert C.record_groups(li.limit(0), sp).count() == 0
    assert {(r.group_id, r.cindex) for r in C.record_groups(li, sp.limit(0)).collect()} >= {(16, 16), (15, 15)}
