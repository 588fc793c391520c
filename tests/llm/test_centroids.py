"""Centroid clustering against plain Python integers."""

import hashlib
import math

import numpy as np
import pytest

from gleaner.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance int, n long"
WIDE = "vec_id long, embedding array<double>"


def brute(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) if abs(x) < 1e300 else int(x) * 64 for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cent = [v for _, v in first[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cent))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        cent = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(cent)]
    done = [(i, *nearest(v)) for i, v in kept]
    sums = {}
    for _, d, k in done:
        sums[k] = sums.get(k, 0) + d
    total = sum(sums.values())
    return sorted(((i, k, d, sums[k], total, hashlib.sha256(",".join(map(str, cent[k])).encode()).hexdigest()) for i, d, k in done), key=repr)


def got_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (20, 64))
    return [(i * 3, [float(np.float32(x)) for x in middles[i % 20] + rng.normal(0, 0.4, 64)]) for i in range(n)]


def test_clusters_against_brute_force(spark):
    v = vectors(300)
    rows = v + v[:5] + [(None, v[7][1]), (9001, None), (9002, [0.5] * 63), (9003, [0.5] * 65), (9004, [None] + [0.5] * 63),
                        (9005, [float("nan")] + [0.5] * 63), (9006, [float("-inf")] + [0.5] * 63), (9007, []), (9008, [-0.0] * 64)]
    df = spark.createDataFrame([(*r, 1, "c", 2, 3) for r in rows], SCHEMA).repartition(5)
    assert got_of(C.cluster(df)) == brute(rows)
    assert C.cluster(df.limit(0)).count() == 0
    assert got_of(C.cluster(df.where("vec_id < 20"))) == brute([r for r in rows if r[0] is not None and r[0] < 20])


def test_one_vector_many_times_and_ties(spark):
    rows = [(i, [1.0] * 64) for i in range(200)] + [(500 + i, [float(i % 2)] * 64) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got_of(C.cluster(df)) == brute(rows)
    same = [(7, [0.25] * 64)] * 50 + [(8, [0.5] * 64)] * 3
    assert got_of(C.cluster(spark.createDataFrame(same, "vec_id long, embedding array<float>"))) == brute(same)


def test_large_components_stay_exact(spark):
    """Beyond 2^27 the tables hold Python integers; distances beyond 64 bits are null."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in (rng.normal(0, 3e6), *rng.normal(0, 1e4, 63))]) for i in range(60)]
    assert max(abs(64 * r[1][0]) for r in rows) > C.SAFE
    assert got_of(C.cluster(spark.createDataFrame(rows, WIDE))) == brute(rows)
    rows += [(1000 + i, [float(x) for x in rng.normal(0, 1e30, 64)]) for i in range(30)]
    want = [(i, k, d if d <= C.MOST else None, s if s <= C.MOST else None, None, h) for i, k, d, s, _, h in brute(rows)]
    assert got_of(C.cluster(spark.createDataFrame(rows, WIDE))) == sorted(want, key=repr)


@pytest.mark.parametrize("x", [0, 5, -1, 2**40, -2**40, -2**40 - 1, 2**90 + 3, -2**100 + 7])
def test_limbs(x):
    assert sum(p << (C.LIMB * k) for k, p in C.limbs(x)) == x
    assert all(abs(p) <= 1 << C.LIMB for _, p in C.limbs(x))


def test_short_list_widens(spark, monkeypatch):
    monkeypatch.setattr(C, "SHORTLIST", 1)
    rows = vectors(400, 5)
    assert got_of(C.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == brute(rows)
