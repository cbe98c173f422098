"""Orchard search against measuring all centroids; odd vectors."""

import hashlib
import math

import numpy as np
import pytest

from tallyward.llm import centroids


def plain(rows, size=64, k=40, rounds=5):
    """The same clustering, every distance measured in Python integers."""
    kept = [(key, [math.floor(256 * x) for x in v]) for key, v in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted((hashlib.sha256(f"2:{'' if key is None else key}".encode()).hexdigest(), v) for key, v in kept)
    centres = [v for _, v in drawn[:k]]

    def apart(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return [min((apart(v, c), i) for i, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        where = [i for _, i in nearest()]
        for c in range(len(centres)):
            mine = [v for (_, v), i in zip(kept, where, strict=True) if i == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(key, i, d, hashlib.sha256(",".join(map(str, centres[i])).encode()).hexdigest()) for (key, _), (d, i) in zip(kept, nearest(), strict=True)]


def held_against(spark, rows, kind="array<double>", **how):
    got = centroids.clustered(spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}"), **how).collect()
    want = plain(rows, **how)
    assert sorted([(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got], key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.inertia == sum(w[2] for w in want)
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
    return got


def test_ties_and_repeated_vectors(spark):
    # vectors on a small grid make many equal distances and equal centroids
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(-2, 3, 3) / 256).tolist()) for i in range(300)] + [(5, [0.0, 0.0, 0.0])] * 3 + [(None, [1.0, 2.0, 3.0])]
    held_against(spark, rows, size=3, k=12, rounds=4)


def test_odd_vectors_are_left_out(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [-0.001, 3.5])]
    got = held_against(spark, rows, size=2, k=40, rounds=2)
    assert {r.vec_id for r in got} == {1, 8}
    clash = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' as cluster", "1 as distance", "2 as _key")
    assert centroids.clustered(clash, size=2).count() == 2


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert centroids.clustered(empty).collect() == []


def test_large_components_are_exact(spark):
    rows = [(1, [2.0**40, 0.0]), (2, [2.0**40, 1 / 256]), (3, [-(2.0**40), 0.0]), (4, [-(2.0**40), 2.0])]
    got = held_against(spark, rows, size=2, k=2, rounds=3)
    assert len(got) == 4
    with pytest.raises(Exception, match="64 bits"):
        centroids.clustered(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), size=2, k=1, rounds=0).collect()


def test_search_measures_less_and_finds_the_same():
    rng = np.random.default_rng(3)
    middles = rng.integers(-2000, 2000, (40, 8))
    points = middles[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 8))
    best, near, measured = centroids.orchard(points, middles, centroids.neighbour_lists(middles))
    gaps = ((points[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (best == gaps.argmin(axis=1)).all() and (near == gaps.min(axis=1)).all()
    assert measured < gaps.size / 2
