"""Operator 12 against brute force: ties, repeated rows, several lengths, large weights, nulls."""

import math
import random

import pytest

from quarry.llm import topk


def brute(rows, k, every=50):
    ok = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in ok]
    out = []
    for q, (i, a) in enumerate(ok):
        if i is not None and i % every == 0:
            got = sorted(((-sum(x * y for x, y in zip(a, b)), j is None, j or 0) for c, (j, b) in enumerate(ok) if c != q))  # noqa: B905
            out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(got[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k=5, **options):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, vector array<double>, row int, c string").repartition(3)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k, **options)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_top(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(rng.choice([6, 6, 6, 3, 0]))]) for i in range(-60, 340)]
    rows += [(50, rows[0][1]), (100, None), (150, [None, 1.0]), (200, [math.inf]), (250, [math.nan, 1.0]), (None, [1.0] * 6), (None, [1.0] * 6)]
    # Many alike, and several of one id.
    rows += [(500 + i % 7, [0.5] * 6) for i in range(100)] + [(700, [0.5] * 6)] * 3
    rng.shuffle(rows)
    assert found(spark, rows, 5, candidates_in_block=97, queries_in_block=3) == brute(rows, 5)
    assert found(spark, rows, 2, components_in_block=200) == brute(rows, 2)


def test_large_weights(spark):
    rows = [(50 * i, [x, -3.0]) for i, x in enumerate([1e6, 2e7, -5e6, 1.5, 3e6])]
    assert found(spark, rows) == brute(rows, 5)
    mixed = [(0, [2.0**45, 1.0]), (1, [2.0**-8, 2.0]), (2, [-(2.0**-8), 2.0**20]), (3, [1.0, -1.0])]
    assert found(spark, mixed) == brute(mixed, 5)


def test_empty(spark):
    assert found(spark, [(1, [1.0])]) == []
    assert found(spark, [(0, [1.0])]) == []
    df = spark.createDataFrame([], "vec_id long, vector array<float>")
    assert topk.top_k(df, df).count() == 0


def test_bounds():
    """What a cell selects is bounded by k, whatever is tied."""
    import numpy as np

    assert topk.best(np.zeros(1000, np.int32), 6).tolist() == list(range(6))
    assert sorted(topk.best(np.array([3, 9, 9, 1, 9]), 2).tolist()) == [1, 2]
