"""Exact top-k search against brute force."""

import math
import random

import numpy as np
import pytest

from ledgerline.llm import topk

LONG = (1 << 63) - 1


def brute(rows, k, every=50):
    """rows: (id, vector). Per query row the k best other rows."""
    ints = []
    for i, v in rows:
        ok = v is not None and len(v) > 0 and all(x is not None and math.isfinite(256 * x) for x in v)
        ints.append((i, [math.floor(256 * x) for x in v] if ok else None))
    out = []
    for a, (i, v) in enumerate(ints):
        if v is None or i is None or i % every:
            continue
        found = [(-min(max(sum(x * y for x, y in zip(v, w)), -LONG - 1), LONG), j is None, j or 0, j) for b, (j, w) in enumerate(ints) if b != a and w is not None]
        out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def check(spark, rows, k=5, kind="double", **sizes):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, score int").repartition(3)
    got = topk.top_k(df, k, **sizes)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k)


@pytest.mark.parametrize("sizes", [{}, {"pairs": 300, "head": 6, "parallelism": 1}])
def test_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12))
    rows = [(int(i), (centres[i % 5] * rng.uniform(0.1, 2) + rng.normal(size=12) * 0.2).tolist()) for i in range(0, 4000, 5)]
    check(spark, rows, **sizes)


def test_odd_rows(spark):
    rng = random.Random(4)
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(0, 400, 10)]  # a group of copies, some of them queries
    rows += [(1000 + i, [rng.choice([0.0, -0.0, 0.5, -1.5, 1e-9]) for _ in range(3)]) for i in range(0, 60)]
    rows += [(50, None), (51, []), (100, [1.0, None, 2.0]), (150, [math.nan, 0.0, 0.0]), (200, [math.inf, 1.0, 1.0]), (250, [1e308, 1.0, 1.0])]
    rows += [(-50, [1.0, 2.0]), (-51, [3.0, 1.0, 2.0, 9.0]), (None, [2.0, 2.0, 2.0]), (None, [2.0, 2.0, 2.0]), (300, [0.0, 0.0, 0.0]), (300, [0.0, 1.0, 0.0]), (300, [0.0, 1.0, 0.0])]
    check(spark, rows)
    check(spark, rows, k=1)


def test_scores_of_large_numbers_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1, -1]) * rng.randrange(1 << 30) / 256 + rng.randrange(1 << 22) * 2.0**12 for _ in range(4)]) for i in range(0, 500, 25)]
    check(spark, rows)
    check(spark, [(0, [1e15, 1e12]), (1, [1e15, 1e12]), (50, [-1e15, 3.0]), (2, [1e200, -1e200])])


def test_few_rows_and_floats(spark):
    check(spark, [])
    check(spark, [(0, [1.0])])
    check(spark, [(0, [1.0]), (7, [0.1])])
    check(spark, [(i, [float(np.float32(x)) for x in (0.1 * i, -0.3, 0.7)]) for i in range(120)], kind="float")


def test_most_pairs_are_left_out():
    """Lengths and correlated components: the bounds spare most of the scoring, and lose nothing."""
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(size=(4000, 6)) @ rng.normal(size=(6, 32)) * rng.lognormal(size=(4000, 1)) + rng.normal(size=(4000, 32)))
    lengths = np.linalg.norm(x, axis=1)
    x = x[np.argsort(-lengths)]
    lengths = np.sort(lengths)[::-1]
    best = topk.Best(x[::50], np.full(80, -np.inf), topk.rotation_of(x.T @ x), 5)
    for a in range(0, 4000, 500):
        best.meet(x[a : a + 500], lengths[a : a + 500], np.arange(a, a + 500), np.arange(a, a + 500))
    q, s, _, v = best.found
    exact = x[::50] @ x.T
    for i in range(80):
        want = np.lexsort((np.arange(4000), -exact[i]))[:5]
        assert v[q == i].tolist() == want.tolist() and s[q == i].tolist() == exact[i][want].astype(int).tolist()
    assert best.scored - 80 * 500 < 80 * 3500 / 50 and best.met < 80 * 4000 / 2  # nothing is known before the first block
