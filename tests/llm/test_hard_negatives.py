"""Hard negatives against a plain search over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from doppel.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score int, chunk string, no long"
INF, NAN = float("inf"), float("nan")


def brute(rows, k=5, m=5, low=80, every=10):
    used = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in c) < 2**56:
            used.add((i, label, c))
    out = []
    for a in used:
        if a[0] % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in used if b != a and len(b[2]) == len(a[2])))
        for s, p, _ in [x for x in scored if x[2] == a[1]][:k]:
            fit = [x for x in scored if x[2] != a[1] and low * -s <= 100 * -x[0] <= 100 * -s][:m]
            out += [(a[0], p, r, x[1], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA)
    got = hn.hard_negatives(df, lambda i: i % 10 == 0, F.col("label"), **options).collect()
    want = brute(rows)
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got) == want
    return want


def vector(rng, n=20):
    return [rng.gauss(0, 0.2) for _ in range(n)]


def test_equals_all_pairs(spark, monkeypatch):
    """A hot label, groups of equal vectors with ties in score, near vectors, many chunks."""
    rng = random.Random(8)
    same, near = vector(rng), vector(rng)
    rows = [(i, same if i % 9 == 0 else [x + rng.gauss(0, 0.03) for x in near] if i % 4 == 0 else vector(rng), 1 if i % 3 == 0 else i % 5)
            for i in range(400)]
    rng.shuffle(rows)
    assert check(spark, rows, chunk_rows=30)


def test_defined_cases(spark):
    rng = random.Random(2)
    v, w = [0.5, -0.25, 0.75], [0.5, -0.25, 0.7]
    rows = [(0, v, 1), (0, v, 1), (0, w, 1), (0, v, 2), (1, v, 1), (2, w, 2), (2, w, 2), (None, v, 1), (3, None, 1), (4, v, None),
            (5, [0.5, None, 0.75], 2), (6, [0.5, NAN, 0.75], 2), (7, [0.5, INF, 0.75], 2), (8, [0.5, 1e300, 0.75], 2), (9, [], 1), (10, [], 1),
            (11, [], 2), (20, [0.1] * 5, 3), (21, [0.1] * 5, 4), (30, [-1.0, 0.0, 0.0], 7), (31, [1.0, 0.0, 0.0], 7),
            (2**53 + 1, v, 2), (2**53 + 7, v, 1), (40, [2.0**19, 1.0], 5), (41, [2.0**19, 0.5], 5), (42, [2.0**19, 0.25], 6)]
    want = check(spark, rows)
    assert any(w[3] == 2**53 + 1 for w in want) and any(w[4] > 2**53 for w in want)


def test_small_tables(spark):
    assert check(spark, []) == [] and check(spark, [(10, [1.0], 1)]) == []
    assert check(spark, [(10, [1.0], 1), (11, [1.0], 1), (12, [0.9], 2)]) == [(10, 11, 1, 12, 65536, 58880)]


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_bounds_hold_and_filter(dims):
    rng = np.random.default_rng(dims)
    base = rng.integers(-200, 200, (1, dims))
    # vectors that are nearly constant in their segments are told apart by the means alone
    steps = np.repeat(rng.integers(-200, 200, (400, -(-dims // 8))), 8, axis=1)[:, :dims]
    for x in (rng.integers(-200, 200, (400, dims)), steps + rng.integers(-3, 4, steps.shape)):
        a, b = hn.Summaries(np.concatenate([base, x[:9]])), hn.Summaries(x)
        exact = a.x @ b.x.T
        for (ma, da), (mb, db) in zip(a.levels, b.levels):
            assert (np.abs(exact - ma @ mb.T) <= da @ db.T + 1e-6).all()
        least = np.sort(exact, 1)[:, -5]
        cols, got = hn.scores(a, b, least.astype(np.int64), np.full(10, 2**62))
        want = np.where(exact >= least[:, None], exact, np.iinfo(np.int64).min)
        assert set(np.flatnonzero((exact >= least[:, None]).any(0))) <= set(cols)
        assert (np.where(got >= least[:, None], got, np.iinfo(np.int64).min) == want[:, cols]).all()
    if dims > 8:
        one = hn.Summaries(a.x[1:2])
        cols, _ = hn.scores(one, b, np.array([int(exact[1].max())]), np.array([2**62]))
        assert len(cols) < 40
