"""Hard negatives against a plain scan, exact products, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleframe.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, q string, chunk int"


def brute(rows, anchor, positives=5, negatives=3):
    whole = {}
    for v, label, x, *_ in rows:
        if v is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        one = (label, [math.floor(256 * float(np.float32(c))) for c in x])
        whole[v] = min(whole.get(v, one), one)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, (label, q) in whole.items():
        if not anchor(a):
            continue
        ranked = sorted((-dot(q, other), v, l) for v, (l, other) in whole.items() if v != a)
        for ps, p, _ in [r for r in ranked if r[2] == label][:positives]:
            inside = [r for r in ranked if r[2] != label and 50 * -ps <= 100 * -r[0] <= 95 * -ps]
            out |= {(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(inside[:negatives])}
    return out


def found(spark, rows, every=3, **more):
    df = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **more)
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("scale", [1, 100, 2**20, 2**31, 2**40])
def test_products(scale):
    rng = np.random.default_rng(scale)
    a, c = (rng.integers(-scale, scale + 1, (n, 7)) for n in (9, 70))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in c] for p in a]
    assert negatives.products(a, c).tolist() == [[min(max(w, -(2**63)), 2**63 - 1) for w in r] for r in want]
    assert negatives.products(a[:, :0], c[:, :0]).shape == (9, 70)


@pytest.mark.parametrize("chunk", [4, 50, 16_384])
def test_scan(spark, chunk):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.choice(4, p=(0.6, 0.2, 0.1, 0.1))), rng.normal(0.2, 0.3, 6).tolist(), "x", 1) for i in range(150)]
    rows += [(200 + i, i % 3, [0.5, 0.25, 0.125, 0.5, 0.5, 0.5], None, None) for i in range(40)]
    want = brute(rows, lambda v: v % 3 == 0)
    assert want and found(spark, rows, chunk=chunk) == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 2.0], "", 0), (1, 1, [1.0, 1.0], "", 0), (2, 2, [0.5, 1.0], "", 0), (2, 2, [0.5, 1.0], "", 0),
            (3, None, [1.0, 1.0], "", 0), (4, 2, None, "", 0), (5, 2, [1.0, None], "", 0), (6, 2, [1.0, nan], "", 0),
            (7, 2, [inf, 1.0], "", 0), (None, 2, [1.0, 1.0], "", 0), (8, 2, [], "", 0), (9, 2, [1.0], "", 0),
            (-3, 1, [1.0, 0.5], "", 0), (12, 1, [0.0, 0.0], "", 0), (15, 3, [3e9, 1e10], "", 0), (16, 3, [3e9, 1e10], "", 0), (17, 4, [2e9, 1e10], "", 0)]
    want = {r for r in brute(rows, lambda v: v % 3 == 0)}
    short = lambda s: min(s, 2**63 - 1)
    got = found(spark, rows)
    small = {r for r in want if max(r[4:]) < 2**63}
    assert small and {r for r in got if r[4] < 2**63 - 1} == small
    assert {r[:2] for r in want - small} >= {r[:2] for r in got if r[4] == short(r[4]) == 2**63 - 1}
    assert found(spark, rows[:1]) == set() and found(spark, []) == set()
