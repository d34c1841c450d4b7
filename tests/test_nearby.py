"""Grid and pivot search for nearby stores against all pairs."""

import math
import random

import pytest

from aisleframe.operators.nearby import _cells, nearby_stores


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def places():
    rng = random.Random(3)
    out = [(i, 36 + rng.random() / 3, 59 + rng.random() / 3) for i in range(120)]
    out += [(200 + i, 10 + rng.random() / 50, (180 + rng.uniform(-0.05, 0.05) + 180) % 360 - 180) for i in range(30)]
    out += [(300 + i, 89.9 + rng.random() / 10, rng.uniform(-180, 180)) for i in range(40)]
    out += [(400 + i, -rng.random() / 30, rng.random() / 30) for i in range(30)]
    out += [(500, 36.1, 59.1), (501, 36.1, 59.1), (502, -90.0, 0.0), (503, 90.0, 5.0)]
    return out


@pytest.mark.parametrize("radius", [0.05, 4.0, 60.0, 25000.0])
@pytest.mark.parametrize("few,share", [(0, 10**9), (0, 0), (10**9, 0)])
def test_nearby_equals_all_pairs(spark, radius, few, share):
    rows = places()
    stores = spark.createDataFrame(rows, "store_id long, lat double, lng double")
    want = {}
    for a in rows:
        near = sorted((round(km(a, b), 9), b[0]) for b in rows if b[0] != a[0] and km(a, b) <= radius)[:5]
        want |= {(a[0], b): (d, k + 1) for k, (d, b) in enumerate(near)}
    got = {(r.store_id, r.other_id): (r.km, r["rank"]) for r in nearby_stores(stores, 5, radius, pairs_per_store=share, few_pairs=few).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1] == want[k][1] for k in want)


def test_visits_grow_with_the_stores(spark):
    rng = random.Random(1)
    for n in (500, 2000):
        rows = [(i, 36 + rng.random() * n / 500, 59 + rng.random()) for i in range(n)]
        homes, visits = _cells(spark.createDataFrame(rows, "store_id long, lat double, lng double"), 4.0)
        pairs = homes.join(visits.drop("store_id", "lat", "lng"), ["band", "cell"]).count()
        assert visits.count() <= 9 * n and pairs < 20 * n


def test_crowded_stores_are_not_all_compared(spark, monkeypatch):
    """Stores that all lie within the radius go to the pivots, and few pairs of them are scored."""
    from aisleframe.operators import nearby

    monkeypatch.setattr(nearby, "SHIPPED_BYTES", 0)
    rng = random.Random(8)
    rows = [(i, 36 + rng.random() / 100, 59 + rng.random() / 100) for i in range(900)]
    rows += [(1000 + i, *rows[i % 7][1:]) for i in range(100)]
    stores = spark.createDataFrame(rows, "store_id long, lat double, lng double")
    got = nearby_stores(stores, 5, 4.0, few_pairs=0, pairs_per_store=1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "stretch" in plan
    want = {}
    for a in rows:
        near = sorted((round(km(a, b), 9), b[0]) for b in rows if b[0] != a[0])[:5]
        want |= {(a[0], b): k + 1 for k, (_, b) in enumerate(near)}
    assert {(r.store_id, r.other_id): r["rank"] for r in got.collect()} == want
