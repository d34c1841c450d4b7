"""Queries without SQL compared with plain Python on small random inputs."""

import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleframe.operators import evaluation, evidence, geometry


def _can_merge(a, b):
    wa, wb, ha, hb = a[2] - a[0], b[2] - b[0], a[3] - a[1], b[3] - b[1]
    if min(wa, wb) <= 0 or min(ha, hb) <= 0:
        return False
    overlap = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    gap = max(a[1], b[1]) - min(a[3], b[3])
    wide = max(a[2], b[2]) - min(a[0], b[0])
    tall = max(a[3], b[3]) - min(a[1], b[1])
    return (
        overlap / min(wa, wb) >= 0.80
        and min(wa, wb) / max(wa, wb) >= 0.75
        and gap / min(ha, hb) <= 0.05
        and tall / wide <= 6.0
    )


def _merge_all(items):
    """items: list of (idx, box, conf); one pass per round, lowest pair first."""
    while True:
        taken, out, again = set(), [], False
        for i, (idx, box, conf) in enumerate(items):
            if i in taken:
                continue
            mate = next(
                (j for j in range(i + 1, len(items)) if j not in taken and _can_merge(box, items[j][1])),
                None,
            )
            if mate is not None:
                other = items[mate]
                taken.add(mate)
                lo = [min(p, q) for p, q in zip(box[:2], other[1][:2])]
                hi = [max(p, q) for p, q in zip(box[2:], other[1][2:])]
                box, conf, again = lo + hi, max(conf, other[2]), True
            out.append((idx, box, conf))
        items = out
        if not again:
            return items


def test_box_merge_equals_a_sequential_pass(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for photo in range(60):
        items = []
        for idx in range(rng.choice([1, 3, 8, 20, 300 if photo == 0 else 12])):
            x = rng.choice([0, 60, 120, 500]) + rng.random() * 6
            y = rng.choice([0, 20, 40, 60, 80]) + rng.random()
            w, h = 18 + rng.random() * 6, 19 + rng.random() * 3
            items.append((idx, [x, y, x + w, y + h], round(rng.random(), 3)))
        rows += [(photo, i, *b, c) for i, b, c in items]
        want |= {(photo, i, *[round(v, 9) for v in b], c) for i, b, c in _merge_all(items)}
    df = spark.createDataFrame(
        rows, "photo int, idx int, x1 double, y1 double, x2 double, y2 double, conf double"
    ).repartition(5)
    got = {
        (r["photo"], r["idx"], *[round(r[c], 9) for c in ("x1", "y1", "x2", "y2")], r["conf"])
        for r in geometry.merge_adjacent_boxes(df).collect()
    }
    assert got == want and len(want) < len(rows)


def test_term_scores_equal_difflib(spark):
    words = {"red": ["red", "scarlet"], "blue": ["azure"]}
    things = {"ring": ["ring", "circlet"], "widget": ["widgets"]}
    texts = {1: ["Scarlett", "rings"], 2: ["azur"], 3: ["wid-gets", "redring"], 4: ["zzz"]}
    reads = spark.createDataFrame(
        [(i, [(t, 0.9) for t in ts]) for i, ts in texts.items()],
        "id int, reads array<struct<text string, conf double>>",
    )
    scores = evidence.term_scores(evidence.read_tokens(reads), evidence.lexicon(words, things))
    got = {(r["id"], r["kind"], r["key"]): r["score"] for r in scores.collect()}

    def one(token, term):
        if len(term) <= 4:
            return 1.0 if term in token else 0.0
        return difflib.SequenceMatcher(None, token, term).ratio()

    for i, ts in texts.items():
        tokens = [t.lower().replace("-", "") for t in ts]
        for kind, table in (("brand", words), ("flavour", things)):
            for key, terms in table.items():
                want = max(one(t, m) for t in tokens for m in terms)
                assert got[(i, kind, key)] == pytest.approx(want)


def test_out_of_fold_head_equals_separate_fits(spark):
    from test_vectors import _reference_head

    rng = np.random.default_rng(9)
    centres = {c: rng.normal(size=8) for c in "abcd"}
    rows = [
        (i, c, (v + 0.8 * rng.normal(size=8)).tolist(), i % 3)
        for i, (c, v) in enumerate((c, v) for c, v in list(centres.items()) * 12)
    ]
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>, fold int")
    got = {r["id"]: r for r in evaluation.out_of_fold(df, "lda", folds=3).collect()}
    assert len(got) == len(rows)
    for fold in range(3):
        labels, coef, bias = _reference_head([r for r in rows if r[3] != fold])
        for i, _, vec, f in rows:
            if f != fold:
                continue
            z = (coef @ np.array(vec) + bias) / 30.0
            p = np.exp(z - z.max())
            p /= p.sum()
            order = np.argsort(-p)
            assert got[i]["product"] == labels[order[0]]
            assert got[i]["score"] == pytest.approx(p[order[0]], rel=1e-6)
            assert got[i]["margin"] == pytest.approx(p[order[0]] - p[order[1]], rel=1e-5, abs=1e-9)


def test_reports_on_an_empty_side(spark):
    rows = spark.createDataFrame([("a", "a", 1.0, 0.9, 1.0)], "product string, truth string, vote double, score double, margin double")
    sweep = evaluation.score_sweep(rows)
    assert sweep.count() == 19 and sweep.where("improves").count() == 0
    assert math.isnan(sweep.orderBy(F.col("score_floor")).first()["balanced"])
