"""Line and severity models: exact marginals, held-out accuracy, rows of any kind."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleframe.llm import quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "a " * 300_000), (None, "x"), (5, "same"), (5, "same")]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([1, 4, 0, 3, 6])
    scores, moves = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    p, pairs = quality.marginals(scores, counts, moves)
    at = 0
    for i, n in enumerate(counts):
        total, good, move = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(s for s, y in zip(scores[at : at + n], labels) if y)
                       + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            good += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                move[a, b] += w
        if n:
            assert np.allclose(p[at : at + n], good / total)
            assert np.allclose(pairs[i], move / total)
        at += n


def test_lines_of_texts():
    texts = [b"", b"one line", b"a\n\nb|c\n", b"word " * 500_000, b"end"]
    bins, lengths, counts = quality.lines_of(texts)
    assert counts[:3].tolist() == [1, 1, 4] and counts[4] == 1 and counts[3] >= 2
    assert len(bins) == len(lengths) == counts.sum()
    assert lengths[:6].tolist() == [0, 8, 1, 0, 3, 0]


def test_quality_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = queries.op3(spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in got]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_severity_of_labelled_rows(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit(docs, labels.where(~odd))
    assert (np.diff(model.bounds) > 0).all()
    got = toxicity.scored(docs, model).join(labels.where(odd & F.col("toxic").isNotNull()), "doc_id").collect()
    clean = [r for r in got if not r.toxic]
    assert np.mean([r.predicted for r in clean]) < 0.02
    assert np.mean([r.predicted for r in got if r.toxic]) > 0.7
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in got)
    held = toxicity.without_toxic(docs, model)
    assert held.columns == docs.columns and 0 < held.count() < docs.count()


@pytest.mark.parametrize("labelled", [[], [(5, 1, 0)], [(5, 0, 1), (2, 1, 0), (5, 0, 0), (99, 1, 1), (None, 1, 1), (4, None, None)]])
def test_rows_of_any_kind(spark, labelled):
    docs = spark.createDataFrame([(*r, 0.5) for r in ODD], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame(labelled, "doc_id bigint, quality int, toxic int")
    tox, qual = toxicity.fit(docs, labels), quality.fit(docs, labels)
    for found in (toxicity.scored(docs, tox), quality.scored(docs, qual)):
        rows = found.collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
        assert all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(docs.limit(0), qual).count() == 0
    assert toxicity.without_toxic(docs.limit(0), tox).count() == 0


def test_ordinal_fit_follows_counts():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 12, 600)
    y = np.digitize(n, [1, 4, 8])
    model = toxicity._descend({"=x": 0}, np.log1p(n)[:, None].astype(float), y)
    expected = model.grades(np.log1p(np.arange(12))[:, None]) @ np.arange(4)
    assert (np.diff(expected) > 0).all() and expected[0] < 0.3 and expected[11] > 2.6


SMALL = "/root/testdata/sf0.001"


def plain_quality(model, text):
    """One text alone: sums in the log domain, line by line."""
    bins, lengths, _ = quality.lines_of([text])
    n = len(bins)
    own = [sum(model.own[k, b] for k, b in enumerate(line)) + model.bias for line in bins]
    for i in range(n):
        if i > 0:
            own[i] += sum(model.before[k, b] for k, b in enumerate(bins[i - 1]))
        if i + 1 < n:
            own[i] += sum(model.after[k, b] for k, b in enumerate(bins[i + 1]))
    emit = [(0.0, max(-30.0, min(30.0, s))) for s in own]
    ahead = [list(emit[0])]
    for i in range(1, n):
        ahead.append([emit[i][y] + np.logaddexp(*[ahead[-1][x] + model.moves[x, y] for x in (0, 1)]) for y in (0, 1)])
    behind = [[0.0, 0.0]]
    for i in range(n - 2, -1, -1):
        behind.append([np.logaddexp(*[model.moves[x, y] + emit[i + 1][y] + behind[-1][y] for y in (0, 1)]) for x in (0, 1)])
    behind.reverse()
    p = [1 / (1 + np.exp(a[0] + b[0] - a[1] - b[1])) for a, b in zip(ahead, behind)]
    w = [max(1, int(x)) for x in lengths]
    s = sum(a * b for a, b in zip(p, w)) / sum(w)
    return 0.5 * s / model.cut if s < model.cut else 0.5 + 0.5 * (s - model.cut) / (1 - model.cut)


def test_op3_equals_a_plain_forward_backward(spark):
    docs, labels = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "labels")
    model = quality.fit(docs, labels, learn=~queries.held_out())
    got = {r.doc_id: r.score for r in queries.op3(spark, SMALL).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        assert got[d] == pytest.approx(plain_quality(model, t), abs=1e-9)


def test_op7_equals_a_plain_scorer(spark):
    docs, labels = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "labels")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in queries.op7(spark, SMALL).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.keys() == texts.keys() and any(r.predicted for r in got.values())
    for d, t in texts.items():
        counts = {}
        for token in t.lower().split():
            for f in toxicity.word_features(token):
                if f in model.index:
                    counts[f] = counts.get(f, 0) + 1
        line = sum(model.weights[model.index[f]] * np.log(1 + n) for f, n in counts.items())
        below = [0.0, *[1 / (1 + np.exp(line - b)) for b in model.bounds], 1.0]
        grades = np.diff(below)
        assert got[d].severity == pytest.approx(sum(k * g for k, g in enumerate(grades)), abs=1e-9)
        assert got[d].score == pytest.approx(1 - grades[0], abs=1e-9)
        assert got[d].predicted == int(1 - grades[0] >= 0.5)
