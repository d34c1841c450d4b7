"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(t_k - w.x) with one weight vector for all ordered thresholds t_1 < t_2 < t_3.
Features are words and word beginnings of four and five letters, counted per document and damped
by log(1 + n). The labels only say toxic or not; toxic rows are graded by how many cue words (words
or beginnings far likelier in toxic rows) they hold. The answer is the expected grade.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleframe.llm.common import folder_table, slices, whole_text

# Bounds of the fit: labelled rows, features, toxic rows with it for a feature to count.
SAMPLE_ROWS = 8000
FEATURES = 1024
LEAST_ROWS = 3
CUE_ODDS = 2.5
GRADE_CUES = (3, 7)  # cue words from which a toxic row has grade 2 and 3
GRADES = 4
MEMORY_WORDS = 100_000

_words = regex.compile(r"[^\W\d_]+").findall


def word_features(token: str) -> list[str]:
    """Features of one white-space token, lower-cased."""
    out = []
    for w in _words(token):
        out.append(f"={w}")
        for k in (4, 5):
            if len(w) >= k:
                out.append(f"{k}{w[:k]}")
    return out


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bounds: np.ndarray  # increasing thresholds

    def grades(self, x: np.ndarray) -> np.ndarray:
        """Probability of each grade, rows by documents."""
        below = 1.0 / (1.0 + np.exp(-(self.bounds[None, :] - (x @ self.weights)[:, None])))
        edge = np.ones((len(x), 1))
        return np.diff(np.hstack([0 * edge, below, edge]), axis=1)


class Counts:
    """Feature counts of texts over a fixed index, remembering words."""

    def __init__(self, index: dict[str, int]):
        self.index, self.memory = index, {}

    def of(self, text: str) -> dict[int, int]:
        found: dict[int, int] = {}
        memory = self.memory
        for token, n in Counter((text or "").lower().split()).items():
            at = memory.get(token)
            if at is None:
                if len(memory) > MEMORY_WORDS:
                    memory.clear()
                hits = (self.index.get(f) for f in word_features(token))
                at = memory[token] = tuple(h for h in hits if h is not None)
            for k in at:
                found[k] = found.get(k, 0) + n
        return found


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """body, toxic of at most ``rows`` labelled documents, chosen by a hash of doc_id; one of equal
    texts. Labels repeated for a document count as toxic if one of them does."""
    marked = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    # At most `rows` rows of two numbers: small by construction.
    got = docs.select(F.col("doc_id").cast("bigint").alias("id"), whole_text().alias("body")).join(
        F.broadcast(marked), "id"
    )
    return folder_table(got.groupBy(F.xxhash64("body")).agg(
        F.first("body").alias("body"), F.max("toxic").alias("toxic")
    ).select("body", "toxic"), "toxic_sample")


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    clean, toxic = Counter(), Counter()
    for batch in slices(batches, "body"):
        for text, mark in zip(batch.column("body").to_pylist(), batch.column("toxic").to_pylist()):
            found = {f for t in set(text.lower().split()) for f in word_features(t)}
            (toxic if mark else clean).update(found)
    names = list({**clean, **toxic})
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([clean[f] for f in names], pa.int64()),
         pa.array([toxic[f] for f in names], pa.int64())],
        names=["feature", "clean", "toxic"],
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the bounded sample. Without toxic or without clean rows no feature counts."""
    seen = sample(docs, labels, rows)
    sizes = {bool(r["toxic"]): r["count"] for r in seen.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        # Nothing to tell apart: one threshold from the share that was seen.
        level = 6.0 if not n_toxic else -6.0
        return Model({}, np.zeros(0), level + np.arange(GRADES - 1, dtype=float))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    best = (
        seen.mapInArrow(_feature_rows, "feature string, clean bigint, toxic bigint")
        .groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
        .where(F.col("t") >= LEAST_ROWS)
        .select("feature", odds.alias("odds"), "t")
        .where(F.col("odds") > 1)
        .orderBy(F.desc(F.col("odds") * F.sqrt("t")), "feature").limit(FEATURES).collect()
    )
    index = {r["feature"]: i for i, r in enumerate(best)}
    cues = {i for i, r in enumerate(best) if r["odds"] >= CUE_ODDS}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(index)
        for batch in slices(batches, "body"):
            rows = [counts.of(t) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([list(r) for r in rows], pa.list_(pa.int32())),
                 pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))],
                names=["toxic", "at", "n"],
            )

    table = seen.mapInArrow(vectors, "toxic int, at array<int>, n array<int>").collect()
    table.sort(key=lambda r: (r["toxic"], r["at"], r["n"]))
    x, y = np.zeros((len(table), len(index))), np.zeros(len(table), np.int64)
    for i, r in enumerate(table):
        x[i, r["at"]] = np.log1p(r["n"])
        if r["toxic"]:
            # A word and its beginnings are up to three cues.
            held = sum(n for k, n in zip(r["at"], r["n"]) if k in cues) / 3
            y[i] = 1 + sum(held >= least for least in GRADE_CUES)
    return _descend(index, x, y)


def _descend(index: dict[str, int], x: np.ndarray, y: np.ndarray, steps: int = 500) -> Model:
    """Penalised likelihood by Adam; thresholds stay ordered through positive gaps."""
    share = np.array([(y <= k).mean() for k in range(GRADES - 1)]).clip(0.01, 0.99)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(x.shape[1]), [start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    d, n = x.shape[1], len(y)
    low, high = np.maximum(y - 1, 0), np.minimum(y, GRADES - 2)
    m = v = np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        bounds = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        line = x @ p[:d]
        cum = 1.0 / (1.0 + np.exp(-np.clip(bounds[None, :] - line[:, None], -40, 40)))
        slope = cum * (1 - cum)
        up = np.where(y == GRADES - 1, 1.0, cum[np.arange(n), high])
        down = np.where(y == 0, 0.0, cum[np.arange(n), low])
        mass = np.maximum(up - down, 1e-9)
        g_up = np.where(y == GRADES - 1, 0.0, slope[np.arange(n), high]) / mass
        g_down = np.where(y == 0, 0.0, slope[np.arange(n), low]) / mass
        by_bound = np.zeros(GRADES - 1)
        np.add.at(by_bound, high, -g_up)
        np.add.at(by_bound, low, g_down)
        rest = by_bound[::-1].cumsum()[::-1]
        grad = np.concatenate(
            [x.T @ (g_up - g_down) / n + 1e-4 * p[:d], [rest[0] / n], rest[1:] * gaps / n]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    bounds = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])
    return Model(index, p[:d], bounds)


ANSWER = T.StructType([
    T.StructField("severity", T.DoubleType()), T.StructField("score", T.DoubleType()),
    T.StructField("grade", T.IntegerType()),
])


def severity(model: Model, text: Column) -> Column:
    """severity (expected grade), score (probability of a grade above 0), grade (likeliest)."""
    counts = Counts(model.index)

    @F.pandas_udf(ANSWER)
    def answer(texts: pd.Series) -> pd.DataFrame:
        line = np.zeros((len(texts), 1))
        one = Model(model.index, np.ones(1), model.bounds)
        for i, t in enumerate(texts):
            line[i] = sum(model.weights[k] * np.log1p(n) for k, n in counts.of(t).items())
        p = one.grades(line)
        return pd.DataFrame({
            "severity": p @ np.arange(GRADES), "score": 1.0 - p[:, 0],
            "grade": p.argmax(axis=1).astype(np.int32),
        })

    return answer(text)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity, score, grade, predicted (1 from score 0.5 on) per row.

    Null text is empty; empty texts have no features and the severity of the thresholds alone.
    Repeated rows and null ids each give their own row, empty tables none; texts are read whole. Other
    columns are not read.
    """
    got = docs.select("doc_id", severity(model, whole_text()).alias("_s"))
    return got.select(
        "doc_id", "_s.severity", "_s.score", "_s.grade",
        (F.col("_s.score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    return docs.where(severity(model, whole_text())["score"] < 0.5)
