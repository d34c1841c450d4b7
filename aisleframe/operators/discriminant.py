"""Linear discriminant head with Ledoit-Wolf shrinkage and uniform priors.

Per class the shrunk covariance needs n, the sum, the Gram matrix and, on standardised rows, the
sum of fourth powers of the norm (Ledoit & Wolf, 2004). All are sums, so they are accumulated per
partition and merged by key; only the pooled d x d matrix and the class means reach the driver,
whose size depends on the dimension and the class list, not on the number of crops. With all
eigenvectors kept the discriminant equals means times the inverse pooled covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import POSTERIOR_TEMPERATURE
from ..runtime import BROADCAST_BYTES
from .neighbors import as_matrix
from .quality import thin_classes

_FLUSH_BYTES = 128 * 1024 * 1024
_CLASS_TASKS = 8


@dataclass
class Head:
    """Coefficients per model; ``models`` maps a model id to (labels, W, b)."""

    models: dict


def fit(refs: DataFrame, model: str | None = None) -> Head | None:
    """Fit on ``refs(label, vec[, model])``; one head per distinct value of ``model``.

    Classes with a single reference are left out. A model with fewer than two usable classes, or
    with a singular pooled covariance, gets no head. Returns None when no model could be fitted.
    """
    rows = refs.withColumn("model", F.col(model) if model else F.lit(0)).select(
        "model", "label", "vec"
    )
    thin = thin_classes(rows, ["model", "label"]).select("model", "label")
    usable = rows.join(thin, ["model", "label"], "left_anti")
    moments = _moments(usable).cache()
    try:
        means = (
            moments.groupBy("model", "label")
            .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "sx"))).alias("s"))
            .select("model", "label", "n", F.col("s.sx").alias("sx"))
        )
        # One row per class and model.
        class_sums = _checked(means)
        quartic = _quartic(usable, _standardisers(moments))
        pooled = _pooled(moments, quartic, class_sums)
        rows_by_model = pooled.toPandas()
    finally:
        moments.unpersist()
    models = {}
    for m, part in class_sums.groupby("model"):
        if len(part) < 2:
            continue
        part = part.sort_values("label")
        mu = np.stack([np.asarray(s) / n for s, n in zip(part["sx"], part["n"])])
        cov = np.stack(
            rows_by_model[rows_by_model["model"] == m].sort_values("i")["row"].to_list()
        )
        try:
            np.linalg.cholesky(cov)
        except np.linalg.LinAlgError:
            continue
        coef = np.linalg.solve(cov, mu.T).T
        bias = -0.5 * (mu * coef).sum(axis=1) + np.log(1.0 / len(part))
        models[m] = (part["label"].to_list(), coef, bias)
    return Head(models) if models else None


def _checked(class_rows: DataFrame) -> pd.DataFrame:
    n, dim = class_rows.agg(F.count(F.lit(1)), F.max(F.size("sx"))).first()
    if n * (dim or 1) * 8 > 16 * BROADCAST_BYTES:
        raise ValueError(f"{n} classes of {dim} dimensions exceed what a head can hold")
    return class_rows.toPandas()


def _moments(rows: DataFrame, budget: int = _FLUSH_BYTES) -> DataFrame:
    """Per (model, label, i): n, sum of coordinate i, row i of the Gram matrix.

    A task holds at most ``budget`` bytes of matrices. Few classes are summed where their rows lie.
    With so many that a task could not hold them all, rows are first dealt by class, each class over
    several tasks, so that a matrix leaves a task once and not for every few rows.
    """
    classes = rows.select("model", "label").distinct().count()
    dim = rows.select(F.size("vec")).first()
    if dim is not None and classes * dim[0] ** 2 * 8 > budget:
        salt = F.pmod(F.xxhash64("vec"), F.lit(_CLASS_TASKS))
        rows = rows.withColumn("_s", salt).repartition("model", "label", "_s")
        rows = rows.sortWithinPartitions("model", "label").drop("_s")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for key, g in b.groupby(["model", "label"], sort=False):
                x = as_matrix(g["vec"])
                n, s, gram = held.get(key, (0, 0.0, 0.0))
                held[key] = (n + len(x), s + x.sum(axis=0), gram + x.T @ x)
                if len(held) * x.shape[1] ** 2 * 8 > budget:
                    yield from _emit(held)
                    held = {}
        yield from _emit(held)

    model_type = rows.schema["model"].dataType.simpleString()
    schema = f"model {model_type}, label string, i int, n long, sx double, row array<double>"
    parts = rows.mapInPandas(partial, schema)
    return parts.groupBy("model", "label", "i").agg(
        F.sum("n").alias("n"), F.sum("sx").alias("sx"), _vector_sum("row")
    )


def _emit(held: dict) -> Iterator[pd.DataFrame]:
    for (m, label), (n, s, gram) in held.items():
        d = len(s)
        yield pd.DataFrame(
            {"model": m, "label": label, "i": np.arange(d, dtype="int32"), "n": n, "sx": s,
             "row": list(gram)}
        )


def _standardisers(moments: DataFrame) -> DataFrame:
    """Per class the mean and standard deviation vectors; a flat coordinate gets scale 1."""
    mean = F.col("sx") / F.col("n")
    var = F.element_at("row", F.col("i") + 1) / F.col("n") - mean * mean
    tiny = F.lit(10.0) * F.lit(np.finfo(np.float64).eps)
    scale = F.when(var <= tiny * F.greatest(mean * mean, F.lit(1e-300)), F.lit(1.0)).otherwise(
        F.sqrt(F.greatest(var, F.lit(0.0)))
    )
    return (
        moments.select("model", "label", "i", mean.alias("mean"), scale.alias("scale"))
        .groupBy("model", "label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "mean", "scale"))).alias("c"))
        .select("model", "label", F.col("c.mean").alias("mean"), F.col("c.scale").alias("scale"))
    )


def _quartic(rows: DataFrame, standardisers: DataFrame) -> DataFrame:
    """Per class the sum over rows of the fourth power of the standardised norm."""
    z = F.zip_with(
        F.zip_with("vec", "mean", lambda x, m: x.cast("double") - m), "scale", lambda c, s: c / s
    )
    sq = F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x)
    return (
        rows.join(standardisers, ["model", "label"])
        .select("model", "label", sq.alias("sq"))
        .groupBy("model", "label")
        .agg(F.sum(F.col("sq") * F.col("sq")).alias("quartic"))
    )


def _pooled(moments: DataFrame, quartic: DataFrame, classes: pd.DataFrame) -> DataFrame:
    """Rows of the uniformly pooled, shrunk within-class covariance per model."""
    per_model = classes.groupby("model").size().to_dict()

    def shrink(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        n = int(g["n"].iloc[0])
        gram = np.stack(g["row"].to_list())
        mean = g["sx"].to_numpy() / n
        cov = gram / n - np.outer(mean, mean)
        var = np.diag(cov).copy()
        flat = var <= 10 * np.finfo(np.float64).eps * np.maximum(mean**2, 1e-300)
        scale = np.where(flat, 1.0, np.sqrt(np.maximum(var, 0.0)))
        corr = cov / np.outer(scale, scale)
        p = len(mean)
        trace = np.diag(corr)
        mu = trace.sum() / p
        delta_ = (corr**2).sum()
        beta = (float(g["quartic"].iloc[0]) / n - delta_) / (p * n)
        delta = (delta_ - 2.0 * mu * trace.sum() + p * mu**2) / p
        beta = min(beta, delta)
        share = 0.0 if beta == 0 else beta / delta
        shrunk = (1.0 - share) * corr
        shrunk[np.diag_indices(p)] += share * mu
        out = shrunk * np.outer(scale, scale) / per_model[key[0]]
        return pd.DataFrame({"model": key[0], "i": np.arange(p, dtype="int32"), "row": list(out)})

    model_type = moments.schema["model"].dataType.simpleString()
    schema = f"model {model_type}, i int, row array<double>"
    # A class is d rows of d numbers.
    return (
        moments.join(quartic, ["model", "label"])
        .groupBy("model", "label").applyInPandas(shrink, schema)
        .groupBy("model", "i").agg(_vector_sum("row"))
    )


def _vector_sum(col: str):
    return vector_to_array(Summarizer.sum(array_to_vector(col))).alias(col)


def posteriors(
    queries: DataFrame,
    head: Head,
    model: str | None = None,
    k: int | None = None,
    temperature: float = POSTERIOR_TEMPERATURE,
) -> DataFrame:
    """Tempered posterior of every class, or of the best ``k``, per crop: id, label, score, rank."""
    shipped = queries.sparkSession.sparkContext.broadcast(head.models)
    id_type = queries.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m, g in b.groupby("model", sort=False):
                if m not in shipped.value:
                    continue
                labels, coef, bias = shipped.value[m]
                labels = np.asarray(labels, dtype=object)
                z = (as_matrix(g["vec"]) @ coef.T + bias) / temperature
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                keep = len(labels) if k is None else min(k, len(labels))
                order = np.argsort(-np.round(p, 12), axis=1, kind="stable")[:, :keep]
                ids = np.repeat(g["id"].to_numpy(), keep)
                yield pd.DataFrame(
                    {
                        "id": ids,
                        "label": labels[order.ravel()],
                        "score": np.take_along_axis(p, order, axis=1).ravel(),
                        "rank": np.tile(np.arange(1, keep + 1), len(g)),
                    }
                )

    return (
        queries.select("id", (F.col(model) if model else F.lit(0)).alias("model"), "vec")
        .mapInPandas(score, f"id {id_type}, label string, score double, rank long")
    )
