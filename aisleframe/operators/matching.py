"""Matching crop vectors to labelled references: votes, centroids, gates."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import softmax_weight, unit
from ..model import (
    K_NEIGHBOURS,
    LOW_CONFIDENCE,
    MARGIN_FLOORS,
    MODES,
    SCORE_FLOORS,
    VOTE_FLOOR,
    VOTE_TEMPERATURE,
)
from .neighbors import Limits, knn_join


def mean_vectors(rows: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Element-wise mean of the vectors per key, combined map-side as whole vectors."""
    wide = array_to_vector(F.col(vec).cast("array<double>"))
    return (
        rows.groupBy(*keys)
        .agg(Summarizer.mean(wide).alias("_m"))
        .select(*keys, vector_to_array("_m").alias("vec"))
    )


def view_average(views: DataFrame, key: str = "id") -> DataFrame:
    """One unit vector per crop from the vectors of its augmented views."""
    return mean_vectors(views, [key]).withColumn("vec", unit(F.col("vec")))


def prototypes(refs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One unit centroid per label."""
    return mean_vectors(refs, (keys or []) + ["label"]).withColumn("vec", unit(F.col("vec")))


def neighbours(
    queries: DataFrame,
    refs: DataFrame,
    k: int = K_NEIGHBOURS,
    exclude: str = "none",
    limits: Limits = Limits(),
) -> DataFrame:
    """Exact cosine neighbours of ``queries(id, vec[, fold])`` in ``refs(id, label, vec[, fold])``."""
    q, r = queries.withColumnRenamed("id", "qid"), refs.withColumnRenamed("id", "rid")
    if exclude == "tag":
        q, r = q.withColumnRenamed("fold", "tag"), r.withColumnRenamed("fold", "tag")
    return knn_join(q, r, k, exclude=exclude, limits=limits)


def vote(hits: DataFrame, temperature: float = VOTE_TEMPERATURE) -> DataFrame:
    """Decision of the k neighbours: id, product, vote, score, margin.

    ``score`` is the similarity of the nearest neighbour whatever its label; a missing runner-up
    counts as share 0; equal shares go to the label of the earlier neighbour.
    """
    # At most k rows per query from here on.
    q = Window.partitionBy("qid")
    weighted = hits.withColumn("best", F.max("score").over(q)).withColumn(
        "w", softmax_weight(F.col("score"), F.col("best"), temperature)
    )
    per_label = weighted.groupBy("qid", "label").agg(
        F.sum("w").alias("w"), F.min("rank").alias("first"), F.max("best").alias("best")
    )
    # Weights that differ only by summation noise are a tie.
    place = F.struct((-F.round("w", 12)).alias("a"), F.col("first").alias("b"), "label", "w")
    return (
        per_label.groupBy("qid")
        .agg(
            F.array_sort(F.collect_list(place)).alias("p"),
            F.sum("w").alias("total"),
            F.max("best").alias("score"),
        )
        .select(
            F.col("qid").alias("id"),
            F.col("p")[0]["label"].alias("product"),
            (F.col("p")[0]["w"] / F.col("total")).alias("vote"),
            "score",
            (
                (F.col("p")[0]["w"] - F.coalesce(F.get("p", F.lit(1))["w"], F.lit(0.0)))
                / F.col("total")
            ).alias("margin"),
        )
    )


def match_knn(queries, refs, k=K_NEIGHBOURS, exclude="none", limits=Limits()) -> DataFrame:
    return vote(neighbours(queries, refs, k, exclude, limits))


def class_ranking(
    queries: DataFrame, protos: DataFrame, k: int | None = None, limits=Limits()
) -> DataFrame:
    """Every class, or the best ``k``, per crop by centroid cosine: id, label, score, rank."""
    if k is None:
        k = max(1, protos.count())
    return knn_join(
        queries.withColumnRenamed("id", "qid"),
        protos.select(F.col("label").alias("rid"), "label", "vec"),
        k,
        limits=limits,
    ).select(F.col("qid").alias("id"), "label", "score", "rank")


def best_and_margin(ranking: DataFrame) -> DataFrame:
    """First row of a ranking with its lead over the second, 1.0 when it stands alone."""
    return ranking.groupBy("id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("product"),
        F.lit(1.0).alias("vote"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.coalesce(
            F.max(F.when(F.col("rank") == 1, F.col("score")))
            - F.max(F.when(F.col("rank") == 2, F.col("score"))),
            F.lit(1.0),
        ).alias("margin"),
    )


def match_prototype(queries: DataFrame, refs: DataFrame, limits=Limits()) -> DataFrame:
    return best_and_margin(class_ranking(queries, prototypes(refs), 2, limits))


def top_matches(
    queries: DataFrame, refs: DataFrame, k: int | None = 5, mode: str = "lda", head=None
) -> DataFrame:
    """One row per class, best first, ``k`` of them or all: by posterior in lda, else by centroid.

    Without ``head`` one is fitted on ``refs``; references that allow none are ranked by centroid.
    """
    k = k if k is None else max(1, k)
    if mode == "lda":
        from .discriminant import fit, posteriors

        head = fit(refs) if head is None else head
        if head is not None:
            return posteriors(queries, head, k=k)
    return class_ranking(queries, prototypes(refs), k)


def match(
    queries: DataFrame, refs: DataFrame, mode: str = "lda", exclude: str = "none"
) -> DataFrame:
    """id, product, vote, score, margin in one of the three modes."""
    if mode == "prototype":
        return match_prototype(queries, refs)
    if mode == "lda":
        from .discriminant import fit, posteriors

        head = fit(refs)
        if head is not None:
            return best_and_margin(posteriors(queries, head, k=2))
    return match_knn(queries, refs, exclude=exclude)


def classify(matches: DataFrame) -> DataFrame:
    """The public three-column answer of a match."""
    return matches.select("id", "product", "vote", "score")


def mode_gates(spark: SparkSession) -> DataFrame:
    """Default floors per mode; a null margin floor switches that gate off."""
    rows = [(m, SCORE_FLOORS[m], MARGIN_FLOORS[m], VOTE_FLOOR) for m in MODES]
    return spark.createDataFrame(
        rows, "mode string, score_floor double, margin_floor double, vote_floor double"
    )


def gated(
    product: Column,
    vote: Column,
    score: Column,
    margin: Column,
    *,
    score_floor: Column,
    margin_floor: Column,
    vote_floor: Column,
) -> Column:
    """The product, or low_confidence when any gate rejects."""
    weak_margin = F.coalesce(margin < margin_floor, F.lit(False))
    return F.when(
        (score < score_floor) | weak_margin | (vote < vote_floor), F.lit(LOW_CONFIDENCE)
    ).otherwise(product)


def apply_gates(
    matches: DataFrame,
    *,
    score_floor: float,
    margin_floor: float | None = None,
    vote_floor: float = VOTE_FLOOR,
) -> DataFrame:
    return matches.withColumn(
        "gated",
        gated(
            F.col("product"),
            F.col("vote"),
            F.col("score"),
            F.col("margin"),
            score_floor=F.lit(score_floor),
            margin_floor=F.lit(margin_floor).cast("double"),
            vote_floor=F.lit(vote_floor),
        ),
    )


def candidate_labels(refs: DataFrame) -> DataFrame:
    """Labels a second opinion may answer with: every named product."""
    from ..model import is_bucket

    return refs.select("label").distinct().where(~is_bucket(F.col("label")))
