"""Share of shelf: facings and area per product, summaries and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import report_parts
from ..functions.scalars import percent, ratio
from ..model import LOW_CONFIDENCE, REPORT_SKIPPED, UNKNOWN_BUCKET, is_bucket, is_non_product


def label_kinds(labels: DataFrame, label: str = "product") -> DataFrame:
    """Bucket predicates of every label."""
    c = F.col(label)
    return labels.select(
        "*",
        is_non_product(c).alias("is_non_product"),
        (c == UNKNOWN_BUCKET).alias("is_unknown"),
        is_bucket(c).alias("is_bucket"),
    )


def counted(label: Column) -> Column:
    """Labels that enter share of shelf; the unknown bucket does, weak matches do not."""
    return (label != LOW_CONFIDENCE) & ~is_non_product(label)


def facings(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Facings and area per product."""
    return (
        predictions.where(counted(F.col("product")))
        .groupBy(*by, "product")
        .agg(F.count(F.lit(1)).alias("facings"), F.sum("area").alias("area"))
    )


def share_of_shelf(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share by facings and by area, within ``by`` (photo, session) or over everything."""
    rows = facings(predictions, by)
    if by:
        # A group is down to one row per product here.
        w = Window.partitionBy(*by)
        total_f, total_a = F.sum("facings").over(w), F.sum("area").over(w)
        return rows.select(
            *rows.columns,
            ratio(F.col("facings"), total_f).alias("share_by_facings"),
            ratio(F.col("area"), total_a).alias("share_by_space"),
        )
    total = rows.agg(F.sum("facings").alias("_f"), F.sum("area").alias("_a"))
    return rows.join(F.broadcast(total)).select(
        *rows.columns,
        ratio(F.col("facings"), F.col("_f")).alias("share_by_facings"),
        ratio(F.col("area"), F.col("_a")).alias("share_by_space"),
    )


def run_summary(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    label = F.col("product")
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(counted(label)).alias("identified"),
        F.count_if(label == LOW_CONFIDENCE).alias("unidentified"),
        F.count_if(is_non_product(label)).alias("skipped"),
    )


def session_crops(predictions: DataFrame) -> DataFrame:
    """Reported crops with their status; distractors are dropped, scores kept to four decimals."""
    label = F.col("product")
    status = (
        F.when(label == LOW_CONFIDENCE, F.lit("low_confidence"))
        .when(label == UNKNOWN_BUCKET, F.lit("unknown"))
        .otherwise(F.lit("identified"))
    )
    return predictions.where(~is_non_product(label)).withColumns(
        {"status": status, "score": F.bround("score", 4)}
    )


def session_share(predictions: DataFrame, by: tuple[str, ...] = ("photo",)) -> DataFrame:
    """Per session share rows rounded to four decimals."""
    return share_of_shelf(predictions, by).withColumns(
        {c: F.bround(c, 4) for c in ("share_by_facings", "share_by_space")}
    )


def report_rows(predictions: DataFrame) -> DataFrame:
    """Report input: labels split into brand, size and flavour, weak matches dropped."""
    parts = report_parts(F.col("product"))
    return predictions.where(~F.col("product").isin(*REPORT_SKIPPED)).select(
        "*", parts.alias("_p")
    ).select(*predictions.columns, "_p.brand", "_p.size", "_p.flavor")


def report_shares(predictions: DataFrame) -> DataFrame:
    """Counts and percentages by product and by brand in one pass over the labels."""
    counts = report_rows(predictions).groupBy("brand", "product").agg(F.count(F.lit(1)).alias("n"))
    both = counts.groupingSets([["brand", "product"], ["brand"]], "brand", "product").agg(
        F.sum("n").alias("count"), F.grouping("product").alias("_g")
    )
    total = counts.agg(F.sum("n").alias("total"))
    return both.join(F.broadcast(total)).select(
        F.when(F.col("_g") == 1, F.lit("brand")).otherwise(F.lit("product")).alias("level"),
        F.when(F.col("_g") == 1, F.col("brand")).otherwise(F.col("product")).alias("name"),
        "count",
        percent(F.col("count"), F.col("total")).alias("share_pct"),
    )


def brand_detections(crops: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Identified crops per brand."""
    return (
        crops.where(F.col("status") == "identified")
        .groupBy(*by, F.split("product", "_")[0].alias("brand"))
        .agg(F.count(F.lit(1)).alias("crops"))
    )


def detection_counters(crops: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return crops.groupBy(*by).agg(
        F.count_if(F.col("status") != "unknown").alias("detected"),
        F.count_if(F.col("status") == "unknown").alias("unknown"),
    )
