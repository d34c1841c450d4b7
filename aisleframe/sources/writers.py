"""Writing results. Each call replaces the previous run's output under its path."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _csv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.mode("overwrite").option("header", str(header).lower()).csv(path)


def share_csv(shares: DataFrame, path: str) -> None:
    """product, facings and both shares to four decimals."""
    four = lambda c: F.format_string("%.4f", F.bround(c, 4))
    rows = shares.orderBy(F.col("facings").desc(), "product").select(
        "product",
        "facings",
        four("share_by_facings").alias("share_by_facings"),
        four("share_by_space").alias("share_by_space"),
    )
    _csv(rows, path)


def predictions_csv(predictions: DataFrame, path: str) -> None:
    """Header-less crop, product, whole percent, source."""
    pct = F.format_string("%d%%", F.bround(F.col("score") * 100).cast("long"))
    _csv(predictions.select("crop", "product", pct.alias("confidence"), "source"), path, False)


def crop_manifest_csv(crops: DataFrame, path: str) -> None:
    _csv(crops.select("crop", "source_photo", "x1", "y1", "x2", "y2", "area"), path)


def provenance_csv(mapping: DataFrame, path: str, at: datetime | None = None) -> None:
    """Full rewrite, sorted by file, one time stamp for the whole run.

    The rows are computed before the old file is replaced, so the input may be derived from it.
    """
    from ..runtime import durable

    stamp = (at or datetime.now()).isoformat(timespec="seconds")
    rows = durable(mapping.select("kb_file", "source_photo"))
    _csv(rows.withColumn("recorded_at", F.lit(stamp)).orderBy("kb_file"), path)


def cluster_folder(cluster: Column) -> Column:
    return F.when(cluster == -1, F.lit("noise")).otherwise(
        F.concat(F.lit("cluster_"), cluster.cast("string"))
    )


def cluster_assignment(rows: DataFrame, csv_path: str, folder: str) -> None:
    """``crop, cluster_id`` as CSV and the crops partitioned by cluster; the input stays in place."""
    _csv(rows.select("crop", "cluster_id"), csv_path)
    out = rows.withColumn("cluster", cluster_folder(F.col("cluster_id")))
    out.write.mode("overwrite").partitionBy("cluster").parquet(folder)


# Columns of the results file in their order, and which of them hold objects or lists.
NESTED_OBJECTS = ("initial_candidate", "brand_recheck", "flavor_recheck", "size_recovery")
NESTED_LISTS = ("brand_candidates", "search_queries", "search_results", "evidence", "conflicts")
DISCOVERY_COLUMNS = (
    "filename", "source_path", "status", "label", "brand", "flavor", "size",
    "verification_reason", "initial_candidate", "brand_recheck", "brand_candidates",
    "flavor_recheck", "size_recovery", "search_queries", "search_results", "evidence",
    "conflicts", "copied_to",
)


def route(status: Column, label: Column) -> Column:
    """Folder of a discovery result."""
    named = label.isNotNull() & status.isin("verified", "partial")
    return F.when(named, F.concat_ws("/", status, label)).otherwise(F.lit("unresolved_unknown"))


def discovery(results: DataFrame, csv_path: str, json_path: str, folder: str) -> None:
    """CSV with JSON cells, JSON lines, and rows routed by status and label."""
    flat = results
    for c in DISCOVERY_COLUMNS:
        if c not in flat.columns:
            flat = flat.withColumn(c, F.lit(None).cast("string"))
    flat = flat.withColumn("copied_to", route(F.col("status"), F.col("label")))
    types = dict(flat.dtypes)
    for c in NESTED_OBJECTS + NESTED_LISTS:
        empty = F.lit("{}" if c in NESTED_OBJECTS else "[]")
        nested = types[c].startswith(("struct", "array", "map"))
        flat = flat.withColumn(c, F.coalesce(F.to_json(c) if nested else F.col(c), empty))
    flat.select(*DISCOVERY_COLUMNS).write.mode("overwrite").option("header", "true").option(
        "escape", '"'
    ).csv(csv_path)
    results.write.mode("overwrite").json(json_path)
    routed = F.when(F.col("status").isin("verified", "partial") & F.col("label").isNotNull(), F.col("status"))
    results.withColumns(
        {
            "route": F.coalesce(routed, F.lit("unresolved_unknown")),
            "route_label": F.when(routed.isNotNull(), F.col("label")),
        }
    ).write.mode("overwrite").partitionBy("route", "route_label").json(folder)


def predictions_by_class(predictions: DataFrame, folder: str) -> None:
    """Crops partitioned by class; distractors together in their own folder."""
    from ..model import is_non_product

    where = F.when(is_non_product(F.col("product")), F.lit("_skipped_non_beverage")).otherwise(
        F.col("product")
    )
    predictions.withColumn("class", where).write.mode("overwrite").partitionBy("class").parquet(folder)


def truth_template(crops: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per crop, existing labels kept."""
    return crops.select("crop").distinct().join(truth.select("crop", "group"), "crop", "left").select(
        "crop", F.coalesce("group", F.lit("")).alias("group")
    )
