"""Reading image trees and the CSV side files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import file_extension, file_parent, relative_to
from ..model import IMAGE_EXTENSIONS, REPORT_SKIPPED


def class_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Every ``*.jpg`` below ``root`` with its parent folder as label: path, key, size, label.

    Without ``content`` the files are listed but not read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jpg")
        .load(root)
    )
    cols = [
        F.col("path"),
        relative_to(F.col("path"), root).alias("key"),
        F.col("length").alias("size"),
        file_parent(F.col("path")).alias("label"),
    ]
    return files.select(*cols, *([F.col("content")] if content else []))


def flat_folder(
    spark: SparkSession,
    folder: str,
    extensions: Sequence[str] = IMAGE_EXTENSIONS,
    content: bool = False,
) -> DataFrame:
    """Files directly in ``folder`` with an allowed extension, whatever its case."""
    files = spark.read.format("binaryFile").load(folder)
    kept = files.where(file_extension(F.col("path")).isin(*extensions))
    cols = [
        F.col("path"),
        relative_to(F.col("path"), folder).alias("key"),
        F.col("length").alias("size"),
    ]
    return kept.select(*cols, *([F.col("content")] if content else []))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Header-less ``crop,product,confidence,...`` lines; short lines and weak labels dropped."""
    parts = F.split(F.trim("value"), ",")
    return (
        spark.read.text(path)
        .select(parts.alias("p"))
        .where(F.size("p") >= 3)
        .select(
            F.col("p")[0].alias("crop"),
            F.col("p")[1].alias("product"),
            F.col("p")[2].alias("confidence"),
        )
        .where(~F.col("product").isin(*REPORT_SKIPPED))
    )


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.option("header", "true")
        .option("multiLine", "false")
        .schema(schema)
        .csv(path)
    )


def crop_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "crop string, source_photo string, x1 int, y1 int, x2 int, y2 int, area long"
    return _csv(spark, path, schema).where(F.coalesce("crop", F.lit("")) != "")


def provenance(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, "kb_file string, source_photo string, recorded_at string")
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return rows.where(filled("kb_file") & filled("source_photo")).withColumn(
        "recorded_at", F.col("recorded_at").try_cast("timestamp")
    )


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled crops; blank groups are left out."""
    rows = _csv(spark, path, "crop string, group string")
    clean = rows.select("crop", F.trim(F.regexp_replace(F.coalesce("group", F.lit("")), r"\s+$", "")).alias("group"))
    return clean.where((F.coalesce("crop", F.lit("")) != "") & (F.col("group") != ""))


def review_log(spark: SparkSession, path: str) -> DataFrame:
    schema = "timestamp timestamp, action string, label string, source_crop string, kb_file string, note string"
    return _csv(spark, path, schema)


def label_corrections(log: DataFrame) -> DataFrame:
    """Additions per label: how many were confirmed, and what the corrected ones were before."""
    before = F.nullif(F.regexp_extract("note", "corrected from (.*)", 1), F.lit(""))
    return log.select("action", "label", before.alias("corrected_from")).groupBy(
        "action", "label", "corrected_from"
    ).agg(F.count(F.lit(1)).alias("n"))
