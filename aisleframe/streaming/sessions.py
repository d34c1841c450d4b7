"""Share of shelf while crops keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import ratio
from ..operators.share import counted
from ..runtime import scratch_path


def running_counts(crops: DataFrame) -> DataFrame:
    """Streaming aggregate per session and product, for update or complete output.

    State is one row per session and product; use :func:`start_session_totals` where sessions
    never stop coming.
    """
    ok = counted(F.col("product"))
    return crops.groupBy("session", "product").agg(
        F.count(F.lit(1)).alias("done"),
        F.count_if(ok).alias("facings"),
        F.sum(F.when(ok, F.col("area")).otherwise(0.0)).alias("area"),
    )


def start_session_totals(crops: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Write each micro-batch's partial totals under ``folder/totals/batch=N``.

    A replayed batch overwrites its own folder, so totals are exact after a failure, and no state
    is held between batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        running_counts(batch).write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")

    return (
        crops.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def session_progress(spark: SparkSession, folder: str, session: str | None = None) -> DataFrame:
    """Totals per session and product over every batch so far.

    The type of session ids comes from the written files, or is given as ``session`` where there may
    be none yet.
    """
    read = spark.read
    if session is not None:
        read = read.schema(
            f"session {session}, product string, done long, facings long, area double, batch long"
        )
    parts = read.parquet(f"{folder}/totals")
    return parts.groupBy("session", "product").agg(
        F.sum("done").alias("done"), F.sum("facings").alias("facings"), F.sum("area").alias("area")
    )


def session_shares(totals: DataFrame) -> DataFrame:
    """Shares within each session from its product totals."""
    # A session has one row per product.
    w = Window.partitionBy("session")
    return totals.where(F.col("facings") > 0).select(
        "session",
        "product",
        "facings",
        "area",
        ratio(F.col("facings"), F.sum("facings").over(w)).alias("share_by_facings"),
        ratio(F.col("area"), F.sum("area").over(w)).alias("share_by_space"),
    )


def run_to_end(crops: DataFrame, folder: str | None = None) -> DataFrame:
    """Consume everything available and return the final session totals."""
    spark = crops.sparkSession
    folder = folder or scratch_path(spark, "sessions")
    query = start_session_totals(crops, folder)
    query.awaitTermination()
    return session_progress(spark, folder, crops.schema["session"].dataType.simpleString())
