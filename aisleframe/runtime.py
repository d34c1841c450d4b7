"""Cluster plumbing shared by the operators: lineage cuts, size checks, skew-safe ranking."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Upper limit for anything that is shipped whole to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach. Only a local session may go without: it gets one of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="aisleframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like :func:`durable`, as a compressed table whose path :func:`forget` can remove."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table of :func:`stored` that nothing reads any more."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def numbered(values: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct ``values`` of any sortable type with their 0-based place in sorted order.

    Ranges are sorted on their own and shifted by the size of the earlier ones.
    """
    # The ranges come from a sample, so they are fixed before they are counted.
    tagged = durable(
        values.select(col).repartitionByRange(col).withColumn("_r", F.spark_partition_id())
    )
    sizes = tagged.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range.
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy(col)) - 1
    return tagged.withColumn("_i", place).join(F.broadcast(shift), "_r").select(
        col, (F.col("_s") + F.col("_i")).cast("long").alias(out)
    )


def split_row_number(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Sequence[Column | tuple[Column, bool]],
    fine: Sequence[Column],
    out: str,
) -> DataFrame:
    """``row_number() over (partition by keys order by coarse, fine)`` without one task per key.

    Rows are numbered inside ``(keys, coarse)`` and shifted by the running count of the earlier
    coarse values. A key that holds a third of the table is thus spread over its coarse values,
    and only their counts are sorted per key. A coarse entry ``(column, True)`` sorts descending;
    coarse columns must not be null.
    """
    coarse = [c if isinstance(c, tuple) else (c, False) for c in coarse]
    names = [f"_c{i}" for i in range(len(coarse))]
    tagged = df.select("*", *[c.alias(n) for (c, _), n in zip(coarse, names)])
    order = [F.col(n).desc() if down else F.col(n).asc() for (_, down), n in zip(coarse, names)]
    per_bucket = tagged.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shift = per_bucket.select(
        *keys, *names, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy(*keys, *names).orderBy(*fine)
    return (
        tagged.withColumn("_inside", F.row_number().over(inside))
        .join(shift, [*keys, *names])
        .withColumn(out, (F.col("_shift") + F.col("_inside")).cast("long"))
        .drop("_inside", "_shift", *names)
    )


RANGE_ROWS = 500_000


def value_counts_ranked(df: DataFrame, col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct values of ``col`` with their count and 1-based first position in sorted order.

    Equal values collapse before sorting, then value ranges of about ``range_rows`` values are
    ranked separately and shifted by the total of the earlier ranges. Columns: value, n, first_pos,
    next_value.
    """
    # The counts are read several times below, the input only once.
    counts = durable(
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    buckets = max(1, -(-counts.count() // range_rows))
    # Range bounds come from a sample, so the ranges are fixed before they are counted.
    ranges = counts.repartitionByRange(buckets, "value").withColumn("_b", F.spark_partition_id())
    tagged = durable(ranges)
    per = tagged.groupBy("_b").agg(F.sum("n").alias("_bn"), F.min("value").alias("_bmin"))
    # At most `buckets` rows reach this unpartitioned window.
    over_all = Window.orderBy("_b")
    shift = per.select(
        "_b",
        F.coalesce(
            F.sum("_bn").over(over_all.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_shift"),
        F.lead("_bmin").over(over_all).alias("_following"),
    )
    w = Window.partitionBy("_b").orderBy("value")
    return (
        tagged.withColumn(
            "_before",
            F.coalesce(
                F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("_lead", F.lead("value").over(w))
        .join(F.broadcast(shift), "_b")
        .select(
            "value",
            "n",
            (F.col("_shift") + F.col("_before") + 1).alias("first_pos"),
            F.coalesce("_lead", "_following").alias("next_value"),
        )
    )


def exact_percentiles(df: DataFrame, col: str, percents: Sequence[float]) -> DataFrame:
    """Linear-interpolation percentiles, exact, without one task holding every value."""
    ranked = value_counts_ranked(df, col)
    total = ranked.agg(F.sum("n").alias("total"))
    wanted = df.sparkSession.createDataFrame([(float(p),) for p in percents], "pct double")
    spot = wanted.join(F.broadcast(total)).select(
        "pct",
        (F.col("pct") / 100 * (F.col("total") - 1)).alias("_pos"),
    )
    spot = spot.select("pct", "_pos", F.floor("_pos").alias("_lo"), F.ceil("_pos").alias("_hi"))
    hit = ranked.join(
        F.broadcast(spot),
        (F.col("first_pos") - 1 <= F.col("_hi"))
        & (F.col("first_pos") - 1 + F.col("n") > F.col("_lo")),
    )
    in_lo = (F.col("first_pos") - 1 <= F.col("_lo")) & (
        F.col("first_pos") - 1 + F.col("n") > F.col("_lo")
    )
    in_hi = (F.col("first_pos") - 1 <= F.col("_hi")) & (
        F.col("first_pos") - 1 + F.col("n") > F.col("_hi")
    )
    return hit.groupBy("pct", "_pos", "_lo").agg(
        F.max(F.when(in_lo, F.col("value"))).alias("_v_lo"),
        F.max(F.when(in_hi, F.col("value"))).alias("_v_hi"),
    ).select(
        "pct",
        (F.col("_v_lo") + (F.col("_v_hi") - F.col("_v_lo")) * (F.col("_pos") - F.col("_lo"))).alias(
            "value"
        ),
    )
