"""Stores around a store."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_RADIUS_KM, haversine_km
from .neighbors import GreatCircle, Limits, knn_join

# Distances up to which all stores are simply compared, in vectors.
FEW_PAIRS = 25_000_000
# Candidate pairs per store up to which the grid is used; denser tables go to the pivot join.
PAIRS_PER_STORE = 2000
# Stores that the pivot join ships whole, in bytes: about ten thousand.
SHIPPED_BYTES = 512 * 1024


def nearby_stores(
    stores: DataFrame,
    n: int = 5,
    max_km: float = 8.0,
    limits: Limits = Limits(),
    pairs_per_store: int = PAIRS_PER_STORE,
    few_pairs: int = FEW_PAIRS,
) -> DataFrame:
    """The ``n`` nearest other stores within ``max_km`` of every store: store_id, other_id, km, rank.

    Stores are joined by grid cells no smaller than the radius, so only neighbours meet. The pairs
    this would make are counted first; where stores crowd in few cells the exact pivot join, which
    splits them, takes over. It also serves tables of a few thousand stores, where comparing all is
    less work than the grid's joins. All ways give the same rows.
    """
    if stores.count() ** 2 <= few_pairs:
        return _by_pivots(stores, n, max_km, limits)
    homes, visits = _cells(stores, max_km)
    crowd = homes.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("n"))
    seen = visits.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("v"))
    work = crowd.join(seen, ["band", "cell"]).agg(
        F.sum(F.col("n").cast("double") * F.col("v")), F.sum("n")
    ).first()
    if work[0] is not None and work[0] > pairs_per_store * work[1]:
        # In the plane pivots prune nearly everything, so no more is shipped whole than is cheap to scan.
        shipped = min(limits.broadcast_bytes, SHIPPED_BYTES)
        return _by_pivots(stores, n, max_km, replace(limits, broadcast_bytes=shipped))
    a, b = visits.alias("a"), homes.alias("b")
    km = haversine_km(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.cell") == F.col("b.cell"))).where(
        F.col("a.store_id") != F.col("b.store_id")
    ).select(F.col("a.store_id").alias("store_id"), F.col("b.store_id").alias("other_id"), km.alias("km"))
    # Distances that differ only by rounding are a tie.
    order = Window.partitionBy("store_id").orderBy(F.round("km", 9), "other_id")
    return (
        pairs.where(F.col("km") <= max_km)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .withColumn("rank", F.col("rank").cast("long"))
    )


def _cells(stores: DataFrame, max_km: float) -> tuple[DataFrame, DataFrame]:
    """Each store in its own cell, and in every cell where its neighbours may be.

    Latitude bands are as high as the radius. Within a band cells are as wide as the radius is at
    the latitude farthest from the equator that a visitor can have, so one cell on either side is
    enough; longitudes wrap around.
    """
    reach = max_km / EARTH_RADIUS_KM * (1 + 1e-9)
    height = math.degrees(reach)
    points = stores.select("store_id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    own = F.floor(F.col("lat") / height)

    def columns(band: Column) -> Column:
        """Number of equal cells around the earth in a band."""
        far = F.greatest(F.abs((band - 1) * height), F.abs((band + 2) * height))
        narrow = F.cos(F.radians(F.least(far, F.lit(90.0))))
        wide = F.when(narrow > math.sin(reach), F.degrees(F.asin(F.lit(math.sin(reach)) / narrow)))
        return F.greatest(F.lit(1), F.coalesce(F.floor(F.lit(360.0) / wide), F.lit(1))).cast("long")

    def cell(count: Column) -> Column:
        east = F.pmod(F.col("lng"), F.lit(360.0))
        return F.least(F.floor(east / 360.0 * count), count - 1)

    homes = points.select("*", own.alias("band"), cell(columns(own)).alias("cell"))
    bands = points.select("*", F.explode(F.sequence(own - 1, own + 1)).alias("band"))
    counted = bands.withColumn("_n", columns(F.col("band")))
    around = F.array_distinct(F.transform(
        F.sequence(F.lit(-1), F.lit(1)), lambda s: F.pmod(cell(F.col("_n")) + s, F.col("_n"))
    ))
    visits = counted.select("store_id", "lat", "lng", "band", F.explode(around).alias("cell"))
    return homes, visits


def _by_pivots(stores: DataFrame, n: int, max_km: float, limits: Limits) -> DataFrame:
    points = stores.select("store_id", F.array("lat", "lng").alias("vec"))
    hits = knn_join(
        points.withColumnRenamed("store_id", "qid"),
        points.withColumnRenamed("store_id", "rid"),
        n,
        measure=GreatCircle(),
        exclude="self",
        max_distance=max_km,
        limits=limits,
    )
    return hits.select(
        F.col("qid").alias("store_id"),
        F.col("rid").alias("other_id"),
        (-F.col("score")).alias("km"),
        "rank",
    )
