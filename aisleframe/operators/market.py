"""Dashboard analytics over (product, store, observation).

Everything that is not tied to a single observation is derived from per-(product, store) totals,
so the fact table is reduced map-side before anything is shuffled by brand, store or district.
No side is broadcast by hint: the planner does that itself when a side's measured size allows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent, ratio, week_index
from ..model import Filters
from ..runtime import durable, forget, numbered, stored
from .nearby import nearby_stores

WEEKS = 12
PERIODS = {"7": 7, "30": 30, "90": 90}
FACING_AREA_UNIT = 240.0
# Stretches of stores by which products are compared before they are counted.
MOST_RANGES = 64
# Blocks of products; larger tables get larger blocks, so a row is shipped a bounded number of times.
MOST_BLOCKS = 64
MOST_TASKS = 4096
FEW_BLOCKS = 8
# Parts of the stores that meet a brand's catalogue each on its own.
SALTS = 32
MISSING_TASKS = 1024
# Counters of a step; meetings are sorted instead where there are SPARSE counters for each of them.
CELLS = 4_000_000
SPARSE = 16
# A page that ends within so many rows is found by a plain sort with a limit.
PAGE_ROWS = 10_000


def period_filter(period: str, as_of: Column) -> Column:
    """Predicate on ``observed_at`` for 'all' or the last 7 / 30 / 90 days."""
    if period == "all":
        return F.lit(True)
    days = F.make_dt_interval(F.lit(PERIODS[period]))
    return (F.col("observed_at") >= as_of - days) & (F.col("observed_at") <= as_of)


def filtered(obs: DataFrame, products: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Observations of known products under the filter, with the product's attributes."""
    return obs.where(f.date_predicate()).join(products.where(f.product_predicate()), "product_id")


def _matching(obs: DataFrame, products: DataFrame, f: Filters) -> DataFrame:
    keys = products.where(f.product_predicate()).select("product_id")
    return obs.where(f.date_predicate()).join(keys, "product_id", "left_semi")


def carried_pairs(obs: DataFrame) -> DataFrame:
    """Totals per (product, store): the base of the coarser measures."""
    return obs.groupBy("product_id", "store_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("detected_count").alias("count"),
        F.sum("shelf_area").alias("area"),
        F.max("observed_at").alias("last"),
    )


def carried_pairs_with_confidence(obs: DataFrame) -> DataFrame:
    """Per (product, store) totals plus the confidence of the latest observation."""
    newest = F.struct("observed_at", "confidence")
    return obs.groupBy("product_id", "store_id").agg(
        F.sum("detected_count").alias("count"),
        F.sum("shelf_area").alias("area"),
        F.max(newest).alias("_newest"),
    ).select(
        "product_id",
        "store_id",
        "count",
        "area",
        F.col("_newest.observed_at").alias("last"),
        F.col("_newest.confidence").alias("confidence"),
    )


def _product_totals(obs: DataFrame) -> DataFrame:
    return obs.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("detected_count").alias("count"),
        F.sum("shelf_area").alias("area"),
    )


def kpis(
    obs: DataFrame, products: DataFrame, stores: DataFrame, f: Filters = Filters()
) -> DataFrame:
    """Headline figures of the filtered observations, one row."""
    pairs = _matching(carried_pairs(obs.where(f.date_predicate())), products, f.without_dates())
    where = stores.select("store_id", "district")
    # One pass over the facts; the distinct sets are reduced map-side on the pair totals.
    return pairs.join(where, "store_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"),
        F.coalesce(F.sum("area"), F.lit(0.0)).alias("total_area"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_facings"),
        F.count_distinct("product_id").alias("products"),
        F.count_distinct("store_id").alias("stores"),
        F.count_distinct("district").alias("regions"),
    ).withColumn(
        "area_index", percent(F.col("total_area"), F.col("total_facings") * FACING_AREA_UNIT)
    )


def period_delta(obs: DataFrame, products: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Row count against the preceding window of the same length, percent change."""
    everything = _matching(obs, products, f.without_dates()).select(
        F.unix_micros(F.col("observed_at").cast("timestamp")).alias("t"),
        f.date_predicate().alias("inside"),
    )
    # One row of bounds, then one pass for both counts; at least one millisecond of span.
    lo, hi = everything.where("inside").agg(F.min("t"), F.max("t")).first()
    earlier = F.lit(False)
    if lo is not None:
        earlier = (F.col("t") >= lo - max(1000, hi - lo)) & (F.col("t") < lo)
    return everything.agg(
        F.count_if("inside").alias("current"), F.count_if(earlier).alias("previous")
    ).withColumn("delta_pct", percent(F.col("current") - F.col("previous"), F.col("previous")))


def _brand_pairs(obs: DataFrame, products: DataFrame, f: Filters) -> DataFrame:
    """Totals per (brand, store)."""
    pairs = carried_pairs(obs.where(f.date_predicate()))
    dim = products.where(f.product_predicate()).select("product_id", "brand_id")
    return pairs.join(dim, "product_id").groupBy("brand_id", "store_id").agg(
        F.sum("n").alias("n"), F.sum("count").alias("count"), F.sum("area").alias("area")
    )


def _keep_brands(brands: DataFrame, figures: DataFrame, *names: str) -> DataFrame:
    return brands.select("brand_id").join(figures, "brand_id", "left").na.fill(0, list(names))


def brand_presence(
    obs: DataFrame, products: DataFrame, brands: DataFrame, f: Filters = Filters()
) -> DataFrame:
    by_brand = _brand_pairs(obs, products, f).groupBy("brand_id").agg(
        F.count(F.lit(1)).alias("stores"), F.sum("n").alias("observations")
    )
    return _keep_brands(brands, by_brand, "stores", "observations")


def brand_share(
    obs: DataFrame, products: DataFrame, brands: DataFrame, f: Filters = Filters()
) -> DataFrame:
    """Facings and area per brand with their percentage of all brands."""
    totals = _product_totals(obs.where(f.date_predicate()))
    dim = products.where(f.product_predicate()).select("product_id", "brand_id")
    by_brand = totals.join(dim, "product_id").groupBy("brand_id").agg(
        F.sum("count").alias("facings"), F.sum("area").alias("area")
    )
    kept = _keep_brands(brands, by_brand, "facings", "area")
    return _with_shares(kept)


def _with_shares(rows: DataFrame) -> DataFrame:
    # One row per brand, so a single window task holds the brand list.
    everything = Window.partitionBy(F.lit(0))
    return rows.select(
        *rows.columns,
        percent(F.col("facings"), F.sum("facings").over(everything)).alias("facings_pct"),
        percent(F.col("area"), F.sum("area").over(everything)).alias("area_pct"),
    )


def market_coverage(
    obs: DataFrame,
    products: DataFrame,
    brands: DataFrame,
    stores: DataFrame,
    f: Filters = Filters(),
) -> DataFrame:
    pairs = _brand_pairs(obs, products, f)
    by_brand = pairs.groupBy("brand_id").agg(F.count(F.lit(1)).alias("stores"))
    seen = pairs.select("store_id").distinct().agg(F.count(F.lit(1)).alias("_seen"))
    known = stores.agg(F.count(F.lit(1)).alias("_known"))
    base = F.when(F.col("_seen") > 0, F.col("_seen")).otherwise(F.col("_known"))
    return (
        _keep_brands(brands, by_brand, "stores")
        .join(F.broadcast(seen.join(F.broadcast(known))))
        .select("brand_id", "stores", percent(F.col("stores"), base).alias("coverage"))
    )


def weekly_trend(
    obs: DataFrame,
    products: DataFrame,
    brands: DataFrame,
    as_of: Column,
    f: Filters = Filters(),
) -> DataFrame:
    """Detections per brand in twelve dense weekly buckets; the date filter is ignored."""
    recent = obs.withColumn("week", week_index(F.col("observed_at"), as_of)).where(
        F.col("week").between(0, WEEKS - 1)
    )
    per_product = recent.groupBy("product_id", "week").agg(F.sum("detected_count").alias("count"))
    dim = products.where(f.product_predicate()).select("product_id", "brand_id")
    per_brand = per_product.join(dim, "product_id").groupBy("brand_id", "week").agg(
        F.sum("count").alias("count")
    )
    dense = brands.select(
        "brand_id", F.explode(F.sequence(F.lit(0), F.lit(WEEKS - 1))).alias("week")
    ).withColumn("week", F.col("week").cast("long"))
    filled = dense.join(per_brand, ["brand_id", "week"], "left").na.fill(0, ["count"])
    total = filled.groupBy("week").agg(F.sum("count").alias("total"))
    return filled.join(total, "week").select(
        "brand_id", (F.lit(WEEKS - 1) - F.col("week")).alias("bucket"), "count", "total"
    )


def top_products(
    obs: DataFrame, products: DataFrame, n: int = 10, f: Filters = Filters()
) -> DataFrame:
    pairs = carried_pairs(_matching(obs, products, f))
    per_product = pairs.groupBy("product_id").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("stores"), F.max("last").alias("last")
    )
    return per_product.orderBy(F.col("count").desc(), "product_id").limit(n)


def product_list(obs: DataFrame, products: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Every product under the filter with its figures; share is of the whole market's area."""
    pairs = carried_pairs(obs.where(f.date_predicate()))
    per_product = pairs.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("stores"),
        F.sum("n").alias("observations"),
        F.sum("count").alias("count"),
        F.sum("area").alias("area"),
        F.max("last").alias("last"),
    )
    market = obs.agg(F.sum("shelf_area").alias("_market"))
    kept = (
        products.where(f.product_predicate()).select("product_id")
        .join(per_product, "product_id", "left")
        .na.fill(0, ["stores", "observations", "count", "area"])
    )
    return kept.join(F.broadcast(market)).withColumn(
        "share", percent(F.col("area"), F.col("_market"))
    ).withColumn("status", status_by_share(F.col("share"), 8, 3)).drop("_market")


def status_by_share(share: Column, high: float, mid: float) -> Column:
    return (
        F.when(share > high, F.lit("growth driver"))
        .when(share > mid, F.lit("stable"))
        .otherwise(F.lit("needs attention"))
    )


def product_share_where_carried(obs: DataFrame) -> DataFrame:
    """Per product: its area over all area in the stores that carry it, coverage, last seen."""
    pairs = carried_pairs(obs)
    store_area = obs.groupBy("store_id").agg(F.sum("shelf_area").alias("store_area"))
    return (
        pairs.join(store_area, "store_id")
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("coverage"),
            F.sum("count").alias("detections"),
            F.sum("area").alias("own_area"),
            F.sum("store_area").alias("carried_area"),
            F.max("last").alias("last_seen"),
        )
        .withColumn("share", percent(F.col("own_area"), F.col("carried_area")))
        .withColumn("status", status_by_share(F.col("share"), 12, 5))
    )


def product_weekly_trend(obs: DataFrame, products: DataFrame, as_of: Column) -> DataFrame:
    """Twelve dense weekly buckets for every product."""
    recent = obs.withColumn("week", week_index(F.col("observed_at"), as_of)).where(
        F.col("week").between(0, WEEKS - 1)
    )
    hit = recent.groupBy("product_id", "week").agg(F.sum("detected_count").alias("count"))
    by_week = hit.groupBy("product_id").agg(
        F.map_from_entries(F.collect_list(F.struct("week", "count"))).alias("_m")
    )
    dense = products.select("product_id").join(by_week, "product_id", "left")
    return dense.select(
        "product_id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(WEEKS - 1), F.lit(0), F.lit(-1)),
                lambda w: F.coalesce(F.try_element_at("_m", w.cast("long")), F.lit(0)),
            )
        ).alias("bucket", "count"),
    )


def competitors(
    obs: DataFrame, product_id=None, n: int = 6, block_pairs: int = 250_000
) -> DataFrame:
    """Other products found in the stores that carry a product, by number of shared stores.

    With ``product_id`` the carrying stores are semi-joined, so work is linear in the table.
    Without it every product is ranked, block against block, but only where a block can matter (the
    idea of threshold algorithms): two products share at most the sum over store ranges of the lesser
    of their store counts there. Blocks hold products of the same main range. A product's ``n``-th
    count inside its own block bounds what others must reach, and pairs of blocks whose sums stay
    below it for every product are never formed.
    """
    if product_id is not None:
        pairs = obs.select("product_id", "store_id").distinct()
        mine = pairs.where(F.col("product_id") == F.lit(product_id)).select("store_id")
        others = pairs.where(F.col("product_id") != F.lit(product_id))
        return (
            others.join(mine, "store_id", "left_semi")
            .groupBy(F.col("product_id").alias("competitor_id"))
            .agg(F.count(F.lit(1)).alias("stores"))
            .orderBy(F.col("stores").desc(), "competitor_id")
            .limit(n)
            .select(F.lit(product_id).alias("product_id"), "competitor_id", "stores")
        )
    spark = obs.sparkSession
    # A product's stores travel as one row.
    carried, path = stored(obs.groupBy("product_id").agg(F.collect_set("store_id").alias("held")), "carried")
    size = carried.agg(F.sum(F.size("held"))).first()[0] or 0
    block_pairs = max(block_pairs, -(-size // MOST_BLOCKS))
    blocks = max(1, -(-size // block_pairs))
    if blocks <= FEW_BLOCKS:
        # Too few to be worth bounds.
        keyed = carried.select(
            "product_id", F.explode("held").alias("s"), F.pmod(F.xxhash64("product_id"), F.lit(blocks)).alias("block")
        )
        every = [(i, j) for i in range(blocks) for j in range(blocks)]
        best = _shared_by_blocks(keyed, spark.createDataFrame(every, "bl long, br long"), n)
        return _top_shared(best, n)
    listed, profiles = _lists_by_range(carried.where("product_id is not null"), size, block_pairs)
    packed, _ = stored(_packed(listed, profiles.select("block").distinct().count()), "blocks")
    forget(spark, path)
    alone = profiles.select(F.col("block").alias("bl"), F.col("block").alias("br")).distinct()
    kind = obs.schema["product_id"].dataType.simpleString()
    own, _ = stored(_shared_by_packed(packed, alone, n, kind), "own")
    wanted = _block_pairs_in_reach(profiles, own, n)
    return _top_shared(own.unionByName(_shared_by_packed(packed, wanted, n, kind)), n)


def _top_shared(best: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("product_id").orderBy(F.col("stores").desc(), "competitor_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .withColumn("rank", F.col("rank").cast("long"))
    )


def _blocks_by_range(pairs: DataFrame, size: int, block_pairs: int) -> tuple[DataFrame, DataFrame]:
    """:func:`_lists_by_range` of distinct pairs, with a row per pair."""
    carried = pairs.groupBy("product_id").agg(F.collect_set("store_id").alias("held"))
    listed, profiles = _lists_by_range(carried, size, block_pairs)
    return listed.select("product_id", F.explode("held").alias("s"), "block"), profiles


def _lists_by_range(carried: DataFrame, size: int, block_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Products with their stores (``held``) and block, and each product's number of stores by range.

    Ranges are stretches of stores in order of their ids, about as many as blocks, MOST_RANGES at most.
    """
    places = durable(numbered(carried.select(F.explode("held").alias("store_id")).distinct(), "store_id", "s"))
    stores = places.count()
    ranges = max(1, min(MOST_RANGES, -(-size // block_pairs)))
    at = lambda s: F.floor(s * ranges / max(1, stores))
    # The first store of every range but the first.
    bounds = [r[0] for r in places.where(at(F.col("s")) > at(F.col("s") - 1)).where("s > 0").orderBy("s").select("store_id").collect()]

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("held")
            shops, rows = held.flatten(), np.diff(held.offsets.to_numpy())
            plain = lambda x: x.to_numpy(zero_copy_only=False)
            found = np.searchsorted(plain(pa.array(bounds, shops.type)), plain(shops), side="right")
            cell = np.repeat(np.arange(len(rows)), rows) * ranges + found
            counts = np.bincount(cell, minlength=len(rows) * ranges).reshape(len(rows), ranges)
            every = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * ranges, pa.int32()), pa.array(counts.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(counts.argmax(axis=1), pa.int32()), pa.array(rows, pa.int64()), every],
                [*b.schema.names, "main", "stores", "profile"],
            )

    kind = carried.select("product_id", "held")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.schema)
    whole = kind.where(F.size("held") > 0).mapInArrow(profiled, f"{shape}, main int, stores long, profile array<long>")
    # One row per range.
    parts = durable(whole.groupBy("main").agg(F.ceil(F.sum("stores") / block_pairs).alias("parts")))
    block = F.col("main") * F.lit(1 << 32) + F.pmod(F.xxhash64("product_id"), F.col("parts"))
    placed = whole.join(F.broadcast(parts), "main").withColumn("block", block)
    profiles, _ = stored(placed.select("product_id", "block", "profile"), "profiles")
    return placed.select("product_id", "held", "block"), profiles


def _packed(listed: DataFrame, blocks: int) -> DataFrame:
    """A row per block: its products with their stores, and its stores with their products, each as bytes."""

    def pack(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        block = block.take(pc.sort_indices(block["product_id"]))
        ids, held = block["product_id"].combine_chunks(), block["held"].combine_chunks()
        shops, at = np.unique(held.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        first = held.offsets.to_numpy() - held.offsets[0].as_py()
        product = np.repeat(np.arange(len(ids)), np.diff(first))
        order = np.argsort(at, kind="stable")
        upto = np.searchsorted(at[order], np.arange(len(shops) + 1))
        ids = ids.to_numpy(zero_copy_only=False)
        rows = _bytes(ids, shops, first, _narrow(at, len(shops))), _bytes(ids, shops, upto, _narrow(product[order], len(ids)))
        return pa.table({
            "block": block["block"].slice(0, 1), "by_product": pa.array(rows[:1], pa.binary()), "by_store": pa.array(rows[1:], pa.binary())
        })

    # A partition for every block, up to a bound.
    return listed.repartition(min(MOST_TASKS, blocks), "block").groupBy("block").applyInArrow(
        pack, "block long, by_product binary, by_store binary"
    )


def _narrow(places: np.ndarray, size: int) -> np.ndarray:
    return places.astype(np.uint16 if size <= 1 << 16 else np.uint32)


def _bytes(*arrays: np.ndarray) -> bytes:
    plain = pickle.dumps(arrays, 5)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def _arrays(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))


def _shared_by_packed(packed: DataFrame, wanted: DataFrame, n: int, kind: str) -> DataFrame:
    """The best ``n`` for every product of block bl over the blocks br wanted with it.

    Blocks are read again where they meet, so nothing is shipped: a task holds one and streams the others.
    """
    partners = wanted.groupBy("bl").agg(F.collect_set("br").alias("partners"))
    blocks = max(1, partners.count())
    # One row per block.
    left = packed.select(F.col("block").alias("bl"), "by_product").join(F.broadcast(partners), "bl")
    right = packed.select(F.col("block").alias("br"), "by_store")
    met = left.repartitionByRange(min(MOST_TASKS, blocks), "bl").hint("shuffle_replicate_nl").join(
        right, F.array_contains("partners", F.col("br"))
    )

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, mine, found, rows = None, None, [], 0
        for batch in batches:
            for bl, br, by_product, by_store in zip(batch["bl"], batch["br"], batch["by_product"], batch["by_store"]):
                if bl != at:
                    yield from found
                    at, mine, found, rows = bl, _arrays(by_product), [], 0
                found.append(_best_of_packed(mine, _arrays(by_store), n, bl == br))
                rows += len(found[-1])
                if rows > 4 * n * len(mine[0]):
                    found = [_first_of_each(pd.concat(found), n)]
                    rows = len(found[0])
        yield from found

    # Partitions of one block of the left stand together.
    return met.select("bl", "br", "by_product", "by_store").coalesce(min(MOST_TASKS, 2 * blocks)).mapInPandas(
        rank, f"product_id {kind}, competitor_id {kind}, stores long"
    )


def _first_of_each(found: pd.DataFrame, n: int) -> pd.DataFrame:
    found = found.sort_values(["product_id", "stores", "competitor_id"], ascending=[True, False, True])
    return found.groupby("product_id", sort=False).head(n)


def _best_of_packed(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], n: int, same: bool) -> pd.DataFrame:
    """Top ``n`` products of ``b`` for each product of ``a`` by shared stores; products stand in order of ids.

    The lists of a product's stores are laid end to end and counted, so the work is the number of meetings.
    """
    ids_a, shops_a, first_a, held = a
    ids_b, shops_b, first_b, members = b
    place = np.searchsorted(shops_b, shops_a)
    place[place == len(shops_b)] = 0
    there = shops_b[place] == shops_a
    # Stores that the other block has, for each product.
    kept = there[held]
    upto = np.concatenate([[0], np.cumsum(kept)])[first_a]
    at = place[held[kept]]
    begin, end = first_b[at].tolist(), first_b[at + 1].tolist()
    members, width, out = members.astype(np.int64), len(ids_b), []
    for i in np.flatnonzero(np.diff(upto)).tolist():
        met = np.concatenate([members[begin[k] : end[k]] for k in range(upto[i], upto[i + 1])])
        if len(met) * SPARSE < width:
            # Few of the counters would be used.
            other, shared = np.unique(met, return_counts=True)
            if same:
                other, shared = other[other != i], shared[other != i]
        else:
            other, shared = None, np.bincount(met, minlength=width)
            if same:
                shared[i] = 0
        # The n-th largest count, from the number of products with each count.
        having = np.bincount(shared)
        having[:1] = 0
        least = max(1, len(having) - 1 - int(np.searchsorted(np.cumsum(having[::-1]), n)))
        more, equal = np.flatnonzero(shared > least), np.flatnonzero(shared == least)
        best = np.concatenate([more, equal[: n - len(more)]])
        if len(best):
            out.append((i, best if other is None else other[best], shared[best]))
    rows = np.repeat([i for i, _, _ in out], [len(x) for _, x, _ in out]).astype(np.int64)
    none = np.zeros(0, np.int64)
    return pd.DataFrame({
        "product_id": ids_a[rows],
        "competitor_id": ids_b[np.concatenate([x for _, x, _ in out]) if out else none],
        "stores": np.concatenate([x for _, _, x in out]) if out else none,
    })


def _block_pairs_in_reach(profiles: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """Pairs of different blocks (bl, br) in which some product of bl can still gain a competitor."""
    floor = own.groupBy("product_id").agg(
        F.when(F.count(F.lit(1)) >= n, F.min("stores")).otherwise(1).alias("least")
    )
    rows = profiles.join(floor, "product_id", "left").select(
        "block", "profile", F.coalesce("least", F.lit(1)).alias("least")
    )
    ranges = profiles.select(F.size("profile")).first()
    tops = profiles.groupBy("block").agg(
        *[F.max(F.col("profile")[r]).alias(f"_{r}") for r in range(ranges[0] if ranges else 0)]
    )
    # One row per block: the most stores that any of its products has in each range.
    shipped = tops.toPandas()
    names, most = shipped["block"].to_numpy(), shipped.drop(columns="block").to_numpy()

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = set()
            mine = np.stack(b["profile"].to_list()) if len(b) else np.zeros((0, most.shape[1]), int)
            step = max(1, 4_000_000 // max(1, most.size))
            for lo in range(0, len(b), step):
                bound = np.minimum(mine[lo : lo + step, None, :], most[None]).sum(axis=2)
                # An equal count can still win by its id.
                row, col = (bound >= b["least"].to_numpy()[lo : lo + step, None]).nonzero()
                found.update(zip(b["block"].to_numpy()[lo + row].tolist(), names[col].tolist()))
            both = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"bl": both[:, 0], "br": both[:, 1]})

    return durable(rows.mapInPandas(reach, "bl long, br long").where("bl <> br").distinct())


def _shared_by_blocks(keyed: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The best ``n`` of block br for every product of block bl, for the wanted pairs of blocks."""

    def unpacked(lists: pd.DataFrame) -> pd.DataFrame:
        ids, unnamed = lists["ids"].to_list(), lists["s"][lists["unnamed"].astype(bool)].to_numpy()
        s = np.repeat(lists["s"].to_numpy(), [len(x) for x in ids])
        if len(unnamed):
            ids.append(np.full(len(unnamed), np.nan))
        return pd.DataFrame({
            "product_id": np.concatenate(ids) if ids else np.zeros(0, object), "s": np.concatenate([s, unnamed])
        })

    def rank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best_shared(unpacked(a), unpacked(b), n)

    # A store's products of a block travel as one row.
    lists = keyed.groupBy("block", "s").agg(
        F.collect_list("product_id").alias("ids"), F.max(F.col("product_id").isNull()).alias("unnamed")
    )
    kind = keyed.schema["product_id"].dataType.simpleString()
    # Few bytes but much work: a partition for every pair of blocks, up to a bound.
    tasks = max(1, min(MOST_TASKS, wanted.count()))
    left, right = (
        lists.select(F.col("s").alias("s"), F.col("ids").alias("ids"), F.col("unnamed").alias("unnamed"), F.col("block").alias(side))
        .join(wanted.select(F.col("bl").alias("bl"), F.col("br").alias("br")), side)
        .repartition(tasks, "bl", "br")
        for side in ("bl", "br")
    )
    return (
        left.groupBy("bl", "br")
        .cogroup(right.groupBy("bl", "br"))
        .applyInPandas(rank, f"product_id {kind}, competitor_id {kind}, stores long")
    )


def _best_shared(a: pd.DataFrame, b: pd.DataFrame, n: int) -> pd.DataFrame:
    """Top ``n`` products of ``b`` for each product of ``a`` by shared stores (product_id, s).

    Counts are added up from the stores' product lists, so the work is the number of meetings, not
    products times products times stores.
    """
    kinds = {"product_id": a["product_id"].dtype, "competitor_id": a["product_id"].dtype, "stores": "int64"}
    empty = pd.DataFrame({c: pd.Series(dtype=kind) for c, kind in kinds.items()})
    if a.empty or b.empty:
        return empty
    ids_a, ia = np.unique(a["product_id"].to_numpy(), return_inverse=True)
    ids_b, ib = np.unique(b["product_id"].to_numpy(), return_inverse=True)
    shops, sb = np.unique(b["s"].to_numpy(), return_inverse=True)
    order = np.argsort(sb, kind="stable")
    lists, first = ib[order], np.searchsorted(sb[order], np.arange(len(shops) + 1))
    sa = np.searchsorted(shops, a["s"].to_numpy())
    held = sa < len(shops)
    held[held] &= shops[sa[held]] == a["s"].to_numpy()[held]
    ia, sa = ia[held], sa[held]
    order = np.argsort(ia, kind="stable")
    ia, sa = ia[order], sa[order]
    meets = first[sa + 1] - first[sa]
    upto = np.concatenate([[0], np.cumsum(meets)])
    out, lo, width = [], 0, len(ids_b)
    while lo < len(ids_a):
        # As many products as keep both the counters and the meetings bounded, one at least.
        start = int(np.searchsorted(ia, lo))
        most = int(np.searchsorted(upto, upto[start] + 4_000_000, side="right")) - 1
        hi = int(ia[most]) if most < len(ia) else len(ids_a)
        meeting = 1 + int(upto[-1]) // max(1, len(ids_a))
        if meeting * SPARSE >= width:
            hi = min(hi, lo + max(1, CELLS // width))
        hi = max(lo + 1, hi)
        stop = int(np.searchsorted(ia, hi))
        n_meets, s = meets[start:stop], sa[start:stop]
        begin = np.repeat(first[s] - (upto[start:stop] - upto[start]), n_meets)
        other = lists[begin + np.arange(int(n_meets.sum()))]
        cell = np.repeat((ia[start:stop] - lo) * width, n_meets) + other
        if (hi - lo) * width > CELLS:
            # Few of the counters would be used.
            cell, count = np.unique(cell, return_counts=True)
            row, col = np.divmod(cell, width)
            keep = ids_a[lo + row] != ids_b[col]
            row, col, count = row[keep], col[keep], count[keep]
        else:
            shared = np.bincount(cell, minlength=(hi - lo) * width).reshape(hi - lo, width)
            shared[ids_a[lo:hi, None] == ids_b[None, :]] = 0
            if width > n:
                floor = -np.partition(-shared, n - 1, axis=1)[:, n - 1]
            else:
                floor = np.zeros(hi - lo, int)
            row, col = (shared >= np.maximum(floor, 1)[:, None]).nonzero()
            count = shared[row, col]
        got = pd.DataFrame(
            {"product_id": ids_a[lo + row], "competitor_id": ids_b[col], "stores": count.astype("int64")}
        )
        got = got.sort_values(["product_id", "stores", "competitor_id"], ascending=[True, False, True])
        out.append(got.groupby("product_id", sort=False).head(n))
        lo = hi
    return pd.concat(out) if out else empty


def recent_observations(obs: DataFrame, n: int = 6) -> DataFrame:
    """Latest ``n`` observations of every product."""
    order = Window.partitionBy("product_id").orderBy(
        F.col("observed_at").desc(),
        "store_id",
        F.col("detected_count").desc(),
        F.col("shelf_area").desc(),
        F.col("confidence").desc(),
    )
    return (
        obs.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .withColumn("rank", F.col("rank").cast("long"))
    )


def store_list(
    obs: DataFrame, products: DataFrame, stores: DataFrame, f: Filters = Filters()
) -> DataFrame:
    """Every store with its figures; empty stores drop out only under attribute filters."""
    pairs = carried_pairs(obs.where(f.date_predicate()))
    dim = products.where(f.product_predicate()).select("product_id", "brand_id")
    per_brand = pairs.join(dim, "product_id").groupBy("store_id", "brand_id").agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("n").alias("n"),
        F.sum("count").alias("count"),
        F.max("last").alias("last"),
    )
    leader = F.struct((-F.col("count")).alias("k"), F.col("brand_id"))
    per_store = per_brand.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("brands"),
        F.sum("products").alias("products"),
        F.sum("n").alias("observations"),
        F.min(leader)["brand_id"].alias("dominant"),
        F.max("last").alias("last"),
    )
    kept = (
        stores.select("store_id", "district")
        .join(per_store, "store_id", "left")
        .na.fill(0, ["brands", "products", "observations"])
    )
    return kept.where(F.col("observations") > 0) if f.restricts_products else kept


def store_brand_share(obs: DataFrame, products: DataFrame) -> DataFrame:
    """Brand shares inside each store, ranked, with the store's last visit and row count."""
    pairs = carried_pairs(obs)
    rows = pairs.join(products.select("product_id", "brand_id"), "product_id").groupBy(
        "store_id", "brand_id"
    ).agg(
        F.sum("count").alias("facings"),
        F.sum("area").alias("area"),
        F.sum("n").alias("n"),
        F.max("last").alias("last"),
    )
    # One row per brand and store by now, so a store's window holds at most the brand list.
    whole = Window.partitionBy("store_id")
    order = whole.orderBy(F.col("facings").desc(), "brand_id")
    return (
        rows.select(
            "store_id",
            "brand_id",
            "facings",
            "area",
            percent(F.col("facings"), F.sum("facings").over(whole)).alias("facings_pct"),
            percent(F.col("area"), F.sum("area").over(whole)).alias("area_pct"),
            F.max("last").over(whole).alias("last_inspection"),
            F.sum("n").over(whole).alias("observations"),
            (F.row_number().over(order) == 1).alias("dominant"),
        )
        .where(F.col("facings") > 0)
    )


def missing_products(obs: DataFrame, products: DataFrame, chunk: int = 50_000) -> DataFrame:
    """Products of the brands a store carries that the store itself was never seen with.

    Seen pairs move twice: a product's stores as one row, to meet its brand, then each pair to its
    brand and part of the stores, where it is put together. A brand's catalogue travels in hashed
    chunks of bounded length, once for each of SALTS parts of the stores. Both meet by brand and part,
    and the long result is unpacked where they meet, never shuffled.
    """
    size = products.count()
    chunks = max(1, -(-size // chunk))
    dim = products.select(
        "product_id",
        "brand_id",
        F.pmod(F.xxhash64("product_id"), F.lit(chunks)).cast("int").alias("chunk"),
    )
    # Few bytes meet, but the result is long.
    tasks, met = max(1, min(MISSING_TASKS, size // 500)), ["brand_id", "salt"]
    held = obs.groupBy("product_id").agg(
        F.collect_set("store_id").alias("held"), F.max(F.col("store_id").isNull()).alias("unnamed")
    )
    unnamed = F.array(F.lit(None).cast(obs.schema["store_id"].dataType))
    stores = F.when(F.col("unnamed"), F.concat("held", unnamed)).otherwise(F.col("held"))
    carried = (
        held.join(dim, "product_id")
        .select("brand_id", "chunk", "product_id", F.explode(stores).alias("store_id"))
        .withColumn("salt", F.pmod(F.xxhash64("store_id"), F.lit(SALTS)).cast("int"))
        .repartition(tasks, *met)
        .groupBy(*met, "store_id", "chunk").agg(F.collect_list("product_id").alias("seen"))
        .groupBy(*met, "store_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("chunk", "seen"))).alias("seen"))
    )
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    catalogue = dim.groupBy("brand_id", "chunk").agg(F.collect_list("product_id").alias("all")).select("*", parts)
    own = F.try_element_at("seen", "chunk")
    return carried.join(catalogue.repartition(tasks, *met), met).select(
        "store_id",
        # Nothing is known of what an unnamed store has.
        F.explode(F.when(F.col("store_id").isNull() | own.isNull(), F.col("all")).otherwise(F.array_except("all", own))).alias("product_id"),
        "brand_id",
    )


def distribution_opportunities(
    obs: DataFrame,
    stores: DataFrame,
    *,
    n_stores: int = 6,
    max_km: float = 0.05,
    min_count: int = 4,
    n: int = 6,
) -> DataFrame:
    """Products absent from a store but selling in its nearest neighbours."""
    pairs = carried_pairs(obs).select("product_id", "store_id", "count")
    near = nearby_stores(stores, n=n_stores, max_km=max_km).select("store_id", "other_id")
    names = stores.select(F.col("store_id").alias("other_id"), "store_name")
    around = (
        near.join(names, "other_id")
        .join(pairs.withColumnRenamed("store_id", "other_id"), "other_id")
        .join(pairs.select("product_id", "store_id"), ["product_id", "store_id"], "left_anti")
    )
    found = around.groupBy("store_id", "product_id").agg(
        F.sum("count").alias("nearby_count"),
        # At most n_stores names.
        F.size(F.collect_set("store_name")).cast("long").alias("nearby_stores"),
    )
    order = Window.partitionBy("store_id").orderBy(F.col("nearby_count").desc(), "product_id")
    return (
        found.where(F.col("nearby_count") >= min_count)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .withColumn("rank", F.col("rank").cast("long"))
    )


def opportunity_insights(
    obs: DataFrame,
    products: DataFrame,
    brands: DataFrame,
    stores: DataFrame,
    f: Filters = Filters(),
    n: int = 8,
) -> DataFrame:
    """Brand and district pairs where rivals outsell the brand.

    The brand's own figure honours every filter but brand; the rivals' figure only flavour and size.
    """
    own_filter = Filters(None, f.flavor, f.size, f.sku, f.date_from, f.date_to)
    rival_filter = Filters(None, f.flavor, f.size)
    own = _district_totals(obs, products, stores, own_filter).withColumnRenamed("count", "mine")
    rivals = _district_totals(obs, products, stores, rival_filter)
    whole = rivals.groupBy("district").agg(F.sum("count").alias("_all"))
    districts = stores.select("district").distinct().join(whole, "district", "left")
    # A small dimension product: the brand list times the district list.
    grid = brands.select("brand_id").join(districts)
    rows = (
        grid.join(own, ["brand_id", "district"], "left")
        .join(rivals.withColumnRenamed("count", "_theirs"), ["brand_id", "district"], "left")
        .na.fill(0, ["mine", "_all", "_theirs"])
        .withColumn("comp", F.col("_all") - F.col("_theirs"))
    )
    hit = rows.where((F.col("comp") > F.col("mine") * 1.8) & (F.col("comp") > 10))
    severity = (
        F.when(F.col("mine") == 0, F.lit("critical"))
        .when(F.col("comp") > F.col("mine") * 3, F.lit("high"))
        .otherwise(F.lit("medium"))
    )
    return (
        hit.select("brand_id", "district", "mine", "comp", severity.alias("severity"))
        .orderBy(F.col("comp").desc(), "brand_id", "district")
        .limit(n)
    )


def _district_totals(
    obs: DataFrame, products: DataFrame, stores: DataFrame, f: Filters
) -> DataFrame:
    return (
        _brand_pairs(obs, products, f)
        .join(stores.select("store_id", "district"), "store_id")
        .groupBy("brand_id", "district")
        .agg(F.sum("count").alias("count"))
    )


def area_strength(
    obs: DataFrame, products: DataFrame, stores: DataFrame, f: Filters = Filters()
) -> DataFrame:
    """Detections and store count per district, empty districts kept."""
    per_store = _matching(obs, products, f).groupBy("store_id").agg(
        F.sum("detected_count").alias("count")
    )
    return (
        stores.select("store_id", "district")
        .join(per_store, "store_id", "left")
        .groupBy("district")
        .agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("count"),
            F.count(F.lit(1)).alias("stores"),
        )
    )


def strongest_and_weakest(areas: DataFrame, n: int = 5) -> DataFrame:
    strong = areas.orderBy(F.col("count").desc(), "district").limit(n)
    weak = areas.orderBy("count", "district").limit(n)
    return strong.withColumn("side", F.lit("strong")).unionByName(
        weak.withColumn("side", F.lit("weak"))
    )


def stores_missing(
    obs: DataFrame, products: DataFrame, stores: DataFrame, sku: str, n: int = 8
) -> DataFrame:
    """First ``n`` stores without a product; empty when no observed product has that sku."""
    known = products.where((F.col("sku") == sku) | (F.col("product_id").cast("string") == sku))
    observed = obs.join(products.where(F.col("sku") == sku), "product_id", "left_semi")
    carrying = obs.join(known.select("product_id"), "product_id", "left_semi").select("store_id")
    any_seen = observed.agg(F.count(F.lit(1)).alias("_seen"))
    return (
        stores.select("store_id", "store_name", "district")
        .join(carrying.distinct(), "store_id", "left_anti")
        .join(F.broadcast(any_seen), F.col("_seen") > 0)
        .drop("_seen")
        .orderBy("store_id")
        .limit(n)
    )


def brand_cards(
    obs: DataFrame,
    products: DataFrame,
    brands: DataFrame,
    stores: DataFrame,
    f: Filters = Filters(),
) -> DataFrame:
    """Per brand: catalogue size, reach, volume, best and worst product."""
    card_filter = Filters(None, f.flavor, f.size, None, f.date_from, f.date_to)
    pairs = carried_pairs(obs.where(card_filter.date_predicate()))
    dim = products.where(card_filter.product_predicate()).select("product_id", "brand_id")
    joined = pairs.join(dim, "product_id").join(
        stores.select("store_id", "district"), "store_id", "left"
    )
    # Totals per product and totals per store side by side, from one pass over the pairs.
    both = joined.groupingSets(
        [["brand_id", "product_id"], ["brand_id", "store_id", "district"]],
        "brand_id", "product_id", "store_id", "district",
    ).agg(
        F.sum("n").alias("n"), F.sum("count").alias("count"), F.sum("area").alias("area"),
        (F.grouping("store_id") == 1).alias("by_product"),
    )
    at_store = lambda c: F.when(~F.col("by_product"), F.col(c))
    place = F.when(F.col("by_product"), F.struct((-F.col("count")).alias("k"), F.col("product_id")))
    figures = both.groupBy("brand_id").agg(
        F.count_if(~F.col("by_product")).alias("stores"),
        F.sum(at_store("n")).alias("observations"),
        F.sum(at_store("count")).alias("facings"),
        F.sum(at_store("area")).alias("area"),
        F.count_distinct(at_store("district")).alias("districts"),
        F.min(place)["product_id"].alias("best"),
        F.max(place)["product_id"].alias("worst"),
    )
    catalogue = products.groupBy("brand_id").agg(F.count(F.lit(1)).alias("skus"))
    out = brands.select("brand_id")
    for part in (catalogue, figures):
        out = out.join(part, "brand_id", "left")
    return out.na.fill(0, ["skus", "stores", "observations", "facings", "area", "districts"])


def compare_brands(shares: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Chosen brands with shares that still refer to every brand."""
    return shares.where(F.col("brand_id").isin(list(selected)))


def search_page(
    rows: DataFrame,
    query: str,
    columns: Sequence[str],
    sort_by: str,
    *,
    descending: bool = True,
    page: int = 0,
    page_size: int = 10,
    tie: str | None = None,
) -> DataFrame:
    """Case-insensitive substring search, typed sort and one page, clamped to the last one.

    Pages beyond PAGE_ROWS rows are first narrowed to the range of sort values that holds them, so
    only rows of that range are sorted, not all rows before the page.
    """
    hit = rows
    q = query.strip().lower()
    if q:
        any_of = F.lit(False)
        for c in columns:
            text = F.coalesce(F.lower(F.col(c).cast("string")), F.lit(""))
            any_of = any_of | F.contains(text, F.lit(q))
        hit = rows.where(any_of)
    total = hit.count()
    current = min(page, max(1, -(-total // page_size)) - 1)
    offset = current * page_size
    numeric = dict(rows.dtypes)[sort_by] not in ("string",)
    key = F.col(sort_by) if numeric else F.coalesce(F.col(sort_by), F.lit(""))
    order = [key.desc() if descending else key.asc()]
    if tie:
        order.append(F.col(tie).asc())
    for column, down in ((key, descending), *([(F.col(tie), False)] if tie else [])):
        hit, total, offset = _narrowed(hit, column, down, total, offset, page_size)
    return hit.orderBy(*order).offset(offset).limit(page_size)


def _narrowed(
    rows: DataFrame, key: Column, down: bool, total: int, offset: int, size: int, most: int | None = None
) -> tuple[DataFrame, int, int]:
    """The rows whose key may stand on the page, their number, and where the page begins among them.

    Values of a small sample cut the rows into ranges; the counts of the ranges say which of them the
    page touches. This repeats inside them until few rows are left or one value remains.
    """
    most = PAGE_ROWS if most is None else most
    for turn in range(8):
        if offset + size <= most or total <= most:
            break
        # At most 64 cuts; null stands below all values.
        pick = rows.where(key.isNotNull()).select(key.alias("k")).where(
            F.pmod(F.xxhash64(F.lit(turn), F.rand(turn)), F.lit(max(1, total // 4096))) == 0
        ).limit(8192)
        values = [r.k for r in pick.distinct().orderBy("k").collect()]
        cuts = values[:: max(1, len(values) // 64)]
        if not cuts:
            break
        held = F.array(*[F.lit(c) for c in cuts])
        bucket = F.coalesce(F.size(F.filter(held, lambda c: c <= key)), F.lit(0))
        counts = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        before, touched, skipped = 0, [], 0
        for r in sorted(counts, key=lambda r: r.b, reverse=down):
            if before + r.n <= offset:
                skipped = before + r.n
            elif before < offset + size:
                touched.append((r.b, r.n))
            before += r.n
        left = sum(n for _, n in touched)
        if not touched or left == total:
            break
        rows = rows.where(bucket.isin(*[b for b, _ in touched]))
        total, offset = left, offset - skipped
    return rows, total, offset


def report(
    kind: str,
    obs: DataFrame,
    products: DataFrame,
    brands: DataFrame,
    stores: DataFrame,
    f: Filters = Filters(),
) -> DataFrame:
    """The table behind a named report."""
    if kind == "sos":
        return brand_share(obs, products, brands, f)
    if kind in ("brand", "compare"):
        return brand_presence(obs, products, brands, f)
    if kind == "coverage":
        return market_coverage(obs, products, brands, stores, f)
    if kind == "geo":
        areas = area_strength(obs, products, stores, f)
        return areas.orderBy(F.col("count").desc(), "district").limit(12)
    return brand_share(obs, products, brands, f).select("brand_id", "facings", "facings_pct")


def expand_catalogue(
    brands: DataFrame, brand_flavours: DataFrame, brand_sizes: DataFrame
) -> DataFrame:
    """Product list: each brand's flavours times its sizes, with sku code and running id.

    ``brands(brand_id, short, pos)``, ``brand_flavours(brand_id, flavor, flavor_code, pos)``,
    ``brand_sizes(brand_id, size, size_code, pos)``.
    """
    rows = (
        brands.withColumnRenamed("pos", "_pb")
        .join(brand_flavours.withColumnRenamed("pos", "_pf"), "brand_id")
        .join(brand_sizes.withColumnRenamed("pos", "_ps"), "brand_id")
    )
    row = F.struct("_pb", "_pf", "_ps", "brand_id", "flavor", "size", "short", "flavor_code", "size_code")
    # Ranges of rows are numbered on their own.
    rows = numbered(rows.select(row.alias("row")), "row", "_n").select("row.*", "_n")
    seq = (F.col("_n") + 1).cast("string")
    return rows.select(
        F.concat(F.lit("P"), F.lpad(seq, F.greatest(F.lit(3), F.length(seq)), F.lit("0"))).alias("product_id"),
        F.concat_ws("-", F.upper(F.substring("short", 1, 2)), "flavor_code", "size_code").alias(
            "sku"
        ),
        "brand_id",
        "flavor",
        "size",
    )


def shelf_summary(detections: DataFrame) -> DataFrame:
    """Known detections per photo."""
    return detections.groupBy("photo").agg(
        F.count(F.lit(1)).alias("detections"), F.count_if("known").alias("total_facings")
    )


def map_points(
    obs: DataFrame, products: DataFrame, stores: DataFrame, f: Filters = Filters()
) -> DataFrame:
    """Per store: position, volume, variety and the attribute sets it carries."""
    pairs = carried_pairs(obs.where(f.date_predicate()))
    dim = products.where(f.product_predicate()).select("product_id", "brand_id", "flavor", "size")
    per_store = (
        pairs.join(dim, "product_id")
        .groupBy("store_id")
        .agg(
            F.sum("n").alias("observations"),
            F.sum("count").alias("count"),
            F.count(F.lit(1)).alias("products"),
            F.sort_array(F.collect_set("brand_id")).alias("brands"),
            F.sort_array(F.collect_set("flavor")).alias("flavors"),
            F.sort_array(F.collect_set("size")).alias("sizes"),
            F.max("last").alias("last"),
        )
    )
    return stores.select("store_id", "lat", "lng").join(per_store, "store_id")


def heat_bands(points: DataFrame) -> DataFrame:
    """Intensity relative to the busiest point, in four bands."""
    top = points.agg(F.greatest(F.lit(1), F.max("count")).alias("_top"))
    t = ratio(F.col("count"), F.col("_top"))
    band = (
        F.when(t > 0.75, F.lit("very high"))
        .when(t > 0.5, F.lit("high"))
        .when(t > 0.3, F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    return points.join(F.broadcast(top)).select(
        *points.columns, t.alias("intensity"), band.alias("band")
    )


def map_scope(points: DataFrame, stores: DataFrame, n: int = 8, max_km: float = 4.0) -> DataFrame:
    """For every store the map points of itself and its nearest neighbours."""
    near = nearby_stores(stores, n=n, max_km=max_km).select("store_id", "other_id")
    own = stores.select("store_id", F.col("store_id").alias("other_id"))
    shown = near.unionByName(own)
    return shown.join(points.withColumnRenamed("store_id", "other_id"), "other_id")
