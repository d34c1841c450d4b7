"""Dashboard queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..model import Filters
from ..operators import market as m
from ..sources import bindings as b
from ..sources.bindings import AS_OF_SQL, MARKET_SQL, OBS_SQL, PRED_SQL, PRODUCTS_SQL, STORES_SQL
from .registry import query

TS = "'%Y-%m-%d %H:%M:%S'"
SOME = Filters(
    flavor="ECONOMY", date_from=datetime(1996, 1, 1), date_to=datetime(2000, 12, 31)
)
SOME_SQL = (
    "flavor = 'ECONOMY' AND observed_at >= TIMESTAMP '1996-01-01' "
    "AND observed_at <= TIMESTAMP '2000-12-31'"
)
JOINED = "j AS (SELECT * FROM obs JOIN products USING (product_id))"


def stamp(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def r2(*cols: str):
    return [F.round(c, 2).alias(c) for c in cols]


def opb(spark, d):
    return b.observations(spark, d), b.products(spark, d), b.brands(spark, d)


@query("mkt01_filtered_observations", f"""
WITH {MARKET_SQL}, {JOINED}
SELECT product_id, store_id, detected_count, round(shelf_area, 2) AS shelf_area,
       strftime(observed_at, {TS}) AS observed_at, brand_id, flavor, size
FROM j WHERE {SOME_SQL}""")
def mkt01(spark, d):
    obs, p, _ = opb(spark, d)
    return m.filtered(obs, p, SOME).select(
        "product_id", "store_id", "detected_count", *r2("shelf_area"), stamp("observed_at"),
        "brand_id", "flavor", "size",
    )


@query("mkt02_period_presets", f"""
WITH {OBS_SQL}
SELECT period, count(*)::BIGINT AS observations, sum(detected_count)::BIGINT AS facings
FROM obs, (VALUES ('7', 7), ('30', 30), ('90', 90), ('all', NULL)) v(period, days)
WHERE days IS NULL OR (observed_at >= {AS_OF_SQL} - to_days(days) AND observed_at <= {AS_OF_SQL})
GROUP BY period""")
def mkt02(spark, d):
    obs = b.observations(spark, d)
    names = ("7", "30", "90", "all")
    inside = {n: m.period_filter(n, b.as_of()) for n in names}
    wide = obs.agg(
        *[F.count_if(inside[n]).alias(f"n_{n}") for n in names],
        *[F.sum(F.when(inside[n], F.col("detected_count"))).alias(f"f_{n}") for n in names],
    )
    lines = F.array(*[
        F.struct(F.lit(n).alias("period"), F.col(f"n_{n}").alias("observations"),
                 F.col(f"f_{n}").alias("facings"))
        for n in names
    ])
    return wide.select(F.inline(lines)).where(F.col("observations") > 0)


@query("mkt03_carried_pairs", f"""
WITH {OBS_SQL}
SELECT product_id, store_id, sum(detected_count)::BIGINT AS count, round(sum(shelf_area), 2) AS area,
       strftime(max(observed_at), {TS}) AS last, round(arg_max(confidence, (observed_at, confidence)), 6) AS confidence
FROM obs GROUP BY ALL""")
def mkt03(spark, d):
    return m.carried_pairs_with_confidence(b.observations(spark, d)).select(
        "product_id", "store_id", "count", *r2("area"), stamp("last"), *r6("confidence")
    )


@query("mkt04_kpis", f"""
WITH {MARKET_SQL}, {JOINED}, k AS (SELECT * FROM j WHERE {SOME_SQL})
SELECT count(DISTINCT product_id)::BIGINT AS products, count(DISTINCT store_id)::BIGINT AS stores,
       count(DISTINCT district)::BIGINT AS regions, count(*)::BIGINT AS observations,
       round(sum(shelf_area), 2) AS total_area, sum(detected_count)::BIGINT AS total_facings,
       round(sum(shelf_area) / (sum(detected_count) * 240) * 100, 4) AS area_index
FROM k JOIN stores USING (store_id)""")
def mkt04(spark, d):
    obs, p, _ = opb(spark, d)
    return m.kpis(obs, p, b.stores(spark, d), SOME).select(
        "products", "stores", "regions", "observations", *r2("total_area"), "total_facings",
        F.round("area_index", 4).alias("area_index"),
    )


@query("mkt05_period_delta", f"""
WITH {MARKET_SQL}, {JOINED}, e AS (SELECT epoch_us(observed_at) AS t, observed_at FROM j WHERE flavor = 'ECONOMY'),
c AS (SELECT count(*) AS current, min(t) AS lo, greatest(1000, max(t) - min(t)) AS span FROM e
      WHERE observed_at >= TIMESTAMP '1999-01-01' AND observed_at <= TIMESTAMP '2000-12-31')
SELECT current::BIGINT AS current, previous::BIGINT AS previous,
       round(CASE WHEN previous > 0 THEN (current - previous) / previous::DOUBLE * 100 ELSE 0 END, 6) AS delta_pct
FROM c, (SELECT count(*) AS previous FROM e, c WHERE t >= lo - span AND t < lo)""")
def mkt05(spark, d):
    obs, p, _ = opb(spark, d)
    f = Filters(flavor="ECONOMY", date_from=datetime(1999, 1, 1), date_to=datetime(2000, 12, 31))
    return m.period_delta(obs, p, f).select("current", "previous", *r6("delta_pct"))


@query("mkt06_brand_presence", f"""
WITH {MARKET_SQL}, {JOINED}
SELECT brand_id, coalesce(stores, 0)::BIGINT AS stores, coalesce(observations, 0)::BIGINT AS observations
FROM (SELECT DISTINCT brand_id FROM products) LEFT JOIN
     (SELECT brand_id, count(DISTINCT store_id) AS stores, count(*) AS observations FROM j GROUP BY 1)
USING (brand_id)""")
def mkt06(spark, d):
    return m.brand_presence(*opb(spark, d))


SHARE_SQL = """SELECT brand_id, facings::BIGINT AS facings, round(area, 2) AS area,
       round(CASE WHEN tf > 0 THEN facings / tf::DOUBLE * 100 ELSE 0 END, 6) AS facings_pct,
       round(CASE WHEN ta > 0 THEN area / ta * 100 ELSE 0 END, 6) AS area_pct
FROM (SELECT *, sum(facings) OVER () AS tf, sum(area) OVER () AS ta FROM (
  SELECT brand_id, coalesce(facings, 0) AS facings, coalesce(area, 0) AS area
  FROM (SELECT DISTINCT brand_id FROM products) LEFT JOIN
       (SELECT brand_id, sum(detected_count) AS facings, sum(shelf_area) AS area FROM j {where} GROUP BY 1)
  USING (brand_id)))"""


@query("mkt07_brand_share", f"WITH {MARKET_SQL}, {JOINED} " + SHARE_SQL.format(where=""))
def mkt07(spark, d):
    return m.brand_share(*opb(spark, d)).select(
        "brand_id", "facings", *r2("area"), *r6("facings_pct", "area_pct")
    )


@query("mkt07_brand_share_filtered", f"WITH {MARKET_SQL}, {JOINED} "
       + SHARE_SQL.format(where="WHERE brand_id = 'Brand#7' AND size <= 50"))
def mkt07_filtered(spark, d):
    return m.brand_share(*opb(spark, d), Filters(brand_id="Brand#7")).select(
        "brand_id", "facings", *r2("area"), *r6("facings_pct", "area_pct")
    )


@query("mkt08_market_coverage", f"""
WITH {MARKET_SQL}, {JOINED}, k AS (SELECT * FROM j WHERE {SOME_SQL})
SELECT brand_id, coalesce(n, 0)::BIGINT AS stores,
       round(coalesce(n, 0) / (SELECT CASE WHEN count(*) > 0 THEN count(DISTINCT store_id)
                               ELSE (SELECT count(*) FROM stores) END FROM k)::DOUBLE * 100, 6) AS coverage
FROM (SELECT DISTINCT brand_id FROM products) LEFT JOIN
     (SELECT brand_id, count(DISTINCT store_id) AS n FROM k GROUP BY 1) USING (brand_id)""")
def mkt08(spark, d):
    obs, p, br = opb(spark, d)
    return m.market_coverage(obs, p, br, b.stores(spark, d), SOME).select(
        "brand_id", "stores", *r6("coverage")
    )


WEEK_SQL = f"floor(floor((epoch_us({AS_OF_SQL}) - epoch_us(observed_at)) / 86400000000.0) / 7)::BIGINT"


@query("mkt09_weekly_trend", f"""
WITH {MARKET_SQL}, w AS (SELECT brand_id, {WEEK_SQL} AS week, sum(detected_count) AS count
  FROM obs JOIN products USING (product_id) GROUP BY ALL),
dense AS (SELECT brand_id, week FROM (SELECT DISTINCT brand_id FROM products), range(12) r(week))
SELECT brand_id, (11 - week)::BIGINT AS bucket, coalesce(count, 0)::BIGINT AS count,
       sum(coalesce(count, 0)) OVER (PARTITION BY week)::BIGINT AS total
FROM dense LEFT JOIN w USING (brand_id, week)""")
def mkt09(spark, d):
    return m.weekly_trend(*opb(spark, d), b.as_of())


@query("mkt10_top_products", f"""
WITH {OBS_SQL}
SELECT product_id, sum(detected_count)::BIGINT AS count, count(DISTINCT store_id)::BIGINT AS stores,
       strftime(max(observed_at), {TS}) AS last
FROM obs GROUP BY 1 ORDER BY count DESC, product_id LIMIT 10""")
def mkt10(spark, d):
    obs, p, _ = opb(spark, d)
    return m.top_products(obs, p).select("product_id", "count", "stores", stamp("last"))


@query("mkt11_product_list", f"""
WITH {PRODUCTS_SQL}, {OBS_SQL}, a AS (
  SELECT product_id, count(DISTINCT store_id) AS stores, count(*) AS observations,
         sum(detected_count) AS count, sum(shelf_area) AS area, max(observed_at) AS last FROM obs GROUP BY 1)
SELECT product_id, coalesce(stores, 0)::BIGINT AS stores, coalesce(observations, 0)::BIGINT AS observations,
       coalesce(count, 0)::BIGINT AS count, round(coalesce(area, 0), 2) AS area, strftime(last, {TS}) AS last,
       round(coalesce(area, 0) / t * 100, 6) AS share,
       CASE WHEN coalesce(area, 0) / t * 100 > 8 THEN 'growth driver' WHEN coalesce(area, 0) / t * 100 > 3
            THEN 'stable' ELSE 'needs attention' END AS status
FROM products LEFT JOIN a USING (product_id), (SELECT sum(shelf_area) AS t FROM obs)""")
def mkt11(spark, d):
    obs, p, _ = opb(spark, d)
    return m.product_list(obs, p).select(
        "product_id", "stores", "observations", "count", *r2("area"), stamp("last"),
        *r6("share"), "status",
    )


@query("mkt12_product_detail", f"""
WITH {OBS_SQL}, s AS (SELECT store_id, sum(shelf_area) AS store_area FROM obs GROUP BY 1),
c AS (SELECT product_id, store_id, sum(detected_count) AS n, sum(shelf_area) AS area, max(observed_at) AS last
      FROM obs GROUP BY 1, 2),
g AS (SELECT product_id, count(*) AS coverage, sum(n) AS detections, sum(area) AS own, sum(store_area) AS whole,
             max(last) AS last_seen FROM c JOIN s USING (store_id) GROUP BY 1)
SELECT product_id, coverage::BIGINT AS coverage, detections::BIGINT AS detections, round(own, 2) AS own_area,
       round(whole, 2) AS carried_area, strftime(last_seen, {TS}) AS last_seen, round(own / whole * 100, 6) AS share,
       CASE WHEN own / whole * 100 > 12 THEN 'growth driver' WHEN own / whole * 100 > 5 THEN 'stable'
            ELSE 'needs attention' END AS status
FROM g""")
def mkt12(spark, d):
    return m.product_share_where_carried(b.observations(spark, d)).select(
        "product_id", "coverage", "detections", *r2("own_area", "carried_area"),
        stamp("last_seen"), *r6("share"), "status",
    )


@query("mkt13_product_trend", f"""
WITH {PRODUCTS_SQL}, {OBS_SQL}, w AS (SELECT product_id, {WEEK_SQL} AS week, sum(detected_count) AS count
  FROM obs GROUP BY ALL)
SELECT product_id, (11 - r.week)::INTEGER AS bucket, coalesce(count, 0)::BIGINT AS count
FROM products CROSS JOIN range(12) r(week) LEFT JOIN w USING (product_id, week)""")
def mkt13(spark, d):
    obs, p, _ = opb(spark, d)
    return m.product_weekly_trend(obs, p, b.as_of())


@query("mkt14_competitors", f"""
WITH {OBS_SQL}, c AS (SELECT DISTINCT product_id, store_id FROM obs),
n AS (SELECT a.product_id, z.product_id AS competitor_id, count(*) AS stores
      FROM c a JOIN c z ON a.store_id = z.store_id AND a.product_id <> z.product_id GROUP BY ALL)
SELECT product_id, competitor_id, stores::BIGINT AS stores,
       row_number() OVER (PARTITION BY product_id ORDER BY stores DESC, competitor_id)::BIGINT AS rank
FROM n QUALIFY rank <= 6""")
def mkt14(spark, d):
    return m.competitors(b.observations(spark, d))


@query("mkt15_recent_observations", f"""
WITH {OBS_SQL}
SELECT product_id, store_id, detected_count, round(shelf_area, 2) AS shelf_area, round(confidence, 6) AS confidence,
       strftime(observed_at, {TS}) AS observed_at,
       row_number() OVER (PARTITION BY product_id ORDER BY observed_at DESC, store_id, detected_count DESC,
                          shelf_area DESC, confidence DESC)::BIGINT AS rank
FROM obs QUALIFY rank <= 6""")
def mkt15(spark, d):
    return m.recent_observations(b.observations(spark, d)).select(
        "product_id", "store_id", "detected_count", *r2("shelf_area"), *r6("confidence"),
        stamp("observed_at"), "rank",
    )


@query("mkt16_store_list", f"""
WITH {MARKET_SQL}, {JOINED}, k AS (SELECT * FROM j WHERE {SOME_SQL}),
bs AS (SELECT store_id, brand_id, sum(detected_count) AS n FROM k GROUP BY ALL),
lead AS (SELECT store_id, brand_id AS dominant FROM bs
         QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY n DESC, brand_id) = 1),
a AS (SELECT store_id, count(DISTINCT brand_id) AS brands, count(DISTINCT product_id) AS products,
             count(*) AS observations, max(observed_at) AS last FROM k GROUP BY 1)
SELECT store_id, district, brands::BIGINT AS brands, products::BIGINT AS products,
       observations::BIGINT AS observations, dominant, strftime(last, {TS}) AS last
FROM stores JOIN a USING (store_id) JOIN lead USING (store_id)""")
def mkt16(spark, d):
    obs, p, _ = opb(spark, d)
    return m.store_list(obs, p, b.stores(spark, d), SOME).select(
        "store_id", "district", "brands", "products", "observations", "dominant", stamp("last")
    )


@query("mkt17_store_brand_share", f"""
WITH {MARKET_SQL}, {JOINED},
g AS (SELECT store_id, brand_id, sum(detected_count) AS facings, sum(shelf_area) AS area, count(*) AS n,
             max(observed_at) AS last FROM j GROUP BY ALL)
SELECT store_id, brand_id, facings::BIGINT AS facings, round(area, 2) AS area,
       round(facings / sum(facings) OVER w::DOUBLE * 100, 6) AS facings_pct,
       round(area / sum(area) OVER w * 100, 6) AS area_pct,
       strftime(max(last) OVER w, {TS}) AS last_inspection, (sum(n) OVER w)::BIGINT AS observations,
       row_number() OVER (PARTITION BY store_id ORDER BY facings DESC, brand_id) = 1 AS dominant
FROM g WINDOW w AS (PARTITION BY store_id)""")
def mkt17(spark, d):
    obs, p, _ = opb(spark, d)
    return m.store_brand_share(obs, p).select(
        "store_id", "brand_id", "facings", *r2("area"), *r6("facings_pct", "area_pct"),
        stamp("last_inspection"), "observations", "dominant",
    )


@query("mkt18_missing_products", f"""
WITH {PRODUCTS_SQL}, {OBS_SQL}, s AS (SELECT DISTINCT store_id, product_id FROM obs),
br AS (SELECT DISTINCT store_id, brand_id FROM s JOIN products USING (product_id))
SELECT store_id, product_id, brand_id FROM br JOIN products USING (brand_id)
WHERE (store_id, product_id) NOT IN (SELECT (store_id, product_id) FROM s)""")
def mkt18(spark, d):
    obs, p, _ = opb(spark, d)
    return m.missing_products(obs, p)


KM_SQL = """(6371.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h)))"""
NEAR_SQL = f"""hav AS (
  SELECT a.store_id, z.store_id AS other_id,
         pow(sin(radians(z.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(z.lat))
           * pow(sin(radians(z.lng - a.lng) / 2), 2) AS h
  FROM stores a JOIN stores z ON a.store_id <> z.store_id),
near AS (SELECT store_id, other_id, {KM_SQL} AS km,
         row_number() OVER (PARTITION BY store_id ORDER BY round({KM_SQL}, 9), other_id)::BIGINT AS rank
         FROM hav WHERE {KM_SQL} <= {{km}})"""


@query("mkt19_distribution_opportunities", f"""
WITH {STORES_SQL}, {OBS_SQL}, {NEAR_SQL.format(km=4)},
mine AS (SELECT DISTINCT store_id, product_id FROM obs),
g AS (SELECT n.store_id, o.product_id, sum(o.detected_count) AS nearby_count,
             count(DISTINCT st.store_name) AS nearby_stores
      FROM near n JOIN obs o ON o.store_id = n.other_id JOIN stores st ON st.store_id = n.other_id
      LEFT JOIN mine m ON m.store_id = n.store_id AND m.product_id = o.product_id
      WHERE n.rank <= 6 AND m.store_id IS NULL GROUP BY ALL HAVING sum(o.detected_count) >= 4)
SELECT store_id, product_id, nearby_count::BIGINT AS nearby_count, nearby_stores::BIGINT AS nearby_stores,
       row_number() OVER (PARTITION BY store_id ORDER BY nearby_count DESC, product_id)::BIGINT AS rank
FROM g QUALIFY rank <= 6""")
def mkt19(spark, d):
    return m.distribution_opportunities(b.observations(spark, d), b.stores(spark, d), max_km=4.0)


@query("mkt20_opportunity_insights", f"""
WITH {MARKET_SQL}, {JOINED}, g AS (SELECT brand_id, district, sum(detected_count) AS n
  FROM j JOIN stores USING (store_id) GROUP BY ALL),
t AS (SELECT district, sum(n) AS whole FROM g GROUP BY 1),
x AS (SELECT br.brand_id, s.district, coalesce(g.n, 0) AS mine, coalesce(t.whole, 0) - coalesce(g.n, 0) AS comp
      FROM (SELECT DISTINCT brand_id FROM products) br CROSS JOIN (SELECT DISTINCT district FROM stores) s
      LEFT JOIN g USING (brand_id, district) LEFT JOIN t USING (district))
SELECT brand_id, district, mine::BIGINT AS mine, comp::BIGINT AS comp,
       CASE WHEN mine = 0 THEN 'critical' WHEN comp > mine * 3 THEN 'high' ELSE 'medium' END AS severity
FROM x WHERE comp > mine * 1.8 AND comp > 10 ORDER BY comp DESC, brand_id, district LIMIT 8""")
def mkt20(spark, d):
    return m.opportunity_insights(*opb(spark, d), b.stores(spark, d))


AREA_SQL = """area AS (SELECT district, coalesce(sum(n), 0)::BIGINT AS count, count(*)::BIGINT AS stores
  FROM stores LEFT JOIN (SELECT store_id, sum(detected_count) AS n FROM obs GROUP BY 1) USING (store_id)
  GROUP BY 1)"""


@query("mkt21_area_strength", f"WITH {STORES_SQL}, {OBS_SQL}, {AREA_SQL} SELECT * FROM area")
def mkt21(spark, d):
    obs, p, _ = opb(spark, d)
    return m.area_strength(obs, p, b.stores(spark, d))


@query("mkt22_strongest_weakest", f"""WITH {STORES_SQL}, {OBS_SQL}, {AREA_SQL}
(SELECT *, 'strong' AS side FROM area ORDER BY count DESC, district LIMIT 5) UNION ALL
(SELECT *, 'weak' AS side FROM area ORDER BY count, district LIMIT 5)""")
def mkt22(spark, d):
    obs, p, _ = opb(spark, d)
    return m.strongest_and_weakest(m.area_strength(obs, p, b.stores(spark, d)))


@query("mkt23_stores_missing_sku", f"""
WITH {MARKET_SQL}, p AS (SELECT product_id FROM products WHERE sku = 'SKU-3')
SELECT store_id, store_name, district FROM stores
WHERE store_id NOT IN (SELECT store_id FROM obs JOIN p USING (product_id))
  AND EXISTS (SELECT 1 FROM obs JOIN p USING (product_id))
ORDER BY store_id LIMIT 8""")
def mkt23(spark, d):
    obs, p, _ = opb(spark, d)
    return m.stores_missing(obs, p, b.stores(spark, d), "SKU-3")


@query("mkt24_brand_cards", f"""
WITH {MARKET_SQL}, {JOINED}, pp AS (SELECT brand_id, product_id, sum(detected_count) AS n FROM j GROUP BY ALL),
best AS (SELECT brand_id, product_id AS best FROM pp
         QUALIFY row_number() OVER (PARTITION BY brand_id ORDER BY n DESC, product_id) = 1),
worst AS (SELECT brand_id, product_id AS worst FROM pp
          QUALIFY row_number() OVER (PARTITION BY brand_id ORDER BY n, product_id DESC) = 1),
v AS (SELECT brand_id, count(DISTINCT store_id) AS stores, count(*) AS observations,
             count(DISTINCT district) AS districts, sum(detected_count) AS facings, sum(shelf_area) AS area
      FROM j JOIN stores USING (store_id) GROUP BY 1)
SELECT brand_id, skus::BIGINT AS skus, stores::BIGINT AS stores, observations::BIGINT AS observations,
       districts::BIGINT AS districts, facings::BIGINT AS facings, round(area, 2) AS area, best, worst
FROM (SELECT brand_id, count(*) AS skus FROM products GROUP BY 1) JOIN v USING (brand_id)
     JOIN best USING (brand_id) JOIN worst USING (brand_id)""")
def mkt24(spark, d):
    return m.brand_cards(*opb(spark, d), b.stores(spark, d)).select(
        "brand_id", "skus", "stores", "observations", "districts", "facings", *r2("area"),
        "best", "worst",
    )


@query("mkt25_brand_comparison", f"WITH {MARKET_SQL}, {JOINED} SELECT * FROM ("
       + SHARE_SQL.format(where="") + ") WHERE brand_id IN ('Brand#1', 'Brand#2', 'Brand#3')")
def mkt25(spark, d):
    shares = m.brand_share(*opb(spark, d))
    return m.compare_brands(shares, ["Brand#1", "Brand#2", "Brand#3"]).select(
        "brand_id", "facings", *r2("area"), *r6("facings_pct", "area_pct")
    )


@query("mkt26_table_search", f"""
WITH {PRODUCTS_SQL}, hit AS (SELECT * FROM products
  WHERE contains(lower(brand_id), 'eco') OR contains(lower(flavor), 'eco') OR contains(lower(label), 'eco')),
pg AS (SELECT least(3, greatest(1, ceil(count(*) / 10.0)) - 1)::BIGINT AS p FROM hit)
SELECT product_id, brand_id, flavor, size, label FROM (
  SELECT *, row_number() OVER (ORDER BY size DESC, product_id) AS rn FROM hit), pg
WHERE rn > p * 10 AND rn <= p * 10 + 10""")
def mkt26(spark, d):
    return m.search_page(
        b.products(spark, d), " Eco", ["brand_id", "flavor", "label"], "size", page=3,
        page_size=10, tie="product_id",
    ).select("product_id", "brand_id", "flavor", "size", "label")


@query("mkt27_report_geo", f"""WITH {STORES_SQL}, {OBS_SQL}, {AREA_SQL}
SELECT * FROM area ORDER BY count DESC, district LIMIT 12""")
def mkt27(spark, d):
    return m.report("geo", *opb(spark, d), b.stores(spark, d))


@query("mkt27_report_product", f"WITH {MARKET_SQL}, {JOINED} SELECT brand_id, facings, facings_pct FROM ("
       + SHARE_SQL.format(where="") + ")")
def mkt27_product(spark, d):
    return m.report("product", *opb(spark, d), b.stores(spark, d)).select(
        "brand_id", "facings", *r6("facings_pct")
    )


@query("mkt29_shelf_summary", f"""
WITH {PRED_SQL}
SELECT photo, count(*)::BIGINT AS detections,
       count(*) FILTER (product NOT IN ('low_confidence', 'unknown_beverage', 'non_beverage'))::BIGINT AS total_facings
FROM pred GROUP BY 1""")
def mkt29(spark, d):
    from ..model import LOW_CONFIDENCE, is_bucket

    p = b.predictions(spark, d)
    known = ~is_bucket(F.col("product")) & (F.col("product") != LOW_CONFIDENCE)
    return m.shelf_summary(p.select("photo", known.alias("known")))


@query("geo05_nearby_stores", f"""WITH {STORES_SQL}, {NEAR_SQL.format(km=8)}
SELECT store_id, other_id, round(km, 6) AS km, rank FROM near WHERE rank <= 5""")
def geo05(spark, d):
    return m.nearby_stores(b.stores(spark, d)).select("store_id", "other_id", *r6("km"), "rank")


POINTS_SQL = f"""points AS (SELECT store_id, lat, lng, count(*)::BIGINT AS observations,
    sum(detected_count)::BIGINT AS count, count(DISTINCT product_id)::BIGINT AS products,
    array_to_string(list_sort(list(DISTINCT brand_id)), ',') AS brands,
    array_to_string(list_sort(list(DISTINCT flavor)), ',') AS flavors,
    array_to_string(list_sort(list(DISTINCT size)), ',') AS sizes, strftime(max(observed_at), {TS}) AS last
  FROM j JOIN stores USING (store_id) GROUP BY ALL)"""


def _points(spark, d):
    obs, p, _ = opb(spark, d)
    return m.map_points(obs, p, b.stores(spark, d))


@query("geo06_map_points", f"""WITH {MARKET_SQL}, {JOINED}, {POINTS_SQL}
SELECT * REPLACE (round(lat, 6) AS lat, round(lng, 6) AS lng) FROM points""")
def geo06(spark, d):
    return _points(spark, d).select(
        "store_id", *r6("lat", "lng"), "observations", "count", "products",
        F.array_join("brands", ",").alias("brands"),
        F.array_join("flavors", ",").alias("flavors"),
        F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"),
        stamp("last"),
    )


@query("geo07_heat_bands", f"""WITH {MARKET_SQL}, {JOINED}, {POINTS_SQL},
t AS (SELECT store_id, count, count / greatest(1, max(count) OVER ())::DOUBLE AS t FROM points)
SELECT store_id, count, round(t, 6) AS intensity,
       CASE WHEN t > 0.75 THEN 'very high' WHEN t > 0.5 THEN 'high' WHEN t > 0.3 THEN 'medium' ELSE 'low' END AS band
FROM t""")
def geo07(spark, d):
    points = _points(spark, d).select("store_id", "count")
    return m.heat_bands(points).select("store_id", "count", *r6("intensity"), "band")


@query("geo08_map_scope", f"""WITH {MARKET_SQL}, {JOINED}, {POINTS_SQL}, {NEAR_SQL.format(km=4)}
SELECT s.store_id, s.other_id, p.observations, p.count, p.products
FROM (SELECT store_id, other_id FROM near WHERE rank <= 8 UNION ALL SELECT store_id, store_id FROM stores) s
     JOIN points p ON p.store_id = s.other_id""")
def geo08(spark, d):
    return m.map_scope(_points(spark, d), b.stores(spark, d)).select(
        "store_id", "other_id", "observations", "count", "products"
    )
