"""Share-of-shelf and box queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lab
from ..operators import geometry as g
from ..operators import share as s
from ..sources import bindings as b
from ..sources.bindings import PRED_SQL, PRODUCTS_SQL
from .market import r2, r6
from .registry import query

COUNTED = "product <> 'low_confidence' AND NOT starts_with(product, 'non_beverage')"


@query("sos01_bucket_predicates", f"""
WITH {PRED_SQL}
SELECT product, starts_with(product, 'non_beverage') AS is_non_product, product = 'unknown_beverage' AS is_unknown,
       starts_with(product, 'non_beverage') OR product = 'unknown_beverage' AS is_bucket, count(*)::BIGINT AS n
FROM pred GROUP BY ALL""")
def sos01(spark, d):
    counts = b.predictions(spark, d).groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    return s.label_kinds(counts)


@query("sos02_facings", f"""
WITH {PRED_SQL}
SELECT product, count(*)::BIGINT AS facings, round(sum(area), 2) AS area FROM pred WHERE {COUNTED} GROUP BY 1""")
def sos02(spark, d):
    return s.facings(b.predictions(spark, d)).select("product", "facings", *r2("area"))


@query("sos03_share", f"""
WITH {PRED_SQL}, f AS (SELECT product, count(*) AS facings, sum(area) AS area FROM pred WHERE {COUNTED} GROUP BY 1)
SELECT product, facings::BIGINT AS facings, round(area, 2) AS area,
       round(facings / sum(facings) OVER ()::DOUBLE, 6) AS share_by_facings,
       round(area / sum(area) OVER (), 6) AS share_by_space
FROM f""")
def sos03(spark, d):
    return s.share_of_shelf(b.predictions(spark, d)).select(
        "product", "facings", *r2("area"), *r6("share_by_facings", "share_by_space")
    )


SUMMARY_SQL = f"""count(*)::BIGINT AS total, count(*) FILTER ({COUNTED})::BIGINT AS identified,
       count(*) FILTER (product = 'low_confidence')::BIGINT AS unidentified,
       count(*) FILTER (starts_with(product, 'non_beverage'))::BIGINT AS skipped"""


@query("sos04_run_summary", f"WITH {PRED_SQL} SELECT photo, {SUMMARY_SQL} FROM pred GROUP BY 1")
def sos04(spark, d):
    return s.run_summary(b.predictions(spark, d), ("photo",))


@query("sos05_crop_status", f"""
WITH {PRED_SQL}
SELECT photo, product, round(area, 2) AS area, round(score, 4) AS score,
       CASE product WHEN 'low_confidence' THEN 'low_confidence' WHEN 'unknown_beverage' THEN 'unknown'
            ELSE 'identified' END AS status
FROM pred WHERE NOT starts_with(product, 'non_beverage')""")
def sos05(spark, d):
    return s.session_crops(b.predictions(spark, d)).select(
        "photo", "product", *r2("area"), "score", "status"
    )


@query("sos06_session_share", f"""
WITH {PRED_SQL}, f AS (SELECT photo, product, count(*) AS facings, sum(area) AS area FROM pred
                       WHERE {COUNTED} GROUP BY ALL)
SELECT photo, product, facings::BIGINT AS facings, round(area, 2) AS area,
       round(facings / sum(facings) OVER w::DOUBLE, 6) AS share_by_facings,
       round(area / sum(area) OVER w, 6) AS share_by_space
FROM f WINDOW w AS (PARTITION BY photo)""")
def sos06(spark, d):
    # Compared before the four-decimal rounding of session_share, which ties can split.
    return s.share_of_shelf(b.predictions(spark, d), ("photo",)).select(
        "photo", "product", "facings", *r2("area"), *r6("share_by_facings", "share_by_space")
    )


PARTS_SQL = """split_part({c}, '_', 1) AS brand,
       CASE WHEN len(split({c}, '_')) > 1 THEN split({c}, '_')[2] ELSE 'unknown' END AS size,
       CASE WHEN len(split({c}, '_')) > 2 THEN array_to_string(split({c}, '_')[3:], '_') ELSE 'unknown' END AS flavor"""


@query("sos07_report_label_parts", f"""
WITH {PRODUCTS_SQL} SELECT product_id, label, {PARTS_SQL.format(c='label')} FROM products""")
def sos07(spark, d):
    p = b.products(spark, d)
    return p.select("product_id", "label", lab.report_parts(F.col("label")).alias("p")).select(
        "product_id", "label", "p.*"
    )


@query("sos08_report_shares", f"""
WITH {PRED_SQL}, r AS (SELECT product, split_part(product, '_', 1) AS brand FROM pred
                       WHERE product NOT IN ('low_confidence', 'unknown'))
SELECT level, name, count::BIGINT AS count, round(count / (SELECT count(*) FROM r)::DOUBLE * 100, 6) AS share_pct
FROM (SELECT 'product' AS level, product AS name, count(*) AS count FROM r GROUP BY 2
      UNION ALL SELECT 'brand', brand, count(*) FROM r GROUP BY 2)""")
def sos08(spark, d):
    return s.report_shares(b.predictions(spark, d)).select("level", "name", "count", *r6("share_pct"))


@query("sos09_brand_detections", f"""
WITH {PRED_SQL}
SELECT photo, split_part(product, '_', 1) AS brand, count(*)::BIGINT AS crops FROM pred
WHERE product NOT IN ('low_confidence', 'unknown_beverage') AND NOT starts_with(product, 'non_beverage')
GROUP BY ALL""")
def sos09(spark, d):
    return s.brand_detections(s.session_crops(b.predictions(spark, d)), ("photo",))


@query("sos09_detection_counters", f"""
WITH {PRED_SQL}
SELECT photo, count(*) FILTER (product <> 'unknown_beverage')::BIGINT AS detected,
       count(*) FILTER (product = 'unknown_beverage')::BIGINT AS unknown
FROM pred WHERE NOT starts_with(product, 'non_beverage') GROUP BY 1""")
def sos09_counters(spark, d):
    return s.detection_counters(s.session_crops(b.predictions(spark, d)), ("photo",))


@query("sos10_localised_labels", f"""
WITH {PRODUCTS_SQL}, br AS (SELECT DISTINCT replace(lower(p_brand), '#', '') AS code, upper(p_brand) AS name FROM part),
sz AS (SELECT DISTINCT p_size || 'ml' AS code, p_size || ' ml' AS name FROM part WHERE p_size <= 40),
fl AS (SELECT DISTINCT lower(p_type) AS code, p_type || '!' AS name FROM part WHERE p_type <> 'PROMO')
SELECT product_id, CASE WHEN ok THEN b END AS brand_name, CASE WHEN ok THEN s END AS size_name,
       CASE WHEN ok THEN f END AS flavor_name
FROM (SELECT product_id, br.name AS b, sz.name AS s, fl.name AS f,
             br.name IS NOT NULL AND sz.name IS NOT NULL AND fl.name IS NOT NULL AS ok
      FROM products LEFT JOIN br ON br.code = split_part(label, '_', 1)
      LEFT JOIN sz ON sz.code = split_part(label, '_', 2) LEFT JOIN fl ON fl.code = split_part(label, '_', 3))""")
def sos10(spark, d):
    part = b.table(spark, d, "part")
    brands = part.select(
        F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")).alias("code"),
        F.upper("p_brand").alias("name"),
    ).distinct()
    sizes = part.where("p_size <= 40").select(
        F.concat(F.col("p_size").cast("string"), F.lit("ml")).alias("code"),
        F.concat(F.col("p_size").cast("string"), F.lit(" ml")).alias("name"),
    ).distinct()
    flavours = part.where("p_type <> 'PROMO'").select(
        F.lower("p_type").alias("code"), F.concat("p_type", F.lit("!")).alias("name")
    ).distinct()
    labels = b.products(spark, d).select("product_id", "label")
    return lab.localised(labels, brands, sizes, flavours).drop("label")


BOX_SQL = """box AS (
  SELECT l_orderkey AS photo, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_tax,
         l_discount, l_returnflag, l_linestatus, 1.0::DOUBLE - l_discount * 8 AS conf,
         (l_partkey % 900)::DOUBLE + 0.5::DOUBLE AS x1, (l_suppkey % 500)::DOUBLE + 0.25::DOUBLE AS y1,
         (l_partkey % 900)::DOUBLE + l_quantity * 4 AS x2, (l_suppkey % 500)::DOUBLE + l_quantity * 6 AS y2
  FROM lineitem)"""
BOX_ORDER = """l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
               l_returnflag, l_linestatus"""


def _boxes(spark, d):
    li = b.table(spark, d, "lineitem")
    x, y = (F.col("l_partkey") % 900).cast("double"), (F.col("l_suppkey") % 500).cast("double")
    return li.select(
        "*",
        F.col("l_orderkey").alias("photo"),
        (F.lit(1.0) - F.col("l_discount") * 8).alias("conf"),
        (x + 0.5).alias("x1"),
        (y + 0.25).alias("y1"),
        (x + F.col("l_quantity") * 4).alias("x2"),
        (y + F.col("l_quantity") * 6).alias("y2"),
    )


def _numbered(spark, d):
    fine = [
        F.col(c)
        for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
                  "l_returnflag", "l_linestatus")
    ]
    coarse = [F.col("l_linenumber"), F.col("l_shipdate")]
    return g.number_boxes(_boxes(spark, d), coarse, fine).withColumns(
        {"img_w": F.lit(1000), "img_h": F.lit(700)}
    )


# Every step of the recursion is the first merge of a round that is still open, or opens the next
# round for a photo that had one; a box that took part in the round is marked until then.
MERGED_SQL = f"""num AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY {BOX_ORDER}) - 1 AS idx FROM box),
state AS (
  SELECT photo, 0 AS step,
         list({{'idx': idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf, 'used': false}} ORDER BY idx) AS boxes
  FROM num GROUP BY photo
  UNION ALL
  SELECT photo, step + 1,
         CASE WHEN pick IS NULL THEN list_transform(boxes, lambda q: struct_update(q, used := false))
         ELSE list_transform(list_filter(boxes, lambda q, k: k <> pick.j), lambda q, k: CASE WHEN k <> pick.i THEN q ELSE
           {{'idx': q.idx, 'x1': least(q.x1, boxes[pick.j].x1), 'y1': least(q.y1, boxes[pick.j].y1),
            'x2': greatest(q.x2, boxes[pick.j].x2), 'y2': greatest(q.y2, boxes[pick.j].y2),
            'conf': greatest(q.conf, boxes[pick.j].conf), 'used': true}} END) END
  FROM (
    SELECT photo, step, boxes, list_filter(
      flatten(list_transform(range(1, len(boxes) + 1), lambda i: list_transform(range(i + 1, len(boxes) + 1),
        lambda j: {{'i': i, 'j': j, 'a': boxes[i], 'b': boxes[j]}}))),
      lambda p: NOT p.a.used AND NOT p.b.used
        AND least(p.a.x2 - p.a.x1, p.b.x2 - p.b.x1) > 0 AND least(p.a.y2 - p.a.y1, p.b.y2 - p.b.y1) > 0
        AND greatest(0, least(p.a.x2, p.b.x2) - greatest(p.a.x1, p.b.x1)) / least(p.a.x2 - p.a.x1, p.b.x2 - p.b.x1) >= 0.80::DOUBLE
        AND least(p.a.x2 - p.a.x1, p.b.x2 - p.b.x1) / greatest(p.a.x2 - p.a.x1, p.b.x2 - p.b.x1) >= 0.75::DOUBLE
        AND (greatest(p.a.y1, p.b.y1) - least(p.a.y2, p.b.y2)) / least(p.a.y2 - p.a.y1, p.b.y2 - p.b.y1) <= 0.05::DOUBLE
        AND (greatest(p.a.y2, p.b.y2) - least(p.a.y1, p.b.y1)) / (greatest(p.a.x2, p.b.x2) - least(p.a.x1, p.b.x1)) <= 6.0::DOUBLE
    )[1] AS pick
    FROM state)
  WHERE pick IS NOT NULL OR len(list_filter(boxes, lambda q: q.used)) > 0),
last AS (SELECT photo, unnest(boxes, recursive := true) FROM state QUALIFY row_number() OVER (PARTITION BY photo ORDER BY step DESC) = 1)"""


@query("geo01_merged_boxes", f"""
WITH RECURSIVE {BOX_SQL}, {MERGED_SQL}
SELECT photo, idx, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(conf, 6) AS conf FROM last""")
def geo01(spark, d):
    return g.merge_adjacent_boxes(_numbered(spark, d)).select(
        "photo", "idx", *r6("x1", "y1", "x2", "y2", "conf")
    )


@query("geo02_confident_boxes", f"""
WITH {BOX_SQL} SELECT photo, count(*)::BIGINT AS n, round(min(conf), 6) AS least FROM box WHERE round(conf, 6) >= 0.5 GROUP BY 1""")
def geo02(spark, d):
    boxes = _boxes(spark, d).withColumn("conf", F.round("conf", 6))
    return g.confident(boxes).groupBy("photo").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("conf"), 6).alias("least")
    )


CROP_SQL = f"""num AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY {BOX_ORDER}) - 1 AS idx FROM box),
crop AS (SELECT photo || '-' || idx AS crop, photo AS source_photo, greatest(0, trunc(x1)::INTEGER - 2) AS x1,
                greatest(0, trunc(y1)::INTEGER - 2) AS y1, least(1000, trunc(x2)::INTEGER + 2) AS x2,
                least(700, trunc(y2)::INTEGER + 2) AS y2 FROM num)"""


@query("geo03_crop_boxes", f"""
WITH {BOX_SQL}, {CROP_SQL}
SELECT *, greatest(0, x2 - x1)::BIGINT * greatest(0, y2 - y1)::BIGINT AS area FROM crop""")
def geo03(spark, d):
    return g.crop_boxes(_numbered(spark, d))


@query("geo04_percent_boxes", f"""
WITH {BOX_SQL}, {CROP_SQL}
SELECT crop, round(x1 / 1000.0::DOUBLE * 100, 6) AS x_pct, round(y1 / 700.0::DOUBLE * 100, 6) AS y_pct,
       round((x2 - x1) / 1000.0::DOUBLE * 100, 6) AS w_pct, round((y2 - y1) / 700.0::DOUBLE * 100, 6) AS h_pct
FROM crop""")
def geo04(spark, d):
    crops = g.crop_boxes(_numbered(spark, d)).withColumns({"img_w": F.lit(1000), "img_h": F.lit(700)})
    return g.percent_boxes(crops).select("crop", *r6("x_pct", "y_pct", "w_pct", "h_pct"))
