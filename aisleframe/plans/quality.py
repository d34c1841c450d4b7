"""Reference-set hygiene, scalar functions and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..functions.labels import brand_and_flavour
from ..functions.vectors import cosine
from ..operators import evaluation as ev
from ..operators import quality as q
from ..runtime import scratch_path
from ..sources import bindings as b
from ..sources.bindings import AS_OF_SQL, CROPS_SQL, PRODUCTS_SQL, STORES_SQL
from ..sources.snapshots import Snapshots
from ..streaming import sessions
from .market import r2, r6
from .registry import query


def _docs(spark, d):
    """Labelled documents play the test set, the others the reference set."""
    docs = b.table(spark, d, "documents").select("doc_id", "text", "lang")
    tested = b.table(spark, d, "labels").select("doc_id").distinct()
    path = F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    named = docs.withColumn("path", path)
    return named.join(tested, "doc_id", "left_semi"), named.join(tested, "doc_id", "left_anti")


@query("dq02_leaked_content", """
WITH d AS (SELECT 'doc/' || lpad(doc_id::VARCHAR, 12, '0') AS path, md5(text) AS hash,
                  doc_id IN (SELECT doc_id FROM labels) AS tested FROM documents),
kb AS (SELECT hash, min(path) AS kb_path FROM d WHERE NOT tested GROUP BY 1)
SELECT path, hash, kb_path FROM d JOIN kb USING (hash) WHERE tested""")
def dq02(spark, d):
    test, kb = _docs(spark, d)
    return q.leaked_content(test, kb, content="text")


PHOTO_SQL = "ph AS (SELECT (doc_id // 10)::BIGINT AS photo, lang FROM documents)"


def _photos(spark, d):
    docs = b.table(spark, d, "documents")
    return docs.select(F.floor(F.col("doc_id") / 10).cast("long").alias("photo"), "lang")


@query("dq03_shared_sources", f"""
WITH {PHOTO_SQL}
SELECT photo, count(*)::BIGINT AS test_rows FROM ph
WHERE lang <> 'es' AND photo IN (SELECT photo FROM ph WHERE lang = 'es') GROUP BY 1""")
def dq03(spark, d):
    ph = _photos(spark, d)
    return q.shared_sources(ph.where("lang <> 'es'"), ph.where("lang = 'es'"))


@query("dq04_source_split", f"""
WITH {PHOTO_SQL}
SELECT photo, bool_or(lang = 'es') AS used FROM ph GROUP BY 1""")
def dq04(spark, d):
    ph = _photos(spark, d)
    return q.split_photos(ph, ph.where("lang = 'es'"))


@query("dq05_thin_classes", f"""
WITH {CROPS_SQL}, c AS (SELECT label || '/' || photo AS label, count(*)::BIGINT AS n FROM crops GROUP BY 1)
SELECT label, n FROM c WHERE n < 2""")
def dq05(spark, d):
    rows = b.crops(spark, d).select(F.concat_ws("/", "label", F.col("photo").cast("string")).alias("label"))
    return q.thin_classes(rows)


@query("dq05_class_counts", f"WITH {CROPS_SQL} SELECT label, count(*)::BIGINT AS n FROM crops GROUP BY 1")
def dq05_counts(spark, d):
    return q.class_counts(b.crops(spark, d))


AUDIT_SQL = f"""{PHOTO_SQL}, known AS (SELECT DISTINCT photo FROM ph WHERE lang = 'es'),
a AS (SELECT photo AS "group", count(*)::BIGINT AS n, count(DISTINCT lang)::BIGINT AS classes,
             array_to_string(list_sort(list(DISTINCT lang)), ',') AS class_names FROM ph GROUP BY 1),
audit AS (SELECT a.*, CASE WHEN classes <= 1 THEN 'single' WHEN known.photo IS NOT NULL THEN 'expected'
                 ELSE 'review' END AS flag, known.photo IS NULL AS unconfirmed
          FROM a LEFT JOIN known ON known.photo = a."group")"""


def _audit(spark, d):
    ph = _photos(spark, d)
    files = ph.select(F.col("photo").alias("group"), F.col("lang").alias("label"))
    return q.group_audit(files, ph.where("lang = 'es'").select("photo"))


@query("dq06_group_audit", f"WITH {AUDIT_SQL} SELECT * FROM audit")
def dq06(spark, d):
    return _audit(spark, d)


@query("dq06_audit_summary", f"""
WITH {AUDIT_SQL}
SELECT count(*)::BIGINT AS groups, count(*) FILTER (n = 1)::BIGINT AS singletons, max(n) AS largest,
       count(*) FILTER (classes > 1)::BIGINT AS multi_class, count(*) FILTER (unconfirmed)::BIGINT AS unconfirmed
FROM audit""")
def dq06_summary(spark, d):
    return q.audit_summary(_audit(spark, d))


def _pool_state(spark, d):
    """Every vector is a wanted file; the pool knows the even labels, some under another size."""
    e = b.table(spark, d, "embeddings")
    key, size = F.col("vec_id").cast("string"), F.size("embedding").cast("long")
    files = e.select(key.alias("key"), size.alias("size"), "embedding")
    pool = e.where("label IN (0, 2, 4, 6, 8)").select(
        key.alias("key"),
        F.when(F.col("label") == 4, size + 1).otherwise(size).alias("size"),
        F.when(F.col("label") == 6, F.lit("old")).otherwise(F.lit("m")).alias("model"),
        F.lit(1).alias("version"),
        "embedding",
    )
    return files, pool


@query("inc02_stale_keys", """
SELECT vec_id::VARCHAR AS key FROM embeddings WHERE label NOT IN (0, 2, 8)""")
def inc02(spark, d):
    files, pool = _pool_state(spark, d)
    return q.stale_keys(files, pool, "m", 1).select("key")


@query("inc02_updated_pool", """
SELECT vec_id::VARCHAR AS key, len(embedding)::BIGINT AS size, 'm' AS model, 1 AS version,
       round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def inc02_pool(spark, d):
    """The pool is committed, then updated; the rows are read through the second version's manifest."""
    files, pool = _pool_state(spark, d)
    folder = scratch_path(spark, "pool")
    Snapshots(spark, folder, q.POOL_SCHEMA).append(pool)
    out = q.commit_pool(spark, folder, files, lambda rows: rows.select("key", "size", "embedding"), "m", 1)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("key", "size", "model", "version", F.round(total, 6).alias("total"))


@query("inc03_matrix", """
SELECT vec_id::VARCHAR AS key, len(embedding)::INTEGER AS width FROM embeddings WHERE label IN (0, 2, 4, 6, 8)""")
def inc03(spark, d):
    files, pool = _pool_state(spark, d)
    rows = q.build_matrix(files.select("key"), pool, 64)
    return rows.select("key", F.size("embedding").alias("width"))


@query("inc04_sample_guard", f"""
WITH {CROPS_SQL} SELECT label, count(*)::BIGINT AS n, count(*) >= 40 AS enough FROM crops GROUP BY 1""")
def inc04(spark, d):
    return q.class_counts(b.crops(spark, d)).withColumn("enough", q.is_enough(F.col("n"), 40))


@query("fn01_cosine", f"""
WITH {CROPS_SQL}, p AS (SELECT * FROM crops)
SELECT id, round(list_cosine_similarity(vec, list_transform(vec, lambda x: x + 0.25::DOUBLE)), 6) AS sim FROM p""")
def fn01(spark, d):
    moved = F.transform("vec", lambda x: x.cast("double") + F.lit(0.25))
    return b.crops(spark, d).select("id", F.round(cosine(F.col("vec"), moved), 6).alias("sim"))


@query("fn03_haversine", f"""
WITH {STORES_SQL}, h AS (SELECT store_id, pow(sin(radians(lat - 36.2972) / 2), 2)
  + cos(radians(36.2972)) * cos(radians(lat)) * pow(sin(radians(lng - 59.6062) / 2), 2) AS h FROM stores)
SELECT store_id, round(6371 * 2 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM h""")
def fn03(spark, d):
    km = sc.haversine_km(F.lit(36.2972), F.lit(59.6062), F.col("lat"), F.col("lng"))
    return b.stores(spark, d).select("store_id", F.round(km, 6).alias("km"))


@query("fn04_jalali", """
WITH ny(jy, first_day) AS (VALUES
  (1370, DATE '1991-03-21'), (1371, DATE '1992-03-21'), (1372, DATE '1993-03-21'), (1373, DATE '1994-03-21'),
  (1374, DATE '1995-03-21'), (1375, DATE '1996-03-20'), (1376, DATE '1997-03-21'), (1377, DATE '1998-03-21'),
  (1378, DATE '1999-03-21'), (1379, DATE '2000-03-20'), (1380, DATE '2001-03-21'), (1381, DATE '2002-03-21')),
z AS (SELECT o_orderkey, jy, date_diff('day', first_day, o_orderdate::DATE) AS day
      FROM orders ASOF JOIN ny ON o_orderdate::DATE >= first_day)
SELECT o_orderkey, jy::INTEGER AS jy,
       (CASE WHEN day < 186 THEN 1 + day // 31 ELSE 7 + (day - 186) // 30 END)::INTEGER AS jm,
       (CASE WHEN day < 186 THEN 1 + day % 31 ELSE 1 + (day - 186) % 30 END)::INTEGER AS jd
FROM z""")
def fn04(spark, d):
    return b.table(spark, d, "orders").select(
        "o_orderkey", sc.jalali(F.col("o_orderdate")).alias("j")
    ).select("o_orderkey", "j.*")


@query("fn05_relative_age", f"""
WITH o AS (SELECT o_orderkey, floor((epoch_us({AS_OF_SQL}) - epoch_us(o_orderdate)) / 86400000000.0 + 0.5)::BIGINT AS n
           FROM orders)
SELECT o_orderkey, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 7 THEN n || ' days'
       WHEN n < 30 THEN (n // 7) || ' weeks' ELSE (n // 30) || ' months' END AS age FROM o""")
def fn05(spark, d):
    return b.table(spark, d, "orders").select(
        "o_orderkey", sc.relative_age(F.col("o_orderdate"), b.as_of()).alias("age")
    )


@query("fn06_path_parts", r"""
WITH p AS (SELECT page_id, split(url, '/') AS s FROM pages), n AS (SELECT page_id, s[-1] AS name, s[-2] AS parent FROM p)
SELECT page_id, parent, regexp_replace(name, '^(.+)\.[^.]+$', '\1') AS stem,
       lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) AS extension FROM n""")
def fn06(spark, d):
    url = F.col("url")
    return b.table(spark, d, "pages").select(
        "page_id",
        sc.file_parent(url).alias("parent"),
        sc.file_stem(url).alias("stem"),
        sc.file_extension(url).alias("extension"),
    )


@query("fn07_md5", "SELECT doc_id, md5(text) AS hash FROM documents")
def fn07(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))


@query("fn09_week_index", f"""
SELECT floor((epoch_us({AS_OF_SQL}) - epoch_us(l_shipdate)) / 86400000000.0)::BIGINT AS days,
       floor(floor((epoch_us({AS_OF_SQL}) - epoch_us(l_shipdate)) / 86400000000.0) / 7)::BIGINT AS week,
       count(*)::BIGINT AS n
FROM lineitem GROUP BY ALL""")
def fn09(spark, d):
    t = F.col("observed_at")
    return b.observations(spark, d).groupBy(
        sc.days_ago(t, b.as_of()).alias("days"), sc.week_index(t, b.as_of()).alias("week")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("fn10_ordered_unique", """
WITH w AS (SELECT p_partkey, list_filter(split(p_name || '  ' || lower(p_type) || ' ' || p_name, ' '), lambda x: x <> '') AS l
           FROM part)
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ',') AS words FROM w""")
def fn10(spark, d):
    words = F.split(F.concat("p_name", F.lit("  "), F.lower("p_type"), F.lit(" "), "p_name"), " ")
    return b.table(spark, d, "part").select(
        "p_partkey", F.array_join(sc.ordered_unique(words, 3), ",").alias("words")
    )


@query("evd02_normalised_text", r"""
SELECT doc_id, md5(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))) AS folded FROM documents""")
def evd02(spark, d):
    # The tables hold composed text only, so compatibility composition changes nothing here.
    return b.table(spark, d, "documents").select(
        "doc_id", F.md5(tx.normalise(F.col("text"))).alias("folded")
    )


@query("evd05_label_brand_flavour", f"""
WITH {PRODUCTS_SQL}
SELECT product_id, split_part(label, '_', 1) AS brand, split(label, '_')[-1] AS flavour FROM products""")
def evd05(spark, d):
    return b.products(spark, d).select(
        "product_id", brand_and_flavour(F.col("label")).alias("p")
    ).select("product_id", "p.*")


@query("eva01_inferred_sources", r"""
WITH p AS (SELECT page_id, split(url, '/')[-1] AS name, split(url, '/')[-2] AS cls FROM pages),
k0 AS (SELECT page_id, cls, trim(regexp_replace(regexp_replace(name, '^(.+)\.[^.]+$', '\1'),
             '\s*\(Edited(?:\s+\d+)?\)', '', 'gi')) AS stem FROM p),
known AS (SELECT DISTINCT stem, true AS known FROM k0 WHERE length(stem) % 2 = 0),
k AS (SELECT * FROM k0 LEFT JOIN known USING (stem))
SELECT page_id, CASE WHEN known THEN stem WHEN regexp_matches(stem, '^(.*?)-(\d+)$') THEN regexp_extract(stem, '^(.*?)-(\d+)$', 1)
       WHEN regexp_matches(stem, '(?i)^(.*)_(?:front|back)[a-z0-9]*$')
       THEN cls || '::' || regexp_extract(stem, '(?i)^(.*)_(?:front|back)[a-z0-9]*$', 1)
       ELSE cls || '::' || stem END AS "group"
FROM k""")
def eva01(spark, d):
    pages = b.table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    from .files import known_stems

    known = known_stems(pages)
    return ev.infer_source_photo(pages, known).select("page_id", "group")


@query("ss01_session_totals", """
SELECT session, product, facings, round(area, 2) AS area,
       round(facings / sum(facings) OVER (PARTITION BY session)::DOUBLE, 6) AS share_by_facings
FROM (SELECT user_id AS session, event_type AS product, count(*)::BIGINT AS facings, sum(value) AS area
      FROM events GROUP BY ALL)""")
def ss01(spark, d):
    schema = b.table(spark, d, "events").schema
    crops = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
        .select(
            F.col("user_id").alias("session"),
            F.col("event_type").alias("product"),
            F.col("value").alias("area"),
        )
    )
    totals = sessions.run_to_end(crops, scratch_path(spark, "sessions"))
    return sessions.session_shares(totals).select(
        "session", "product", "facings", *r2("area"), *r6("share_by_facings")
    )
