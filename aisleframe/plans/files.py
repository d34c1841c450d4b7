"""Sinks and sources: rows of the driver's tables are written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import CLUSTER_MIN_POINTS, PHOTO_EXTENSIONS
from ..operators import evaluation as ev
from ..operators import market as m
from ..operators import quality as q
from ..operators import share as sh
from ..runtime import scratch_path
from ..sources import bindings as b
from ..sources import readers, trees, writers
from ..sources.bindings import CROPS_SQL
from ..streaming import ingest
from .registry import query

NAMED_SQL = """named AS (SELECT 'crop-' || p_partkey AS crop, p_partkey AS id,
    CASE WHEN p_size % 9 = 0 THEN 'low_confidence' WHEN p_size % 9 = 1 THEN 'non_beverage_cup'
         ELSE lower(replace(p_brand, '#', '')) || '_' || p_size || 'ml_' || lower(p_type) END AS product,
    p_size::DOUBLE / 64 AS score, p_size, p_name FROM part)"""


def _named(spark, d):
    p = b.table(spark, d, "part")
    size = F.col("p_size")
    label = F.concat_ws(
        "_", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")),
        F.concat(size.cast("string"), F.lit("ml")), F.lower("p_type"),
    )
    return p.select(
        F.concat(F.lit("crop-"), F.col("p_partkey").cast("string")).alias("crop"),
        F.col("p_partkey").alias("id"),
        F.when(size % 9 == 0, F.lit("low_confidence"))
        .when(size % 9 == 1, F.lit("non_beverage_cup")).otherwise(label).alias("product"),
        (size.cast("double") / 64).alias("score"),
        "p_size", "p_name",
    )


def _page_files(spark, d, kinds):
    """A file per page: its url as content, in a folder of its class; every third has the next kind."""
    pages = b.table(spark, d, "pages")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_id") % len(kinds) + 1).cast("int"))
    return pages.select(
        (F.col("page_id") % 7).alias("class"), F.concat(F.lit("page-"), F.col("page_id"), kind).alias("name"),
        F.encode("url", "UTF-8").alias("content"),
    )


@query("src01_class_tree", """
SELECT 'shelf/class-' || page_id % 7 || '/page-' || page_id || '.jpg' AS key, strlen(url)::BIGINT AS size,
       'class-' || page_id % 7 AS label
FROM pages WHERE page_id % 3 <> 1""")
def src01(spark, d):
    root = scratch_path(spark, "tree")
    folder = F.concat(F.lit("shelf/class-"), F.col("class"))
    files = _page_files(spark, d, [".jpg", ".png", ".jpg"]).select(F.concat_ws("/", folder, "name").alias("key"), "content")
    trees.write_tree(files, root)
    return readers.class_tree(spark, root).select("key", "size", "label")


@query("src02_flat_folder", """
SELECT 'page-' || page_id || ['.jpg', '.JPEG', '.txt', '.Png'][page_id % 4 + 1] AS key, strlen(url)::BIGINT AS size, url AS content
FROM pages WHERE page_id % 4 <> 2 AND page_id % 7 <> 0""")
def src02(spark, d):
    root = scratch_path(spark, "folder")
    flat = F.when(F.col("class") > 0, F.col("name")).otherwise(F.concat(F.lit("deeper/"), F.col("name")))
    trees.write_tree(_page_files(spark, d, [".jpg", ".JPEG", ".txt", ".Png"]).select(flat.alias("key"), "content"), root)
    found = readers.flat_folder(spark, root, content=True)
    return found.select("key", "size", F.decode("content", "UTF-8").alias("content"))


@query("src03_predictions_file", f"""
WITH {NAMED_SQL} SELECT crop, product, round_even(score * 100, 0)::BIGINT || '%' AS confidence
FROM named WHERE product <> 'low_confidence'""")
def src03(spark, d):
    path = scratch_path(spark, "predictions")
    writers.predictions_csv(_named(spark, d).withColumn("source", F.lit("local")), path)
    return readers.predictions(spark, path)


@query("snk01_share_file", f"""
WITH {NAMED_SQL}, t AS (SELECT product, count(*) AS n FROM named GROUP BY 1), s AS (SELECT sum(n) AS whole FROM t)
SELECT product, n::VARCHAR AS facings, printf('%.4f', round_even((n / whole)::DECIMAL(38, 15), 4)) AS share_by_facings
FROM t, s""")
def snk01(spark, d):
    path = scratch_path(spark, "shares")
    counts = _named(spark, d).groupBy("product").agg(F.count(F.lit(1)).alias("facings"))
    whole = counts.agg(F.sum("facings").alias("whole"))
    share = F.col("facings") / F.col("whole")
    # One row of totals.
    rows = counts.join(F.broadcast(whole)).withColumns(
        {"share_by_facings": share, "share_by_space": F.lit(0.5)}
    )
    writers.share_csv(rows, path)
    back = spark.read.option("header", "true").csv(path)
    return back.select("product", "facings", "share_by_facings")


@query("src04_crop_manifest_file", """
SELECT 'crop-' || l_orderkey || '-' || l_linenumber AS crop, 'photo-' || (l_orderkey // 8) AS source_photo,
       l_linenumber::INTEGER AS x1, (l_linenumber + l_quantity)::INTEGER AS x2,
       (l_quantity * l_quantity)::BIGINT AS area FROM lineitem""")
def src04(spark, d):
    path = scratch_path(spark, "manifest")
    li = b.table(spark, d, "lineitem")
    x1, w = F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int")
    writers.crop_manifest_csv(li.select(
        F.concat_ws("-", F.lit("crop"), "l_orderkey", "l_linenumber").alias("crop"),
        F.concat(F.lit("photo-"), F.floor(F.col("l_orderkey") / 8).cast("string")).alias("source_photo"),
        x1.alias("x1"), F.lit(0).alias("y1"), (x1 + w).alias("x2"), w.alias("y2"),
        (w * w).cast("long").alias("area"),
    ), path)
    return readers.crop_manifest(spark, path).select("crop", "source_photo", "x1", "x2", "area")


@query("src05_provenance_file", """
SELECT 'img-' || vec_id || '.jpg' AS kb_file, 'photo ' || (vec_id // 4) AS source_photo FROM embeddings
WHERE vec_id % 5 <> 0""")
def src05(spark, d):
    path = scratch_path(spark, "provenance")
    e, i = b.table(spark, d, "embeddings"), F.col("vec_id")
    photo = F.concat(F.lit("photo "), F.floor(i / 4).cast("string"))
    writers.provenance_csv(e.select(
        F.concat(F.lit("img-"), i.cast("string"), F.lit(".jpg")).alias("kb_file"),
        F.when(i % 5 != 0, photo).alias("source_photo"),
    ), path)
    back = readers.provenance(spark, path)
    return back.where("recorded_at IS NOT NULL").select("kb_file", "source_photo")


@query("src06_ground_truth_file", f"""
WITH {NAMED_SQL} SELECT crop, product AS "group" FROM named WHERE p_size % 9 > 1""")
def src06(spark, d):
    path = scratch_path(spark, "truth")
    rows = _named(spark, d)
    known = rows.where("p_size % 9 > 1").select("crop", F.col("product").alias("group"))
    blank = F.when(F.col("group") != "", F.concat(F.lit(" "), "group", F.lit("  "))).otherwise(F.lit("   "))
    # The template of all crops, filled in as far as labels are known.
    filled = writers.truth_template(rows, known).select("crop", blank.alias("group"))
    filled.write.option("header", "true").option("ignoreTrailingWhiteSpace", "false").option(
        "ignoreLeadingWhiteSpace", "false"
    ).csv(path)
    return readers.ground_truth(spark, path)


@query("src07_label_corrections", f"""
WITH {NAMED_SQL} SELECT CASE WHEN p_size % 2 = 0 THEN 'added' ELSE 'confirmed' END AS action, product AS label,
       CASE WHEN p_size % 3 = 0 THEN 'item ' || p_size END AS corrected_from, count(*)::BIGINT AS n FROM named GROUP BY ALL""")
def src07(spark, d):
    path = scratch_path(spark, "reviews")
    size = F.col("p_size")
    before = F.concat(F.lit("corrected from item "), size.cast("string"))
    _named(spark, d).select(
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        F.when(size % 2 == 0, F.lit("added")).otherwise(F.lit("confirmed")).alias("action"),
        F.col("product").alias("label"), F.col("crop").alias("source_crop"),
        F.concat("crop", F.lit(".jpg")).alias("kb_file"),
        F.when(size % 3 == 0, before).otherwise(F.lit("as is")).alias("note"),
    ).write.option("header", "true").csv(path)
    return readers.label_corrections(readers.review_log(spark, path))


@query("snk04_cluster_folders", f"""
WITH {CROPS_SQL} SELECT CASE WHEN id % 7 = 0 THEN 'noise' ELSE 'cluster_' || (id % 7) END AS cluster,
       count(*)::BIGINT AS crops FROM crops GROUP BY 1""")
def snk04(spark, d):
    path = scratch_path(spark, "clusters")
    number = F.when(F.col("id") % 7 == 0, F.lit(-1)).otherwise((F.col("id") % 7).cast("int"))
    rows = b.crops(spark, d).select(F.col("id").alias("crop"), number.alias("cluster_id"))
    writers.cluster_assignment(rows, f"{path}/csv", f"{path}/folders")
    listed = spark.read.option("header", "true").schema("crop long, cluster_id int").csv(f"{path}/csv")
    stored = spark.read.parquet(f"{path}/folders")
    return stored.join(listed, ["crop", "cluster_id"]).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("crops")
    )


@query("snk05_discovery_files", f"""
WITH {NAMED_SQL} SELECT id::VARCHAR AS filename,
       CASE WHEN p_size % 3 = 0 THEN 'verified/' || product WHEN p_size % 3 = 1 THEN 'partial/' || product
            ELSE 'unresolved_unknown' END AS copied_to,
       '{{"brand":"' || p_name || '"}}' AS initial_candidate, '[]' AS evidence FROM named""")
def snk05(spark, d):
    back = spark.read.option("header", "true").option("escape", '"').csv(f"{_discovery(spark, d)}/csv")
    return back.select("filename", "copied_to", "initial_candidate", "evidence")


def _discovery(spark, d):
    """Where the results of one case per part are written in all three forms."""
    path = scratch_path(spark, "discovery")
    size = F.col("p_size")
    rows = _named(spark, d).select(
        F.col("id").cast("string").alias("filename"),
        F.when(size % 3 == 0, F.lit("verified")).when(size % 3 == 1, F.lit("partial"))
        .otherwise(F.lit("unresolved_unknown")).alias("status"),
        F.col("product").alias("label"),
        F.struct(F.col("p_name").alias("brand")).alias("initial_candidate"),
    )
    writers.discovery(rows, f"{path}/csv", f"{path}/json", f"{path}/folders")
    return path


DISCOVERED_SQL = f"""{NAMED_SQL}, found AS (SELECT id::VARCHAR AS filename, product AS label, p_name AS brand,
  CASE p_size % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'partial' ELSE 'unresolved_unknown' END AS status FROM named)"""
DISCOVERED = "filename string, status string, label string, initial_candidate struct<brand: string>"


@query("snk05_result_lines", f"WITH {DISCOVERED_SQL} SELECT filename, status, label, brand FROM found")
def snk05_lines(spark, d):
    back = spark.read.schema(DISCOVERED).json(f"{_discovery(spark, d)}/json")
    return back.select("filename", "status", "label", "initial_candidate.brand")


@query("snk05_routed_folders", f"""
WITH {DISCOVERED_SQL} SELECT filename, status AS route, CASE WHEN status <> 'unresolved_unknown' THEN label END AS route_label, brand FROM found""")
def snk05_routed(spark, d):
    back = spark.read.schema(f"{DISCOVERED}, route string, route_label string").json(f"{_discovery(spark, d)}/folders")
    return back.select("filename", "route", "route_label", "initial_candidate.brand")


@query("snk06_predictions_by_class", f"""
WITH {NAMED_SQL} SELECT CASE WHEN starts_with(product, 'non_beverage') THEN '_skipped_non_beverage' ELSE product END AS class,
       count(*)::BIGINT AS n FROM named GROUP BY 1""")
def snk06(spark, d):
    path = scratch_path(spark, "classes")
    writers.predictions_by_class(_named(spark, d).select("crop", "product", "score"), path)
    return spark.read.parquet(path).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("snk07_truth_template", f"""
WITH {NAMED_SQL} SELECT crop, CASE WHEN p_size % 9 > 1 THEN product ELSE '' END AS "group" FROM named""")
def snk07(spark, d):
    rows = _named(spark, d)
    known = rows.where("p_size % 9 > 1").select("crop", F.col("product").alias("group"))
    return writers.truth_template(rows, known)


@query("dq01_misplaced_folders", r"""
WITH p AS (SELECT split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages)
SELECT CASE WHEN len(s) < 2 THEN '.' ELSE array_to_string(s[1:len(s) - 1], '/') END AS folder, count(*)::BIGINT AS files
FROM p WHERE len(s) <> 2 GROUP BY 1""")
def dq01(spark, d):
    path = F.concat(F.lit("/root/"), F.regexp_replace("url", "^https?://", ""))
    return q.misplaced_folders(b.table(spark, d, "pages").select(path.alias("path")), "/root")


@query("inc01_signature_changes", """
WITH e AS (SELECT 'v' || vec_id AS path, vec_id % 10 AS k FROM embeddings)
SELECT path, 'added' AS change FROM e WHERE k IN (1, 2)
UNION ALL SELECT path, 'removed' FROM e WHERE k IN (2, 3)""")
def inc01(spark, d):
    """Vectors ending in 1 are new, in 2 of another size, in 3 gone; the others are as cached."""
    e, k = b.table(spark, d, "embeddings"), F.col("vec_id") % 10
    rows = e.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), k.alias("k"),
        F.size("embedding").cast("long").alias("size"), F.lit("m").alias("model"),
        F.lit(1).alias("version"), F.lit(None).cast("string").alias("variant"),
    )
    before = rows.where("k <> 1").withColumn("size", F.col("size") + (F.col("k") == 2).cast("int"))
    return q.signature_changes(rows.where("k <> 3"), before).select("path", "change")


@query("inc04_enough_points", f"""
WITH {CROPS_SQL} SELECT label, count(*) >= {CLUSTER_MIN_POINTS} AS enough FROM crops GROUP BY 1""")
def inc04(spark, d):
    """The guard of every label's crops before they are clustered."""
    counts = q.class_counts(b.crops(spark, d))
    return counts.select("label", q.is_enough(F.col("n"), CLUSTER_MIN_POINTS).alias("enough"))


@query("eva02_resolved_groups", r"""
WITH p AS (SELECT page_id, split(url, '/')[-1] AS name, split(url, '/')[-2] AS cls FROM pages),
k AS (SELECT page_id, cls, trim(regexp_replace(regexp_replace(name, '^(.+)\.[^.]+$', '\1'),
             '\s*\(Edited(?:\s+\d+)?\)', '', 'gi')) AS stem FROM p),
known AS (SELECT DISTINCT stem FROM k WHERE length(stem) % 2 = 0),
g AS (SELECT page_id, CASE WHEN known.stem IS NOT NULL THEN k.stem
       WHEN regexp_matches(k.stem, '^(.*?)-(\d+)$') THEN regexp_extract(k.stem, '^(.*?)-(\d+)$', 1)
       WHEN regexp_matches(k.stem, '(?i)^(.*)_(?:front|back)[a-z0-9]*$')
       THEN cls || '::' || regexp_extract(k.stem, '(?i)^(.*)_(?:front|back)[a-z0-9]*$', 1)
       ELSE cls || '::' || k.stem END AS grp FROM k LEFT JOIN known USING (stem))
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'photo ' || page_id ELSE grp END AS "group",
       page_id % 3 <> 0 AS inferred FROM g""")
def eva02(spark, d):
    """A third of the pages has recorded sources; stems of even length are known photos."""
    pages = b.table(spark, d, "pages").select(
        "page_id", F.col("url").alias("path"), F.col("page_id").cast("string").alias("kb_file")
    )
    recorded = pages.where("page_id % 3 = 0").select(
        "kb_file", F.concat(F.lit("photo "), "kb_file").alias("source_photo")
    )
    found = ev.resolve_groups(pages, recorded, known_stems(pages))
    return found.select("page_id", "group", "inferred")


def known_stems(pages):
    """Photos named like the files whose stem has an even length."""
    from ..functions.scalars import file_stem

    stem = F.trim(F.regexp_replace(file_stem(F.col("path")), ev.EDITED, ""))
    return pages.select(stem.alias("photo")).where(F.length("photo") % 2 == 0)


@query("eva02_known_photos", r"""
SELECT DISTINCT regexp_replace(split(url, '/')[-1], '^(.+)\.[^.]+$', '\1') || '-' || (page_id % 4) AS photo
FROM pages WHERE page_id % 4 < 3 AND split(url, '/')[-1] <> ''""")
def eva02_photos(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".png", ".gif")]), (F.col("page_id") % 4 + 1).cast("int"))
    stem = F.regexp_replace(F.element_at(F.split("url", "/"), -1), r"^(.+)\.[^.]+$", "$1")
    files = b.table(spark, d, "pages").where(F.element_at(F.split("url", "/"), -1) != "").select(
        F.concat(F.lit("photos/"), stem, F.lit("-"), (F.col("page_id") % 4).cast("string"), kind).alias("path")
    )
    return ev.known_photos(files, PHOTO_EXTENSIONS)


@query("mkt28_expanded_catalogue", """
WITH br AS (SELECT p_brand AS brand_id, min(p_partkey) AS pos FROM part GROUP BY 1),
fl AS (SELECT p_brand AS brand_id, p_type AS flavor, min(p_partkey) AS pos FROM part GROUP BY ALL),
sz AS (SELECT p_brand AS brand_id, p_size AS size, min(p_partkey) AS pos FROM part GROUP BY ALL),
x AS (SELECT brand_id, flavor, size, row_number() OVER (ORDER BY br.pos, fl.pos, sz.pos) AS n
      FROM br JOIN fl USING (brand_id) JOIN sz USING (brand_id))
SELECT 'P' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS product_id,
       upper(brand_id[1:2]) || '-' || flavor[1:3] || '-' || size AS sku, brand_id, flavor, size FROM x""")
def mkt28(spark, d):
    p = b.table(spark, d, "part").select(
        F.col("p_brand").alias("brand_id"), F.col("p_type").alias("flavor"), F.col("p_size").alias("size"),
        "p_partkey",
    )
    first = F.min("p_partkey").alias("pos")
    brands = p.groupBy("brand_id").agg(first).withColumn("short", F.col("brand_id"))
    flavours = p.groupBy("brand_id", "flavor").agg(first).withColumn("flavor_code", F.substring("flavor", 1, 3))
    sizes = p.groupBy("brand_id", "size").agg(first).withColumn("size_code", F.col("size").cast("string"))
    return m.expand_catalogue(brands, flavours, sizes)


@query("fn08_four_decimals", """
WITH c AS (SELECT l_suppkey AS photo, l_partkey % 5 AS product, count(*) AS n, sum(l_quantity::INTEGER)::DOUBLE AS space FROM lineitem GROUP BY ALL),
t AS (SELECT photo, sum(n) AS n, sum(space) AS space FROM c GROUP BY 1)
SELECT photo, 'p' || product AS product, c.n::BIGINT AS facings,
       round_even((c.n / t.n)::DECIMAL(38, 15), 4)::DOUBLE AS share_by_facings,
       round_even((c.space / t.space)::DECIMAL(38, 15), 4)::DOUBLE AS share_by_space
FROM c JOIN t USING (photo)""")
def fn08(spark, d):
    li = b.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("photo"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")).alias("product"),
        F.col("l_quantity").cast("int").cast("double").alias("area"),
    )
    return sh.session_share(li).select(
        "photo", "product", "facings", "share_by_facings", "share_by_space"
    )


@query("ss02_pool_updates", """
SELECT vec_id::VARCHAR AS key, len(embedding)::BIGINT AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings""")
def ss02(spark, d):
    """The vectors arrive as a stream twice; the second run finds nothing left to embed."""
    folder = scratch_path(spark, "pool")

    def arrivals():
        return b.arriving(spark, d, "embeddings").select(
            F.col("vec_id").cast("string").alias("key"), F.size("embedding").cast("long").alias("size"),
            "embedding",
        )

    take = lambda rows: rows.select("key", "size", "embedding")
    ingest.start_pool_updates(arrivals(), folder, take, "m", 1).awaitTermination()
    ingest.start_pool_updates(arrivals(), folder, take, "m", 1, checkpoint=f"{folder}/again").awaitTermination()
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return ingest.pool(spark, folder).select("key", "size", F.round(total, 4).alias("total"))
