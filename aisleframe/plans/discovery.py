"""Unknown-product queries: normalisers, web evidence, resolution and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import discovery as dc
from ..operators import evidence as fx
from ..sources import bindings as b
from .market import r6
from .registry import query

NONE = "array<string>"

WRAPPED_SQL = """w AS (SELECT event_id, props, CASE event_type
    WHEN 'click' THEN '```json' || chr(10) || props || chr(10) || '```'
    WHEN 'view' THEN 'Answer: ' || props || ' as asked.'
    WHEN 'error' THEN replace(props, '}', '') WHEN 'purchase' THEN '[' || props || ']' ELSE props END AS body,
  event_type FROM events)"""


def _responses(spark, d):
    e = b.table(spark, d, "events")
    p, t = F.col("props"), F.col("event_type")
    body = (
        F.when(t == "click", F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(t == "view", F.concat(F.lit("Answer: "), p, F.lit(" as asked.")))
        .when(t == "error", F.replace(p, F.lit("}"), F.lit("")))
        .when(t == "purchase", F.concat(F.lit("["), p, F.lit("]")))
        .otherwise(p)
    )
    return e.select("event_id", body.alias("body"))


@query("unk01_response_json", f"""
WITH {WRAPPED_SQL}
SELECT event_id, CASE WHEN event_type NOT IN ('error', 'purchase') THEN (props::JSON ->> 'k')::BIGINT END AS k,
       CASE event_type WHEN 'error' THEN 'no JSON found' WHEN 'purchase' THEN 'not a JSON object' END AS error FROM w""")
def unk01(spark, d):
    good, bad = dc.parse_responses(_responses(spark, d), "body", "k bigint")
    return good.select("event_id", "response.k", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("event_id", F.lit(None).cast("long").alias("k"), "error")
    )


@query("unk02_compact_token", """
SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', '', 'g') AS token FROM part""")
def unk02(spark, d):
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return b.table(spark, d, "part").select("p_partkey", tx.compact_token(text).alias("token"))


SIZE_SQL = """CASE p_type WHEN 'SMALL' THEN p_size || ' ml' WHEN 'MEDIUM' THEN p_size || ' Centilitres 33 cl'
  WHEN 'LARGE' THEN p_size || ',5 Litres' WHEN 'PROMO' THEN 'net ' || p_size || ',000 ml' WHEN 'ECONOMY' THEN p_size || 'cc' ELSE 'large' END"""


def _size_text():
    s, t = F.col("p_size").cast("string"), F.col("p_type")
    return (
        F.when(t == "SMALL", F.concat(s, F.lit(" ml")))
        .when(t == "MEDIUM", F.concat(s, F.lit(" Centilitres 33 cl")))
        .when(t == "LARGE", F.concat(s, F.lit(",5 Litres")))
        .when(t == "PROMO", F.concat(F.lit("net "), s, F.lit(",000 ml")))
        .when(t == "ECONOMY", F.concat(s, F.lit("cc")))
        .otherwise(F.lit("large"))
    )


@query("unk03_normalised_size", """
SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN p_size || 'ml' WHEN 'MEDIUM' THEN '330ml' WHEN 'LARGE' THEN p_size || '.5L'
       WHEN 'PROMO' THEN p_size || 'L' WHEN 'ECONOMY' THEN p_size || 'ml' ELSE '' END AS size FROM part""")
def unk03(spark, d):
    return b.table(spark, d, "part").select("p_partkey", tx.normalise_size(_size_text()).alias("size"))


def _flavour_text():
    i = F.col("p_size") % 6
    words = ["blood orange juice", "Sour-Cherry", "peach nectar", "Apple & mango", "mixed fruit drink", "لیمو"]
    return F.element_at(F.array(*[F.lit(w) for w in words]), i.cast("int") + 1)


@query("unk04_fruits", """
SELECT p_partkey, ['orange', 'cherry', 'peach', 'apple,mango', '', ''][p_size % 6 + 1] AS fruits FROM part""")
def unk04(spark, d):
    return b.table(spark, d, "part").select(
        "p_partkey", F.array_join(dc.extract_fruits(_flavour_text()), ",").alias("fruits")
    )


@query("unk05_flavour", """
SELECT p_partkey, ['orange', 'cherry', 'peach', 'mix', 'mix', ''][p_size % 6 + 1] AS flavour FROM part""")
def unk05(spark, d):
    return b.table(spark, d, "part").select(
        "p_partkey", dc.flavour(_flavour_text(), F.array().cast(NONE)).alias("flavour")
    )


@query("unk06_brand_candidates", """
WITH l AS (SELECT p_partkey, [lower(replace(p_brand, '#', '')), lower(replace(p_brand, '#', '')), replace(p_name, ' ', ''), lower(p_type)] AS l FROM part)
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ',') AS brands FROM l""")
def unk06(spark, d):
    rows = b.table(spark, d, "part").withColumn("names", F.array("p_brand", F.upper("p_brand"), "p_name"))
    return dc.brand_candidates(rows, "p_partkey", "names", "p_type").select(
        "p_partkey", F.array_join("brands", ",").alias("brands")
    )


RESULT_SQL = r"""res AS (SELECT page_id AS pos, (page_id % 3)::INTEGER AS query_pos,
    regexp_extract(url, '^https?://[^.]+\.([^./]+)', 1) || CASE WHEN length(url) % 2 = 0 THEN '' ELSE ' x' END AS brand,
    trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title, url, trim(html) AS snippet FROM pages)"""


def _results(spark, d):
    p = b.table(spark, d, "pages")
    host = F.regexp_extract("url", r"^https?://[^.]+\.([^./]+)", 1)
    return p.select(
        F.col("page_id").alias("pos"),
        (F.col("page_id") % 3).cast("int").alias("query_pos"),
        F.concat(host, F.when(F.length("url") % 2 == 0, F.lit("")).otherwise(F.lit(" x"))).alias("brand"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        "url",
        F.col("html").alias("snippet"),
    )


EXACT_SQL = """regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') <> '' AND contains(regexp_replace(lower(title || ' ' || snippet || ' ' || url), '[^a-z0-9]+', '', 'g'),
  regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g'))"""


@query("unk07_exact_brand", f"WITH {RESULT_SQL} SELECT pos, brand, {EXACT_SQL} AS exact FROM res")
def unk07(spark, d):
    return dc.exact_brand_match(_results(spark, d)).select("pos", "brand", "exact")


@query("unk08_deduped_results", f"""
WITH {RESULT_SQL}, a AS (SELECT 0 AS src, pos, brand, title, url FROM res
  UNION ALL SELECT 1, pos, upper(brand), '', upper(url) FROM res UNION ALL SELECT 1, pos + 1000000, brand, '', url FROM res)
SELECT pos, brand, title, url FROM a
QUALIFY row_number() OVER (PARTITION BY lower(brand), lower(url), lower(title) ORDER BY src, pos) = 1""")
def unk08(spark, d):
    old = _results(spark, d).select("pos", "brand", F.trim("title").alias("title"), "url")
    loud = old.select("pos", F.upper("brand").alias("brand"), F.lit("").alias("title"), F.upper("url").alias("url"))
    late = old.select((F.col("pos") + 1000000).alias("pos"), "brand", F.lit("").alias("title"), "url")
    return dc.dedupe_results(old, loud.unionByName(late))


@query("unk09_query_expansion", f"""
WITH p AS (SELECT p_partkey AS id, lower(replace(p_brand, '#', '')) AS brand, ['blood orange juice', 'Sour-Cherry', 'peach nectar',
    'Apple & mango', 'mixed fruit drink', 'لیمو'][p_size % 6 + 1] AS raw,
    ['orange', 'cherry', 'peach', 'mix', 'mix', ''][p_size % 6 + 1] AS fl,
    CASE p_type WHEN 'SMALL' THEN p_size || 'ml' WHEN 'MEDIUM' THEN '330ml' WHEN 'LARGE' THEN p_size || '.5L'
       WHEN 'PROMO' THEN p_size || 'L' WHEN 'ECONOMY' THEN p_size || 'ml' ELSE '' END AS size FROM part),
f AS (SELECT *, unnest(list_filter([raw, fl], lambda x: x <> '')) AS one FROM p)
SELECT id, brand, '"' || brand || '" "' || one || '" "' || size || '" beverage' AS query, 'brand_flavor_size' AS purpose FROM f WHERE size <> ''
UNION ALL SELECT id, brand, '"' || brand || '" "' || one || '" beverage', 'brand_flavor' FROM f
UNION ALL SELECT id, brand, '"' || brand || '" "' || size || '" beverage', 'brand_size' FROM p WHERE size <> ''
UNION ALL SELECT id, brand, '"' || brand || '" beverage juice', 'brand_discovery' FROM p
UNION ALL SELECT id, brand, '"' || brand || '" "' || fl || '" beverage', 'flavor_validation' FROM p WHERE fl <> ''
UNION ALL SELECT id, brand, '"' || brand || '" "' || fl || '" "' || size || '" beverage', 'flavor_validation' FROM p WHERE fl <> '' AND size <> ''
UNION ALL SELECT id, brand, '"' || brand || '" "' || fl || '" ml beverage', 'size_recovery' FROM p WHERE fl <> ''
UNION ALL SELECT id, brand, '"' || brand || '" "' || fl || '" volume size', 'size_recovery' FROM p WHERE fl <> ''
UNION ALL SELECT id, brand, '"' || brand || '" ml beverage', 'size_recovery' FROM p WHERE fl = ''""")
def unk09(spark, d):
    rows = b.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.array(tx.compact_token(F.col("p_brand"))).alias("brands"),
        _flavour_text().alias("raw_flavour"),
        dc.flavour(_flavour_text(), F.array().cast(NONE)).alias("flavour"),
        tx.normalise_size(_size_text()).alias("size"),
    )
    out = dc.search_queries(rows, "initial")
    for stage in ("flavor", "size"):
        out = out.unionByName(dc.search_queries(rows, stage))
    return out.select("id", "brand", "query", "purpose")


@query("unk10_capped_results", f"""
WITH {RESULT_SQL}, one AS (SELECT * FROM res WHERE title <> '' OR url <> '' OR snippet <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(brand), lower(url), lower(title) ORDER BY query_pos, pos) = 1),
n AS (SELECT greatest(1, 30 // count(DISTINCT brand)) AS cap FROM res)
SELECT brand, pos, query_pos, url, title, length(snippet)::INTEGER AS snippet_chars
FROM (SELECT brand, pos, query_pos, url, title, substr(snippet, 1, 1400) AS snippet,
             row_number() OVER (PARTITION BY brand ORDER BY query_pos, pos) AS rn FROM one), n WHERE rn <= cap""")
def unk10(spark, d):
    return dc.cap_results(_results(spark, d)).select(
        "brand", "pos", "query_pos", "url", "title", F.length("snippet").alias("snippet_chars")
    )


@query("unk11_web_support", f"""
WITH {RESULT_SQL}, e AS (SELECT *, {EXACT_SQL} AS exact FROM res),
t AS (SELECT brand, title, row_number() OVER (PARTITION BY brand ORDER BY pos) AS rn FROM e WHERE exact QUALIFY rn <= 5)
SELECT brand, count(*)::BIGINT AS results, count(*) FILTER (exact)::BIGINT AS exact_results,
       coalesce((SELECT string_agg(title, '|' ORDER BY rn) FROM t WHERE t.brand = e.brand), '') AS titles
FROM e GROUP BY brand""")
def unk11(spark, d):
    rows = _results(spark, d).withColumn("title", F.trim("title"))
    return dc.web_support(dc.exact_brand_match(rows)).select(
        "brand", "results", "exact_results", F.array_join("exact_titles", "|").alias("titles")
    )


def _spread_parts(spark, d):
    """Parts in several tasks per core: their rows are few bytes, so one task would read them all, but a case is much
    work. A number that is asked for is not merged by size, and what groups and joins by key needs no other shuffle."""
    parts = b.table(spark, d, "part")
    return parts.repartition(max(4 * spark.sparkContext.defaultParallelism, parts.rdd.getNumPartitions()), "p_partkey")


def _cases(spark, d):
    """One case per part, with stage answers set by simple rules."""
    none = F.array().cast(NONE)
    size = F.concat(F.col("p_size").cast("string"), F.lit(" cl"))
    yes = F.lit(True)
    few = F.col("p_size")
    return _spread_parts(spark, d).select(
        F.col("p_partkey").alias("id"),
        F.struct(
            F.when(F.col("p_type") == "PROMO", F.lit("none")).otherwise(F.lit("candidate")).alias("status"),
            F.col("p_brand").alias("brand"), F.lit("peach nectar").alias("flavor"), size.alias("size"),
            none.alias("fruits"), none.alias("evidence"), none.alias("conflicts"),
        ).alias("initial"),
        F.when(F.col("p_type") == "SMALL", none).otherwise(F.array(tx.compact_token(F.col("p_brand")))).alias("brands"),
        F.struct(
            F.lit("peach").alias("flavor"), none.alias("fruits"), yes.alias("flavor_supported"),
            none.alias("evidence"), none.alias("conflicts"),
        ).alias("flavor_recheck"),
        F.struct(
            F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("size"),
            F.lit(None).cast("boolean").alias("size_supported"), none.alias("evidence"), none.alias("conflicts"),
        ).alias("size_recovery"),
        F.struct(
            F.when(few <= 40, F.lit("Accept ")).otherwise(F.lit("reject")).alias("verdict"),
            F.col("p_brand").alias("brand"), F.lit("Peach juice").alias("flavor"), size.alias("size"),
            F.array(F.lit("peach")).alias("fruits"), (few <= 30).alias("image_supported"),
            yes.alias("brand_recheck_supported"), yes.alias("brand_supported"), yes.alias("flavor_supported"),
            F.when(few != 9, yes).alias("size_supported"), F.lit("inconclusive").alias("web_status"),
            F.lit(None).cast("boolean").alias("web_supported"),
            none.alias("evidence"),
            F.when(few == 7, F.array(F.lit("flavour differs"))).otherwise(none).alias("conflicts"),
            F.lit("").alias("reason"),
        ).alias("verification"),
    )


RESOLVED_SQL = """r AS (SELECT p_partkey AS id, CASE WHEN p_type NOT IN ('PROMO', 'SMALL') AND p_size <= 30 AND p_size NOT IN (7, 9)
    THEN 'verified' ELSE 'partial' END AS status,
  lower(replace(p_brand, '#', '')) || '_peach_' || (p_size * 10) || 'ml' AS label,
  CASE WHEN p_type NOT IN ('PROMO', 'SMALL') AND p_size = 7 THEN 1
       WHEN p_type = 'SMALL' THEN 1 ELSE 0 END::INTEGER AS conflicts FROM part)"""


@query("unk13_resolution", f"WITH {RESOLVED_SQL} SELECT * FROM r")
def unk13(spark, d):
    return dc.resolve(_cases(spark, d)).select(
        "id", "status", "label", F.size("conflicts").alias("conflicts")
    )


@query("unk14_stage_gates", """
SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'unresolved: no candidate' WHEN p_type = 'SMALL' THEN 'unresolved: no brand'
       ELSE 'verify' END AS stage, (p_size * 10) || 'ml' AS initial_size FROM part""")
def unk14(spark, d):
    return dc.stage_gates(_cases(spark, d)).select("id", "stage", "initial_size")


def _varied_cases(spark, d):
    """One case per part in which every flag, status and field of the stages fails for some parts."""
    k, none = F.col("p_partkey"), F.array().cast(NONE)
    size = F.concat(F.col("p_size").cast("string"), F.lit(" cl"))
    fails = lambda m, r: k % m == r
    blank = fails(73, 19)
    text = lambda gone, value: F.when(gone | blank, F.lit("")).otherwise(value)
    notes = lambda m, r: F.when(fails(m, r), F.array(F.lit("differs"))).otherwise(none)
    return _spread_parts(spark, d).select(
        k.alias("id"),
        F.struct(
            F.when(fails(13, 1), F.lit("none")).otherwise(F.lit(" Candidate")).alias("status"),
            text(F.lit(False), F.col("p_brand")).alias("brand"), text(F.lit(False), F.lit("peach nectar")).alias("flavor"),
            text(fails(5, 3), size).alias("size"), none.alias("fruits"), none.alias("evidence"), none.alias("conflicts"),
        ).alias("initial"),
        F.when(fails(11, 2) | blank, none).otherwise(F.array(tx.compact_token(F.col("p_brand")))).alias("brands"),
        F.struct(
            text(fails(17, 5), F.lit("peach")).alias("flavor"), none.alias("fruits"), (~fails(19, 6)).alias("flavor_supported"),
            none.alias("evidence"), notes(67, 17).alias("conflicts"),
        ).alias("flavor_recheck"),
        F.struct(
            F.when(fails(2, 0), F.lit("recovered")).otherwise(F.lit("failed")).alias("status"),
            text(fails(3, 0), size).alias("size"), F.when(~fails(7, 4), True).alias("size_supported"),
            none.alias("evidence"), notes(71, 18).alias("conflicts"),
        ).alias("size_recovery"),
        F.struct(
            F.when(fails(23, 7), F.lit("reject")).otherwise(F.lit(" ACCEPT")).alias("verdict"),
            text(fails(47, 13), F.col("p_brand")).alias("brand"), text(fails(53, 14), F.lit("Peach juice")).alias("flavor"),
            text(fails(59, 15), size).alias("size"), F.array(F.lit("peach")).alias("fruits"),
            (~fails(29, 8)).alias("image_supported"), (~fails(31, 9)).alias("brand_recheck_supported"),
            F.when(~fails(37, 10), True).alias("brand_supported"), (~fails(41, 11)).alias("flavor_supported"),
            (~fails(43, 12)).alias("size_supported"),
            F.when(fails(4, 2), F.lit("Confirmed ")).when(fails(8, 3), F.lit("contradicted")).otherwise(F.lit("inconclusive")).alias("web_status"),
            (~fails(16, 2)).alias("web_supported"), none.alias("evidence"), notes(61, 16).alias("conflicts"),
            F.when(fails(2, 1), F.lit("label read")).otherwise(F.lit("")).alias("reason"),
        ).alias("verification"),
    )


@query("unk12_acceptance", f"""
WITH c AS (SELECT p_partkey AS k, p_partkey % 73 = 19 AS blank, p_partkey % 5 <> 3 AS first_size, p_partkey % 3 <> 0 AS found_size FROM part),
v AS (SELECT k, blank, k % 13 = 1 AS no_candidate, k % 11 = 2 OR blank AS no_brand,
    NOT blank AND k % 23 <> 7 AND k % 29 <> 8 AND k % 31 <> 9 AND k % 37 <> 10 AND k % 41 <> 11 AND k % 43 <> 12
    AND k % 47 <> 13 AND k % 17 <> 5 AND k % 19 <> 6 AND k % 61 <> 16 AND k % 67 <> 17 AND k % 71 <> 18
    AND (first_size OR k % 2 = 0 AND k % 7 <> 4 AND found_size)
    AND (k % 59 <> 15 OR found_size)
    AND CASE WHEN k % 4 = 2 THEN k % 16 <> 2 ELSE k % 8 <> 3 END AS kept FROM c)
SELECT k AS id, CASE WHEN kept AND NOT no_candidate AND NOT no_brand THEN 'verified' WHEN blank THEN 'unresolved_unknown' ELSE 'partial' END AS status,
       CASE WHEN no_candidate THEN '{dc.NO_CANDIDATE}' WHEN no_brand THEN '{dc.NO_BRAND}'
            WHEN k % 2 = 1 THEN 'label read' ELSE '{dc.REJECTED}' END AS reason FROM v""")
def unk12(spark, d):
    return dc.resolve(_varied_cases(spark, d)).select("id", "status", "reason")


@query("unk14_all_stages", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 1 THEN 'unresolved: no candidate' WHEN p_partkey % 11 = 2 OR p_partkey % 73 = 19 THEN 'unresolved: no brand'
       WHEN p_partkey % 5 = 3 THEN 'recover size' ELSE 'verify' END AS stage,
       CASE WHEN p_partkey % 5 = 3 OR p_partkey % 73 = 19 THEN '' ELSE (p_size * 10) || 'ml' END AS initial_size FROM part""")
def unk14_all(spark, d):
    return dc.stage_gates(_varied_cases(spark, d)).select("id", "stage", "initial_size")


@query("unk15_status_counts", f"WITH {RESOLVED_SQL} SELECT status, count(*)::BIGINT AS n FROM r GROUP BY 1")
def unk15(spark, d):
    return dc.status_counts(dc.resolve(_cases(spark, d)))


@query("unk16_triage", """
SELECT event_id AS id, round(value / 100, 6) AS confidence,
       CASE WHEN event_type = 'purchase' OR round(value / 100, 6) > 0.7 THEN 'verified' WHEN round(value / 100, 6) > 0.55 THEN 'partial'
            ELSE 'unknown' END AS status FROM events""")
def unk16(spark, d):
    e = b.table(spark, d, "events")
    items = e.select(F.col("event_id").alias("id"), F.round(F.col("value") / 100, 6).alias("confidence"))
    return dc.triage(items, e.where("event_type = 'purchase'").select(F.col("event_id").alias("id")))


@query("unk16_triage_view", """
SELECT p_partkey AS id, 'partial' AS status FROM part
WHERE p_size * 0.01 + 0.3 > 0.55 AND p_size * 0.01 + 0.3 <= 0.7 AND p_partkey % 5 <> 0
  AND contains(p_brand || p_type || p_size, 'ECO')""")
def unk16_view(spark, d):
    p = b.table(spark, d, "part")
    items = p.select(
        F.col("p_partkey").alias("id"), F.round(F.col("p_size") / 100 + 0.3, 6).alias("confidence"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("flavor"), F.col("p_size").cast("string").alias("size"),
    )
    approved = items.where("id % 5 = 0").select("id")
    return dc.triage_view(dc.triage(items, approved), "partial", " ECO ").select("id", "status")


def _reads(spark, d):
    """Words of each part's name and type as confident and weak reads."""
    p = b.table(spark, d, "part")
    read = lambda text, conf: F.struct(text.alias("text"), F.lit(conf).alias("conf"))
    return p.select(
        F.col("p_partkey").alias("id"),
        F.array(
            read(F.upper(F.split("p_name", " ")[0]), 0.9),
            read(F.split("p_name", " ")[1], 0.2),
            read(F.col("p_type"), 0.1),
            read(F.lit(" - "), 0.9),
        ).alias("reads"),
    )


WORDS = {"red": ["red"], "smallish": ["smallest"], "blue": ["blue", "azure"]}
THINGS = {"ring": ["ring"], "widget": ["widgets"], "gadget": ["gadget"]}


@query("evd01_read_tokens", """
SELECT p_partkey AS id, unnest([lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2))]) AS token FROM part""")
def evd01(spark, d):
    return fx.read_tokens(_reads(spark, d))


# Ratcliff and Obershelp: the longest common block (the first in the token, then in the term), and the
# same again left and right of it; a segment pair is a row of the recursion.
BLOCK_SQL = """list_max(flatten(list_transform(range(1, length(sa) + 1), lambda i: list_transform(range(1, length(sb) + 1),
    lambda j: {'k': len(list_filter(range(1, 1 + least(length(sa) - i, length(sb) - j) + 1),
                 lambda n: sa[i:i + n - 1] = sb[j:j + n - 1])), 'i': -i, 'j': -j}))))"""
COMMON_SQL = f"""seg AS (
  SELECT DISTINCT token, term, token AS sa, term AS sb FROM reads CROSS JOIN lexicon WHERE length(term) > 4
  UNION ALL
  SELECT token, term, unnest([sa[:-m.i - 1], sa[m.k - m.i:]]), unnest([sb[:-m.j - 1], sb[m.k - m.j:]])
  FROM (SELECT *, {BLOCK_SQL} AS m FROM seg WHERE sa <> '' AND sb <> '') WHERE m.k > 0),
common AS (SELECT token, term, sum((b).k) AS m FROM (SELECT token, term, {BLOCK_SQL} AS b FROM seg WHERE sa <> '' AND sb <> '') GROUP BY ALL)"""
SCORES_SQL = f"""lexicon(kind, key, pos, term) AS (VALUES ('brand', 'red', 0, 'red'), ('brand', 'smallish', 1, 'smallest'),
  ('brand', 'blue', 2, 'blue'), ('brand', 'blue', 2, 'azure'), ('flavour', 'ring', 0, 'ring'),
  ('flavour', 'widget', 1, 'widgets'), ('flavour', 'gadget', 2, 'gadget')),
reads AS (SELECT DISTINCT p_partkey AS id, unnest([lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2))]) AS token FROM part),
{COMMON_SQL},
scores AS (SELECT id, kind, key, pos, max(CASE WHEN length(term) <= 4 THEN contains(token, term)::INTEGER
    ELSE coalesce(2.0::DOUBLE * m / (length(token) + length(term)), 0) END::DOUBLE) AS score
  FROM reads CROSS JOIN lexicon LEFT JOIN common USING (token, term) GROUP BY ALL)"""
EVIDENCE_SQL = f"""{SCORES_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY score DESC, pos, key) AS place FROM scores),
evidence AS (SELECT id, max(key) FILTER (kind = 'flavour' AND place = 1) AS flavour, max(key) FILTER (kind = 'brand' AND place = 1) AS brand,
  max(score) FILTER (kind = 'flavour' AND place = 1) AS flavour_score, max(score) FILTER (kind = 'brand' AND place = 1) AS brand_score,
  max(score) FILTER (kind = 'brand' AND place = 2) AS brand_runner_up FROM placed GROUP BY 1)"""


@query("evd04_term_scores", f"WITH RECURSIVE {SCORES_SQL} SELECT id, kind, key, round(score, 6) AS score FROM scores")
def evd04(spark, d):
    scores = fx.term_scores(fx.read_tokens(_reads(spark, d)), fx.lexicon(WORDS, THINGS))
    return scores.select("id", "kind", "key", *r6("score"))


@query("evd04_best_terms", f"""WITH RECURSIVE {EVIDENCE_SQL}
SELECT id, flavour, brand, round(flavour_score, 6) AS flavour_score, round(brand_score, 6) AS brand_score,
       round(brand_runner_up, 6) AS brand_runner_up FROM evidence""")
def evd04_best(spark, d):
    scores = fx.term_scores(fx.read_tokens(_reads(spark, d)), fx.lexicon(WORDS, THINGS))
    return fx.read_evidence(scores).select(
        "id", "flavour", "brand", *r6("flavour_score", "brand_score", "brand_runner_up")
    )


@query("evd11_reading_yield", f"""WITH RECURSIVE {EVIDENCE_SQL}
SELECT count(*)::BIGINT AS crops, count(*)::BIGINT AS with_text,
       count_if(brand_score >= 0.6 AND brand_score - brand_runner_up >= 0.15)::BIGINT AS with_brand,
       count_if(flavour_score >= 0.6)::BIGINT AS with_flavour,
       count_if(flavour_score >= 0.6 AND contains(p_name, flavour))::BIGINT AS flavour_agrees
FROM evidence JOIN part ON p_partkey = id""")
def evd11(spark, d):
    tokens = fx.read_tokens(_reads(spark, d))
    evidence = fx.read_evidence(fx.term_scores(tokens, fx.lexicon(WORDS, THINGS)))
    truth = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("truth"))
    return fx.reading_yield(truth, evidence, tokens)
