"""Fusing label reads and second opinions into the visual ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import brand_and_flavour
from ..functions.text import match_terms, nfkc, fold_letters, normalise
from ..model import LOW_CONFIDENCE, UNKNOWN_BUCKET

# Lexicon of printed brand and flavour words.
BRAND_TERMS = {
    "sunich": ["سن ایچ", "سنایچ", "sunich"],
    "sunstar": ["سان استار", "سانستار", "sun star", "sunstar", "sun-star"],
}
FLAVOUR_TERMS = {
    "apple": ["سیب", "apple"],
    "cherry": ["آلبالو", "گیلاس", "cherry"],
    "mango": ["انبه", "mango"],
    "orange": ["پرتقال", "orange", "blood orange"],
    "peach": ["هلو", "peach"],
    "pineapple": ["آناناس", "pineapple"],
    "pomegranate": ["انار", "pomegranate"],
    "mix": ["میکس", "مخلوط", "مولتی ویتامین", "mix", "multi"],
    "pinacolada": ["پیناکولادا", "پینا کولادا", "pinacolada", "colada"],
    "tropical": ["گرمسیری", "استوایی", "tropical"],
}
# Fusion parameters.
READ_FLOOR = 0.20
MIN_MATCH = 0.60
BRAND_LEAD = 0.15
FLAVOUR_WEIGHT = 1.5
BRAND_WEIGHT = 3.0
BRAND_VETO = 1e-6
CONSULT_MARGIN = 0.35


def read_tokens(reads: DataFrame, floor: float = READ_FLOOR) -> DataFrame:
    """Comparable tokens of the confident reads: id, token.

    ``reads(id, reads ARRAY<STRUCT<text, conf>>)``.
    """
    kept = F.filter("reads", lambda r: r["conf"] >= floor)
    words = reads.select("id", F.explode(kept).alias("r")).select(
        "id", fold_letters(nfkc(F.col("r.text"))).alias("token")
    )
    return words.where(F.length("token") > 0)


def lexicon(brands: dict = BRAND_TERMS, flavours: dict = FLAVOUR_TERMS) -> Column:
    """The word list as an array of (kind, key, position, term) entries."""
    rows = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(key).alias("key"),
            F.lit(pos).alias("pos"),
            F.lit(term).alias("term"),
        )
        for kind, table in (("brand", brands), ("flavour", flavours))
        for pos, (key, terms) in enumerate(table.items())
        for term in terms
    ]
    return F.array(*rows)


def term_scores(tokens: DataFrame, words: Column | None = None) -> DataFrame:
    """Best match of any token per crop and lexicon key: id, kind, key, pos, score.

    Each distinct token is compared with the word list once.
    """
    words = lexicon() if words is None else words
    distinct = tokens.select("token").distinct()
    pairs = distinct.select("token", F.explode(words).alias("w")).select(
        "token", "w.kind", "w.key", "w.pos", normalise(F.col("w.term")).alias("term")
    )
    per_token = (
        match_terms(pairs, ["token", "kind", "key", "pos"])
        .groupBy("token")
        .agg(F.collect_list(F.struct("kind", "key", "pos", "score")).alias("hits"))
    )
    return (
        tokens.distinct().join(per_token, "token")
        .select("id", F.explode("hits").alias("h"))
        .select("id", "h.*")
        .groupBy("id", "kind", "key", "pos")
        .agg(F.max("score").alias("score"))
    )


def read_evidence(scores: DataFrame) -> DataFrame:
    """Best flavour and best brand per crop, with the runner-up brand's score."""
    place = F.struct((-F.col("score")).alias("s"), "pos", "key")
    ranked = lambda kind: F.array_sort(
        F.collect_list(F.when(F.col("kind") == kind, place))
    )
    rows = scores.groupBy("id").agg(ranked("brand").alias("b"), ranked("flavour").alias("f"))
    first = lambda c: F.get(c, F.lit(0))
    return rows.select(
        "id",
        first("f")["key"].alias("flavour"),
        F.coalesce(-first("f")["s"], F.lit(0.0)).alias("flavour_score"),
        first("b")["key"].alias("brand"),
        F.coalesce(-first("b")["s"], F.lit(0.0)).alias("brand_score"),
        F.coalesce(-F.get("b", F.lit(1))["s"], F.lit(0.0)).alias("brand_runner_up"),
    )


def should_consult(
    candidates: DataFrame, margin: float = CONSULT_MARGIN, verify_brand: bool = False
) -> DataFrame:
    """Crops worth reading: undecided ones and, on request, those about to name a product."""
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    top = candidates.groupBy("id").agg(
        at("label", 1).alias("top"), at("score", 1).alias("s1"), at("score", 2).alias("s2")
    )
    named = brand_and_flavour(F.col("top"))["brand"].isNotNull()
    close = F.coalesce((F.col("s1") - F.col("s2")) < margin, F.lit(False))
    consult = (named | close) if verify_brand else close
    return top.select("id", consult.alias("consult"))


def fuse(
    candidates: DataFrame,
    evidence: DataFrame,
    *,
    flavour_weight: float = FLAVOUR_WEIGHT,
    min_match: float = MIN_MATCH,
    brand_weight: float = BRAND_WEIGHT,
    brand_lead: float = BRAND_LEAD,
    unknown_label: str = UNKNOWN_BUCKET,
) -> DataFrame:
    """Re-ranked candidates: id, label, score, rank.

    A read flavour raises the candidates that carry it. A clearly read brand vetoes candidates of
    other brands and, when no candidate carries it, raises the unknown bucket. Without usable
    evidence scores and order stay as they are.
    """
    # A crop has one row per class.
    q = Window.partitionBy("id")
    parsed = candidates.select("id", "label", "score", "rank").withColumn(
        "_p", brand_and_flavour(F.col("label"))
    )
    rows = parsed.join(evidence, "id", "left")
    use_flavour = F.coalesce(F.col("flavour_score") >= min_match, F.lit(False))
    use_brand = F.coalesce(
        (F.col("brand_score") >= min_match)
        & (F.col("brand_score") - F.col("brand_runner_up") >= brand_lead),
        F.lit(False),
    )
    same_brand = F.coalesce(F.col("_p.brand") == F.col("brand"), F.lit(False))
    known = F.max(same_brand).over(q)
    by_flavour = F.when(
        use_flavour & F.coalesce(F.col("_p.flavour") == F.col("flavour"), F.lit(False)),
        F.exp(F.lit(flavour_weight) * F.col("flavour_score")),
    ).otherwise(F.lit(1.0))
    by_brand = (
        F.when(use_brand & F.col("_p.brand").isNotNull() & ~same_brand, F.lit(BRAND_VETO))
        .when(
            use_brand & (F.col("label") == unknown_label) & ~F.col("_known"),
            F.exp(F.lit(brand_weight) * F.col("brand_score")),
        )
        .otherwise(F.lit(1.0))
    )
    weighed = rows.withColumn("_known", known).withColumn(
        "_w", F.col("score") * by_flavour * by_brand
    )
    total = F.sum("_w").over(q)
    used = use_flavour | use_brand
    fused = weighed.withColumn(
        "_s",
        F.when(used, F.col("_w") / F.when(total == 0, F.lit(1.0)).otherwise(total)).otherwise(
            F.col("score")
        ),
    )
    # Without evidence the old rank already is the order.
    order = q.orderBy(F.when(used, -F.col("_s")).otherwise(F.lit(0.0)), F.col("rank"))
    return fused.select(
        "id", "label", F.col("_s").alias("score"), F.row_number().over(order).cast("long").alias("rank")
    )


def fused_decision(matches: DataFrame, candidates: DataFrame, fused: DataFrame) -> DataFrame:
    """Matches with the fused ranking's answer where one was consulted.

    ``fused`` holds the consulted crops only. The source turns to ``ocr`` when the top changed.
    """
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    new = fused.groupBy("id").agg(
        at("label", 1).alias("_label"), at("score", 1).alias("_score"), at("score", 2).alias("_s2")
    )
    old = candidates.where(F.col("rank") == 1).select("id", F.col("label").alias("_old"))
    hit = F.col("_label").isNotNull()
    return matches.join(new, "id", "left").join(old, "id", "left").select(
        "id",
        F.when(hit, F.col("_label")).otherwise(F.col("product")).alias("product"),
        F.when(hit, F.lit(1.0)).otherwise(F.col("vote")).alias("vote"),
        F.when(hit, F.col("_score")).otherwise(F.col("score")).alias("score"),
        F.when(hit, F.coalesce(F.col("_score") - F.col("_s2"), F.lit(1.0)))
        .otherwise(F.col("margin"))
        .alias("margin"),
        F.when(hit & (F.col("_label") != F.col("_old")), F.lit("ocr"))
        .otherwise(F.lit("local"))
        .alias("source"),
    )


def second_opinion(gated: DataFrame, verdicts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rejected crops take an allowed verdict; an unlisted or failed one counts as unknown.

    ``gated(id, product, score, source)``, ``verdicts(id, label, confidence)``, ``allowed(label)``.
    """
    usable = verdicts.where(F.col("label").isNotNull()).join(allowed, "label", "left_semi").select(
        "id", F.col("label").alias("_l"), F.coalesce("confidence", F.lit(0.0)).alias("_c")
    )
    rejected = F.col("product") == LOW_CONFIDENCE
    take = F.col("_l").isNotNull()
    weak = gated.where(rejected).join(usable, "id", "left").select(
        "id",
        F.when(take, F.col("_l")).otherwise(F.col("product")).alias("product"),
        F.when(take, F.col("_c")).otherwise(F.col("score")).alias("score"),
        F.when(take, F.lit("llm")).otherwise(F.col("source")).alias("source"),
    )
    return gated.where(~rejected).select("id", "product", "score", "source").unionByName(weak)


def reading_yield(crops: DataFrame, evidence: DataFrame, tokens: DataFrame) -> DataFrame:
    """How often reading helped: crops with text, a clear brand, a flavour, a right flavour.

    ``crops(id, truth)``.
    """
    text = tokens.select("id").distinct().withColumn("_text", F.lit(True))
    rows = crops.join(evidence, "id", "left").join(text, "id", "left")
    clear = (F.col("brand_score") >= MIN_MATCH) & (
        F.col("brand_score") - F.col("brand_runner_up") >= BRAND_LEAD
    )
    flavour = F.col("flavour_score") >= MIN_MATCH
    return rows.agg(
        F.count(F.lit(1)).alias("crops"),
        F.count_if("_text").alias("with_text"),
        F.count_if(clear).alias("with_brand"),
        F.count_if(flavour).alias("with_flavour"),
        F.count_if(flavour & F.contains(F.col("truth"), F.col("flavour"))).alias("flavour_agrees"),
    )
