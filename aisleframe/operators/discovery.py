"""Unknown products: normalising and adjudicating model and web evidence held in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let, ordered_unique
from ..functions.text import clean_words, compact_token, normalise_size

# Flavour vocabulary.
GENERIC_FLAVOUR_WORDS = (
    "juice", "drink", "beverage", "nectar", "squash", "flavor", "flavour", "flavored", "flavoured",
    "with", "pulp", "pulpy", "nopulp", "withoutpulp",
)
FRUITS = (
    "apple", "apricot", "banana", "blackberry", "blueberry", "cherry", "coconut", "cranberry",
    "dragonfruit", "grape", "grapefruit", "guava", "kiwi", "lemon", "lime", "lychee", "mandarin",
    "mango", "melon", "orange", "passionfruit", "peach", "pear", "pineapple", "pomegranate",
    "raspberry", "strawberry", "tangerine", "watermelon",
)
FRUIT_ALIASES = {
    "passion fruit": "passionfruit",
    "dragon fruit": "dragonfruit",
    "blood orange": "orange",
    "red orange": "orange",
    "pulp orange": "orange",
    "pulpy orange": "orange",
    "orange with pulp": "orange",
    "orange without pulp": "orange",
    "no pulp orange": "orange",
    "sour cherry": "cherry",
}
MIXED_FLAVOURS = ("mixedfruit", "mixedfruits", "fruitmix", "mixed", "mix")
MAX_BRANDS = 3
MAX_RESULTS = 30
SNIPPET_LENGTH = 1400
VERIFIED_ABOVE, PARTIAL_ABOVE = 0.7, 0.55

# Reasons and notes written with a result.
NO_CANDIDATE = "The first VLM pass could not form a useful candidate."
NO_BRAND = "Brand identity could not be narrowed to a usable candidate set."
NO_BRAND_NOTE = "No usable brand candidate was produced."
REJECTED = "Final verification rejected the candidate."
BAD_BRAND = "Final brand could not be normalized safely."
BAD_FLAVOUR = "Final flavor could not be normalized safely."
BAD_SIZE = "Final package size could not be normalized safely."

FENCE = r"(?i)^```(?:json)?\s*|\s*```$"


def response_object(text: Column) -> Column:
    """struct<json, error>: the JSON object inside a model response, or why there is none."""
    cleaned = F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), FENCE, ""))

    def locate(c: Column) -> Column:
        return F.struct(c.alias("clean"), F.regexp_extract(c, r"(?s)\{.*\}", 0).alias("inner"))

    def parse(c: Column) -> Column:
        # The variant reader refuses repeated keys, of which the last value counts.
        keys = lambda part: F.json_object_keys(part)
        again = lambda part: F.size(keys(part)) > F.size(F.array_distinct(keys(part)))
        kind = lambda part: F.coalesce(
            F.schema_of_variant(F.try_parse_json(part)),
            F.when(F.endswith(part, F.lit("}")) & again(part), F.lit("OBJECT")),
        )
        whole = kind(c["clean"])
        return F.struct(
            F.when(whole.isNotNull(), c["clean"]).otherwise(c["inner"]).alias("body"),
            F.coalesce(whole, kind(c["inner"])).alias("kind"),
            c["clean"].alias("clean"),
        )

    def answer(c: Column) -> Column:
        is_object = F.coalesce(F.startswith(c["kind"], F.lit("OBJECT")), F.lit(False))
        error = (
            F.when(c["clean"] == "", F.lit("empty response"))
            .when(is_object, F.lit(None).cast("string"))
            .when(c["body"] == "", F.lit("no JSON found"))
            .when(c["kind"].isNull(), F.lit("malformed JSON"))
            .otherwise(F.lit("not a JSON object"))
        )
        return F.struct(F.when(is_object, c["body"]).alias("json"), error.alias("error"))

    return let(let(let(cleaned, locate), parse), answer)


def parse_responses(rows: DataFrame, text: str, schema) -> tuple[DataFrame, DataFrame]:
    """Parsed rows (adds ``response``) and rejected rows (adds ``error``)."""
    read = rows.withColumn("_r", response_object(F.col(text)))
    good = read.where(F.col("_r.error").isNull()).withColumn(
        "response", F.from_json(F.col("_r.json"), schema)
    )
    bad = read.where(F.col("_r.error").isNotNull()).withColumn("error", F.col("_r.error"))
    return good.drop("_r"), bad.drop("_r")


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fruits_in(words: Column) -> Column:
    """Canonical fruits named in already cleaned words, aliases first."""
    special = ("orange", "cherry", "passionfruit", "dragonfruit")
    aliases = F.array(
        *[
            F.struct(F.lit(phrase).alias("phrase"), F.lit(fruit).alias("fruit"))
            for phrase, fruit in FRUIT_ALIASES.items()
        ]
    )

    def found(text: Column) -> Column:
        has = lambda w: F.array_contains(F.split(text, " "), w)
        return F.concat(
            F.transform(
                F.filter(aliases, lambda a: F.contains(text, a["phrase"])), lambda a: a["fruit"]
            ),
            F.filter(_literals(("orange", "cherry")), has),
            F.transform(
                F.filter(_literals(("passion", "dragon")), lambda p: has(p) & has("fruit")),
                lambda p: F.concat(p, F.lit("fruit")),
            ),
            F.filter(_literals([f for f in FRUITS if f not in special]), has),
        )

    return ordered_unique(let(words, found))


def extract_fruits(text: Column) -> Column:
    return fruits_in(clean_words(text))


def normalise_fruits(rows: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Canonical fruit lists of array columns, one output column per entry of ``columns``.

    A word that names no fruit stays as its token.
    """

    def tag(name: str):
        return lambda v, p: F.struct(F.lit(name).alias("o"), p.alias("p"), v.alias("v"))

    tagged = F.concat(
        *[F.transform(F.coalesce(c, _no_text()), tag(o)) for o, c in columns.items()]
    )
    each = rows.select(key, F.inline(tagged)).select(
        key, "o", "p", clean_words(F.col("v")).alias("w"), compact_token(F.col("v")).alias("t")
    )
    named = each.withColumn("f", fruits_in(F.col("w"))).withColumn(
        "f", F.when(F.size("f") > 0, F.col("f")).otherwise(F.array("t"))
    )
    # As many entries as the arrays had.
    per = named.groupBy(key).agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("o") == o, F.struct("p", "f")))).alias(o)
            for o in columns
        ]
    ).select(key, *[ordered_unique(F.flatten(F.col(o)["f"])).alias(o) for o in columns])
    return rows.join(per, key, "left").withColumns(
        {o: F.coalesce(o, _no_text()) for o in columns}
    )


def _no_text() -> Column:
    return F.array().cast("array<string>")


def canonical_flavour(words: Column, given: Column, fruits: Column) -> Column:
    """Flavour from cleaned words and a canonical fruit list.

    ``given`` tells whether there was any text; text in another script leaves no words and gives ''.
    """

    def decide(c: Column) -> Column:
        text, every = c["words"], c["every"]
        first = F.coalesce(F.get(every, F.lit(0)), F.lit(""))
        tokens = F.filter(
            F.split(text, " "), lambda t: (t != "") & ~t.isin(*GENERIC_FLAVOUR_WORDS)
        )
        plain = F.array_join(tokens, "")
        return (
            F.when(F.size(every) >= 2, F.lit("mix"))
            .when((text == "") & c["given"], F.lit(""))
            .when(text == "", first)
            .when(F.array_contains(F.split(text, " "), "orange"), F.lit("orange"))
            .when(F.contains(text, F.lit("sour cherry")), F.lit("cherry"))
            .when(plain.isin(*MIXED_FLAVOURS), F.lit("mix"))
            .when((F.size(every) == 1) & F.startswith(plain, first), first)
            .when(plain != "", plain)
            .otherwise(first)
        )

    every = ordered_unique(F.concat(F.coalesce(fruits, _no_text()), fruits_in(words)))
    case = F.struct(words.alias("words"), given.alias("given"), every.alias("every"))
    return let(case, decide)


def flavour(text: Column, fruits: Column) -> Column:
    """Flavour of free text with a canonical fruit list."""
    return canonical_flavour(clean_words(text), F.coalesce(text, F.lit("")) != "", fruits)


def brand_candidates(
    rows: DataFrame, key: str, values: str, initial: str, cap: int = MAX_BRANDS
) -> DataFrame:
    """Distinct brand tokens in order, the first-pass brand last, at most ``cap``: adds brands."""
    listed = rows.select(key, F.posexplode_outer(values).alias("_p", "_v")).union(
        rows.select(key, F.lit(2**31 - 1).alias("_p"), F.col(initial).alias("_v"))
    )
    per = listed.select(key, F.coalesce("_p", F.lit(0)).alias("_p"), compact_token(F.col("_v")).alias("_t"))
    # As many entries as the model response listed.
    brands = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "_t"))).alias("_l"))
    return rows.join(
        brands.select(key, ordered_unique(F.col("_l._t"), cap).alias("brands")), key, "left"
    )


def exact_brand_match(results: DataFrame) -> DataFrame:
    """Marks results whose compacted title, snippet and url contain the brand token."""
    token = compact_token(F.col("brand"))
    text = compact_token(F.concat_ws(" ", "title", "snippet", "url"))
    return results.withColumn("exact", (token != "") & F.contains(text, token))


def dedupe_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old results plus new ones whose (brand, url, title) is not there yet; the first wins."""
    rows = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    keys = [F.lower(F.coalesce(c, F.lit(""))).alias(f"_k_{c}") for c in ("brand", "url", "title")]
    place = F.struct("_src", "pos")
    kept = rows.select("*", *keys).groupBy("_k_brand", "_k_url", "_k_title").agg(
        F.min_by(F.struct(*[c for c in rows.columns]), place).alias("r")
    )
    return kept.select("r.*").drop("_src")


def search_queries(rows: DataFrame, stage: str) -> DataFrame:
    """Query texts per brand candidate with their purpose and position.

    ``rows(id, brands ARRAY<STRING>, raw_flavour, flavour, size)``; stage is initial, flavor or size.
    """
    b = F.concat(F.lit('"'), F.col("brand"), F.lit('"'))
    quoted = lambda c: F.concat(F.lit(' "'), c, F.lit('"'))
    entry = lambda *parts, purpose: F.struct(
        F.concat(b, *parts).alias("query"), F.lit(purpose).alias("purpose")
    )
    size = F.col("size")
    fl = F.col("flavour")
    has_size, has_flavour = size != "", fl != ""
    if stage == "initial":
        flavours = ordered_unique(F.array("raw_flavour", "flavour"))
        per_flavour = F.flatten(
            F.transform(
                flavours,
                lambda f: F.filter(
                    F.array(
                        F.when(has_size, entry(quoted(f), quoted(size), F.lit(" beverage"), purpose="brand_flavor_size")),
                        entry(quoted(f), F.lit(" beverage"), purpose="brand_flavor"),
                    ),
                    lambda e: e.isNotNull(),
                ),
            )
        )
        lines = F.concat(
            per_flavour,
            F.array(
                F.when(has_size, entry(quoted(size), F.lit(" beverage"), purpose="brand_size")),
                entry(F.lit(" beverage juice"), purpose="brand_discovery"),
            ),
        )
    elif stage == "flavor":
        lines = F.array(
            F.when(has_flavour, entry(quoted(fl), F.lit(" beverage"), purpose="flavor_validation")),
            F.when(has_flavour & has_size, entry(quoted(fl), quoted(size), F.lit(" beverage"), purpose="flavor_validation")),
        )
    else:
        lines = F.array(
            F.when(has_flavour, entry(quoted(fl), F.lit(" ml beverage"), purpose="size_recovery")),
            F.when(has_flavour, entry(quoted(fl), F.lit(" volume size"), purpose="size_recovery")),
            F.when(~has_flavour, entry(F.lit(" ml beverage"), purpose="size_recovery")),
        )
    per_brand = rows.select("*", F.posexplode("brands").alias("brand_pos", "brand"))
    return per_brand.select(
        "id",
        "brand",
        "brand_pos",
        F.posexplode(F.filter(lines, lambda e: e.isNotNull())).alias("query_pos", "q"),
    ).select("id", "brand", "brand_pos", "query_pos", "q.query", "q.purpose")


def cap_results(
    results: DataFrame,
    total: int = MAX_RESULTS,
    keys: tuple[str, ...] = (),
    cap: int | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """First ``total / brands`` distinct results per brand in query order, empty ones dropped.

    ``results(brand, query_pos, pos, title, url, snippet)``; ``keys`` scope a case. The share counts
    the brands of ``asked(keys..., brand)``, the queries that were sent, so a brand without hits
    leaves the others' share alone; without it the brands that returned rows.
    """
    # Bodies are cut before they travel.
    results = results.withColumn("snippet", F.substring(F.trim("snippet"), 1, SNIPPET_LENGTH))
    clean = results.withColumns({
        **{c: F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "url")},
        "snippet": F.coalesce("snippet", F.lit("")),
    })
    clean = clean.where((F.col("title") != "") | (F.col("url") != "") | (F.col("snippet") != ""))
    marks = [F.lower("brand").alias("_b"), F.lower("url").alias("_u"), F.lower("title").alias("_t")]
    first = clean.select("*", *marks).groupBy(*keys, "_b", "_u", "_t").agg(
        F.min_by(F.struct(*clean.columns), F.struct("query_pos", "pos")).alias("r")
    ).select("r.*")
    brands = (results if asked is None else asked).select(*keys, "brand").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n")
    )
    limit = F.lit(cap) if cap else F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("_n")))
    order = Window.partitionBy(*keys, "brand").orderBy("query_pos", "pos")
    # The top `total` per brand are found map-side; the exact share per brand is cut afterwards.
    ranked = first.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= (cap or total))
    scoped = ranked.join(brands, list(keys)) if keys else ranked.join(F.broadcast(brands))
    return scoped.where(F.col("_rn") <= limit).drop("_rn", "_n")


def web_support(results: DataFrame, keys: tuple[str, ...] = (), titles: int = 5) -> DataFrame:
    """Per brand: result count, exact matches and the first exact titles."""
    order = Window.partitionBy(*keys, "brand").orderBy("pos", "title")
    first = (
        results.where("exact").withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= titles)
        .groupBy(*keys, "brand")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "title")))["title"].alias("exact_titles"))
    )
    counts = results.groupBy(*keys, "brand").agg(
        F.count(F.lit(1)).alias("results"), F.count_if("exact").alias("exact_results")
    )
    return counts.join(first, [*keys, "brand"], "left").withColumn(
        "exact_titles", F.coalesce("exact_titles", F.array().cast("array<string>"))
    )


def stage_gates(cases: DataFrame) -> DataFrame:
    """Next stage of each case: unresolved early, size recovery, or verification.

    ``cases`` carries ``initial`` (status, size) and ``brands``.
    """
    is_candidate = F.lower(F.trim(F.coalesce("initial.status", F.lit("")))) == "candidate"
    size = normalise_size(F.col("initial.size"))
    sized = cases.withColumn("initial_size", size)
    stage = (
        F.when(~is_candidate, F.lit("unresolved: no candidate"))
        .when(F.coalesce(F.size("brands"), F.lit(0)) <= 0, F.lit("unresolved: no brand"))
        .when(F.col("initial_size") == "", F.lit("recover size"))
        .otherwise(F.lit("verify"))
    )
    return sized.withColumn("stage", stage)


def passed_through_size(cases: DataFrame) -> DataFrame:
    """Size stage result for the cases whose first pass already read a valid size."""
    known = F.col("initial_size") != ""
    return cases.withColumn(
        "size_recovery",
        F.when(
            known,
            F.struct(
                F.lit("not_needed").alias("status"),
                F.col("initial_size").alias("size"),
                F.lit(True).alias("size_supported"),
                F.array().cast("array<string>").alias("evidence"),
                F.array().cast("array<string>").alias("conflicts"),
            ),
        ).otherwise(F.col("size_recovery")),
    )


def _first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.coalesce(v, F.lit("")), F.lit("")) for v in values])


def resolve(cases: DataFrame) -> DataFrame:
    """Verdict per case: id, status, label, brand, flavor, size, evidence, conflicts, reason.

    ``cases(id, initial, brands, flavor_recheck, size_recovery, verification)``: structs as
    answered by the stages; a missing stage is null.
    """
    none = _no_text()
    texts = lambda c: F.coalesce(F.col(c), none)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    has = lambda c: F.size(c) > 0
    rows = normalise_fruits(
        cases,
        "id",
        {
            "_fi": F.col("initial.fruits"),
            "_ff": F.col("flavor_recheck.fruits"),
            "_fv": F.col("verification.fruits"),
        },
    )
    final_text = _first_filled(F.col("verification.flavor"), F.col("flavor_recheck.flavor"))
    final_fruits = F.when(has("_fv"), F.col("_fv")).otherwise(F.col("_ff"))
    rows = rows.withColumns(
        {
            "_brand": compact_token(F.col("verification.brand")),
            "_brand0": compact_token(F.col("initial.brand")),
            "_size": normalise_size(
                _first_filled(F.col("verification.size"), F.col("size_recovery.size"))
            ),
            "_size_r": normalise_size(F.col("size_recovery.size")),
            "_size_i": normalise_size(F.col("initial.size")),
            "_words": F.array(
                clean_words(final_text),
                clean_words(F.col("flavor_recheck.flavor")),
                clean_words(F.col("initial.flavor")),
            ),
        }
    )
    spoken = lambda c: F.coalesce(c, F.lit("")) != ""
    sources = F.array(
        F.struct(F.col("_words")[0].alias("w"), spoken(final_text).alias("g"), final_fruits.alias("f")),
        F.struct(
            F.col("_words")[1].alias("w"),
            spoken(F.col("flavor_recheck.flavor")).alias("g"),
            F.col("_ff").alias("f"),
        ),
        F.struct(
            F.col("_words")[2].alias("w"),
            spoken(F.col("initial.flavor")).alias("g"),
            F.col("_fi").alias("f"),
        ),
    )
    rows = rows.withColumn(
        "_flavors", F.transform(sources, lambda s: canonical_flavour(s["w"], s["g"], s["f"]))
    )
    rows = rows.withColumns(
        {
            "_flavor": F.col("_flavors")[0],
            "_flavor_f": F.col("_flavors")[1],
            "_flavor_i": F.col("_flavors")[2],
        }
    )
    status0 = F.lower(F.trim(F.coalesce("initial.status", F.lit(""))))
    no_candidate = status0 != "candidate"
    no_brand = F.coalesce(F.size("brands"), F.lit(0)) <= 0
    early = no_candidate | no_brand
    flavor_ok = flag("flavor_recheck.flavor_supported") & (F.col("_flavor_f") != "")
    size_ok = (F.col("_size_i") != "") | (
        F.coalesce(F.col("size_recovery.status") == "recovered", F.lit(False))
        & flag("size_recovery.size_supported")
        & (F.col("_size_r") != "")
    )
    core = (
        flag("verification.image_supported")
        & flag("verification.brand_recheck_supported")
        & flavor_ok
        & size_ok
        & flag("verification.brand_supported")
        & flag("verification.flavor_supported")
        & flag("verification.size_supported")
    )
    web = F.lower(F.trim(F.coalesce("verification.web_status", F.lit(""))))
    web_ok = (web == "inconclusive") | ((web == "confirmed") & flag("verification.web_supported"))
    stage_conflicts = F.concat(
        texts("verification.conflicts"),
        texts("flavor_recheck.conflicts"),
        texts("size_recovery.conflicts"),
    )
    verdict = F.lower(F.trim(F.coalesce("verification.verdict", F.lit(""))))
    accepted = (
        ~early
        & (verdict == "accept")
        & core
        & web_ok
        & (F.size(stage_conflicts) == 0)
        & (F.col("_brand") != "")
        & (F.col("_flavor") != "")
        & (F.col("_size") != "")
    )
    late = lambda c: F.when(~early, c)
    first_brand = F.get("brands", F.lit(0))
    brand = _first_filled(
        late(F.col("_brand")), late(F.col("_brand0")), first_brand, F.col("_brand0")
    )
    # The re-check's own fruit list (else the first pass's) also decides the flavour read back.
    back_fruits = F.when(has("_ff"), F.col("_ff")).otherwise(F.col("_fi"))
    said = F.when(early, F.lit("")).otherwise(F.col("_flavor"))
    rows = rows.withColumn("_flavor_b", canonical_flavour(said, said != "", back_fruits))
    flav = _first_filled(F.col("_flavor_b"), F.col("_flavor_f"), F.col("_flavor_i"))
    size = _first_filled(late(F.col("_size")), F.col("_size_r"), F.col("_size_i"))
    missing = F.filter(
        F.array(
            F.when(F.col("_brand") == "", F.lit(BAD_BRAND)),
            F.when(F.col("_flavor") == "", F.lit(BAD_FLAVOUR)),
            F.when(
                F.col("_size") == "", F.lit(BAD_SIZE)
            ),
        ),
        lambda m: m.isNotNull(),
    )
    rows = rows.withColumns({"_accepted": accepted, "_b": brand, "_f": flav, "_s": size})
    ok = F.col("_accepted")
    any_field = F.coalesce("_b", "_f", "_s").isNotNull()
    partial = F.concat_ws(
        "_",
        F.coalesce("_b", F.lit("unknownbrand")),
        F.coalesce("_f", F.lit("unknownflavor")),
        F.coalesce("_s", F.lit("unknownsize")),
    )
    evidence = F.when(early, texts("initial.evidence")).otherwise(
        F.concat(
            texts("initial.evidence"),
            texts("flavor_recheck.evidence"),
            texts("size_recovery.evidence"),
            texts("verification.evidence"),
        )
    )
    conflicts = (
        F.when(ok, none)
        .when(no_candidate, texts("initial.conflicts"))
        .when(
            no_brand,
            F.concat(
                texts("initial.conflicts"),
                F.array(F.lit(NO_BRAND_NOTE)),
            ),
        )
        .otherwise(F.concat(texts("initial.conflicts"), stage_conflicts, missing))
    )
    reason = (
        F.when(no_candidate, F.lit(NO_CANDIDATE))
        .when(
            no_brand,
            F.lit(NO_BRAND),
        )
        .otherwise(
            _first_filled(
                F.col("verification.reason"), F.lit(REJECTED)
            )
        )
    )
    return rows.select(
        "id",
        F.when(ok, F.lit("verified"))
        .when(any_field, F.lit("partial"))
        .otherwise(F.lit("unresolved_unknown"))
        .alias("status"),
        F.when(ok, F.concat_ws("_", "_brand", "_flavor", "_size"))
        .when(any_field, partial)
        .alias("label"),
        F.when(ok, F.col("_brand")).otherwise(F.col("_b")).alias("brand"),
        F.when(ok, F.col("_flavor")).otherwise(F.col("_f")).alias("flavor"),
        F.when(ok, F.col("_size")).otherwise(F.col("_s")).alias("size"),
        evidence.alias("evidence"),
        conflicts.alias("conflicts"),
        reason.alias("reason"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def triage(items: DataFrame, approvals: DataFrame) -> DataFrame:
    """Status by confidence; a manual approval overrides it."""
    by_score = (
        F.when(F.col("confidence") > VERIFIED_ABOVE, F.lit("verified"))
        .when(F.col("confidence") > PARTIAL_ABOVE, F.lit("partial"))
        .otherwise(F.lit("unknown"))
    )
    approved = approvals.select("id").distinct().withColumn("_ok", F.lit(True))
    return items.join(approved, "id", "left").withColumn(
        "status", F.when(F.col("_ok"), F.lit("verified")).otherwise(by_score)
    ).drop("_ok")


def triage_view(items: DataFrame, tab: str | None = None, query: str = "") -> DataFrame:
    """Items of a tab whose brand, flavour and size text contains the query."""
    out = items if tab is None else items.where(F.col("status") == tab)
    q = query.strip()
    if q:
        out = out.where(F.contains(F.concat("brand", "flavor", "size"), F.lit(q)))
    return out
