"""URL filter: hand-written rules first, then association rules mined from labels.

A URL becomes a set of tokens (scheme, host labels, path segments and query keys with their digits
folded, fragment). FP-growth mines token combinations that go with a bad label; those with enough
support and confidence are kept and matched through an inverted index: a rule is looked up under its
rarest token only, so a URL meets the few rules that could fit it. Matching needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import folder_table

# (verdict, host and beginning of the path); the longest that fits a URL decides.
LISTED = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
BLOCK = "block"
# A combination must stand in one of 64 labelled URLs, and in five at least.
SHARE, LEAST = 64, 5
CONFIDENCE = 0.5
# Fitted on the tokens most often labelled bad, at most so many of one URL, up to three in a rule.
VOCABULARY, PER_URL, PER_RULE = 256, 12, 3
LONG_TOKEN = 64
# Combinations that leave a task at a time.
STEP_COMBOS = 100_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def after_scheme(url: str = "url") -> Column:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")


def host_of(url: str = "url") -> Column:
    return lowered(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0))


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def tokens_of(url: str = "url") -> Column:
    """Distinct tokens, each with a letter for its place; long ones by their digest."""
    rest = after_scheme(url)
    scheme = F.when(F.instr(url, "://") > 0, lowered(F.substring_index(url, "://", 1))).otherwise("")
    query = F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1)
    fold = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    groups = {
        "s": F.array(scheme),
        "h": F.split(host_of(url), "[.]"),
        "p": F.transform(F.split(path_of(url), "/"), fold),
        "q": F.transform(F.split(query, "&"), lambda x: fold(F.substring_index(x, "=", 1))),
        "f": F.array(fold(F.regexp_extract(rest, "(?s)#(.*)", 1))),
    }
    short = lambda x: F.when(F.length(x) > LONG_TOKEN, F.md5(x.cast("binary"))).otherwise(x)

    def marked(kind: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), short(x)))

    named = [marked(k, v) for k, v in groups.items()]
    return F.when(F.col(url).isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*named)))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = LISTED) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    name = verdict = F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        of, _, start = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def mine(
    labelled: DataFrame, share: int = SHARE, least: int = LEAST, confidence: float = CONFIDENCE,
    vocabulary: int = VOCABULARY, per_url: int = PER_URL, exact: bool = False,
) -> list[tuple[tuple[str, ...], float]]:
    """Rules (tokens, confidence) of ``labelled`` (url, bad), tokens by falling count of bad URLs.

    All labelled rows count; rows with a null label do not, null URLs have no tokens. At most
    ``vocabulary`` tokens, ``per_url`` of them in a URL and PER_RULE in a rule enter, so there are no
    more than (number of such combinations in a URL) x ``share`` rules whatever the table holds: at
    most 19,072 of short tokens with the bounds above. No labelled row, no rule. With ``exact`` all tokens
    with enough support enter, all of them of a URL: where the bounds would drop one, combinations are
    counted by level.
    """
    rows = folder_table(
        labelled.where("bad is not null").select(tokens_of().alias("tokens"), F.col("bad").cast("boolean").alias("bad")),
        "labelled_urls",
    )
    total = rows.count()
    least = max(least, -(-total // share))
    often = (
        rows.where("bad").select(F.explode("tokens").alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        .orderBy(F.desc("n"), "token")
    )
    # A token needs one in `share` URLs, so there are at most `share` times the mean tokens of a URL.
    words = [r.token for r in (often if exact else often.limit(vocabulary)).collect()]
    if not words:
        return []
    if exact:
        place = {w: i for i, w in enumerate(words)}
        if len(words) > vocabulary or _most_known(rows, place) > per_url:
            return _mined_by_level(rows, place, least, confidence)
    known = F.array_intersect(F.array(*[F.lit(w) for w in words]), "tokens")
    items = F.concat(F.slice(known, 1, per_url), F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>")))
    # Half a row less keeps the least count whole when it is multiplied back.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=confidence).fit(rows.select(items.alias("items")))
    kept = model.associationRules.where(
        (F.col("consequent")[0] == BLOCK) & (F.size("antecedent") <= PER_RULE)
    ).select("antecedent", "confidence").collect()
    place = {w: i for i, w in enumerate(words)}
    return sorted((tuple(sorted(r.antecedent, key=place.get)), r.confidence) for r in kept)


def _most_known(rows: DataFrame, place: dict[str, int]) -> int:
    """The most tokens of one URL that have a place."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [sum(t in place for t in tokens) for tokens in b["tokens"]]}, dtype="int64")

    return rows.select("tokens").mapInPandas(count, "n bigint").agg(F.max("n")).first()[0] or 0


def _mined_by_level(
    rows: DataFrame, place: dict[str, int], least: int, confidence: float
) -> list[tuple[tuple[str, ...], float]]:
    """Rules of up to PER_RULE of the tokens. A combination is counted if all its parts have support."""
    names, found, supported = list(place), [], None
    for size in range(1, PER_RULE + 1):
        known = supported

        def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                combos, bad = [], []
                for tokens, is_bad in zip(b["tokens"], b["bad"]):
                    have = sorted(place[t] for t in tokens if t in place)
                    for c in _combos(have, size, known):
                        combos.append(c)
                        bad.append(is_bad)
                        if len(combos) == STEP_COMBOS:
                            yield pd.DataFrame({"combo": combos, "bad": bad})
                            combos, bad = [], []
                yield pd.DataFrame({"combo": pd.Series(combos, dtype=object), "bad": pd.Series(bad, dtype=bool)})

        counts = rows.mapInPandas(grown, "combo array<int>, bad boolean").groupBy("combo").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("hits")
        ).where(F.col("hits") >= least).collect()
        supported = {tuple(r.combo) for r in counts}
        found += [(tuple(names[i] for i in r.combo), r.hits / r.n) for r in counts if r.hits / r.n >= confidence]
    return sorted(found)


def _combos(have: list[int], size: int, known: set | None) -> Iterator[tuple[int, ...]]:
    """Combinations of ``size`` whose parts one smaller are known."""
    if known is None:
        yield from ((i,) for i in have)
        return
    for start in combinations(have, size - 1):
        if start in known:
            for i in have:
                c = (*start, i)
                if i > start[-1] and all(p in known for p in combinations(c, size - 1)):
                    yield c


def matcher(rules: Sequence[tuple[tuple[str, ...], float]]):
    """A column function: the surest rule whose tokens a URL has (then the shortest, then by name)."""
    index: dict[str, list[tuple[float, int, str, frozenset]]] = {}
    for words, sure in rules:
        index.setdefault(words[-1], []).append((-sure, len(words), " ".join(words), frozenset(words)))

    @F.pandas_udf("terms string, confidence double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for words in batch:
                have = set(words)
                fit = [r for w in have & index.keys() for r in index[w] if r[3] <= have]
                sure, _, name, _ = min(fit, key=lambda r: r[:3], default=(None, 0, None, None))
                out.append((name, None if sure is None else -sure))
            yield pd.DataFrame(out, columns=["terms", "confidence"])

    return best


def judged(pages: DataFrame, rules: Sequence[tuple[tuple[str, ...], float]], listed: Sequence[tuple[str, str]] = LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule that fits (terms, confidence) per row.

    A listed rule decides; else a URL is blocked if a mined rule fits it. Null URLs and those without
    ``://`` have an empty host and path and are allowed unless a mined rule fits. Repeated rows and
    null ids each give their own row; columns other than page_id and url are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), host_of().alias("host"), path_of().alias("path"),
        matcher(rules)(tokens_of()).alias("mined"),
    )
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    by_method = F.when(F.col("mined.terms").isNotNull(), BLOCK).otherwise("allow")
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"),
        "mined.terms", "mined.confidence",
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad of the pages whose id has labels: bad if one of them says quality 0 or toxic 1."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))
    marks = labels.where("quality is not null or toxic is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return pages.select(F.col("page_id").alias("doc_id"), "url").join(marks, "doc_id").select("url", "bad")
