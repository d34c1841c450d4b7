"""URL rules against plain parsing and a count of all token combinations."""

import itertools
import math
import random
import re
from collections import Counter

from aisleframe.llm import urls

SCHEMA = "page_id bigint, url string, html string, host int, rule string"


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def brute_rule(host, path):
    fits = [(len(r), r, v) for v, r in urls.LISTED
            if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/"):])]
    return max(fits)[1:] if fits else (None, None)


def brute_mine(rows, share=64, least=5, confidence=0.5):
    least = max(least, math.ceil(len(rows) / share))
    bad = Counter(t for tokens, b in rows if b for t in tokens)
    words = sorted((w for w in bad if bad[w] >= least), key=lambda w: (-bad[w], w))[: urls.VOCABULARY]
    place = {w: i for i, w in enumerate(words)}
    both, alone = Counter(), Counter()
    for tokens, b in rows:
        known = sorted((t for t in tokens if t in place), key=place.get)[: urls.PER_URL]
        for n in range(1, urls.PER_RULE + 1):
            for c in itertools.combinations(known, n):
                alone[c] += 1
                both[c] += bool(b)
    return sorted((c, both[c] / alone[c]) for c in both if both[c] >= least and both[c] / alone[c] >= confidence)


URLS = [
    None, "", "example.com/en/", "://", "http://", "http://COM", "http://com/", "HTTP://WWW.Example.COM/en/1?x=/es/#a?b",
    "http://example.com/en/", "http://m.example.com/en/x", "http://www.example.com/EN/x", "https://a.net/es/1", "https://net/fr/",
    "https://notnet/fr/", "https://a.net?x=/fr/", "https://a.net#/fr/", "https://u:p@h.org:80/a//b/../c?k=1&k=2&&=3&z#frag9\nx",
    "x://é.org/ü", "https://a.com/" + "q" * 5000, "https://a.org/" + "/".join(f"s{i}x" for i in range(3000)),
]


def test_parts_and_listed_rules(spark):
    rows = [(i, u, None, 1, "r") for i, u in enumerate(URLS)] + [(None, URLS[8], "", 2, None), (8, URLS[8], "", 2, None)]
    got = urls.judged(spark.createDataFrame(rows, SCHEMA), []).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = brute_parts(URLS[8 if r.page_id is None else r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_tokens(spark):
    df = spark.createDataFrame([(URLS[16],), (None,), ("plain",)], "url string")
    got = [sorted(r.t) for r in df.select(urls.tokens_of().alias("t")).collect()]
    assert got == [sorted(["s:https", "h:u:p@h", "h:org:80", "p:a", "p:b", "p:..", "p:c", "q:k", "q:z", "f:frag0\nx"]), [], []]


def test_mined_rules(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        host, seg = rng.choice("abcd"), rng.choice(("buy", "read", "win"))
        url = f"https://{host}.org/{seg}/{i}?{rng.choice(('ref', 'page'))}=1{rng.choice(('', '#top'))}"
        rows.append((url, rng.random() < (0.9 if host == "a" and seg == "win" else 0.1)))
    rows += [("https://hot.org/x/1", False)] * 500 + [(None, True), ("https://a.org/win/1", None)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = [(r.t, r.bad) for r in df.select(urls.tokens_of().alias("t"), "bad").collect() if r.bad is not None]
    rules = urls.mine(df)
    assert rules == brute_mine(tokens) and any(set(w) == {"h:a", "p:win"} for w, _ in rules)
    pages = spark.createDataFrame([(i, u, "", 0, "") for i, (u, _) in enumerate(rows)], SCHEMA)
    for r in urls.judged(pages, rules, listed=()).collect():
        have = set(tokens[min(r.page_id, len(tokens) - 1)][0]) if r.page_id < len(tokens) else {"s:https", "h:a", "h:org", "p:win", "p:0"}
        fit = [(-s, len(w), " ".join(w)) for w, s in rules if set(w) <= have]
        assert (r.terms, r.confidence) == ((min(fit)[2], -min(fit)[0]) if fit else (None, None))
        assert r.verdict == ("block" if fit else "allow")


def test_exact_rules_beyond_the_bounds(spark):
    """Neither the bound on a URL's tokens nor that on all tokens drops a rule when asked for all."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(9)]
    rows = []
    for i in range(400):
        own = rng.sample(words, 5)
        rows.append(("https://" + ".".join(own) + "/", rng.random() < (0.9 if "w8" in own else 0.2)))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    want = urls.mine(df)
    assert urls.mine(df, exact=True) == want and any(len(w) == 3 for w, _ in want)
    assert urls.mine(df, vocabulary=4) != want and urls.mine(df, per_url=2) != want
    assert urls.mine(df, vocabulary=4, exact=True) == want
    assert urls.mine(df, per_url=2, exact=True) == want


def test_no_labels(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    assert urls.mine(none) == [] and urls.judged(spark.createDataFrame([], SCHEMA), []).count() == 0
    many = "https://" + ".".join(f"h{i}" for i in range(400)) + "/"
    same = spark.createDataFrame([(many, True)] * 50, "url string, bad boolean")
    assert len(urls.mine(same)) == 12 + 66 + 220
    pages = spark.createDataFrame([(1, "u"), (2, None)], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 0), (2, None, None), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert [tuple(r) for r in urls.labelled_pages(pages, labels).collect()] == [("u", True)]
