"""Periodic runs against a scan of every lag."""

import hashlib
import random
import zlib

import pytest

from aisleframe.llm import queries, runs

FOLDER = "/root/testdata/sf0.001"


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                span = (i, j - i + q)
                found.setdefault(span, q)  # the smallest period of a stretch comes first
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


CASES = [
    "", "a", "a a a a a", "a a a a a a", "x a a a a a a y", "a b " * 4, "a b " * 3, "a b " * 3 + "a",
    "a a b a a b a a b a a b", "a b c " * 9 + "d " + "a b c " * 9, "a " * 40 + "b " + "a " * 40,
    ("a " * 7 + "b ") * 6, ("a b " * 4 + "c ") * 5, "p q r s t u v w x y z " * 7 + "p q",
]


def test_cases():
    words = [c.encode().split() for c in CASES]
    assert runs.runs_of(words) == [brute(w) for w in words]
    assert any(len(r) > 1 for r in runs.runs_of(words))


@pytest.mark.parametrize("seed", range(6))
def test_random_words(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = []
        while len(words) < rng.choice((5, 80, 700)):
            unit = [rng.choice("abcdefgh"[: rng.randint(1, 8)]).encode() for _ in range(rng.choice((1, 2, 3, 7, 8, 9, 15, 16, 31, 32, 33, 63)))]
            words += unit * rng.choice((1, 1, 2, 3, 4, 5, 9))
            words = words[: len(words) - rng.randint(0, 3)]
        texts.append(words)
    got = runs.runs_of(texts)
    assert got == [brute(w) for w in texts]
    assert {q.bit_length() for r in got for _, _, q in r} >= {1, 2, 3, 4, 5, 6}


def test_long_periods():
    rng = random.Random(3)
    unit = [str(rng.randint(0, 400)).encode() for _ in range(3000)]
    words = [b"x"] + unit * 4 + unit[:50] + [b"y"]
    assert runs.runs_of([words, unit * 3]) == [[(1, 12050, 3000)], []]
    assert runs.runs_of([[b"w"] * 50_000]) == [[(0, 50_000, 1)]]


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, runs int, start string"
    rows = [(1, None, 1, "q"), (2, "", 1, None), (3, " \t\n ", 1, ""), (None, "z " * 9, 1, ""), (4, "z " * 9, 1, ""),
            (4, "z " * 9, 1, ""), (5, "é x é x é x é x é x é x", None, None), (6, "w " * 300_000 + "é", 0, "")]
    got = sorted(map(tuple, runs.summary(runs.periodic_runs(spark.createDataFrame(rows, schema))).collect()), key=str)
    for doc, text, _, _ in rows:
        words = (text or "").encode().split()
        found = [(0, 300_000, 1)] if doc == 6 else brute(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        text_left = brute_collapsed([w.decode() for w in words], found)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want = (doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text_left.encode()).hexdigest())
        assert want in got
    assert len(got) == len(rows)
    assert runs.periodic_runs(spark.createDataFrame([], schema)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, FOLDER, "documents").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op13_minimizer_runs"](spark, FOLDER).collect()}
    assert got.keys() == texts.keys() and any(r.n_runs for r in got.values())
    for doc, text in texts.items():
        words = planted(doc, text or "")
        found = brute(words)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert got[doc].n_runs == len(found)
        assert got[doc].runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert got[doc].collapsed_sha256 == hashlib.sha256(brute_collapsed(words, found).encode()).hexdigest()


def test_planted_rows_of_any_kind(spark):
    chosen = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    texts = ["", None, " \t\n", "a", " x  y\tz " * 9, "é " * 50]
    rows = [*zip(chosen, texts), (None, "a b"), (chosen[4], texts[4])]
    got = runs.with_planted_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    want = {(d, " ".join(planted(d, t or "")) if d is not None else t) for d, t in rows}
    assert {(r.doc_id, " ".join(r.text.split())) for r in got} == want
