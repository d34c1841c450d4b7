"""Spaced seeds against a slide of every item over every text."""

import random
import re

import numpy as np

from aisleframe.llm import decontam


def words(text):
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def brute(docs, items, overlap, identity):
    out = set()
    for d, text in docs:
        t = words(text)
        for i, item in items:
            w = words(item)
            if len(w) < decontam.LEAST_TOKENS:
                continue
            need = min(overlap, len(w))
            for shift in range(-len(w) + 1, len(t)):
                eq = [0 <= k + shift < len(t) and t[k + shift] == w[k] for k in range(len(w))]
                if sum(eq) < identity * need - 1e-9:
                    continue
                ok = [0 <= k + shift < len(t) for k in range(len(w))]
                for a in range(len(w)):
                    if not eq[a]:
                        continue
                    for b in range(a + need, len(w) + 1):
                        if eq[b - 1] and all(ok[a:b]) and sum(eq[a:b]) >= identity * (b - a) - 1e-9:
                            out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice((3, 6, 15, 30))))) for k in range(12)]
    docs = []
    for d in range(60):
        t = rng.choices(vocab, k=rng.randrange(0, 60))
        if d % 2:
            w = words(items[d % 12][1])
            for _ in range(rng.randrange(0, max(1, len(w) // 5))):
                w[rng.randrange(len(w))] = "zz"
            at = rng.randrange(len(t) + 1)
            t[at:at] = w
        docs.append((d, ", ".join(t).title()))
    docs += [(100, None), (101, ""), (102, docs[1][1]), (102, docs[1][1])]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id bigint, text string")
    want = brute(docs, items, decontam.OVERLAP, decontam.IDENTITY)
    for size in (decontam.BLOCK_TOKENS, 20):
        got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench, block_tokens=size).collect()}
        assert got == want and len(want) > 15
        kept = decontam.without_leaks(df, bench, block_tokens=size)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_long_texts_are_read_to_their_end(spark):
    item = " ".join(f"q{k}" for k in range(20))
    long = "abc def " * 400_000 + item
    df = spark.createDataFrame([(1, long), (2, "x" * 3_000_000), (3, "abc def " * 10)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = decontam.leaks(df, bench).collect()
    assert [(r.doc_id, r.item_id, r.overlap_tokens, r.doc_start) for r in got] == [(1, 7, 20, 800_000)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.leaks(docs, bench).count() == 0
    assert decontam.without_leaks(docs, bench).count() == 1
    assert decontam.leaks(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_longest_stretch():
    f = lambda s: decontam.longest_stretch(np.array([c == "1" for c in s]), 0.8)
    assert f("1111011110") == (0, 9)
    assert f("0001111000") == (3, 7)
    assert f("0000") == (0, 0)
    assert f("110000011110111101111") == (7, 21)


def test_longest_stretch_is_trimmed_before_it_is_compared(spark):
    f = lambda s: decontam.longest_stretch(np.array([c == "1" for c in s], bool), 0.8)
    assert f("1" * 11 + "0" * 10 + "1" * 12) == (21, 33)
    rng = random.Random(9)
    for _ in range(2000):
        s = "".join(rng.choices("01", weights=(1, rng.choice((1, 2, 4))), k=rng.randrange(0, 40)))
        sizes = [b - a for a in range(len(s)) for b in range(a + 1, len(s) + 1)
                 if s[a] == s[b - 1] == "1" and s[a:b].count("1") >= 0.8 * (b - a) - 1e-9]
        a, b = f(s)
        assert b - a == max(sizes, default=0), s
    item = [f"q{k}" for k in range(33)]
    text = item[:11] + ["zz"] * 10 + item[21:]
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert [(r.overlap_tokens, r.doc_start) for r in decontam.leaks(docs, bench).collect()] == [(12, 21)]
    assert decontam.without_leaks(docs, bench).count() == 0
