"""Exact groups by tries and SimHash groups by vantage-point trees against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from aisleframe.llm import exact_dedup, simhash


def rows_with_copies(n=400, seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abé", k=rng.randrange(0, 9))) for _ in range(60)]
    base += [None, "", "x" * 200_000, "x" * 200_001]
    rows = [(k, rng.choice(base), "o") for k in range(n)]
    return rows + [(0, rows[0][1], "o"), (0, rows[0][1], "o"), (None, "ab", "o"), (None, "lonely", "o")]


SCHEMA = "doc_id bigint, text string, owner string"


def truth(rows, pick):
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(t or "", []).append(d)
    out = {}
    for t, ids in groups.items():
        own = pick([d for d in ids if d is not None], default=None)
        for d in ids:
            out[d, t] = (own, len(ids), d == own)
    return out


def test_groups_equal_brute_force(spark):
    rows = rows_with_copies()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    weak = lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))  # noqa: E731  many texts share it
    for keep, pick in (("max", max), ("min", min)):
        want = truth(rows, pick)
        for budget, digest in ((exact_dedup.TRIE_BYTES, exact_dedup.content_digest), (40, exact_dedup.content_digest),
                               (40, weak)):
            got = exact_dedup.groups(df, keep, budget, digest).collect()
            texts = {}
            for d, t, _ in rows:
                texts.setdefault(d, set()).add(t or "")
            assert len(got) == len(want)
            for r in got:
                assert any((r.keep_id, r.group_size, r.kept) == want[r.doc_id, t] for t in texts[r.doc_id])
        kept = exact_dedup.keep_owners(df, keep, 40)
        assert kept.columns == df.columns
        ours = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
        assert ours == sorted({(str(o[0]), t) for (_, t), o in want.items()})
    assert exact_dedup.groups(df.limit(0)).count() == 0


def test_trie_gives_up_whole_subtrees():
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randrange(0, 12))).encode() for _ in range(500)]
    trie, spilled = exact_dedup.Trie(), []
    for k, w in enumerate(words):
        if not trie.insert(w, k, 1, b""):
            spilled.append(w)
        while trie.bytes > 300 and (given := trie.give_up()):
            spilled += [t for t, _ in given]
    held = {t for t, _ in trie.terminals()}
    assert held | set(spilled) == set(words) and not held & set(spilled)
    assert all(n.owner == words.index(t) for t, n in trie.terminals())


def brute_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_a_plain_count(spark):
    rng = random.Random(5)
    texts = ["", None, "One", "one TWO", "É É x", "a b c\x0bd\x1ce", "x " * 100_000] + [
        " ".join(rng.choices(["A", "b", "éÉ", "dd", "E"], k=rng.randrange(1, 60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = simhash.fingerprints(df).select("doc_id", simhash.fingerprint_hex().alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == {k: f"{brute_fingerprint(t):016x}" for k, t in enumerate(texts)}


def crowd(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out) | {int(v) for v in rng.integers(0, 2**64, n, dtype=np.uint64)})


def test_links_equal_all_pairs(spark):
    for seed, shard, leaf in ((1, 10**6, 16), (2, 150, 16), (3, 60, 384)):
        points = np.array(crowd(seed, 400), np.uint64)
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
        signed = points.view(np.int64)
        i, j = np.nonzero(np.triu(near, 1))
        want = {tuple(sorted((int(signed[a]), int(signed[b])))) for a, b in zip(i, j)}
        df = spark.createDataFrame([(int(v),) for v in signed], "fp bigint")
        got = simhash.near_links(df, 2, shard, leaf, forest=False)
        assert {(r.a, r.b) for r in got.collect()} == want and want
        forest = {(r.a, r.b) for r in simhash.near_links(df, 2, shard, leaf).collect()}
        assert forest <= want and roots(forest) == roots(want)


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_groups_of_documents(spark):
    rng = random.Random(7)
    texts = []
    for k in range(30):
        w = [f"w{rng.randrange(500)}" for _ in range(400)]
        texts += [" ".join(w), " ".join(w), " ".join(w[:-1] + ["zz"])]
    rows = [(k, t, "c") for k, t in enumerate(texts + ["", None, " \t"])] + [(0, texts[0], "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    fps = {d: brute_fingerprint(t) for d, t, _ in rows}
    ids = sorted(fps)
    link = {(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2}
    root = {d: d for d in ids} | roots(link)
    got = simhash.near_groups(df).collect()
    assert len(got) == len(rows) and all(r.component_id == root[r.doc_id] for r in got)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(root.values())
    assert simhash.near_groups(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
