"""Near copies by five-word shingles: recall on planted pairs, exact links, crowds, odd rows."""

import random

import corpus_pipeline
import numpy as np
import pytest

from aisleframe.llm import near_copies
from aisleframe.llm.simhash import shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def jaccard(a, b):
    x, y = (set(shingles(t.encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, w, k):
    w = list(w)
    for at in rng.sample(range(len(w)), k):
        w[at] = "zz"
    return w


@pytest.fixture(scope="module")
def planted():
    """Pairs with a similarity of 0.8 to 0.95, pairs just below, and texts of their own."""
    rng = random.Random(8)
    rows, pairs, below = [], [], 0
    while len(pairs) < 300 or below < 60:
        w = words(rng, rng.randrange(60, 500))
        a, b = " ".join(w), " ".join(changed(rng, w, rng.randrange(1, 1 + len(w) // 35)))
        s = jaccard(a, b)
        if 0.8 <= s <= 0.95 and len(pairs) < 300:
            pairs.append((len(rows), len(rows) + 1))
        elif 0.7 <= s < 0.8 and below < 60:
            below += 1
        else:
            continue
        rows += [(len(rows), a), (len(rows) + 1, b)]
    rows += [(len(rows) + k, " ".join(words(rng, 80))) for k in range(200)]
    return rows, set(pairs)


@pytest.mark.parametrize("block", [256, 4])
def test_recall_and_exact_links(spark, planted, block):
    rows, pairs = planted
    got = {(r.a, r.b) for r in near_copies.near_copy_links(frame(spark, rows), block=block).collect()}
    assert got <= pairs
    assert len(got) >= 0.97 * len(pairs)


def test_crowds_and_growth(spark):
    """One group however it is cut, and no more candidates per text in a group twice as large."""
    rng = random.Random(4)
    base = words(rng, 300)
    rate = []
    for n in (300, 600):
        rows = [(k, " ".join(changed(rng, base, 3))) for k in range(n)] + [(n, "a b c d e f g h")]
        block = 256 if n == 300 else 16
        left = near_copies.without_copies(frame(spark, rows), block=block)
        assert sorted(r.doc_id for r in left.collect()) == [0, n]
        own = near_copies.sketched(frame(spark, rows))
        rate.append(near_copies.candidates(own, 16).count() / n)
    assert rate[1] < 1.2 * rate[0] and rate[1] < 2 * near_copies.TREES


def test_sketches_estimate_the_similarity():
    rng = random.Random(2)
    w = words(rng, 800)
    a, b = (shingles(" ".join(x).encode(), 5) for x in (w, changed(rng, w, 14)))
    true = jaccard(" ".join(w), " ".join(changed(random.Random(2), w, 0)))
    assert true == 1
    low = near_copies.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
    x, y = set(a.tolist()), set(b.tolist())
    assert abs((low[0] == low[1]).mean() - len(x & y) / len(x | y)) < 0.15
    keys = near_copies.tree_keys(low)
    same = (low[0] == low[1]).reshape(near_copies.TREES, -1)
    for k, depth in enumerate(near_copies.DEPTHS):
        assert (keys[0, :, k] == keys[1, :, k]).tolist() == same[:, :depth].all(axis=1).tolist()


def test_odd_rows(spark):
    long = "l " * 150_000 + " ".join(f"x{k}" for k in range(2000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  b"), (6, "a c"), (None, "a b"), (7, "a b c d e f g"), (7, "q"),
            (8, "a b c d e f g"), (9, long), (10, long + " end"), (11, "q"), (11, "q")]
    left = sorted((str(r.doc_id), r.text) for r in near_copies.without_copies(frame(spark, rows)).collect())
    want = [(1, None), (4, "a b"), (6, "a c"), (None, "a b"), (7, "a b c d e f g"), (7, "q"), (9, long)]
    assert [d for d, _ in left] == sorted(str(d) for d, _ in want)
    assert near_copies.without_copies(frame(spark, [])).count() == 0


def test_the_stage_keeps_one_of_each_pair(spark, planted):
    rows, pairs = planted
    kept = {r.doc_id for r in corpus_pipeline.near(spark, frame(spark, rows), None).collect()}
    gone = {b for _, b in pairs} - kept
    assert {d for d, _ in rows} - kept == gone and len(gone) >= 0.97 * len(pairs)


def test_no_link_is_lost(spark, planted, monkeypatch):
    """Components equal those of all pairs, whatever the groups hold, and even if they name no candidate."""
    rows, _ = planted
    rng = random.Random(12)
    base = words(rng, 120)
    crowd = [(10_000 + k, " ".join(changed(rng, base, rng.randrange(1, 6)))) for k in range(150)]
    rows = rows[:300] + crowd + [(20_000, ""), (20_001, " "), (20_002, "a b"), (20_003, "a b")]
    sets = {d: set(shingles(t.encode(), 5).tolist()) for d, t in rows}
    smallest = {d: d for d in sets}

    def top(x):
        while smallest[x] != x:
            x = smallest[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if len(x & y) >= 0.8 * len(x | y) - 1e-9 and top(a) != top(b):
                lo, hi = sorted((top(a), top(b)))
                smallest[hi] = lo
    want = {d for d in ids if top(d) == d}
    assert 150 < len(want) < len(ids)
    for block in (256, 4):
        left = {r.doc_id for r in near_copies.without_copies(frame(spark, rows), block=block).collect()}
        assert left == want
    monkeypatch.setattr(near_copies, "candidates", lambda own, block: own.select(
        own.doc_id.alias("a"), own.doc_id.alias("b")).limit(0))
    monkeypatch.setattr(near_copies, "ORDER_LEAST", 2)
    left = {r.doc_id for r in near_copies.without_copies(frame(spark, rows)).collect()}
    assert left == want


def test_parity_maps_leave_out_no_link():
    rng = random.Random(6)
    texts = [["a"], ["a"], []]
    for n in (5, 9, 40, 130, 600):
        base = words(rng, n)
        texts += [changed(rng, base, min(n, k)) for k in (0, 0, 1, 2, 5, 20)] + [base + words(rng, n // 4)]
    hashes = [np.unique(shingles(" ".join(w).encode(), 5)) for w in texts]
    hashes = [h if len(h) else np.zeros(1, np.uint64) for h in hashes]
    maps = np.array([near_copies.parity_map(h) for h in hashes], object)
    assert len({len(m) for m in maps}) > 3
    x, y = np.triu_indices(len(texts), 1)
    size = np.array([len(h) for h in hashes])
    allowed = near_copies.maps_allow(x, y, size, maps, 0.8)
    true = np.array([len(np.intersect1d(hashes[a], hashes[b])) / len(np.union1d(hashes[a], hashes[b])) for a, b in zip(x, y)])
    assert allowed[true >= 0.8].all() and (true >= 0.8).sum() > 20
    alike = np.minimum(size[x], size[y]) >= 0.8 * np.maximum(size[x], size[y])
    assert allowed[alike & (true < 0.4)].mean() < 0.05


def test_a_crowd_of_unlike_texts_is_not_joined_pair_by_pair(spark):
    """Texts that share a rare stretch but little else meet on it; no pair of them reaches the texts."""
    rng = random.Random(21)
    shared = [f"s{k}" for k in range(40)]
    rows = [(k, " ".join(words(rng, 90) + shared)) for k in range(120)]
    docs = frame(spark, rows)
    own = near_copies.sketched(docs)
    none = spark.createDataFrame([], "node bigint, component bigint")
    assert near_copies.unjoined_candidates(docs, own, none, 0.8).count() < len(rows)
