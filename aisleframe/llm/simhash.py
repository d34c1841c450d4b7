"""SimHash near-dedup with vantage-point trees over the distinct fingerprints.

Fingerprints are dealt into shards by a tree of vantage points: at a node with point v and bound t a
fingerprint goes inside when its distance to v is small and outside when it is large, and to both
when it is so near the bound that a partner may be on the other side (triangle inequality). Any two
fingerprints within the radius thus meet in a shard, where trees of the same kind end in leaves
that are compared pair by pair. Shards hand on a spanning forest of what they found, so crowds of
near copies are not written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import folder_table, kept_rows, slices, whole_text
from aisleframe.operators.clustering import connected_components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
# Fingerprints that one shard should hold, rows per leaf, sample rows that fit one shard's split.
SHARD_ROWS = 200_000
LEAF_ROWS = 384
SAMPLE_PER_SHARD = 64
LEAST_SAMPLE, MOST_SAMPLE = 4096, 1 << 18
CANDIDATES = 6


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of the word shingles of the A-Z lower-cased text, of all words if there are fewer."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    plain = b" ".join(tokens)
    hashed = xxhash.xxh64_intdigest
    n = len(tokens)
    if n <= words:
        return np.array([hashed(plain, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.empty(n, np.int64)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    spans = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((hashed(plain[a:b], SEED) for a, b in spans), np.uint64, n - words + 1)


def text_fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over word shingles of the A-Z lower-cased text; 0 without words."""
    return fingerprint_of(shingles(text, words))


def fingerprint_of(h: np.ndarray) -> int:
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) per row. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            fps = [text_fingerprint(t, words) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=["doc_id", "fp"],
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("body")
    )
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def distances(points: np.ndarray, centre) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(centre))


def choose_split(points: np.ndarray, radius: int) -> tuple[int, int] | None:
    """Vantage point and bound whose larger side is smallest; None when nothing splits."""
    n = len(points)
    best = None
    for i in range(CANDIDATES):
        v = points[(2 * i + 1) * n // (2 * CANDIDATES)]
        counts = np.bincount(distances(points, v), minlength=65).cumsum()
        # Inside up to t + reach, outside from t + reach + 1 - radius on.
        for t in range(64 - radius):
            inside, outside = counts[t + radius - 1], n - (counts[t - 1] if t else 0)
            worst = max(inside, outside)
            if best is None or worst < best[0]:
                best = (worst, int(v), t)
    return None if best is None or best[0] > 0.9 * n else best[1:]


def sides(points: np.ndarray, split: tuple[int, int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks inside and outside. Two points within ``radius`` share a side: were one only inside
    (distance below t) and the other only outside (distance above t + radius - 1), their distances
    to the vantage point would differ by more than ``radius``."""
    d = distances(points, split[0])
    return d <= split[1] + radius - 1, d >= split[1]


def build_tree(sample: np.ndarray, depth: int, radius: int):
    """Nested (vantage, bound, inside, outside); leaves are None."""
    if depth == 0 or len(sample) < 2 * SAMPLE_PER_SHARD:
        return None
    split = choose_split(sample, radius)
    if split is None:
        return None
    a, b = sides(sample, split, radius)
    return (
        *split, build_tree(sample[a], depth - 1, radius), build_tree(sample[b], depth - 1, radius),
    )


def place(points: np.ndarray, tree, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions of the points in it)."""
    stack = [(tree, np.arange(len(points)), 1)]
    while stack:
        node, at, name = stack.pop()
        if not len(at):
            continue
        if node is None:
            yield name, at
            continue
        a, b = sides(points[at], node[:2], radius)
        stack += [(node[2], at[a], 2 * name), (node[3], at[b], 2 * name + 1)]


def leaf_pairs(points: np.ndarray, radius: int, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position pairs within the radius; a pair may come more than once."""
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        n = len(at)
        if n < 2:
            continue
        split = choose_split(points[at], radius) if n > leaf else None
        if split is None:
            # Leaves, and crowds that no vantage point parts, in bounded blocks.
            for low in range(0, n, leaf):
                own = points[at[low : low + leaf]]
                for other in range(low, n, 4 * leaf):
                    more = points[at[other : other + 4 * leaf]]
                    i, j = np.nonzero(np.bitwise_count(own[:, None] ^ more[None, :]) <= radius)
                    up = i + low < j + other
                    if up.any():
                        yield at[i[up] + low], at[j[up] + other]
            continue
        a, b = sides(points[at], split, radius)
        stack += [at[a], at[b]]


def find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def spanning(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    parent, edges = np.arange(n), []
    for i, j in found:
        fresh = parent[i] != parent[j]
        for x, y in zip(i[fresh].tolist(), j[fresh].tolist()):
            a, b = find(parent, x), find(parent, y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((x, y))
        parent = parent[parent]
    return edges


def near_links(
    distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS,
    leaf_rows: int = LEAF_ROWS, forest: bool = True,
) -> DataFrame:
    """Links a < b between distinct fingerprints ``fp`` at ``radius`` or fewer differing bits.

    With ``forest`` only as many as keep the components (each of them a real link), else every pair.
    The top tree is fitted on a sample of 64 rows per shard, 4096 at least and 262,144 at most; it
    only decides where fingerprints meet, never whether. Beyond that shards grow, at eight bytes a row.
    """
    total = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total / shard_rows)))))
    tree = None
    if depth:
        wanted = max(LEAST_SAMPLE, SAMPLE_PER_SHARD * 2 ** (depth + 1))
        share = min(1.0, min(wanted, MOST_SAMPLE) / total)
        picked = distinct.where(
            F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(1_000_000)) < int(share * 1_000_000) + 1
        )
        sample = np.array(sorted(r[0] for r in picked.select("fp").collect()), np.int64)
        tree = build_tree(np.random.default_rng(5).permutation(sample.view(np.uint64)), depth, radius)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            signed = frame["fp"].to_numpy(np.int64)
            for shard, at in place(signed.view(np.uint64), tree, radius):
                yield pd.DataFrame({"shard": np.int64(shard), "fp": signed[at]})

    def search(group: pd.DataFrame) -> pd.DataFrame:
        signed = np.sort(group["fp"].to_numpy(np.int64))
        # Neighbours in sorted order are alike; vantage points should not be.
        points = signed.view(np.uint64)
        found = leaf_pairs(points, radius, leaf_rows)
        if forest:
            edges = spanning(len(points), found)
        else:
            edges = sorted({p for i, j in found for p in zip(i.tolist(), j.tolist())})
        both = np.array(edges, np.int64).reshape(-1, 2)
        a, b = signed[both[:, 0]], signed[both[:, 1]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    sharded = distinct.select("fp").mapInPandas(deal, "shard bigint, fp bigint")
    return sharded.groupBy("shard").applyInPandas(search, "a bigint, b bigint").distinct()


def near_groups(
    docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, shard_rows: int = SHARD_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable through links) per document.

    Rows with equal fingerprints are one class, so copies are never paired. Texts without words
    have fingerprint 0 and are linked like others. Rows repeating a doc_id each count.
    """
    own = folder_table(fingerprints(docs, words), "fingerprints")
    classes = folder_table(own.groupBy("fp").agg(F.min("doc_id").alias("head")), "classes")
    named = classes.where("head is not null").select("fp")
    links = near_links(named, radius, shard_rows, leaf_rows)
    a = classes.select(F.col("fp").alias("a"), F.col("head").alias("u"))
    b = classes.select(F.col("fp").alias("b"), F.col("head").alias("v"))
    # One document may carry two texts, then two classes share a head.
    edges = links.join(a, "a").join(b, "b").select("u", "v")
    reach = connected_components(edges).select(
        F.col("node").alias("head"), F.col("component").alias("root")
    )
    named = classes.join(reach, "head", "left").select(
        "fp", F.coalesce("root", "head").alias("component_id")
    )
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp="fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` without rows whose component has a smaller doc_id."""
    heads = near_groups(docs, words, radius).where(
        F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
    return kept_rows(docs, heads, ["doc_id"])
