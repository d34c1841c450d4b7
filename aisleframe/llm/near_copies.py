"""Near copies of whole texts: candidates from SimHash trees and min-wise forests, measured exactly.

Texts are near copies when the sets of their five-word shingles have a Jaccard similarity of 0.8.
SimHash fingerprints, linked by vantage-point trees at two bits, find the closest. Pairs of 0.8 lie
about ten bits apart, where no metric tree prunes; for them each text stands in several trees of
min-wise hashes. Texts that agree on the first hashes of a tree meet; where more meet than a task
should compare, further hashes part them, and what stays together even then (texts that are almost
equal) is cut into blocks that share their first member. Work and rows are thus linear in the texts.

In a group every text names two candidates: the first and the most alike by their sketches. All
candidates are measured on the whole shingle sets as pairs of texts; those whose ends measured links
already join are left out.

What chance and the bounds of the groups leave out is found by an exact prefix join (Chaudhuri et al.,
ICDE 2006; Vernica et al., SIGMOD 2010): with all shingles in one order, two sets of the similarity
share one of their first ones. Only pairs that no measured links join yet are formed, so a crowd of near
copies is not compared with itself, and of these only pairs leave a task whose parity maps allow the
similarity (bitmap filter, Sandes et al., 2020): every shingle turns one bit of its text's map, so maps of
two texts differ in no more bits than there are shingles in one text alone. Components of all measured
links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.llm.common import folder_table, slices, whole_text
from aisleframe.llm.simhash import fingerprint_of, near_links, shingles
from aisleframe.operators.clustering import connected_components

WORDS = 5
SIMILARITY = 0.8
# Trees, and the hashes of a tree that texts must share: the first depth at which a group is small.
TREES = 12
DEPTHS = (4, 6, 8)
BLOCK = 256
# The prefix join orders shingles by their texts in one of ORDER_SHARE documents, rare ones first, those that
# have fewer than ORDER_LEAST there by their hash; only the ORDER_MOST most frequent are told apart. Any order
# gives the same links; a good one gives few candidates. Pairs that leave a task at a time.
ORDER_SHARE, ORDER_LEAST, ORDER_MOST = 16, 3, 2**20
PAIRS = 2**18
# Bits of the smallest parity map, bytes of maps that are compared at a time.
LEAST_BITS, MAP_BYTES = 64, 2**24
# Estimates have a standard error of 0.04 at 0.8; candidates below it by more than three are not named.
LEAST_ESTIMATE = 0.66
_FACTORS = np.random.default_rng(23).integers(0, 2**31, (TREES * DEPTHS[-1], 2), dtype=np.uint32) * 2 + 1
_KEY = np.random.default_rng(29).integers(0, 2**63, DEPTHS[-1], dtype=np.uint64) * 2 + 1


def sketches(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Least values of all hash functions per text; ``h`` holds the texts' shingle hashes in turn."""
    h = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), len(_FACTORS)), np.uint32)
    for k, (a, b) in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat(h * a ^ (h >> np.uint32(15)) * b, starts)
    return out


def tree_keys(least: np.ndarray) -> np.ndarray:
    """(text, tree, depth) keys; a key holds all hashes up to its depth."""
    by_tree = least.reshape(len(least), TREES, DEPTHS[-1]).astype(np.uint64) + np.uint64(1)
    mixed = np.cumsum(by_tree * _KEY, axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * _KEY[0])[:, :, [d - 1 for d in DEPTHS]].view(np.int64)


def parity_map(own: np.ndarray) -> bytes:
    """Bits that an odd number of the set's hashes fall on; their number is a power of two, twice that of the hashes or more."""
    bits = max(LEAST_BITS, 2 << (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(maps: list[bytes], width: int) -> np.ndarray:
    """A row of 64-bit words per map, all as if made with ``width`` bytes; wider maps fold to them."""
    out = np.empty((len(maps), width), np.uint8)
    for k, one in enumerate(maps):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(one, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def maps_allow(
    x: np.ndarray, y: np.ndarray, size: np.ndarray, maps: np.ndarray, similarity: float
) -> np.ndarray:
    """Whether the sets at the places ``x`` and ``y`` may have the similarity; never false if they have it."""
    width = np.array([len(m) for m in maps])
    narrow = np.minimum(width[x], width[y])
    out = np.empty(len(x), bool)
    for w in np.unique(narrow):
        at = np.flatnonzero(narrow == w)
        used, place = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
        words = folded([maps[k] for k in used], int(w))
        a, b = place[: len(at)], place[len(at) :]
        step = max(1, MAP_BYTES // int(w))
        for lo in range(0, len(at), step):
            differ = np.bitwise_count(words[a[lo : lo + step]] ^ words[b[lo : lo + step]]).sum(axis=1, dtype=np.int64)
            both = size[x[at[lo : lo + step]]].astype(np.int64) + size[y[at[lo : lo + step]]]
            out[at[lo : lo + step]] = (1 + similarity) * differ <= (1 - similarity) * both + 1e-6
    return out


SKETCH = (
    f"doc_id bigint, fp bigint, size int, map binary, sig binary, {', '.join(f'k{d} array<bigint>' for d in DEPTHS)}"
)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, fp, size and parity map of the set, sig (a byte per hash function), keys of all trees by depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            hashes = [shingles(t, WORDS) for t in batch.column("body").to_pylist()]
            fps = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
            # Texts without words are alike.
            hashes = [h if len(h) else np.zeros(1, np.uint64) for h in hashes]
            least = sketches(np.concatenate(hashes), np.array([len(h) for h in hashes]))
            keys = tree_keys(least)
            sig = least.astype(np.uint8)
            sets = [np.unique(h) for h in hashes]
            lists = [pa.array(list(keys[:, :, k]), pa.list_(pa.int64())) for k in range(len(DEPTHS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(fps), pa.array([len(x) for x in sets], pa.int32()),
                    pa.array([parity_map(x) for x in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sig], pa.binary()), *lists,
                ],
                names=["doc_id", "fp", "size", "map", "sig", *[f"k{d}" for d in DEPTHS]],
            )

    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("body")
    )
    return rows.mapInArrow(run, SKETCH)


def forest_groups(own: DataFrame, block: int = BLOCK) -> DataFrame:
    """(g, doc_id): groups of two to about ``block`` texts that agree in a tree."""
    names = [f"k{d}" for d in DEPTHS]
    rows = own.select("doc_id", F.posexplode(F.arrays_zip(*names)).alias("t", "k")).select("doc_id", "t", "k.*")
    out = None
    for level, key in enumerate(names):
        counts = rows.groupBy("t", key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
        met = rows.join(counts.where("n > 1"), ["t", key])
        if key != names[-1]:
            rows = folder_table(met.where(F.col("n") > block).drop("n", "first"), "crowded_keys")
            met = met.where(F.col("n") <= block)
        parts = F.ceil(F.col("n") / block)
        g = F.xxhash64(F.lit(level), "t", key, F.pmod(F.xxhash64("doc_id"), parts))
        found = met.select(g.alias("g"), "doc_id", F.when(parts > 1, F.col("first")).alias("first"))
        out = found if out is None else out.unionByName(found)
    out = folder_table(out, "groups")
    shared = out.where("first is not null").select("g", F.col("first").alias("doc_id"))
    return out.select("g", "doc_id").unionByName(shared).distinct()


def named_pairs(ids: np.ndarray, sig: np.ndarray, least: float) -> list[tuple[int, int]]:
    """For every text its first earlier candidate and its most alike one."""
    n, functions = sig.shape
    if n == 2:
        alike = np.array([[0.0, 0.0], [np.count_nonzero(sig[0] == sig[1]), 0.0]])
        alike[0, 1] = alike[1, 0]
    else:
        alike = np.stack([(sig == row).sum(axis=1) for row in sig]).astype(float)
        np.fill_diagonal(alike, 0)
    # One in 256 bytes agrees by chance.
    alike = (alike / functions - 1 / 256) * 256 / 255
    near = alike >= least
    out = set()
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        first, best = int(near[i].argmax()), int(alike[i].argmax())
        out.update((min(i, j), max(i, j)) for j in (first, best))
    return [(int(ids[i]), int(ids[j])) for i, j in out]


def candidates(own: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of doc_ids that may be near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def leave(groups):
            got = [p for ids, sig in groups if len(ids) > 1 for p in named_pairs(ids, sig, LEAST_ESTIMATE)]
            both = np.array(got, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "doc_id"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(len(g), -1)
            turns = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            done = []
            for a, b in zip(turns, turns[1:]):
                if g[a] != now and held:
                    done.append(tuple(np.concatenate(x) for x in zip(*held)))
                    held = []
                now = g[a]
                held.append((ids[a:b], sig[a:b]))
            yield leave(done)
        if held:
            yield leave([tuple(np.concatenate(x) for x in zip(*held))])

    # A doc_id that stands for two texts meets itself; such groups have one member.
    members = forest_groups(own, block).join(own.select("doc_id", "sig").dropDuplicates(["doc_id"]), "doc_id")
    met = members.select("g", "doc_id", "sig").repartition("g").sortWithinPartitions("g", "doc_id")
    by_forest = met.mapInArrow(run, "a bigint, b bigint")

    classes = folder_table(own.groupBy("fp").agg(F.min("doc_id").alias("head")), "classes")
    equal = own.join(classes, "fp").where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    links = near_links(classes.select("fp"))
    ends = [classes.select(F.col("fp").alias(x), F.col("head").alias(y)) for x, y in (("a", "u"), ("b", "v"))]
    close = links.join(ends[0], "a").join(ends[1], "b").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return by_forest.unionByName(equal).unionByName(close).where("a < b").distinct()


def measured(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have ``similarity`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in slices(slices(batches, "x"), "y"):
            keep = []
            for a, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "x", "y")]):
                if (a, x) != last:
                    last, own = (a, x), np.unique(shingles(x, WORDS))
                other = np.unique(shingles(y, WORDS))
                low, high = sorted((len(own), len(other)))
                both = 0
                if low >= similarity * high - 1e-9:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(both >= similarity * (low + high - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"]
            )

    body = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("id"), whole_text().cast("binary").alias("body")
    )
    # Texts of no pair stay where they are; the others are stored, so each join moves these alone.
    pairs = folder_table(pairs, "pairs")
    ends = folder_table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair_ends")
    body = folder_table(body.join(ends, "id", "left_semi"), "pair_texts")
    first = pairs.join(body.select(F.col("id").alias("a"), F.col("body").alias("x")), "a")
    both = first.join(body.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def shingle_sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Distinct shingle hashes of every text in ascending order; texts without words are alike."""
    sets = [np.unique(shingles(t, WORDS)) for t in batch.column("body").to_pylist()]
    return [x if len(x) else np.zeros(1, np.uint64) for x in sets]


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of a share of the texts hold, ascending, and how many hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            sets = shingle_sets(batch)
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    some = rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(ORDER_SHARE)) == 0)
    counts = some.select("body").mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    # At most ORDER_MOST rows.
    top = counts.where(F.col("n") >= ORDER_LEAST).orderBy(F.col("n").desc(), "h").limit(ORDER_MOST).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top["n"].to_numpy(np.int64)[order]


def prefix_of(own: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which a set of that similarity shares one."""
    wanted = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
    if not len(frequent):
        return own[:wanted]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    n = np.where(frequent[at] == own, counts[at], 0)
    return own[np.argsort(n, kind="stable")[:wanted]]


def pairs_between(
    ids: np.ndarray, group: np.ndarray, size: np.ndarray, maps: np.ndarray, similarity: float
) -> Iterator[np.ndarray]:
    """Pairs of ids of different groups whose sizes and parity maps allow the similarity, in bounded pieces."""
    order = np.argsort(group, kind="stable")
    ids, group, size, maps = ids[order], group[order], size[order], maps[order]
    ends = [*(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(ids)]
    held, start = [], 0

    def leave():
        x, y = (np.concatenate(z) for z in zip(*held))
        near = maps_allow(x, y, size, maps, similarity)
        held.clear()
        return np.stack([ids[x[near]], ids[y[near]]], axis=1)

    for end in ends[:-1]:
        step = max(1, PAIRS // (len(ids) - end))
        for at in range(start, end, step):
            to = min(end, at + step)
            low, high = np.minimum.outer(size[at:to], size[end:]), np.maximum.outer(size[at:to], size[end:])
            x, y = (low >= similarity * high - 1e-9).nonzero()
            held.append((at + x, end + y))
            if sum(len(z) for z, _ in held) >= PAIRS:
                yield leave()
        start = end
    if held:
        yield leave()


def unjoined_candidates(docs: DataFrame, own: DataFrame, reach: DataFrame, similarity: float) -> DataFrame:
    """All pairs a < b that may have the similarity and that ``reach`` (node, component) does not join.

    ``own`` holds size and parity map of every text."""
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("body")
    )
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            sets = shingle_sets(batch)
            firsts = [prefix_of(x, similarity, *frequent.value) for x in sets]
            if firsts:
                many = [len(x) for x in firsts]
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.repeat(ids, many)),
                    pa.array(np.repeat(np.array([len(x) for x in sets], np.int32), many)),
                ], names=["h", "doc_id", "size"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = None

        def leave():
            ids, group, size, maps = (np.concatenate(x) for x in zip(*held))
            for both in pairs_between(ids, group, size, maps, similarity):
                a, b = both.min(axis=1), both.max(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "doc_id", "c", "size", "map"))
            turns = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            for start, end in zip(turns, turns[1:]):
                if h[start] != now and held:
                    yield from leave()
                    held = []
                now = h[start]
                held.append([x[start:end] for x in rest])
        if held:
            yield from leave()

    by_shingle = Window.partitionBy("h")

    def differ(df: DataFrame, column: str) -> DataFrame:
        ends = df.withColumn("lo", F.min(column).over(by_shingle)).withColumn("hi", F.max(column).over(by_shingle))
        return ends.where("lo <> hi").drop("lo", "hi")

    shared = folder_table(differ(rows.mapInArrow(prefixes, "h bigint, doc_id bigint, size int"), "doc_id"), "shared_shingles")
    named = reach.select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
    grouped = shared.join(named, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    # A doc_id that stands for several texts of a size brings all their maps; one of them is the right one.
    maps = own.select("doc_id", "size", "map").distinct()
    met = differ(grouped, "c").join(maps, ["doc_id", "size"])
    met = met.select("h", "doc_id", "c", "size", "map").repartition("h").sortWithinPartitions("h")
    return met.mapInArrow(meet, "a bigint, b bigint").distinct()


def likely_links(docs: DataFrame, own: DataFrame, similarity: float, block: int) -> DataFrame:
    """Measured links a < b of the candidates that trees and forests name."""
    pairs = folder_table(candidates(own, block), "candidates")
    first = folder_table(measured(pairs.groupBy("b").agg(F.min("a").alias("a")), docs, similarity), "first_links")
    # Where measured links lead in two steps.
    up = first.groupBy("b").agg(F.min("a").alias("r"))
    two = up.alias("x").join(up.alias("y"), F.col("x.r") == F.col("y.b"), "left").select(
        F.col("x.b").alias("node"), F.coalesce("y.r", "x.r").alias("root")
    )
    two = folder_table(two, "roots")
    rest = pairs.join(first, ["a", "b"], "left_anti")
    for end, name in (("a", "ra"), ("b", "rb")):
        named = two.select(F.col("node").alias(end), F.col("root").alias(name))
        rest = rest.join(named, end, "left").withColumn(name, F.coalesce(name, end))
    rest = rest.where("ra <> rb").select("a", "b")
    return folder_table(first.unionByName(measured(rest, docs, similarity)), "likely_links")


def near_copy_links(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Measured links a < b, enough to join all texts that chains of links of the similarity join."""
    own = folder_table(sketched(docs), "sketches")
    likely = likely_links(docs, own, similarity, block)
    reach = folder_table(connected_components(likely.select(F.col("a").alias("u"), F.col("b").alias("v"))), "likely")
    others = folder_table(unjoined_candidates(docs, own, reach, similarity), "unjoined")
    return folder_table(likely.unionByName(measured(others, docs, similarity)), "links")


def without_copies(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``docs`` without rows that measured links join to a smaller doc_id.

    Texts are compared whole; null ones are empty, those without words are near copies of each other,
    those of fewer than five words are one shingle. Rows that repeat a doc_id stay or go together; rows
    with a null doc_id stay. Empty tables stay empty; all columns of ``docs`` are kept.
    """
    links = near_copy_links(docs, similarity, block)
    reach = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    gone = reach.where("component < node").select(F.col("node").alias("gone"))
    left = docs.alias("l").join(gone.alias("r"), F.col("l.doc_id").cast("bigint") == F.col("r.gone"), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
