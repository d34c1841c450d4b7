"""Hard negatives by Kronecker-packed products.

Components become integers. Within a tile both sides are biased to be non-negative; the biased
components of several candidates go into separated fields of one wide integer, every anchor
component is multiplied with it once, and the fields of the sum are the candidates' products, from
which the biases are taken off again. Wide integers of up to 53 bits are held in doubles, where sums
and products of integers are exact and matrix products fast; ranges too wide for that use integers
of any width.

Anchors are dealt over chunks of bounded size, by label, labels with many anchors over several.
Every chunk meets the candidates stretch by stretch: a task holds one chunk and streams its
candidates, keeping the best few per anchor, so memory does not depend on the table. Positives meet
only the chunks of their own label. The number of stretches follows the cluster, not the table, so
the partial results stay in proportion to the anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from aisleframe.llm.common import Rows, folder_table

# Anchors that one task holds, and the sides of the tiles it multiplies.
CHUNK, TILE = 16_384, 1_024
SCALE = 256
WIDE_BITS = 53
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "anchor_id bigint, place int, other_id bigint, score bigint"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, label, q (floor of 256 times each component) of the rows that take part.

    Rows with a null id, label, vector or component, or a component that is not finite, do not. An
    id names one vector: of rows that share it the least by (label, components) stands for all.
    Components beyond a long saturate.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    q = F.transform("embedding", lambda v: F.floor(SCALE * v))
    least = rows.groupBy("vec_id").agg(F.min(F.struct("label", q.alias("q"))).alias("v"))
    return least.select("vec_id", "v.label", "v.q")


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``c``, exact; beyond a long they saturate."""
    (m, d), n = a.shape, len(c)
    if not (m and n and d):
        return np.zeros((m, n), np.int64)
    bounds = [int(v) for v in (a.min(), a.max(), c.min(), c.max())]
    a_low, c_low = bounds[0], bounds[2]
    a_top, c_top = bounds[1] - a_low, bounds[3] - c_low
    bits = max(1, (d * a_top * c_top).bit_length())
    if bits > WIDE_BITS or max(map(abs, bounds)) >= 1 << 31:
        return wide_products(a, c, a_low, c_low, bits)
    a, c = a - a_low, c - c_low
    fields = min(WIDE_BITS // bits, n)
    groups = -(-n // fields)
    packed = np.zeros((groups * fields, d), np.int64)
    packed[:n] = c
    packed = packed.reshape(groups, fields, d) << (bits * np.arange(fields, dtype=np.int64))[:, None]
    total = (a.astype(np.float64) @ packed.sum(axis=1).astype(np.float64).T).astype(np.int64)
    out = np.empty((m, groups, fields), np.int64)
    for f in range(fields):
        out[:, :, f] = (total >> (bits * f)) & ((1 << bits) - 1)
    out = out.reshape(m, -1)[:, :n]
    out += (c_low * a.sum(axis=1) + d * a_low * c_low)[:, None] + a_low * c.sum(axis=1)
    return out


def wide_products(a: np.ndarray, c: np.ndarray, a_low: int, c_low: int, bits: int, fields: int = 64) -> np.ndarray:
    """The same with integers of any width."""
    d = a.shape[1]
    left = [[v - a_low for v in row] for row in a.tolist()]
    right = [[v - c_low for v in row] for row in c.tolist()]
    mask, out = (1 << bits) - 1, np.empty((len(left), len(right)), np.int64)
    tails = [c_low * sum(x) + d * a_low * c_low for x in left]
    for start in range(0, len(right), fields):
        part = right[start : start + fields]
        packed = [sum(row[j] << (bits * f) for f, row in enumerate(part)) for j in range(d)]
        for i, row in enumerate(left):
            total = sum(x * w for x, w in zip(row, packed))
            for f, other in enumerate(part):
                score = ((total >> (bits * f)) & mask) + tails[i] + a_low * sum(other)
                out[i, start + f] = min(max(score, LEAST), MOST)
    return out


class Best:
    """The best ``k`` (score descending, id ascending) per anchor and place, over any number of tiles."""

    def __init__(self, anchors: int, places: int, k: int):
        self.k = k
        self.score = np.full((anchors, places, k), LEAST)
        self.id = np.full((anchors, places, k), MOST)
        self.held = np.zeros((anchors, places, k), bool)

    def take(self, rows: slice, place: int, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` ascend along the columns of ``score``."""
        last, last_id = self.score[rows, place, -1:], self.id[rows, place, -1:]
        better = allowed & (score >= last)
        hit = np.flatnonzero(better.any(axis=1))
        if not len(hit):
            return
        score, better = score[hit], better[hit]
        better &= (score > last[hit]) | (ids < last_id[hit])
        n = score.shape[1]
        if max(-int(score.min()), int(score.max())) < MOST // n - 1:
            rank = score
        else:
            rank = np.unique(score, return_inverse=True)[1].reshape(score.shape)
        key = np.where(better, rank * n + np.arange(n - 1, -1, -1), LEAST)
        k = min(self.k, n)
        top = np.argpartition(key, n - k, axis=1)[:, n - k :]
        at = np.arange(rows.start, rows.stop)[hit]
        new_score = np.concatenate([self.score[at, place], np.take_along_axis(score, top, 1)], axis=1)
        new_id = np.concatenate([self.id[at, place], ids[top]], axis=1)
        held = np.concatenate([self.held[at, place], np.take_along_axis(better, top, 1)], axis=1)
        order = np.lexsort((new_id, ~new_score, ~held), axis=1)[:, : self.k]
        held = np.take_along_axis(held, order, 1)
        self.held[at, place] = held
        self.score[at, place] = np.where(held, np.take_along_axis(new_score, order, 1), LEAST)
        self.id[at, place] = np.where(held, np.take_along_axis(new_id, order, 1), MOST)


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of numbers, shorter ones filled with zeros."""
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def same_width(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


class Cell:
    """One chunk of anchors and the best found for them so far."""

    def __init__(self, k: int, bounds):
        self.k, self.bounds, self.parts, self.best = k, bounds, [], None

    def add_anchors(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def start(self) -> None:
        whole = pa.Table.from_batches(self.parts).combine_chunks()
        self.ids = whole["vec_id"].to_numpy()
        self.labels = whole["label"].to_numpy()
        self.q = same_width([matrix(p.column("q")) for p in self.parts])
        self.windows = [] if self.bounds is None else self.bounds(whole["scores"].to_pylist())
        self.best = Best(len(self.ids), max(1, len(self.windows)), self.k)

    def add_candidates(self, batch: pa.RecordBatch) -> None:
        if not self.parts:
            return
        if self.best is None:
            self.start()
        ids, labels = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("vec_id", "label"))
        order = np.argsort(ids, kind="stable")
        ids, labels, q = ids[order], labels[order], matrix(batch.column("q"))[order]
        width = max(self.q.shape[1], q.shape[1])
        self.q = same_width([self.q, np.zeros((0, width), np.int64)])
        q = same_width([q, np.zeros((0, width), np.int64)])
        for c in range(0, len(ids), TILE):
            c_ids, c_labels = ids[c : c + TILE], labels[c : c + TILE]
            for r in range(0, len(self.ids), TILE):
                rows = slice(r, min(r + TILE, len(self.ids)))
                score = products(self.q[rows], q[c : c + TILE])
                same = self.labels[rows, None] == c_labels
                if self.bounds is None:
                    self.best.take(rows, 0, score, same & (self.ids[rows, None] != c_ids), c_ids)
                for place, (low, high) in enumerate(self.windows):
                    inside = ~same & (score >= low[rows, None]) & (score <= high[rows, None])
                    self.best.take(rows, place, score, inside, c_ids)

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        if self.best is None:
            return
        for i, place, k in zip(*np.nonzero(self.best.held)):
            yield int(self.ids[i]), int(place), int(self.best.id[i, place, k]), int(self.best.score[i, place, k])


def score_windows(positives: int, low: int, high: int):
    """Bounds of the scores a negative may have, in per cent of each positive's score."""

    def bounds(scores: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for place in range(positives):
            of = [s[place] if place < len(s) else None for s in scores]
            # low * p <= 100 * n and 100 * n <= high * p for whole n
            least = [MOST if p is None else max(LEAST, -(-low * p // 100)) for p in of]
            most = [LEAST if p is None else min(MOST, high * p // 100) for p in of]
            out.append((np.array(least, np.int64), np.array(most, np.int64)))
        return out

    return bounds


def best_of_cells(cells: DataFrame, k: int, bounds=None) -> DataFrame:
    """Rows FOUND over a stream that is sorted by cell, anchors (kind 0) before candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())]))
        name, cell = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in ("chunk", "stretch", "kind")])
            turns = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *turns], [*turns, batch.num_rows]):
                here = tuple(keys[:2, start])
                if here != name:
                    for row in cell.rows() if cell else ():
                        if out.add(*row):
                            yield out.take()
                    name, cell = here, Cell(k, bounds)
                part = batch.slice(start, end - start)
                (cell.add_candidates if keys[2, start] else cell.add_anchors)(part)
        for row in cell.rows() if cell else ():
            if out.add(*row):
                yield out.take()
        if len(out):
            yield out.take()

    return cells.mapInArrow(run, FOUND)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; other columns are not read. ``is_anchor`` is a
    condition on vec_id or label. An anchor's positives are its best ``positives`` other rows of its
    label; for each, the best ``negatives`` rows of other labels whose score is ``low`` to ``high``
    per cent of the positive's. Equal scores are ordered by id. Rows that :func:`quantised` leaves out
    take no part; shorter vectors count as filled with zeros; anchors without positives, and empty
    tables, give no row. Results do not depend on ``chunk`` or on the cluster.
    """
    spark = vectors.sparkSession
    rows = folder_table(quantised(vectors), "vectors")
    anchors = rows.where(is_anchor)
    counts = folder_table(anchors.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "anchors_by_label")
    bundles = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // chunk))
    # At most two labels for every chunk.
    parts = F.ceil(F.col("n") / chunk).cast("int")
    before = F.sum(parts).over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)) - parts
    large = folder_table(
        counts.where(F.col("n") * 2 >= chunk).select("label", parts.alias("parts"), (before + bundles).cast("int").alias("first")),
        "labels_with_many_anchors",
    )
    chunks = bundles + (large.agg(F.sum("parts")).first()[0] or 0)
    stretches = max(1, -(-4 * spark.sparkContext.defaultParallelism // chunks))

    own = F.pmod(F.xxhash64("label"), F.lit(bundles)).cast("int")
    spot = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    stretch = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(stretches)).cast("int")
    place = rows.join(large, "label", "left")

    def cells(held: DataFrame, met: DataFrame) -> DataFrame:
        left = held.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit(stretches - 1)))).withColumn("kind", F.lit(0))
        right = met.select("*", F.array().cast("array<bigint>").alias("scores"), stretch.alias("stretch"), F.lit(1).alias("kind"))
        both = left.unionByName(right).repartition(chunks * stretches, "chunk", "stretch")
        return both.sortWithinPartitions("chunk", "stretch", "kind")

    def merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        # At most k rows of every stretch; sorted by falling score, then id.
        one = F.struct(F.bitwise_not("score").alias("down"), F.col("other_id"))
        return found.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(one)), 1, k).alias("best"))

    dealt = place.where(is_anchor).select(
        "vec_id", "label", "q", F.coalesce(F.col("first") + spot, own).alias("chunk")
    )
    to_own = place.select(
        "vec_id", "label", "q",
        F.explode(F.coalesce(F.sequence("first", F.col("first") + F.col("parts") - 1), F.array(own))).alias("chunk"),
    )
    none = F.array().cast("array<bigint>").alias("scores")
    nearest = best_of_cells(cells(dealt.select("*", none), to_own), positives)
    nearest = folder_table(merged(nearest, ["anchor_id"], positives), "positives")

    scores = F.transform("best", lambda b: F.bitwise_not(b["down"])).alias("scores")
    held = dealt.join(nearest.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select(*dealt.columns, scores)
    to_all = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    found = best_of_cells(cells(held, to_all), negatives, score_windows(positives, low, high))
    found = merged(found, ["anchor_id", "place"], negatives)
    pairs = nearest.select("anchor_id", F.posexplode("best").alias("place", "p"))
    return found.join(pairs, ["anchor_id", "place"]).select(
        "anchor_id", F.col("p.other_id").alias("positive_id"), F.bitwise_not("p.down").alias("positive_score"),
        F.posexplode("best").alias("rank", "n"),
    ).select(
        "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("n.other_id").alias("negative_id"),
        "positive_score", F.bitwise_not("n.down").alias("negative_score"),
    )
