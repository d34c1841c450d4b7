"""Exact nearest-neighbour joins.

A reference side whose measured size is small is shipped to the executors and searched with matrix
products. Beyond that both sides are split by pivots: the distance of a reference to its pivot and
the triangle inequality give every query a proven upper bound on its k-th distance, and the query
only visits what can still hold a neighbour (the partitioning of Lu et al., "Efficient processing of
k nearest neighbor joins using MapReduce", VLDB 2012). A cell's references are cut into rings by their
distance to the pivot, crowded rings into blocks of bounded size. Queries are dealt into chunks by
their own cell, so the queries of a chunk need the same few blocks; a list of (chunk, block) says
which, and references travel by that list only. A task holds one chunk and streams its references.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, durable

SLACK = 1e-6
# Queries and references of one matrix of a search, pairs that are scored at a time.
_BATCH, _FIRST, _TILE, _SCORED = 1024, 1024, 4096, 16_384
# Numbers in one matrix of a step, rings of a pivot's cell, partitions of the streamed search.
_STEP_CELLS = 1_000_000
RINGS = 16
MOST_PARTITIONS = 4096
# References from which on the queries of the shipped search are dealt over all cores.
SPREAD_REFS = 4096
# Chunks a reference should go to at most, and queries of a chunk up to which chunks are put together for it.
MOST_COPIES, MOST_CHUNK_ROWS = 12, 32_768


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=m.copy(), where=n > 0)


def as_matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 0))


class Cosine:
    """Score is the cosine; the angle is the metric behind the pruning."""

    def prepare(self, m):
        return unit_rows(m)

    def score(self, q, r):
        """Scores of the pairs of rows."""
        return np.round(np.einsum("ij,ij->i", q, r), 12)

    def coarse(self, m):
        """Rows whose inner products order references like their scores, but for the slack."""
        return m.astype(np.float32)

    def floor(self, score):
        """The inner product that belongs to a score."""
        return score

    def slack(self, dim):
        """Products of unit rows in single precision err by less than half of this."""
        return (dim + 4) * 2.4e-7

    def metric(self, q, r):
        return np.arccos(np.clip(q @ r.T, -1.0, 1.0))


class GreatCircle:
    """Score is the negated great-circle distance in km, which is itself a metric."""

    radius = 6371.0

    def prepare(self, m):
        return np.radians(m)

    def metric(self, q, r):
        dlat = (r[None, :, 0] - q[:, None, 0]) / 2
        dlng = (r[None, :, 1] - q[:, None, 1]) / 2
        a = (
            np.sin(dlat) ** 2
            + np.cos(q[:, None, 0]) * np.cos(r[None, :, 0]) * np.sin(dlng) ** 2
        )
        return self.radius * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))

    def score(self, q, r):
        dlat, dlng = (r[:, 0] - q[:, 0]) / 2, (r[:, 1] - q[:, 1]) / 2
        a = np.sin(dlat) ** 2 + np.cos(q[:, 0]) * np.cos(r[:, 0]) * np.sin(dlng) ** 2
        return np.round(-self.radius * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a)), 9)

    def coarse(self, m):
        if not len(m):
            return np.zeros((0, 3))
        flat = np.cos(m[:, 0])
        return np.stack([flat * np.cos(m[:, 1]), flat * np.sin(m[:, 1]), np.sin(m[:, 0])], axis=1)

    def floor(self, score):
        return np.cos(np.clip(-score / self.radius, 0.0, np.pi))

    def slack(self, dim):
        """Covers the rounding of the score, too: 1e-9 km are 1.6e-13 of a radius."""
        return 1e-12


@dataclass(frozen=True)
class Limits:
    """Size knobs; tests shrink them to drive the distributed path on small tables.

    ``pivots`` is the most that are used; a smaller table gets about one per block.
    """

    broadcast_bytes: int = BROADCAST_BYTES
    block_rows: int = 4096
    pivots: int = 1024

    def pivots_for(self, rows: int) -> int:
        return max(1, min(self.pivots, -(-rows // self.block_rows)))


def _first_k(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of every row, in order; ties go to the smaller column."""
    order = np.lexsort((cols, -scores, rows))
    sorted_rows = rows[order]
    first = np.searchsorted(sorted_rows, sorted_rows)
    return order[np.arange(len(order)) - first < k]


def _prepared(q: pd.DataFrame, measure) -> tuple[np.ndarray, np.ndarray]:
    m = measure.prepare(as_matrix(q["vec"]))
    return m, measure.coarse(m)


def _search(
    q: pd.DataFrame, ref: dict, k: int, measure, exclude: str, far: float, known: np.ndarray | None = None,
    ready: tuple[np.ndarray, np.ndarray] | None = None,
) -> pd.DataFrame:
    """The best k of ``ref`` for every query; those below ``known``, a score per query, may be left out.
    ``ready`` holds the queries' matrices if they were made before.

    Inner products over a tile of references name what can still be among the best k; only these few
    pairs are scored exactly, and the k-th score so far bounds the next tile.
    """
    qm, qc = _prepared(q, measure) if ready is None else ready
    slack = measure.slack(qm.shape[1])
    positions = pd.Index(ref["rid"]) if exclude == "self" else None
    parts = []
    for lo in range(0, len(q), _BATCH):
        hi = min(lo + _BATCH, len(q))
        kth = np.full(hi - lo, -np.inf) if known is None else known[lo:hi].copy()
        rows, cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        own = None if positions is None else positions.get_indexer(q["qid"].iloc[lo:hi])
        tags = q["tag"].to_numpy()[lo:hi, None]
        at = 0
        while at < len(ref["rid"]):
            end = min(len(ref["rid"]), at + (_TILE if at else _FIRST))
            c = qc[lo:hi] @ ref["c"][at:end].T
            if own is not None:
                inside = np.flatnonzero((own >= at) & (own < end))
                c[inside, own[inside] - at] = -np.inf
            elif exclude == "tag":
                c[tags == ref["tag"][None, at:end]] = -np.inf
            elif exclude == "other":
                c[tags != ref["tag"][None, at:end]] = -np.inf
            open_ = np.isneginf(kth)
            least = np.where(open_, -4.0, measure.floor(np.where(open_, 0.0, kth)) - slack)
            if open_.any() and end - at > k:
                # Excluded and undefined products sort last.
                near = -np.partition(-c[open_], k - 1, axis=1)[:, k - 1]
                least[open_] = np.where(np.isfinite(near), near - slack, -4.0)
            # Flat places are found much faster than pairs of them.
            row, col = np.divmod(np.flatnonzero(c >= least.astype(c.dtype)[:, None]), end - at)
            got = [
                measure.score(qm[lo + row[x : x + _SCORED]], ref["m"][at + col[x : x + _SCORED]])
                for x in range(0, len(row), _SCORED)
            ]
            found = np.concatenate(got) if got else np.zeros(0)
            keep = np.isfinite(found) & (found >= -far)
            rows, cols = np.concatenate([rows, row[keep]]), np.concatenate([cols, at + col[keep]])
            scores = np.concatenate([scores, found[keep]])
            best = _first_k(rows, cols, scores, k)
            rows, cols, scores = rows[best], cols[best], scores[best]
            last = np.searchsorted(rows, np.arange(hi - lo), side="right")
            full = last - np.searchsorted(rows, np.arange(hi - lo)) == k
            kth[full] = np.maximum(kth[full], scores[last[full] - 1])
            at = end
        parts.append(
            pd.DataFrame(
                {
                    "qid": q["qid"].to_numpy()[lo + rows],
                    "rid": ref["rid"][cols],
                    "label": ref["label"][cols],
                    "score": scores,
                }
            )
        )
    return pd.concat(parts) if parts else pd.DataFrame(columns=["qid", "rid", "label", "score"])


def _pack(r: pd.DataFrame, measure) -> dict:
    r = r.sort_values("rid", kind="stable")
    m = measure.prepare(as_matrix(r["vec"]))
    return {
        "rid": r["rid"].to_numpy(),
        "label": r["label"].to_numpy(),
        "tag": r["tag"].to_numpy(),
        "m": m,
        "c": measure.coarse(m),
    }


def knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    *,
    measure=Cosine(),
    exclude: str = "none",
    max_distance: float | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """The ``k`` best references of every query: qid, rid, label, score, rank.

    ``queries(qid, vec[, tag])``, ``refs(rid, vec[, label][, tag])``. ``exclude='self'`` skips the
    reference with the query's own id, ``exclude='tag'`` those with its tag (a fold number) and
    ``exclude='other'`` those with any other tag; tags must be few. ``max_distance`` is in the measure's metric and needs a distance measure.
    Ties rank by rid.
    """
    refs = _with_default(_with_default(refs, "label", F.lit("")), "tag", F.lit(-1))
    queries = _with_default(queries, "tag", F.lit(-2))
    q = queries.select("qid", "tag", "vec")
    r = refs.select("rid", "label", "tag", "vec")
    out = ", ".join(
        [
            f"qid {q.schema['qid'].dataType.simpleString()}",
            f"rid {r.schema['rid'].dataType.simpleString()}",
            f"label {r.schema['label'].dataType.simpleString()}",
            "score double",
        ]
    )
    far = np.inf if max_distance is None else float(max_distance)
    size = r.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    n_refs, dim = size[0], size[1] or 1
    if n_refs * (dim + 4) * 8 <= limits.broadcast_bytes:
        hits = _broadcast_join(q, r, k, measure, exclude, far, out, n_refs)
    else:
        hits = _pivot_join(q, r, k, measure, exclude, far, out, limits, n_refs)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "rid")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("long"))
    )


def _with_default(df: DataFrame, name: str, value) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, value)


def _broadcast_join(q, r, k, measure, exclude, far, out, n_refs: int) -> DataFrame:
    context = q.sparkSession.sparkContext
    shipped = context.broadcast(_pack(r.toPandas(), measure))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield _search(b, shipped.value, k, measure, exclude, far)

    if n_refs >= SPREAD_REFS:
        # A file with few bytes of vectors is one task, whatever the work on each of them.
        q = q.repartition(min(MOST_PARTITIONS, 4 * context.defaultParallelism), F.xxhash64("qid"))
    return q.mapInPandas(search, out)


def _bounded(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        for at in range(0, len(f), rows):
            yield f.iloc[at : at + rows]


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _placed(df: DataFrame, pivots: np.ndarray, measure) -> DataFrame:
    """Adds the nearest pivot (cell) and the distance to it (d), computed once."""

    def assign(batches):
        for b in _bounded(batches, max(1, _STEP_CELLS // len(pivots))):
            d = measure.metric(measure.prepare(as_matrix(b["vec"])), pivots)
            cell = d.argmin(axis=1)
            yield b.assign(cell=cell.astype("int32"), d=d[np.arange(len(b)), cell])

    return durable(df.mapInPandas(assign, f"{_fields(df)}, cell int, d double"))


class _Rings:
    """A cell's references by distance to the pivot: at most RINGS of about equal size per cell."""

    def __init__(self, placed: DataFrame, pivots: int, block_rows: int):
        steps = [i / RINGS for i in range(1, RINGS)]
        # At most one row per pivot, then one per ring.
        cells = placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("d", F.array(*map(F.lit, steps))).alias("cuts")
        ).toPandas()
        self.cuts: dict[int, np.ndarray] = {}
        for cell, n, cuts in cells.itertuples(index=False):
            wanted = int(min(RINGS, -(-n // block_rows)))
            chosen = [cuts[i * RINGS // wanted - 1] for i in range(1, wanted)]
            self.cuts[cell] = np.unique(np.array(chosen, dtype=np.float64))
        counts = np.array([len(self.cuts[c]) + 1 if c in self.cuts else 0 for c in range(pivots)])
        self.first = np.cumsum(counts) - counts
        self.cell = np.repeat(np.arange(pivots), counts)

    def assign(self, placed: DataFrame) -> DataFrame:
        """Adds the ring."""

        def run(batches):
            for b in batches:
                cell, d = b["cell"].to_numpy(), b["d"].to_numpy()
                ring = self.first[cell]
                for c in np.unique(cell):
                    own = cell == c
                    ring[own] += np.searchsorted(self.cuts[c], d[own], side="right")
                yield b.assign(ring=ring.astype("int32"))

        return placed.mapInPandas(run, f"{_fields(placed)}, ring int")

    def measure(self, ringed: DataFrame) -> None:
        """Nearest and farthest member of every ring, and its size."""
        self.low, self.high = np.full(len(self.cell), np.inf), np.full(len(self.cell), -np.inf)
        self.rows = np.zeros(len(self.cell), np.int64)
        got = ringed.groupBy("ring").agg(
            F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")
        ).toPandas()
        self.low[got["ring"]], self.high[got["ring"]], self.rows[got["ring"]] = got["low"], got["high"], got["n"]


def _dealt_by_need(q, r, k, measure, exclude, far, limits: Limits, n_refs: int) -> tuple[DataFrame, DataFrame, int]:
    """Queries (with chunk), references (once for every chunk that may need them), number of chunks."""
    sample = r.orderBy(F.xxhash64("rid"), "rid").limit(limits.pivots_for(n_refs)).select("vec").toPandas()
    pivots = measure.prepare(as_matrix(sample["vec"]))

    # Of identical references only the smallest ids can be among the best k, so a crowd of copies
    # shrinks before it is placed; the limit is applied map-side first.
    need = k + 1 if exclude == "self" else k
    tagged = exclude in ("tag", "other")
    copies_of = Window.partitionBy("vec", *(["tag"] if tagged else [])).orderBy("rid")
    r = r.withColumn("i", F.row_number().over(copies_of)).where(F.col("i") <= need).drop("i")
    placed = _placed(r, pivots, measure)
    rings = _Rings(placed, len(pivots), limits.block_rows)
    ringed = rings.assign(placed)
    rings.measure(ringed)
    # Per cell the few smallest pivot distances. Bounded by pivots x tags x k.
    by_tag = ["cell", "tag"] if tagged else ["cell"]
    nearest = (
        placed.withColumn("i", F.row_number().over(Window.partitionBy(*by_tag).orderBy("d")))
        .where(F.col("i") <= need)
        .select(*by_tag, "d")
        .toPandas()
    )
    near_cell, near_d = nearest["cell"].to_numpy(), nearest["d"].to_numpy()
    near_tag = nearest["tag"].to_numpy() if tagged else None

    # Queries of a cell share chunks: they are close, so they need about the same rings.
    homes = _placed(q, pivots, measure)
    sizes = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()
    parts = np.zeros(len(pivots), np.int64)
    parts[sizes["cell"]] = -(-sizes["n"] // limits.block_rows)
    first = np.cumsum(parts) - parts
    plan = q.sparkSession.createDataFrame(
        [(int(c), int(parts[c]), int(first[c])) for c in sizes["cell"]], "cell int, parts long, first long"
    )
    # One row per pivot.
    chunk = F.col("first") + F.pmod(F.xxhash64("qid"), F.col("parts"))
    dealt = homes.join(F.broadcast(plan), "cell").select("qid", "tag", "vec", chunk.alias("chunk"))
    ring_cell, low, high = rings.cell, rings.low, rings.high
    width = max(1, len(near_cell), len(ring_cell), len(pivots))

    def route(batches):
        for b in _bounded(batches, max(1, _STEP_CELLS // width)):
            d = measure.metric(measure.prepare(as_matrix(b["vec"])), pivots)
            reach = d[:, near_cell] + near_d[None, :]
            if near_tag is not None:
                same = b["tag"].to_numpy()[:, None] == near_tag[None, :]
                reach[same if exclude == "tag" else ~same] = np.inf
            if reach.shape[1] >= need:
                bound = np.partition(reach, need - 1, axis=1)[:, need - 1]
            else:
                bound = np.full(len(b), np.inf)
            bound = np.minimum(bound, far)[:, None] + SLACK
            to_pivot = d[:, ring_cell]
            needed = (to_pivot - high <= bound) & (low - to_pivot <= bound)
            # One row per chunk and ring, never one per query and ring.
            order = np.argsort(b["chunk"].to_numpy(), kind="stable")
            chunks, starts = np.unique(b["chunk"].to_numpy()[order], return_index=True)
            row, ring = np.logical_or.reduceat(needed[order], starts, axis=0).nonzero()
            yield pd.DataFrame({"chunk": chunks[row], "ring": ring.astype("int32")})

    wanted = durable(dealt.mapInPandas(route, "chunk bigint, ring int").distinct())
    chunks = int(parts.sum())
    # Where pivots part little, every chunk needs most references: larger chunks then, and fewer copies.
    # One row per ring.
    asked = wanted.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).toPandas()
    copies, rows = int((rings.rows[asked["ring"]] * asked["n"]).sum()), int(rings.rows.sum())
    together = min(-(-copies // (MOST_COPIES * max(1, rows))), MOST_CHUNK_ROWS // limits.block_rows)
    if together > 1:
        merged = F.floor(F.col("chunk") / together).cast("long").alias("chunk")
        dealt = dealt.select("qid", "tag", "vec", merged)
        wanted = wanted.select(merged, "ring").distinct()
        chunks = -(-chunks // together)
    return dealt, ringed.join(wanted, "ring").select("chunk", "rid", "label", "tag", "vec"), chunks


def _pivot_join(q, r, k, measure, exclude, far, out, limits: Limits, n_refs: int) -> DataFrame:
    dealt, shipped, chunks = _dealt_by_need(q, r, k, measure, exclude, far, limits, n_refs)
    # Few chunks are searched by several tasks each, which split the references.
    stretches = max(1, -(-4 * q.sparkSession.sparkContext.defaultParallelism // max(1, chunks)))
    spread = F.explode(F.sequence(F.lit(0), F.lit(stretches - 1)))
    a = dealt.select(
        "chunk", spread.alias("stretch"), F.lit(0).alias("kind"), F.struct("qid", "tag", "vec").alias("q"),
        F.lit(None).cast(shipped.select(F.struct("rid", "label", "tag", "vec")).schema[0].dataType).alias("r"),
    )
    b = shipped.select(
        "chunk", F.pmod(F.xxhash64("rid"), F.lit(stretches)).cast("int").alias("stretch"), F.lit(1).alias("kind"),
        F.lit(None).cast(a.schema["q"].dataType).alias("q"), F.struct("rid", "label", "tag", "vec").alias("r"),
    )
    cells = a.unionByName(b).repartition(
        max(1, min(chunks * stretches, MOST_PARTITIONS)), "chunk", "stretch"
    ).sortWithinPartitions("chunk", "stretch", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, cell = None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if not keys.shape[1]:
                continue
            turns = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            for start, end in zip([0, *turns], [*turns, keys.shape[1]]):
                here = tuple(keys[:2, start])
                if here != name:
                    if cell is not None:
                        yield from cell.close()
                    name, cell = here, _Stream(k, measure, exclude, far, limits.block_rows)
                part = batch.slice(start, end - start).column(4 if keys[2, start] else 3)
                (cell.add_refs if keys[2, start] else cell.add_queries)(pa.RecordBatch.from_struct_array(part))
        if cell is not None:
            yield from cell.close()

    return cells.mapInArrow(search, out)


class _Stream:
    """The queries of a chunk, held whole, and the best k of the references that stream by."""

    def __init__(self, k, measure, exclude, far, block_rows):
        self.rule, self.block_rows = (k, measure, exclude, far), block_rows
        self.q, self.r, self.waiting, self.best, self.fields = [], [], 0, None, None
        self.known = self.queries = self.ready = None

    def add_queries(self, batch: pa.RecordBatch) -> None:
        self.q.append(batch)

    def add_refs(self, batch: pa.RecordBatch) -> None:
        if not self.q:
            return
        self.r.append(batch)
        self.waiting += batch.num_rows
        if self.waiting >= self.block_rows:
            self.search()

    def search(self) -> None:
        if self.ready is None:
            # Queries come before references.
            q = pa.Table.from_batches(self.q).to_pandas()
            self.ready, self.queries = _prepared(q, self.rule[1]), q.drop(columns="vec")
            self.q = [self.q[0].slice(0, 0)]
        q, r = self.queries, pa.Table.from_batches(self.r).to_pandas()
        self.fields = [self.q[0].schema.field("qid"), *(self.r[0].schema.field(c) for c in ("rid", "label"))]
        found = _search(q, _pack(r, self.rule[1]), *self.rule, self.known, self.ready)
        if self.best is not None:
            found = pd.concat([self.best, found]).sort_values(
                ["qid", "score", "rid"], ascending=[True, False, True], kind="stable"
            ).groupby("qid", sort=False).head(self.rule[0])
        self.best, self.r, self.waiting = found, [], 0
        # Scores that k references reach already.
        kth = found.groupby("qid", sort=False)["score"].agg(["size", "min"])
        kth = kth["min"][kth["size"] >= self.rule[0]]
        self.known = q["qid"].map(kth).fillna(-np.inf).to_numpy(np.float64)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            self.search()
        if self.best is not None and len(self.best):
            schema = pa.schema([*self.fields, pa.field("score", pa.float64())])
            yield pa.RecordBatch.from_pandas(self.best, schema=schema, preserve_index=False)
