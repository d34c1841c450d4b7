"""Density clustering on cosine distance, and its diagnosis.

The clustering is built from core distances (an exact nearest-neighbour join) and a minimum
spanning forest under mutual reachability: within every pair of neighbouring blocks only forest
edges are kept, never all close pairs, and forest edges are enough to find the components at any
radius up to the one searched. Exact copies collapse into one weighted point first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..functions.vectors import unit
from ..model import K_DISTANCE_PERCENTILES
from ..runtime import durable, exact_percentiles, forget, numbered, stored, value_counts_ranked
from .neighbors import SLACK, Limits, as_matrix, knn_join, unit_rows

BLOCK = Limits(block_rows=1024)
# The tree of pivots: rows it is fitted on for each pivot and in all, pivots of a node, and the power
# of growth of the copies from which on a node is not parted.
LEAST_SAMPLE, MOST_SAMPLE = 8, 32_768
PIVOTS_PER_NODE = 1024
WORST_POWER = 0.7
# Larger leaves that no pivots part get larger blocks, so about as many: a row is shipped once for each. So do
# the chunks of core distances.
LEAF_BLOCKS, BLOCKS, MOST_BLOCK_ROWS = 12, 24, 32_768
# Rows of a block that are compared in one matrix.
PART_ROWS = 1024
# Share of close pairs of two parts up to which they are weighed one by one, without a matrix.
SPARSE = 0.02
# Edges that a task holds before it thins them to a forest.
MOST_EDGES = 2**20
# Copies of rows that leave a task at a time.
ROUTED_ROWS = 16_384


def _collapse(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unit vectors with copies merged: (rep, vec, weight) and the vector of every id."""
    rows = points.select("id", unit(F.col("vec")).alias("vec"))
    reps = rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    return reps, rows


def _sized(limits: Limits, rows: int) -> Limits:
    """Limits with blocks that suit a table of so many rows."""
    return replace(limits, block_rows=max(limits.block_rows, min(MOST_BLOCK_ROWS, -(-rows // BLOCKS))))


def _core_distances(
    reps: DataFrame, k: int, limits: Limits, queries: DataFrame | None = None
) -> DataFrame:
    """Distance to the k-th neighbour, the point itself and its copies included."""
    q = (reps if queries is None else queries).select(F.col("rep").alias("qid"), "vec")
    r = reps.select(F.col("rep").alias("rid"), "vec", F.col("weight").alias("label"))
    hits = knn_join(q, r, k, limits=_sized(limits, reps.count()))
    seen = F.sum("label").over(
        Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        hits.withColumn("seen", seen)
        .where(F.col("seen") >= k)
        .groupBy(F.col("qid").alias("rep"))
        .agg(F.greatest(F.lit(0.0), F.min(F.lit(1.0) - F.col("score"))).alias("core"))
    )


def _cores_at(
    reps: DataFrame, pivots: np.ndarray, eps: float, k: int, limits: Limits
) -> DataFrame:
    """Points with a core value of at most ``eps`` exactly when they are core points: rep, vec, core.

    Points of an inner ball that weighs enough are core points without a neighbour search.
    """
    placed = _place(reps, pivots).withColumn("ball", _in_ball(eps))
    crowd = placed.where("ball").groupBy("cell").agg(F.sum("weight").alias("_w")).where(
        F.col("_w") >= k
    )
    marked = placed.join(crowd, "cell", "left")
    sure = F.col("ball") & F.col("_w").isNotNull()
    open_ = marked.where(~sure).select("rep", "vec")
    found = _core_distances(reps, k, limits, open_)
    inf = F.lit(float("inf"))
    return durable(
        marked.join(found, "rep", "left").select(
            "rep", "vec", F.when(sure, F.lit(0.0)).otherwise(F.coalesce("core", inf)).alias("core")
        )
    )


def _choose_pivots(points: DataFrame, limits: Limits) -> np.ndarray:
    n = limits.pivots_for(points.count())
    sample = points.orderBy(F.xxhash64("rep"), "rep").limit(n).select("vec").toPandas()
    return unit_rows(as_matrix(sample["vec"]))


def _reach(eps: float) -> float:
    """Angle that belongs to a cosine distance."""
    return float(np.arccos(np.clip(1.0 - eps, -1.0, 1.0)))


def _angles(vec: pd.Series, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit_rows(as_matrix(vec)) @ pivots.T, -1.0, 1.0))


def _place(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot (cell) and the angle to it (d)."""

    def place(batches):
        for b in batches:
            if len(b):
                d = _angles(b["vec"], pivots)
                cell = d.argmin(axis=1)
                yield b.assign(cell=cell.astype("int32"), d=d[np.arange(len(b)), cell])

    return points.mapInPandas(place, f"{_ddl(points)}, cell int, d double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _in_ball(eps: float):
    """Points this near to one pivot are all within ``eps`` of each other."""
    return F.col("d") <= F.lit(_reach(eps) / 2 - SLACK)


def _visits(d: np.ndarray, reach: float) -> np.ndarray:
    """Cells (rows x pivots) a vector stands in, by its distances to the pivots: that of its nearest
    pivot, and those whose pivot is at most ``reach`` farther. Of two vectors within ``reach`` one
    stands in the other's nearest cell: the two differences add up to 2 ``reach`` at most."""
    return d <= d.min(axis=1, keepdims=True) + reach + 2 * SLACK


def _farthest_first(sample: np.ndarray, n: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Picks, each farthest from those before; its distance to them; all distances to the picks."""
    picks, gaps, columns = [0], [np.inf], []
    near = np.full(len(sample), np.inf)
    while True:
        columns.append(np.arccos(np.clip(sample @ sample[picks[-1]], -1.0, 1.0)))
        near = np.minimum(near, columns[-1])
        far = int(near.argmax())
        if len(picks) == n or near[far] <= SLACK:
            return picks, np.array(gaps), np.stack(columns, axis=1)
        picks.append(far)
        gaps.append(near[far])


def _pivot_tree(sample: np.ndarray, rows: float, reach: float, leaf_rows: int, names):
    """(pivots, children) or the number of a leaf. ``rows`` is what the table should have in the node.

    If a level makes c copies of a row and leaves a share s of the rows in its largest cell, copies end
    up growing as (rows / leaf_rows) to the power log(c) / log(1 / s). A node takes the pivots for which
    this power is least; at WORST_POWER and above it stays a leaf, whose blocks are paired (power 1).
    """
    most = min(PIVOTS_PER_NODE, int(2 * rows / leaf_rows), len(sample) // LEAST_SAMPLE)
    best = None
    if rows > leaf_rows and most > 1:
        picks, gaps, d = _farthest_first(sample, most)
        apart = [int((gaps > c * reach).sum()) for c in (4, 3, 2, 1)]
        for n in {m for m in (*apart, len(picks), len(picks) // 4, len(picks) // 16) if m > 1}:
            at = _visits(d[:, :n], reach)
            copies, largest = at.sum() / len(sample), at.sum(axis=0).max() / len(sample)
            power = np.log(copies) / -np.log(largest) if largest < 1 else np.inf
            if power < WORST_POWER and (best is None or (power, largest) < best[:2]):
                best = (power, largest, n, at)
    if best is None:
        return next(names)
    _, _, n, at = best
    share = rows / len(sample)
    return sample[picks[:n]], [
        _pivot_tree(sample[at[:, j]], share * at[:, j].sum(), reach, leaf_rows, names) for j in range(n)
    ]


def _leaves(m: np.ndarray, tree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and leaf of every place of every vector."""
    rows, leaves, stack = [], [], [(tree, np.arange(len(m)))]
    while stack:
        node, at = stack.pop()
        if isinstance(node, int):
            rows.append(at)
            leaves.append(np.full(len(at), node, np.int64))
            continue
        inside = _visits(np.arccos(np.clip(m[at] @ node[0].T, -1.0, 1.0)), reach)
        stack += [(child, at[inside[:, j]]) for j, child in enumerate(node[1]) if inside[:, j].any()]
    return np.concatenate(rows), np.concatenate(leaves)


def _block_pairs(
    points: DataFrame, eps: float, limits: Limits, pivots: np.ndarray, ball=None
) -> DataFrame:
    """Every point copied to each pair of blocks it may have neighbours in: adds block, pair, side.

    A tree of pivots parts the table into leaves that overlap at the bounds, so any two points
    within ``eps`` share a leaf; it is fitted on at most MOST_SAMPLE rows and only decides where points
    meet. A leaf that fits a block is one pair. Leaves that no pivots part, or that the sample could
    not part further, are cut into blocks that are all paired. With ``ball``
    (a condition on the points) the points of one cell's inner ball get blocks of their own there,
    and such blocks of a cell are not paired: the caller already knows that their points are mutual
    neighbours. A crowd of near copies then costs nothing against itself.
    """
    total_rows = points.count()
    reach, size = _reach(eps), limits.block_rows
    wanted = min(MOST_SAMPLE, max(4096, 8 * LEAST_SAMPLE * -(-total_rows // size)))
    tree = 0
    if total_rows > size:
        sample = points.orderBy(F.xxhash64(F.lit(11), "rep"), "rep").limit(wanted).select("vec").toPandas()
        tree = _pivot_tree(unit_rows(as_matrix(sample["vec"])), total_rows, reach, size, count())
    inner = F.lit(False) if ball is None else (_in_ball(eps) & ball)
    placed = _place(points, pivots).select(
        *points.columns, F.when(inner, F.col("cell")).otherwise(-1).alias("crowd")
    )

    def part(batches):
        for b in batches:
            if len(b):
                rows, leaves = _leaves(unit_rows(as_matrix(b["vec"])), tree, reach)
                yield b.iloc[rows].assign(leaf=leaves)

    leafed = placed.mapInPandas(part, f"{_ddl(placed)}, leaf long")
    # A row for each leaf, and for the crowds in it.
    counts = leafed.groupBy("leaf", "crowd").agg(F.count(F.lit(1)).alias("n")).toPandas()
    in_leaf = counts.groupby("leaf")["n"].sum()
    per_block = np.maximum(size, np.minimum(MOST_BLOCK_ROWS, -(-in_leaf // LEAF_BLOCKS)))
    # Crowds of less than a block gain nothing by blocks of their own, which all others are shipped to:
    # most hold little more than their pivot. They stand among the leaf's other rows.
    alone = {
        (leaf, crowd) for leaf, crowd, n in counts.itertuples(index=False) if crowd >= 0 and n >= per_block[leaf]
    }
    apart = [(leaf, crowd) in alone for leaf, crowd in zip(counts["leaf"], counts["crowd"])]
    counts["crowd"] = counts["crowd"].where(apart, -1)
    counts = counts.groupby(["leaf", "crowd"], as_index=False)["n"].sum()
    small = counts.groupby("leaf")["n"].transform("sum") <= size
    # Small leaves are one block, whatever crowds they hold.
    counts["blocks"] = np.where(small, 0, -(-counts["n"] // counts["leaf"].map(per_block)))
    counts.loc[small & ~counts.duplicated("leaf"), "blocks"] = 1
    counts["first"] = counts["blocks"].cumsum() - counts["blocks"]
    counts.loc[small, "first"] = counts[small].groupby("leaf")["first"].transform("min")
    counts.loc[small, "blocks"] = 1
    total = int(counts["first"].max() + counts["blocks"].max()) + 1 if len(counts) else 1
    by_leaf = {leaf: g for leaf, g in counts.groupby("leaf")}

    def route(batches):
        for b in batches:
            apart = [key in alone for key in zip(b["leaf"], b["crowd"])]
            b = b.assign(crowd=b["crowd"].where(apart, -1))
            for (leaf, crowd), g in b.groupby(["leaf", "crowd"], sort=False):
                layout = by_leaf[leaf]
                mine = layout[layout["crowd"] == crowd].iloc[0]
                own = mine["first"] + g["h"].to_numpy() % mine["blocks"]
                first, last = layout["first"].min(), (layout["first"] + layout["blocks"]).max()
                others = np.arange(first, last)
                if last - first > 1 and crowd >= 0:
                    others = others[(others < mine["first"]) | (others >= mine["first"] + mine["blocks"])]
                step = max(1, ROUTED_ROWS // max(1, len(others)))
                for at in range(0, len(g), step):
                    rows = np.repeat(np.arange(at, min(at + step, len(g))), len(others))
                    got = g.iloc[rows].drop(columns=["leaf", "crowd", "h"])
                    a, z = own[rows], np.tile(others, len(rows) // max(1, len(others)))
                    lo, hi = np.minimum(a, z), np.maximum(a, z)
                    got["block"], got["pair"] = a.astype("int64"), (lo * total + hi).astype("int64")
                    got["side"] = (a != lo).astype("int32")
                    yield got

    hashed = leafed.withColumn("h", F.pmod(F.xxhash64("rep"), F.lit(2**40)))
    return hashed.mapInPandas(route, f"{_ddl(points)}, block long, pair long, side int")


def _forest(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning forest of a dense weight matrix; inf means no edge (Prim)."""
    n = len(weights)
    left = np.ones(n, dtype=bool)
    best = np.full(n, np.inf)
    parent = np.full(n, -1)
    us, vs, ws = [], [], []
    for _ in range(n):
        masked = np.where(left, best, np.inf)
        v = int(masked.argmin())
        if np.isfinite(masked[v]):
            us.append(parent[v])
            vs.append(v)
            ws.append(best[v])
        else:
            v = int(left.argmax())
        left[v] = False
        closer = left & (weights[v] < best)
        best[closer] = weights[v][closer]
        parent[closer] = v
    return np.asarray(us, dtype=int), np.asarray(vs, dtype=int), np.asarray(ws)


def _forest_of_parts(
    m: np.ndarray, core: np.ndarray, side: np.ndarray | None, eps: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forest of the rows of one block, or between the two sides of a pair of blocks (``side``).

    Parts of PART_ROWS are compared two at a time; the union of their forests holds a forest of all.
    """
    at = [np.arange(len(m))] if side is None else [np.flatnonzero(side == x) for x in (0, 1)]
    parts = [[i[x : x + PART_ROWS] for x in range(0, len(i), PART_ROWS)] for i in at]
    if side is None:
        pairs = [(a, b) for x, a in enumerate(parts[0]) for b in parts[0][x:]]
    else:
        pairs = [(a, b) for a in parts[0] for b in parts[1]]
    found, coarse, least = [], m.astype(np.float32), np.float32(1.0 - eps - (m.shape[1] + 4) * 2.4e-7 - 1e-12)
    for a, b in pairs:
        if sum(len(x) for _, _, x in found) > MOST_EDGES:
            found = [_spanning(len(m), found)]
        # Products in single precision name the pairs that may be close; few of them are weighed one by one.
        near = np.flatnonzero(coarse[a] @ coarse[b].T >= least)
        if len(near) <= SPARSE * len(a) * len(b):
            i, j = np.divmod(near, len(b))
            if a is b:
                i, j = i[i < j], j[i < j]
            i, j = a[i], b[j]
            d = np.maximum(0.0, 1.0 - np.round(np.einsum("ij,ij->i", m[i], m[j]), 12))
            w = np.maximum(np.maximum(d, core[i]), core[j])
            close = w <= eps
            found.append((i[close], j[close], w[close]))
            continue
        rows = a if a is b else np.concatenate([a, b])
        d = np.maximum(0.0, 1.0 - np.round(m[rows] @ m[rows].T, 12))
        w = np.maximum(np.maximum(d, core[rows, None]), core[None, rows])
        w[w > eps] = np.inf
        np.fill_diagonal(w, np.inf)
        if a is not b:
            w[: len(a), : len(a)] = w[len(a) :, len(a) :] = np.inf
        u, v, x = _forest(w)
        found.append((rows[u], rows[v], x))
    if not found:
        none = np.zeros(0, int)
        return none, none, np.zeros(0)
    return _spanning(len(m), found)


def _spanning(n: int, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning forest of lists of edges (Kruskal)."""
    u, v, x = (np.concatenate(c) for c in zip(*found))
    root = list(range(n))
    order, kept = np.argsort(x, kind="stable"), []
    for e, a, b in zip(order.tolist(), u[order].tolist(), v[order].tolist()):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[a] = b
            kept.append(e)
    return u[kept], v[kept], x[kept]


def reachability_forest(
    points: DataFrame, eps: float, limits: Limits = BLOCK, pivots: np.ndarray | None = None
) -> DataFrame:
    """Edges (u, v, d) whose components at any radius up to ``eps`` are those of all close pairs.

    ``points(rep, vec, core)``; d is the mutual reachability distance. With ``pivots`` the edges
    hold for ``eps`` alone and the inner balls around them are linked to their smallest id.
    """
    id_type = points.schema["rep"].dataType.simpleString()
    near = points.where(F.col("core") <= eps)
    if pivots is None:
        routed = _block_pairs(near, eps, limits, _choose_pivots(near, limits))
    else:
        routed = _block_pairs(near, eps, limits, pivots, ball=F.lit(True))

    def forest(g: pd.DataFrame) -> pd.DataFrame:
        m = unit_rows(as_matrix(g["vec"]))
        side = g["side"].to_numpy() if g["block"].nunique() > 1 else None
        u, v, x = _forest_of_parts(m, g["core"].to_numpy(), side, eps)
        ids = g["rep"].to_numpy()
        return pd.DataFrame({"u": ids[u], "v": ids[v], "d": x}) if len(u) else pd.DataFrame(
            {"u": ids[:0], "v": ids[:0], "d": x}
        )

    edges = routed.groupBy("pair").applyInPandas(forest, f"u {id_type}, v {id_type}, d double")
    if pivots is not None:
        members = _place(near, pivots).where(_in_ball(eps)).select("cell", "rep")
        heads = members.groupBy("cell").agg(F.min("rep").alias("v"))
        links = members.join(heads, "cell").where(F.col("rep") != F.col("v"))
        edges = edges.unionByName(links.select(F.col("rep").alias("u"), "v", F.lit(eps).alias("d")))
    return edges.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(
        F.min("d").alias("d")
    )


def connected_components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest reachable node per node: keys..., node, component.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond", SoCC 2014), each cut through reliable storage; only the last round's
    table is left there.
    """
    keys = list(keys)
    cur, path = stored(
        edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v").distinct(), "components"
    )
    mark = None
    while True:
        both = cur.unionByName(cur.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn(
            "m", F.least("m", "u")
        )
        large = (
            both.where("v > u").join(lows, [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        floor = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(floor, [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(floor.select(*keys, "u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        old = path
        cur, path = stored(small, "components")
        forget(edges.sparkSession, old)
        now = cur.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))
        ).first()
        if now == mark:
            break
        mark = now
    roots = cur.select(*keys, F.col("v").alias("node")).distinct()
    return cur.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(*keys, "node", F.col("node").alias("component"))
    )


def dbscan(
    points: DataFrame, eps: float, min_samples: int = 2, limits: Limits = BLOCK
) -> DataFrame:
    """Cluster of every point: id, cluster (smallest core id of the cluster, null for noise)."""
    reps, rows = _collapse(points)
    reps = durable(reps)
    pivots = _choose_pivots(reps, limits)
    core = _cores_at(reps, pivots, eps, min_samples, limits)
    dense = core.where(F.col("core") <= eps)
    forest = reachability_forest(core, eps, limits, pivots)
    comp = connected_components(forest.select("u", "v"))
    labelled = dense.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "vec", F.coalesce("component", "rep").alias("cluster")
    )
    out = labelled
    if min_samples > 2:
        labelled = durable(labelled)
        border = _border(core.where(F.col("core") > eps), labelled, eps, limits, pivots)
        out = labelled.unionByName(border)
    return rows.join(out.select("vec", "cluster"), "vec", "left").select("id", "cluster")


def _border(
    loose: DataFrame, labelled: DataFrame, eps: float, limits: Limits, pivots: np.ndarray
) -> DataFrame:
    """Non-core points beside a core point join the smallest such cluster."""
    none = F.lit(None).cast(labelled.schema["cluster"].dataType)
    both = labelled.unionByName(loose.select("rep", "vec", none.alias("cluster")))
    routed = _block_pairs(both, eps, limits, pivots, ball=F.col("cluster").isNotNull())
    id_type = labelled.schema["rep"].dataType.simpleString()

    def adopt(g: pd.DataFrame) -> pd.DataFrame:
        is_core = g["cluster"].notna().to_numpy()
        a, b = g[~is_core], g[is_core].sort_values("cluster")
        empty = pd.DataFrame({"rep": a["rep"].iloc[:0], "cluster": a["rep"].iloc[:0]})
        if a.empty or b.empty:
            return empty
        am, bm = unit_rows(as_matrix(a["vec"])), unit_rows(as_matrix(b["vec"]))
        first = np.full(len(a), -1)
        step = max(1, PART_ROWS * PART_ROWS // len(b))
        for lo in range(0, len(a), step):
            close = 1.0 - np.round(am[lo : lo + step] @ bm.T, 12) <= eps
            first[lo : lo + step] = np.where(close.any(axis=1), close.argmax(axis=1), -1)
        hit = first >= 0
        return pd.DataFrame(
            {
                "rep": a["rep"].to_numpy()[hit],
                "cluster": b["cluster"].to_numpy()[first[hit]].astype(a["rep"].dtype),
            }
        )

    got = routed.groupBy("pair").applyInPandas(adopt, f"rep {id_type}, cluster {id_type}")
    best = got.groupBy("rep").agg(F.min("cluster").alias("cluster"))
    return loose.join(best, "rep").select("rep", "vec", "cluster")


def number_clusters(assignment: DataFrame) -> DataFrame:
    """Cluster ids 0, 1, ... by smallest member; -1 for noise."""
    heads = assignment.where("cluster is not null").select("cluster").distinct()
    order = numbered(heads, "cluster", "cluster_id")
    return assignment.join(order, "cluster", "left").select(
        "id", F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id")
    )


def cluster_sizes(assignment: DataFrame, label: str = "cluster_id") -> DataFrame:
    return assignment.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def cluster_summary(assignment: DataFrame, label: str = "cluster_id") -> DataFrame:
    sizes = cluster_sizes(assignment, label)
    real = F.col(label) != -1
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("samples"),
        F.count_if(real).alias("clusters"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("noise"),
        F.max(F.when(real, F.col("n"))).alias("largest"),
    )


def k_distances(points: DataFrame, k: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Distance of every point to its k-th neighbour, itself included: id, d."""
    q = points.select(F.col("id").alias("qid"), "vec")
    hits = knn_join(q, q.withColumnRenamed("qid", "rid"), k, limits=limits)
    return hits.where(F.col("rank") == k).select(
        F.col("qid").alias("id"),
        F.greatest(F.lit(0.0), F.lit(1.0) - F.col("score")).alias("d"),
    )


def k_distance_percentiles(
    distances: DataFrame, percents: Sequence[float] = K_DISTANCE_PERCENTILES
) -> DataFrame:
    return exact_percentiles(distances, "d", percents)


def largest_jump(distances: DataFrame) -> DataFrame:
    """Largest step between consecutive sorted distances: from, to, jump, 1-based position, total."""
    ranked = value_counts_ranked(distances, "d")
    total = ranked.agg(F.sum("n").alias("total"))
    # Equal values differ by zero, so a positive step always leaves the last copy of a value.
    step = ranked.where("next_value is not null").select(
        F.col("value").alias("d_from"),
        F.col("next_value").alias("d_to"),
        (F.col("next_value") - F.col("value")).alias("jump"),
        (F.col("first_pos") + F.col("n") - 1).alias("position"),
    )
    flat = ranked.where((F.col("n") > 1) & (F.col("first_pos") == 1)).select(
        F.col("value").alias("d_from"),
        F.col("value").alias("d_to"),
        F.lit(0.0).alias("jump"),
        F.lit(1).cast("long").alias("position"),
    )
    top = step.unionByName(flat).orderBy(F.col("jump").desc(), "position").limit(1)
    return top.join(F.broadcast(total))


def contingency(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, "truth", "cluster_id").agg(F.count(F.lit(1)).alias("n"))


def purity(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of clustered points in their cluster's majority group; NaN without any."""
    best = (
        table.where(~F.col("cluster_id").cast("string").isin("-1", NOISE))
        .groupBy(*keys, "cluster_id")
        .agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    )
    whole = best.groupBy(*keys).agg(F.sum("top").alias("top"), F.sum("n").alias("n"))
    value = F.coalesce(F.try_divide(F.col("top").cast("double"), F.col("n")), F.lit(float("nan")))
    if not keys:
        return whole.select(value.alias("purity"))
    base = table.select(*keys).distinct()
    return base.join(whole, list(keys), "left").select(*keys, value.alias("purity"))


def adjusted_rand(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index; noise counts as one more label."""
    keys = list(keys)
    two = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    base = [F.lit(0).alias("_k")] if not keys else []
    src = table.select("*", *base)
    by = keys or ["_k"]
    cell = src.groupBy(*by).agg(F.sum(two("n")).alias("s"), F.sum("n").alias("n"))
    rows = src.groupBy(*by, "truth").agg(F.sum("n").alias("n")).groupBy(*by).agg(
        F.sum(two("n")).alias("a")
    )
    cols = src.groupBy(*by, "cluster_id").agg(F.sum("n").alias("n")).groupBy(*by).agg(
        F.sum(two("n")).alias("b")
    )
    total = F.col("n").cast("double") * (F.col("n") - 1) / 2
    expected = F.coalesce(F.try_divide(F.col("a") * F.col("b"), total), F.lit(0.0))
    top = (F.col("a") + F.col("b")) / 2
    value = F.coalesce(F.try_divide(F.col("s") - expected, top - expected), F.lit(1.0))
    return cell.join(rows, by).join(cols, by).select(*keys, value.alias("ari"))


NOISE = "noise"


def _mark(cluster: str):
    """Cluster as text that no id of any type can confuse with noise."""
    return F.coalesce(F.concat(F.lit("c"), F.col(cluster).cast("string")), F.lit(NOISE)).alias("cluster_id")


def eps_sweep(
    points: DataFrame,
    truth: DataFrame,
    grid: Sequence[float],
    min_samples: int = 2,
    limits: Limits = BLOCK,
) -> DataFrame:
    """Clusters, noise, adjusted Rand index and purity per radius, on the points with a truth.

    The forest is built once at the largest radius; its edges are filtered per radius and all
    radii share one component search. Needs ``min_samples`` of at most 2, where no point is a
    border point; larger values run :func:`dbscan` per radius.
    """
    scored = points.join(truth.select("id", "truth"), "id")
    pts = scored.select("id", "vec")
    if min_samples > 2:
        parts = [
            dbscan(pts, e, min_samples, limits).select("id", _mark("cluster")).withColumn("eps", F.lit(e))
            for e in grid
        ]
        labels = parts[0]
        for p in parts[1:]:
            labels = labels.unionByName(p)
        rows = labels.join(truth, "id")
    else:
        reps, by_vec = _collapse(pts)
        core = durable(
            reps.join(_core_distances(reps, min_samples, limits), "rep", "left")
        ).na.fill(float("inf"), ["core"])
        forest = durable(reachability_forest(core, max(grid), limits))
        radii = scored.sparkSession.createDataFrame([(float(e),) for e in grid], "eps double")
        # As many rows as radii in the grid.
        per_eps = forest.join(F.broadcast(radii), F.col("d") <= F.col("eps")).select("eps", "u", "v")
        comp = connected_components(per_eps, ["eps"])
        at = core.join(F.broadcast(radii)).join(
            comp.withColumnRenamed("node", "rep"), ["eps", "rep"], "left"
        )
        cluster = F.when(F.col("core") <= F.col("eps"), F.coalesce("component", "rep"))
        at = at.select("eps", "vec", cluster.alias("_c"))
        rows = (
            by_vec.join(at, "vec").join(truth.select("id", "truth"), "id")
            .select("eps", "truth", _mark("_c"))
        )
    table = contingency(rows, ["eps"])
    sizes = table.groupBy("eps", "cluster_id").agg(F.sum("n").alias("n"))
    counts = sizes.groupBy("eps").agg(
        F.count_if(F.col("cluster_id") != NOISE).alias("clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster_id") == NOISE, F.col("n"))), F.lit(0)).alias("noise"),
    )
    return counts.join(adjusted_rand(table, ["eps"]), "eps").join(purity(table, ["eps"]), "eps")
