import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleframe.operators import clustering, discriminant, matching, neighbors
from aisleframe.operators.neighbors import Cosine, GreatCircle, Limits, _dealt_by_need, knn_join

TINY = Limits(broadcast_bytes=0, block_rows=16, pivots=7)


def _unit(v):
    return v / np.linalg.norm(v)


def _toy(seed=0, labels=("a", "b", "c")):
    rng = np.random.default_rng(seed)
    centres = {c: _unit(rng.normal(size=16)) for c in labels}
    rows = [
        (i * 5 + j, c, _unit(v + 0.05 * rng.normal(size=16)).tolist())
        for i, (c, v) in enumerate(centres.items())
        for j in range(5)
    ]
    return rows, centres


@pytest.fixture(scope="module")
def toy(spark):
    rows, centres = _toy()
    refs = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    q = [
        (1, _unit(centres["a"] + 0.01).tolist()),
        (2, _unit(centres["a"] + centres["b"]).tolist()),
    ]
    return refs, spark.createDataFrame(q, "id long, vec array<double>"), rows, centres


@pytest.mark.parametrize("mode", ["lda", "knn", "prototype"])
def test_confident_and_tied_queries(toy, mode):
    refs, queries, _, _ = toy
    got = {r["id"]: r for r in matching.match(queries, refs, mode).collect()}
    assert got[1]["product"] == "a" and got[1]["margin"] > 0.3
    assert got[2]["margin"] < 0.35


def test_duplicate_cannot_dominate(spark, toy):
    refs, queries, _, _ = toy
    copy = queries.where("id = 1").select(F.lit(99).cast("long").alias("id"), F.lit("b").alias("label"), "vec")
    got = matching.match_knn(queries.where("id = 1"), refs.unionByName(copy)).first()
    assert got["product"] == "a" and got["vote"] < 0.99


def test_classify_is_the_first_three_columns(toy):
    refs, queries, _, _ = toy
    full = matching.match(queries, refs, "knn")
    three = matching.classify(full)
    assert three.columns == ["id", "product", "vote", "score"]
    assert three.orderBy("id").collect() == full.select(*three.columns).orderBy("id").collect()


def test_vote_numbers(spark):
    def hits(rows):
        return spark.createDataFrame(
            [(1, i, l, s, i + 1) for i, (l, s) in enumerate(rows)],
            "qid long, rid long, label string, score double, rank long",
        )

    got = matching.vote(hits([("a", 1.0), ("a", 0.96), ("a", 0.8), ("b", 0.6), ("b", 0.0)])).first()
    assert got["product"] == "a" and got["score"] == 1.0
    assert got["vote"] == pytest.approx(0.99977148, abs=1e-8)
    assert got["margin"] == pytest.approx(0.99954296, abs=1e-8)
    got = matching.vote(hits([("a", 0.9 - i / 50) for i in range(5)])).first()
    assert (got["vote"], got["margin"]) == (1.0, 1.0)
    got = matching.vote(hits([("b", 0.90), ("a", 0.89), ("a", 0.89)])).first()
    assert got["product"] == "a" and got["score"] == 0.90


@pytest.mark.parametrize(
    "vote,score,margin,floor,expect",
    [
        (1.0, 0.9, None, None, "a"),
        (1.0, 0.9, 0.01, None, "a"),
        (1.0, 0.9, None, 0.2, "a"),
        (1.0, 0.9, 0.01, 0.2, "low_confidence"),
        (1.0, 0.9, 0.5, 0.2, "a"),
        (1.0, 0.1, None, None, "low_confidence"),
        (0.3, 0.9, None, None, "low_confidence"),
    ],
)
def test_gates(spark, vote, score, margin, floor, expect):
    row = spark.createDataFrame(
        [(1, "a", vote, score, margin)],
        "id long, product string, vote double, score double, margin double",
    )
    out = matching.apply_gates(row, score_floor=0.3, margin_floor=floor, vote_floor=0.4)
    assert out.first()["gated"] == expect


def test_mode_defaults_differ(spark):
    got = {r["mode"]: r for r in matching.mode_gates(spark).collect()}
    assert got["lda"]["score_floor"] != got["prototype"]["score_floor"]
    assert got["lda"]["margin_floor"] == 0.05
    assert got["knn"]["margin_floor"] is None and got["prototype"]["margin_floor"] is None


def test_two_class_head_answers_both(spark):
    rows, centres = _toy(1, ("a", "b"))
    refs = spark.createDataFrame(rows, "id long, label string, vec array<double>")
    head = discriminant.fit(refs)
    q = spark.createDataFrame(
        [(1, centres["a"].tolist()), (2, centres["b"].tolist())], "id long, vec array<double>"
    )
    got = discriminant.posteriors(q, head).collect()
    top = {r["id"]: r["label"] for r in got if r["rank"] == 1}
    assert top == {1: "a", 2: "b"}
    assert sum(r["score"] for r in got if r["id"] == 1) == pytest.approx(1.0)


def _reference_head(rows):
    """Plain NumPy fit of the same head."""
    labels = sorted({r[1] for r in rows})
    pooled, means = 0.0, []
    for c in labels:
        x = np.array([r[2] for r in rows if r[1] == c])
        n, p = x.shape
        mean, sd = x.mean(0), x.std(0)
        z = (x - mean) / sd
        emp = z.T @ z / n
        mu = np.trace(emp) / p
        d2 = ((emp - mu * np.eye(p)) ** 2).sum() / p
        b2 = min(sum(((np.outer(r, r) - emp) ** 2).sum() for r in z) / n**2 / p, d2)
        shrunk = b2 / d2 * mu * np.eye(p) + (1 - b2 / d2) * emp
        pooled = pooled + np.outer(sd, sd) * shrunk / len(labels)
        means.append(mean)
    means = np.array(means)
    coef = means @ np.linalg.inv(pooled)
    return labels, coef, -0.5 * np.diag(means @ coef.T) - math.log(len(labels))


def test_head_matches_the_formula(toy):
    refs, _, rows, _ = toy
    labels, coef, bias = discriminant.fit(refs).models[0]
    want = _reference_head(rows)
    assert labels == want[0]
    np.testing.assert_allclose(coef, want[1], rtol=1e-8)
    np.testing.assert_allclose(bias, want[2], rtol=1e-8)


def test_thin_classes_stay_out_of_the_head(spark, toy):
    refs, _, rows, _ = toy
    lone = spark.createDataFrame([(500, "lone", rows[0][2])], refs.schema)
    assert discriminant.fit(refs.unionByName(lone)).models[0][0] == ["a", "b", "c"]
    assert discriminant.fit(refs.where("label = 'a'")) is None


def test_view_average_is_unit(spark):
    views = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "id long, vec array<double>")
    got = {r["id"]: r["vec"] for r in matching.view_average(views).collect()}
    assert got[1] == pytest.approx([math.sqrt(0.5)] * 2)
    assert got[2] == [0.0, 0.0]


def _vectors(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    m[:copies] = m[0]
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("limits", [Limits(), TINY])
@pytest.mark.parametrize("exclude", ["none", "self", "tag"])
def test_knn_join_is_exact(spark, limits, exclude):
    m = _vectors(150, 6, 3, copies=50)
    rows = [(i, m[i].tolist(), i % 3) for i in range(len(m))]
    df = spark.createDataFrame(rows, "qid long, vec array<double>, tag int")
    got = knn_join(df, df.withColumnRenamed("qid", "rid"), 4, exclude=exclude, limits=limits)
    got = {(r["qid"], r["rank"]): (r["rid"], r["score"]) for r in got.collect()}
    s = np.round(m @ m.T, 12)
    tag = np.arange(len(m)) % 3
    if exclude == "self":
        np.fill_diagonal(s, -np.inf)
    if exclude == "tag":
        s[tag[:, None] == tag[None, :]] = -np.inf
    for i in range(len(m)):
        best = np.argsort(-np.round(s[i], 9), kind="stable")[:4]
        assert [got[(i, k + 1)][0] for k in range(4)] == best.tolist()


def test_references_travel_by_need(spark):
    """On clustered data a reference goes to about as many chunks whatever the size of the table."""
    rate = []
    for n in (2000, 8000):
        rng = np.random.default_rng(n)
        centres = rng.normal(size=(n // 100, 24))
        m = centres[rng.integers(len(centres), size=n)] + 0.02 * rng.normal(size=(n, 24))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "qid long, vec array<double>")
        q = df.withColumn("tag", F.lit(-2))
        r = df.select(F.col("qid").alias("rid"), F.lit("").alias("label"), F.lit(-1).alias("tag"), "vec")
        limits = Limits(broadcast_bytes=0, block_rows=50)
        dealt, shipped, chunks = _dealt_by_need(q, r, 3, Cosine(), "self", np.inf, limits, n)
        assert dealt.count() == n and chunks >= n // 50
        rate.append(shipped.count() / n)
    # Without a list every reference would go to every chunk: 40 and 160 times.
    assert max(rate) < 8 and rate[1] < 1.5 * rate[0]


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_great_circle_radius(spark, limits):
    rng = np.random.default_rng(5)
    p = np.column_stack([36.25 + rng.random(80) / 10, 59.55 + rng.random(80) / 10])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "qid long, vec array<double>")
    got = knn_join(
        df, df.withColumnRenamed("qid", "rid"), 5, measure=GreatCircle(), exclude="self",
        max_distance=2.0, limits=limits,
    ).collect()
    g = GreatCircle()
    d = g.metric(g.prepare(p), g.prepare(p))
    np.fill_diagonal(d, np.inf)
    want = {
        (i, int(j))
        for i in range(80)
        for j in np.argsort(d[i], kind="stable")[:5]
        if d[i, j] <= 2.0
    }
    assert {(r["qid"], r["rid"]) for r in got} == want


def _dbscan(m, eps, min_samples):
    d = 1 - np.round(m @ m.T, 12)
    near = d <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(m), -1)
    c = 0
    for i in range(len(m)):
        if label[i] != -1 or not core[i]:
            continue
        stack = [i]
        label[i] = c
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for k in np.nonzero(near[j] & (label == -1))[0]:
                label[k] = c
                stack.append(k)
        c += 1
    return label


@pytest.mark.parametrize("limits", [clustering.BLOCK, TINY])
@pytest.mark.parametrize("min_samples", [2, 4])
def test_dbscan_matches_brute_force(spark, limits, min_samples):
    rng = np.random.default_rng(11)
    centres = _vectors(6, 5, 12)
    m = np.concatenate([c + 0.12 * rng.normal(size=(18, 5)) for c in centres])
    m[:30] = m[0]
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    got = clustering.number_clusters(clustering.dbscan(df, 0.02, min_samples, limits))
    got = {r["id"]: r["cluster_id"] for r in got.collect()}
    assert [got[i] for i in range(len(m))] == _dbscan(m, 0.02, min_samples).tolist()


def test_copies_of_a_point_do_not_grow_with_the_table(spark):
    """On clustered data a point goes to about as many pairs of blocks whatever the size of the table."""
    rate = []
    for n in (1500, 6000):
        rng = np.random.default_rng(n)
        centres = rng.normal(size=(n // 50, 24))
        m = centres[rng.integers(len(centres), size=n)] + 0.02 * rng.normal(size=(n, 24))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "rep long, vec array<double>")
        limits = Limits(block_rows=100)
        routed = clustering._block_pairs(df, 0.01, limits, clustering._choose_pivots(df, limits))
        rate.append(routed.count() / n)
        pairs = routed.groupBy("pair").count().agg(F.max("count")).first()[0]
        assert pairs <= 4 * limits.block_rows
        seen = routed.select("rep", "pair").distinct().toPandas().groupby("rep")["pair"].agg(set)
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        close = np.argwhere(np.triu(1 - unit[:400] @ unit.T <= 0.01, 1))
        assert len(close) and all(seen[a] & seen[b] for a, b in close)
    assert max(rate) < 3 and rate[1] < 1.3 * rate[0]


@pytest.mark.parametrize("min_samples", [2, 5])
def test_dbscan_with_a_crowd_of_near_copies(spark, min_samples):
    rng = np.random.default_rng(21)
    m = _vectors(120, 4, 22)
    m[:60] = m[0] + 0.01 * rng.normal(size=(60, 4))
    m[60:64] = m[0] + 0.15 * rng.normal(size=(4, 4))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    got = clustering.number_clusters(clustering.dbscan(df, 0.02, min_samples, TINY))
    got = {r["id"]: r["cluster_id"] for r in got.collect()}
    assert [got[i] for i in range(len(m))] == _dbscan(m, 0.02, min_samples).tolist()


def test_purity_and_rand(spark):
    rows = [(t, c) for t, c in zip("xxxyyz", [0, 0, 1, 1, 1, -1])]
    table = clustering.contingency(spark.createDataFrame(rows, "truth string, cluster_id long"))
    assert clustering.purity(table).first()[0] == pytest.approx(0.8)
    assert clustering.adjusted_rand(table).first()[0] == pytest.approx(0.31818182)


def test_purity_without_clusters_is_nan(spark):
    table = clustering.contingency(spark.createDataFrame([("x", -1)], "truth string, cluster_id long"))
    assert math.isnan(clustering.purity(table).first()[0])


def test_eps_sweep_agrees_with_single_runs(spark):
    rng = np.random.default_rng(2)
    m = _vectors(5, 4, 1)
    m = np.concatenate([c + 0.1 * rng.normal(size=(12, 4)) for c in m])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    truth = df.select("id", F.floor(F.col("id") / 12).cast("string").alias("truth"))
    grid = (0.005, 0.02, 0.05)
    got = {r["eps"]: r for r in clustering.eps_sweep(df, truth, grid, limits=TINY).collect()}
    for e in grid:
        want = _dbscan(m, e, 2)
        assert got[e]["clusters"] == len(set(want) - {-1})
        assert got[e]["noise"] == int((want == -1).sum())


def test_k_distance_statistics(spark):
    d = [0.0] * 40 + [0.1, 0.2, 0.25, 0.6, 0.61]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(d)], "id long, d double")
    got = {r["pct"]: r["value"] for r in clustering.k_distance_percentiles(df, (10, 50, 90, 95, 99)).collect()}
    for p, v in got.items():
        assert v == pytest.approx(float(np.percentile(d, p)))
    jump = clustering.largest_jump(df).first()
    i = int(np.argmax(np.diff(d)))
    assert (jump["position"], jump["total"]) == (i + 1, len(d))
    assert jump["jump"] == pytest.approx(0.35)


@pytest.mark.parametrize("exclude", ["none", "self", "tag", "other"])
def test_search_scores_few_pairs_and_keeps_all_ties(exclude):
    """Only pairs that products cannot rule out are scored; equal scores go to the smaller id."""
    import pandas as pd

    from aisleframe.operators import neighbors as nb

    scored = []

    class Counted(Cosine):
        def score(self, q, r):
            scored.append(len(q))
            return super().score(q, r)

    rng = np.random.default_rng(12)
    m = rng.normal(size=(9000, 24))
    m[4000:4010] = m[0]
    m[8000:8100] = m[1] * 3
    m[5] = 0
    refs = pd.DataFrame({"rid": rng.permutation(9000), "label": "x", "tag": np.arange(9000) % 3, "vec": list(m)})
    q = refs.iloc[:1200].rename(columns={"rid": "qid"})[["qid", "tag", "vec"]]
    measure = Counted()
    got = nb._search(q, nb._pack(refs, measure), 5, measure, exclude, np.inf)
    assert sum(scored) < len(q) * len(refs) / 20
    unit = nb.unit_rows(m)
    for i in [*range(8), 700, 1199]:
        s = np.round(unit[i] @ unit.T, 12)
        if exclude == "self":
            s[i] = -np.inf
        elif exclude != "none":
            s[(refs["tag"] == refs["tag"][i]) == (exclude == "tag")] = -np.inf
        best = np.lexsort((refs["rid"], -s))[:5]
        mine = got[got["qid"] == refs["rid"][i]]
        assert mine["rid"].tolist() == refs["rid"].to_numpy()[best].tolist()
        assert np.allclose(mine["score"], s[best], atol=1e-12)


@pytest.mark.parametrize("two", [False, True])
def test_forest_of_parts_joins_what_one_matrix_joins(monkeypatch, two):
    """Blocks of any size are compared in bounded matrices; components at every radius stay."""
    from aisleframe.operators import clustering as c

    rng = np.random.default_rng(3)
    m = rng.normal(size=(150, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    core, side = rng.random(150) * 0.3, rng.integers(0, 2, 150) if two else None
    monkeypatch.setattr(c, "PART_ROWS", 16)
    u, v, d = c._forest_of_parts(m, core, side, 0.5)
    assert len(u) < 150
    for eps in (0.1, 0.2, 0.35, 0.5):
        far = np.maximum(np.maximum(1 - m @ m.T, core[:, None]), core[None, :])
        near = far <= eps
        if two:
            near &= side[:, None] != side[None, :]
        reach = np.eye(150, dtype=bool) | near
        mine = np.eye(150, dtype=bool)
        mine[u[d <= eps], v[d <= eps]] = mine[v[d <= eps], u[d <= eps]] = True
        for _ in range(9):
            reach, mine = reach @ reach, mine @ mine
        assert (reach == mine).all()


def test_blocks_grow_with_the_table():
    from aisleframe.operators import clustering as c

    for rows in (1000, 50_000, 700_000):
        assert -(-rows // c._sized(c.BLOCK, rows).block_rows) <= c.BLOCKS


def test_steps_of_the_pivot_join_hold_small_matrices(spark):
    class Watched(Cosine):
        """Fails where a step holds more than 8 MB in one matrix of distances."""

        def metric(self, q, r):
            assert len(q) * len(r) <= 1_000_000
            return Cosine.metric(self, q, r)

    rows = spark.range(10_000, numPartitions=1).select(
        F.col("id").alias("qid"), F.array(*[F.sin(F.col("id") * (k + 1.5)) for k in range(4)]).alias("vec")
    )
    tagged = rows.withColumn("tag", F.lit(-2)).select("qid", "tag", "vec")
    refs = rows.where("qid < 5000").select(F.col("qid").alias("rid"), F.lit("").alias("label"), F.lit(-1).alias("tag"), "vec")
    limits = Limits(broadcast_bytes=0, block_rows=32, pivots=128)
    dealt, shipped, chunks = _dealt_by_need(tagged, refs, 1, Watched(), "none", np.inf, limits, 5000)
    assert shipped.select("chunk").distinct().count() <= chunks and dealt.count() == 10_000


def test_rows_that_no_pivots_part_go_to_few_blocks(spark):
    """Inner balls that hold little more than their pivot add no blocks that every row is shipped to."""
    limits = Limits(block_rows=50)
    rate = []
    for n in (1000, 3000):
        m = _vectors(n, 64, 5)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "rep long, vec array<double>")
        pivots = clustering._choose_pivots(df, limits)
        assert len(pivots) == n // 50
        rate.append(clustering._block_pairs(df, 0.6, limits, pivots, ball=F.lit(True)).count() / n)
    assert max(rate) <= clustering.LEAF_BLOCKS + 1 and rate[1] < 1.1 * rate[0]


@pytest.mark.parametrize("eps", [0.3, 1.2])
def test_forest_of_parts_joins_what_all_close_pairs_join(monkeypatch, eps):
    """Whether pairs are weighed one by one or as a matrix, and however often edges are thinned."""
    m = np.concatenate([_vectors(90, 8, 3), _vectors(1, 8, 4).repeat(30, axis=0)])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    core = np.random.default_rng(2).random(len(m)) * eps
    w = np.maximum(np.maximum(np.maximum(0.0, 1 - np.round(m @ m.T, 12)), core[:, None]), core[None, :])
    monkeypatch.setattr(clustering, "PART_ROWS", 16)
    monkeypatch.setattr(clustering, "MOST_EDGES", 100)

    def groups(u, v):
        label = np.arange(len(m))
        for _ in range(len(m)):
            low = label.copy()
            np.minimum.at(low, u, label[v])
            np.minimum.at(low, v, label[u])
            if (low == label).all():
                return label.tolist()
            label = low

    for side in (None, np.arange(len(m)) % 2):
        allowed = np.triu(np.ones_like(w, bool), 1) if side is None else np.triu(side[:, None] != side[None, :], 1)
        for sparse in (0.0, 0.02, 1.0):
            monkeypatch.setattr(clustering, "SPARSE", sparse)
            u, v, x = clustering._forest_of_parts(m, core, side, eps)
            assert len(u) < len(m) and np.allclose(x, w[u, v], atol=1e-11)
            for at in (eps / 2, eps):
                i, j = np.nonzero(allowed & (w <= at))
                assert groups(u[x <= at], v[x <= at]) == groups(i, j)


def test_chunks_that_need_all_references_are_put_together(spark):
    """Where pivots part nothing, references go to few chunks, and the rows found are the same."""
    n = 1500
    m = _vectors(n, 32, 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "qid long, vec array<double>")
    refs = df.withColumnRenamed("qid", "rid")
    limits = Limits(broadcast_bytes=0, block_rows=25)
    tagged = df.withColumn("tag", F.lit(-2))
    r = refs.select("rid", F.lit("").alias("label"), F.lit(-1).alias("tag"), "vec")
    dealt, shipped, chunks = _dealt_by_need(tagged, r, 3, Cosine(), "self", np.inf, limits, n)
    assert dealt.count() == n and dealt.select("chunk").distinct().count() <= chunks
    assert shipped.count() / n <= 13
    got = {(g.qid, g["rank"]): g.rid for g in knn_join(df, refs, 3, exclude="self", limits=limits).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -np.inf)
    best = np.argsort(-s, axis=1)[:, :3]
    assert got == {(i, k + 1): best[i, k] for i in range(n) for k in range(3)}


def test_queries_of_one_file_are_searched_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "SPREAD_REFS", 100)
    m = _vectors(200, 8, 9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "qid long, vec array<double>").coalesce(1)
    q = df.withColumn("tag", F.lit(-2))
    r = df.select(F.col("qid").alias("rid"), F.lit("").alias("label"), F.lit(-1).alias("tag"), "vec")
    out = "qid bigint, rid bigint, label string, score double"
    hits = neighbors._broadcast_join(q, r, 3, Cosine(), "self", np.inf, out, 200)
    tasks = hits.select("qid", F.spark_partition_id().alias("task")).distinct()
    assert tasks.count() == 200 and tasks.select("task").distinct().count() > 4
