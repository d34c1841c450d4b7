"""Nothing is cut, ids may be of any type, and scratch tables stay few and shared."""

import difflib
import glob
from types import SimpleNamespace

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aisleframe import runtime
from aisleframe.functions import text
from aisleframe.operators import clustering, discovery, discriminant, market, matching, recognition
from aisleframe.streaming import sessions


def unit(v):
    return (v / np.linalg.norm(v)).tolist()


@pytest.fixture(scope="module")
def twelve(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        rows += [(f"s{c}-{j}", f"class{c:02d}", unit(centre + 0.3 * rng.normal(size=24))) for j in range(6)]
    return spark.createDataFrame(rows, "id string, label string, vec array<double>")


def test_every_class_is_ranked(spark, twelve):
    queries = twelve.select("id", "vec")
    head = discriminant.fit(twelve)
    full = discriminant.posteriors(queries, head)
    sums = full.groupBy("id").agg(F.count("*").alias("n"), F.sum("score").alias("s")).collect()
    assert all(r.n == 12 and abs(r.s - 1) < 1e-9 for r in sums)
    for k, want in ((12, 12), (8, 8), (None, 12), (5, 5)):
        got = matching.top_matches(queries, twelve, k)
        assert got.count() == 72 * want
        # Without a head one is fitted, so scores are posteriors.
        assert got.join(full.withColumnRenamed("score", "p"), ["id", "label"]).where("abs(score - p) > 1e-9").count() == 0
    assert matching.top_matches(queries, twelve, None, "prototype").count() == 72 * 12


def test_catalogue_ids_do_not_collide(spark):
    brands = spark.createDataFrame([("b", "Bee", 0)], "brand_id string, short string, pos int")
    flavours = spark.createDataFrame([("b", f"f{k}", f"F{k}", k) for k in range(40)], "brand_id string, flavor string, flavor_code string, pos int")
    sizes = spark.createDataFrame([("b", f"{k}ml", f"{k}", k) for k in range(30)], "brand_id string, size string, size_code string, pos int")
    ids = [r.product_id for r in market.expand_catalogue(brands, flavours, sizes).collect()]
    assert len(ids) == len(set(ids)) == 1200 and {"P001", "P999", "P1000", "P1200"} <= set(ids)


@pytest.mark.parametrize("blocks", [400_000, 40])
def test_competitors_of_string_ids(spark, blocks):
    rng = np.random.default_rng(3)
    pairs = sorted({(f"P{rng.integers(30):03d}", f"S{rng.integers(20)}") for _ in range(200)} | {("P999", f"S{k}") for k in range(20)})
    obs = spark.createDataFrame(pairs, "product_id string, store_id string")
    at = {}
    for p, s in pairs:
        at.setdefault(p, set()).add(s)
    want = set()
    for p in at:
        near = sorted(((-len(at[p] & at[q]), q) for q in at if q != p and at[p] & at[q]))[:6]
        want |= {(p, q, -n, k + 1) for k, (n, q) in enumerate(near)}
    got = market.competitors(obs, block_pairs=blocks).collect()
    assert {(r.product_id, r.competitor_id, r.stores, r["rank"]) for r in got} == want


def points(spark, name, kind):
    rng = np.random.default_rng(5)
    rows, truth = [], []
    for c in range(4):
        centre = rng.normal(size=8)
        for j in range(6):
            rows.append((name(c * 6 + j), unit(centre + 0.02 * rng.normal(size=8))))
            truth.append((name(c * 6 + j), f"t{c}"))
    rows.append((name(90), unit(rng.normal(size=8))))
    truth.append((name(90), "t9"))
    return (spark.createDataFrame(rows, f"id {kind}, vec array<double>"),
            spark.createDataFrame(truth, f"id {kind}, truth string"))


@pytest.mark.parametrize("name,kind", [(lambda k: f"crop-{k:02d}", "string"), (lambda k: -k, "long"), (lambda k: k, "long")])
def test_clusters_of_any_id(spark, name, kind):
    pts, truth = points(spark, name, kind)
    got = {r.id: r.cluster_id for r in clustering.number_clusters(clustering.dbscan(pts, 0.05)).collect()}
    assert got[name(90)] == -1 and sorted(set(got.values())) == [-1, 0, 1, 2, 3]
    first = {c: min(i for i in got if got[i] == c) for c in range(4)}
    assert sorted(first.values()) == [first[c] for c in range(4)]
    for least in (2, 3):
        sweep = {r.eps: r for r in clustering.eps_sweep(pts, truth, [1e-9, 0.05], least).collect()}
        assert (sweep[0.05].clusters, sweep[0.05].noise, sweep[0.05].purity) == (4, 1, 1.0)
        assert (sweep[1e-9].clusters, sweep[1e-9].noise) == (0, 25) and np.isnan(sweep[1e-9].purity)


def test_component_rounds_leave_one_table(spark):
    folder = runtime.shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/components-*"))
    edges = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(150)], "u string, v string")
    got = clustering.connected_components(edges)
    assert got.count() == 151 and got.select("component").distinct().collect()[0][0] == "n000"
    assert len(set(glob.glob(f"{folder}/components-*")) - before) == 1


def test_places_of_sorted_values(spark):
    names = [f"v{k:04d}" for k in range(500)]
    got = runtime.numbered(spark.createDataFrame([(n,) for n in reversed(names)], "x string"), "x", "i")
    assert {r.x: r.i for r in got.collect()} == {n: i for i, n in enumerate(names)}


def test_sessions_of_string_ids(spark, tmp_path):
    rows = [("s1", "a", 1.0), ("s1", "b", 2.0), ("s2", "a", 3.0)]
    schema = "session string, product string, area double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    crops = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "out")
    given = sessions.run_to_end(crops, folder).collect()
    read = sessions.session_progress(spark, folder).collect()
    assert sorted(map(tuple, given)) == sorted(map(tuple, read)) and {r.session for r in read} == {"s1", "s2"}


def test_a_brand_without_hits_keeps_its_share(spark):
    rows = [("x", 0, k, f"t{k}", f"u{k}", "s" * 3000) for k in range(40)]
    results = spark.createDataFrame(rows, "brand string, query_pos int, pos int, title string, url string, snippet string")
    asked = spark.createDataFrame([("x",), ("y",), ("z",)], "brand string")
    assert discovery.cap_results(results).count() == 30
    got = discovery.cap_results(results, asked=asked)
    assert got.count() == 10 and got.select(F.max(F.length("snippet"))).first()[0] == discovery.SNIPPET_LENGTH


def test_repeated_keys_are_read(spark):
    rows = spark.createDataFrame([('{"a":1,"a":2}',), ('{"a":1,"a":2',), ('x {"a": 3, "a": 4} y',)], "t string")
    good, bad = discovery.parse_responses(rows, "t", "a int")
    assert sorted(r.response.a for r in good.collect()) == [2, 4]
    assert [r.error for r in bad.collect()] == ["no JSON found"]


def test_a_cluster_without_shared_folder_is_refused():
    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(session)


def test_moments_of_many_classes_stay_within_their_budget(spark):
    rng = np.random.default_rng(2)
    rows = [(0, f"c{k % 2000:04d}", rng.normal(size=8).tolist()) for k in range(6000)]
    df = spark.createDataFrame(rows, "model int, label string, vec array<double>")
    # 2,000 matrices of 8 x 8 are 1 MB; a task may hold a sixteenth of that.
    got = discriminant._moments(df, budget=64 * 1024).where("i = 3").collect()
    want = {}
    for _, label, v in rows:
        n, s, g = want.get(label, (0, 0.0, 0.0))
        want[label] = (n + 1, s + v[3], g + v[3] * np.array(v))
    assert len(got) == 2000
    for r in got:
        n, s, g = want[r.label]
        assert r.n == n and abs(r.sx - s) < 1e-9 and np.allclose(r["row"], g)


def test_recognition_in_lda_on_planted_centres(spark, twelve):
    refs = twelve.withColumn("label", F.concat(F.lit("brand_1L_"), "label"))
    held = {c: [r.vec for r in twelve.where(F.col("label") == c).collect()] for c in ("class00", "class01")}
    between = unit(np.mean(held["class00"], axis=0) + np.mean(held["class01"], axis=0))
    weak = spark.createDataFrame([("odd", between), ("odder", between)], "id string, vec array<double>")
    crops = refs.select("id", "vec").unionByName(weak)
    reads = spark.createDataFrame([], "id string, flavour string, flavour_score double, brand string, brand_score double, brand_runner_up double")
    verdicts = spark.createDataFrame([("odd", "brand_1L_class03", 0.7), ("odder", "unlisted", 0.9)], "id string, label string, confidence double")
    got = recognition.recognise(crops, refs, reads, verdicts, score_floor=0.6)
    rows = {r.id: r for r in got.collect()}
    truth = {r.id: r.label for r in refs.collect()}
    assert np.mean([rows[i].product in (truth[i], "low_confidence") for i in truth]) > 0.95
    assert np.mean([rows[i].product == truth[i] for i in truth]) > 0.5
    assert rows["odd"].source == "llm" and rows["odd"].product == "brand_1L_class03"
    assert rows["odder"].product == "low_confidence"
    located = crops.select("id", F.lit(2.0).alias("area"), F.lit(1).alias("photo"))
    shares = recognition.shelf_shares(got, located).collect()
    assert abs(sum(r.share_by_facings for r in shares) - 1) < 1e-9


def test_competitors_form_only_block_pairs_in_reach(spark):
    """Regional ranges: products of far regions are never counted against each other."""
    rng = np.random.default_rng(6)
    rows = []
    for p in range(240):
        region = p // 30
        shops = set((region * 40 + rng.choice(40, 12, replace=False)).tolist())
        if p % 30 == 0:
            shops |= set(rng.choice(320, 8, replace=False).tolist())
        rows += [(p, s) for s in shops]
    obs = spark.createDataFrame(rows, "product_id long, store_id long")
    keyed, profiles = market._blocks_by_range(obs.distinct(), len(rows), 300)
    blocks = profiles.select("block").distinct()
    own = market._shared_by_blocks(keyed, blocks.selectExpr("block as bl", "block as br"), 6)
    wanted, all_pairs = market._block_pairs_in_reach(profiles, own, 6).count(), blocks.count() ** 2
    assert blocks.count() >= 8 and 0 < wanted < all_pairs / 2
    carried = {}
    for p, s in rows:
        carried.setdefault(p, set()).add(s)
    want = {}
    for p, mine in carried.items():
        ranked = sorted((-len(mine & other), q) for q, other in carried.items() if q != p and mine & other)[:6]
        want.update({(p, k + 1): (q, -c) for k, (c, q) in enumerate(ranked)})
    for size in (300, 400_000):
        got = market.competitors(obs, block_pairs=size).collect()
        assert {(r.product_id, r["rank"]): (r.competitor_id, r.stores) for r in got} == want


def test_competitors_travel_as_store_lists(spark, monkeypatch):
    """Blocks are shipped as a row per store, and meetings are sorted where counters would be idle."""
    rng = np.random.default_rng(9)
    rows = sorted({(int(p), int(s)) for p, s in zip(rng.integers(0, 300, 1500), rng.integers(0, 90, 1500))})
    obs = spark.createDataFrame(rows, "product_id long, store_id long")
    want = {tuple(r) for r in market.competitors(obs, block_pairs=100).collect()}
    a = pd.DataFrame(rows, columns=["product_id", "s"])
    dense = market._best_shared(a, a, 6).reset_index(drop=True)
    monkeypatch.setattr(market, "CELLS", 1)
    monkeypatch.setattr(market, "SPARSE", 0)
    pd.testing.assert_frame_equal(market._best_shared(a, a, 6).reset_index(drop=True), dense)
    assert {tuple(r)[:3] for r in want} == set(dense.itertuples(index=False, name=None))
    keyed = obs.select("product_id", F.col("store_id").alias("s"), (F.col("product_id") % 2).alias("block"))
    wanted = spark.createDataFrame([(0, 1)], "bl long, br long")
    plan = market._shared_by_blocks(keyed, wanted, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(product_id" in plan


@pytest.mark.parametrize("sparse", [16, 0, 1 << 20])
def test_blocks_of_competitors_are_read_again_and_not_shipped(spark, monkeypatch, sparse):
    rng = np.random.default_rng(12)
    rows = sorted({(f"P{p}", int(s)) for p, s in zip(rng.integers(0, 200, 2500), rng.integers(0, 60, 2500))})
    carried = {}
    for p, s in rows:
        carried.setdefault(p, set()).add(s)
    want = set()
    for p, mine in carried.items():
        ranked = sorted((-len(mine & other), q) for q, other in carried.items() if q != p and mine & other)[:6]
        want |= {(p, q, -c, k + 1) for k, (c, q) in enumerate(ranked)}
    # Repeated rows and stores without a name meet nothing new.
    obs = spark.createDataFrame(rows + rows[::7] + [("P1", None), ("P2", None)], "product_id string, store_id long")
    monkeypatch.setattr(market, "SPARSE", sparse)
    got = market.competitors(obs, block_pairs=120)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "shuffle_replicate_nl" in plan and "CoGroup" not in plan and "by_store" in plan
    assert {tuple(r) for r in got.select("product_id", "competitor_id", "stores", "rank").collect()} == want


def test_unnamed_products_and_stores_stay(spark):
    rows = [(1, 1), (None, 1), (2, 1), (2, 2), (None, 2), (3, None)]
    obs = spark.createDataFrame(rows, "product_id long, store_id long")
    got = {(r.product_id, r.competitor_id): r.stores for r in market.competitors(obs).collect()}
    assert got[2, None] == 2 and got[2, 1] == 1 and (3, 1) not in got
    products = spark.createDataFrame([(p, "b") for p in (1, 2, 3)], "product_id long, brand_id string")
    missing = {(r.store_id, r.product_id) for r in market.missing_products(obs, products).collect()}
    assert missing == {(1, 3), (2, 1), (2, 3), (None, 1), (None, 2), (None, 3)}


def test_missing_products_never_shuffle_a_catalogue_per_store(spark):
    obs = spark.createDataFrame([(p, s) for s in range(6) for p in range(s, 40, 7)], "product_id long, store_id long")
    products = spark.createDataFrame([(p, f"b{p % 3}") for p in range(40)], "product_id long, brand_id string")
    seen = {(r.store_id, r.product_id) for r in obs.collect()}
    brand = {r.product_id: r.brand_id for r in products.collect()}
    carried = {(s, brand[p]) for s, p in seen}
    want = sorted((s, p, b) for p, b in brand.items() for s in range(6) if (s, b) in carried and (s, p) not in seen)
    for chunk in (50_000, 5):
        got = market.missing_products(obs, products, chunk)
        assert sorted(map(tuple, got.collect())) == want
        # Above the join with the catalogue nothing is exchanged.
        plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins = [line for line in plan if "Join " in line]
        assert "salt" in joins[0] and "LeftOuter" not in "".join(joins)


def test_seen_pairs_of_missing_products_move_to_product_and_brand_only(spark):
    obs = spark.createDataFrame([(p, s) for s in range(6) for p in range(s, 40, 7)] * 2 + [(3, None)], "product_id long, store_id long")
    products = spark.createDataFrame([(p, f"b{p % 3}") for p in range(40)], "product_id long, brand_id string")
    got = market.missing_products(obs, products)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("store_id" in k for k in keys)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and sorted(p for s, p, _ in rows if s is None) == list(range(0, 40, 3))


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("values", [1_000_003, 7])
def test_deep_pages_sort_only_their_range(spark, descending, values):
    """A page deep in a million rows, on distinct values and on few values with a tie column."""
    n, page = 1_000_000, 70_000
    rows = spark.range(n).select("id", (F.col("id") * 7919 % values).alias("v"))
    seen = []
    kept = market._narrowed

    def spy(*args):
        seen.append(kept(*args))
        return seen[-1]

    market._narrowed = spy
    try:
        got = market.search_page(rows, "", [], "v", descending=descending, page=page, page_size=10, tie="id").collect()
    finally:
        market._narrowed = kept
    ids = np.arange(n)
    v = ids * 7919 % values
    want = np.lexsort((ids, -v if descending else v))[page * 10 : page * 10 + 10]
    assert [r.id for r in got] == want.tolist()
    assert seen[-1][1] <= 50_000 and seen[-1][0].count() == seen[-1][1]
    last = market.search_page(rows, "", [], "v", page=10**9, page_size=10, tie="id").collect()
    assert len(last) == 10


def test_few_pairs_are_compared_letter_by_letter(spark):
    """Bounds hold, scores equal a comparison of every pair, and not every pair needs one."""
    rng = np.random.default_rng(12)
    terms = ["peach", "orange juice", "pineapple", "mandarin", "apple", "grape", "red grape", "tea", "lemonade", "limonade"]
    word = lambda: "".join(rng.choice(list("aeimnrlpgcd "), rng.integers(0, 12)))
    tokens = sorted({word() for _ in range(300)} | {"peach", "pinapple", "grapes", "mandarine", "", "lemon", "teapot"})
    rows = [(t, f"k{i % 4}", w) for t in tokens for i, w in enumerate(terms)]
    pairs = spark.createDataFrame(rows, "token string, key string, term string").cache()
    least, most = text.fuzzy_bounds(F.col("token"), F.col("term"))
    for r in pairs.where("token <> ''").select("*", least.alias("least"), most.alias("most")).collect():
        exact = difflib.SequenceMatcher(None, r.token, r.term).ratio()
        assert r.least <= exact <= r.most, r
    want = {}
    for t, k, w in rows:
        one = 0.0 if not t else float(w in t) if len(w) <= text.SHORT_TERM else difflib.SequenceMatcher(None, t, w).ratio()
        want[t, k] = max(want.get((t, k), 0.0), one)
    compared = spark.sparkContext.accumulator(0)
    plain = text.fuzzy_ratio

    @F.pandas_udf("double")
    def counting(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(int(a.notna().sum()))
        return pd.Series([None if x is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    text.fuzzy_ratio = counting
    try:
        got = {(r.token, r.key): r.score for r in text.match_terms(pairs, ["token", "key"]).collect()}
    finally:
        text.fuzzy_ratio = plain
    assert got == want
    assert 0 < compared.value < 0.8 * len(rows)


def test_cases_of_a_small_file_are_dealt_over_all_cores(spark):
    """A row of parts is few bytes and much work: one file must not be one task, nor be merged into one."""
    from aisleframe.plans import discovery

    for cases in (discovery._cases, discovery._varied_cases):
        rows = cases(spark, "/root/testdata/sf0.001")
        assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
