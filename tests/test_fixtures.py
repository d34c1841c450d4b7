"""Hand-checked expectations on small inputs."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from aisleframe.functions import labels, scalars, text
from aisleframe.model import Filters, is_bucket, is_non_product
from aisleframe.operators import discovery, evaluation, evidence, geometry, market, quality, share

BOX = "photo string, idx int, x1 double, y1 double, x2 double, y2 double, conf double"


def one(df):
    return df.first()[0]


def merged(spark, boxes):
    rows = [("p", i, *map(float, b), c) for i, (b, c) in enumerate(boxes)]
    got = geometry.merge_adjacent_boxes(spark.createDataFrame(rows, BOX)).collect()
    return sorted((r["idx"], r["x1"], r["y1"], r["x2"], r["y2"], r["conf"]) for r in got)


@pytest.mark.parametrize(
    "boxes,expect",
    [
        ([((0, 0, 10, 20), 0.6), ((0, 20.5, 10, 40), 0.9)], [(0, 0, 0, 10, 40, 0.9)]),
        ([((50, 0, 60, 20), 0.6), ((50, 22, 60, 42), 0.6)], 2),
        ([((100, 0, 110, 35), 0.6), ((100, 35, 110, 70), 0.6)], 2),
        ([((200, 0, 210, 20), 0.6), ((200, 20, 217, 40), 0.6)], 2),
        ([((300, 0, 310, 15), 0.5), ((300, 15, 310, 30), 0.7), ((300, 30, 310, 45), 0.6)],
         [(0, 300, 0, 310, 45, 0.7)]),
        ([((0, 0, 0, 20), 0.6), ((0, 20, 10, 40), 0.9)], 2),
    ],
)
def test_box_merge(spark, boxes, expect):
    got = merged(spark, boxes)
    assert len(got) == expect if isinstance(expect, int) else got == expect


def test_box_merge_on_many_photos(spark):
    rows = [
        (f"p{i}", j, 10.0 * j, 0.0, 10.0 * j + 8, 15.0, 0.5) for i in range(40) for j in range(6)
    ]
    rows += [(f"p{i}", 6, 0.0, 15.0, 8.0, 30.0, 0.9) for i in range(0, 40, 2)]
    got = geometry.merge_adjacent_boxes(spark.createDataFrame(rows, BOX).repartition(7))
    n = {r["photo"]: r["n"] for r in got.groupBy("photo").agg(F.count("*").alias("n")).collect()}
    assert set(n.values()) == {6}
    assert got.where("conf = 0.9").count() == 20


def test_empty_boxes(spark):
    assert geometry.merge_adjacent_boxes(spark.createDataFrame([], BOX)).count() == 0


def test_crop_box(spark):
    row = spark.createDataFrame(
        [("p", 0, 1.9, 5.2, 98.7, 60.1, 0.9, 100, 60)], BOX + ", img_w int, img_h int"
    )
    r = geometry.crop_boxes(row).first()
    assert (r["crop"], r["x1"], r["y1"], r["x2"], r["y2"], r["area"]) == ("p-0", 0, 3, 100, 60, 5700)


def test_number_boxes_is_a_row_number(spark):
    rows = [("hot" if i % 3 else f"p{i % 7}", 0, float(i % 5), float(i), 1.0, 1.0, 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, BOX).drop("idx")
    got = geometry.number_boxes(df, [F.col("x1")], [F.col("y1")])
    want = df.selectExpr("*", "row_number() over (partition by photo order by x1, y1) - 1 as want")
    both = got.join(want, ["photo", "x1", "y1"])
    assert both.count() == 200 and both.where("idx <> want").count() == 0


EVIDENCE = (
    "id int, flavour string, flavour_score double, brand string, brand_score double, "
    "brand_runner_up double"
)


def fused(spark, cands, ev):
    c = spark.createDataFrame(
        [(1, l, s, i + 1) for i, (l, s) in enumerate(cands)], "id int, label string, score double, rank int"
    )
    e = spark.createDataFrame([(1, *ev)] if ev else [], EVIDENCE)
    return [(r["label"], r["score"]) for r in evidence.fuse(c, e).orderBy("rank").collect()]


CANDS = [("sunich_1L_orange", 0.99), ("sunich_1L_peach", 0.007), ("unknown_beverage", 0.003)]


def test_fusion_routes_a_foreign_brand_to_unknown(spark):
    got = fused(spark, CANDS, ("orange", 1.0, "sunstar", 1.0, 0.4615))
    assert [g[0] for g in got] == ["unknown_beverage", "sunich_1L_orange", "sunich_1L_peach"]
    assert [g[1] for g in got] == pytest.approx([0.99992626, 7.3628e-5, 1.1616e-7], rel=1e-4)


def test_fusion_flavour_only(spark):
    cands = [("sunich_1L_mix", 0.45), ("sunich_1L_cherry", 0.40), ("unknown_beverage", 0.15)]
    got = dict(fused(spark, cands, ("cherry", 1.0, None, 0.0, 0.0)))
    assert got["sunich_1L_cherry"] == pytest.approx(0.74923471)
    assert got["sunich_1L_mix"] == pytest.approx(0.18807397)
    assert got["unknown_beverage"] == pytest.approx(0.06269132)


def test_fusion_without_evidence_changes_nothing(spark):
    assert fused(spark, CANDS, None) == CANDS
    assert fused(spark, CANDS, ("orange", 0.59, "sunstar", 0.9, 0.8)) == CANDS


@pytest.mark.parametrize(
    "token,term,expect",
    [
        ("sunstar", "sunich", 0.461538),
        ("sunst4r", "sunstar", 0.857143),
        ("peaer", "peach", 0.60),
        ("mixx", "mix", 1.0),
        ("mxi", "mix", 0.0),
    ],
)
def test_term_match(spark, token, term, expect):
    df = spark.createDataFrame([(token, term)], "a string, b string")
    assert one(df.select(text.match_term(F.col("a"), F.col("b")))) == pytest.approx(expect, abs=1e-6)


def test_reads_become_evidence(spark):
    reads = spark.createDataFrame(
        [(1, [("Sun-Star", 0.9), ("پرتقال", 0.8), ("mango", 0.1)]), (2, [("؟", 0.9)])],
        "id int, reads array<struct<text string, conf double>>",
    )
    tokens = evidence.read_tokens(reads)
    ev = evidence.read_evidence(evidence.term_scores(tokens))
    r = ev.collect()
    assert len(r) == 1 and r[0]["brand"] == "sunstar" and r[0]["flavour"] == "orange"
    assert r[0]["brand_runner_up"] == pytest.approx(0.461538, abs=1e-6)
    crops = spark.createDataFrame([(1, "sunstar_240ml_orange"), (2, "x")], "id int, truth string")
    y = evidence.reading_yield(crops, ev, tokens).first()
    assert tuple(y) == (2, 1, 1, 1, 1)


def test_normalise_text(spark):
    df = spark.createDataFrame([("سن ایچ",), ("ﬁne ＡＢ-c_1",), ("مولتي‌ويتامين",)], "t string")
    got = [r[0] for r in df.select(text.normalise(F.col("t"))).collect()]
    assert got == ["سنایچ", "fineabc1", "مولتیویتامین"]


def test_should_consult(spark):
    c = spark.createDataFrame(
        [(1, "a_1L_x", 0.9, 1), (1, "b_1L_x", 0.1, 2), (2, "unknown_beverage", 0.5, 1),
         (2, "a_1L_x", 0.4, 2), (3, "unknown_beverage", 0.9, 1)],
        "id int, label string, score double, rank int",
    )
    get = lambda **k: {r["id"]: r["consult"] for r in evidence.should_consult(c, **k).collect()}
    assert get() == {1: False, 2: True, 3: False}
    assert get(verify_brand=True) == {1: True, 2: True, 3: False}


def test_second_opinion(spark):
    g = spark.createDataFrame(
        [(1, "low_confidence", 0.1, "local"), (2, "low_confidence", 0.2, "local"), (3, "a", 0.9, "local")],
        "id int, product string, score double, source string",
    )
    v = spark.createDataFrame([(1, "b", 0.7), (2, "zzz", 0.9), (3, "b", 0.9)], "id int, label string, confidence double")
    out = evidence.second_opinion(g, v, spark.createDataFrame([("b",)], "label string"))
    got = {r["id"]: tuple(r)[1:] for r in out.collect()}
    assert got == {1: ("b", 0.7, "llm"), 2: ("low_confidence", 0.2, "local"), 3: ("a", 0.9, "local")}


@pytest.mark.parametrize(
    "preds,expect",
    [
        (("sunich_1L_apple", "low_confidence", "non_beverage"), (1.0, 1.0, 0, 1.0)),
        (("sunich_1L_apple", "sunich_1L_mango", "non_beverage"), (1.0, 0.5, 1, 0.75)),
    ],
)
def test_open_set_metrics(spark, preds, expect):
    truth = ("sunich_1L_apple", "unknown_beverage", "non_beverage")
    rows = spark.createDataFrame(list(zip(preds, truth)), "pred string, truth string")
    m = evaluation.open_set_metrics(rows).first()
    assert (m["sku_accuracy"], m["neg_handled"], m["false_accepts"], m["balanced"]) == expect


def test_open_set_metrics_without_negatives(spark):
    m = evaluation.open_set_metrics(spark.createDataFrame([("a", "a")], "pred string, truth string")).first()
    assert math.isnan(m["neg_handled"]) and math.isnan(m["balanced"]) and m["sku_accuracy"] == 1.0


def test_inferred_sources(spark):
    known = spark.createDataFrame([("t3",), ("2025",)], "photo string")
    none = known.where("false")
    def groups(paths, k):
        df = spark.createDataFrame([(p,) for p in paths], "path string")
        got = {r["path"]: r["group"] for r in evaluation.infer_source_photo(df, k).collect()}
        return [got[p] for p in paths]
    assert groups(
        ["data/sample/t3.jpg", "kb/unknown_beverage/t3 (Edited).jpg",
         "kb/unknown_beverage/t3 (Edited) (Edited 2).jpg"], known) == ["t3"] * 3
    assert groups(
        ["kb/sunich_1L_apple/2025-12.jpg", "kb/sunich_1L_orange/orange_front.jpg",
         "kb/sunich_750ml_orange/orange_front.jpg", "kb/sunich_1L_cherry/0x.jpg"], none,
    ) == ["2025", "sunich_1L_orange::orange", "sunich_750ml_orange::orange", "sunich_1L_cherry::0x"]


def test_recorded_provenance_wins(spark):
    files = spark.createDataFrame(
        [("kb/a/x-1.jpg", "a/x-1.jpg"), ("kb/a/y-1.jpg", "a/y-1.jpg")], "path string, kb_file string"
    )
    rec = spark.createDataFrame([("a/x-1.jpg", "zed")], "kb_file string, source_photo string")
    out = evaluation.resolve_groups(files, rec, spark.createDataFrame([], "photo string"))
    assert {(r["group"], r["inferred"]) for r in out.collect()} == {("zed", False), ("y", True)}
    assert tuple(quality.count_inferred(out).first()) == (2, 1)


def test_folds_keep_groups_together(spark):
    rows = spark.range(400).selectExpr("id", "cast(id / 4 as long) as photo", "cast(id % 3 as string) as label")
    folds = evaluation.assign_folds(rows)
    per = folds.groupBy("photo").agg(F.countDistinct("fold").alias("n"))
    assert per.where("n > 1").count() == 0
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 16


@pytest.mark.parametrize(
    "given,expect",
    [("240 ml", "240ml"), ("1000ml", "1L"), ("1.5 L", "1.5L"), ("25cl", "250ml"), ("330cc", "330ml"),
     ("0 ml", ""), ("large", ""), ("۲۵۰ میلی‌لیتر", "250ml"), ("1,5 litre", "1.5L"),
     ("1,000 ml", "1L"), ("2 لیتری", "2L"), (None, "")],
)
def test_sizes(spark, given, expect):
    df = spark.createDataFrame([(given,)], "t string")
    assert one(df.select(text.normalise_size(F.col("t")))) == expect


@pytest.mark.parametrize(
    "given,fruits,expect",
    [("", ["orange", "mango"], "mix"), ("blood orange juice", [], "orange"), ("sour cherry", [], "cherry"),
     ("peach nectar", [], "peach"), ("Green Tea drink", [], "greentea"), ("هلو", ["peach"], ""),
     (None, ["peach"], "peach"), ("mixed fruits", [], "mix"), ("peach tea", [], "peach")],
)
def test_flavours(spark, given, fruits, expect):
    df = spark.createDataFrame([(given, fruits)], "t string, f array<string>")
    assert one(df.select(discovery.flavour(F.col("t"), F.col("f")))) == expect


@pytest.mark.parametrize(
    "body,ok,error",
    [('```json\n{"a": 1}\n```', True, None), ('so: {"a": {"b": 2}} ok', True, None), ("", False, "empty response"),
     ("[1]", False, "not a JSON object"), ("{broken", False, "no JSON found"), ("x {a b} y", False, "malformed JSON")],
)
def test_response_json(spark, body, ok, error):
    r = spark.createDataFrame([(body,)], "t string").select(discovery.response_object(F.col("t")).alias("r")).first()["r"]
    assert (r["json"] is not None) == ok and r["error"] == error


def test_labels(spark):
    df = spark.createDataFrame(
        [("sunich_750ml_mix",), ("unknown_beverage",), ("non_beverage_snack",), ("sunich_1L_apple",)], "l string"
    )
    got = [tuple(r[0]) for r in df.select(labels.brand_and_flavour(F.col("l"))).collect()]
    assert got == [("sunich", "mix"), (None, None), (None, None), ("sunich", "apple")]
    got = [tuple(r[0]) for r in df.select(labels.report_parts(F.col("l"))).collect()]
    assert got[3] == ("sunich", "1L", "apple") and got[1] == ("unknown", "beverage", "unknown")
    flags = [tuple(r) for r in df.select(is_non_product(F.col("l")), is_bucket(F.col("l"))).collect()]
    assert flags == [(False, False), (False, True), (True, True), (False, False)]


def test_dates_and_distance(spark):
    days = [(2024, 3, 20), (2024, 3, 19), (2026, 9, 9), (2001, 11, 5)]
    df = spark.createDataFrame([(i, date(*d)) for i, d in enumerate(days)], "i int, d date")
    got = [tuple(r[0]) for r in df.orderBy("i").select(scalars.jalali(F.col("d"))).collect()]
    assert got == [(1403, 1, 1), (1402, 12, 29), (1405, 6, 18), (1380, 8, 14)]
    km = scalars.haversine_km(*[F.lit(v) for v in (36.2972, 59.6062, 36.3185, 59.5891)])
    assert one(spark.range(1).select(km)) == pytest.approx(2.82088626)


def test_share_of_shelf(spark):
    rows = [("apple", 100.0), ("apple", 200.0), ("mango", 300.0), ("unknown_beverage", 400.0),
            ("low_confidence", 500.0), ("non_beverage", 600.0)]
    p = spark.createDataFrame(rows, "product string, area double")
    got = {r["product"]: (r["facings"], r["share_by_facings"], r["share_by_space"]) for r in share.share_of_shelf(p).collect()}
    assert got == {"apple": (2, 0.5, 0.3), "mango": (1, 0.25, 0.3), "unknown_beverage": (1, 0.25, 0.4)}
    assert tuple(share.run_summary(p).first()) == (6, 4, 1, 1)
    assert share.share_of_shelf(p.where("product = 'low_confidence'")).count() == 0


@pytest.fixture(scope="module")
def mini(spark):
    obs = spark.createDataFrame(
        [("p1", "s1", 3, 300.0), ("p1", "s1", 1, 100.0), ("p3", "s1", 4, 200.0), ("p3", "s2", 2, 100.0)],
        "product_id string, store_id string, detected_count int, shelf_area double",
    ).withColumns({"observed_at": F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz"), "confidence": F.lit(0.9)})
    products = spark.createDataFrame(
        [("p1", "A"), ("p2", "A"), ("p3", "B")], "product_id string, brand_id string"
    ).withColumns({"sku": F.col("product_id"), "flavor": F.lit("f"), "size": F.lit(1)})
    brands = spark.createDataFrame([("A",), ("B",), ("C",)], "brand_id string")
    stores = spark.createDataFrame(
        [("s1", "d1", 36.0, 59.0), ("s2", "d1", 36.01, 59.0), ("s3", "d2", 36.02, 59.0)],
        "store_id string, district string, lat double, lng double",
    ).withColumn("store_name", F.col("store_id"))
    return obs, products, brands, stores


def test_market_mini_set(mini):
    obs, products, brands, stores = mini
    rows = {r["brand_id"]: r for r in market.brand_share(obs, products, brands).collect()}
    assert rows["B"]["facings_pct"] == 60 and rows["B"]["area_pct"] == pytest.approx(42.857142857)
    assert rows["A"]["facings"] == 4 and rows["A"]["area_pct"] == pytest.approx(57.142857143)
    assert tuple(rows["C"])[1:] == (0, 0, 0, 0)
    cov = {r["brand_id"]: (r["stores"], r["coverage"]) for r in market.market_coverage(obs, products, brands, stores).collect()}
    assert cov == {"A": (1, 50.0), "B": (2, 100.0), "C": (0, 0.0)}
    d = {r["product_id"]: r["share"] for r in market.product_share_where_carried(obs).collect()}
    assert d["p1"] == pytest.approx(66.666666667) and d["p3"] == pytest.approx(42.857142857)
    s = {r["store_id"]: r for r in market.store_list(obs, products, stores).collect()}
    assert (s["s1"]["brands"], s["s1"]["products"], s["s1"]["observations"], s["s1"]["dominant"]) == (2, 2, 3, "A")
    assert s["s3"]["observations"] == 0
    assert "s3" not in {r["store_id"] for r in market.store_list(obs, products, stores, Filters(brand_id="A")).collect()}
    miss = {(r["store_id"], r["product_id"]) for r in market.missing_products(obs, products).collect()}
    assert miss == {("s1", "p2")}
    area = {r["district"]: (r["count"], r["stores"]) for r in market.area_strength(obs, products, stores).collect()}
    assert area == {"d1": (10, 2), "d2": (0, 1)}
    assert market.period_delta(obs, products).first()["delta_pct"] == 0


def test_competitors_of_one_and_of_all(mini):
    obs = mini[0]
    assert [tuple(r) for r in market.competitors(obs, "p1").collect()] == [("p1", "p3", 1)]
    ids = {"p1": 1, "p3": 3}
    numbered = obs.withColumn("product_id", F.substring("product_id", 2, 1).cast("long"))
    for block in (400_000, 1):
        got = {(r["product_id"], r["competitor_id"], r["stores"]) for r in market.competitors(numbered, block_pairs=block).collect()}
        assert got == {(1, 3, 1), (3, 1, 1)}, ids


def test_missing_product_chunks_agree(mini):
    obs, products, _, _ = mini
    whole = market.missing_products(obs, products).collect()
    assert sorted(whole) == sorted(market.missing_products(obs, products, chunk=1).collect())


def test_catalogue(spark):
    brands = spark.createDataFrame([("alpha", "Alpha", 0), ("beta", "Beta", 1)], "brand_id string, short string, pos int")
    fl = spark.createDataFrame([("alpha", "apple", "APL", 0), ("alpha", "peach", "PCH", 1), ("beta", "apple", "APL", 0)],
                               "brand_id string, flavor string, flavor_code string, pos int")
    sz = spark.createDataFrame([("alpha", "1L", "100", 0), ("beta", "1L", "100", 0), ("beta", "250", "025", 1)],
                               "brand_id string, size string, size_code string, pos int")
    got = [(r["product_id"], r["sku"]) for r in market.expand_catalogue(brands, fl, sz).orderBy("product_id").collect()]
    assert got == [("P001", "AL-APL-100"), ("P002", "AL-PCH-100"), ("P003", "BE-APL-100"), ("P004", "BE-APL-025")]


def test_depth_guard(spark):
    good = ["data/kb/a_1L_b/x.jpg", "data/kb/non_beverage/y.jpg"]
    bad = good + ["data/kb/unknown_beverage/clustering_results/run_1/cluster_0/z.jpg"]
    df = lambda ps: spark.createDataFrame([(p,) for p in ps], "path string")
    quality.assert_flat_class_tree(df(good), "data/kb")
    with pytest.raises(quality.LayoutError, match="cluster_0"):
        quality.assert_flat_class_tree(df(bad), "data/kb")


def test_leakage_guard(spark):
    t = spark.createDataFrame([("t/1", "same"), ("t/2", "new")], "path string, content string")
    kb = spark.createDataFrame([("k/2", "same"), ("k/1", "same")], "path string, content string")
    with pytest.raises(quality.LeakageError):
        quality.assert_no_leakage(t, kb)
    assert quality.assert_no_leakage(t, kb, allow=True).first()["kb_path"] == "k/1"


def test_cache_signature(spark):
    cols = "path string, size long, model string, version int, variant string"
    a = spark.createDataFrame([("a/1.jpg", 10, "m", 1, "")], cols)
    assert quality.cache_is_valid(a, a)
    assert not quality.cache_is_valid(a, a.withColumn("size", F.lit(11).cast("long")))
    assert not quality.cache_is_valid(a, a.withColumn("variant", F.lit("tta")))


def case(**over):
    base = dict(
        initial=("candidate", "Acme", "peach", "", [], [], []),
        brands=["acme"],
        flavor=("peach", [], True, [], []),
        size=("recovered", "250 ml", True, [], []),
        ver=("accept", "Acme", "peach", "250ml", ["peach"], True, True, True, True, "confirmed", True, True, True, True, [], [], "fine"),
    )
    base.update(over)
    return (1, base["initial"], base["brands"], base["flavor"], base["size"], base["ver"])


CASE = """id int,
initial struct<status string, brand string, flavor string, size string, fruits array<string>, evidence array<string>, conflicts array<string>>,
brands array<string>,
flavor_recheck struct<flavor string, fruits array<string>, flavor_supported boolean, evidence array<string>, conflicts array<string>>,
size_recovery struct<status string, size string, size_supported boolean, evidence array<string>, conflicts array<string>>,
verification struct<verdict string, brand string, flavor string, size string, fruits array<string>, image_supported boolean,
  brand_recheck_supported boolean, flavor_recheck_supported boolean, size_recovery_supported boolean, web_status string,
  web_supported boolean, brand_supported boolean, flavor_supported boolean, size_supported boolean, evidence array<string>,
  conflicts array<string>, reason string>"""

VER = case()[5]


@pytest.mark.parametrize(
    "over,status,label",
    [
        ({}, "verified", "acme_peach_250ml"),
        ({"ver": VER[:9] + ("confirmed", None) + VER[11:]}, "partial", "acme_peach_250ml"),
        ({"ver": VER[:9] + ("inconclusive", None) + VER[11:]}, "verified", "acme_peach_250ml"),
        ({"flavor": ("peach", [], True, [], ["smudged"])}, "partial", "acme_peach_250ml"),
        ({"initial": ("candidate", "Acme", "peach", "", [], [], ["old doubt"])}, "verified", "acme_peach_250ml"),
        ({"size": ("not_found", "", False, [], []), "ver": VER[:3] + ("",) + VER[4:]}, "partial", "acme_peach_unknownsize"),
        ({"initial": ("none", "", "", "", [], [], []), "brands": None, "flavor": None, "size": None, "ver": None},
         "unresolved_unknown", None),
        ({"initial": ("none", "Acme", "", "", [], [], []), "brands": None, "flavor": None, "size": None, "ver": None},
         "partial", "acme_unknownflavor_unknownsize"),
    ],
)
def test_resolution(spark, over, status, label):
    r = discovery.resolve(spark.createDataFrame([case(**over)], CASE)).first()
    assert (r["status"], r["label"]) == (status, label)


def test_stage_gates(spark):
    rows = spark.createDataFrame(
        [case(), case(brands=[]), case(initial=("candidate", "a", "b", "1L", [], [], []))], CASE
    )
    got = sorted(r["stage"] for r in discovery.stage_gates(rows).collect())
    assert got == ["recover size", "unresolved: no brand", "verify"]
    sized = discovery.passed_through_size(discovery.stage_gates(rows)).where("stage = 'verify'").first()
    assert sized["size_recovery"]["status"] == "not_needed" and sized["size_recovery"]["size"] == "1L"
