"""How far the answers can be trusted: provenance, folds, open-set metrics, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import file_parent, file_stem
from ..model import (
    LOW_CONFIDENCE,
    MARGIN_FLOORS,
    MARGIN_GRID,
    MODES,
    SCORE_FLOORS,
    SCORE_GRID,
    VOTE_FLOOR,
    is_bucket,
)
from ..runtime import exact_percentiles, split_row_number
from . import evidence as ev
from .discriminant import fit, posteriors
from .matching import apply_gates, best_and_margin, match_knn, mean_vectors
from .neighbors import Limits, knn_join
from ..functions.vectors import unit

# File-name patterns of exports, crops and studio views.
EDITED = r"(?i)\s*\(Edited(?:\s+\d+)?\)"
CROP_INDEX = r"^(.*?)-(\d+)$"
STUDIO_VIEW = r"(?i)^(.*)_(?:front|back)[a-z0-9]*$"

NAN = float("nan")


def infer_source_photo(files: DataFrame, known: DataFrame) -> DataFrame:
    """Group id of every file from its name: adds ``group``.

    ``files(path[, label])``; the class defaults to the parent folder. ``known(photo)``.
    """
    cls = F.col("label") if "label" in files.columns else file_parent(F.col("path"))
    stem = F.trim(F.regexp_replace(file_stem(F.col("path")), EDITED, ""))
    named = files.withColumn("_stem", stem)
    marks = known.select(F.col("photo").alias("_stem")).distinct().withColumn("_known", F.lit(True))
    s = F.col("_stem")
    group = (
        F.when(F.col("_known"), s)
        .when(F.rlike(s, F.lit(CROP_INDEX)), F.regexp_extract(s, CROP_INDEX, 1))
        .when(
            F.rlike(s, F.lit(STUDIO_VIEW)),
            F.concat(cls, F.lit("::"), F.regexp_extract(s, STUDIO_VIEW, 1)),
        )
        .otherwise(F.concat(cls, F.lit("::"), s))
    )
    return named.join(marks, "_stem", "left").withColumn("group", group).drop("_stem", "_known")


def known_photos(files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Photo ids of a folder listing."""
    from ..functions.scalars import file_extension

    return files.where(file_extension(F.col("path")).isin(*extensions)).select(
        file_stem(F.col("path")).alias("photo")
    ).distinct()


def resolve_groups(files: DataFrame, recorded: DataFrame, known: DataFrame) -> DataFrame:
    """Recorded provenance first, inference for the rest: adds ``group`` and ``inferred``.

    ``files(path, kb_file)``, ``recorded(kb_file, source_photo)``.
    """
    guessed = infer_source_photo(files, known)
    return guessed.join(recorded.select("kb_file", "source_photo"), "kb_file", "left").select(
        *files.columns,
        F.coalesce("source_photo", "group").alias("group"),
        F.col("source_photo").isNull().alias("inferred"),
    )


def assign_folds(rows: DataFrame, k: int = 5, group: str = "photo") -> DataFrame:
    """Fold per row: whole groups stay together and labels spread evenly.

    Groups are dealt out in turn within their dominant label, largest first.
    """
    per_label = rows.groupBy(F.col(group).alias("g"), "label").agg(F.count(F.lit(1)).alias("n"))
    lead = F.struct((-F.col("n")).alias("k"), "label")
    groups = per_label.groupBy("g").agg(
        F.sum("n").alias("n"), F.min(lead)["label"].alias("dominant")
    )
    digest = F.md5(F.col("g").cast("string"))
    dealt = split_row_number(
        groups,
        ["dominant"],
        [(F.col("n"), True), F.substring(digest, 1, 3)],
        [digest, F.col("g")],
        "_rn",
    )
    fold = F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")
    folds = dealt.select(F.col("g").alias(group), fold.alias("fold"))
    return rows.join(folds, group)


def out_of_fold(
    rows: DataFrame, mode: str, folds: int = 5, limits: Limits = Limits()
) -> DataFrame:
    """Match of every crop by a model that never saw its fold.

    ``rows(id, label, vec, fold)`` -> id, product, vote, score, margin.
    """
    if mode == "knn":
        return match_knn(rows, rows, exclude="tag", limits=limits)
    # Each reference serves the models of the other folds.
    held_out = F.explode(
        F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    )
    train = rows.select(held_out.alias("model"), "label", "vec")
    if mode == "lda":
        head = fit(train, "model")
        if head is None:
            return match_knn(rows, rows, exclude="tag", limits=limits)
        got = best_and_margin(posteriors(rows, head, "fold", k=2))
        missing = [f for f in range(folds) if f not in head.models]
        if missing:
            rest = match_knn(
                rows.where(F.col("fold").isin(missing)), rows, exclude="tag", limits=limits
            )
            got = got.unionByName(rest)
        return got
    protos = mean_vectors(train, ["model", "label"]).withColumn("vec", unit(F.col("vec")))
    hits = knn_join(
        rows.select(F.col("id").alias("qid"), F.col("fold").alias("tag"), "vec"),
        protos.select(F.col("label").alias("rid"), "label", F.col("model").alias("tag"), "vec"),
        2,
        exclude="other",
        limits=limits,
    )
    return best_and_margin(hits.withColumnRenamed("qid", "id"))


def with_truth(matches: DataFrame, rows: DataFrame) -> DataFrame:
    return matches.join(rows.select("id", F.col("label").alias("truth")), "id")


def open_set_metrics(
    rows: DataFrame, keys: Sequence[str] = (), pred: str = "pred", weight: Column | None = None
) -> DataFrame:
    """Naming and rejection scored apart; a side without rows gives NaN."""
    w = F.lit(1) if weight is None else weight
    p, t = F.col(pred), F.col("truth")
    neg = is_bucket(t)
    rejected = p == LOW_CONFIDENCE
    total = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("long")
    sums = rows.groupBy(*keys).agg(
        total(~neg).alias("n_known"),
        total(neg).alias("n_neg"),
        total(~neg & (p == t)).alias("_hit"),
        total(~neg & rejected).alias("false_rejects"),
        total(neg & (rejected | is_bucket(p))).alias("_ok"),
    )
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(NAN))
    return sums.select(
        *keys,
        "n_known",
        "n_neg",
        part("_hit", "n_known").alias("sku_accuracy"),
        "false_rejects",
        part("_ok", "n_neg").alias("neg_handled"),
        (F.col("n_neg") - F.col("_ok")).alias("false_accepts"),
        ((part("_hit", "n_known") + part("_ok", "n_neg")) / 2).alias("balanced"),
    )


def gated_accuracy(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Plain agreement after gates and how many were rejected: ``rows(pred, truth)``."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy"),
        F.count_if(F.col("pred") == LOW_CONFIDENCE).alias("rejected"),
    )


def classification_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1, support per class, with accuracy, macro and weighted rows."""
    cells = rows.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    by_truth = cells.groupBy(F.col("truth").alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"),
    )
    by_pred = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = by_truth.join(by_pred, "label", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    precision, recall = part(F.col("tp"), F.col("predicted")), part(F.col("tp"), F.col("support"))
    per = both.select(
        F.col("label").alias("class"),
        precision.alias("precision"),
        recall.alias("recall"),
        "support",
        "tp",
    ).withColumn(
        "f1",
        part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
    figures = ("precision", "recall", "f1")
    total = per.agg(
        *[F.avg(c).alias(f"m_{c}") for c in figures],
        *[part(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in figures],
        part(F.sum("tp"), F.sum("support")).alias("acc"),
        F.sum("support").alias("support"),
    )
    line = lambda name, cols: total.select(
        F.lit(name).alias("class"), *[c.alias(n) for n, c in zip(figures, cols)], "support"
    )
    return (
        per.select("class", *figures, "support")
        .unionByName(line("accuracy", [F.col("acc")] * 3))
        .unionByName(line("macro avg", [F.col(f"m_{c}") for c in figures]))
        .unionByName(line("weighted avg", [F.col(f"w_{c}") for c in figures]))
    )


def top_confusions(rows: DataFrame, n: int = 10) -> DataFrame:
    return (
        rows.where(F.col("truth") != F.col("pred"))
        .groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "truth", "pred").limit(n)
    )


def gate_profile(
    rows: DataFrame,
    scores: Sequence[float],
    margins: Sequence[float],
    keys: Sequence[str] = (),
    vote_floor: float = VOTE_FLOOR,
) -> DataFrame:
    """Counts by truth, prediction and how many thresholds of each grid a match passes.

    Sweeps read this small table instead of repeating every row per threshold.
    ``rows(product, vote, score, margin, truth)``.
    """
    grid = lambda g: F.array(*[F.lit(float(v)) for v in g])
    passed = lambda g, c: F.size(F.filter(grid(g), lambda t: ~(F.col(c) < t)))
    margin_passed = F.when(F.col("margin").isNull(), F.lit(len(margins))).otherwise(
        passed(margins, "margin")
    )
    return (
        rows.select(
            *keys,
            "truth",
            F.when(F.col("vote") < vote_floor, F.lit(LOW_CONFIDENCE)).otherwise(F.col("product"))
            .alias("product"),
            passed(scores, "score").alias("s_pass"),
            margin_passed.alias("m_pass"),
        )
        .groupBy(*keys, "truth", "product", "s_pass", "m_pass")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def gate_sweep(
    rows: DataFrame,
    scores: Sequence[float],
    margins: Sequence[float] = (0.0,),
    vote_floor: float = VOTE_FLOOR,
) -> DataFrame:
    """Open-set metrics for every score and margin floor; grids must ascend."""
    profile = gate_profile(rows, scores, margins, vote_floor=vote_floor)
    points = lambda g: F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(g)]
    )
    spread = profile.select("*", F.explode(points(scores)).alias("s")).select(
        "*", F.explode(points(margins)).alias("m")
    )
    pred = F.when(
        (F.col("s.i") < F.col("s_pass")) & (F.col("m.i") < F.col("m_pass")), F.col("product")
    ).otherwise(F.lit(LOW_CONFIDENCE))
    flat = spread.select(
        F.col("s.v").alias("score_floor"), F.col("m.v").alias("margin_floor"), "truth",
        pred.alias("pred"), "n",
    )
    return open_set_metrics(flat, ["score_floor", "margin_floor"], weight=F.col("n"))


def score_sweep(rows: DataFrame, scores: Sequence[float] = SCORE_GRID, **kw) -> DataFrame:
    """One row per score floor; marks each new best balanced value and the overall best."""
    table = gate_sweep(rows, scores, **kw).drop("margin_floor")
    usable = F.when(~F.isnan("balanced"), F.col("balanced"))
    # The grid's few rows are ordered in one window.
    before = Window.orderBy("score_floor").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.max(usable).over(before), F.lit(-1.0))
    marked = table.withColumn("improves", F.coalesce(usable > so_far, F.lit(False)))
    best = marked.where("improves").agg(F.max("score_floor").alias("_best"))
    return marked.join(F.broadcast(best)).select(
        *marked.columns,
        F.coalesce(F.col("score_floor") == F.col("_best"), F.lit(False)).alias("is_best"),
    )


def margin_distribution(rows: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum of the margin."""
    return exact_percentiles(rows, "margin", (0, 25, 50, 75, 100))


def grouped_cv(
    rows: DataFrame,
    modes: Sequence[str] = MODES,
    folds: int = 5,
    score_floors: dict | None = None,
    margin_floors: dict | None = None,
) -> DataFrame:
    """Out-of-fold accuracy before gates and open-set metrics after them, per mode."""
    score_floors = score_floors or SCORE_FLOORS
    margin_floors = MARGIN_FLOORS if margin_floors is None else margin_floors
    parts = None
    for mode in modes:
        got = with_truth(out_of_fold(rows, mode, folds), rows)
        got = apply_gates(
            got, score_floor=score_floors[mode], margin_floor=margin_floors[mode]
        ).select(F.lit(mode).alias("mode"), "product", F.col("gated").alias("pred"), "truth")
        parts = got if parts is None else parts.unionByName(got)
    counts = parts.groupBy("mode", "product", "pred", "truth").agg(F.count(F.lit(1)).alias("n"))
    argmax = counts.groupBy("mode").agg(
        (
            F.sum(F.when(F.col("product") == F.col("truth"), F.col("n")).otherwise(0)).cast("double")
            / F.sum("n")
        ).alias("argmax")
    )
    return argmax.join(open_set_metrics(counts, ["mode"], weight=F.col("n")), "mode")


def mode_comparison(
    matches_by_mode: dict[str, DataFrame], score_floors: dict | None = None
) -> DataFrame:
    """Accuracy and rejections of each mode at its own score floor, without the margin gate.

    The values are matches with ``truth``.
    """
    score_floors = score_floors or SCORE_FLOORS
    parts = None
    for mode, rows in matches_by_mode.items():
        got = apply_gates(rows, score_floor=score_floors[mode]).select(
            F.lit(mode).alias("mode"), F.col("gated").alias("pred"), "truth"
        )
        parts = got if parts is None else parts.unionByName(got)
    return gated_accuracy(parts, ["mode"])


def negative_destinations(rows: DataFrame) -> DataFrame:
    """Where crops of each bucket end: bucket, destination, product, n, share of the bucket.

    ``rows(pred, truth)``; ``product`` is filled for the damaging case, a named product.
    """
    p, t = F.col("pred"), F.col("truth")
    dest = (
        F.when(p == t, F.lit("same bucket"))
        .when(is_bucket(p), F.lit("other bucket"))
        .when(p == LOW_CONFIDENCE, F.lit("rejected"))
        .otherwise(F.lit("named product"))
    )
    cells = (
        rows.where(is_bucket(t))
        .select(t.alias("bucket"), dest.alias("destination"), p.alias("_p"))
        .groupBy(
            "bucket",
            "destination",
            F.when(F.col("destination") == "named product", F.col("_p")).otherwise(F.lit(""))
            .alias("product"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = cells.groupBy("bucket").agg(F.sum("n").alias("_t"))
    return cells.join(whole, "bucket").select(
        "bucket", "destination", "product", "n", (F.col("n") / F.col("_t")).alias("share")
    )


def negatives_named_rate(rows: DataFrame) -> DataFrame:
    """Share of all negatives that were given a product name."""
    p = F.col("pred")
    named = ~is_bucket(p) & (p != LOW_CONFIDENCE)
    return rows.where(is_bucket(F.col("truth"))).agg(
        F.count(F.lit(1)).alias("negatives"),
        F.count_if(named).alias("named"),
        F.coalesce(F.avg(named.cast("double")), F.lit(NAN)).alias("rate"),
    )


def fusion_sweep(
    candidates: DataFrame,
    evidence: DataFrame,
    truths: DataFrame,
    alphas: Sequence[float] = (1.5, 3.0),
    margins: Sequence[float] = (0.35, 1.01),
) -> DataFrame:
    """Accuracy of every fusion setting against the visual ranking alone.

    Candidates and evidence are computed once by the caller. One row per verify, margin, alpha.
    """
    base = candidates.where(F.col("rank") == 1).select("id", F.col("label").alias("base"))
    rows = base.join(truths.select("id", "truth"), "id")
    for a in alphas:
        fused = ev.fuse(candidates, evidence, flavour_weight=a)
        top = fused.where(F.col("rank") == 1).select("id", F.col("label").alias(f"fused_{a}"))
        rows = rows.join(top, "id")
    for verify in (False, True):
        for m in margins:
            c = ev.should_consult(candidates, m, verify).withColumnRenamed(
                "consult", f"c_{verify}_{m}"
            )
            rows = rows.join(c, "id")
    right = lambda c: F.avg((c == F.col("truth")).cast("double"))
    settings = [(v, m, a) for v in (False, True) for m in margins for a in alphas]
    aggs = [right(F.col("base")).alias("base_accuracy")]
    for i, (v, m, a) in enumerate(settings):
        use = F.col(f"`c_{v}_{m}`")
        pred = F.when(use, F.col(f"`fused_{a}`")).otherwise(F.col("base"))
        aggs += [F.count_if(use).alias(f"n{i}"), right(pred).alias(f"a{i}")]
    wide = rows.agg(*aggs)
    lines = F.array(
        *[
            F.struct(
                F.lit(v).alias("verify"),
                F.lit(float(m)).alias("margin"),
                F.lit(float(a)).alias("alpha"),
                F.col(f"n{i}").alias("consulted"),
                F.col(f"a{i}").alias("accuracy"),
                (F.col(f"a{i}") - F.col("base_accuracy")).alias("delta"),
            )
            for i, (v, m, a) in enumerate(settings)
        ]
    )
    return wide.select("base_accuracy", F.explode(lines).alias("s")).select("base_accuracy", "s.*")


