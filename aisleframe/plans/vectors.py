"""Matching, evaluation and clustering queries over the vector table.

Every vector is matched against all the others, so both sides are the whole table. The vectors are
unrelated to their labels, so the score floor is 0.35 instead of the product default, which would
reject everything.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import norm, unit
from ..model import LOW_CONFIDENCE, MARGIN_GRID, SCORE_GRID
from ..operators import clustering as cl
from ..operators import discriminant as lda
from ..operators import evaluation as ev
from ..operators import evidence as fx
from ..operators import matching as mt
from ..operators import recognition as rc
from ..sources import bindings as b
from ..sources.bindings import CROPS_SQL
from .market import r6
from .registry import query

FLOOR = 0.35
FLOORS = {"knn": FLOOR, "prototype": FLOOR, "lda": FLOOR}
EPS = 0.60
EPS_GRID = (0.45, 0.50, 0.55, 0.60)

SIMS_SQL = """sims AS (SELECT a.id AS qid, z.id AS rid, z.label, list_cosine_similarity(a.vec, z.vec) AS sim
  FROM {left} a JOIN {right} z ON {on})"""
VOTE_SQL = """hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 10) DESC, rid) AS rank
  FROM sims QUALIFY rank <= 5),
votes AS (SELECT qid, label, sum(exp((sim - best) / 0.05)) AS w, min(rank) AS f, max(best) AS score
  FROM (SELECT *, max(sim) OVER (PARTITION BY qid) AS best FROM hits) GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER o AS rn, sum(w) OVER (PARTITION BY qid) AS total, lead(w) OVER o AS w2
  FROM votes WINDOW o AS (PARTITION BY qid ORDER BY round(w, 12) DESC, f)),
knn AS (SELECT qid AS id, label AS product, w / total AS vote, score, (w - coalesce(w2, 0)) / total AS margin
  FROM placed WHERE rn = 1)"""
PROTO_SQL = """protos AS (SELECT {key} label, list(x ORDER BY pos) AS vec FROM (
    SELECT {key} label, pos, avg(vec[pos]) AS x FROM {src}, range(1, 65) t(pos) GROUP BY ALL) GROUP BY ALL)"""
RANK_SQL = """ranking AS (SELECT c.id, p.label, list_cosine_similarity(c.vec, p.vec) AS score,
    row_number() OVER (PARTITION BY c.id ORDER BY round(list_cosine_similarity(c.vec, p.vec), 10) DESC, p.label)::BIGINT AS rank
  FROM {rows} c JOIN protos p ON {on})"""
BEST_SQL = """proto AS (SELECT id, max(label) FILTER (rank = 1) AS product, 1.0::DOUBLE AS vote,
    max(score) FILTER (rank = 1) AS score,
    coalesce(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 1.0) AS margin FROM ranking GROUP BY 1)"""
FOLD_SQL = """gl AS (SELECT photo, label, count(*) AS n FROM crops GROUP BY ALL),
gr AS (SELECT photo, sum(n) AS n, arg_min(label, (-n, label)) AS dominant FROM gl GROUP BY 1),
folds AS (SELECT photo, ((row_number() OVER (PARTITION BY dominant ORDER BY n DESC, md5(photo::VARCHAR)) - 1) % 5)::INTEGER AS fold
  FROM gr), rows AS (SELECT crops.*, fold FROM crops JOIN folds USING (photo))"""
LOO_KNN = f"{CROPS_SQL}, {SIMS_SQL.format(left='crops', right='crops', on='a.id <> z.id')}, {VOTE_SQL}"
PROTO = (
    f"{CROPS_SQL}, {PROTO_SQL.format(key='', src='crops')}, {RANK_SQL.format(rows='crops', on='true')}, {BEST_SQL}"
)
CV_KNN = f"{CROPS_SQL}, {FOLD_SQL}, {SIMS_SQL.format(left='rows', right='rows', on='a.fold <> z.fold')}, {VOTE_SQL}"
TRAIN_SQL = "train AS (SELECT m.m AS model, label, vec FROM rows JOIN range(5) m(m) ON m.m <> fold)"
CV_PROTO = (
    f"{TRAIN_SQL}, {PROTO_SQL.format(key='model,', src='train')}, "
    f"{RANK_SQL.format(rows='rows', on='p.model = c.fold')}, {BEST_SQL}"
)
# The discriminant head in sums: moments, Ledoit-Wolf shrinkage per class, the pooled covariance, and
# its system solved by one elimination step per coordinate.
LDA_SQL = """lda_x AS (SELECT model, label, row_number() OVER () AS r, vec FROM train),
lda_n AS (SELECT model, label, count(*) AS n FROM lda_x GROUP BY ALL HAVING count(*) > 1),
lda_e AS (SELECT x.model, x.label, r, pos, vec[pos] AS v FROM lda_x x JOIN lda_n USING (model, label), range(1, 65) t(pos)),
lda_m AS (SELECT model, label, pos, avg(v) AS m, var_pop(v) AS var FROM lda_e GROUP BY ALL),
lda_s AS (SELECT *, CASE WHEN var <= 2.3e-15 * greatest(m * m, 1e-300) THEN 1 ELSE sqrt(var) END AS s FROM lda_m),
lda_z AS (SELECT model, label, r, list((v - m) / s ORDER BY pos) AS z, sum(pow((v - m) / s, 2)) AS sq
          FROM lda_e JOIN lda_s USING (model, label, pos) GROUP BY ALL),
lda_q AS (SELECT model, label, count(*) AS n, sum(sq * sq) AS quartic FROM lda_z GROUP BY ALL),
lda_c AS (SELECT model, label, i, j, avg(z[i] * z[j]) AS c FROM lda_z, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL),
lda_t AS (SELECT model, label, sum(c) FILTER (i = j) AS tr, sum(c * c) AS d FROM lda_c GROUP BY ALL),
lda_w AS (SELECT model, label, tr / 64 AS mu, (quartic / n - d) / (64 * n) AS beta,
                 (d - 2 * tr * tr / 64 + tr * tr / 64) / 64 AS delta FROM lda_t JOIN lda_q USING (model, label)),
lda_k AS (SELECT model, label, mu, CASE WHEN least(beta, delta) = 0 THEN 0 ELSE least(beta, delta) / delta END AS share FROM lda_w),
lda_p AS (SELECT c.model, i, j, avg(((1 - share) * c + CASE WHEN i = j THEN share * mu ELSE 0 END) * si.s * sj.s) AS v
          FROM lda_c c JOIN lda_k USING (model, label)
          JOIN lda_s si ON si.model = c.model AND si.label = c.label AND si.pos = i
          JOIN lda_s sj ON sj.model = c.model AND sj.label = c.label AND sj.pos = j GROUP BY ALL),
lda_a AS (SELECT model, i, list(v ORDER BY j) AS left_side FROM lda_p GROUP BY ALL),
lda_b AS (SELECT model, pos AS i, list(m ORDER BY label) AS right_side FROM lda_s GROUP BY ALL),
lda_g AS (SELECT model, list(list_concat(left_side, right_side) ORDER BY i) AS mat FROM lda_a JOIN lda_b USING (model, i) GROUP BY ALL),
lda_r AS (
  SELECT model, 1 AS k, mat FROM lda_g
  UNION ALL
  SELECT model, k + 1, list_transform(mat, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / mat[k][k])
      ELSE list_transform(list_zip(row, mat[k]), lambda z: z[1] - row[k] / mat[k][k] * z[2]) END)
  FROM lda_r WHERE k <= 64),
lda_l AS (SELECT model, label, row_number() OVER (PARTITION BY model ORDER BY label) AS c, count(*) OVER (PARTITION BY model) AS classes
          FROM lda_n),
lda_h AS (SELECT l.model, l.label, list(mat[pos][64 + c] ORDER BY pos) AS coef,
                 -0.5 * sum(mat[pos][64 + c] * m) + ln(1.0 / any_value(classes)) AS bias
          FROM lda_l l JOIN lda_r g ON g.model = l.model AND k = 65 JOIN lda_s s ON s.model = l.model AND s.label = l.label
          GROUP BY l.model, l.label)"""
POSTERIOR_SQL = """ranking AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, label)::BIGINT AS rank
  FROM (SELECT id, label, exp(y - max(y) OVER w) / sum(exp(y - top)) OVER w AS score
        FROM (SELECT *, max(y) OVER (PARTITION BY id) AS top FROM (
          SELECT c.id, h.label, (list_inner_product(c.vec, h.coef) + h.bias) / 30 AS y FROM {rows} c JOIN lda_h h ON {on}))
        WINDOW w AS (PARTITION BY id)))"""
LDA_ALL = f"{CROPS_SQL}, train AS (SELECT 0 AS model, label, vec FROM crops), {LDA_SQL}"
LDA_RANKED = f"{LDA_ALL}, {POSTERIOR_SQL.format(rows='crops', on='true')}, {BEST_SQL}"
CV_LDA = f"{CROPS_SQL}, {FOLD_SQL}, {TRAIN_SQL}, {LDA_SQL}, {POSTERIOR_SQL.format(rows='rows', on='h.model = c.fold')}, {BEST_SQL}"
GATE_SQL = "CASE WHEN score < {s} {m} OR vote < 0.4 THEN 'low_confidence' ELSE product END"
NEG = "(truth = 'unknown_beverage' OR starts_with(truth, 'non_beverage'))"
PBUCKET = "(pred = 'unknown_beverage' OR starts_with(pred, 'non_beverage'))"


def metrics_sql(src: str, keys: str = "") -> str:
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {by}nk AS n_known, nn AS n_neg, round(hit / nk::DOUBLE, 6) AS sku_accuracy, fr AS false_rejects,
       round(ok / nn::DOUBLE, 6) AS neg_handled, nn - ok AS false_accepts,
       round((hit / nk::DOUBLE + ok / nn::DOUBLE) / 2, 6) AS balanced
FROM (SELECT {by}count(*) FILTER (NOT {NEG})::BIGINT AS nk, count(*) FILTER ({NEG})::BIGINT AS nn,
             count(*) FILTER (NOT {NEG} AND pred = truth)::BIGINT AS hit,
             count(*) FILTER (NOT {NEG} AND pred = 'low_confidence')::BIGINT AS fr,
             count(*) FILTER ({NEG} AND (pred = 'low_confidence' OR {PBUCKET}))::BIGINT AS ok FROM {src} {group})"""


METRICS = ("sku_accuracy", "neg_handled", "balanced")
COUNTS = ("n_known", "n_neg", "false_rejects", "false_accepts")


def _metrics(df, *keys):
    return df.select(*keys, *COUNTS, *r6(*METRICS))


def _loo(spark, d):
    rows = b.crops(spark, d)
    return mt.match_knn(rows.select("id", "vec"), rows, exclude="self")


def _loo_gated(spark, d):
    got = ev.with_truth(_loo(spark, d), b.crops(spark, d))
    return mt.apply_gates(got, score_floor=FLOOR).withColumn("pred", F.col("gated"))


def _folds(spark, d):
    return ev.assign_folds(b.crops(spark, d))


@query("vec01_unit_vectors", f"""
WITH {CROPS_SQL}, n AS (SELECT id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS n FROM crops)
SELECT id, round(n, 6) AS length, round(vec[1] / n, 6) AS head, round(vec[-1] / n, 6) AS tail,
       round(list_sum(list_transform(vec, lambda x: x / n)), 6) AS total FROM n""")
def vec01(spark, d):
    u = b.crops(spark, d).select("id", norm(F.col("vec")).alias("length"), unit(F.col("vec")).alias("u"))
    return u.select(
        "id", *r6("length"), F.round(F.element_at("u", 1), 6).alias("head"),
        F.round(F.element_at("u", -1), 6).alias("tail"),
        F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query("vec02_view_average", f"""
WITH {CROPS_SQL}, m AS (SELECT photo AS id, pos, avg(vec[pos]) AS x FROM crops, range(1, 65) t(pos) GROUP BY ALL),
n AS (SELECT id, list(x ORDER BY pos) AS v, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT id, round(v[1] / n, 6) AS head, round(v[64] / n, 6) AS tail FROM n""")
def vec02(spark, d):
    views = b.crops(spark, d).select(F.col("photo").alias("id"), "vec")
    return mt.view_average(views).select(
        "id", F.round(F.element_at("vec", 1), 6).alias("head"),
        F.round(F.element_at("vec", -1), 6).alias("tail"),
    )


@query("vec03_prototypes", f"""
WITH {CROPS_SQL}, m AS (SELECT label, pos, avg(vec[pos]) AS x FROM crops, range(1, 65) t(pos) GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT label, pos::INTEGER AS pos, round(x / n, 6) AS x FROM m JOIN n USING (label)""")
def vec03(spark, d):
    protos = mt.prototypes(b.crops(spark, d))
    return protos.select("label", F.posexplode("vec").alias("pos", "x")).select(
        "label", (F.col("pos") + 1).alias("pos"), *r6("x")
    )


@query("vec04_neighbours", f"""
WITH {LOO_KNN} SELECT qid, rid, label, round(sim, 6) AS score, rank::BIGINT AS rank FROM hits""")
def vec04(spark, d):
    rows = b.crops(spark, d)
    return mt.neighbours(rows.select("id", "vec"), rows, exclude="self").select(
        "qid", "rid", "label", *r6("score"), "rank"
    )


MATCH = ("vote", "score", "margin")


@query("vec05_knn_vote", f"""
WITH {LOO_KNN} SELECT id, product, round(vote, 6) AS vote, round(score, 6) AS score, round(margin, 6) AS margin FROM knn""")
def vec05(spark, d):
    return _loo(spark, d).select("id", "product", *r6(*MATCH))


@query("vec06_prototype_match", f"""
WITH {PROTO} SELECT id, product, vote, round(score, 6) AS score, round(margin, 6) AS margin FROM proto""")
def vec06(spark, d):
    rows = b.crops(spark, d)
    return mt.match_prototype(rows.select("id", "vec"), rows).select("id", "product", *r6(*MATCH))


@query("vec07_discriminant_head", f"""WITH RECURSIVE {LDA_ALL}
SELECT label, round(sqrt(list_inner_product(coef, coef)), 6) AS norm, round(bias, 6) AS bias FROM lda_h""")
def vec07(spark, d):
    """Coefficient norm and bias per class of the fitted head."""
    head = lda.fit(b.crops(spark, d))
    labels, coef, bias = head.models[0]
    rows = [(l, float((c**2).sum() ** 0.5), float(x)) for l, c, x in zip(labels, coef, bias)]
    return spark.createDataFrame(rows, "label string, norm double, bias double").select(
        "label", *r6("norm", "bias")
    )


@query("vec08_discriminant_match", f"""WITH RECURSIVE {LDA_RANKED}
SELECT id, product, vote, round(score, 6) AS score, round(margin, 6) AS margin FROM proto""")
def vec08(spark, d):
    rows = b.crops(spark, d)
    return mt.match(rows.select("id", "vec"), rows, "lda").select("id", "product", *r6(*MATCH))


@query("vec09_top_matches", f"""
WITH {PROTO} SELECT id, label, round(score, 6) AS score, rank FROM ranking WHERE rank <= 5""")
def vec09(spark, d):
    rows = b.crops(spark, d)
    return mt.top_matches(rows.select("id", "vec"), rows, 5, "knn").select(
        "id", "label", *r6("score"), "rank"
    )


@query("vec09_top_matches_lda", f"""WITH RECURSIVE {LDA_RANKED}
SELECT id, label, round(score, 6) AS score, rank FROM ranking""")
def vec09_lda(spark, d):
    """Every class by posterior, with a head fitted on the references."""
    rows = b.crops(spark, d)
    return mt.top_matches(rows.select("id", "vec"), rows, None).select(
        "id", "label", *r6("score"), "rank"
    )


@query("vec10_classify", f"""
WITH {LOO_KNN} SELECT id, product, round(vote, 6) AS vote, round(score, 6) AS score FROM knn""")
def vec10(spark, d):
    return mt.classify(_loo(spark, d)).select("id", "product", *r6("vote", "score"))


@query("vec11_mode_gates", f"""
WITH {LOO_KNN}, g(mode, score_floor, margin_floor) AS (VALUES ('lda', 0.30, 0.05), ('knn', 0.60, NULL), ('prototype', 0.60, NULL))
SELECT mode, count(*) FILTER (score < score_floor OR coalesce(margin < margin_floor, false) OR vote < 0.4)::BIGINT AS rejected,
       count(*)::BIGINT AS n FROM knn, g GROUP BY 1""")
def vec11(spark, d):
    gates = mt.mode_gates(spark)
    # Three rows of defaults.
    rows = _loo(spark, d).join(F.broadcast(gates))
    g = mt.gated(
        F.col("product"), F.col("vote"), F.col("score"), F.col("margin"),
        score_floor=F.col("score_floor"), margin_floor=F.col("margin_floor"),
        vote_floor=F.col("vote_floor"),
    )
    return rows.groupBy("mode").agg(
        F.count_if(g == LOW_CONFIDENCE).alias("rejected"), F.count(F.lit(1)).alias("n")
    )


@query("vec12_gated", f"""
WITH {LOO_KNN} SELECT id, {GATE_SQL.format(s=FLOOR, m='OR margin < 0.05')} AS gated FROM knn""")
def vec12(spark, d):
    return mt.apply_gates(_loo(spark, d), score_floor=FLOOR, margin_floor=0.05).select("id", "gated")


@query("fn02_softmax", f"""
WITH {PROTO}, e AS (SELECT id, label, exp((score - max(score) OVER (PARTITION BY id)) / 0.05) AS w FROM ranking)
SELECT id, label, round(w / sum(w) OVER (PARTITION BY id), 6) AS p FROM e""")
def fn02(spark, d):
    from pyspark.sql import Window

    from ..functions.vectors import softmax_weight

    rows = b.crops(spark, d)
    protos = mt.prototypes(rows)
    ranked = mt.class_ranking(rows.select("id", "vec"), protos)
    # One row per class and crop.
    w = Window.partitionBy("id")
    weighed = ranked.withColumn("w", softmax_weight(F.col("score"), F.max("score").over(w), 0.05))
    return weighed.select("id", "label", F.round(F.col("w") / F.sum("w").over(w), 6).alias("p"))


@query("evd10_candidate_labels", f"""
WITH {CROPS_SQL} SELECT DISTINCT label FROM crops WHERE label <> 'unknown_beverage' AND NOT starts_with(label, 'non_beverage')""")
def evd10(spark, d):
    return mt.candidate_labels(b.crops(spark, d))


# Evidence planted by rule on the vector ids, as a reader would have left it.
EVIDENCE_SQL = """evidence AS (SELECT id, 'flavour' || (id % 8) AS flavour, 0.5::DOUBLE + (id % 6) / 10.0::DOUBLE AS flavour_score,
    'brand' || (id % 4) AS brand, 0.45::DOUBLE + (id % 11) / 20.0::DOUBLE AS brand_score, 0.3::DOUBLE AS brand_runner_up
  FROM crops)"""
FUSE_SQL = """parsed AS (SELECT r.*, CASE WHEN starts_with(r.label, 'brand') THEN split_part(r.label, '_', 1) END AS pb,
    CASE WHEN starts_with(r.label, 'brand') THEN split(r.label, '_')[-1] END AS pf, e.* EXCLUDE (id),
    round(flavour_score, 6) >= 0.6 AS uf,
    round(brand_score, 6) >= 0.6 AND round(brand_score - brand_runner_up, 6) >= 0.15 AS ub
  FROM ranking r JOIN evidence e USING (id)),
weighed AS (SELECT *, score * CASE WHEN uf AND pf = flavour THEN exp({alpha} * flavour_score) ELSE 1 END
    * CASE WHEN ub AND pb IS NOT NULL AND pb <> brand THEN 1e-6
           WHEN ub AND label = 'unknown_beverage' AND NOT coalesce(bool_or(pb = brand) OVER (PARTITION BY id), false)
           THEN exp(3.0 * brand_score) ELSE 1 END AS w FROM parsed),
normed AS (SELECT *, CASE WHEN uf OR ub THEN w / sum(w) OVER (PARTITION BY id) ELSE score END AS s FROM weighed),
fused AS (SELECT id, label, rank AS old_rank, s,
    row_number() OVER (PARTITION BY id ORDER BY CASE WHEN uf OR ub THEN -round(s, 12) ELSE 0 END, rank)::BIGINT AS rank
  FROM normed)"""
# Cosines can be negative; shifted by one they can be weighed like probabilities.
SHIFT_SQL = "ranking AS (SELECT id, label, (score + 1) / 2 AS score, rank FROM ranking0)"
FUSION = (
    f"{CROPS_SQL}, {PROTO_SQL.format(key='', src='crops')}, "
    + RANK_SQL.format(rows="crops", on="true").replace("ranking AS", "ranking0 AS", 1)
    + f", {SHIFT_SQL}, {EVIDENCE_SQL}"
)


def _candidates(spark, d):
    rows = b.crops(spark, d)
    ranked = mt.class_ranking(rows.select("id", "vec"), mt.prototypes(rows))
    return ranked.withColumn("score", (F.col("score") + 1) / 2)


def _evidence(spark, d):
    i = F.col("id")
    text = lambda p, n: F.concat(F.lit(p), (i % n).cast("string"))
    return b.crops(spark, d).select(
        "id",
        text("flavour", 8).alias("flavour"),
        F.round(F.lit(0.5) + (i % 6) / 10, 6).alias("flavour_score"),
        text("brand", 4).alias("brand"),
        F.round(F.lit(0.45) + (i % 11) / 20, 6).alias("brand_score"),
        F.lit(0.3).alias("brand_runner_up"),
    )


@query("evd06_should_consult", f"""
WITH {FUSION}, t AS (SELECT id, max(label) FILTER (rank = 1) AS top, max(score) FILTER (rank = 1) AS s1,
                            max(score) FILTER (rank = 2) AS s2 FROM ranking GROUP BY 1)
SELECT id, starts_with(top, 'brand') OR s1 - s2 < 0.05 AS verified, s1 - s2 < 0.05 AS close FROM t""")
def evd06(spark, d):
    c = _candidates(spark, d)
    a = fx.should_consult(c, 0.05, True).withColumnRenamed("consult", "verified")
    return a.join(fx.should_consult(c, 0.05, False).withColumnRenamed("consult", "close"), "id")


@query("evd07_fused_ranking", f"""
WITH {FUSION}, {FUSE_SQL.format(alpha=1.5)} SELECT id, label, round(s, 6) AS score, rank FROM fused""")
def evd07(spark, d):
    return fx.fuse(_candidates(spark, d), _evidence(spark, d)).select("id", "label", *r6("score"), "rank")


@query("evd08_fused_decision", f"""
WITH {FUSION}, {FUSE_SQL.format(alpha=1.5)},
t AS (SELECT id, max(label) FILTER (rank = 1) AS product, max(s) FILTER (rank = 1) AS score,
             max(s) FILTER (rank = 1) - max(s) FILTER (rank = 2) AS margin, max(label) FILTER (old_rank = 1) AS old
      FROM fused GROUP BY 1)
SELECT id, CASE WHEN score < 0.3 OR margin < 0.05 THEN 'low_confidence' ELSE product END AS product,
       round(score, 6) AS score, round(margin, 6) AS margin, CASE WHEN product <> old THEN 'ocr' ELSE 'local' END AS source
FROM t""")
def evd08(spark, d):
    c = _candidates(spark, d)
    fused = fx.fuse(c, _evidence(spark, d))
    out = fx.fused_decision(mt.best_and_margin(c), c, fused)
    return mt.apply_gates(out, score_floor=0.30, margin_floor=0.05).select(
        "id", F.col("gated").alias("product"), *r6("score", "margin"), "source"
    )


@query("evd09_second_opinion", f"""
WITH {LOO_KNN}, g AS (SELECT id, {GATE_SQL.format(s=FLOOR, m='')} AS product, score FROM knn),
v AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'unlisted' ELSE label END AS label, 0.5::DOUBLE + (id % 5) / 10.0 AS confidence FROM crops),
ok AS (SELECT v.* FROM v WHERE label IN (SELECT label FROM crops) AND label <> 'unknown_beverage'
       AND NOT starts_with(label, 'non_beverage'))
SELECT g.id, CASE WHEN g.product = 'low_confidence' AND ok.id IS NOT NULL THEN ok.label ELSE g.product END AS product,
       round(CASE WHEN g.product = 'low_confidence' AND ok.id IS NOT NULL THEN ok.confidence ELSE g.score END, 6) AS score,
       CASE WHEN g.product = 'low_confidence' AND ok.id IS NOT NULL THEN 'llm' ELSE 'local' END AS source
FROM g LEFT JOIN ok USING (id)""")
def evd09(spark, d):
    rows = b.crops(spark, d)
    gated = _loo_gated(spark, d).select("id", F.col("pred").alias("product"), "score", F.lit("local").alias("source"))
    verdicts = rows.select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("unlisted")).otherwise(F.col("label")).alias("label"),
        (F.lit(0.5) + (F.col("id") % 5) / 10).alias("confidence"),
    )
    out = fx.second_opinion(gated, verdicts, mt.candidate_labels(rows))
    return out.select("id", "product", *r6("score"), "source")


# Areas by rule on the vector ids.
RECOGNISED_SQL = f"""{FUSION}, top2 AS (SELECT id, max(label) FILTER (rank = 1) AS product, max(score) FILTER (rank = 1) AS s1,
    max(score) FILTER (rank = 2) AS s2 FROM ranking GROUP BY 1),
consulted AS (SELECT id FROM top2 WHERE starts_with(product, 'brand') OR s1 - s2 < 0.05),
{FUSE_SQL.format(alpha=1.5)},
t AS (SELECT k.id, coalesce(max(f.label) FILTER (f.rank = 1), any_value(k.product)) AS product,
        coalesce(max(f.s) FILTER (f.rank = 1), any_value(s1)) AS score,
        coalesce(max(f.s) FILTER (f.rank = 1) - max(f.s) FILTER (f.rank = 2), any_value(s1 - s2)) AS margin,
        coalesce(max(f.label) FILTER (f.rank = 1) <> max(f.label) FILTER (f.old_rank = 1), false) AS changed
      FROM top2 k LEFT JOIN (SELECT * FROM fused WHERE id IN (FROM consulted)) f ON f.id = k.id GROUP BY k.id),
g AS (SELECT id, CASE WHEN score < 0.3 OR margin < 0.05 THEN 'low_confidence' ELSE product END AS product, score,
             CASE WHEN changed THEN 'ocr' ELSE 'local' END AS source FROM t),
ok AS (SELECT id, label, 0.5::DOUBLE + (id % 5) / 10.0 AS confidence FROM crops
       WHERE id % 3 <> 0 AND label <> 'unknown_beverage' AND NOT starts_with(label, 'non_beverage')),
recognised AS (SELECT g.id, CASE WHEN product = 'low_confidence' AND ok.id IS NOT NULL THEN ok.label ELSE product END AS product,
       CASE WHEN product = 'low_confidence' AND ok.id IS NOT NULL THEN ok.confidence ELSE score END AS score,
       CASE WHEN product = 'low_confidence' AND ok.id IS NOT NULL THEN 'llm' ELSE source END AS source
     FROM g LEFT JOIN ok USING (id))"""


def _recognised(spark, d):
    rows = b.crops(spark, d)
    verdicts = rows.select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("unlisted")).otherwise(F.col("label")).alias("label"),
        (F.lit(0.5) + (F.col("id") % 5) / 10).alias("confidence"),
    )
    return rc.recognise(
        rows.select("id", "vec"), rows, _evidence(spark, d), verdicts, "prototype",
        consult_margin=0.05, score_floor=0.30, margin_floor=0.05, ranking=_candidates(spark, d),
    )


@query("flow01_recognised_crops", f"""
WITH {RECOGNISED_SQL} SELECT id, product, round(score, 6) AS score, source FROM recognised""")
def flow01(spark, d):
    """Ranking, label reads, fusion, gates and second opinion as one job."""
    return _recognised(spark, d).select("id", "product", *r6("score"), "source")


@query("flow02_shelf_shares", f"""
WITH {RECOGNISED_SQL}, f AS (SELECT photo, product, count(*) AS facings, sum((1 + id % 13)::DOUBLE) AS area
  FROM recognised JOIN crops USING (id) WHERE product <> 'low_confidence' AND NOT starts_with(product, 'non_beverage') GROUP BY ALL)
SELECT photo, product, facings::BIGINT AS facings, area, round(facings / sum(facings) OVER w::DOUBLE, 6) AS share_by_facings,
       round(area / sum(area) OVER w, 6) AS share_by_space FROM f WINDOW w AS (PARTITION BY photo)""")
def flow02(spark, d):
    """The shares of every photo from its recognised crops."""
    located = b.crops(spark, d).select("id", "photo", (1 + F.col("id") % 13).cast("double").alias("area"))
    return rc.shelf_shares(_recognised(spark, d), located).select(
        "photo", "product", "facings", "area", *r6("share_by_facings", "share_by_space")
    )


def fusion_sweep_sql() -> str:
    alphas = {1.5: "a", 3.0: "b"}
    ctes = []
    for a, tag in alphas.items():
        text = FUSE_SQL.format(alpha=a)
        for n in ("parsed", "weighed", "normed", "fused"):
            text = text.replace(f"{n} AS (", f"{n}_{tag} AS (").replace(f"FROM {n}", f"FROM {n}_{tag}")
        ctes.append(text)
    top = """top AS (SELECT c.id, c.label AS truth, r.label AS base, s1 - s2 AS gap, fa.label AS l15, fb.label AS l30
  FROM crops c JOIN ranking r ON r.id = c.id AND r.rank = 1 JOIN (SELECT id, max(score) FILTER (rank = 1) AS s1,
       max(score) FILTER (rank = 2) AS s2 FROM ranking GROUP BY 1) g ON g.id = c.id
  JOIN fused_a fa ON fa.id = c.id AND fa.rank = 1 JOIN fused_b fb ON fb.id = c.id AND fb.rank = 1)"""
    return f"""
WITH {FUSION}, {', '.join(ctes)}, {top},
cfg AS (SELECT * FROM (VALUES (false), (true)) v(verify), (VALUES (0.01::DOUBLE), (1.01::DOUBLE)) m(margin), (VALUES (1.5::DOUBLE), (3.0::DOUBLE)) a(alpha)),
p AS (SELECT verify, margin, alpha, truth, base, gap < margin OR (verify AND starts_with(base, 'brand')) AS consult,
             CASE WHEN alpha = 1.5 THEN l15 ELSE l30 END AS alt FROM top, cfg)
SELECT verify, margin, alpha, count(*) FILTER (consult)::BIGINT AS consulted,
       round(avg((CASE WHEN consult THEN alt ELSE base END = truth)::INTEGER), 6) AS accuracy,
       round(avg((CASE WHEN consult THEN alt ELSE base END = truth)::INTEGER) - avg((base = truth)::INTEGER), 6) AS delta,
       round(avg((base = truth)::INTEGER), 6) AS base_accuracy
FROM p GROUP BY ALL"""


@query("eva14_fusion_sweep", fusion_sweep_sql())
def eva14(spark, d):
    truths = b.crops(spark, d).select("id", F.col("label").alias("truth"))
    out = ev.fusion_sweep(_candidates(spark, d), _evidence(spark, d), truths, margins=(0.01, 1.01))
    return out.select("verify", "margin", "alpha", "consulted", *r6("accuracy", "delta", "base_accuracy"))


@query("eva03_folds", f"WITH {CROPS_SQL}, {FOLD_SQL} SELECT id, photo, label, fold FROM rows")
def eva03(spark, d):
    return _folds(spark, d).select("id", "photo", "label", "fold")


@query("eva04_out_of_fold_knn", f"""
WITH {CV_KNN} SELECT id, product, round(vote, 6) AS vote, round(score, 6) AS score, round(margin, 6) AS margin FROM knn""")
def eva04_knn(spark, d):
    return ev.out_of_fold(_folds(spark, d), "knn").select("id", "product", *r6(*MATCH))


@query("eva04_out_of_fold_prototype", f"""
WITH {CROPS_SQL}, {FOLD_SQL}, {CV_PROTO}
SELECT id, product, vote, round(score, 6) AS score, round(margin, 6) AS margin FROM proto""")
def eva04_proto(spark, d):
    return ev.out_of_fold(_folds(spark, d), "prototype").select("id", "product", *r6(*MATCH))


@query("eva04_out_of_fold_lda", f"""WITH RECURSIVE {CV_LDA}
SELECT id, product, vote, round(score, 6) AS score, round(margin, 6) AS margin FROM proto""")
def eva04_lda(spark, d):
    return ev.out_of_fold(_folds(spark, d), "lda").select("id", "product", *r6(*MATCH))


CV_BOTH = f"""{CV_KNN}, {CV_PROTO},
both_modes AS (SELECT 'knn' AS mode, k.*, label AS truth FROM knn k JOIN crops USING (id)
  UNION ALL SELECT 'prototype', k.*, label FROM proto k JOIN crops USING (id)),
pr AS (SELECT mode, product, {GATE_SQL.format(s=FLOOR, m='')} AS pred, truth FROM both_modes)"""


@query("eva05_grouped_cv", f"""
WITH {CV_BOTH}, m AS ({metrics_sql('pr', 'mode')})
SELECT m.*, round(argmax, 6) AS argmax
FROM m JOIN (SELECT mode, avg((product = truth)::INTEGER) AS argmax FROM pr GROUP BY 1) USING (mode)""")
def eva05(spark, d):
    out = ev.grouped_cv(_folds(spark, d), ("knn", "prototype"), score_floors=FLOORS)
    return out.select("mode", *r6("argmax"), *COUNTS, *r6(*METRICS))


@query("eva05_grouped_cv_lda", f"""WITH RECURSIVE {CV_LDA},
pr AS (SELECT 'lda' AS mode, product, {GATE_SQL.format(s=0.30, m='OR margin < 0.05')} AS pred, label AS truth
       FROM proto JOIN crops USING (id)), m AS ({metrics_sql('pr', 'mode')})
SELECT m.*, round(argmax, 6) AS argmax
FROM m JOIN (SELECT mode, avg((product = truth)::INTEGER) AS argmax FROM pr GROUP BY 1) USING (mode)""")
def eva05_lda(spark, d):
    out = ev.grouped_cv(_folds(spark, d), ("lda",))
    return out.select("mode", *r6("argmax"), *COUNTS, *r6(*METRICS))


GATED = f"{LOO_KNN}, pr AS (SELECT k.id, product, {GATE_SQL.format(s=FLOOR, m='')} AS pred, label AS truth, vote, score, margin FROM knn k JOIN crops USING (id))"


@query("eva06_gated_accuracy", f"""
WITH {GATED} SELECT count(*)::BIGINT AS n, round(avg((pred = truth)::INTEGER), 6) AS accuracy,
       count(*) FILTER (pred = 'low_confidence')::BIGINT AS rejected FROM pr""")
def eva06(spark, d):
    return ev.gated_accuracy(_loo_gated(spark, d)).select("n", *r6("accuracy"), "rejected")


@query("eva07_classification_report", f"""
WITH {GATED}, l AS (SELECT truth AS c FROM pr UNION SELECT pred FROM pr),
x AS (SELECT c, (SELECT count(*) FROM pr WHERE truth = c) AS sup, (SELECT count(*) FROM pr WHERE pred = c) AS prd,
             (SELECT count(*) FROM pr WHERE pred = c AND truth = c) AS tp FROM l),
y AS (SELECT c, sup, tp, CASE WHEN prd > 0 THEN tp / prd::DOUBLE ELSE 0 END AS p,
             CASE WHEN sup > 0 THEN tp / sup::DOUBLE ELSE 0 END AS r FROM x),
z AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM y)
SELECT c AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, sup::BIGINT AS support FROM z
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(sup)::DOUBLE, 6), round(sum(tp) / sum(sup)::DOUBLE, 6),
                 round(sum(tp) / sum(sup)::DOUBLE, 6), sum(sup)::BIGINT FROM z
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(sup)::BIGINT FROM z
UNION ALL SELECT 'weighted avg', round(sum(p * sup) / sum(sup), 6), round(sum(r * sup) / sum(sup), 6),
                 round(sum(f * sup) / sum(sup), 6), sum(sup)::BIGINT FROM z""")
def eva07(spark, d):
    return ev.classification_report(_loo_gated(spark, d)).select(
        "class", *r6("precision", "recall", "f1"), "support"
    )


@query("eva08_open_set_metrics", f"WITH {GATED} {metrics_sql('pr')}")
def eva08(spark, d):
    return _metrics(ev.open_set_metrics(_loo_gated(spark, d)))


@query("eva09_confusions", f"""
WITH {GATED} SELECT truth, pred, count(*)::BIGINT AS n FROM pr WHERE truth <> pred GROUP BY ALL
ORDER BY n DESC, truth, pred LIMIT 10""")
def eva09(spark, d):
    return ev.top_confusions(_loo_gated(spark, d))


SCORES_SQL = "(SELECT (x / 20.0)::DOUBLE AS score_floor FROM range(19) t(x))"
MARGINS_SQL = "(SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS margin_floor)"
SWEPT = "CASE WHEN score < score_floor OR margin < margin_floor OR vote < 0.4 THEN 'low_confidence' ELSE product END"


@query("eva10_score_sweep", f"""
WITH {GATED}, sw AS (SELECT score_floor, truth, {SWEPT.replace(' OR margin < margin_floor', '')} AS pred
  FROM pr, {SCORES_SQL}), m AS ({metrics_sql('sw', 'score_floor')}),
i AS (SELECT *, balanced > coalesce(max(balanced) OVER (ORDER BY score_floor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
        AS improves FROM m)
SELECT *, score_floor = (SELECT max(score_floor) FROM i WHERE improves) AS is_best FROM i""")
def eva10(spark, d):
    rows = ev.with_truth(_loo(spark, d), b.crops(spark, d))
    return _metrics(ev.score_sweep(rows, SCORE_GRID), "score_floor", "improves", "is_best")


@query("eva11_gate_sweep", f"""
WITH {GATED}, sw AS (SELECT score_floor, margin_floor, truth, {SWEPT} AS pred
  FROM pr, (SELECT unnest([0.0, 0.35, 0.5])::DOUBLE AS score_floor), {MARGINS_SQL})
{metrics_sql('sw', 'score_floor, margin_floor')}""")
def eva11(spark, d):
    rows = ev.with_truth(_loo(spark, d), b.crops(spark, d))
    return _metrics(ev.gate_sweep(rows, (0.0, FLOOR, 0.5), MARGIN_GRID), "score_floor", "margin_floor")


@query("eva12_margin_distribution", f"""
WITH {LOO_KNN} SELECT pct::DOUBLE AS pct, round(value, 6) AS value FROM (
  SELECT unnest([0, 25, 50, 75, 100]) AS pct, unnest(quantile_cont(margin, [0, 0.25, 0.5, 0.75, 1])) AS value FROM knn)""")
def eva12(spark, d):
    return ev.margin_distribution(_loo(spark, d)).select("pct", *r6("value"))


@query("eva13_negative_destinations", f"""
WITH {GATED}, n AS (SELECT truth AS bucket, CASE WHEN pred = truth THEN 'same bucket' WHEN {PBUCKET} THEN 'other bucket'
  WHEN pred = 'low_confidence' THEN 'rejected' ELSE 'named product' END AS destination, pred FROM pr WHERE {NEG})
SELECT bucket, destination, CASE WHEN destination = 'named product' THEN pred ELSE '' END AS product, count(*)::BIGINT AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY bucket)::DOUBLE, 6) AS share
FROM n GROUP BY 1, 2, 3""")
def eva13(spark, d):
    return ev.negative_destinations(_loo_gated(spark, d)).select(
        "bucket", "destination", "product", "n", *r6("share")
    )


@query("eva13_negatives_named", f"""
WITH {GATED} SELECT count(*)::BIGINT AS negatives, count(*) FILTER (NOT {PBUCKET} AND pred <> 'low_confidence')::BIGINT AS named,
       round(avg((NOT {PBUCKET} AND pred <> 'low_confidence')::INTEGER), 6) AS rate FROM pr WHERE {NEG}""")
def eva13_rate(spark, d):
    return ev.negatives_named_rate(_loo_gated(spark, d)).select("negatives", "named", *r6("rate"))


@query("eva15_mode_comparison", f"""
WITH {LOO_KNN}, {PROTO_SQL.format(key='', src='crops')}, {RANK_SQL.format(rows='crops', on='true')}, {BEST_SQL},
pr AS (SELECT mode, {GATE_SQL.format(s=FLOOR, m='')} AS pred, label AS truth
       FROM (SELECT 'knn' AS mode, * FROM knn UNION ALL SELECT 'prototype', * FROM proto) JOIN crops USING (id))
SELECT mode, count(*)::BIGINT AS n, round(avg((pred = truth)::INTEGER), 6) AS accuracy,
       count(*) FILTER (pred = 'low_confidence')::BIGINT AS rejected FROM pr GROUP BY 1""")
def eva15(spark, d):
    rows = b.crops(spark, d)
    by_mode = {
        "knn": ev.with_truth(_loo(spark, d), rows),
        "prototype": ev.with_truth(mt.match_prototype(rows.select("id", "vec"), rows), rows),
    }
    return ev.mode_comparison(by_mode, FLOORS).select("mode", "n", *r6("accuracy"), "rejected")


def edges_sql(eps: str) -> str:
    return f"""e AS (SELECT a.id AS u, z.id AS v, 1 - list_cosine_similarity(a.vec, z.vec) AS dist
  FROM crops a JOIN crops z ON a.id <> z.id AND round(1 - list_cosine_similarity(a.vec, z.vec), 10) <= {eps})"""


COMPONENTS_SQL = """reach(u, v) AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
comp AS (SELECT u AS id, min(v) AS head FROM reach GROUP BY 1),
heads AS (SELECT head, row_number() OVER (ORDER BY head) - 1 AS cluster_id FROM (SELECT DISTINCT head FROM comp)),
assigned AS (SELECT crops.id, label, coalesce(cluster_id, -1)::BIGINT AS cluster_id
  FROM crops LEFT JOIN comp USING (id) LEFT JOIN heads USING (head))"""
CLUSTERS = f"RECURSIVE {CROPS_SQL}, {edges_sql(str(EPS))}, {COMPONENTS_SQL}"


def _clusters(spark, d):
    return cl.number_clusters(cl.dbscan(b.crops(spark, d).select("id", "vec"), EPS))


@query("clu01_dbscan", f"WITH {CLUSTERS} SELECT id, cluster_id FROM assigned")
def clu01(spark, d):
    return _clusters(spark, d)


@query("clu02_cluster_summary", f"""
WITH {CLUSTERS}, n AS (SELECT cluster_id, count(*) AS n FROM assigned GROUP BY 1)
SELECT sum(n)::BIGINT AS samples, count(*) FILTER (cluster_id <> -1)::BIGINT AS clusters,
       coalesce(sum(n) FILTER (cluster_id = -1), 0)::BIGINT AS noise, max(n) FILTER (cluster_id <> -1)::BIGINT AS largest FROM n""")
def clu02(spark, d):
    return cl.cluster_summary(_clusters(spark, d))


KD_SQL = f"""{CROPS_SQL}, kd AS (SELECT a.id, min(1 - list_cosine_similarity(a.vec, z.vec)) AS d
  FROM crops a JOIN crops z ON a.id <> z.id GROUP BY 1)"""


def _k_distances(spark, d):
    return cl.k_distances(b.crops(spark, d).select("id", "vec"), 2)


@query("clu03_k_distance", f"""
WITH {KD_SQL} SELECT unnest([10, 25, 50, 75, 90, 95, 99])::DOUBLE AS pct,
  round(unnest(quantile_cont(d, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])), 6) AS value FROM kd""")
def clu03(spark, d):
    return cl.k_distance_percentiles(_k_distances(spark, d)).select("pct", *r6("value"))


@query("clu04_largest_jump", f"""
WITH {KD_SQL}, s AS (SELECT d AS d_from, lead(d) OVER (ORDER BY d) AS d_to, row_number() OVER (ORDER BY d) AS position FROM kd)
SELECT round(d_from, 6) AS d_from, round(d_to, 6) AS d_to, round(d_to - d_from, 6) AS jump, position::BIGINT AS position,
       (SELECT count(*) FROM kd)::BIGINT AS total
FROM s WHERE d_to IS NOT NULL ORDER BY d_to - d_from DESC, position LIMIT 1""")
def clu04(spark, d):
    return cl.largest_jump(_k_distances(spark, d)).select(*r6("d_from", "d_to", "jump"), "position", "total")


def _table(spark, d):
    truth = b.crops(spark, d).select("id", F.col("label").alias("truth"))
    return cl.contingency(_clusters(spark, d).join(truth, "id"))


PURITY_SQL = """(SELECT sum(t) / sum(n)::DOUBLE FROM (SELECT max(n) AS t, sum(n) AS n FROM
    (SELECT cluster_id, label, count(*) AS n FROM assigned WHERE cluster_id <> -1 GROUP BY ALL) GROUP BY cluster_id))"""


@query("clu05_purity", f"WITH {CLUSTERS} SELECT round({PURITY_SQL}, 6) AS purity")
def clu05(spark, d):
    return cl.purity(_table(spark, d)).select(*r6("purity"))


@query("clu06_adjusted_rand", f"""
WITH {CLUSTERS}, s AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS s, sum(n) AS t FROM (SELECT count(*)::DOUBLE AS n FROM assigned GROUP BY cluster_id, label)),
a AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS a FROM (SELECT count(*)::DOUBLE AS n FROM assigned GROUP BY label)),
c AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS c FROM (SELECT count(*)::DOUBLE AS n FROM assigned GROUP BY cluster_id))
SELECT round((s - a * c / (t * (t - 1) / 2)) / ((a + c) / 2 - a * c / (t * (t - 1) / 2)), 6) AS ari FROM s, a, c""")
def clu06(spark, d):
    return cl.adjusted_rand(_table(spark, d)).select(*r6("ari"))


@query("clu07_eps_sweep", f"""
WITH RECURSIVE {CROPS_SQL}, e0 AS (SELECT a.id AS u, z.id AS v, round(1 - list_cosine_similarity(a.vec, z.vec), 10) AS dist
  FROM crops a JOIN crops z ON a.id <> z.id AND round(1 - list_cosine_similarity(a.vec, z.vec), 10) <= 0.6),
g AS (SELECT unnest([0.45, 0.5, 0.55, 0.6])::DOUBLE AS eps), e AS (SELECT eps, u, v FROM e0, g WHERE dist <= eps),
reach(eps, u, v) AS (SELECT eps, u, v FROM e UNION SELECT e.eps, reach.u, e.v FROM reach JOIN e ON reach.v = e.u AND reach.eps = e.eps),
comp AS (SELECT eps, u AS id, min(v) AS head FROM reach GROUP BY ALL),
x AS (SELECT g.eps, crops.id, label, coalesce(head, -1) AS c FROM g CROSS JOIN crops LEFT JOIN comp ON comp.eps = g.eps AND comp.id = crops.id),
k AS (SELECT eps, c, label, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
kc AS (SELECT eps, c, sum(n) AS n, max(n) AS top FROM k GROUP BY ALL),
kl AS (SELECT eps, label, sum(n) AS n FROM k GROUP BY ALL),
s AS (SELECT eps, sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM k GROUP BY 1),
a AS (SELECT eps, sum(n * (n - 1) / 2) AS a FROM kl GROUP BY 1),
b AS (SELECT eps, sum(n * (n - 1) / 2) AS b, count(*) FILTER (c <> -1)::BIGINT AS clusters,
             coalesce(sum(n) FILTER (c = -1), 0)::BIGINT AS noise, sum(top) FILTER (c <> -1) / sum(n) FILTER (c <> -1) AS purity
      FROM kc GROUP BY 1)
SELECT eps, clusters, noise, round((s - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari,
       round(coalesce(purity, 'nan'::DOUBLE), 6) AS purity
FROM s JOIN a USING (eps) JOIN b USING (eps)""")
def clu07(spark, d):
    rows = b.crops(spark, d)
    truth = rows.select("id", F.col("label").alias("truth"))
    return cl.eps_sweep(rows.select("id", "vec"), truth, EPS_GRID).select(
        "eps", "clusters", "noise", *r6("ari", "purity")
    )
