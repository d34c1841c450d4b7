"""From located crops to shelf shares: the stages of recognition composed as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DEFAULT_MODE, MARGIN_FLOORS, SCORE_FLOORS, is_non_product
from . import evidence as fx
from . import matching as mt
from .share import share_of_shelf


def recognise(
    crops: DataFrame,
    refs: DataFrame,
    evidence: DataFrame,
    verdicts: DataFrame,
    mode: str = DEFAULT_MODE,
    *,
    consult_margin: float = fx.CONSULT_MARGIN,
    verify_brand: bool = True,
    score_floor: float | None = None,
    margin_floor: float | None = None,
    ranking: DataFrame | None = None,
) -> DataFrame:
    """id, product, score, source per crop.

    ``crops(id, vec)`` are ranked against ``refs(id, label, vec)``; crops worth reading are fused
    with their label reads (``evidence``); gates turn weak answers into low confidence, for which an
    allowed verdict may step in. Gates come before distractors are left out, so a weak distractor is
    a low-confidence crop. ``ranking`` replaces the first step.
    """
    ranked = mt.top_matches(crops, refs, None, mode) if ranking is None else ranking
    consulted = fx.should_consult(ranked, consult_margin, verify_brand).where("consult").select("id")
    read = ranked.join(consulted, "id", "left_semi")
    fused = fx.fuse(read, evidence.join(consulted, "id", "left_semi"))
    decided = fx.fused_decision(mt.best_and_margin(ranked), ranked, fused)
    gated = mt.apply_gates(
        decided,
        score_floor=SCORE_FLOORS[mode] if score_floor is None else score_floor,
        margin_floor=MARGIN_FLOORS[mode] if margin_floor is None else margin_floor,
    ).select("id", F.col("gated").alias("product"), "score", "source")
    return fx.second_opinion(gated, verdicts, mt.candidate_labels(refs))


def shelf_shares(recognised: DataFrame, located: DataFrame, by: tuple[str, ...] = ("photo",)) -> DataFrame:
    """Share by facings and by area of the recognised crops; ``located(id, area, by...)``."""
    reported = recognised.where(~is_non_product(F.col("product")))
    return share_of_shelf(reported.join(located.select("id", "area", *by), "id"), by)
