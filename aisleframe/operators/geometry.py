"""Detection boxes: floor, merge of split objects, crop boxes, percent boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import split_row_number

# Detection floor, crop padding and merge thresholds.
DETECTION_FLOOR = 0.5
CROP_PAD = 2
X_OVERLAP = 0.80
WIDTH_RATIO = 0.75
Y_GAP = 0.05
MAX_ASPECT = 6.0
_STRIP = 64.0


def confident(boxes: DataFrame, floor: float = DETECTION_FLOOR) -> DataFrame:
    return boxes.where(F.col("conf") >= floor)


def number_boxes(boxes: DataFrame, coarse: list[Column], fine: list[Column]) -> DataFrame:
    """0-based box index per photo in the given order, without one task per photo."""
    return split_row_number(boxes, ["photo"], coarse, fine, "_rn").withColumn(
        "idx", F.col("_rn") - 1
    ).drop("_rn")


def crop_boxes(boxes: DataFrame, prefix: Column | None = None, pad: int = CROP_PAD) -> DataFrame:
    """Padded, clamped integer boxes with area and name ``<prefix>-<idx>``."""
    low = lambda c: F.greatest(F.lit(0), F.col(c).cast("int") - pad)
    high = lambda c, limit: F.least(F.col(limit).cast("int"), F.col(c).cast("int") + pad)
    name = F.concat_ws("-", (prefix if prefix is not None else F.col("photo")).cast("string"), F.col("idx").cast("string"))
    out = boxes.select(
        name.alias("crop"),
        F.col("photo").alias("source_photo"),
        low("x1").alias("x1"),
        low("y1").alias("y1"),
        high("x2", "img_w").alias("x2"),
        high("y2", "img_h").alias("y2"),
    )
    side = lambda a, b: F.greatest(F.lit(0), F.col(b) - F.col(a)).cast("long")
    return out.withColumn("area", side("x1", "x2") * side("y1", "y2"))


def percent_boxes(crops: DataFrame) -> DataFrame:
    """Box position and extent as percentages of the image."""
    part = lambda v, whole: v.cast("double") / F.col(whole) * 100
    return crops.select(
        "*",
        part(F.col("x1"), "img_w").alias("x_pct"),
        part(F.col("y1"), "img_h").alias("y_pct"),
        part(F.col("x2") - F.col("x1"), "img_w").alias("w_pct"),
        part(F.col("y2") - F.col("y1"), "img_h").alias("h_pct"),
    )


def _islands(boxes: DataFrame) -> DataFrame:
    """Cut photos at vertical lines no box crosses; boxes on both sides can never merge.

    Coverage is kept per strip of pixels, so a photo's window holds at most width / strip rows.
    """
    strip = lambda c: F.floor(F.col(c) / _STRIP).cast("long")
    covered = boxes.select(
        "photo", F.explode(F.sequence(strip("x1"), F.greatest(strip("x1"), strip("x2")))).alias("s")
    ).distinct()
    w = Window.partitionBy("photo").orderBy("s")
    gap = F.when(F.col("s") - F.lag("s").over(w) > 1, 1).otherwise(0)
    island = covered.withColumn("_gap", gap).withColumn("island", F.sum("_gap").over(w))
    return boxes.withColumn("s", strip("x1")).join(
        island.select("photo", "s", "island"), ["photo", "s"]
    ).drop("s")


def merge_adjacent_boxes(
    boxes: DataFrame,
    *,
    x_overlap: float = X_OVERLAP,
    width_ratio: float = WIDTH_RATIO,
    y_gap: float = Y_GAP,
    max_aspect: float = MAX_ASPECT,
) -> DataFrame:
    """Re-join objects that were detected as an upper and a lower box.

    ``boxes(photo, idx, x1, y1, x2, y2, conf)``. In every round the lowest index pairs first and a
    box takes part in one merge; rounds repeat until nothing changes. The result keeps the smaller
    index and the larger confidence. The order matters only among boxes that share columns of the
    image, so each such island is one small group.
    """

    rule = (x_overlap, width_ratio, y_gap, max_aspect)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if held is not None:
                b = pd.concat([held, b])
            if len(b):
                # The last island may continue in the next batch.
                start = _starts(b)
                if start[-1]:
                    yield _merge_islands(b.iloc[: start[-1]], rule)
                held = b.iloc[start[-1]:]
        if held is not None and len(held):
            yield _merge_islands(held, rule)

    types = dict(boxes.dtypes)
    schema = (
        f"photo {types['photo']}, idx {types['idx']}, x1 double, y1 double, x2 double, y2 double, "
        "conf double"
    )
    need = boxes.select("photo", "idx", *[F.col(c).cast("double").alias(c) for c in _BOX])
    return (
        _islands(need)
        .repartition("photo", "island")
        .sortWithinPartitions("photo", "island", "idx")
        .mapInPandas(merge, schema)
    )


_BOX = ("x1", "y1", "x2", "y2", "conf")
_ROWS = 256


def _starts(b: pd.DataFrame) -> np.ndarray:
    """First row of every island in rows sorted by photo and island."""
    photo, island = b["photo"].to_numpy(), b["island"].to_numpy()
    change = (photo[1:] != photo[:-1]) | (island[1:] != island[:-1])
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def _merge_islands(b: pd.DataFrame, rule: tuple) -> pd.DataFrame:
    box = b[list(_BOX[:4])].to_numpy(dtype=float, copy=True)
    conf = b["conf"].to_numpy(dtype=float, copy=True)
    keep = np.ones(len(b), dtype=bool)
    starts = _starts(b)
    for lo, hi in zip(starts, np.append(starts[1:], len(b))):
        alive = np.arange(lo, hi)
        while len(alive) > 1:
            pairs = _first_pairs(box[alive], rule)
            if not pairs:
                break
            i, j = (alive[list(v)] for v in zip(*pairs))
            box[i, :2] = np.minimum(box[i, :2], box[j, :2])
            box[i, 2:] = np.maximum(box[i, 2:], box[j, 2:])
            conf[i] = np.maximum(conf[i], conf[j])
            keep[j] = False
            alive = alive[keep[alive]]
    out = b.loc[:, ["photo", "idx"]].assign(
        x1=box[:, 0], y1=box[:, 1], x2=box[:, 2], y2=box[:, 3], conf=conf
    )
    return out[keep]


def _mergeable(a: np.ndarray, box: np.ndarray, rule: tuple) -> np.ndarray:
    """Which boxes look like the other part of each object in ``a``."""
    x_overlap, width_ratio, y_gap, max_aspect = rule
    lo = lambda c: np.minimum(a[:, None, c], box[None, :, c])
    hi = lambda c: np.maximum(a[:, None, c], box[None, :, c])
    w = lambda m: m[:, 2] - m[:, 0]
    h = lambda m: m[:, 3] - m[:, 1]
    thin, wide = np.minimum(w(a)[:, None], w(box)), np.maximum(w(a)[:, None], w(box))
    short = np.minimum(h(a)[:, None], h(box))
    joint_w, joint_h = hi(2) - lo(0), hi(3) - lo(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (
            (thin > 0)
            & (short > 0)
            & (joint_w > 0)
            & (np.maximum(0.0, lo(2) - hi(0)) / thin >= x_overlap)
            & (thin / wide >= width_ratio)
            & ((hi(1) - lo(3)) / short <= y_gap)
            & (joint_h / joint_w <= max_aspect)
        )


def _first_pairs(box: np.ndarray, rule: tuple) -> list[tuple[int, int]]:
    """Pairs in index order, each box used once; rows are compared in slices."""
    n = len(box)
    free = np.ones(n, dtype=bool)
    pairs = []
    for lo in range(0, n, _ROWS):
        ok = _mergeable(box[lo: lo + _ROWS], box, rule)
        for i in np.flatnonzero(ok.any(axis=1)) + lo:
            if free[i]:
                partners = np.flatnonzero(ok[i - lo, i + 1:] & free[i + 1:])
                if len(partners):
                    j = int(partners[0]) + i + 1
                    free[i] = free[j] = False
                    pairs.append((int(i), j))
    return pairs
