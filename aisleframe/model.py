"""Shared vocabulary: sentinel labels, match modes, gates, filter specification, schemas."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sentinel labels.
LOW_CONFIDENCE = "low_confidence"
UNKNOWN_BUCKET = "unknown_beverage"
NON_PRODUCT_PREFIX = "non_beverage"
REPORT_SKIPPED = ("low_confidence", "unknown")

# Match modes and their gates.
MODES = ("lda", "knn", "prototype")
DEFAULT_MODE = "lda"
K_NEIGHBOURS = 5
VOTE_TEMPERATURE = 0.05
POSTERIOR_TEMPERATURE = 30.0
VOTE_FLOOR = 0.40
SCORE_FLOORS = {"lda": 0.30, "knn": 0.60, "prototype": 0.60}
MARGIN_FLOORS = {"lda": 0.05, "knn": None, "prototype": None}

# Clustering.
CLUSTER_EPS = 0.15
CLUSTER_MIN_SAMPLES = 2
CLUSTER_MIN_POINTS = 40
EPS_GRID = (0.05, 0.08, 0.10, 0.15, 0.20, 0.25, 0.30)
K_DISTANCE_PERCENTILES = (10, 25, 50, 75, 90, 95, 99)

# Gate sweeps.
SCORE_GRID = tuple(round(0.05 * i, 2) for i in range(19))
MARGIN_GRID = (0.0, 0.05, 0.10, 0.20, 0.30, 0.50)

# File extensions accepted for images.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".png")


def is_non_product(label: Column) -> Column:
    """Distractor classes that are seen but never reported."""
    return label.startswith(NON_PRODUCT_PREFIX)


def is_bucket(label: Column) -> Column:
    """Either kind of label that names no product."""
    return (label == UNKNOWN_BUCKET) | is_non_product(label)


@dataclass(frozen=True)
class Filters:
    """Optional dashboard filter; an unset field does not restrict."""

    brand_id: str | None = None
    flavor: str | None = None
    size: int | str | None = None
    sku: str | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None

    @property
    def restricts_products(self) -> bool:
        return any(v is not None for v in (self.brand_id, self.flavor, self.size, self.sku))

    def without_dates(self) -> "Filters":
        return Filters(self.brand_id, self.flavor, self.size, self.sku)

    def product_predicate(self) -> Column:
        terms = []
        if self.brand_id is not None:
            terms.append(F.col("brand_id") == self.brand_id)
        if self.flavor is not None:
            terms.append(F.col("flavor") == self.flavor)
        if self.size is not None:
            terms.append(F.col("size") == self.size)
        if self.sku is not None:
            terms.append(
                (F.col("product_id").cast("string") == self.sku) | (F.col("sku") == self.sku)
            )
        return reduce(lambda a, b: a & b, terms, F.lit(True))

    def date_predicate(self) -> Column:
        terms = []
        if self.date_from is not None:
            terms.append(F.col("observed_at") >= F.lit(self.date_from).cast("timestamp_ntz"))
        if self.date_to is not None:
            terms.append(F.col("observed_at") <= F.lit(self.date_to).cast("timestamp_ntz"))
        return reduce(lambda a, b: a & b, terms, F.lit(True))


VERDICT_SCHEMA = T.StructType(
    [
        T.StructField("verdict", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("flavor", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("fruits", T.ArrayType(T.StringType())),
        T.StructField("image_supported", T.BooleanType()),
        T.StructField("brand_recheck_supported", T.BooleanType()),
        T.StructField("flavor_recheck_supported", T.BooleanType()),
        T.StructField("size_recovery_supported", T.BooleanType()),
        T.StructField("web_status", T.StringType()),
        T.StructField("web_supported", T.BooleanType()),
        T.StructField("brand_supported", T.BooleanType()),
        T.StructField("flavor_supported", T.BooleanType()),
        T.StructField("size_supported", T.BooleanType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("conflicts", T.ArrayType(T.StringType())),
        T.StructField("reason", T.StringType()),
    ]
)
