"""Label grammar ``<brand>_<size>_<flavour...>`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import is_bucket


def brand_and_flavour(label: Column) -> Column:
    """struct<brand, flavour>; both null unless the label names a product in three parts."""
    parts = F.split(label, "_")
    named = (F.size(parts) >= 3) & ~is_bucket(label)
    return F.struct(
        F.when(named, parts[0]).alias("brand"),
        F.when(named, F.element_at(parts, -1)).alias("flavour"),
    )


def report_parts(label: Column) -> Column:
    """struct<brand, size, flavor> as the share report reads a label."""
    parts = F.split(label, "_")
    n = F.size(parts)
    return F.struct(
        parts[0].alias("brand"),
        F.when(n > 1, F.get(parts, F.lit(1))).otherwise(F.lit("unknown")).alias("size"),
        F.when(n > 2, F.array_join(F.slice(parts, 3, F.greatest(n - 2, F.lit(0))), "_"))
        .otherwise(F.lit("unknown"))
        .alias("flavor"),
    )


def localised(
    labels: DataFrame, brands: DataFrame, sizes: DataFrame, flavours: DataFrame
) -> DataFrame:
    """Displayed brand, size and flavour of each label; all null unless every part is mapped.

    The three mappings are ``(code, name)`` tables.
    """
    parts = F.split("label", "_")
    n = F.size(parts)
    rest = F.when(n > 2, F.array_join(F.slice(parts, 3, F.greatest(n - 2, F.lit(0))), "_"))
    split = labels.select(
        "*",
        parts[0].alias("_b"),
        F.get(parts, F.lit(1)).alias("_s"),
        F.coalesce(rest, F.lit("")).alias("_f"),
    )
    out = split
    for key, table, name in (
        ("_b", brands, "brand_name"),
        ("_s", sizes, "size_name"),
        ("_f", flavours, "flavor_name"),
    ):
        out = out.join(
            table.select(F.col("code").alias(key), F.col("name").alias(name)), key, "left"
        )
    whole = (
        F.col("brand_name").isNotNull()
        & F.col("size_name").isNotNull()
        & F.col("flavor_name").isNotNull()
    )
    return out.select(
        *labels.columns,
        *[F.when(whole, F.col(c)).alias(c) for c in ("brand_name", "size_name", "flavor_name")],
    )
