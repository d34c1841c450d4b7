"""Corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, tokens.

Every stage works on all rows its predecessor kept and takes its decisions there; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.llm import bpe, decontam, exact_dedup, near_copies, toxicity
from aisleframe.llm.common import forget_tables, small_batches, tables_left
from aisleframe.llm.queries import table, tokenizer_path
from aisleframe.runtime import forget, stored


def bounded(stage):
    """The stage with batches of bounded bytes, whatever the length of texts."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a severity grade above 0 is 0.5 or more go. Null text is empty."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@bounded
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null is empty, ids rank before null ids."""
    return exact_dedup.keep_owners(docs, keep="max")


@bounded
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles the one with the smallest
    doc_id stays. Null ids stay, null and empty texts are near copies of each other."""
    return near_copies.without_copies(docs)


@bounded
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and the digest of what they decode to."""
    found = bpe.tokens(docs, tokenizer_path())
    return found.select(
        "doc_id", "n_tokens", "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", clean),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokens),
]
# Fingerprints, the fitted model and the tokenizer have no SQL form; tests/llm compares run() with a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path, others = table(spark, sf_dir, "documents"), None, tables_left()
    for name, stage in STAGES[:-1]:
        before = path
        docs, path = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        # The stage is stored; what it was made from is not read again.
        forget_tables(spark, others)
        if before is not None:
            forget(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
