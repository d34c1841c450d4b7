"""Keeping an embedding pool up to date while image files arrive."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import relative_to
from ..operators.quality import stale_keys
from ..sources.snapshots import Snapshots, newest

POOL_SCHEMA = "key string, size long, model string, version int, embedding array<float>, batch long"
# Folders of a version beyond which it is rewritten as one.
SMALL_FOLDERS = 32


def snapshots(spark: SparkSession, folder: str) -> Snapshots:
    return Snapshots(spark, f"{folder}/vectors", POOL_SCHEMA)


def pool(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """Latest vector per key, model and version of a committed pool of :func:`start_pool_updates`."""
    rows = newest(snapshots(spark, folder).read(version), ["key", "model", "version"], "batch")
    return rows.select("key", "size", "model", "version", "embedding")


def new_files(spark: SparkSession, folder: str, glob: str = "*.jpg") -> DataFrame:
    """Stream of files with key and size."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select(
            relative_to(F.col("path"), folder).alias("key"),
            F.col("length").alias("size"),
            "content",
        )
    )


def _first(manifest: dict, model: str, version: int) -> list:
    """Model and version that a pool began with."""
    return manifest["marks"].get("first", [model, version])


def start_pool_updates(
    files: DataFrame,
    folder: str,
    embed: Callable[[DataFrame], DataFrame],
    model: str,
    version: int,
    checkpoint: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Embed the files of each batch that the pool lacks and commit them as a version of the pool.

    A version keeps the number of its batch by stream, so a replayed batch commits nothing twice; files
    already present with the same size, model and version are not embedded again. Versions of more than
    SMALL_FOLDERS folders are rewritten as one, with the latest vector of every key.

    A stream goes on where its checkpoint ended. Another model or version than the pool's first has a
    checkpoint of its own, so it gets every file; so has a run that names one, for files that are to
    arrive again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = snapshots(spark, folder)
        parent = store.manifest()
        # Numbers of batches begin anew with every checkpoint.
        mark = f"batch {spark.sparkContext.getLocalProperty('sql.streaming.queryId')}"
        if parent["marks"].get(mark, -1) >= number:
            return
        known = store.read(parent["version"])
        fresh = embed(stale_keys(batch, known, model, version)).where("embedding is not null")
        rows = fresh.select(
            "key", "size", F.lit(model).alias("model"), F.lit(version).alias("version"), "embedding",
            # Later rows have larger numbers, whichever stream they are of.
            F.lit(parent["version"]).cast("long").alias("batch"),
        )
        store.append(rows, {mark: number, "first": _first(parent, model, version)}, parent)
        store.compact(SMALL_FOLDERS, lambda rows: newest(rows, ["key", "model", "version"], "batch").select(*rows.columns))

    if checkpoint is None:
        of = [model, version]
        own = _first(snapshots(files.sparkSession, folder).manifest(), model, version) == of
        checkpoint = f"{folder}/checkpoint" + ("" if own else f"-{version}-{quote(model, safe='')}")
    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
