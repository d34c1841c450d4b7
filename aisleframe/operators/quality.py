"""Reference-set hygiene: layout, leakage, thin classes, group audit, incremental upkeep."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import relative_to
from ..model import CLUSTER_MIN_POINTS
from ..sources.snapshots import Snapshots


class LayoutError(ValueError):
    """A class tree holds files that are not exactly one folder deep."""


class LeakageError(ValueError):
    """Test content is also reference content."""


def misplaced_folders(files: DataFrame, root: str) -> DataFrame:
    """Folders (relative to ``root``) whose files are not at ``<class>/<file>``, with counts."""
    parts = F.split(relative_to(F.col("path"), root), "/")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return (
        files.where(F.size(parts) != 2)
        .groupBy(F.when(F.size(parts) < 2, F.lit(".")).otherwise(folder).alias("folder"))
        .agg(F.count(F.lit(1)).alias("files"))
    )


def assert_flat_class_tree(files: DataFrame, root: str, what: str = "knowledge base") -> None:
    """Raise naming the first ten offending folders."""
    bad = misplaced_folders(files, root)
    totals = bad.agg(F.sum("files"), F.count(F.lit(1))).first()
    if not totals[0]:
        return
    named = [r["folder"] for r in bad.orderBy("folder").limit(10).collect()]
    more = f" and {totals[1] - 10} more" if totals[1] > 10 else ""
    raise LayoutError(
        f"{what} at {root}: {totals[0]} file(s) not at <class>/<file>, in "
        f"{', '.join(named)}{more}"
    )


def leaked_content(test: DataFrame, kb: DataFrame, content: str = "content") -> DataFrame:
    """Test rows whose content hash occurs in the reference set, with the first reference path.

    Both sides are ``(path, <content>)``.
    """
    hashed = kb.groupBy(F.md5(F.col(content)).alias("hash")).agg(F.min("path").alias("kb_path"))
    return test.select("path", F.md5(F.col(content)).alias("hash")).join(hashed, "hash")


def assert_no_leakage(test: DataFrame, kb: DataFrame, allow: bool = False, **kw) -> DataFrame:
    leaked = leaked_content(test, kb, **kw)
    n = leaked.count()
    if n and not allow:
        raise LeakageError(f"{n} test item(s) are byte-identical to reference items")
    return leaked


def shared_sources(test: DataFrame, kb: DataFrame) -> DataFrame:
    """Photos of test rows that also fed the reference set, with the number of test rows."""
    return (
        test.groupBy("photo").agg(F.count(F.lit(1)).alias("test_rows"))
        .join(kb.select("photo").distinct(), "photo", "left_semi")
    )


def split_photos(photos: DataFrame, kb: DataFrame) -> DataFrame:
    """Every photo marked as used by the reference set or free for a test set."""
    used = kb.select("photo").distinct().withColumn("_used", F.lit(True))
    return photos.select("photo").distinct().join(used, "photo", "left").select(
        "photo", F.coalesce("_used", F.lit(False)).alias("used")
    )


def class_counts(refs: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    return refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def thin_classes(refs: DataFrame, keys: Sequence[str] = ("label",), least: int = 2) -> DataFrame:
    """Classes with too few references for a discriminant fit."""
    return class_counts(refs, keys).where(F.col("n") < least)


def without_thin_classes(refs: DataFrame, least: int = 2) -> DataFrame:
    return refs.join(thin_classes(refs, least=least), "label", "left_anti")


def group_audit(files: DataFrame, known_photos: DataFrame) -> DataFrame:
    """Per source group: size, classes, and whether a human should look.

    ``files(group, label)``, ``known_photos(photo)``. Flags: ``expected`` for a known photo that
    spans classes, ``review`` for an unknown one, ``single`` otherwise; ``unconfirmed`` marks ids
    without a photo that are not class-qualified.
    """
    per_class = files.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    per_group = per_class.groupBy("group").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("classes"),
        F.array_join(F.array_sort(F.collect_list("label")), ",").alias("class_names"),
    )
    known = known_photos.select(F.col("photo").alias("group")).distinct().withColumn(
        "_known", F.lit(True)
    )
    is_known = F.coalesce("_known", F.lit(False))
    return per_group.join(known, "group", "left").select(
        "group",
        "n",
        "classes",
        "class_names",
        F.when(F.col("classes") <= 1, F.lit("single"))
        .when(is_known, F.lit("expected"))
        .otherwise(F.lit("review"))
        .alias("flag"),
        (~is_known & ~F.contains(F.col("group").cast("string"), F.lit("::"))).alias("unconfirmed"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.max("n").alias("largest"),
        F.count_if(F.col("classes") > 1).alias("multi_class"),
        F.count_if("unconfirmed").alias("unconfirmed"),
    )


SIGNATURE = ("path", "size", "model", "version", "variant")


def signature_changes(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows present on one side only; an empty result means the cache is valid."""
    keys = list(SIGNATURE)
    same = lambda l, r: [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    l, r = current.select(*keys).alias("l"), cached.select(*keys).alias("r")
    added = l.join(r, same(l, r), "left_anti").withColumn("change", F.lit("added"))
    gone = cached.select(*keys).alias("l").join(
        current.select(*keys).alias("r"), same(l, r), "left_anti"
    ).withColumn("change", F.lit("removed"))
    return added.unionByName(gone)


def cache_is_valid(current: DataFrame, cached: DataFrame) -> bool:
    return signature_changes(current, cached).isEmpty()


def stale_keys(files: DataFrame, pool: DataFrame, model: str, version: int) -> DataFrame:
    """Files whose vector is missing, of another size, or of another model version."""
    good = pool.where((F.col("model") == model) & (F.col("version") == version))
    return files.join(good.select("key", "size"), ["key", "size"], "left_anti")


def update_pool(
    files: DataFrame,
    pool: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    model: str,
    version: int,
) -> DataFrame:
    """Retained vectors plus freshly embedded ones; failed embeddings (null) are skipped.

    ``embed`` maps the stale files to ``(key, size, embedding)``, usually with ``mapInPandas`` and
    a lazily loaded model per task. Rows of another model version are dropped. Rows of files that
    are gone are kept, as a later run may see them again.
    """
    good = pool.where((F.col("model") == model) & (F.col("version") == version))
    fresh = (
        embed(stale_keys(files, pool, model, version))
        .where(F.col("embedding").isNotNull())
        .select("key", "size", F.lit(model).alias("model"), F.lit(version).alias("version"), "embedding")
    )
    kept = good.join(fresh.select("key"), "key", "left_anti")
    return kept.select("key", "size", "model", "version", "embedding").unionByName(fresh)


POOL_SCHEMA = "key string, size long, model string, version int, embedding array<float>"


def commit_pool(
    spark: SparkSession, folder: str, files: DataFrame, embed: Callable[[DataFrame], DataFrame],
    model: str, version: int,
) -> DataFrame:
    """:func:`update_pool` on the committed pool in ``folder``: the new version, read back.

    Readers of the version before go on undisturbed; if anything fails, that one stays the newest.
    """
    store = Snapshots(spark, folder, POOL_SCHEMA)
    new = store.replace(lambda pool: update_pool(files, pool, embed, model, version))
    return store.read(new)


def build_matrix(files: DataFrame, pool: DataFrame, dim: int) -> DataFrame:
    """Files that have a vector of the right width, with it; a wrong width is an error."""
    vec = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(
        F.raise_error(F.concat(F.lit("vector width is not "), F.lit(str(dim)))).cast("array<float>")
    )
    return files.join(pool.select("key", "embedding"), "key").withColumn("embedding", vec)


def is_enough(n: Column, least: int) -> Column:
    return n >= least


def enough_points(rows: DataFrame, least: int = CLUSTER_MIN_POINTS) -> bool:
    """Guard before clustering; reads no more rows than the floor."""
    return rows.limit(least).agg(is_enough(F.count(F.lit(1)), least)).first()[0]


def count_inferred(resolved: DataFrame, flag: Column | str = "inferred") -> DataFrame:
    return resolved.agg(F.count(F.lit(1)).alias("files"), F.count_if(flag).alias("inferred"))
