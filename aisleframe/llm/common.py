"""Arrow plumbing of the text operators: bounded slices in, bounded batches out, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.runtime import forget, scratch_path

# Text handed to one vectorised step, and text gathered before a batch leaves a task.
SLICE_BYTES = 4 * 1024 * 1024
OUT_BYTES = 8 * 1024 * 1024
# Arrow batches that Spark hands to Python workers; its own bound is 64 MB, which executor and worker hold at once.
BATCH_BYTES = 4 * 1024 * 1024
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


# Tables that operators of this session have left in the shared folder.
_left: list[str] = []


def folder_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: a compressed table in the shared folder, read back by Spark.

    It stays until :func:`forget_tables`, as results are lazy and may be read any time later.
    """
    path = scratch_path(df.sparkSession, name)
    _left.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_left() -> int:
    """How many tables operators have left so far."""
    return len(_left)


def forget_tables(spark: SparkSession, since: int = 0) -> int:
    """Removes the tables left after the first ``since``; for callers whose own results are stored."""
    gone = _left[since:]
    del _left[since:]
    for path in gone:
        forget(spark, path)
    return len(gone)


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers of this session get batches of about BATCH_BYTES or one longer row.

    Rows and results stay as they are. It is not taken back, as results are lazy."""
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def whole_text(col: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def slices(
    batches: Iterable[pa.RecordBatch], col: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the bytes of ``col`` stay near ``limit``; a longer row comes alone.

    Memory of batches that were read goes back to the system: workers outlive their tasks."""
    pool = pa.default_memory_pool()
    for batch in batches:
        n, column = batch.num_rows, batch.column(col)
        if column.nbytes <= limit:
            if n:
                yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < n:
            yield batch.slice(start)
        column = None
        pool.release_unused()
    batch = column = None
    pool.release_unused()


class Rows:
    """Gathers output rows and hands them on as batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = OUT_BYTES, rows: int = 20_000):
        self.schema, self.limit, self.rows = schema, limit, rows
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.held = 0

    def add(self, *values, size: int = 64) -> bool:
        """True when the batch should leave."""
        for column, value in zip(self.columns, values):
            column.append(value)
        self.held += size
        return self.held >= self.limit or len(self.columns[0]) >= self.rows

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema)]
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def __len__(self) -> int:
        return len(self.columns[0])


def arrow_map(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    return df.mapInArrow(fn, schema)


def kept_rows(docs: DataFrame, keep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``docs`` whose keys are in ``keep``; null keys match null."""
    left, right = docs.alias("l"), keep.select(*keys).distinct().alias("r")
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return left.join(right, on, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
