"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words that repeats with a smallest period ``q``, at least ``max(6, 4 * q)``
words long, that no neighbouring word extends. Scale ``s`` looks for ``2**s <= q < 2**(s + 1)``.
There, grams of ``2**(s + 1)`` words inside a run are equal only at multiples of ``q``, and windows
of ``2**s`` grams hold the same least gram one period later. So two neighbouring minimizers with
equal grams stand ``q`` apart in every such run; each pair is a seed, extended word by word to both
sides. Periods too short for windows are read off directly, one comparison of the words with
themselves per lag. Hashes only propose: every run is confirmed on the words.

Texts of a slice are laid one behind the other with separators that equal nothing, so all steps are
vectors over the whole slice whatever the lengths of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import Rows, slices, whole_text

LEAST_WORDS, LEAST_PERIODS = 6, 4
FIRST_SCALE = 3
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_FOLD = np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    return (x ^ (x >> _FOLD)) * _ODD2


def repeats(period: int) -> int:
    """Least number of words equal to the one a period later."""
    return max(LEAST_WORDS, LEAST_PERIODS * period) - period


def is_smallest(ids: np.ndarray, start: int, period: int) -> bool:
    """No proper divisor is a period too. Others cannot be: runs span four periods (Fine and Wilf)."""
    n, divisor = period, 2
    word = ids[start : start + 2 * period]
    while n > 1:
        if divisor * divisor > n:
            divisor = n
        if n % divisor:
            divisor += 1
            continue
        while n % divisor == 0:
            n //= divisor
        d = period // divisor
        if np.array_equal(word[:period], word[d : d + period]):
            return False
    return True


def agreeing(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many places from a and b on (step 1) or back (step -1) hold the same words; a < b."""
    done, size = 0, 64
    while True:
        if step > 0:
            x, y = ids[a + done : a + done + size], ids[b + done : b + done + size]
            x = x[: len(y)]
        else:
            x, y = (ids[max(0, p - done - size + 1) : max(0, p - done + 1)][::-1] for p in (a, b))
            y = y[: len(x)]
        same = x == y
        if not same.all():
            return done + int(same.argmin())
        done += len(x)
        if len(x) < size:
            return done
        size *= 2


def short_runs(ids: np.ndarray, period: int) -> Iterator[tuple[int, int, int]]:
    if len(ids) <= period:
        return
    same = np.zeros(len(ids) - period + 2, np.int8)
    same[1:-1] = ids[period:] == ids[:-period]
    turn = np.diff(same)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    for k in np.flatnonzero(ends - starts >= repeats(period)):
        start = int(starts[k])
        if is_smallest(ids, start, period):
            yield start, int(ends[k]) - start + period, period


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places whose gram is the least of some window; a power of two, ties all count."""
    least, step = grams, 1
    while step < window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    most = np.zeros(len(grams) + window - 1, np.uint64)
    most[window - 1 : window - 1 + len(least)] = least
    step = 1
    while step < window:
        most = np.maximum(most[:-step], most[step:])
        step *= 2
    return np.flatnonzero(most == grams)


def seeds(grams: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(place, period) of neighbouring equal minimizers, by place."""
    chosen = minimizers(grams, window)
    values = grams[chosen]
    order = np.argsort(values, kind="stable")
    values, places = values[order], at[chosen[order]]
    gap = places[1:] - places[:-1]
    hit = np.flatnonzero((values[1:] == values[:-1]) & (gap >= window) & (gap < 2 * window))
    return sorted(zip(places[hit].tolist(), gap[hit].tolist()))


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) over texts laid end to end, each followed by one separator."""
    found = [r for q in range(1, 1 << FIRST_SCALE) for r in short_runs(ids, q)]
    at, grams = np.arange(len(ids)), mixed(ids.astype(np.uint64) + np.uint64(1))
    size_at = np.repeat(sizes, sizes + 1)
    gram, scale = 1, FIRST_SCALE
    longest = int(sizes.max(initial=0))
    while LEAST_PERIODS << scale <= longest:
        window = 1 << scale
        # Shorter texts hold no such run; leaving them out keeps the cost of a scale to what it can find.
        fits = size_at >= LEAST_PERIODS * window
        if fits.mean() < 0.7:
            keep = np.flatnonzero(fits[: len(grams)])
            at, grams, size_at = at[keep], grams[keep], size_at[keep]
        while gram < 2 * window and len(grams) > gram:
            grams = mixed(grams[:-gram] + mixed(grams[gram:]))
            gram *= 2
        if gram < 2 * window or len(grams) < window:
            break
        at, size_at = at[: len(grams)], size_at[: len(grams)]
        until: dict[int, int] = {}
        for place, period in seeds(grams, at, window):
            if place < until.get(period, 0):
                continue
            right = agreeing(ids, place, place + period, 1)
            left = agreeing(ids, place - 1, place + period - 1, -1)
            until[period] = place + right
            if left + right >= repeats(period) and is_smallest(ids, place - left, period):
                found.append((place - left, left + right + period, period))
        scale += 1
    return sorted(found)


class Numbers(dict):
    """Gives every new word the next number."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words that stand in no run behind its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words, by start, then period."""
    look = Numbers()
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for t, n, end in zip(texts, sizes.tolist(), ends.tolist()):
        ids[end - 1 - n : end - 1] = np.fromiter(map(look.__getitem__, t), np.int64, n)
    ids[ends - 1] = len(look) + np.arange(len(ends))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begins = ends - sizes - 1
    for start, length, period in find_runs(ids, sizes):
        k = int(np.searchsorted(ends, start, side="right"))
        out[k].append((start - int(begins[k]), length, period))
    return out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (by start, then period; words numbered from 0) and the collapsed text per row.

    Words are what white space of ASCII separates. Null and empty texts have no words, no run and an
    empty collapsed text; repeated rows and null ids each give their own row; an empty table gives
    none. Texts are read whole, a very long one alone in its slice. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(pa.schema([("doc_id", pa.int64()), ("runs", RUN_TYPE), ("collapsed", pa.string())]))
        for batch in slices(batches, "body"):
            texts = [b.split() for b in batch.column("body").to_pylist()]
            for doc, words, found in zip(batch.column("doc_id").to_pylist(), texts, runs_of(texts)):
                left = collapsed(words, found).decode()
                rows = [{"start": s, "length": n, "period": q} for s, n, q in found]
                if out.add(doc, rows, left, size=64 + len(left) + 24 * len(rows)):
                    yield out.take()
        if len(out):
            yield out.take()

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("body")
    )
    return rows.mapInArrow(run, f"doc_id bigint, runs {RUN}, collapsed string")


def summary(found: DataFrame) -> DataFrame:
    """Counts, the longest run (then earliest, then shortest period) and digests per row."""
    one = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.transform("runs", lambda r: F.concat(one(r), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    start, length, period = -best["start"], best["length"], -best["period"]
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, share: int = 10) -> DataFrame:
    """Texts of one row in ``share``, chosen by a hash of doc_id, repeat a stretch of their own words.

    With h the CRC-32 of the decimal doc_id, n words, g = h div 10, a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8), word i >= a becomes word a + (i - a) mod p. Rows without
    words and with null ids stay as they are.
    """
    text = whole_text()
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", text.alias("text"), h.alias("_h")).withColumn(
        "_w", F.when(F.col("_h") % share == 0, words)
    )
    g, n = F.floor(F.col("_h") / 10), F.size("_w")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    moved = F.transform(
        F.sequence(F.lit(0), (n - 1).cast("int")),
        lambda i: F.get("_w", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")),
    )
    changed = F.when((F.col("_h") % share == 0) & (n > 0), F.array_join(moved, " "))
    return rows.select("doc_id", F.coalesce(changed, "text").alias("text"))
