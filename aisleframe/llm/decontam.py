"""Benchmark decontamination with spaced seeds.

A seed is the hash of the tokens that a fixed mask keeps; the positions it ignores may hold other
words. Test and training seeds meet in a hash join whose test side is sent to every task in blocks
of bounded size, so the documents are never shuffled. Around each hit the two texts are laid over
each other and the longest stretch in which at least ``identity`` of the tokens agree is measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import Rows, slices, whole_text

# Kept and ignored positions. Together they find any 15 tokens of which three were replaced.
MASKS = ("11111", "110111", "1101011", "11001011")
OVERLAP = 12
IDENTITY = 0.8
LEAST_TOKENS = 5
BLOCK_TOKENS = 250_000
PIECE = 1 << 20

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the (odd) base and of its inverse modulo 2**64, for one piece."""
    if not _powers:
        inverse = pow(_BASE, -1, 2**64)
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(PIECE + 1, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
        rng = np.random.default_rng(11)
        _powers["byte"] = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    return _powers["up"], _powers["down"]


def _piece_tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the tokens of at most ``PIECE`` bytes: runs of letters and digits; bytes
    above 127 count as letters."""
    up, down = _power_tables()
    word = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_powers["byte"][data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h, starts


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts one after the other, and where each text begins."""
    hashes, bounds, group, held = [], [0], [], 0

    def flush():
        nonlocal group, held
        if not group:
            return
        h, starts = _piece_tokens(np.frombuffer(b"\n".join(group), np.uint8))
        ends = np.cumsum([len(t) + 1 for t in group])
        base = bounds[-1]
        bounds.extend((base + np.searchsorted(starts, ends)).tolist())
        hashes.append(h)
        group, held = [], 0

    for text in texts:
        if len(text) > PIECE:
            flush()
            n = 0
            for part in _parts(text):
                h, _ = _piece_tokens(np.frombuffer(part, np.uint8))
                hashes.append(h)
                n += len(h)
            bounds.append(bounds[-1] + n)
            continue
        if held + len(text) + 1 > PIECE:
            flush()
        group.append(text)
        held += len(text) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(bounds)


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at a blank; a longer run without one is cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            blank = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = blank + 1 if blank > at else end
        yield text[at:end]
        at = end


def seeds(tokens: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(seed hashes, token positions) of one mask; no seed reaches over a text's end."""
    span = len(mask)
    n = len(tokens) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, hash_of(mask), np.uint64)
    factor = _BASE
    for k, keep in enumerate(mask):
        factor = factor * 0xD1342543DE82EF95 % 2**64 | 1
        if keep == "1":
            out += tokens[k : k + n] * np.uint64(factor)
    inside = np.ones(n, bool)
    for b in bounds[1:-1]:
        inside[max(0, b - span + 1) : b] = False
    at = np.flatnonzero(inside)
    return out[at], at


def hash_of(mask: str) -> int:
    return int(mask, 2) * _BASE % 2**64


def longest_stretch(equal: np.ndarray, identity: float) -> tuple[int, int]:
    """(start, end) of the longest stretch that begins and ends with an agreement and in which at
    least ``identity`` agree; the first of equals."""
    gain = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - identity, -identity))])
    # Where a stretch that may reach to a place ends with its last agreement.
    closed = np.concatenate([[0], np.maximum.accumulate(np.where(equal, np.arange(1, len(equal) + 1), 0))])
    best = (0, 0)
    # Starts worth trying have a smaller sum than all before; ends are tried from the right.
    starts = np.flatnonzero(gain[:-1] < np.concatenate([[np.inf], np.minimum.accumulate(gain[:-1])[:-1]]))
    tail = np.maximum.accumulate(gain[::-1])[::-1]
    end = 0
    for s in starts.tolist():
        end = max(end, s)
        while end + 1 < len(gain) and tail[end + 1] >= gain[s] - 1e-9:
            end += 1
        lead = s + int(np.argmax(equal[s:end])) if equal[s:end].any() else end
        if closed[end] - lead > best[1] - best[0]:
            best = (lead, int(closed[end]))
    return best


@dataclass
class Block:
    """A part of the benchmark: sorted seeds with item row and token position, and the item tokens."""

    seeds: np.ndarray
    item: np.ndarray
    at: np.ndarray
    tokens: np.ndarray
    bounds: np.ndarray
    ids: list
    sieve: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[bytes]) -> "Block":
        tokens, bounds = tokens_of(texts)
        found = [seeds(tokens, bounds, m) for m in MASKS]
        value = np.concatenate([f[0] for f in found])
        pos = np.concatenate([f[1] for f in found])
        order = np.argsort(value, kind="stable")
        value, pos = value[order], pos[order]
        item = np.searchsorted(bounds, pos, side="right") - 1
        bits = max(12, int(16 * max(1, len(value))).bit_length())
        sieve = np.zeros(1 << bits, bool)
        sieve[(value & np.uint64(len(sieve) - 1)).astype(np.int64)] = True
        return cls(value, item, pos - bounds[item], tokens, bounds, ids, sieve)

    def find(self, texts: list[bytes], overlap: int, identity: float) -> list[tuple]:
        """(row, item row, tokens of the stretch, of them equal, its start in text and item)."""
        tokens, bounds = tokens_of(texts)
        hits = []
        for mask in MASKS:
            value, pos = seeds(tokens, bounds, mask)
            may = self.sieve[(value & np.uint64(len(self.sieve) - 1)).astype(np.int64)]
            value, pos = value[may], pos[may]
            low = np.searchsorted(self.seeds, value)
            n = np.searchsorted(self.seeds, value, side="right") - low
            again = np.repeat(np.arange(len(value)), n)
            k = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            row = np.searchsorted(bounds, pos[again], side="right") - 1
            hits.append(np.stack([row, self.item[k], pos[again] - bounds[row] - self.at[k]], axis=1))
        out: dict[tuple[int, int], tuple] = {}
        for row, item, shift in np.unique(np.concatenate(hits), axis=0).tolist():
            own = self.tokens[self.bounds[item] : self.bounds[item + 1]]
            text = tokens[bounds[row] : bounds[row + 1]]
            a, b = max(0, -shift), min(len(own), len(text) - shift)
            s, e = longest_stretch(own[a:b] == text[a + shift : b + shift], identity)
            if e - s < min(overlap, max(LEAST_TOKENS, len(own))):
                continue
            same = int((own[a + s : a + e] == text[a + s + shift : a + e + shift]).sum())
            old = out.get((row, item))
            if old is None or (e - s, same) > old[2:4]:
                out[row, item] = (row, item, e - s, same, a + s + shift, a + s)
        return list(out.values())


def blocks(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> Iterator[Block]:
    """The benchmark in parts of about ``block_tokens``, each fetched when it is needed."""
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        F.lower(whole_text()).cast("binary").alias("body"),
    )
    letters = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-letters // (6 * block_tokens)))
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(parts)) == k).collect()
        mine = [r for r in mine if len(r["body"])]
        if mine:
            mine.sort(key=lambda r: (r["item_id"] is None, r["item_id"], bytes(r["body"])))
            yield Block.of([r["item_id"] for r in mine], [bytes(r["body"]) for r in mine])


LEAK = ("doc_id bigint, item_id bigint, overlap_tokens int, equal_tokens int, doc_start int, "
        "item_start int")


def leaks(
    docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, identity: float = IDENTITY,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per document and benchmark item that overlap: the longest stretch, in tokens.

    A stretch counts from ``overlap`` tokens on, or from the whole item if that is shorter; items of
    fewer than five tokens say too little and match nothing. Null texts are empty; repeated rows of
    a document or an item give one row.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.lower(whole_text()).cast("binary").alias("body"),
    )
    out = docs.sparkSession.createDataFrame([], LEAK)
    for block in blocks(benchmark, block_tokens):
        out = out.unionByName(rows.mapInArrow(_search(rows, block, overlap, identity), LEAK))
    best = F.max(F.struct(
        "overlap_tokens", "equal_tokens", (-F.col("doc_start")).alias("d"),
        (-F.col("item_start")).alias("i"),
    )).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.overlap_tokens", "b.equal_tokens",
        (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"),
    )


def _search(rows: DataFrame, block: Block, overlap: int, identity: float):
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[
            (c, pa.int32()) for c in ("overlap_tokens", "equal_tokens", "doc_start", "item_start")]])
        out, probe = Rows(schema), sent.value
        for batch in slices(batches, "body"):
            ids = batch.column("doc_id").to_pylist()
            for row, item, *rest in probe.find(batch.column("body").to_pylist(), overlap, identity):
                if out.add(ids[row], probe.ids[item], *rest):
                    yield out.take()
        if len(out):
            yield out.take()

    return run


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, identity: float = IDENTITY,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """``docs`` without the rows in which a benchmark item is found; one filter per block."""
    for block in blocks(benchmark, block_tokens):
        docs = docs.where(~_holds(docs, block, overlap, identity))
    return docs


def _holds(docs: DataFrame, block: Block, overlap: int, identity: float) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf("boolean")
    def holds(bodies: pd.Series) -> pd.Series:
        texts, out = list(bodies), np.zeros(len(bodies), bool)
        start = held = 0
        for i, t in enumerate([*texts, b""]):
            held += len(t)
            if i == len(texts) or held > 4 * PIECE:
                found = sent.value.find(texts[start : i + 1], overlap, identity)
                out[[start + f[0] for f in found]] = True
                start, held = i + 1, 0
        return pd.Series(out)

    return holds(F.lower(whole_text()).cast("binary"))
