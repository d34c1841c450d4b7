"""Document quality from a linear-chain conditional random field over lines.

Each line has a few measures (letters, capitals, symbols, bars, repeated words, ...) cut into bins; a
line's score for "good" adds weights for its own bins and those of the lines before and after, and
neighbouring labels have transition weights. Forward-backward gives every line its probability of
being good, and their mean weighted by line length, bent so that one half is the threshold that
splits the training rows best, is the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import folder_table, slices, whole_text
from aisleframe.llm.decontam import PIECE, _parts, _piece_tokens

SAMPLE_ROWS = 4000
STEPS = 120
# Upper edges of the bins of each measure, in the order of ``measures``.
EDGES = (
    (0.5, 0.7, 0.8, 0.9, 0.95, 0.98),  # letters, of the bytes that are not blank
    (0.02, 0.05, 0.1, 0.3, 0.6, 0.9),  # capitals, of the ASCII letters
    (0.01, 0.1, 0.3, 0.6, 0.9),  # bars per word
    (0.01, 0.05, 0.15, 0.3, 0.6),  # symbols, of the bytes that are not blank
    (0.02, 0.1, 0.3, 0.6, 0.9),  # exclamation marks per word
    (0.02, 0.05, 0.1, 0.2, 0.4),  # stops and commas per word
    (0.01, 0.05, 0.2, 0.5),  # digits, of the bytes that are not blank
    (3, 4, 5, 6, 7, 9, 12),  # bytes per word
    (1, 3, 6, 12, 25, 60, 150),  # words
    (0.02, 0.05, 0.1, 0.3, 0.6, 0.9),  # words that equal the one before
    (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),  # distinct words, of the words
    (0.5,),  # ends in a stop
)
BINS = max(map(len, EDGES)) + 1
MEASURES = len(EDGES)

_kind = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 3 digit, 4 bar, 5 exclamation, 6 stop, 7 symbol
_kind[128:] = 1
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2),
                   (b"0123456789", 3), (b"|", 4), (b"!", 5), (b".,;:?", 6), (b"#$%&*@^~=+<>\\_`{}[]/", 7)):
    _kind[list(_chars)] = _k


def measures(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines x measures as bin numbers, line lengths in bytes) of text whose lines all end in a
    newline; at most ``PIECE`` bytes."""
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kind = _kind[data]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[ends] - total[starts]).astype(float)

    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    words, shown = np.maximum(count(begins), 1), np.maximum(count(~blank), 1)
    small, capital = count(kind == 1), count(kind == 2)
    ascii_small = count((kind == 1) & (data < 128))
    last = np.where(ends > starts, data[np.maximum(ends - 1, 0)], 0)
    hashes, at = _piece_tokens(np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8))
    line = np.searchsorted(ends, at)
    n = len(ends)
    tokens = np.maximum(np.bincount(line, minlength=n), 1)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashes, line))
    h, l = hashes[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    values = (
        (small + capital) / shown, capital / np.maximum(capital + ascii_small, 1), count(kind == 4) / words,
        count(kind == 7) / shown, count(kind == 5) / words, count(kind == 6) / words,
        count(kind == 3) / shown, shown / words, words, np.bincount(line, again, n) / tokens,
        np.bincount(l, new, n) / tokens, np.isin(last, list(b".!?")).astype(float),
    )
    bins = np.stack([np.searchsorted(e, v, side="right") for e, v in zip(EDGES, values)], axis=1)
    return bins.astype(np.uint8), ends - starts


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, lengths, lines per text) of all texts. A text has one line at least; lines over a
    megabyte are cut at a blank."""
    bins, lengths, counts = [], [], np.zeros(len(texts), np.int64)
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush():
        nonlocal group, held
        if group:
            data = np.frombuffer(b"".join([p for _, p in group]), np.uint8)
            b, n = measures(data)
            bins.append(b)
            lengths.append(n)
            for i, p in group:
                counts[i] += p.count(b"\n")
        group, held = [], 0

    for i, text in enumerate(texts):
        for part in _parts(text) if len(text) >= PIECE else (text,):
            part = part if part.endswith(b"\n") and len(part) >= PIECE // 2 else part + b"\n"
            if held + len(part) > PIECE:
                flush()
            group.append((i, part))
            held += len(part)
            if held > PIECE:
                flush()
    flush()
    if not bins:
        return np.zeros((0, MEASURES), np.uint8), np.zeros(0, np.int64), counts
    return np.concatenate(bins), np.concatenate(lengths), counts


@dataclass
class Model:
    own: np.ndarray  # measures x bins
    before: np.ndarray
    after: np.ndarray
    bias: float
    moves: np.ndarray  # 2 x 2, from label to label; 1 is good
    cut: float = 0.5

    def line_scores(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log-odds of good of each line before its neighbours' labels speak."""
        k = np.arange(MEASURES)
        s = self.own[k, bins].sum(axis=1) + self.bias
        first = np.zeros(len(bins) + 1, bool)
        first[np.concatenate([[0], np.cumsum(counts)])] = True
        inner = np.flatnonzero(~first[1 : len(bins)]) + 1  # lines with one before in the same text
        s[inner] += self.before[k, bins[inner - 1]].sum(axis=1)
        s[inner - 1] += self.after[k, bins[inner]].sum(axis=1)
        return s


def marginals(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray):
    """Probability of good per line, and per text the expected moves (texts x 2 x 2)."""
    p, pairs = np.zeros(len(scores)), np.zeros((len(counts), 2, 2))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    size = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
    step = np.exp(moves - moves.max())
    for s in np.unique(size[counts > 0]):
        at = np.flatnonzero((size == s) & (counts > 0))
        for low in range(0, len(at), 4096):
            own = at[low : low + 4096]
            n = counts[own]
            t = int(n.max())
            live = np.arange(t)[:, None] < n[None, :]
            where = np.where(live, starts[own][None, :] + np.arange(t)[:, None], 0)
            good = 1 / (1 + np.exp(-np.clip(scores[where], -30, 30)))
            emit = np.stack([1 - good, good], axis=2)
            emit[~live] = 1.0
            fore, back = np.empty_like(emit), np.ones_like(emit)
            fore[0] = emit[0] / emit[0].sum(axis=1, keepdims=True)
            for k in range(1, t):
                a = (fore[k - 1] @ step) * emit[k]
                a /= a.sum(axis=1, keepdims=True)
                fore[k] = np.where(live[k][:, None], a, fore[k - 1])
            for k in range(t - 2, -1, -1):
                b = (back[k + 1] * emit[k + 1]) @ step.T
                b /= b.sum(axis=1, keepdims=True)
                back[k] = np.where(live[k + 1][:, None], b, 1.0)
            both = fore * back
            prob = both[:, :, 1] / both.sum(axis=2)
            p[where[live]] = prob[live]
            if t > 1:
                joint = fore[:-1, :, :, None] * step * (emit * back)[1:, :, None, :]
                joint /= joint.sum(axis=(2, 3), keepdims=True)
                joint[~live[1:]] = 0
                pairs[own] += joint.sum(axis=0)
    return p, pairs


def weighted(p: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of the lines' probabilities by length; blank lines weigh one byte."""
    at = np.repeat(np.arange(len(counts)), counts)
    w = np.maximum(lengths, 1)
    return np.bincount(at, p * w, len(counts)) / np.maximum(np.bincount(at, w, len(counts)), 1)


def train(bins: np.ndarray, lengths: np.ndarray, counts: np.ndarray, good: np.ndarray) -> Model:
    """Penalised likelihood by Adam; every line has its document's label, documents count alike."""
    share = float(np.clip(good.mean() if len(good) else 0.5, 0.01, 0.99))
    shape = (3, MEASURES, BINS)
    size = int(np.prod(shape))
    p = np.zeros(size + 5)
    p[size] = np.log(share / (1 - share))
    at = np.repeat(np.arange(len(counts)), counts)
    if len(np.unique(good)) < 2:
        return Model(*p[:size].reshape(shape), p[size], np.zeros((2, 2)))
    weight = 1.0 / counts[at]
    first = np.zeros(len(bins) + 1, bool)
    first[np.concatenate([[0], np.cumsum(counts)])] = True
    inner = np.flatnonzero(~first[1 : len(bins)]) + 1
    flat = bins + np.arange(MEASURES) * BINS
    same = np.zeros((len(counts), 2, 2))
    same[np.arange(len(counts)), good, good] = counts - 1
    m = v = np.zeros_like(p)
    for step in range(1, STEPS + 1):
        model = Model(*p[:size].reshape(shape), p[size], p[size + 1 :].reshape(2, 2))
        prob, pairs = marginals(model.line_scores(bins, counts), counts, model.moves)
        off = (prob - good[at]) * weight

        def by_bin(rows, values):
            return np.bincount(flat[rows].ravel(), np.repeat(values, MEASURES), MEASURES * BINS)

        grad = np.concatenate([
            by_bin(slice(None), off), by_bin(inner - 1, off[inner]), by_bin(inner, off[inner - 1]),
            [off.sum()], (((pairs - same) / counts[:, None, None]).sum(axis=0)).ravel(),
        ]) / len(counts)
        grad[:size] += 2e-4 * p[:size]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p - 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(*p[:size].reshape(shape), p[size], p[size + 1 :].reshape(2, 2))
    prob, _ = marginals(model.line_scores(bins, counts), counts, model.moves)
    model.cut = best_cut(weighted(prob, lengths, counts), good)
    return model


def best_cut(score: np.ndarray, good: np.ndarray) -> float:
    """Threshold with fewest training errors, the middle of the widest such gap."""
    order = np.argsort(score)
    s, g = score[order], good[order]
    errors = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum((1 - g)[::-1])[::-1], [0]])
    edges = np.concatenate([[0.0], s, [1.0]])
    gap = np.where(errors == errors.min(), np.diff(edges), -1)
    k = int(gap.argmax())
    return float(np.clip((edges[k] + edges[k + 1]) / 2, 0.02, 0.98))


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    bins, lengths, counts = lines_of(texts)
    p, _ = marginals(model.line_scores(bins, counts), counts, model.moves)
    s = weighted(p, lengths, counts)
    return np.where(s < model.cut, 0.5 * s / model.cut, 0.5 + 0.5 * (s - model.cut) / (1 - model.cut))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents for which ``learn`` (a condition on doc_id) holds,
    chosen by a hash of doc_id, one of equal texts. Labels repeated for a document count as bad if
    one of them does."""
    chosen = labels.where("quality is not null and doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    if learn is not None:
        chosen = chosen.where(learn)
    marked = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(
        F.xxhash64("doc_id"), "doc_id"
    ).limit(rows)
    # At most `rows` rows of two numbers: small by construction.
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("body")).join(
        F.broadcast(marked), "doc_id"
    )
    seen = folder_table(got.groupBy(F.xxhash64("body").alias("h")).agg(
        F.first("body").alias("body"), F.min("quality").alias("quality")
    ), "quality_sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", PIECE):
            bins, lengths, counts = lines_of(batch.column("body").to_pylist())
            cut = np.cumsum(counts)[:-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("quality"),
                 pa.array([b.tobytes() for b in np.split(bins, cut)], pa.binary()),
                 pa.array([x.astype("<i8").tobytes() for x in np.split(lengths, cut)], pa.binary())],
                names=["h", "quality", "bins", "lengths"],
            )

    table = seen.select("h", "quality", F.col("body").cast("binary").alias("body")).mapInArrow(
        run, "h bigint, quality int, bins binary, lengths binary"
    ).collect()
    table.sort(key=lambda r: r["h"])
    parts = [np.frombuffer(r["bins"], np.uint8).reshape(-1, MEASURES) for r in table]
    lengths = [np.frombuffer(r["lengths"], "<i8") for r in table]
    good = np.array([int(r["quality"] > 0) for r in table], np.int64)
    if not table:
        return train(np.zeros((0, MEASURES), np.uint8), np.zeros(0), np.zeros(0, np.int64), good)
    return train(np.concatenate(parts), np.concatenate(lengths), np.array([len(p) for p in parts]), good)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher is better) per row.

    Null text is empty; an empty text is one blank line. Repeated rows and null ids each give their own
    row, empty tables none; texts are read whole, lines over a megabyte in parts. Other columns are not
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", PIECE):
            score = score_texts(model, batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"]
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("body")
    )
    return rows.mapInArrow(run, "doc_id bigint, score double")
