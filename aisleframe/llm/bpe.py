"""BPE encoding and decoding with content-defined chunks.

A rolling hash over 32 bytes cuts texts where their content says so, hence passages that documents
share become the same chunks wherever they stand. Chunks that recur are encoded once: those that
save most bytes in a job of their own whose result (bounded bytes) every task gets, the others once
per task while they stay in its memory. Where two chunks meet inside a word, the words around the
join are encoded anew and spliced in, over more and more words until both sides agree exactly with
what their chunks hold before and after.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import Rows, slices, small_batches, whole_text

GEAR = np.random.default_rng(17).integers(0, 2**32, 256, dtype=np.uint32)
MASK_BITS = 11  # chunks of 2 KB on average
LEAST, MOST = 256, 16384
# Text of the chunks that are encoded ahead for all tasks, and their number.
SHARED_BYTES = 8 * 1024 * 1024
SHARED_CHUNKS = 16384
# What one task keeps: chunk results, and recent words with their pieces (those before are as many).
TASK_BYTES = 8 * 1024 * 1024
TASK_WORDS = 120_000
# Text that is encoded together, and results gathered before they leave a task.
TEXT_BYTES = 1024 * 1024
LEAVE_BYTES = 2 * 1024 * 1024

# The pattern by which the tokenizer cuts words.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = b" \t\n\r\x0b\x0c"


def _byte_letters() -> list[str]:
    """Printable stand-in of every byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash: byte values from a fixed table, shifted one bit for each byte that follows, so the
    last 32 bytes count. Built by doubling the window instead of byte by byte."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def cuts(text: bytes, bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Chunk ends. Every chunk holds white space unless the whole text has none."""
    n = len(text)
    if n <= least:
        return [n]
    data = np.frombuffer(text, np.uint8)
    h = rolling(data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = (data & 0xC0) != 0x80
    starts = np.append(starts[1:], True)  # a character begins after this byte
    marks = np.flatnonzero(h < np.uint32(1 << (32 - bits))) + 1
    marks = marks[starts[marks - 1]]
    blanks = np.flatnonzero(blank)
    out, last = [], 0
    for end in [*marks.tolist(), n]:
        while end - last > most:
            # No mark for long: cut at a fixed distance, on a character.
            at = last + most
            while not starts[at - 1]:
                at += 1
            k = int(np.searchsorted(blanks, last))
            if k == len(blanks):
                break
            at = max(at, int(blanks[k]) + 1)
            if at >= end:
                break
            out.append(at)
            last = at
        if end - last < least and end < n:
            continue
        k = int(np.searchsorted(blanks, last))
        if end < n and (k == len(blanks) or blanks[k] >= end):
            continue
        out.append(end)
        last = end
    # The end of the text without white space belongs to the chunk before.
    if len(out) > 1:
        k = int(np.searchsorted(blanks, out[-2]))
        if k == len(blanks):
            out.pop(-2)
    return out


def chunks(text: bytes, **rule) -> list[bytes]:
    ends = cuts(text, **rule)
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Encoder:
    """Library tokenizer with memories for words and chunks. Results are (ids, tokens): ids as
    little-endian 32-bit bytes, tokens each followed by a space."""

    def __init__(self, path: str, shared: dict | None = None, rule: dict | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.names = [(self.tok.id_to_token(i) or "").encode() + b" "
                      for i in range(self.tok.get_vocab_size())]
        self.letters = _byte_letters()
        self.find = regex.compile(PIECES).findall
        # Letters for which library, regex module and Python agree in case and class.
        self.plain = regex.compile(r"[\x21-\x7eÀ-ɏ]*").fullmatch
        self.rule, self.shared = rule or {}, shared or {}
        # Recent words and those before; what is asked for again moves to the recent ones.
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held: dict[bytes, tuple[bytes, bytes]] = {}
        self.held_bytes = 0

    def named(self, ids: bytes) -> tuple[bytes, bytes]:
        names = self.names
        return ids, b"".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def learn(self, words: set[bytes]) -> None:
        """Bring words into memory, those that are not there by encoding them."""
        known, older = self.words, self.older
        fresh, odd = {}, []
        for w in words:
            if w in known:
                continue
            ids = older.get(w)
            if ids is not None:
                known[w] = ids
                continue
            s = w.decode("utf-8", "replace")
            if b"<|" in w or not self.plain(s):
                odd.append((w, s))
            else:
                fresh[w] = self.find(unicodedata.normalize("NFC", s).lower())
        model, letters, coded = self.tok.model, self.letters, {}
        for piece in {p for ps in fresh.values() for p in ps}:
            got = model.tokenize("".join([letters[b] for b in piece.encode()]))
            coded[piece] = b"".join([t.id.to_bytes(4, "little") for t in got])
        for w, pieces in fresh.items():
            known[w] = coded[pieces[0]] if len(pieces) == 1 else b"".join([coded[p] for p in pieces])
        if odd:
            whole = self.tok.encode_batch_fast([s for _, s in odd], add_special_tokens=False)
            for (w, _), e in zip(odd, whole):
                known[w] = np.array(e.ids, "<u4").tobytes()
        if len(known) > TASK_WORDS:
            self.older, self.words = known, {w: known[w] for w in words}

    def plain_ids(self, text: bytes) -> bytes:
        """White space parts words for this tokenizer, so a text is its words in turn."""
        words = text.split()
        try:
            return b"".join([self.words[w] for w in words])
        except KeyError:
            self.learn(set(words))
            return b"".join([self.words[w] for w in words])

    def plainly(self, text: bytes) -> tuple[bytes, bytes]:
        return self.named(self.plain_ids(text))

    def chunk(self, body: bytes) -> tuple[bytes, bytes]:
        got = self.shared.get(body) or self.held.get(body)
        if got is None:
            got = self.plainly(body)
            if self.held_bytes > TASK_BYTES:
                self.held, self.held_bytes = {}, 0
            self.held[body] = got
            self.held_bytes += len(body) + len(got[0]) + len(got[1]) + 200
        return got

    def encode_all(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Results of a slice of texts. Chunks are looked up first; only words of chunks without a
        result, and those at joins, are learnt, all of the slice together."""
        cut = [chunks(t, **self.rule) for t in texts]
        missed, words = set(), set()
        for parts in cut:
            missed.update(p for p in parts if p not in self.shared and p not in self.held)
            for left, right in zip(parts, parts[1:]):
                if left[-1] not in SPACES and right[0] not in SPACES:
                    tail, head = left.rsplit(None, 1)[-1], right.split(None, 1)[0]
                    words.update((tail, head, tail + head))
        for p in missed:
            words.update(p.split())
        self.learn(words)
        return map(self.encode, cut)

    def join(self, left: bytes, right: bytes, a: tuple, b: tuple):
        """What the end of ``a`` and the start of ``b`` hold of the words around the join, and what
        these words encode to together; None when no number of words agrees."""
        words = 1
        while True:
            before, after = left.rsplit(None, words), right.split(None, words)
            if len(before) <= words or len(after) <= words:
                return None if words > 1 else self._edge(left, right, a, b, before, after)
            tail, head = left[len(before[0]) :], right[: len(right) - len(after[-1])]
            t, h = self.plainly(tail), self.plainly(head)
            if a[0].endswith(t[0]) and b[0].startswith(h[0]):
                return t, h, self.plainly(tail + head)
            words *= 2

    def _edge(self, left, right, a, b, before, after):
        """A chunk of one word, with the white space it holds, is taken whole."""
        tail = left[len(before[0]) :] if len(before) > 1 else left
        head = right[: len(right) - len(after[-1])] if len(after) > 1 else right
        t, h = self.plainly(tail), self.plainly(head)
        if a[0].endswith(t[0]) and b[0].startswith(h[0]):
            return t, h, self.plainly(tail + head)
        return None

    def encode(self, parts: list[bytes]) -> tuple[bytes, bytes]:
        """The text whose chunks ``parts`` are."""
        coded = [self.chunk(p) for p in parts]
        if len(parts) == 1:
            return coded[0]
        ids, names = [], []
        from_id = from_name = 0
        for k, (part, (i, n)) in enumerate(zip(parts, coded)):
            to_id, to_name, between = len(i), len(n), None
            if k + 1 < len(parts) and part[-1] not in SPACES and parts[k + 1][0] not in SPACES:
                got = self.join(part, parts[k + 1], (i, n), coded[k + 1])
                if got is None:
                    return self.plainly(b"".join(parts))
                t, h, between = got
                to_id, to_name = to_id - len(t[0]), to_name - len(t[1])
            if to_id < from_id:  # both joins of a chunk claim the same words
                return self.plainly(b"".join(parts))
            ids.append(i[from_id:to_id])
            names.append(n[from_name:to_name])
            from_id = from_name = 0
            if between is not None:
                ids.append(between[0])
                names.append(between[1])
                from_id, from_name = len(h[0]), len(h[1])
        return b"".join(ids), b"".join(names)


def _counted(rule: dict, flush: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: dict[int, list[int | None]] = {}

        def leave():
            keys = np.fromiter(seen, np.uint64, len(seen)).view(np.int64)
            columns = [pa.array(c, pa.int64()) for c in zip(*seen.values())]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), *columns], names=["h", "n", "size", "doc_id", "start"]
            )

        for batch in slices(batches, "body"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                start = 0
                for part in chunks(text, **rule):
                    got = seen.get(h := xxhash.xxh3_64_intdigest(part))
                    if got is None:
                        seen[h] = [1, len(part), doc, start]
                    else:
                        got[0] += 1
                    start += len(part)
            if len(seen) > flush:
                yield leave()
                seen = {}
        if seen:
            yield leave()

    return run


def shared_chunks(
    rows: DataFrame, path: str, rule: dict, most_bytes: int, most_chunks: int
) -> dict[bytes, tuple[bytes, bytes]]:
    """Results of the recurring chunks that save most; at most ``most_bytes`` of their text."""
    counts = rows.mapInArrow(_counted(rule), "h bigint, n bigint, size bigint, doc_id bigint, start bigint")
    place = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "start")))
    recur = counts.groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size"), place.alias("at"))
    best = (
        recur.where("n > 1 and at is not null").orderBy(F.desc(F.expr("(n - 1) * size")), "h").limit(most_chunks)
        .select("h", "size", "at.*").collect()
    )
    wanted, held = {}, 0
    for r in best:
        if held + r["size"] <= most_bytes:
            wanted.setdefault(r["doc_id"], []).append((r["start"], r["size"], r["h"] % 2**64))
            held += r["size"]
    if not wanted:
        return {}

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The wanted chunks, taken where they were counted; rows that repeat an id may hold others."""
        import xxhash

        seen: set[bytes] = set()
        for batch in slices(batches, "body"):
            ids, column = batch.column("doc_id").to_pylist(), batch.column("body")
            for k, doc in enumerate(ids):
                for start, size, h in wanted.get(doc, ()):
                    part = column[k].as_py()[start : start + size]
                    if xxhash.xxh3_64_intdigest(part) == h:
                        seen.add(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary())], names=["body"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, rule=rule)
        out = Rows(pa.schema([("body", pa.binary()), ("ids", pa.binary()), ("names", pa.binary())]), LEAVE_BYTES)
        for batch in batches:
            for body in batch.column("body").to_pylist():
                ids, names = encoder.plainly(body)
                if out.add(body, ids, names, size=len(body) + len(ids) + len(names)):
                    yield out.take()
        if len(out):
            yield out.take()

    distinct = rows.mapInArrow(bodies, "body binary").distinct()
    got = distinct.mapInArrow(coded, "body binary, ids binary, names binary").collect()
    return {bytes(r["body"]): (bytes(r["ids"]), bytes(r["names"])) for r in got}


def tokens(
    docs: DataFrame, path: str, rule: dict | None = None, shared_bytes: int = SHARED_BYTES,
    shared_count: int = SHARED_CHUNKS,
) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), decoded per row; null text counts as empty.

    ``path`` is the tokenizer file of a word-end BPE whose words are parted by white space and which
    has no decoder: its decoded text is its tokens with a space between. Empty texts have no tokens;
    repeated rows and null ids each give their own row, empty tables none; a very long text is read
    whole, alone in its slice. Other columns are not read.
    """
    rule = rule or {}
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("body")
    )
    shared = shared_chunks(rows, path, rule, shared_bytes, shared_count) if shared_bytes else {}
    sent = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, sent.value, rule)
        out = Rows(pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                              ("ids", pa.binary()), ("decoded", pa.string())]), LEAVE_BYTES)
        for batch in slices(batches, "body", TEXT_BYTES):
            coded = encoder.encode_all(batch.column("body").to_pylist())
            for doc, (ids, names) in zip(batch.column("doc_id").to_pylist(), coded):
                if out.add(doc, len(ids) // 4, ids, names[:-1].decode(), size=len(ids) + len(names)):
                    yield out.take()
        if len(out):
            yield out.take()

    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")
