"""Chat formatting with prefix-target expansion.

A conversation is written once, as a row per turn with its place in the conversation's formatted
text. Every assistant turn then is an example of its own: the text up to the end of that turn, with
only that reply under the loss mask. As the context is a prefix of the formatted text, an example is
a row of offsets; ``texts`` writes examples out. Turns after the last reply end in one more example
without a target, so nothing is lost.

    <s>role\\n text </s>\\n      (without the blanks shown here)

Control strings inside texts get a backslash behind their first character, those that have
backslashes there one more, which ``unescape`` takes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.llm.common import Rows, slices, whole_text

TARGET_ROLE = "assistant"
CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)"
_escaped = re.compile(r"(<|\[)\\(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)")
_piece = re.compile(r"<s>([^\n]*)\n(.*)</s>\n", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2\3", text)


def _role_line(role: Column) -> Column:
    one_line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(one_line)


def read_role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def pieces(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 0), trainable, piece, start, text_start, text_end, end.

    Offsets are code points in the conversation's formatted text. Turns stand by ``turn`` (null
    first), then role and text; rows that repeat all three are turns of their own. Null role and
    text are empty.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        whole_text("role").alias("role"), whole_text().alias("text"),
    )
    head = F.concat(F.lit("<s>"), _role_line(F.col("role")), F.lit("\n"))
    marked = rows.select(
        "conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body")
    ).select(
        "conv_id", "turn", "role", "text", (F.col("role") == TARGET_ROLE).alias("trainable"),
        F.concat("head", "body", F.lit("</s>\n")).alias("piece"),
        F.length("head").cast("bigint").alias("h"), F.length("body").cast("bigint").alias("b"),
    )
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marked.select(
        "conv_id", (F.row_number().over(w) - 1).cast("bigint").alias("position"), "trainable", "piece",
        F.sum(F.length("piece").cast("bigint")).over(run).alias("end"), "h", "b",
    )
    start = F.col("end") - F.length("piece")
    return placed.select(
        "conv_id", "position", "trainable", "piece", start.alias("start"),
        (start + F.col("h")).alias("text_start"), (start + F.col("h") + F.col("b")).alias("text_end"),
        "end",
    )


def examples(written: DataFrame) -> DataFrame:
    """conv_id, target (position of the reply, null for trailing turns), last (position of the last
    turn), loss_start, loss_end, n_chars: one row per example of ``pieces``."""
    w = Window.partitionBy("conv_id").orderBy("position")
    ends = written.select("*", F.lead("position").over(w).isNull().alias("closing")).where(
        "trainable or closing"
    )
    mine = lambda c: F.when(F.col("trainable"), F.col(c))
    return ends.select(
        "conv_id", mine("position").alias("target"), F.col("position").alias("last"),
        mine("text_start").alias("loss_start"), mine("text_end").alias("loss_end"),
        F.col("end").alias("n_chars"),
    )


def texts(written: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` examples with their formatted text. Contexts repeat: the output grows with the
    square of a conversation's turns, by definition."""
    w, e = written.alias("w"), wanted.alias("e")
    same = F.col("w.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("w.position") <= F.col("e.last"))
    part = F.struct(F.col("w.position").alias("p"), F.col("w.piece").alias("t"))
    return e.join(w, same).groupBy(*[F.col(f"e.{c}") for c in wanted.columns]).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("text")
    )


READ = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint")


def read_back(written: DataFrame, expanded: DataFrame) -> DataFrame:
    """Per conversation what its formatted text and its ``expanded`` examples hold: the turns, parsed
    and unescaped, and the text under the examples' loss masks, as running digests, and the length of
    all examples. Each example is read when the stream has reached its last turn; rows stream by,
    none is kept. No turns give no row."""
    turns = written.select(
        "conv_id", "position", F.lit(0).alias("kind"), "piece", "start",
        F.lit(None).cast("bigint").alias("loss_start"), F.lit(None).cast("bigint").alias("loss_end"),
        F.lit(None).cast("bigint").alias("n_chars"),
    )
    masks = expanded.select(
        "conv_id", F.col("last").alias("position"), F.lit(1).alias("kind"), F.lit("").alias("piece"),
        F.lit(None).cast("bigint").alias("start"), "loss_start", "loss_end", "n_chars",
    )
    held = turns.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = [x.split()[0] for x in READ.split(", ")]
        out = Rows(pa.schema(list(zip(names, types))))
        now = state = None
        said, at = "", 0
        for batch in slices(batches, "piece"):
            for conv, _, example, piece, start, a, b, size in zip(
                *[batch.column(c).to_pylist() for c in held]
            ):
                if state is None or conv != now:
                    if state is not None and out.add(*_closed(now, state), size=300):
                        yield out.take()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if not example:
                    said, at = piece, start
                    role, text = _piece.fullmatch(piece).groups()
                    state[0] += 1
                    state[1].update(f"{read_role(role)}\n{unescape(text)}\n".encode())
                    continue
                state[4] += size
                if a is not None:
                    reply = unescape(said[a - at : b - at])
                    state[2] += len(reply)
                    state[3].update(reply.encode())
        if state is not None:
            out.add(*_closed(now, state))
        if len(out):
            yield out.take()

    dealt = turns.unionByName(masks).repartition("conv_id").sortWithinPartitions("conv_id", "position", "kind")
    return dealt.mapInArrow(run, READ)


def _closed(conv, state) -> tuple:
    n, turns, chars, loss, total = state
    return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total
