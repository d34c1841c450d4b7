"""Secret scans with an incremental blob ledger.

Texts are content-addressed: a blob is named by its SHA-256, whatever path or version holds it. The
ledger has a row for every (blob, rule, version) that was scanned, with what was found. A run ships
every distinct blob once (compressed), scans it only under the rule versions its ledger rows lack,
and joins all findings back to every document that holds the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import Rows, folder_table, slices, whole_text

BASE = ("assign", "access", "hex")
SPAN = "array<struct<kind: string, start: int, end: int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
LEDGER = f"blob binary, rule string, version int, spans {SPAN}"


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1
    hints: tuple[str, ...] = ()  # one of them is in every lower-cased text that matches
    ignore_case: bool = False

    def scan(self, text: str, lowered: str) -> list[tuple[int, int]]:
        if self.hints and not any(h in lowered for h in self.hints):
            return []
        found = re.compile(self.pattern, re.A | (re.I if self.ignore_case else 0)).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


RULES = (
    Rule("assign", 1,
         r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 12, ("passw", "secret", "token", "key"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    # Runs of at least 16 are the runs that [0-9a-f]+ finds, less the short ones.
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("private", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("signed", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyj",)),
)


def blob_name(text=None):
    return F.unhex(F.sha2(whole_text() if text is None else text, 256))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each blob once per task, compressed."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    seen: set[bytes] = set()
    out = Rows(pa.schema([("blob", pa.binary()), ("packed", pa.binary())]))
    for batch in slices(batches, "body"):
        for name, body in zip(batch.column("blob").to_pylist(), batch.column("body").to_pylist()):
            if name in seen:
                continue
            if len(seen) > 500_000:  # forgetting costs a second copy in the shuffle, no more
                seen.clear()
            seen.add(name)
            packed = press.compress(body)
            if out.add(name, packed, size=len(packed) + 64):
                yield out.take()
    if len(out):
        yield out.take()


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows of the blob and rule-version pairs that ``ledger`` lacks: blob, rule, version,
    spans (empty where nothing was found). Null texts are the empty blob."""
    spark = docs.sparkSession
    rows = docs.select(blob_name().alias("blob"), whole_text().cast("binary").alias("body"))
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    current = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")
    # As many rows as there are rules.
    done = (
        ledger.join(F.broadcast(current), ["rule", "version"], "left_semi")
        .groupBy("blob").agg(F.collect_set("rule").alias("done"))
    )
    dealt = (
        rows.mapInArrow(_distinct, "blob binary, packed binary").repartition("blob")
        .join(done, "blob", "left")
        .where(F.coalesce(F.size("done"), F.lit(0)) < len(rules))
        .select("blob", "packed", "done").sortWithinPartitions("blob")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        out = Rows(pa.schema([("blob", pa.binary()), ("rule", pa.string()), ("version", pa.int32()),
                              ("spans", SPAN_TYPE)]))
        before = None
        for batch in slices(batches, "packed"):
            columns = [batch.column(c).to_pylist() for c in ("blob", "packed", "done")]
            for blob, packed, done in zip(*columns):
                if blob == before:
                    continue
                before = blob
                text = unpack.decompress(packed).decode("utf-8", "replace")
                lowered = text.lower()
                for rule in rules:
                    if rule.name in (done or ()):
                        continue
                    got = [{"kind": rule.name, "start": s, "end": e} for s, e in rule.scan(text, lowered)]
                    if out.add(blob, rule.name, rule.version, got, size=96 + 60 * len(got)):
                        yield out.take()
        if len(out):
            yield out.take()

    return dealt.mapInArrow(run, LEDGER)


def extended(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with this run's rows, kept in the shared folder."""
    fresh = folder_table(scan(docs, ledger, rules), "ledger")
    return fresh if ledger is None else ledger.unionByName(fresh)


def findings(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, spans (by start, then rule as listed) per row, from the ledger's rows for ``rules``."""
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    current = docs.sparkSession.createDataFrame(
        [(r.name, r.version) for r in rules], "rule string, version int"
    )
    hits = (
        ledger.where(F.size("spans") > 0).join(F.broadcast(current), ["rule", "version"], "left_semi")
        .select("blob", F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col("s.start").alias("start"), order[F.col("s.kind")].alias("rank"),
            F.col("s.end").alias("end"), F.col("s.kind").alias("kind"),
        ))).alias("s"))
        .select("blob", F.transform("s", lambda x: F.struct(x["kind"], x["start"], x["end"])).alias("spans"))
    )
    # A table of its own, so that the join below can split a blob that very many documents hold.
    hits = folder_table(hits, "findings")
    paths = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blob_name().alias("blob"))
    none = F.array().cast(SPAN)
    return paths.join(hits, "blob", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
