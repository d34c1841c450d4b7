"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, digits, plus signs, schemes and account cues in one pass.
From each anchor a local parser walks to both sides and validates what it holds; parsers never go
back over text they have passed, so the work is linear in the text. Positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import Rows, slices, whole_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "login")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
SCHEMES = ("://",)
SPAN = "array<struct<kind: string, start: int, end: int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_number_run = re.compile(r"[0-9 ().+-]+").match
_digits = re.compile(r"[0-9]+").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_iban = re.compile(r"[ :#=.]{0,12}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Z0-9])").match
_account = re.compile(
    r"(?:[ :#=.]|no\b|nr\b|number\b){0,8}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])", re.I | re.A
).match
_login = re.compile(r"[A-Za-z0-9._%+-]{1,64}:[^\s/@:]{1,64}@(?=[A-Za-z0-9])").match
_not_digit = re.compile(r"[^0-9]")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789+":
        found.add_word(c, ("number", 1))
    found.add_word("@", ("at", 1))
    for s in SCHEMES:
        found.add_word(s, ("scheme", len(s)))
    for cue in CUES:
        for form in {cue, cue.title(), cue.upper()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def numbers(text: str, a: int, b: int) -> Iterator[tuple[str, int, int]]:
    """Addresses, cards and phones inside one run of digits and their separators."""
    groups = [(m.start(), m.end()) for m in _digits(text, a, b)]
    k = 0
    while k + 3 < len(groups):
        four = groups[k : k + 4]
        gap = next((j for j in range(3) if four[j + 1][0] != four[j][1] + 1 or text[four[j][1]] != "."), None)
        if gap is not None:
            k += gap + 1
            continue
        if all(small(text[s:e]) for s, e in four):
            yield "ip", four[0][0], four[3][1]
        k += 4
    for m in _card(text, a, b):
        if m.end() - m.start() >= 12:
            digits = _not_digit.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text[a:b]:
        for m in _phone(text, a, b):
            if 9 <= len(_not_digit.sub("", m.group())) <= 15:
                yield "phone", m.start(), m.end()


def iban_holds(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    found = []
    passed = email_end = 0
    for last, (what, width) in anchors.iter(text):
        if what == "number":
            if last >= passed:
                passed = _number_run(text, last).end()
                if passed - last > 6:
                    found += [(s, KINDS.index(k), e) for k, s, e in numbers(text, last, passed)]
        elif what == "at":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _domain(text, last + 1)):
                email_end = m.end()
                found.append((start, 0, email_end))
        elif what == "scheme":
            if m := _login(text, last + 1):
                found.append((m.start(), 6, m.end() - 1))
        else:
            if m := _iban(text, last + 1):
                if iban_holds(m.group(1)):
                    found.append((m.start(1), 4, m.end(1)))
                    continue
            if m := _account(text, last + 1):
                found.append((m.start(1), 5, m.end(1)))
    # Two cues may lead to the same number.
    return sorted(set(found))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (by start, then kind as in KINDS) per row.

    Null and empty texts have none. Repeated rows and null ids each give their own row, empty tables
    none; a very long text is read whole, alone in its slice. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        out = Rows(pa.schema([("doc_id", pa.int64()), ("spans", SPAN_TYPE)]))
        for batch in slices(batches, "body"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                got = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(text, anchors)]
                if out.add(doc, got, size=64 + 60 * len(got)):
                    yield out.take()
        if len(out):
            yield out.take()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("body"))
    return rows.mapInArrow(run, f"doc_id bigint, spans {SPAN}")
