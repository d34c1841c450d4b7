"""Registered queries over whole tables against plain passes over the same rows."""

import hashlib
import html
import re

import numpy as np
import pytest
from compare import differences
from tokenizers import Tokenizer

import __spark_entry__ as entry
from aisleframe.llm import decontam, pii, queries, secrets
from tests.llm.test_decontam import brute
from tests.llm.test_duplicates import brute_fingerprint, roots
from tests.llm.test_spans import base_pii, base_secrets, check

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in queries.table(spark, FOLDER, "documents").collect()}


def test_all_queries_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert differences(spark, FOLDER, queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_op1(spark, texts):
    items = [(r.item_id, r.text) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    want = brute(list(texts.items()), items, decontam.OVERLAP, decontam.IDENTITY)
    got = {(r.doc_id, r.item_id) for r in queries.op1(spark, FOLDER).collect()}
    assert got == want and want


def test_op2(spark):
    pages = {r.page_id: r.html for r in queries.table(spark, FOLDER, "pages").collect()}
    got = queries.op2(spark, FOLDER).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        body = re.search(r"<article[^>]*>(.*?)</article>", pages[r.page_id], re.S).group(1)
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", body)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br" in p else "", p)).split()) for p in parts]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_op4_and_op8(spark, texts):
    check(queries.op4(spark, FOLDER).collect(), base_secrets, secrets.BASE, {d: base_secrets(t) for d, t in texts.items()})
    check(queries.op8(spark, FOLDER).collect(), base_pii, pii.BASE, {d: base_pii(t) for d, t in texts.items()})


def test_op5(spark, texts):
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    link = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2}
    root = {d: d for d in fps} | roots(link)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5(spark, FOLDER).collect()}
    assert got == {d: (f"{fps[d]:016x}", root[d]) for d in fps}


def test_op10(spark, texts):
    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    got = queries.op10(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
