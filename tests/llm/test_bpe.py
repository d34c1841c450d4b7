"""Chunked encoding against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aisleframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TINY = {"bits": 3, "least": 4, "most": 24}


def library():
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


def odd_texts(n=400, seed=3):
    rng = random.Random(seed)
    bits = ["a", "B", "'s", "'LL", "é", "É", "ß", "İ", "Σ", "ΑΣ", "<|endoftext|>", "<|end", "7", "12",
            "!!", "。", "漢字", "é", "́", " ", "\x1c", "\x85", "\t", "\n", " ", "  ", " ",
            "👍🏽", "word", "Lorem", "the", "\x00", "…", "½", "Ⅷ", "﻿", "ǅ"]
    out = ["", " ", "x" * 3000, "漢" * 500, "<|endoftext|>" * 20, "a " * 500]
    out += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    return out


@pytest.mark.parametrize("rule", [TINY, {"bits": 5, "least": 16, "most": 200}, {}])
def test_every_text_encodes_and_decodes_as_the_library_does(rule):
    tok, coder = library(), bpe.Encoder(PATH, rule=rule)
    for text in odd_texts():
        want = tok.encode(text, add_special_tokens=False).ids
        ids, names = next(coder.encode_all([text.encode()]))
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert names[:-1].decode() == tok.decode(want, skip_special_tokens=False)


def test_chunks_cover_the_text_and_follow_its_content():
    rng = random.Random(1)
    shared = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(4000))
    texts = ["".join(rng.choices("xyz ", k=k)) + shared for k in (0, 77, 911)]
    parts = [bpe.chunks(t.encode()) for t in texts]
    assert ["".join(p.decode() for p in ps) for ps in parts] == texts
    common = set(parts[0]) & set(parts[1]) & set(parts[2])
    assert sum(map(len, common)) > 0.8 * len(shared)


def test_rows_of_any_kind(spark):
    rows = [(1, None, "u"), (2, "", None), (None, "the the", "v"), (3, "the the", None),
            (3, "the the", None), (4, "abc " * 30000, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.tokens(df, PATH, rule={"bits": 5, "least": 16, "most": 200}).collect()
    tok = library()
    want = sorted((r[0] or -1, len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == want
    assert bpe.tokens(df.limit(0), PATH).count() == 0


def test_shared_chunks_stay_within_their_bound(spark):
    df = spark.createDataFrame([(i, "same words here " * 200) for i in range(9)], "doc_id bigint, text string")
    rows = df.selectExpr("doc_id", "cast(text as binary) as body")
    rule = {"bits": 4, "least": 32, "most": 300}
    got = bpe.shared_chunks(rows, PATH, rule, 700, 50)
    assert got and sum(map(len, got)) <= 700
    assert bpe.tokens(df, PATH, rule).select("ids").distinct().count() == 1


def test_words_of_shared_chunks_are_not_encoded_again():
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(600)).encode() for _ in range(2)]
    plain = bpe.Encoder(PATH)
    shared = {p: plain.plainly(p) for p in bpe.chunks(texts[0])[1:]}
    coder, learnt = bpe.Encoder(PATH, shared), set()
    learn = coder.learn
    coder.learn = lambda words: (learnt.update(words), learn(words))
    assert list(coder.encode_all(texts)) == [plain.plainly(t) for t in texts]
    first, *others = bpe.chunks(texts[0])
    joins = {w for p in [first, *others] for w in (p.split()[0], p.split()[-1])}
    inside = {w for p in others for w in p.split()} - joins - set(first.split()) - set(texts[1].split())
    assert len(shared) > 1 and inside and not inside & learnt and set(texts[1].split()) <= learnt


def test_memory_of_words_is_bounded():
    coder = bpe.Encoder(PATH)
    for k in range(6):
        list(coder.encode_all([" ".join(f"q{i}" for i in range(k * 40_000, (k + 1) * 40_000)).encode()]))
        # Recent words, those of the text at hand among them, and those before.
        assert len(coder.words) + len(coder.older) <= 320_000 and coder.held_bytes <= 12 * 2**20
    assert coder.older
