"""The pipeline against a plain pass over the same rows, stage by stage."""

import hashlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aisleframe.llm import decontam, exact_dedup, queries, toxicity
from aisleframe.llm.common import BATCH_BYTES, BATCH_SETTING, forget_tables, tables_left
from aisleframe.llm.simhash import shingles
from tests.llm.test_decontam import brute
from tests.llm.test_duplicates import roots

FOLDER = "/root/testdata/sf0.001"


def plain(docs, toxic, items):
    """doc_ids left after each stage."""
    left = [[d for d in docs if d not in toxic]]
    newest = {}
    for d in left[0]:
        newest[docs[d]] = max(d, newest.get(docs[d], d))
    left.append(sorted(newest.values()))
    sets = {d: set(shingles((docs[d] or "").encode(), 5).tolist()) for d in left[1]}
    link = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = roots(link)
    left.append([d for d in left[1] if root.get(d, d) == d])
    leaked = {d for d, _ in brute([(d, docs[d]) for d in left[2]], items, decontam.OVERLAP, decontam.IDENTITY)}
    left.append([d for d in left[2] if d not in leaked])
    return left


def test_every_stage_keeps_what_a_plain_pass_keeps(spark):
    table = lambda name: queries.table(spark, FOLDER, name)
    docs, columns = table("documents"), table("documents").columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, table("labels"))
    toxic = {r.doc_id for r in toxicity.scored(docs, model).where("predicted = 1").collect()}
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    want = plain(texts, toxic, items)
    assert len(texts) > len(want[0]) > len(want[1]) and len(want[2]) > len(want[3])
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(expected), name
    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    got = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(want[3])
    for r in got:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        text = tok.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_run_applies_the_stages_in_order(spark):
    got = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()}
    docs = queries.table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    assert got == {r.doc_id for r in docs.select("doc_id").collect()} and got
    before = tables_left()
    exact_dedup.keep_owners(docs)
    assert tables_left() > before
    assert forget_tables(spark, before) > 0 and tables_left() == before


def test_stages_take_rows_of_any_kind(spark):
    rows = [(1, None, None, "s", 0), (2, "", "en", None, 0), (3, "", "en", "s", None), (None, "x y z", "en", "s", 1),
            (4, "x y z", "en", "s", 1), (4, "x y z", "en", "s", 1), (5, "w " * 200_000, "en", "s", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).withColumn("fp", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns[-1] == "fp"
    assert {r.doc_id for r in docs.collect()} == {1, 3, 4, 5} - {1}
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER) if "text" in empty.columns else empty
    assert empty.count() == 0


def test_stages_hand_workers_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    none = spark.createDataFrame([], schema)
    wide = spark.range(0, 900, 1, 1).selectExpr("repeat(cast(id as string), 10000) as text")
    before = spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(BATCH_SETTING, before)
            stage(spark, none, FOLDER)
            got = [r.n for r in wide.mapInArrow(sizes, "n bigint").collect()]
            assert len(got) > 2 and max(got) < 1.5 * BATCH_BYTES, name
    finally:
        spark.conf.set(BATCH_SETTING, before)
