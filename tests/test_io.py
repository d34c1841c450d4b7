"""Sources, sinks and streaming on small folders."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from aisleframe.operators import quality, share
from aisleframe.plans import load_all
from aisleframe.sources import readers, trees, writers
from aisleframe.sources.snapshots import Snapshots, VersionTaken
from aisleframe.streaming import ingest, sessions


def put(path, text=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_class_tree_and_flat_folder(spark, tmp_path):
    put(tmp_path / "kb" / "a_1L_b" / "1.jpg", b"one")
    put(tmp_path / "kb" / "unknown_beverage" / "2.jpg", b"four")
    put(tmp_path / "kb" / "unknown_beverage" / "note.txt")
    put(tmp_path / "kb" / "top.JPG")
    got = {(r["key"], r["label"], r["size"]) for r in readers.class_tree(spark, str(tmp_path / "kb")).collect()}
    assert got == {("a_1L_b/1.jpg", "a_1L_b", 3), ("unknown_beverage/2.jpg", "unknown_beverage", 4)}
    quality.assert_flat_class_tree(readers.class_tree(spark, str(tmp_path / "kb")), str(tmp_path / "kb"))
    assert [r["key"] for r in readers.flat_folder(spark, str(tmp_path / "kb")).collect()] == ["top.JPG"]


def test_predictions_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("c1", "a_1L_b", 0.874, "local"), ("c2", "low_confidence", 0.1, "ocr")],
        "crop string, product string, score double, source string",
    )
    writers.predictions_csv(rows, str(tmp_path / "p"))
    back = readers.predictions(spark, str(tmp_path / "p")).collect()
    assert [tuple(r) for r in back] == [("c1", "a_1L_b", "87%")]
    put(tmp_path / "q.csv", "\nbad,line\nc,unknown,1%\nc,unknown_beverage,50%,llm\n")
    assert [r["product"] for r in readers.predictions(spark, str(tmp_path / "q.csv")).collect()] == ["unknown_beverage"]


def test_share_csv_has_four_decimals(spark, tmp_path):
    p = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "product string, area double")
    writers.share_csv(share.share_of_shelf(p), str(tmp_path / "s"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert "a,2,0.6667,0.6667" in lines and "b,1,0.3333,0.3333" in lines


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("p-0", "p", 0, 3, 100, 60, 5700)],
                                 "crop string, source_photo string, x1 int, y1 int, x2 int, y2 int, area long")
    writers.crop_manifest_csv(rows, str(tmp_path / "m"))
    assert readers.crop_manifest(spark, str(tmp_path / "m")).collect() == rows.collect()


def test_provenance_rewrite(spark, tmp_path):
    path = str(tmp_path / "prov")
    first = spark.createDataFrame([("b/2.jpg", "t3"), ("a/1-12.jpg", "1")], "kb_file string, source_photo string")
    writers.provenance_csv(first, path, datetime(2026, 8, 16, 11, 4, 7))
    got = readers.provenance(spark, path)
    assert {(r["kb_file"], r["source_photo"]) for r in got.collect()} == {("b/2.jpg", "t3"), ("a/1-12.jpg", "1")}
    fixed = got.where("kb_file = 'a/1-12.jpg'").withColumn("source_photo", F.lit("corrected"))
    writers.provenance_csv(fixed, path)
    assert [r["source_photo"] for r in readers.provenance(spark, path).collect()] == ["corrected"]


def test_truth_and_template(spark, tmp_path):
    put(tmp_path / "t.csv", "crop,group\r\na.jpg, g1 \r\nb.jpg,\r\n")
    truth = readers.ground_truth(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in truth.collect()] == [("a.jpg", "g1")]
    crops = spark.createDataFrame([("a.jpg",), ("c.jpg",)], "crop string")
    got = {tuple(r) for r in writers.truth_template(crops, truth).collect()}
    assert got == {("a.jpg", "g1"), ("c.jpg", "")}


def test_review_log(spark, tmp_path):
    put(tmp_path / "r.csv", "timestamp,action,label,source_crop,kb_file,note\n"
        "2026-09-05T09:34:47,add,x,/a,/b,confirmed\n2026-09-05T09:35:19,add,x,/a,/b,corrected from y\n")
    got = {tuple(r) for r in readers.label_corrections(readers.review_log(spark, str(tmp_path / "r.csv"))).collect()}
    assert got == {("add", "x", None, 1), ("add", "x", "y", 1)}


def test_cluster_and_class_folders(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("b", -1)], "crop string, cluster_id long")
    writers.cluster_assignment(rows, str(tmp_path / "c.csv"), str(tmp_path / "c"))
    assert {d for d in os.listdir(tmp_path / "c") if "=" in d} == {"cluster=cluster_0", "cluster=noise"}
    p = spark.createDataFrame([("c1", "a_1L_b"), ("c2", "non_beverage_box")], "crop string, product string")
    writers.predictions_by_class(p, str(tmp_path / "k"))
    assert {d for d in os.listdir(tmp_path / "k") if "=" in d} == {"class=a_1L_b", "class=_skipped_non_beverage"}


def test_discovery_sink(spark, tmp_path):
    rows = spark.createDataFrame(
        [("f1", "verified", "a_b_1L", ["ok"]), ("f2", "unresolved_unknown", None, [])],
        "filename string, status string, label string, evidence array<string>",
    )
    writers.discovery(rows, str(tmp_path / "csv"), str(tmp_path / "json"), str(tmp_path / "out"))
    csv = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv"))
    assert len(csv.columns) == 18
    got = {r["filename"]: (r["evidence"], r["initial_candidate"], r["copied_to"]) for r in csv.collect()}
    assert got == {"f1": ('["ok"]', "{}", "verified/a_b_1L"), "f2": ("[]", "{}", "unresolved_unknown")}
    assert spark.read.json(str(tmp_path / "out")).where("route = 'verified'").count() == 1


def test_session_totals_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "a", 10.0), (1, "a", 20.0), (1, "low_confidence", 5.0), (2, "b", 1.0), (1, "b", 30.0)]
    df = spark.createDataFrame(rows, "session long, product string, area double")
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    totals = sessions.run_to_end(stream, str(tmp_path / "out"))
    got = {(r["session"], r["product"]): (r["facings"], r["share_by_facings"]) for r in sessions.session_shares(totals).collect()}
    assert got == {(1, "a"): (2, 2 / 3), (1, "b"): (1, 1 / 3), (2, "b"): (1, 1.0)}
    # Nothing is left to read, so a second run changes nothing.
    assert sessions.run_to_end(stream, str(tmp_path / "out")).agg(F.sum("done")).first()[0] == 5


def test_pool_stream_embeds_only_new_files(spark, tmp_path):
    put(tmp_path / "img" / "1.jpg", b"one")
    put(tmp_path / "img" / "2.jpg", b"three")
    calls = spark.sparkContext.accumulator(0)

    def embed(rows):
        def run(batches):
            for b in batches:
                calls.add(len(b))
                yield b[["key", "size"]].assign(embedding=[[float(s)] for s in b["size"]])
        return rows.mapInPandas(run, "key string, size long, embedding array<float>")

    for extra in (None, "3.jpg"):
        if extra:
            put(tmp_path / "img" / extra, b"seven77")
        files = ingest.new_files(spark, str(tmp_path / "img"))
        ingest.start_pool_updates(files, str(tmp_path / "pool"), embed, "m", 1).awaitTermination()
    got = {r["key"]: (r["size"], r["embedding"]) for r in ingest.pool(spark, str(tmp_path / "pool")).collect()}
    assert got == {"1.jpg": (3, [3.0]), "2.jpg": (5, [5.0]), "3.jpg": (7, [7.0])}
    assert calls.value == 3


def test_class_tree_lists_without_reading(spark, tmp_path):
    files = spark.createDataFrame([("a/x.jpg", b"123"), ("a/b/y.jpg", b"4"), ("z.png", b"1")], "key string, content binary")
    trees.write_tree(files, str(tmp_path / "t"))
    found = readers.class_tree(spark, str(tmp_path / "t"))
    assert sorted(tuple(r)[1:] for r in found.collect()) == [("a/b/y.jpg", 1, "b"), ("a/x.jpg", 3, "a")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    whole = readers.class_tree(spark, str(tmp_path / "t"), content=True)
    assert {bytes(r.content) for r in whole.collect()} == {b"123", b"4"}
    # A second run of the same rows leaves the same files.
    trees.write_tree(files, str(tmp_path / "t"))
    assert readers.class_tree(spark, str(tmp_path / "t")).count() == 2


def test_committed_versions(spark, tmp_path):
    schema = "key string, size long, model string, version int, embedding array<float>"
    store = Snapshots(spark, str(tmp_path / "pool"), schema)
    assert store.read().count() == 0 and store.versions() == []
    rows = lambda *keys: spark.createDataFrame([(k, 1, "m", 1, [1.0]) for k in keys], schema)
    keys = lambda v=None: sorted(r.key for r in store.read(v).select("key").collect())
    assert store.append(rows("a", "b"), {"batch": 4}) == 1
    reader = store.read()

    # A writer that fails leaves the version as it was, and no data in it.
    broken = F.udf(lambda k: 1 // 0, "long")
    files = rows("c").select("key", "size", "embedding")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        quality.commit_pool(spark, store.folder, files, lambda f: f.withColumn("size", broken("key")), "m", 1)
    assert store.versions() == [1] and keys() == ["a", "b"]

    got = quality.commit_pool(spark, store.folder, files, lambda f: f, "m", 1)
    assert sorted(r.key for r in got.collect()) == keys() == ["a", "b", "c"] and keys(1) == ["a", "b"]
    assert reader.count() == 2 and store.manifest()["marks"] == {"batch": 4}

    # Of two writers with the same parent one is told.
    parent = store.manifest()
    store.append(rows("d"), parent=parent)
    with pytest.raises(VersionTaken):
        store.append(rows("e"), parent=parent)
    assert keys() == ["a", "b", "c", "d"]

    assert store.compact(9) is None and store.compact(1) == 4
    assert len(store.manifest()["folders"]) == 1 and keys() == keys(3) == ["a", "b", "c", "d"]
    store.vacuum(keep=1)
    assert store.versions() == [4] and keys() == ["a", "b", "c", "d"]
    assert not [n for n in os.listdir(tmp_path / "pool" / "versions") if n.endswith(".draft")]


def test_a_replayed_batch_is_committed_once(spark, tmp_path):
    put(tmp_path / "img" / "1.jpg", b"123")
    folder = str(tmp_path / "pool")
    take = lambda f: f.select("key", "size", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    ingest.start_pool_updates(ingest.new_files(spark, str(tmp_path / "img")), folder, take, "m", 1).awaitTermination()
    store = ingest.snapshots(spark, folder)
    before = store.versions()
    # Without its commit mark the stream runs the batch again.
    for name in os.listdir(tmp_path / "pool" / "checkpoint" / "commits"):
        os.remove(tmp_path / "pool" / "checkpoint" / "commits" / name)
    ingest.start_pool_updates(ingest.new_files(spark, str(tmp_path / "img")), folder, take, "m", 1).awaitTermination()
    assert store.versions() == before and ingest.pool(spark, folder).count() == 1


def test_pool_stream_of_another_model_or_checkpoint_gets_every_file(spark, tmp_path):
    put(tmp_path / "img" / "1.jpg", b"one")
    put(tmp_path / "img" / "2.jpg", b"three")
    folder, calls = str(tmp_path / "pool"), spark.sparkContext.accumulator(0)

    def embed(rows):
        def run(batches):
            for b in batches:
                calls.add(len(b))
                yield b[["key", "size"]].assign(embedding=[[float(s)] for s in b["size"]])
        return rows.mapInPandas(run, "key string, size long, embedding array<float>")

    def update(*of, **kw):
        before = calls.value
        ingest.start_pool_updates(ingest.new_files(spark, str(tmp_path / "img")), folder, embed, *of, **kw).awaitTermination()
        return calls.value - before

    assert update("m", 1) == 2 and update("m", 1) == 0
    # The files were seen, but not for this version.
    assert update("m", 2) == 2 and update("m", 2) == 0
    put(tmp_path / "img" / "3.jpg", b"1234567")
    assert update("m", 1) == 1 and update("m", 2) == 1 and update("n/o", 1) == 3
    # All files arrive again: those that the pool holds are not embedded, those that changed are, and count as the latest.
    versions = len(ingest.snapshots(spark, folder).versions())
    assert update("m", 1, checkpoint=f"{folder}/again") == 0
    assert len(ingest.snapshots(spark, folder).versions()) == versions + 1
    (tmp_path / "img" / "1.jpg").write_bytes(b"longer")
    assert update("m", 1, checkpoint=f"{folder}/third") == 1
    got = {(r["key"], r["model"], r["version"]): (r["size"], r["embedding"]) for r in ingest.pool(spark, folder).collect()}
    assert got["1.jpg", "m", 1] == (6, [6.0]) and got["1.jpg", "m", 2] == (3, [3.0]) and len(got) == 9


@pytest.mark.parametrize("one_file", [True, False])
def test_vectors_of_pool_updates_arrive_twice(spark, tmp_path, monkeypatch, one_file):
    rows = spark.createDataFrame([(k, [float(k), 0.5]) for k in range(9)], "vec_id long, embedding array<float>")
    rows.repartition(1 if one_file else 3).write.parquet(str(tmp_path / "in"))
    if one_file:
        (part,) = (tmp_path / "in").glob("part-*.parquet")
        (tmp_path / "embeddings.parquet").write_bytes(part.read_bytes())
    else:
        (tmp_path / "in").rename(tmp_path / "embeddings.parquet")
    runs, start = [], ingest.start_pool_updates

    def spy(files, folder, embed, *a, **kw):
        embedded = []

        def count(rows):
            fresh = embed(rows)
            embedded.append(fresh.count())
            return fresh

        query = start(files, folder, count, *a, **kw)
        query.awaitTermination()
        runs.append((folder, embedded))
        return query

    monkeypatch.setattr(ingest, "start_pool_updates", spy)
    got = load_all().QUERIES["ss02_pool_updates"](spark, str(tmp_path))
    assert {(r["key"], r["size"], r["total"]) for r in got.collect()} == {(str(k), 2, k + 0.5) for k in range(9)}
    # The second run gets a batch, too, and finds nothing in it that the pool lacks.
    (pool, first), (same, second) = runs
    assert pool == same and first == [9] and second == [0]
