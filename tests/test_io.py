"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from framelake.sources import readers
from framelake.streaming import shots


def test_inverted_index_round_trip(spark, tmp_path):
    occ = {"scene": 1, "frame": 5, "video_path": "v", "frame_time": 0.2, "start_time": 0.0, "end_time": 2.0, "confidence": 0.9, "model_name": "m"}
    (tmp_path / "i.json").write_text(json.dumps({"dog": [occ, {**occ, "scene": 2}], "cat": []}))
    rows = readers.inverted_index_json(spark, str(tmp_path / "i.json"))
    assert [(r.key, r.scene) for r in rows.orderBy("scene").collect()] == [("dog", 1), ("dog", 2)]
    readers.write_inverted_index(rows, str(tmp_path / "out"))
    assert [len(r.occurrences) for r in spark.read.json(str(tmp_path / "out")).collect()] == [2]


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"text": "x", "chunks": [{"text": " hi ", "timestamp": [None, 2.5]}, {"text": "  ", "timestamp": [2.5, 3.0]}]}))
    assert [(r.text, r.start, r.end) for r in readers.transcripts_json(spark, str(tmp_path / "t.json")).collect()] == [("hi", 0.0, 2.5)]


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('sentence1,sentence2,score\n"a, b",c,5\nc,d,\nd,a,0.5\n')
    rows = readers.sts_pairs(spark, str(tmp_path / "s.csv"))
    assert sorted((r.sentence1, r.score) for r in rows.collect()) == [("a, b", 1.0), ("d", 0.0)]
    assert [(r.id, r.sentence) for r in readers.distinct_sentences(rows).orderBy("id").collect()] == [(0, "a"), (1, "a, b"), (2, "c"), (3, "d")]


def test_voc_xml(spark, tmp_path):
    box = "<bndbox><xmin>{}</xmin><ymin>2</ymin><xmax>9</xmax><ymax>8</ymax></bndbox>"
    (tmp_path / "a.xml").write_text("<annotation><filename>a.jpg</filename><size><width>10</width><height>20</height></size>" + "".join(f"<object><name>{n}</name><difficult>{k}</difficult>{box.format(x)}</object>" for n, k, x in (("Dog", 0, 1), ("cat", 1, 9))) + "</annotation>")
    rows = readers.voc_xml(spark, str(tmp_path / "a.xml"), shift=-1).orderBy("pos").collect()
    assert [(r.label, r.difficult, r.box.x1, r.width) for r in rows] == [("dog", False, 0.0, 10), ("cat", True, 8.0, 10)]
    assert readers.voc_xml(spark, str(tmp_path / "a.xml"), keep_degenerate=False).count() == 1


def test_vrd_json(spark, tmp_path):
    side = lambda c, *b: {"category": c, "bbox": list(b)}
    rels = [{"predicate": 0, "subject": side(0, 1, 2, 3, 4), "object": side(1, 5, 6, 7, 8)}, {"predicate": 1, "subject": side(1, 5, 6, 7, 8), "object": side(0, 1, 2, 3, 4)}, {"predicate": 9, "subject": side(0, 1, 2, 3, 4), "object": side(1, 0, 1, 0, 1)}]
    (tmp_path / "v.json").write_text(json.dumps({"f.jpg": rels}))
    objects, links = readers.vrd_json(spark, str(tmp_path / "v.json"), ["man", "dog"], ["on", "near"])
    assert [(r.idx, r.label, r.box.x1, r.box.y1) for r in objects.orderBy("idx").collect()] == [(0, "man", 3.0, 1.0), (1, "dog", 7.0, 5.0)]
    assert [(r.subject_idx, r.predicate, r.object_idx) for r in links.orderBy("pos").collect()] == [(0, "on", 1), (1, "near", 0)]


def test_text_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("0\t10\n11 20\nbad line here\nx y\n")
    assert sorted((r.start, r.end) for r in readers.scene_truth(spark, str(tmp_path / "s.txt")).collect()) == [(0, 10), (11, 20)]
    (tmp_path / "g.txt").write_text("cat 1 2\ndogs 3 4\nbad 1\n")
    words = readers.word_vectors(spark, str(tmp_path / "g.txt"), 2)
    t = spark.createDataFrame([(1, ["cat", "dog"]), (2, ["catsx"]), (3, ["zzz"])], "k int, words array<string>")
    got = {r.k: r.v for r in readers.embedded(t, words, "k", 2).collect()}
    assert got[1] == [2.0, 3.0] and got[2] == [1.0, 2.0] and len(got[3]) == 2
    (tmp_path / "m.txt").write_text("b\na\nd\nc\n")
    assert [r.value for r in readers.manifest(spark, str(tmp_path / "m.txt"), 1, 2).collect()] == ["b", "c"]
    files = spark.createDataFrame([("a.MP4",), ("b.txt",)], "path string")
    assert [r.path for r in readers.accepted_uploads(files).collect()] == ["a.MP4"]


def test_mpeg7(spark, tmp_path):
    seg = "".join(f"<VideoSegment><MediaTime><MediaTimePoint>T00:00:0{s}:0F25</MediaTimePoint></MediaTime></VideoSegment>" for s in (0, 2, 4))
    (tmp_path / "m.xml").write_text(f"<Mpeg7>{seg}</Mpeg7>")
    assert sorted(r.frame for r in readers.mpeg7_cuts(spark, str(tmp_path / "m.xml")).collect()) == [50, 100]


def test_models_and_postings(spark, tmp_path):
    readers.save_model(str(tmp_path / "m"), idf=spark.createDataFrame([("a", 1.0)], "term string, idf double"))
    assert readers.load_model(spark, str(tmp_path / "m"), "idf")["idf"].first().term == "a"
    readers.save_postings(spark.createDataFrame([(1, 0), (2, 1)], "vec_id long, l2 int"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("l2 = 1").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from framelake.operators import sequences
    from framelake.sources import catalog

    frames = catalog.frame_scores(spark, "/root/testdata/sf0.01").where("video < 12").withColumn("part", (F.col("frame") / 30).cast("int")).cache()
    for p in range(frames.agg(F.max("part")).first()[0] + 1):
        frames.where(F.col("part") == p).select(F.col("video"), "frame", "score").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video long, frame int, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = shots.stream_cuts(stream).writeStream.format("memory").queryName("cuts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    want = sequences.adaptive_cuts(frames, "video").select("video", F.explode("cuts").alias("frame"))
    assert sorted(map(tuple, spark.table("cuts").collect())) == sorted(map(tuple, want.collect()))


def test_append_and_vector_store(spark, tmp_path):
    from framelake.sources import store

    store.append(spark.range(3), str(tmp_path / "rows"))
    store.append(spark.range(3, 5), str(tmp_path / "rows"))
    assert sorted(x.id for x in spark.read.parquet(str(tmp_path / "rows")).collect()) == [0, 1, 2, 3, 4]

    path, schema = str(tmp_path / "vectors"), "vec_id long, v array<double>, meta map<string,string>"
    s = store.VectorStore(spark, path)
    with pytest.raises(ValueError):
        s.query(spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, q array<double>"), 1)
    s.add(spark.createDataFrame([(1, [1.0, 0.0], {"a": "x"}), (2, [0.0, 2.0], {"a": "y"})], schema))
    s.add(spark.createDataFrame([(2, [3.0, 0.1], {"a": "z"})], schema))
    s.add(spark.createDataFrame([], schema))
    with pytest.raises(ValueError):
        s.add(spark.createDataFrame([(3, [1.0, 0.0, 0.0], None)], schema))
    again = store.VectorStore(spark, path)
    got = again.query(spark.createDataFrame([(7, [5.0, 0.0])], "query_id long, q array<double>"), 5)
    assert [(x.rank, x.vec_id, x.meta["a"]) for x in got.orderBy("rank").collect()] == [(1, 1, "x"), (2, 2, "z")]
    with pytest.raises(ValueError):
        again.query(spark.createDataFrame([(7, [5.0])], "query_id long, q array<double>"), 5)


def test_training_triples(spark, tmp_path):
    from framelake.sources import readers

    (tmp_path / "t.csv").write_text('anchor,positive,negative\n"a, ""b""",p,\nx,y,z\n')
    got = {tuple(x) for x in readers.training_triples(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {('a, "b"', "p", ""), ("x", "y", "z")}
