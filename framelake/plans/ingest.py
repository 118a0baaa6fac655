"""Ingest and evaluation queries: joins with videos, listings, negatives, pooling, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import vectors
from framelake.operators import clusters, indexing, ingest, lexical, reading
from framelake.plans import indexing as postings
from framelake.sources import catalog as c
from framelake.streaming import shots

r = F.round


def segments_with_videos(spark, d):
    rows = c.chunks(spark, d).withColumn("video", (F.col("video") % 25).cast("int")).withColumn("text", F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")))
    return ingest.segments_with_videos(rows, c.videos(spark, d)).select("video", "turn", "file_name", F.length("text").alias("n"))


SEGMENTS_SQL = c.sql("SELECT c.video % 25 AS video, turn, file_name, length(text) AS n FROM chunks c JOIN videos v ON c.video % 25 = v.id WHERE turn % 3 <> 1 AND trim(text) <> ''", "chunks", "videos")


def zip_detections(spark, d):
    """Frames of a video beside its detections, by place."""
    f = c.frame_scores(spark, d).where("frame % 2 = 0").select("video", "frame")
    x = c.detections(spark, d).select(F.col("image").alias("video"), "det_id")
    return ingest.zipped(f, x, "video", "frame", "det_id").select("video", "pos", "frame", "det_id")


ZIP_SQL = c.sql("""+a AS (SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY frame) - 1 AS pos FROM frames WHERE frame % 2 = 0), b AS (SELECT image AS video, det_id, row_number() OVER (PARTITION BY image ORDER BY det_id) - 1 AS pos FROM boxes)
SELECT video, pos, frame, det_id FROM a JOIN b USING (video, pos)""", "frames", "boxes")  # fmt: skip


def annotations_with_images(spark, d):
    images = c.detections(spark, d).where("image % 3 <> 0").groupBy("image").agg(F.max("score").alias("best"))
    return ingest.annotated(c.truths(spark, d), images, "image").select("image", "gt_id", r("best", 6).alias("best"))


ANNOTATED_SQL = c.sql("SELECT image, gt_id, round(best, 6) AS best FROM gt JOIN (SELECT image, max(score) AS best FROM boxes WHERE image % 3 <> 0 GROUP BY image) USING (image)", "boxes", "gt")


def images_with_truth(spark, d):
    """Images whose annotation exists, too."""
    return ingest.with_files(c.detections(spark, d).select("image").distinct(), c.truths(spark, d), "image")


FILES_SQL = c.sql("SELECT DISTINCT image FROM boxes SEMI JOIN gt USING (image)", "boxes", "gt")


def hardest_negatives(spark, d):
    """Of each class the hundred best detections that are no truth."""
    x = c.detections(spark, d).join(c.truths(spark, d).select(F.col("gt_id").alias("det_id")), "det_id", "left_anti")
    return ingest.hardest(x, "label", 100).select("label", "rank", "det_id", r("score", 6).alias("score"))


HARDEST_SQL = c.sql("SELECT label, CAST(rank AS INTEGER) AS rank, det_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, det_id) AS rank FROM boxes WHERE det_id NOT IN (SELECT gt_id FROM gt)) WHERE rank <= 100", "boxes", "gt")


def first_video(spark, d):
    return ingest.first_row(c.videos(spark, d), "file_name")


def distinct_boxes(spark, d):
    x = c.detections(spark, d)
    return ingest.distinct_boxes(x.union(x), "image")


def value_cdf(spark, d):
    return ingest.empirical_cdf(c.base(spark, d, "lineitem"), "l_returnflag", "l_quantity").select("l_returnflag", "l_quantity", r("p", 6).alias("p"))


CDF_SQL = "SELECT DISTINCT l_returnflag, l_quantity, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 6) AS p FROM lineitem WHERE l_quantity IS NOT NULL"


def layer_counts(spark, d):
    """Nodes of each layer of a graph whose levels halve."""
    level = F.size(F.filter(F.sequence(F.lit(1), F.lit(20)), lambda i: F.col("vec_id") % F.pow(F.lit(4.0), i).cast("long") == 0))
    return clusters.layer_counts(c.base(spark, d, "embeddings").where("vec_id > 0").withColumn("level", level))


LAYER_SQL = "WITH l AS (SELECT len(list_filter(range(1, 21), lambda i: vec_id % CAST(pow(4, i) AS BIGINT) = 0)) AS level FROM embeddings WHERE vec_id > 0) SELECT CAST(layer AS INTEGER) AS layer, count(*) AS nodes FROM (SELECT unnest(range(level + 1)) AS layer FROM l) GROUP BY layer"


def sparse_vectors(spark, d):
    w = c.occurrences(spark, d).groupBy(F.col("scene").alias("doc_id"), F.col("video_id").alias("idx")).agg(F.count("*").cast("double").alias("weight"))
    v = lexical.sparse_map(w)
    return v.select("doc_id", F.size("vector").alias("n"), F.aggregate(F.transform(F.map_entries("vector"), lambda e: e["key"] * e["value"]), F.lit(0.0), lambda s, x: s + x).alias("s"))


SPARSE_SQL = c.sql("+w AS (SELECT scene AS doc_id, video_id AS idx, count(*) AS n FROM occ GROUP BY ALL) SELECT doc_id, CAST(count(*) AS INTEGER) AS n, CAST(sum(idx * n) AS DOUBLE) AS s FROM w GROUP BY doc_id", "occ")


def neighbour_quads(spark, d):
    b, p = F.col("box"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    q = F.array(p(b["x1"], b["y1"]), p(b["x2"], b["y1"]), p(b["x2"], b["y2"]), p(b["x1"], b["y2"]))
    out = reading.neighbour_quads(c.detections(spark, d).select("image", F.col("det_id").alias("pos"), q.alias("q")), "image")
    return out.select("image", "pos", *[F.col("quad")[k][v].alias(f"{v}{k}") for k in range(4) for v in "xy"])


QUADS_SQL = c.sql("""+n AS (SELECT image, det_id AS pos, (x1 + x2) / 2 AS x, y1, y2, lead((x1 + x2) / 2) OVER w AS nx, lead(y1) OVER w AS ny1, lead(y2) OVER w AS ny2 FROM boxes WINDOW w AS (PARTITION BY image ORDER BY det_id))
SELECT image, pos, x AS x0, y1 AS y0, nx AS x1, ny1 AS y1, nx AS x2, ny2 AS y2, x AS x3, y2 AS y3 FROM n WHERE nx IS NOT NULL""", "boxes")  # fmt: skip


def _vectors(spark, d):
    return c.base(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def top_classes(spark, d):
    """The three best classes of each vector, read as scores of its dimensions."""
    scores = F.transform("v", lambda x, i: F.struct(x.alias("p"), i.alias("class")))
    rows = _vectors(spark, d).select("vec_id", F.posexplode(reading.top_classes(scores, 3)).alias("rank", "x"))
    return rows.select("vec_id", "rank", F.col("x.class").alias("class"), r(-F.col("x.m"), 6).alias("p"))


TOP_SQL = """WITH f AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, i) - 1 AS rank FROM f)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(i AS INTEGER) AS class, round(CAST(e AS DOUBLE), 6) AS p FROM s WHERE rank < 3"""


def softmax(spark, d):
    p = _vectors(spark, d).select("vec_id", vectors.softmax(F.col("v")).alias("p"))
    return p.select("vec_id", r(F.array_max("p"), 6).alias("top"), r(F.array_min("p"), 6).alias("low"))


SOFTMAX_SQL = "WITH f AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS e FROM embeddings) SELECT vec_id, round(exp(max(e)) / sum(exp(e)), 6) AS top, round(exp(min(e)) / sum(exp(e)), 6) AS low FROM f GROUP BY vec_id"


def pooled(spark, d):
    """Eight token vectors of eight numbers from each embedding, every third masked."""
    at = lambda x, i: F.slice(x, i * 8 + 1, 8)
    rows = _vectors(spark, d).where(F.size("v") == 64).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: at(F.col("v"), i)).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i % 3).alias("m"))
    rows = rows.select("vec_id", vectors.pooled(F.col("t"), F.col("m")).alias("mean"), vectors.pooled(F.col("t"), F.col("m"), "max").alias("max"))
    return rows.select("vec_id", F.posexplode(F.arrays_zip("mean", "max")).alias("dim", "x")).select("vec_id", "dim", r("x.mean", 6).alias("mean"), F.col("x.max").alias("max"))


POOLED_SQL = """WITH f AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE len(embedding) = 64)
SELECT vec_id, CAST(i % 8 AS INTEGER) AS dim, round(avg(e), 6) AS mean, max(e) AS max FROM f WHERE (i // 8) % 3 <> 0 GROUP BY vec_id, i % 8"""


def warmup_schedule(spark, d):
    s = spark.range(0, 200)
    return s.select(F.col("id").alias("step"), r(vectors.warmup_cosine(F.col("id"), 20, 180), 6).alias("factor"))


WARMUP_SQL = "SELECT step, round(CASE WHEN step < 20 THEN step / CAST(20 AS DOUBLE) ELSE greatest(0, 0.5 * (1 + cos(pi() * (step - 20) / 160))) END, 6) AS factor FROM (SELECT CAST(unnest(range(200)) AS BIGINT) AS step)"


def embedding_rows(spark, d):
    return reading.embedding_rows(c.chunks(spark, d), "mini").select("external_id", "video", "start", "end", F.length("text").alias("n"))


ROWS_SQL = c.sql("SELECT 'mini_' || turn AS external_id, video, start, \"end\", length(text) AS n FROM chunks", "chunks")


def flattened_index(spark, d):
    """Postings back as rows."""
    idx = indexing.inverted_index(postings._best(spark, d), "key", ["video_id", "scene"], ["l_orderkey", "confidence"])
    return indexing.flattened(idx).select("key", "video_id", "scene", "l_orderkey", r("confidence", 4).alias("confidence"))


FLAT_SQL = c.sql(f"+{postings._BEST} SELECT key, video_id, scene, l_orderkey, round(confidence, 4) AS confidence FROM b", "occ")


def windowed_counts(spark, d):
    """Events by hour; as a stream, the same with a watermark."""
    w = shots.windowed_counts(c.base(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", r("total", 4).alias("total"))


WINDOWED_SQL = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY date_trunc('hour', ts), event_type"

QUERIES = {
    "segments_with_videos": (segments_with_videos, SEGMENTS_SQL), "zip_detections": (zip_detections, ZIP_SQL), "annotations_with_images": (annotations_with_images, ANNOTATED_SQL), "images_with_truth": (images_with_truth, FILES_SQL),
    "hardest_negatives": (hardest_negatives, HARDEST_SQL), "first_video": (first_video, c.sql("SELECT id, file_name, file_path FROM videos ORDER BY file_name LIMIT 1", "videos")), "distinct_boxes": (distinct_boxes, c.sql("SELECT DISTINCT image, x1, y1, x2, y2 FROM boxes", "boxes")),
    "value_cdf": (value_cdf, CDF_SQL), "layer_counts": (layer_counts, LAYER_SQL), "sparse_vectors": (sparse_vectors, SPARSE_SQL), "neighbour_quads": (neighbour_quads, QUADS_SQL), "top_classes": (top_classes, TOP_SQL), "softmax": (softmax, SOFTMAX_SQL),
    "pooled": (pooled, POOLED_SQL), "warmup_schedule": (warmup_schedule, WARMUP_SQL), "embedding_rows": (embedding_rows, ROWS_SQL), "flattened_index": (flattened_index, FLAT_SQL), "windowed_counts": (windowed_counts, WINDOWED_SQL),
}
