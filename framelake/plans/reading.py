"""Characters, words, class scores and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import reading
from framelake.sources import catalog as c

r = F.round


def word_clusters(spark, d):
    """Chains of neighbours: no SQL for a closure within each image that would say more than the fold."""
    return reading.word_clusters(c.detections(spark, d), "image").groupBy("image").agg(F.count("*").alias("words"), F.max("n").alias("longest"))


def reading_order(spark, d):
    return reading.reading_order(c.detections(spark, d).select("image", "det_id", "box"), "image").select("image", "det_id", "line", "pos")


ORDER_SQL = c.sql("""+s AS (SELECT image, list_reduce(list_prepend([{'y': CAST(-1e9 AS DOUBLE), 'line': -1, 'top': true, 'det_id': CAST(-1 AS BIGINT)}], list([{'y': y1, 'line': -1, 'top': false, 'det_id': det_id}] ORDER BY y1, det_id)),
  lambda a, x: list_append(a, {'y': x[1].y, 'line': coalesce(list_filter(a, lambda t: t.top AND abs(t.y - x[1].y) < 10)[1].line, CAST(len(list_filter(a, lambda t: t.top)) - 1 AS INTEGER)), 'top': len(list_filter(a, lambda t: t.top AND abs(t.y - x[1].y) < 10)) = 0, 'det_id': x[1].det_id})) AS o FROM boxes GROUP BY image),
u AS (SELECT image, unnest(o[2:]) AS e FROM s) SELECT u.image, e.det_id AS det_id, CAST(e.line AS INTEGER) AS line, CAST(row_number() OVER (PARTITION BY u.image ORDER BY e.line, x1, y1, e.det_id) - 1 AS INTEGER) AS pos FROM u JOIN boxes b ON b.det_id = e.det_id""", "boxes")  # fmt: skip


def best_per_class(spark, d):
    x = reading.relabelled(c.detections(spark, d), {"click": "tap"})
    f = reading.rescoring_features(x, "image", ["tap", "purchase", "view"], 560.0, 460.0)
    return f.select("det_id", *[r(F.col("features")[k], 6).alias(f"f{k}") for k in range(8)])


BEST_SQL = c.sql("""+m AS (SELECT image, coalesce(max(score) FILTER (label = 'click'), 0) AS a, coalesce(max(score) FILTER (label = 'purchase'), 0) AS p, coalesce(max(score) FILTER (label = 'view'), 0) AS v FROM boxes GROUP BY image)
SELECT det_id, round(score, 6) AS f0, round(x1 / 560, 6) AS f1, round(y1 / 460, 6) AS f2, round(x2 / 560, 6) AS f3, round(y2 / 460, 6) AS f4, round(a, 6) AS f5, round(p, 6) AS f6, round(v, 6) AS f7 FROM boxes JOIN m USING (image)""", "boxes")  # fmt: skip


def strategy_ranking(spark, d):
    x = c.detections(spark, d).withColumn("phrase", F.col("score")).withColumn("object", (F.col("det_id") * 131 % 997) / 997.0)
    return reading.strategies(x, "image", 5).select("image", "strategy", "rank", "det_id", r("score", 6).alias("score"))


_PIXELS = "greatest(0, least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1) + 1) * greatest(0, least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1) + 1)"
STRATEGY_SQL = c.sql(f"""+o AS (SELECT *, (det_id * 131 % 997) / CAST(997.0 AS DOUBLE) AS other FROM boxes), s AS (SELECT image, det_id, x1, y1, x2, y2, 'phrase' AS strategy, score FROM o UNION ALL SELECT image, det_id, x1, y1, x2, y2, 'object', other FROM o UNION ALL SELECT image, det_id, x1, y1, x2, y2, 'both', score + other FROM o),
k AS (SELECT image, strategy, unnest(list_reduce(list_transform(list({{'s': -score, 'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY -score, det_id), lambda e: [e]),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_PIXELS} / ((k.x2 - k.x1 + 1) * (k.y2 - k.y1 + 1) + (x[1].x2 - x[1].x1 + 1) * (x[1].y2 - x[1].y1 + 1) - {_PIXELS}) > 0.3)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS e FROM s GROUP BY image, strategy)
SELECT * FROM (SELECT image, strategy, CAST(row_number() OVER (PARTITION BY image, strategy ORDER BY e.s, e.det_id) AS INTEGER) AS rank, e.det_id AS det_id, round(-e.s, 6) AS score FROM k) WHERE rank <= 5""", "boxes")  # fmt: skip


def window_width(spark, d):
    return reading.window_width(c.detections(spark, d))


WIDTH_SQL = c.sql("SELECT label, CAST(greatest(56, least(184, round_even(104 * quantile_cont((x2-x1)/(y2-y1), 0.5) / 8, 0) * 8)) AS INTEGER) AS w FROM boxes GROUP BY label", "boxes")


def class_balance(spark, d):
    return reading.class_weights(c.base(spark, d, "labels"), "quality").select("quality", "n", r("weight", 6).alias("weight"))


BALANCE_SQL = "SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / CAST(count(*) OVER () * count(*) AS DOUBLE), 6) AS weight FROM labels GROUP BY quality"


def one_vs_one(spark, d):
    e = c.base(spark, d, "events").select("event_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (0, 2), (1, 2))])).alias("p"), "value")
    score = F.sin(F.col("value") * (F.col("p.i") + 1) + F.col("p.j"))
    return reading.one_vs_one(e.select("event_id", "p.i", "p.j", score.alias("score")), "event_id", 3, 2.0).select("event_id", "class", r("p", 6).alias("p"))


OVO_SQL = """WITH e AS (SELECT event_id, i, j, 1 / (1 + exp(-2 * sin(value * (i + 1) + j))) AS p FROM events, (VALUES (0, 1), (0, 2), (1, 2)) v(i, j)),
s AS (SELECT event_id, class, sum(p) AS p FROM (SELECT event_id, i AS class, p FROM e UNION ALL SELECT event_id, j, 1 - p FROM e) GROUP BY ALL) SELECT event_id, class, round(p / (sum(p) OVER (PARTITION BY event_id) + 1e-12), 6) AS p FROM s"""


def phrase_images(spark, d):
    x = c.detections(spark, d).withColumn("label", F.concat_ws("_", "label", F.when(F.col("det_id") % 2 == 0, F.lit("on_page"))))
    return reading.phrase_images(x)


PHRASE_SQL = c.sql("SELECT label || '_on_page' AS label, count(DISTINCT image) AS images FROM boxes WHERE det_id % 2 = 0 GROUP BY 1", "boxes")


def ocr_cleanup(spark, d):
    """Readings of the turns of a conversation as one text, and its words."""
    rows = c.base(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.concat(F.lit("  "), "text").alias("reading"), (F.col("turn") % 5 / 5.0).alias("conf"))
    return reading.words_of(reading.cleaned_readings(rows, ["conv_id"], 0.3), ["conv_id"]).groupBy("conv_id").agg(F.count("*").alias("n"), F.max("word").alias("last_word"), r(F.max("conf"), 6).alias("conf"))


OCR_SQL = r"""WITH t AS (SELECT conv_id, lower(trim(string_agg('  ' || text, ' ' ORDER BY turn))) AS text, avg(turn % 5 / CAST(5 AS DOUBLE)) AS conf FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, conf, unnest(regexp_split_to_array(text, '\s+')) AS word FROM t WHERE conf >= 0.3 AND length(text) >= 2) SELECT conv_id, count(*) AS n, max(word) AS last_word, round(max(conf), 6) AS conf FROM w WHERE word <> '' GROUP BY conv_id"""


def cluster_silhouette(spark, d):
    e = c.base(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("l1"))
    return reading.silhouette(e).select("vec_id", r("s", 5).alias("s"))


SILHOUETTE_SQL = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(1 - list_dot_product(a.v, b.v)) AS s, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
m AS (SELECT vec_id, max(CASE WHEN la = lb THEN s / n END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM d GROUP BY vec_id) SELECT vec_id, round((b - a) / greatest(a, b), 5) AS s FROM m"""


def scene_elbow(spark, d):
    """Where the sorted scores of a video bend."""
    from pyspark.sql import Window

    f = c.frame_scores(spark, d)
    ranked = f.select("video", (F.row_number().over(Window.partitionBy("video").orderBy(F.col("score").desc(), "frame")) - 1).alias("pos"), F.log(F.col("score") + 1).alias("value"))
    return reading.elbow(ranked, "video", "pos", "value")


ELBOW_SQL = c.sql("""+q AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame) - 1 AS pos, ln(score + 1) AS value FROM frames), z AS (SELECT *, first_value(value) OVER w AS f, (last_value(value) OVER w - first_value(value) OVER w) / (count(*) OVER w - 1 + CAST(1e-9 AS DOUBLE)) AS m FROM q WINDOW w AS (PARTITION BY video ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT video, CAST(greatest(2, arg_max(pos, (abs(f + m * pos - value) / sqrt(m * m + 1), -pos))) AS INTEGER) AS k FROM z GROUP BY video""", "frames")  # fmt: skip

QUERIES = {
    "word_clusters": (word_clusters, None), "reading_order": (reading_order, ORDER_SQL), "best_per_class": (best_per_class, BEST_SQL), "strategy_ranking": (strategy_ranking, STRATEGY_SQL), "window_width": (window_width, WIDTH_SQL), "class_balance": (class_balance, BALANCE_SQL),
    "one_vs_one": (one_vs_one, OVO_SQL), "phrase_images": (phrase_images, PHRASE_SQL), "ocr_cleanup": (ocr_cleanup, OCR_SQL), "cluster_silhouette": (cluster_silhouette, SILHOUETTE_SQL), "scene_elbow": (scene_elbow, ELBOW_SQL),
}
