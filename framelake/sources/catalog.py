"""Domain tables derived from the driver's tables, as DataFrames and - for the oracle - as SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import boxes, text


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def videos(spark: SparkSession, d: str) -> DataFrame:
    ids = base(spark, d, "lineitem").select((F.col("l_suppkey") % 20).cast("int").alias("id")).distinct()
    return ids.select("id", F.concat(F.lit("v"), "id", F.lit(".mp4")).alias("file_name"), F.concat(F.lit("videos/v"), "id", F.lit(".mp4")).alias("file_path"))


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Keys with ids by order of key; a dimension of a few hundred names."""
    keys = base(spark, d, "part").select(F.col("p_name").alias("key")).distinct()
    return keys.select(F.row_number().over(Window.orderBy("key")).alias("id"), "key")


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Detected objects: a row for each line item, in a total order of confidence and keys."""
    li = base(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag", "l_linestatus")
    part = base(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    scene = (F.col("l_orderkey") % 50).cast("int")
    return li.join(part, "l_partkey").select(
        F.col("p_name").alias("key"), (F.col("l_suppkey") % 20).cast("int").alias("video_id"), scene.alias("scene"), (scene * 5.0).alias("frame_time"),
        (scene * 5.0).alias("start_time"), (scene * 5.0 + 5).alias("end_time"), (1 - F.col("l_discount")).alias("confidence"),
        F.when(F.col("l_returnflag") == "A", "HOG").otherwise("Faster R-CNN").alias("model_name"), F.concat("l_returnflag", "l_linestatus").alias("predicate"), F.col("p_type").alias("object"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def detections(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    x, y = (e * 37) % 400, (e * 53) % 300
    rows = base(spark, d, "events").select(e.alias("det_id"), F.col("user_id").alias("image"), F.col("event_type").alias("label"), boxes.box(x, y, x + 40 + (e * 11) % 160, y + 40 + (e * 17) % 120).alias("box"), ((e * 7919) % 10007 / 10007.0).alias("score"))
    return rows


def truths(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth detection, shifted by 5 pixels."""
    b = F.col("box")
    return detections(spark, d).where("det_id % 5 = 0").select(F.col("det_id").alias("gt_id"), "image", "label", boxes.box(b["x1"] + 5, b["y1"] + 5, b["x2"] + 5, b["y2"] + 5).alias("box"), (F.col("det_id") % 35 == 0).alias("difficult"))


def frame_scores(spark: SparkSession, d: str) -> DataFrame:
    """Change scores of frames in order, by video."""
    e = base(spark, d, "events").select(F.col("user_id").alias("video"), "ts", "event_id", F.col("value").alias("score"))
    return e.select("video", (F.row_number().over(Window.partitionBy("video").orderBy("ts", "event_id")) - 1).alias("frame"), "score")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = base(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("video"), "turn", F.col("turn") * 5.0, "text").toDF("video", "turn", "start", "text").withColumn("end", F.col("start") + 5)


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, tokens) of all documents, tokenised once."""
    return base(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("tokens"))


def ocr_words(spark: SparkSession, d: str) -> DataFrame:
    """Words on screen: tokens of English documents that are a-z only; video is the source, frame the document."""
    rows = base(spark, d, "documents").where("lang = 'en'").select("source", "doc_id", F.explode(text.tokenize(F.col("text"))).alias("word"))
    return rows.where(F.col("word").rlike("^[a-z]{2,}$")).select(F.col("source").alias("video"), F.col("doc_id").alias("frame_number"), "word")


def sentence_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as sentences in order, by label; pos from 0."""
    e = base(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("pos"), "vec_id", "v")


# --- the same for DuckDB ---

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_PUNCT = text.PUNCTUATION.replace("'", "''")
TOKENS = f"list_filter(regexp_split_to_array(translate(lower(text), '{_PUNCT}', ''), '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"
_X, _Y = "(event_id*37)%400", "(event_id*53)%300"
CTE = {
    "videos": "SELECT DISTINCT CAST(l_suppkey % 20 AS INTEGER) AS id, 'v' || (l_suppkey % 20) || '.mp4' AS file_name, 'videos/v' || (l_suppkey % 20) || '.mp4' AS file_path FROM lineitem",
    "objects": "SELECT CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS id, key FROM (SELECT DISTINCT p_name AS key FROM part)",
    "occ": """SELECT p_name AS key, CAST(l_suppkey % 20 AS INTEGER) AS video_id, CAST(l_orderkey % 50 AS INTEGER) AS scene, (l_orderkey % 50) * CAST(5.0 AS DOUBLE) AS frame_time, (l_orderkey % 50) * CAST(5.0 AS DOUBLE) AS start_time,
      (l_orderkey % 50) * CAST(5.0 AS DOUBLE) + 5 AS end_time, 1 - l_discount AS confidence, CASE WHEN l_returnflag = 'A' THEN 'HOG' ELSE 'Faster R-CNN' END AS model_name, l_returnflag || l_linestatus AS predicate, p_type AS object,
      l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "boxes": f"SELECT event_id AS det_id, user_id AS image, event_type AS label, CAST({_X} AS DOUBLE) AS x1, CAST({_Y} AS DOUBLE) AS y1, CAST({_X} + 40 + (event_id*11)%160 AS DOUBLE) AS x2, CAST({_Y} + 40 + (event_id*17)%120 AS DOUBLE) AS y2, ((event_id*7919)%10007) / CAST(10007.0 AS DOUBLE) AS score FROM events",
    "gt": "SELECT det_id AS gt_id, image, label, x1+5 AS x1, y1+5 AS y1, x2+5 AS x2, y2+5 AS y2, det_id % 35 = 0 AS difficult FROM boxes WHERE det_id % 5 = 0",
    "frames": "SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS score FROM events",
    "chunks": "SELECT conv_id AS video, turn, turn * CAST(5.0 AS DOUBLE) AS start, turn * CAST(5.0 AS DOUBLE) + 5 AS \"end\", text FROM conversations",
    "tokens": f"SELECT doc_id, {TOKENS} AS tokens FROM documents",
    "ocr": f"SELECT source AS video, doc_id AS frame_number, word FROM (SELECT source, doc_id, unnest({TOKENS}) AS word FROM documents WHERE lang = 'en') WHERE regexp_matches(word, '^[a-z]{{2,}}$')",
    "sents": "SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
}


def sql(query: str, *names: str) -> str:
    """query behind the WITH of the named tables; those that build on others come after them."""
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names) + (", " if query.startswith("+") else " ") + query.removeprefix("+")
