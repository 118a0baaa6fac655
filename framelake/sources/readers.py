"""Readers and writers of the files that video pipelines exchange, by Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import boxes, text

OCCURRENCE = "array<struct<scene:int,frame:int,video_path:string,frame_time:double,start_time:double,end_time:double,confidence:double,model_name:string>>"
VIDEO_TYPES = ("mp4", "avi", "mov", "mkv", "webm")


def inverted_index_json(spark: SparkSession, path: str) -> DataFrame:
    """{key: [occurrence, ...]} as (key, occurrence fields)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{OCCURRENCE}>").alias("m"))
    return raw.select(F.explode("m").alias("key", "o")).select("key", F.explode("o").alias("o")).select("key", "o.*")


def write_inverted_index(rows: DataFrame, path: str) -> None:
    """One line for each key: {"key": ..., "occurrences": [...]}, in order of scene and frame."""
    item = F.struct(*[F.col(c) for c in rows.columns if c != "key"])
    rows.groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("occurrences")).write.mode("overwrite").json(path)


def transcripts_json(spark: SparkSession, path: str) -> DataFrame:
    """Speech recognition output as chunks (video_path, pos, text, start, end): null times are 0, blank chunks go."""
    schema = "text string, chunks array<struct<text:string,timestamp:array<double>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("video_path"), F.posexplode("chunks").alias("pos", "c"))
    at = lambda i: F.coalesce(F.get("c.timestamp", F.lit(i)), F.lit(0.0))
    return rows.select("video_path", "pos", F.trim("c.text").alias("text"), at(0).alias("start"), at(1).alias("end")).where("text <> ''")


def training_triples(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema="anchor string, positive string, negative string", quote='"', escape='"', multiLine=True)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def sts_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Sentence pairs with their score brought to -1..1; rows without a score go."""
    from framelake.functions import vectors

    rows = spark.read.csv(path, header=True, schema="sentence1 string, sentence2 string, score double", quote='"', escape='"', multiLine=True)
    return rows.where("score is not null").select("sentence1", "sentence2", vectors.sts_normalised(F.col("score")).alias("score"))


def distinct_sentences(pairs: DataFrame) -> DataFrame:
    """(id, sentence) of both columns in sorted order, from 0."""
    from framelake.operators.lexical import term_index

    every = pairs.select(F.col("sentence1").alias("term")).union(pairs.select("sentence2")).where("term is not null").distinct()
    return term_index(every).select(F.col("idx").alias("id"), F.col("term").alias("sentence"))


def voc_xml(spark: SparkSession, path: str, shift: float = 0.0, keep_degenerate: bool = True) -> DataFrame:
    """Boxes of annotation files: (filename, width, height, label, difficult, box); shift is added to every corner."""
    schema = "filename string, size struct<width:int,height:int>, object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path).select("filename", "size", F.posexplode("object").alias("pos", "o"))
    b = F.col("o.bndbox")
    out = rows.select("filename", F.col("size.width").alias("width"), F.col("size.height").alias("height"), "pos", F.lower(F.trim("o.name")).alias("label"), (F.coalesce("o.difficult", F.lit(0)) == 1).alias("difficult"), boxes.box(b["xmin"] + shift, b["ymin"] + shift, b["xmax"] + shift, b["ymax"] + shift).alias("box"))
    return out if keep_degenerate else out.where((F.col("box.x2") > F.col("box.x1")) & (F.col("box.y2") > F.col("box.y1")))


def vrd_json(spark: SparkSession, path: str, labels: list[str], predicates: list[str]) -> tuple[DataFrame, DataFrame]:
    """Relationship annotations: objects (file, idx, label, box), numbered by first appearance, and relationships (file, pos,
    subject_idx, predicate, object_idx). Unknown predicates and categories drop the relationship."""
    side = "struct<category:int,bbox:array<double>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,array<struct<predicate:int,subject:{side},object:{side}>>>")).alias("file", "r"))
    rels = raw.select("file", F.posexplode("r").alias("pos", "r"))
    known = F.array(*map(F.lit, labels)), F.array(*map(F.lit, predicates))
    name = lambda c: F.get(known[0], F.col(f"r.{c}.category"))
    # Files have y1, y2, x1, x2.
    at = lambda c: boxes.box(F.col(f"r.{c}.bbox")[2], F.col(f"r.{c}.bbox")[0], F.col(f"r.{c}.bbox")[3], F.col(f"r.{c}.bbox")[1])
    rels = rels.select("file", "pos", F.get(known[1], F.col("r.predicate")).alias("predicate"), *[F.struct(name(c).alias("label"), at(c).alias("box")).alias(c) for c in ("subject", "object")])
    rels = rels.where("predicate is not null and subject.label is not null and object.label is not null")
    both = rels.select("file", F.posexplode(F.array("subject", "object")).alias("side", "o"), "pos")
    first = both.groupBy("file", "o").agg(F.min(F.struct("pos", "side")).alias("at"))
    objects = first.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).alias("idx"), "o")
    link = lambda c: objects.select("file", F.col("o").alias(c), F.col("idx").alias(f"{c}_idx"))
    out = rels.join(link("subject"), ["file", "subject"]).join(link("object"), ["file", "object"])
    return objects.select("file", "idx", "o.label", "o.box"), out.select("file", "pos", "subject_idx", "predicate", "object_idx")


def scene_truth(spark: SparkSession, path: str) -> DataFrame:
    """Lines of exactly two numbers: (video, start, end)."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.input_file_name().alias("video"), parts.alias("p")).where(F.size("p") == 2)
    return rows.select("video", F.col("p")[0].try_cast("int").alias("start"), F.col("p")[1].try_cast("int").alias("end")).where("start is not null and end is not null")


def mpeg7_cuts(spark: SparkSession, path: str, fps: float = 25.0) -> DataFrame:
    """(video, frame): where segments begin, the first left out."""
    rows = spark.read.format("xml").option("rowTag", "VideoSegment").schema("MediaTime struct<MediaTimePoint:string,MediaDuration:string>").load(path)
    rows = rows.select(F.input_file_name().alias("video"), F.round(text.mpeg7_seconds(F.col("MediaTime.MediaTimePoint")) * fps).cast("int").alias("frame"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("video").orderBy("frame"))).where("_n > 1").drop("_n")


def manifest(spark: SparkSession, path: str, skip: int = 0, take: int | None = None) -> DataFrame:
    rows = spark.read.text(path).where(F.trim("value") != "").orderBy("value").offset(skip)
    return rows.limit(take) if take is not None else rows


def word_vectors(spark: SparkSession, path: str, dim: int = 50) -> DataFrame:
    """(word, v) of a text file of words and numbers; lines of another length go."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == dim + 1)
    return rows.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, dim), lambda x: x.try_cast("double")).alias("v"))


def embedded(tokens: DataFrame, words: DataFrame, key: str, dim: int = 50) -> DataFrame:
    """(key, v): mean vector of the words of tokens (key, words array); a word is looked up as it is, with s, without its last
    letter or two, and else gets numbers from its hash, the same everywhere."""
    flat = tokens.select(key, F.posexplode("words").alias("pos", "w"))
    forms = flat.select(key, "pos", "w", F.posexplode(F.array("w", F.concat("w", F.lit("s")), F.expr("substring(w, 1, greatest(length(w) - 1, 0))"), F.expr("substring(w, 1, greatest(length(w) - 2, 0))"))).alias("_form", "form"))
    hit = forms.join(words.withColumnRenamed("word", "form"), "form", "left").groupBy(key, "pos", "w").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("_form"))).alias("v"))
    made = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.pmod(F.xxhash64("w", i), F.lit(2001)) / 1000.0 - 1)
    each = hit.select(key, F.posexplode(F.coalesce("v", made)).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def accepted_uploads(files: DataFrame, column: str = "path") -> DataFrame:
    return files.where(F.lower(F.substring_index(F.col(column), ".", -1)).isin(*VIDEO_TYPES))


def save_model(path: str, **tables: DataFrame) -> None:
    """Tables of a fitted model as Parquet folders below path; Spark's commit makes each appear whole or not at all."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def save_postings(assigned: DataFrame, path: str) -> None:
    """Vectors filed by cluster: a query that probes few clusters reads only their folders."""
    assigned.write.mode("overwrite").partitionBy("l2").parquet(path)
