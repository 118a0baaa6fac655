"""Inverted indexes, per-scene dedup, upserts, surrogate keys, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import indexing
from framelake.sources import catalog as c

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _best(spark, d):
    return indexing.best_per_scene(c.occurrences(spark, d), ["key", "video_id", "scene"], [F.col("confidence").desc(), *map(F.col, ORDER)])


def scene_dedup(spark, d):
    return _best(spark, d).select("key", "video_id", "scene", F.round("confidence", 4).alias("confidence"), *ORDER)


_BEST = "b AS (SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY key, video_id, scene ORDER BY confidence DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1)"
DEDUP_SQL = c.sql(f"+{_BEST} SELECT key, video_id, scene, round(confidence, 4) AS confidence, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM b", "occ")


def inverted_index(spark, d):
    idx = indexing.inverted_index(_best(spark, d), "key", ["video_id", "scene"], ["l_orderkey", "confidence"])
    return idx.select("key", "n", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["video_id"], p["scene"], p["l_orderkey"])), ",").alias("postings"))


INDEX_SQL = c.sql(f"+{_BEST} SELECT key, count(*) AS n, string_agg(video_id || ':' || scene || ':' || l_orderkey, ',' ORDER BY video_id, scene) AS postings FROM b GROUP BY key", "occ")


def triple_index(spark, d):
    """Relationship occurrences by 's, p, o', one a scene."""
    rows = c.occurrences(spark, d).withColumn("triple", F.concat_ws(", ", "key", "predicate", "object"))
    one = indexing.best_per_scene(rows, ["triple", "video_id", "scene"], [F.col("confidence").desc(), *map(F.col, ORDER)])
    return indexing.inverted_index(one, "triple", ["video_id", "scene"], []).select("triple", "n", F.element_at("postings", 1)["scene"].alias("first_scene"))


TRIPLE_SQL = c.sql("SELECT triple, count(*) AS n, CAST(arg_min(scene, (video_id, scene)) AS INTEGER) AS first_scene FROM (SELECT DISTINCT key || ', ' || predicate || ', ' || object AS triple, video_id, scene FROM occ) GROUP BY triple", "occ")


def insert_if_absent(spark, d):
    """Occurrences of even orders are there; what the others add, by (key, video, scene)."""
    occ = c.occurrences(spark, d).select("key", "video_id", "scene", "l_orderkey")
    key = ["key", "video_id", "scene"]
    return indexing.new_rows(occ.where("l_orderkey % 2 = 1"), occ.where("l_orderkey % 2 = 0"), key).select(*key)


ABSENT_SQL = c.sql("SELECT DISTINCT key, video_id, scene FROM occ WHERE l_orderkey % 2 = 1 EXCEPT SELECT key, video_id, scene FROM occ WHERE l_orderkey % 2 = 0", "occ")


def _meta(spark, d):
    e = c.base(spark, d, "events")
    return e.select(F.col("event_id").alias("vector_id"), F.col("event_type").alias("embedder_model"), F.col("value").alias("start_time"), F.col("props").alias("payload_json"))


def upsert_latest(spark, d):
    m = _meta(spark, d)
    new = m.where("vector_id % 3 = 0").withColumn("start_time", F.col("start_time") + 1)
    return indexing.upserted(m.where("vector_id % 5 <> 0"), new, ["vector_id", "embedder_model"]).select("vector_id", "embedder_model", F.round("start_time", 6).alias("start_time"))


UPSERT_SQL = "SELECT event_id AS vector_id, event_type AS embedder_model, round(CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END, 6) AS start_time FROM events WHERE event_id % 3 = 0 OR event_id % 5 <> 0"


def surrogate_keys(spark, d):
    old = c.objects(spark, d).where("id % 3 = 0")
    return indexing.with_surrogates(c.base(spark, d, "part").select(F.col("p_name").alias("key")), old)


SURROGATE_SQL = c.sql("+old AS (SELECT * FROM objects WHERE id % 3 = 0) SELECT id, key FROM old UNION ALL SELECT CAST((SELECT max(id) FROM old) + row_number() OVER (ORDER BY key) AS INTEGER), key FROM objects WHERE id % 3 <> 0", "objects")


def payload_merge(spark, d):
    """Columns fill what the payload lacks."""
    m = _meta(spark, d).withColumn("payload_json", F.when(F.col("vector_id") % 7 == 0, "not json").otherwise(F.col("payload_json")))
    got = indexing.payload_merged(F.col("payload_json"), {"k": F.lit("none"), "model": F.col("embedder_model")})
    return m.select("vector_id", got["k"].alias("k"), got["model"].alias("model"), F.size(got).alias("n"))


PAYLOAD_SQL = "SELECT event_id AS vector_id, CASE WHEN event_id % 7 = 0 THEN 'none' ELSE coalesce(props->>'k', 'none') END AS k, event_type AS model, CAST(2 AS INTEGER) AS n FROM events"


def delete_by_model(spark, d):
    keep, gone = indexing.deleted(_meta(spark, d), F.col("embedder_model") == "click")
    return keep.agg(F.count("*").alias("kept")).join(gone, F.lit(True))


DELETE_SQL = "SELECT count(*) FILTER (event_type <> 'click') AS kept, count(*) FILTER (event_type = 'click') AS deleted FROM events"


def ids_in_list(spark, d):
    """Metadata of listed vectors of one model."""
    return _meta(spark, d).where(F.col("vector_id").isin(1, 5, 8, 13, 21, 34, 55) & F.col("embedder_model").isin("view", "click")).select("vector_id", "embedder_model")


IN_SQL = "SELECT event_id AS vector_id, event_type AS embedder_model FROM events WHERE event_id IN (1, 5, 8, 13, 21, 34, 55) AND event_type IN ('view', 'click')"


def triple_split(spark, d):
    keys = c.occurrences(spark, d).select(F.concat_ws(",", F.concat(F.lit(" "), "key"), "predicate", F.when(F.col("scene") % 2 == 0, F.col("object"))).alias("k")).distinct()
    p = indexing.triple_parts(F.col("k"))
    return keys.select("k", p["subject"].alias("subject"), p["object"].alias("object"))


SPLIT_SQL = c.sql("SELECT DISTINCT concat_ws(',', ' ' || key, predicate, CASE WHEN scene % 2 = 0 THEN object END) AS k, CASE WHEN scene % 2 = 0 THEN key END AS subject, CASE WHEN scene % 2 = 0 THEN object END AS object FROM occ", "occ")

QUERIES = {
    "scene_dedup": (scene_dedup, DEDUP_SQL), "inverted_index": (inverted_index, INDEX_SQL), "triple_index": (triple_index, TRIPLE_SQL), "insert_if_absent": (insert_if_absent, ABSENT_SQL), "upsert_latest": (upsert_latest, UPSERT_SQL),
    "surrogate_keys": (surrogate_keys, SURROGATE_SQL), "payload_merge": (payload_merge, PAYLOAD_SQL), "delete_by_model": (delete_by_model, DELETE_SQL), "ids_in_list": (ids_in_list, IN_SQL), "triple_split": (triple_split, SPLIT_SQL),
}
