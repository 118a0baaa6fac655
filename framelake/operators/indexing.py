"""Inverted indexes, idempotent writes, surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_scene(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key and scene the first row in the order; one shuffle, ranks are cut before the sort is full."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def inverted_index(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, n, postings): occurrences of a key in the given order."""
    item = F.struct(*[F.col(x) for x in [*order, *fields]])
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("postings"))


def flattened(index: DataFrame, key: str = "key") -> DataFrame:
    return index.select(key, F.explode("postings").alias("p")).select(key, "p.*")


def _others(rows: DataFrame, key: list[str]) -> list[Column]:
    """Columns outside the key, in a form that sorts."""
    return [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in rows.dtypes if c not in key]


def _first(rows: DataFrame, key: list[str]) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(*(_others(rows, key) or [F.lit(0)]))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def new_rows(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of incoming whose natural key is not there yet; of rows of one key the first by their other columns."""
    return _first(incoming, key).join(existing.select(*key), key, "left_anti")


def upserted(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """existing with the rows of incoming in place of those of the same key. Running it twice changes nothing.

    Of several rows of one key and side the first by their other columns counts.
    """
    both = existing.withColumn("_age", F.lit(0)).unionByName(incoming.withColumn("_age", F.lit(1)))
    latest = Window.partitionBy(*key).orderBy(F.col("_age").desc(), *_others(existing, key))
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_age", "_n")


def with_surrogates(keys: DataFrame, dimension: DataFrame) -> DataFrame:
    """dimension (id, key) with ids for the keys that are new to it, after its largest id, in order of key."""
    new = keys.select("key").where("key is not null").distinct().join(dimension, "key", "left_anti")
    top = dimension.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # A dimension's new keys are few; facts only meet it in joins.
    numbered = new.withColumn("n", F.row_number().over(Window.orderBy("key"))).join(F.broadcast(top), F.lit(True))
    return dimension.select("id", "key").unionByName(numbered.select((F.col("top") + F.col("n")).cast(dict(dimension.dtypes)["id"]).alias("id"), "key"))


def deleted(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and one row with the number deleted. A null condition deletes nothing."""
    gone = F.coalesce(condition, F.lit(False))
    return rows.where(~gone), rows.where(gone).agg(F.count("*").alias("deleted"))


def payload_merged(payload: Column, columns: dict[str, Column]) -> Column:
    """A JSON payload as a map; columns fill keys it lacks, its own values - nulls, too - win; what is no JSON counts as empty."""
    base = F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))])
    own = F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def triple_parts(key: Column) -> Column:
    """'a, b, c' as three trimmed parts, null if there are not just three."""
    parts = F.transform(F.split(key, ","), lambda x: F.trim(x))
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("subject"), parts[1].alias("predicate"), parts[2].alias("object")))
