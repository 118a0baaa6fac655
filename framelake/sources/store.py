"""A vector store as a table: add, query, reopen. Search is exact, by operators.search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import vectors
from framelake.operators import search


def append(rows: DataFrame, path: str) -> None:
    """Append sink: rows become visible as a whole when Spark commits the write."""
    rows.write.mode("append").parquet(path)


class VectorStore:
    """Vectors (vec_id long, v array<double>, meta map<string,string>) of one dimension below a path.

    The dimension is fixed by the first add and kept in the table. A repeated vec_id is replaced by a later add: rows carry the
    number of their add, and the latest counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def _state(self) -> tuple[int | None, int]:
        """(dimension, number of adds): two numbers come to the driver."""
        if not self._folder():
            return None, 0
        dim, last = self.spark.read.parquet(self.path).agg(F.max("dim"), F.max("add")).first()
        return dim, 0 if last is None else last + 1

    def add(self, rows: DataFrame) -> None:
        """rows (vec_id, v, meta); raises ValueError if any has another dimension than the store, or than the other rows."""
        dim, turn = self._state()
        low, high = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
        if low is None:
            return
        if low != high or (dim is not None and low != dim):
            raise ValueError(f"vectors of {low} to {high} dimensions, the store has {dim or low}")
        out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), F.col("meta").cast("map<string,string>").alias("meta"))
        append(out.dropDuplicates(["vec_id"]).withColumns({"dim": F.lit(low), "add": F.lit(turn)}), self.path)

    def rows(self) -> DataFrame:
        """(vec_id, v, meta) as they stand."""
        stored = self.spark.read.parquet(self.path)
        latest = stored.groupBy("vec_id").agg(F.max("add").alias("add"))
        return stored.join(latest, ["vec_id", "add"]).select("vec_id", "v", "meta")

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, sim, meta) for queries (query_id, q), by cosine; ValueError for another dimension."""
        dim, _ = self._state()
        other = queries.where(F.size("q") != F.lit(dim)).limit(1).count()
        if dim is None or other:
            raise ValueError(f"queries must have the store's {dim} dimensions")
        rows = self.rows()
        unit = lambda t, c: t.withColumn(c, vectors.normalise(c))
        hits = search.top_k(unit(queries, "q"), unit(rows.select("vec_id", "v"), "v"), k, drop_self=False)
        return hits.join(rows.select("vec_id", "meta"), "vec_id").select("query_id", "rank", "vec_id", "sim", "meta")
