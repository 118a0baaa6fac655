"""What the training-data operators share: reading, cutting lineage, ordered indexes, grouped Arrow processing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches sent to Python are held to this many rows and bytes, whatever the length of texts.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: White space of the word rule: words are runs of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, read by Spark (any store), with Arrow batches bounded for what follows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and read it from there, so lost executors cost no recomputation.

    Uses spark.checkpoint.dir; only where that is unset (local tests) a folder of this machine is set.
    """
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def shared(spark: SparkSession) -> str:
    """The folder that all machines share. Only a local master, as in tests, may go without one and gets a folder of this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", "")
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again; dropped() removes it."""
    path = f"{shared(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.written_to = path
    return out


def laid(df: DataFrame) -> DataFrame:
    """df as cut() writes it, plain rows without a code; dropped() removes it. About twice the disk of written() for arrays of numbers, and less to compute."""
    out = cut(df)
    out.written_to = out._jdf.logicalPlan().rdd().getCheckpointFile().get()
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that written() or laid() made, once nothing is to be read from them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect garbage now: only then Spark removes shuffle files that nothing refers to any more.

    What Python and Arrow have freed goes back to the machine, where the C library can do that.
    """
    gc.collect()
    if "pyarrow" in sys.modules:
        sys.modules["pyarrow"].default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
    spark.sparkContext._jvm.System.gc()


def constant(rows: DataFrame, n: int) -> Column:
    """An array of n numbers, x at each k of rows (k int, x long; each k once) and 0 elsewhere, as a scalar subquery over a written row."""
    zeros = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("long").alias("x"))
    all_ = rows.unionByName(zeros).groupBy("k").agg(F.sum("x").alias("x")).agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("x", F.lit(0).cast("long")).alias("x")))).alias("all"))
    return cut(all_.select(F.transform("all", lambda y: y["x"]).alias("x"))).scalar()


SIEVE = 1 << 22


def sieve(rows: DataFrame, *keys: str) -> Callable[..., Column]:
    """A condition that holds for every key of rows and for few others, while rows are fewer than its SIEVE bits.

    It goes before a shuffled semi-join, which decides. The bits are one row of fixed size, which stays in the shared folder: as a
    literal it would stand in the text of every plan, and the driver keeps those.
    """
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(SIEVE))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_p") % 64).cast("int"))
    found = rows.select(place([F.col(k) for k in keys]).alias("_p")).groupBy((F.col("_p") / 64).cast("int").alias("k")).agg(F.bit_or(bit).alias("x"))
    table = constant(found, SIEVE // 64)

    def held(*cols: Column) -> Column:
        p = place(cols)
        return F.call_function("shiftright", F.element_at(table, (p / 64).cast("int") + 1), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    return held


def kept(name: str, make: Callable):
    """make(), once for each Python worker. Functions travel by value here, so module globals would not last."""
    store = sys.modules.setdefault("_framelake_worker", types.ModuleType("_framelake_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_index(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """df with a gapless index from 0 in the given order, without a single-task sort.

    Range partitions are sorted and written; the driver gets one row count for each partition and nothing else.
    """
    n = partitions(df.sparkSession)
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    starts, total = [], 0
    for pid, count in sorted(rows.groupBy("_pid").count().collect()):
        starts.append((pid, total))
        total += count
    if not starts:
        return rows.withColumn(name, F.lit(0).cast("long")).drop("_pid", "_at")
    offsets = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    return rows.withColumn(name, offsets[F.col("_pid")].cast("long") + F.col("_at")).drop("_pid", "_at")


def grouped(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str, n: int | None = None) -> DataFrame:
    """fn(key, pandas frame) for each group of keys, rows in the given order; fn returns a frame or None.

    One shuffle by the keys and a sort; groups then stream through Python, so that many small groups cost little.
    The callers bound the rows of a group by blocks or salts.
    """
    rows = df.repartition(n or partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)

    def run(frames: Iterator) -> Iterable:
        import pandas as pd

        held, key, out, size = [], None, [], 0
        for frame in frames:
            if not len(frame):
                continue
            new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy().copy()
            new[0] = True
            at = [*new.nonzero()[0], len(frame)]
            for a, b in zip(at, at[1:], strict=False):
                part = frame.iloc[a:b]
                k = tuple(part[keys].iloc[0])
                if k != key and held:
                    out.append(fn(key, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)))
                    held = []
                key = k
                held.append(part.reset_index(drop=True))
            out = [x for x in out if x is not None and len(x)]
            size = sum(map(len, out))
            if size >= 2000:
                yield pd.concat(out, ignore_index=True)
                out = []
        if held:
            out.append(fn(key, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)))
        out = [x for x in out if x is not None and len(x)]
        if out:
            yield pd.concat(out, ignore_index=True)

    return rows.mapInPandas(run, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges (a long, b long).

    Alternating large-star and small-star rounds; each joins on ids, and only two numbers come to the driver.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = cut(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components: not settled")
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
