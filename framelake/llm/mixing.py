"""Mixing sources to target weights by the cube method.

Every document of a source is wanted r = target / source size times: whole copies are certain, the fractional part is an
inclusion probability. The flight phase walks these probabilities through the null space of two balancing constraints, tokens
and documents, until units are 0 or 1; blocks of a source run apart, what they leave undecided (three units at most) meets in
the next round, and only the last block's units are landed at random; swaps in that block then make good the tokens that
landing has put out of balance. Null source is a source of its own, the last. Null and
empty texts have size 0 and may be taken, at no words. Repeated rows are units of their own. Empty tables give empty results.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import WORD, cut, grouped, table, with_index

WEIGHTS, MOST, BLOCK = (1.0, 2.0, 3.0), 3.0, 4000


def flight(p: list[float], size: list[float], rng: random.Random, land: bool = False) -> list[float]:
    """Inclusion probabilities after the flight: at most two stay strictly between 0 and 1; none if they land."""
    p, wanted, eps = list(p), list(p), 1e-9
    window: list[int] = []
    for k in [*(i for i, x in enumerate(p) if 0 < x < 1), None, None]:
        if k is not None:
            window.append(k)
        while len(window) >= (3 if k is not None else 2):
            if len(window) >= 3:
                a, b, c = (size[i] for i in window[:3])
                u = [b - c, c - a, a - b]  # orthogonal to the sizes and to (1, 1, 1)
                if not any(u):
                    u = [1.0, -1.0, 0.0]
            elif size[window[0]] == size[window[1]]:
                u = [1.0, -1.0]
            else:
                break
            up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(window, u, strict=False) if d)
            down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(window, u, strict=False) if d)
            step = up if rng.random() * (up + down) < down else -down
            for i, d in zip(window, u, strict=False):
                p[i] += step * d
                p[i] = 0.0 if p[i] < eps else 1.0 if p[i] > 1 - eps else p[i]
            window = [i for i in window if 0 < p[i] < 1]
    if land:
        for i in window:  # two units at most
            p[i] = float(rng.random() < p[i])
        off = sum(s * (x - w) for s, x, w in zip(size, p, wanted, strict=True))
        repair(p, size, off, [i for i, w in enumerate(wanted) if 0 < w < 1])
    return p


def repair(p: list[float], size: list[float], off: float, units: list[int], most: int = 4) -> None:
    """After landing: swap a taken unit for one left out, where that brings the tokens nearer to what they should be."""
    for _ in range(most):
        inside = sorted((size[i], i) for i in units if p[i] == 1.0)
        outside = sorted((size[i], i) for i in units if p[i] == 0.0)
        best = (abs(off), None, None)
        for s, i in inside:
            k = bisect_left(outside, (s - off, -1))
            for t, j in outside[max(0, k - 1) : k + 1]:
                if abs(off - s + t) < best[0]:
                    best = (abs(off - s + t), i, j)
        if best[1] is None:
            return
        p[best[1]], p[best[2]] = 0.0, 1.0
        off += size[best[2]] - size[best[1]]


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(src, source, source_size, target) from (source, source_size): shares by weight, the excess over most times a source reshared."""
    ranked = cut(with_index(sizes, [F.col("source").asc_nulls_last()], "src").withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))).withColumn("capped", F.lit(False)))
    while True:
        total, fixed, w = ranked.agg(F.sum("source_size"), F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)), F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w")))).first()
        share = (total - most * fixed) / w if w else 0.0
        wanted = F.when(F.col("capped"), F.col("source_size") * most).otherwise(F.col("w") * F.lit(share))
        ranked = cut(ranked.withColumn("over", ~F.col("capped") & (wanted > F.col("source_size") * most)).withColumn("capped", F.col("capped") | F.col("over")))
        if not ranked.where("over").take(1):
            return ranked.select("src", "source", F.col("source_size"), wanted.alias("target"))


def mix(docs: DataFrame, size, keys: list[str], weights: tuple = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """The columns of keys with size, source_size, target and copies (times the row is taken), a row for each row of docs.

    size: a column of whole words. Blocks and their order follow hashes of doc_id and text, so reruns agree.
    """
    rows = cut(docs.select(*keys, "source", size.cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("hash")).withColumn("rid", F.monotonically_increasing_id()))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumnRenamed("source", "s2")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # The table of sources is joined as Spark sees fit, without a broadcast hint: nothing bounds their number.
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
    left, flown, level = rows.where("p > 0").select("rid", "src", "size", "hash", "p"), None, 0
    while True:
        blocks = left.groupBy("src").agg(F.ceil(F.count("*") / block).alias("blocks"))
        given = cut(left.join(blocks, "src").withColumn("block", F.pmod(F.xxhash64("hash", F.lit(level)), F.col("blocks"))))
        last = (given.agg(F.max("blocks")).first()[0] or 0) <= 1

        def fly(key, f, level=level):
            rng = random.Random(zlib.crc32(f"{key[0]}/{level}/{key[1]}".encode()))
            f["p"] = flight(f["p"].tolist(), [float(x) for x in f["size"]], rng, bool(f["blocks"].iloc[0] <= 1))
            return f[["rid", "src", "size", "hash", "p"]]

        now = cut(grouped(given, ["src", "block"], ["hash", "size"], fly, "rid long, src long, size long, hash long, p double"))
        settled = now.where("p <= 0 or p >= 1").select("rid", "p")
        flown = settled if flown is None else flown.unionByName(settled)
        if last:
            break
        left = now.where("p > 0 and p < 1")
        level += 1
    taken = F.col("whole") + F.coalesce(F.col("f"), F.lit(0.0))
    return rows.join(flown.withColumnRenamed("p", "f"), "rid", "left").select(*keys, "size", "source_size", "target", taken.cast("long").alias("copies"))


def words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), words(), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents as mixed: a document taken k times is there k times."""
    # The scan is the same both times, and so are the ids it gives.
    rows = docs.withColumn("_uid", F.monotonically_increasing_id())
    mixed = mix(rows.select("_uid", "doc_id", "text", "source"), words(), ["_uid"]).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows.join(mixed.select("_uid", "copies"), "_uid").withColumn("_copy", copies).select(docs.columns)
