"""Relationship priors: counts at every level, smoothed back-off, score fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (("s", "o", "p"), ("s", "p"), ("o", "p"), ("p",), ("s", "o"), ("s",), ("o",), ())


def counts(triples: DataFrame) -> DataFrame:
    """(s, o, p, g, n): one pass over triples (s, p, o) for all levels; g is the grouping id, absent columns are null."""
    return triples.groupingSets([[F.col(c) for c in level] for level in LEVELS], "s", "o", "p").agg(F.grouping_id("s", "o", "p").alias("g"), F.count("*").alias("n")).select("s", "o", "p", F.col("g").cast("int").alias("g"), "n")


def _level(c: DataFrame, *have: str) -> DataFrame:
    g = sum(b for b, k in ((4, "s"), (2, "o"), (1, "p")) if k not in have)
    return c.where(F.col("g") == g).select(*have, F.col("n").alias("n_" + "".join(have)))


def backoff(asked: DataFrame, c: DataFrame, predicates: int, smoothing: float = 1.0, least: int = 2) -> DataFrame:
    """asked (s, o, p) with prior: of the pair if seen often enough, else the mean of what is known of subject, object and pair,
    else of the predicate alone."""
    r = asked
    for have in (("s", "o"), ("s", "o", "p"), ("s",), ("s", "p"), ("o",), ("o", "p"), ("p",)):
        r = r.join(_level(c, *have), list(have), "left")
    total = c.where("g = 7").select(F.col("n").alias("n_all"))
    r = r.join(F.broadcast(total), F.lit(True), "left")
    n = lambda k: F.coalesce(F.col("n_" + k), F.lit(0))
    smooth = lambda a, b: (n(a) + smoothing) / (n(b) + smoothing * max(1, predicates))
    parts = [(smooth("sp", "s"), n("s") > 0), (smooth("op", "o"), n("o") > 0), (smooth("sop", "so"), n("so") > 0)]
    known = sum((F.when(k, 1).otherwise(0) for _, k in parts), F.lit(0))
    mean = sum((F.when(k, v).otherwise(0.0) for v, k in parts), F.lit(0.0)) / F.greatest(known, F.lit(1))
    prior = F.when(n("so") >= least, smooth("sop", "so")).when((n("s") > 0) | (n("o") > 0), mean).otherwise(smooth("p", "all"))
    return r.select(*asked.columns, prior.alias("prior"))


def zero_shot(pairs: DataFrame, c: DataFrame, words: DataFrame, predicates: int, k: int = 5, least: float = 0.5) -> DataFrame:
    """pairs (s, o, p), of labels never seen, with prior from the k known pairs whose word vectors are most alike; null where none is
    alike enough. words: (word, v). Known pairs are joined by blocks of the stated pairs, k of each stay."""
    from framelake.functions import vectors

    vec = lambda t: t.join(words.select(F.col("word").alias("s"), F.col("v").alias("sv")), "s").join(words.select(F.col("word").alias("o"), F.col("v").alias("ov")), "o").withColumn("x", F.concat("sv", "ov")).drop("sv", "ov")
    known = vec(_level(c, "s", "o")).select(F.col("s").alias("ks"), F.col("o").alias("ko"), F.col("x").alias("kx"), "n_so")
    asked = vec(pairs.select("s", "o").distinct())
    sims = asked.join(known, F.lit(True)).withColumn("sim", vectors.cosine("x", "kx"))
    top = sims.withColumn("r", F.row_number().over(Window.partitionBy("s", "o").orderBy(F.col("sim").desc(), "ks", "ko"))).where((F.col("r") <= k) & (F.col("sim") >= least))
    hit = pairs.join(top.select("s", "o", "ks", "ko", "sim", "n_so"), ["s", "o"]).join(_level(c, "s", "o", "p").select(F.col("s").alias("ks"), F.col("o").alias("ko"), "p", "n_sop"), ["ks", "ko", "p"], "left")
    raw = F.sum(F.col("sim") * F.coalesce("n_sop", F.lit(0)) / F.col("n_so")) / F.sum("sim")
    got = hit.groupBy("s", "o", "p").agg(F.greatest(raw, F.lit(1.0 / (10 * max(1, predicates)))).alias("prior"))
    return pairs.join(got, ["s", "o", "p"], "left")


def fused(rows: DataFrame, image: str, weight: float = 0.5, k: int = 10) -> DataFrame:
    """The k best triples of an image by prob * prior^weight * both objects' scores; ties by id."""
    score = F.col("prob") * F.pow("prior", F.lit(weight)) * F.col("s_score") * F.col("o_score")
    w = Window.partitionBy(image).orderBy(F.round("score", 9).desc(), "id")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def negatives(pairs: DataFrame, positives: DataFrame, keys: list[str], ratio: float = 3.0, seed: int = 0) -> DataFrame:
    """Pairs that are no positives, about ratio for each positive of their image (the first key), the same ones on every run."""
    image = keys[0]
    rest = pairs.join(positives.select(*keys), keys, "left_anti")
    n = positives.groupBy(image).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(image).orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)
    return rest.join(n, image).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_n") * ratio).drop("_r", "_n")


def mnr_loss(pairs: DataFrame, temperature: float = 0.05) -> DataFrame:
    """One row: in-batch contrastive loss of pairs (batch, i, a, b), both ways; a batch is small, and only its own rows meet."""
    from framelake.functions import vectors

    other = pairs.select("batch", F.col("i").alias("j"), F.col("b").alias("bj"))
    s = pairs.select("batch", "i", "a").join(other, "batch").withColumn("s", vectors.cosine("a", "bj") / temperature)
    one = lambda k: s.groupBy("batch", k).agg(F.log(F.sum(F.exp("s"))).alias("l"), F.max(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("own")).agg(F.avg(F.col("l") - F.col("own")).alias(f"loss_{k}"))
    return one("i").join(one("j"), F.lit(True)).select(((F.col("loss_i") + F.col("loss_j")) / 2).alias("loss"))
