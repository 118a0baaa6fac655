"""Operators on ordered sequences: shot cuts, scenes, topic boundaries, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import vectors
from framelake.operators.detection import fold_ordered


def _order(keys: list[str], by: str):
    return Window.partitionBy(*keys).orderBy(by)


def lag_score(frames: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of absolute changes of channels to the frame before; 0 at the first."""
    w = _order([key], "frame")
    total = sum(abs(x) for x in weights.values())
    change = sum((F.abs(F.col(c) - F.lag(c).over(w)) * x for c, x in weights.items()), F.lit(0.0))
    return frames.withColumn("change", F.coalesce(change / total, F.lit(0.0)))


def adaptive_cuts(frames: DataFrame, key: str, k: float = 2.5, history: int = 50, least: int = 10) -> DataFrame:
    """(key, n, cuts): frames whose score exceeds mean + k deviations of the running history.

    The history holds the last scores, history at most; it decides once it has least; a cut leaves its last ten.
    """
    empty = F.array().cast("array<double>")
    state = F.struct(empty.alias("h"), F.array().cast("array<int>").alias("cuts"))

    def step(acc, x):
        h, n = acc["h"], F.size(acc["h"])
        mean = F.aggregate(h, F.lit(0.0), lambda s, v: s + v) / n
        sd = F.sqrt(F.aggregate(h, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)
        cut = F.when(n >= least, x["score"] > mean + k * sd).otherwise(F.lit(False))
        kept = F.concat(F.when(cut, F.slice(h, F.greatest(F.lit(1), n - 9), F.lit(10))).otherwise(h), F.array(x["score"]))
        kept = F.when(F.size(kept) > history, F.slice(kept, F.size(kept) - history + 1, F.lit(history))).otherwise(kept)
        return F.struct(kept.alias("h"), F.when(cut, F.concat(acc["cuts"], F.array(x["frame"]))).otherwise(acc["cuts"]).alias("cuts"))

    cuts = fold_ordered(frames, [key], F.struct("frame", "score"), state, step)
    n = frames.groupBy(key).agg(F.count("*").cast("int").alias("n"))
    return cuts.join(n, key).select(key, "n", F.col("state.cuts").alias("cuts"))


def clean_cuts(raw: Column, total: Column, min_len: int = 10) -> Column:
    """0, then each cut that comes more than min_len after the raw one before it, then the total."""
    every = F.concat(F.array(F.lit(0)), raw, F.array(total))
    ends = F.filter(F.transform(F.sequence(F.lit(1), F.size(every) - 1), lambda i: F.struct(every[i].alias("c"), (every[i] - every[i - 1] > min_len).alias("ok"))), lambda x: x["ok"])
    out = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x["c"]))
    return F.when(F.element_at(out, -1) != total, F.concat(out, F.array(total))).otherwise(out)


def scenes(rows: DataFrame, key: str, cuts: str, fps: float = 25.0) -> DataFrame:
    """(key, index, start_frame, end_frame, start_time, end_time): between cuts, each start one after the end before."""
    ends = rows.select(key, F.posexplode(F.slice(cuts, F.lit(2), F.size(cuts))).alias("i", "end_frame"))
    start = F.coalesce(F.lag("end_frame").over(_order([key], "i")) + 1, F.lit(0))
    return ends.withColumn("start_frame", start).select(key, (F.col("i") + 1).alias("index"), "start_frame", "end_frame", (F.col("start_frame") / fps).alias("start_time"), (F.col("end_frame") / fps).alias("end_time"))


def window_stats(frames: DataFrame, key: str, value: str = "score", half: int = 5) -> DataFrame:
    """Mean, deviation, largest and smallest over 2 half + 1 frames, as if there were zeros beyond the ends."""
    w = _order([key], "frame").rowsBetween(-half, half)
    n = 2 * half + 1
    mean = F.sum(value).over(w) / n
    short = F.count("*").over(w) < n
    var = F.greatest(F.lit(0.0), F.sum(F.col(value) * F.col(value)).over(w) / n - mean * mean)
    edge = lambda f, g: F.when(short, g(f(value).over(w), F.lit(0.0))).otherwise(f(value).over(w))
    return frames.select(key, "frame", F.col(value), mean.alias("mean"), F.sqrt(var).alias("std"), edge(F.max, F.greatest).alias("max"), edge(F.min, F.least).alias("min"))


def thinned(frames: DataFrame, key: str, least: int) -> DataFrame:
    """(key, kept): frames at least so far from the one kept before; the first is kept."""
    none = F.array().cast("array<int>")
    far = lambda acc, x: F.when(F.size(acc) == 0, True).otherwise(x["frame"] - F.element_at(acc, -1) >= least)
    return fold_ordered(frames, [key], F.struct("frame"), none, lambda acc, x: F.when(far(acc, x), F.concat(acc, F.array(x["frame"]))).otherwise(acc), name="kept")


def flash_filter(frames: DataFrame, key: str, mode: str = "SUPPRESS", length: int = 15) -> DataFrame:
    """(key, cuts) from frames with above (boolean): flashes within length of one another are dropped or become one cut.

    last starts at the first frame. SUPPRESS: a frame above counts if length after last, which it then is. MERGE: frames above
    move last; the first above after a pause counts, and further ones open a run that counts, at last, once it is over and long.
    """
    nothing = F.lit(None).cast("int")
    state = F.struct(nothing.alias("last"), F.lit(False).alias("on"), nothing.alias("start"), F.array().cast("array<int>").alias("cuts"))

    def step(acc, x):
        f, above = x["frame"], x["above"]
        last = F.coalesce(acc["last"], f)
        calm = f - last >= length
        add = lambda c, v: F.when(c, F.concat(acc["cuts"], F.array(v))).otherwise(acc["cuts"])
        if mode == "SUPPRESS":
            hit = above & calm
            return F.struct(F.when(hit, f).otherwise(last).alias("last"), acc["on"].alias("on"), acc["start"].alias("start"), add(hit, f).alias("cuts"))
        moved = F.when(above, f).otherwise(last)
        run = acc["start"].isNotNull()
        over = run & calm & ~above & (moved - acc["start"] >= length)
        fresh = ~run & above & calm
        opens = ~run & above & ~calm & acc["on"]
        cuts = F.when(over, F.concat(acc["cuts"], F.array(moved))).when(fresh, F.concat(acc["cuts"], F.array(f))).otherwise(acc["cuts"])
        return F.struct(moved.alias("last"), (acc["on"] | fresh).alias("on"), F.when(over, nothing).when(opens, f).otherwise(acc["start"]).alias("start"), cuts.alias("cuts"))

    return fold_ordered(frames, [key], F.struct("frame", "above"), state, step).select(key, F.col("state.cuts").alias("cuts"))


def block_similarity(sents: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(key, pos, n, sim): cosine of the means of the w vectors before and from each place on, w = max(1, min(most, n / 4)).

    The first w places take the value at w, the last w that of the last place before them; all are 0 where n <= 2 w.
    """
    n = F.count("*").over(Window.partitionBy(key))
    rows = sents.withColumn("n", n.cast("int")).withColumn("w", F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("n") / 4).cast("int"))))
    w = _order([key], "pos")
    # Frames of windows are constants: the largest is read, and what w leaves out is cut off.
    before = F.slice(F.collect_list("v").over(w.rowsBetween(-most, -1)), -F.least(F.col("w"), F.greatest(F.col("pos").cast("int"), F.lit(1))), F.col("w"))
    after = F.slice(F.collect_list("v").over(w.rowsBetween(0, most - 1)), F.lit(1), F.col("w"))
    total = lambda vs: F.aggregate(vs, F.transform("v", lambda x: x * 0.0), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    rows = rows.withColumn("b", F.when(F.col("pos") > 0, before)).withColumn("a", after)
    inside = (F.col("pos") >= F.col("w")) & (F.col("pos") < F.col("n") - F.col("w"))
    rows = rows.withColumn("sim", F.when(inside, vectors.cosine(total(F.col("b")), total(F.col("a")))))
    g = Window.partitionBy(key)
    first = F.max(F.when(F.col("pos") == F.col("w"), F.col("sim"))).over(g)
    last = F.max(F.when(F.col("pos") == F.col("n") - F.col("w") - 1, F.col("sim"))).over(g)
    sim = F.when(F.col("n") <= 2 * F.col("w"), 0.0).when(F.col("pos") < F.col("w"), first).when(F.col("pos") >= F.col("n") - F.col("w"), last).otherwise(F.col("sim"))
    return rows.select(key, "pos", "n", sim.alias("sim"))


def smoothed(rows: DataFrame, key: str, value: str = "sim", sigma: float = 1.0) -> DataFrame:
    """(key, pos, smooth): a Gaussian of radius int(3 sigma), the ends mirrored without their last value."""
    import math

    radius = max(1, int(3.0 * sigma))
    kernel = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-radius, radius + 1)]
    weights = F.array(*[F.lit(k / sum(kernel)) for k in kernel])
    xs = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias("x"))
    n = F.size("x")

    def at(i):  # mirrored as often as needed
        period = F.greatest(F.lit(1), 2 * (n - 1))
        m = F.pmod(i, period)
        return F.get("x", F.when(m < n, m).otherwise(period - m))

    y = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(2 * radius)), F.lit(0.0), lambda s, j: s + F.get(weights, j) * at(i + j - radius)))
    return xs.select(key, F.posexplode(y).alias("pos", "smooth"))


def valleys(rows: DataFrame, key: str, value: str = "smooth", prominence: float = 0.005, alpha: float = 0.6) -> DataFrame:
    """Strict local minima, deep enough beside their neighbours and below mean - alpha deviations."""
    w, g = _order([key], "pos"), Window.partitionBy(key)
    x = F.col(value)
    left, right = F.lag(value).over(w) - x, F.lead(value).over(w) - x
    threshold = F.avg(value).over(g) - alpha * (F.stddev_pop(value).over(g) + 1e-8)
    out = rows.withColumn("_l", left).withColumn("_r", right).withColumn("_t", threshold)
    return out.where((F.col("_l") > 0) & (F.col("_r") > 0) & (F.least("_l", "_r") >= prominence) & (x <= F.col("_t"))).drop("_l", "_r", "_t")


def ranges(boundaries: DataFrame, sizes: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, range_id, first, last) that cover 0..n-1: a boundary opens a range if the one before has least places."""
    none = F.array(F.lit(0))
    step = lambda acc, b: F.when(b["pos"] - F.element_at(acc, -1) >= least, F.concat(acc, F.array(b["pos"]))).otherwise(acc)
    folded = fold_ordered(boundaries, [key], F.struct(F.col("pos").cast("int").alias("pos")), none, step, name="starts")
    rows = sizes.join(folded, key, "left").withColumn("starts", F.coalesce("starts", F.array(F.lit(0))))
    flat = rows.select(key, "n", "starts", F.posexplode("starts").alias("range_id", "first"))
    return flat.select(key, "range_id", "first", (F.coalesce(F.get("starts", F.col("range_id") + 1), F.col("n")) - 1).cast("int").alias("last"))


def merged_ranges(chunks: DataFrame, rng: DataFrame, key: str) -> DataFrame:
    """Text of the chunks of a range in order, its first start and last end."""
    hit = chunks.join(rng, key).where(F.col("pos").between(F.col("first"), F.col("last")))
    item = F.sort_array(F.collect_list(F.struct("pos", "text", "start", "end")))
    rows = hit.groupBy(key, "range_id").agg(item.alias("c"))
    return rows.select(key, "range_id", F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("text"), F.round(F.element_at("c", 1)["start"], 2).alias("start"), F.round(F.element_at("c", -1)["end"], 2).alias("end"))


def titles(texts: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """(keys, title): the n most frequent words of more than two letters, by length, each with a capital; ties by first place."""
    from framelake.functions.text import TITLE_STOP_WORDS

    words = F.split(F.regexp_replace(F.lower("text"), r"[^a-z\s]", ""), r"\s+")
    flat = texts.select(*keys, F.posexplode(words).alias("at", "w")).where((F.length("w") > 2) & ~F.col("w").isin(*TITLE_STOP_WORDS))
    counts = flat.groupBy(*keys, "w").agg(F.count("*").alias("c"), F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("c").desc(), "at"))
    top = counts.withColumn("r", rank).where(F.col("r") <= n).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.length("w").alias("l"), "r", "w"))).alias("t"))
    named = top.select(*keys, F.initcap(F.array_join(F.transform("t", lambda x: x["w"]), " ")).alias("title"))
    return texts.select(*keys).join(named, keys, "left").withColumn("title", F.coalesce("title", F.lit("Untitled")))


def optimal_scenes(shots: DataFrame, key: str, k: int) -> DataFrame:
    """(key, scene, first, last): shots (key, shot, v) in k runs, the sum of distances within runs over the sum of the runs' squared sizes the least.

    The least ratio is found by the parametric method: for a ratio r, dynamic programming finds the runs with the least sum of
    distances - r * squared size; their own ratio is the next r, until none is lower. Each round goes over the ends of runs, so a
    video of n shots takes memory for its vectors and k n sums, and time for n^2 distances a round; rounds are few. With fewer
    shots than k every shot is a run. Of equal sums the earlier cut counts.
    """

    def run(f):
        import numpy as np
        import pandas as pd

        f = f.sort_values("shot")
        x = np.stack(f["v"].to_numpy())
        n, m = len(x), min(k, len(x))
        squares = np.einsum("ij,ij->i", x, x)

        def least(r):
            """Cuts with the least sum at ratio r, that sum, and the sum of distances within the runs."""
            best, back = np.full((m, n + 1), np.inf), np.zeros((m, n + 1), int)
            inside = np.zeros((m, n + 1))
            block = np.zeros(n)  # sums of the distances within the runs from each shot to the last one met
            for e in range(1, n + 1):
                dist = np.sqrt(np.maximum(squares[:e] + squares[e - 1] - 2 * (x[:e] @ x[e - 1]), 0))
                dist[-1] = 0
                block[:e] += 2 * dist[::-1].cumsum()[::-1]
                cost = block[:e] - r * np.arange(e, 0, -1.0) ** 2
                best[0, e], inside[0, e] = cost[0], block[0]
                for j in range(1, m):
                    total = best[j - 1, :e] + cost
                    at = back[j, e] = total.argmin()
                    best[j, e], inside[j, e] = total[at], inside[j - 1, at] + block[at]
            cuts = [n]
            for j in range(m - 1, 0, -1):
                cuts.append(int(back[j][cuts[-1]]))
            return [0, *cuts[::-1]], best[m - 1, n], inside[m - 1, n]

        cuts, _, within = least(0.0)
        while True:
            r = within / (np.diff(cuts) ** 2).sum()
            lower, left, within = least(r)
            if left >= -1e-9 * max(1.0, within) or lower == cuts:
                break
            cuts = lower
        return pd.DataFrame({key: f[key].iloc[0], "scene": range(m), "first": cuts[:-1], "last": [c - 1 for c in cuts[1:]]})

    return shots.groupBy(key).applyInPandas(run, f"{key} {dict(shots.dtypes)[key]}, scene int, first int, last int")

