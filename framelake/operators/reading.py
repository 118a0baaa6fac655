"""Operators on characters, words and class scores: clustering, reading order, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import boxes
from framelake.operators.detection import fold_ordered, nms


def word_clusters(chars: DataFrame, image: str, x_gap: float = 20, y_gap: float = 10) -> DataFrame:
    """(image, word, n, box): characters joined, through any chain, where rows are nearer than y_gap and facing sides than x_gap.

    An image's characters meet in one task, as a sweep over sorted rows would have them; a page holds thousands at most.
    """

    def run(f):
        import numpy as np
        import pandas as pd

        f = f.sort_values("det_id", kind="stable")
        b = np.array([[x[k] for k in ("x1", "y1", "x2", "y2")] for x in f["box"]])
        parent = np.arange(len(b))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        order = np.argsort(b[:, 1], kind="stable")
        for k, i in enumerate(order):  # rows in reach, from above
            for j in order[k + 1 :]:
                if b[j, 1] - b[i, 1] >= y_gap:
                    break
                if abs(b[i, 2] - b[j, 0]) < x_gap or abs(b[j, 2] - b[i, 0]) < x_gap:
                    p, q = root(i), root(j)
                    parent[max(p, q)] = min(p, q)
        r = np.array([root(i) for i in range(len(b))])
        rows = []
        for w, k in enumerate(np.unique(r)):
            m = b[r == k]
            rows.append((f[image].iloc[0], w, len(m), {"x1": m[:, 0].min(), "y1": m[:, 1].min(), "x2": m[:, 2].max(), "y2": m[:, 3].max()}))
        return pd.DataFrame(rows, columns=[image, "word", "n", "box"])

    return chars.groupBy(image).applyInPandas(run, f"{image} {dict(chars.dtypes)[image]}, word int, n int, box struct<x1:double,y1:double,x2:double,y2:double>")


def reading_order(rows: DataFrame, image: str, y_gap: float = 10) -> DataFrame:
    """rows (det_id, box) with line and pos: from above, a box joins the first line whose first box is nearer than y_gap; in a line by x."""
    item = F.struct(F.col("box.y1").alias("y"), "det_id")
    state = F.struct(F.array().cast("array<double>").alias("tops"), F.array().cast("array<struct<det_id:bigint,line:int>>").alias("out"))

    def step(acc, x):
        near = F.filter(F.transform(acc["tops"], lambda t, i: F.when(F.abs(t - x["y"]) < y_gap, i)), lambda i: i.isNotNull())
        line = F.coalesce(F.get(near, F.lit(0)), F.size(acc["tops"]))
        tops = F.when(F.size(near) > 0, acc["tops"]).otherwise(F.concat(acc["tops"], F.array(x["y"])))
        return F.struct(tops.alias("tops"), F.concat(acc["out"], F.array(F.struct(x["det_id"].alias("det_id"), line.alias("line")))).alias("out"))

    lines = fold_ordered(rows, [image], item, state, step).select(image, F.explode("state.out").alias("o")).select(image, "o.det_id", "o.line")
    order = Window.partitionBy(image).orderBy("line", "box.x1", "box.y1", "det_id")
    return rows.join(lines, [image, "det_id"]).withColumn("pos", F.row_number().over(order) - 1)


def neighbour_quads(chars: DataFrame, key: str) -> DataFrame:
    """(key, pos, quad): midpoints of the upper and lower sides of a character and the next; chars: pos, q (array of 4 points x, y)."""
    w = Window.partitionBy(key).orderBy("pos")
    mid = lambda q, a, b: F.struct(((q[a]["x"] + q[b]["x"]) / 2).alias("x"), ((q[a]["y"] + q[b]["y"]) / 2).alias("y"))
    n = F.col("_n")
    rows = chars.withColumn("_n", F.lead("q").over(w)).where("_n is not null")
    return rows.select(key, "pos", F.array(mid(F.col("q"), 0, 1), mid(n, 0, 1), mid(n, 2, 3), mid(F.col("q"), 2, 3)).alias("quad"))


def cleaned_readings(rows: DataFrame, key: list[str], least: float = 0.5) -> DataFrame:
    """(key, text, conf): readings of a region in order as one lower-cased text with its mean confidence, if high and long enough."""
    got = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "reading"))).alias("r"), F.avg("conf").alias("conf"))
    joined = F.lower(F.trim(F.array_join(F.transform("r", lambda x: x["reading"]), " ")))
    return got.select(*key, joined.alias("text"), "conf").where((F.col("conf") >= least) & (F.length("text") >= 2))


def words_of(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(*key, "conf", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "word"))


def top_classes(scores: Column, k: int) -> Column:
    """The k best (p, class) of an array of structs, ties by class."""
    return F.slice(F.array_sort(F.transform(scores, lambda x: F.struct((-x["p"]).alias("m"), x["class"].alias("class")))), 1, k)


def one_vs_one(pairs: DataFrame, key: str, classes: int, a: float = 1.0, b: float = 0.0) -> DataFrame:
    """(key, class, p) from decisions (key, i, j, score) between classes i and j: Platt's probabilities summed by class, then shared out."""
    from framelake.functions.vectors import sigmoid

    p = sigmoid(F.col("score"), a, b)
    votes = pairs.select(key, F.explode(F.array(F.struct(F.col("i").alias("class"), p.alias("p")), F.struct(F.col("j").alias("class"), (1 - p).alias("p")))).alias("v"))
    sums = votes.groupBy(key, "v.class").agg(F.sum("v.p").alias("p"))
    return sums.withColumn("p", F.col("p") / (F.sum("p").over(Window.partitionBy(key)) + 1e-12))


def relabelled(rows: DataFrame, names: dict[str, str], column: str = "label") -> DataFrame:
    """Labels by a small map; those it lacks stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def best_per_class(dets: DataFrame, image: str, classes: list[str]) -> DataFrame:
    """(image, best): the best score of each class as a vector, 0 without."""
    return dets.groupBy(image).agg(F.array(*[F.coalesce(F.max(F.when(F.col("label") == c, F.col("score"))), F.lit(0.0)) for c in classes]).alias("best"))


def rescoring_features(dets: DataFrame, image: str, classes: list[str], w: float, h: float) -> DataFrame:
    b = F.col("box")
    own = F.array("score", b["x1"] / w, b["y1"] / h, b["x2"] / w, b["y2"] / h)
    return dets.join(best_per_class(dets, image, classes), image).select(image, "det_id", F.concat(own, "best").alias("features"))


def strategies(cands: DataFrame, image: str, k: int = 10, most: float = 0.3) -> DataFrame:
    """(image, strategy, rank, det_id, score): the same candidates by phrase score, object score and their sum, suppressed each."""
    kinds = F.array(*[F.struct(F.lit(n).alias("strategy"), s.alias("score")) for n, s in (("phrase", F.col("phrase")), ("object", F.col("object")), ("both", F.col("phrase") + F.col("object")))])
    rows = cands.select(image, "det_id", "box", F.explode(kinds).alias("s")).select(image, "det_id", "box", "s.strategy", "s.score")
    kept = nms(rows, [image, "strategy"], most, boxes.iou_pixels)
    w = Window.partitionBy(image, "strategy").orderBy(F.col("score").desc(), "det_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("box")


def window_width(gts: DataFrame, base: int = 104, least: int = 56, most: int = 184) -> DataFrame:
    """(label, w): window width of a class: base times the median aspect of its boxes, a multiple of 8, within limits."""
    b = F.col("box")
    ratio = F.when((boxes.width(b) > 4) & (boxes.height(b) > 4), boxes.width(b) / boxes.height(b))
    mid = gts.groupBy("label").agg(F.coalesce(F.percentile(ratio, F.lit(0.5)), F.lit(1.0)).alias("ar"))
    return mid.select("label", F.greatest(F.lit(least), F.least(F.lit(most), (F.rint(base * F.col("ar") / 8) * 8).cast("int"))).alias("w"))


def phrase_images(rows: DataFrame, image: str = "image", label: str = "label") -> DataFrame:
    """(label, images): images of each phrase - a label with an underscore -, most first."""
    return rows.where(F.col(label).contains("_")).groupBy(label).agg(F.count_distinct(image).alias("images")).orderBy(F.col("images").desc(), label)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n rows / (classes x rows of the class)."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    both = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return n.join(F.broadcast(both), F.lit(True)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def undersampled(rows: DataFrame, label: str, key: str, ratio: float = 0.09, seed: int = 0) -> DataFrame:
    """All rows of class 1 and about ratio of class 0, the same on every run."""
    share = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where((F.col(label) == 1) | (share < ratio))


def silhouette(rows: DataFrame, cluster: str = "l1", block: int = 4096, shares: int = 64) -> DataFrame:
    """(vec_id, s) over all rows (vec_id, v unit, cluster): by mean cosine distance to the own and to the nearest other cluster.

    With sums of unit vectors by cluster - few beside the rows - means need no pairs of rows. Up to block clusters are broadcast;
    more of them meet shares of the rows in blocks, by a join on block and share.
    """
    from framelake.functions import vectors

    flat = rows.select(cluster, F.posexplode("v").alias("i", "e")).groupBy(cluster, "i").agg(F.sum("e").alias("t"))
    sums = flat.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("t"))
    sums = sums.join(rows.groupBy(cluster).agg(F.count("*").alias("n")), cluster).select(F.col(cluster).alias("c"), "t", "n")
    blocks = -(-rows.select(cluster).distinct().count() // block)
    if blocks <= 1:
        d = rows.join(F.broadcast(sums), F.lit(True))
    else:
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        place = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
        sums = sums.withColumn("_block", place("c", blocks)).withColumn("_share", every(shares))
        d = rows.withColumn("_share", place("vec_id", shares)).withColumn("_block", every(blocks)).join(sums, ["_block", "_share"])
    d = d.withColumn("dot", vectors.dot("v", "t"))
    own = F.col("c") == F.col(cluster)
    mean = F.when(own, (F.col("n") - F.col("dot")) / F.greatest(F.lit(1), F.col("n") - 1)).otherwise(1 - F.col("dot") / F.col("n"))
    m = d.withColumn("m", mean).groupBy("vec_id").agg(F.max(F.when(own, F.col("m"))).alias("a"), F.min(F.when(~own, F.col("m"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("n"))
    return m.select("vec_id", F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0).alias("s"))


def elbow(values: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, k): the place farthest from the line between the first and the last value, 2 at least."""
    w = Window.partitionBy(key).orderBy(pos)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, n = F.first(value).over(whole), F.last(value).over(whole), F.count("*").over(Window.partitionBy(key))
    slope = (last - first) / (n - 1 + 1e-9)
    d = F.abs(first + slope * F.col(pos) - F.col(value)) / F.sqrt(slope * slope + 1)
    return values.withColumn("_d", d).groupBy(key).agg(F.greatest(F.lit(2), F.max_by(pos, F.struct("_d", -F.col(pos)))).alias("k"))


def batch(rows: DataFrame, key: str, i: int, size: int) -> DataFrame:
    """Rows i * size to (i + 1) * size of a gapless key."""
    return rows.where((F.col(key) >= i * size) & (F.col(key) < (i + 1) * size))


def embedding_rows(chunks: DataFrame, model: str) -> DataFrame:
    """Metadata rows of transcript chunks, ids by place in their video."""
    return chunks.select(F.concat(F.lit(f"{model}_"), "turn").alias("external_id"), "video", "text", "start", "end")
