"""Operators on detected boxes: filters, suppression, pairs, anchors, matching against truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import boxes


def fold_ordered(rows: DataFrame, keys: list[str], item: Column, init: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, name: str = "state") -> DataFrame:
    """One fold over the sorted items of each group: the shape of every greedy operator here. Groups are those of one image or video."""
    items = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return items.select(*keys, (F.aggregate("_items", init, step, finish) if finish else F.aggregate("_items", init, step)).alias(name))


def nms(dets: DataFrame, keys: list[str], most: float, iou: Callable[[Column, Column], Column] = boxes.iou_eps, cap: int | None = None) -> DataFrame:
    """Detections (det_id, score, box) kept by greedy suppression in each group, best score first, ties by det_id; at most cap."""
    item = F.struct((-F.col("score")).alias("s"), "det_id", "box")
    empty = F.array().cast("array<struct<s:double,det_id:bigint,box:struct<x1:double,y1:double,x2:double,y2:double>>>")
    hit = lambda kept, x: F.exists(kept, lambda k: iou(k["box"], x["box"]) > most)
    full = (lambda kept: F.size(kept) >= cap) if cap else (lambda kept: F.lit(False))
    kept = fold_ordered(dets, keys, item, empty, lambda kept, x: F.when(hit(kept, x) | full(kept), kept).otherwise(F.concat(kept, F.array(x))))
    return kept.select(*keys, F.explode("state").alias("k")).select(*keys, "k.det_id", (-F.col("k.s")).alias("score"), "k.box")


def merged_boxes(dets: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """Greedy merging in order of det_id: a box joins the first merged box it overlaps by more than least, which grows to hold both."""
    item = F.struct("det_id", "box")
    empty = F.array().cast("array<struct<box:struct<x1:double,y1:double,x2:double,y2:double>,n:int>>")

    def step(acc, x):
        at = F.array_position(F.transform(acc, lambda m: boxes.iou_eps(m["box"], x["box"]) > least), F.lit(True))
        grown = F.transform(acc, lambda m, i: F.when(i + 1 == at, F.struct(boxes.union_box(m["box"], x["box"]).alias("box"), (m["n"] + 1).alias("n"))).otherwise(m))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(F.struct(x["box"].alias("box"), F.lit(1).alias("n")))))

    out = fold_ordered(dets, keys, item, empty, step)
    return out.select(*keys, F.posexplode("state").alias("pos", "m")).select(*keys, "pos", "m.box", "m.n")


def plausible(dets: DataFrame, w: float, h: float, least_area: float = 400, aspect: tuple = (0.1, 2.5), share: float = 0.8, width: float = 0.5) -> DataFrame:
    """Boxes of a size and shape that text can have in an image of w by h."""
    b = F.col("box")
    ratio = F.try_divide(boxes.width(b), boxes.height(b))
    return dets.where((boxes.area(b) >= least_area) & ratio.between(*aspect) & (boxes.area(b) < share * w * h) & (boxes.width(b) < width * w))


def without_holes(dets: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes that no other of their group contains; of equal boxes the smallest det_id stays."""
    outer = dets.select(*keys, F.col("det_id").alias("oid"), F.col("box").alias("o"))
    o, b = F.col("o"), F.col("box")
    inside = (b["x1"] >= o["x1"]) & (b["y1"] >= o["y1"]) & (b["x2"] <= o["x2"]) & (b["y2"] <= o["y2"]) & (F.col("oid") != F.col("det_id")) & ((b != o) | (F.col("oid") < F.col("det_id")))
    cond = inside
    for k in keys:
        cond = cond & (dets[k] == outer[k])
    return dets.join(outer, cond, "left_anti")


def ordered_pairs(dets: DataFrame, image: str, least_score: float = 0.0, least_iou: float = 0.0, overlapping: bool = False, most: int | None = None) -> DataFrame:
    """Ordered pairs of different detections of an image, by product of scores; if scores are all alike, by distance of centres."""
    side = lambda n: dets.where(F.col("score") >= least_score).select(F.col(image), F.col("det_id").alias(f"{n}_id"), F.col("label").alias(f"{n}_label"), F.col("score").alias(f"{n}_score"), F.col("box").alias(f"{n}_box"))
    pairs = side("s").join(side("o"), image).where("s_id <> o_id").withColumn("iou", boxes.iou_exact(F.col("s_box"), F.col("o_box"))).where(F.col("iou") >= least_iou)
    if overlapping:
        pairs = pairs.where("iou > 0")
    (sx, sy), (ox, oy) = boxes.center(F.col("s_box")), boxes.center(F.col("o_box"))
    pairs = pairs.withColumn("distance", F.sqrt((sx - ox) ** 2 + (sy - oy) ** 2))
    w = Window.partitionBy(image)
    uniform = F.max("s_score").over(w) - F.min("s_score").over(w) < 1e-9
    rank = F.row_number().over(w.orderBy(F.when(F.col("_uniform"), F.col("distance")).otherwise(-F.round(F.col("s_score") * F.col("o_score"), 9)), "s_id", "o_id"))
    pairs = pairs.withColumn("_uniform", uniform).withColumn("rank", rank).drop("_uniform")
    return pairs.where(F.col("rank") <= most) if most else pairs


def anchors(rows: DataFrame, stride: int = 16, scales: tuple = (8.0, 16.0, 32.0), ratios: tuple = (0.5, 1.0, 2.0)) -> DataFrame:
    """Anchor boxes over feature maps (image, fh, fw): for each cell, scales x ratios boxes about its middle."""
    cells = rows.select("image", F.explode(F.sequence(F.lit(0), F.col("fh") - 1)).alias("i"), "fw").select("image", "i", F.explode(F.sequence(F.lit(0), F.col("fw") - 1)).alias("j"))
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s * stride * (1 / r) ** 0.5 / 2).alias("hw"), F.lit(s * stride * r**0.5 / 2).alias("hh")) for k, (s, r) in enumerate((s, r) for s in scales for r in ratios)])
    cells = cells.withColumn("a", F.explode(kinds))
    cx, cy = F.col("j") * stride + stride / 2, F.col("i") * stride + stride / 2
    return cells.select("image", "i", "j", F.col("a.k").alias("k"), boxes.box(cx - F.col("a.hw"), cy - F.col("a.hh"), cx + F.col("a.hw"), cy + F.col("a.hh")).alias("box"))


def windows(w: int, h: int, size: tuple[int, int], step: int, scales: tuple = (1.0, 0.75, 0.5)) -> Column:
    """Windows over an image at several scales, mapped back with whole numbers, as an array of boxes."""
    parts = []
    for s in scales:
        sw, sh = int(w * s), int(h * s)
        if sw < size[0] or sh < size[1]:
            continue
        xs, ys = F.sequence(F.lit(0), F.lit(sw - size[0]), F.lit(step)), F.sequence(F.lit(0), F.lit(sh - size[1]), F.lit(step))
        whole = lambda c, s=s: (c / s).cast("int")
        parts.append(F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: boxes.box(whole(x), whole(y), whole(x + size[0]), whole(y + size[1]))))))
    return F.concat(*parts) if parts else F.array()


def matched(dets: DataFrame, gts: DataFrame, keys: list[str], least: float = 0.5, free_only: bool = False, iou: Callable[[Column, Column], Column] = boxes.iou_eps) -> DataFrame:
    """(keys, det_id, score, tp): each detection's outcome, best scores first, ties by det_id: 1 true, 0 false, null not counted.

    free_only: the best truth is sought among those not taken yet; otherwise among all, and a taken one makes the detection false.
    A truth that is difficult is never taken and its detections do not count. Truths and detections of a group meet in one fold.
    """
    gt = gts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("gt_id", "box", "difficult"))).alias("g"))
    # The join is by group, and a group is one image's class.
    items = dets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "det_id", "box"))).alias("d")).join(gt, keys, "left")
    kinds = dict(dets.dtypes)
    state = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast(f"array<struct<det_id:{kinds['det_id']},score:double,tp:int>>").alias("out"))

    def step(acc, x):
        free = F.filter("g", lambda t: ~F.array_contains(acc["taken"], t["gt_id"])) if free_only else F.col("g")
        near = F.transform(free, lambda t: F.struct(iou(x["box"], t["box"]).alias("iou"), (-t["gt_id"]).alias("gt"), t["difficult"].alias("hard")))
        best = F.array_max(near)
        hit = F.coalesce(best["iou"] >= least, F.lit(False)) & ~F.array_contains(acc["taken"], F.coalesce(-best["gt"], F.lit(-1)))
        hard = F.coalesce(best["hard"], F.lit(False))
        tp = F.when(hit & ~hard, 1).when(hit & hard, F.lit(None).cast("int")).otherwise(0)
        taken = F.when(hit & ~hard, F.concat(acc["taken"], F.array(-best["gt"]))).otherwise(acc["taken"])
        return F.struct(taken.alias("taken"), F.concat(acc["out"], F.array(F.struct(x["det_id"].alias("det_id"), (-x["s"]).alias("score"), tp.alias("tp")))).alias("out"))

    folded = items.select(*keys, F.aggregate("d", state, step).alias("s"))
    return folded.select(*keys, F.explode("s.out").alias("o")).select(*keys, "o.det_id", "o.score", "o.tp")


def rejected_windows(wins: DataFrame, gts: DataFrame, keys: list[str], most: float = 0.3) -> DataFrame:
    """Windows that overlap no truth of their group by more than most."""
    g = gts.select(*keys, F.col("box").alias("g"))
    cond = boxes.iou_early(F.col("box"), F.col("g")) > most
    for k in keys:
        cond = cond & (wins[k] == g[k])
    return wins.join(g, cond, "left_anti")


def context_features(cands: DataFrame, dets: DataFrame, image: str, classes: list[str]) -> DataFrame:
    """For each candidate and class, of the best detection above, overlapping (IoU > 0.1) and below: score, IoU, area ratio; 0 without."""
    d = dets.select(F.col(image), F.col("label").alias("c"), F.col("score").alias("ds"), F.col("box").alias("db"), F.col("det_id").alias("did"))
    p = cands.join(d, image).where("did <> det_id")
    iou = boxes.iou_exact(F.col("box"), F.col("db"))
    place = F.when(iou > 0.1, "over").when(boxes.center(F.col("db"))[1] < boxes.center(F.col("box"))[1], "above").otherwise("below")
    p = p.withColumn("f", F.struct(F.col("ds").alias("score"), (-F.col("did")).alias("tie"), iou.alias("iou"), (boxes.area(F.col("db")) / boxes.area(F.col("box"))).alias("ratio"))).withColumn("k", F.concat_ws("_", "c", place))
    best = p.groupBy(image, "det_id", "k").agg(F.max("f").alias("f"))
    m = best.groupBy(image, "det_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "f"))).alias("m"))
    out = cands.join(m, [image, "det_id"], "left")
    keys = [f"{c}_{w}" for c in classes for w in ("above", "over", "below")]
    values = F.flatten(F.array(*[F.array(*[F.coalesce(F.try_element_at("m", F.lit(k))[x], F.lit(0.0)) for x in ("score", "iou", "ratio")]) for k in keys]))
    return out.select(image, "det_id", values.alias("features"))
