"""Box geometry, suppression, pairs, anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import boxes
from framelake.operators import detection as det
from framelake.sources import catalog as c

def r(col, n=6):
    return F.round(col, n)


def _pairs(spark, d):
    x = c.detections(spark, d)
    return x.alias("a").join(x.alias("b"), (F.col("a.image") == F.col("b.image")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.det_id") < F.col("b.det_id")))


def iou_variants(spark, d):
    a, b = F.col("a.box"), F.col("b.box")
    return _pairs(spark, d).select(F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id"), *[r(f(a, b)).alias(k) for k, f in boxes.IOU.items()])


_I = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_P = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1)"
_S = lambda t, e="": f"(({t}.x2 - {t}.x1{e}) * ({t}.y2 - {t}.y1{e}))"
_U = f"({_S('a')} + {_S('b')} - {_I})"
_SAME = "FROM boxes a JOIN boxes b ON a.image = b.image AND a.label = b.label AND a.det_id < b.det_id"
IOU_SQL = c.sql(f"SELECT a.det_id AS a_id, b.det_id AS b_id, round({_I} / ({_U} + 1e-8), 6) AS eps, round(CASE WHEN {_I} <= 0 THEN 0 ELSE {_I} / ({_U} + 1e-6) END, 6) AS early, round({_I} / {_U}, 6) AS \"exact\", round({_P} / ({_S('a', ' + 1')} + {_S('b', ' + 1')} - {_P}), 6) AS pixels {_SAME}", "boxes")


def iou_self_pairs(spark, d):
    p = _pairs(spark, d).where(boxes.iou_exact(F.col("a.box"), F.col("b.box")) > 0.3)
    return p.select(F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id"))


SELF_SQL = c.sql(f"SELECT a.det_id AS a_id, b.det_id AS b_id {_SAME} WHERE {_I} / {_U} > 0.3", "boxes")


def nms_per_class(spark, d):
    return det.nms(c.detections(spark, d), ["image", "label"], 0.3).select("image", "label", "det_id")


_ROW = "{'s': -score, 'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
_LI = "greatest(0, least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1)) * greatest(0, least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1))"
NMS_SQL = c.sql(f"""SELECT image, label, unnest(list_transform(list_reduce(list_transform(list({_ROW} ORDER BY -score, det_id), lambda e: [e]),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_LI} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - {_LI} + 1e-8) > 0.3)) > 0 THEN acc ELSE list_concat(acc, x) END), lambda e: e.det_id)) AS det_id FROM boxes GROUP BY image, label""", "boxes")  # fmt: skip


def nms_capped(spark, d):
    """Three of each image and class at most, as detectors cap what they return."""
    return det.nms(c.detections(spark, d), ["image", "label"], 0.5, boxes.iou_early, cap=3).select("image", "label", "det_id")


CAPPED_SQL = c.sql(f"""SELECT image, label, unnest(list_transform(list_reduce(list_transform(list({_ROW} ORDER BY -score, det_id), lambda e: [e]),
  lambda acc, x: CASE WHEN len(acc) >= 3 OR len(list_filter(acc, lambda k: {_LI} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - {_LI} + 1e-6) > 0.5)) > 0 THEN acc ELSE list_concat(acc, x) END), lambda e: e.det_id)) AS det_id FROM boxes GROUP BY image, label""", "boxes")  # fmt: skip


def box_filters(spark, d):
    return det.plausible(c.detections(spark, d), 560, 460, least_area=6000).select("det_id", boxes.area(F.col("box")).alias("area"), *[v.alias(n) for v, n in zip(boxes.center(F.col("box")), ("cx", "cy"), strict=True)])


FILTER_SQL = c.sql("SELECT det_id, (x2-x1)*(y2-y1) AS area, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM boxes WHERE (x2-x1)*(y2-y1) >= 6000 AND (x2-x1)/(y2-y1) BETWEEN 0.1 AND 2.5 AND (x2-x1)*(y2-y1) < 0.8*560*460 AND x2-x1 < 280", "boxes")


def holes_anti(spark, d):
    return det.without_holes(c.detections(spark, d), ["image"]).select("image", "det_id")


HOLES_SQL = c.sql("SELECT image, det_id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM boxes o WHERE o.image = b.image AND o.det_id <> b.det_id AND b.x1 >= o.x1 AND b.y1 >= o.y1 AND b.x2 <= o.x2 AND b.y2 <= o.y2 AND ((b.x1, b.y1, b.x2, b.y2) <> (o.x1, o.y1, o.x2, o.y2) OR o.det_id < b.det_id))", "boxes")


def pair_ranking(spark, d):
    p = det.ordered_pairs(c.detections(spark, d), "image", 0.5, 0.05, True, 20)
    return p.select("image", "rank", "s_id", "o_id", r("iou").alias("iou"), r("distance", 4).alias("distance"))


_PAIR = f"FROM boxes a JOIN boxes b ON a.image = b.image AND a.det_id <> b.det_id WHERE a.score >= 0.5 AND b.score >= 0.5 AND {_I} / {_U} >= 0.05"
PAIR_SQL = c.sql(f"""SELECT * FROM (SELECT a.image, CAST(row_number() OVER (PARTITION BY a.image ORDER BY -round(a.score * b.score, 9), a.det_id, b.det_id) AS INTEGER) AS rank, a.det_id AS s_id, b.det_id AS o_id,
  round({_I} / {_U}, 6) AS iou, round(sqrt(pow((a.x1+a.x2)/2 - (b.x1+b.x2)/2, 2) + pow((a.y1+a.y2)/2 - (b.y1+b.y2)/2, 2)), 4) AS distance {_PAIR}) WHERE rank <= 20""", "boxes")  # fmt: skip


def spatial_features(spark, d):
    p = det.ordered_pairs(c.detections(spark, d), "image", 0.8, 0.1, True)
    f = boxes.spatial_features(F.col("s_box"), F.col("o_box"), 560.0, 460.0)
    return p.select("s_id", "o_id", *[r(x).alias(f"f{k}") for k, x in enumerate(f)])


_E = ["((a.x1+a.x2)/2 - (b.x1+b.x2)/2) / 560", "((a.y1+a.y2)/2 - (b.y1+b.y2)/2) / 460", f"ln(({_S('a')} + 1e-6) / ({_S('b')} + 1e-6))", f"{_I} / {_U}", "(a.x2-a.x1) / (b.x2-b.x1 + 1e-6)", "(a.y2-a.y1) / (b.y2-b.y1 + 1e-6)"] + [f"{t}.{v} / {560 if v[0] == 'x' else 460}" for t in "ab" for v in ("x1", "y1", "x2", "y2")]
SPATIAL_SQL = c.sql("SELECT a.det_id AS s_id, b.det_id AS o_id, " + ", ".join(f"round({e}, 6) AS f{k}" for k, e in enumerate(_E)) + f" FROM boxes a JOIN boxes b ON a.image = b.image AND a.det_id <> b.det_id WHERE a.score >= 0.8 AND b.score >= 0.8 AND {_I} / {_U} >= 0.1", "boxes")


def anchor_grid(spark, d):
    """Anchors of three feature maps, clipped to their images."""
    maps = spark.range(1, 4).select(F.col("id").alias("image"), (F.col("id") * 4).cast("int").alias("fh"), (F.col("id") * 5).cast("int").alias("fw"))
    a = det.anchors(maps).withColumn("clipped", boxes.clip(F.col("box"), F.col("image") * 80.0, F.col("image") * 64.0))
    return a.select("image", "i", "j", "k", *[r(F.col("box")[v], 4).alias(v) for v in ("x1", "y1", "x2", "y2")], r(boxes.area(F.col("clipped")), 2).alias("area"))


ANCHOR_SQL = """WITH m AS (SELECT unnest([1, 2, 3]) AS image), g AS (SELECT image, unnest(range(image * 4)) AS i FROM m), h AS (SELECT image, i, unnest(range(image * 5)) AS j FROM g),
k AS (SELECT unnest(range(9)) AS k, unnest([8, 8, 8, 16, 16, 16, 32, 32, 32]) * CAST(16 AS DOUBLE) AS s, unnest([0.5, 1, 2, 0.5, 1, 2, 0.5, 1, 2]) AS q),
b AS (SELECT image, i, j, k, j*16+8 - s*sqrt(1/CAST(q AS DOUBLE))/2 AS x1, i*16+8 - s*sqrt(CAST(q AS DOUBLE))/2 AS y1, j*16+8 + s*sqrt(1/CAST(q AS DOUBLE))/2 AS x2, i*16+8 + s*sqrt(CAST(q AS DOUBLE))/2 AS y2 FROM h, k)
SELECT CAST(image AS BIGINT) AS image, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2,
round((least(x2, image*80.0) - greatest(x1, 0)) * (least(y2, image*64.0) - greatest(y1, 0)), 2) AS area FROM b"""


def delta_roundtrip(spark, d):
    """Boxes to deltas against a shifted box, and back; mirrored boxes beside."""
    x = c.detections(spark, d).withColumn("roi", boxes.box(F.col("box")["x1"] + 3, F.col("box")["y1"] - 2, F.col("box")["x2"] + 9, F.col("box")["y2"] + 4)).withColumn("t", boxes.to_deltas(F.col("roi"), F.col("box")))
    x = x.withColumn("back", boxes.from_deltas(F.col("roi"), F.col("t"))).withColumn("m", boxes.flip(F.col("box"), 560))
    return x.select("det_id", *[r(F.col(f"t.{v}")).alias(v) for v in ("tx", "ty", "tw", "th")], *[r(F.col(f"back.{v}"), 4).alias(v) for v in ("x1", "y1", "x2", "y2")], F.col("m.x1").alias("mx1"), r(boxes.resize_scale(boxes.width(F.col("box")), boxes.height(F.col("box")))).alias("scale"))


DELTA_SQL = c.sql("""SELECT det_id, round(-6 / (x2-x1+6), 6) AS tx, round(-1 / (y2-y1+6), 6) AS ty, round(ln((x2-x1) / (x2-x1+6)), 6) AS tw, round(ln((y2-y1) / (y2-y1+6)), 6) AS th,
round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2, 560 - x2 AS mx1, round(least(600 / least(x2-x1, y2-y1), 1000 / greatest(x2-x1, y2-y1)), 6) AS scale FROM boxes""", "boxes")  # fmt: skip


def merge_boxes(spark, d):
    """Greedy merging within image and class; what overlaps a merged box makes it grow."""
    return det.merged_boxes(c.detections(spark, d), ["image", "label"]).select("image", "label", "pos", "n", *[F.col("box")[v].alias(v) for v in ("x1", "y1", "x2", "y2")])


_HIT = f"{_LI} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - {_LI} + 1e-8) > 0.3"
_AT = f"coalesce(list_position(list_transform(acc, lambda k: {_HIT}), true), 0)"
MERGE_SQL = c.sql(f"""+m AS (SELECT image, label, list_reduce(list_transform(list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'n': 1}} ORDER BY det_id), lambda e: [e]), lambda acc, x: CASE WHEN {_AT} = 0 THEN list_concat(acc, x)
  ELSE list_transform(acc, lambda o, i: CASE WHEN i = {_AT} THEN {{'x1': least(o.x1, x[1].x1), 'y1': least(o.y1, x[1].y1), 'x2': greatest(o.x2, x[1].x2), 'y2': greatest(o.y2, x[1].y2), 'n': o.n + 1}} ELSE o END) END) AS l FROM boxes GROUP BY image, label),
u AS (SELECT image, label, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS pos FROM m) SELECT image, label, CAST(pos AS INTEGER) AS pos, b.n AS n, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2 FROM u""", "boxes")  # fmt: skip


def background_windows(spark, d):
    """Windows of a grid that overlap no true box of the image by more than 0.3."""
    images = c.truths(spark, d).select("image").distinct()
    wins = images.select("image", F.posexplode(det.windows(560, 460, (128, 96), 96)).alias("pos", "box"))
    return det.rejected_windows(wins, c.truths(spark, d), ["image"]).groupBy("image").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"))


def _grid():
    parts, base = [], 0
    for s in (1.0, 0.75, 0.5):
        sw, sh = int(560 * s), int(460 * s)
        nx, ny = (sw - 128) // 96 + 1, (sh - 96) // 96 + 1
        t = lambda e, s=s: f"CAST(trunc(({e}) / CAST({s} AS DOUBLE)) AS DOUBLE)"
        parts.append(f"SELECT {base} + y * {nx} + x AS pos, {t('x*96')} AS x1, {t('y*96')} AS y1, {t('x*96+128')} AS x2, {t('y*96+96')} AS y2 FROM range({nx}) r(x), range({ny}) q(y)")
        base += nx * ny
    return " UNION ALL ".join(parts)


BACKGROUND_SQL = c.sql(f"+grid AS ({_grid()}), a AS (SELECT image, grid.* FROM (SELECT DISTINCT image FROM gt), grid) SELECT image, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos FROM a WHERE NOT EXISTS (SELECT 1 FROM gt b WHERE b.image = a.image AND {_I} > 0 AND {_I} / ({_U} + 1e-6) > 0.3) GROUP BY image", "boxes", "gt")


def context_features(spark, d):
    x = c.detections(spark, d)
    f = det.context_features(x.where("score > 0.9").select("image", "det_id", "box"), x, "image", ["click", "purchase", "view"])
    return f.select("image", "det_id", F.size("features").alias("n"), r(F.aggregate("features", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


CONTEXT_SQL = c.sql(f"""+a AS (SELECT * FROM boxes WHERE score > 0.9), b AS (SELECT * FROM boxes WHERE label IN ('click', 'purchase', 'view')),
p AS (SELECT a.image, a.det_id, b.label, CASE WHEN {_I} / {_U} > 0.1 THEN 'over' WHEN b.y1 + b.y2 < a.y1 + a.y2 THEN 'above' ELSE 'below' END AS place, b.score AS score, b.det_id AS did, b.score + {_I} / {_U} + {_S('b')} / {_S('a')} AS v FROM a JOIN b ON a.image = b.image AND a.det_id <> b.det_id),
k AS (SELECT image, det_id, arg_max(v, (score, -did)) AS v FROM p GROUP BY image, det_id, label, place)
SELECT a.image, a.det_id, CAST(27 AS INTEGER) AS n, round(coalesce(sum(v), 0), 4) AS total FROM a LEFT JOIN k ON a.image = k.image AND a.det_id = k.det_id GROUP BY a.image, a.det_id""", "boxes")  # fmt: skip

QUERIES = {
    "iou_variants": (iou_variants, IOU_SQL), "iou_self_pairs": (iou_self_pairs, SELF_SQL), "nms_per_class": (nms_per_class, NMS_SQL), "nms_capped": (nms_capped, CAPPED_SQL), "box_filters": (box_filters, FILTER_SQL),
    "holes_anti": (holes_anti, HOLES_SQL), "pair_ranking": (pair_ranking, PAIR_SQL), "spatial_features": (spatial_features, SPATIAL_SQL), "anchor_grid": (anchor_grid, ANCHOR_SQL), "delta_roundtrip": (delta_roundtrip, DELTA_SQL),
    "merge_boxes": (merge_boxes, MERGE_SQL), "background_windows": (background_windows, BACKGROUND_SQL), "context_features": (context_features, CONTEXT_SQL),
}
