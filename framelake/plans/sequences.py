"""Shot cuts, scenes, topic boundaries and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import sequences as seq
from framelake.sources import catalog as c

r = F.round


def frame_lag_score(spark, d):
    f = c.frame_scores(spark, d).withColumn("edge", F.sqrt(F.abs(F.col("score"))))
    return seq.lag_score(f, "video", {"score": 1.0, "edge": 15.0}).select("video", "frame", r("change", 4).alias("change"))


LAG_SQL = c.sql("SELECT video, CAST(frame AS INTEGER) AS frame, round(coalesce((abs(score - lag(score) OVER w) + 15 * abs(sqrt(abs(score)) - lag(sqrt(abs(score))) OVER w)) / 16, 0), 4) AS change FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame)", "frames")


def adaptive_cuts(spark, d):
    x = seq.adaptive_cuts(c.frame_scores(spark, d), "video")
    return x.select("video", "n", F.array_join(F.col("cuts").cast("array<string>"), ",").alias("cuts"))


_MU = "(list_sum(a.h) / len(a.h))"
CUTS = f"""folded AS (SELECT video, list_reduce(list_prepend({{'h': CAST([] AS DOUBLE[]), 'cuts': CAST([] AS BIGINT[]), 'f': CAST(-1 AS BIGINT), 's': CAST(0 AS DOUBLE)}}, list({{'h': CAST([] AS DOUBLE[]), 'cuts': CAST([] AS BIGINT[]), 'f': frame, 's': score}} ORDER BY frame)),
  lambda a, x: CASE WHEN len(a.h) >= 10 AND x.s > {_MU} + CAST(2.5 AS DOUBLE) * sqrt(list_sum(list_transform(a.h, lambda v: (v - {_MU}) * (v - {_MU}))) / len(a.h))
    THEN {{'h': list_append(a.h[-10:], x.s), 'cuts': list_append(a.cuts, x.f), 'f': x.f, 's': x.s}} ELSE {{'h': list_append(a.h, x.s)[-50:], 'cuts': a.cuts, 'f': x.f, 's': x.s}} END) AS state, count(*) AS n FROM frames GROUP BY video)"""
CUTS_SQL = c.sql(f"+{CUTS} SELECT video, CAST(n AS INTEGER) AS n, array_to_string(state.cuts, ',') AS cuts FROM folded", "frames")


def scenes_from_cuts(spark, d):
    x = seq.adaptive_cuts(c.frame_scores(spark, d), "video").withColumn("clean", seq.clean_cuts(F.col("cuts"), F.col("n")))
    return seq.scenes(x, "video", "clean").select("video", "index", "start_frame", "end_frame", r("start_time", 4).alias("start_time"), r("end_time", 4).alias("end_time"))


SCENES_SQL = c.sql(f"""+{CUTS}, e AS (SELECT video, n, list_concat(list_concat([0], state.cuts), [n]) AS x FROM folded),
k AS (SELECT video, n, list_filter(x, lambda v, i: i > 1 AND v - x[i - 1] > 10) AS y FROM e), z AS (SELECT video, CASE WHEN len(y) = 0 OR y[-1] <> n THEN list_append(y, n) ELSE y END AS y FROM k),
s AS (SELECT video, unnest(y) AS b, generate_subscripts(y, 1) AS i FROM z), t AS (SELECT video, i, b, coalesce(lag(b) OVER (PARTITION BY video ORDER BY i) + 1, 0) AS a FROM s)
SELECT video, CAST(i AS INTEGER) AS index, CAST(a AS INTEGER) AS start_frame, CAST(b AS INTEGER) AS end_frame, round(a / CAST(25 AS DOUBLE), 4) AS start_time, round(b / CAST(25 AS DOUBLE), 4) AS end_time FROM t""", "frames")  # fmt: skip


def window_stats_pm5(spark, d):
    x = seq.window_stats(c.frame_scores(spark, d), "video")
    return x.select("video", "frame", *[r(v, 3).alias(v) for v in ("mean", "std", "max", "min")])


WINDOW_SQL = c.sql("""SELECT video, CAST(frame AS INTEGER) AS frame, round(sum(score) OVER w / 11, 3) AS mean, round(sqrt(greatest(0, sum(score * score) OVER w / 11 - pow(sum(score) OVER w / 11, 2))), 3) AS std,
round(CASE WHEN count(*) OVER w < 11 THEN greatest(0, max(score) OVER w) ELSE max(score) OVER w END, 3) AS max, round(CASE WHEN count(*) OVER w < 11 THEN least(0, min(score) OVER w) ELSE min(score) OVER w END, 3) AS min
FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""", "frames")  # fmt: skip


def fixed_cuts(spark, d):
    """Frames above 150 that are at least ten after the one kept before."""
    x = seq.thinned(c.frame_scores(spark, d).where("score > 150"), "video", 10)
    return x.select("video", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


FIXED_SQL = c.sql("""SELECT video, array_to_string(list_reduce(list([frame] ORDER BY frame), lambda a, x: CASE WHEN x[1] - a[-1] >= 10 THEN list_concat(a, x) ELSE a END), ',') AS kept FROM frames WHERE score > 150 GROUP BY video""", "frames")


def flash_filter(spark, d):
    f = c.frame_scores(spark, d).withColumn("above", F.col("score") > 120)
    a, b = (seq.flash_filter(f, "video", m, 8).select("video", F.array_join(F.col("cuts").cast("array<string>"), ",").alias(m.lower())) for m in ("SUPPRESS", "MERGE"))
    return a.join(b, "video")


_LAST = "coalesce(acc.last, x.f)"
_CALM = f"x.f - {_LAST} >= 8"
_MOVED = f"CASE WHEN x.above THEN x.f ELSE {_LAST} END"
_OVER = f"(acc.start IS NOT NULL AND {_CALM} AND NOT x.above AND {_LAST} - acc.start >= 8)"
_FRESH = f"(acc.start IS NULL AND x.above AND {_CALM})"
_FLASH = "{'last': CAST(NULL AS BIGINT), 'live': false, 'start': CAST(NULL AS BIGINT), 'cuts': CAST([] AS BIGINT[]), 'f': %s, 'above': %s}"
FLASH_SQL = c.sql(f"""+l AS (SELECT video, list_prepend({_FLASH % ("CAST(0 AS BIGINT)", "false")}, list({_FLASH % ("frame", "score > 120")} ORDER BY frame)) AS l FROM frames GROUP BY video)
SELECT video, coalesce(array_to_string(list_reduce(l, lambda acc, x: {{'last': CASE WHEN x.above AND {_CALM} THEN x.f ELSE {_LAST} END, 'live': acc.live, 'start': acc.start, 'cuts': CASE WHEN x.above AND {_CALM} THEN list_append(acc.cuts, x.f) ELSE acc.cuts END, 'f': x.f, 'above': x.above}}).cuts, ','), '') AS suppress,
coalesce(array_to_string(list_reduce(l, lambda acc, x: {{'last': {_MOVED}, 'live': acc.live OR {_FRESH}, 'start': CASE WHEN {_OVER} THEN NULL WHEN acc.start IS NULL AND x.above AND NOT ({_CALM}) AND acc.live THEN x.f ELSE acc.start END,
  'cuts': CASE WHEN {_OVER} THEN list_append(acc.cuts, {_LAST}) WHEN {_FRESH} THEN list_append(acc.cuts, x.f) ELSE acc.cuts END, 'f': x.f, 'above': x.above}}).cuts, ','), '') AS merge FROM l""", "frames")  # fmt: skip


def gaussian_smooth(spark, d):
    s = seq.block_similarity(c.sentence_vectors(spark, d), "label")
    return seq.smoothed(s, "label").select("label", "pos", r("smooth", 6).alias("smooth"))


SMOOTH = """b AS (SELECT s.label, s.pos, n, greatest(1, least(4, n // 4)) AS w FROM sents s JOIN (SELECT label, count(*) AS n FROM sents GROUP BY label) USING (label)),
c0 AS (SELECT x.label, x.pos, x.n, x.w, p.i, sum(p.e) FILTER (p.pos >= x.pos - x.w AND p.pos < x.pos) AS l, sum(p.e) FILTER (p.pos >= x.pos AND p.pos < x.pos + x.w) AS rr
  FROM b x JOIN (SELECT label, pos, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM sents) p ON p.label = x.label AND p.pos BETWEEN x.pos - 4 AND x.pos + 3 GROUP BY ALL),
c1 AS (SELECT label, pos, n, w, sum(l * rr) / (sqrt(sum(l * l)) * sqrt(sum(rr * rr))) AS sim FROM c0 GROUP BY ALL),
c2 AS (SELECT label, pos, n, w, CASE WHEN n <= 2 * w THEN 0 WHEN pos < w THEN max(CASE WHEN pos = w THEN sim END) OVER g WHEN pos >= n - w THEN max(CASE WHEN pos = n - w - 1 THEN sim END) OVER g ELSE sim END AS sim FROM c1 WINDOW g AS (PARTITION BY label)),
kk AS (SELECT unnest(range(-3, 4)) AS k), kw AS (SELECT k, exp(-0.5 * k * k) / (SELECT sum(exp(-0.5 * k * k)) FROM kk) AS q FROM kk),
c3 AS (SELECT x.label, x.pos, any_value(x.n) AS n, sum(q * y.sim) AS smooth FROM c2 x, kw JOIN c2 y ON y.label = x.label AND y.pos = CASE WHEN x.pos + k < 0 THEN -(x.pos + k) WHEN x.pos + k >= x.n THEN 2 * (x.n - 1) - (x.pos + k) ELSE x.pos + k END GROUP BY x.label, x.pos)"""
SMOOTH_SQL = c.sql(f"+{SMOOTH} SELECT label, CAST(pos AS INTEGER) AS pos, round(smooth, 6) AS smooth FROM c3", "sents")


def _valleys(spark, d):
    s = seq.block_similarity(c.sentence_vectors(spark, d), "label")
    sizes = s.groupBy("label").agg(F.max("n").alias("n"))
    return seq.valleys(seq.smoothed(s, "label"), "label"), sizes


def valleys(spark, d):
    return _valleys(spark, d)[0].select("label", "pos", r("smooth", 6).alias("smooth"))


_V = f"""{SMOOTH}, v0 AS (SELECT label, pos, n, smooth, lag(smooth) OVER w - smooth AS l, lead(smooth) OVER w - smooth AS rr, avg(smooth) OVER g - CAST(0.6 AS DOUBLE) * (stddev_pop(smooth) OVER g + CAST(1e-8 AS DOUBLE)) AS t FROM c3 WINDOW w AS (PARTITION BY label ORDER BY pos), g AS (PARTITION BY label)),
v AS (SELECT label, pos, n, smooth FROM v0 WHERE l > 0 AND rr > 0 AND least(l, rr) >= 0.005 AND smooth <= t)"""
VALLEYS_SQL = c.sql(f"+{_V} SELECT label, CAST(pos AS INTEGER) AS pos, round(smooth, 6) AS smooth FROM v", "sents")


def ranges(spark, d):
    v, sizes = _valleys(spark, d)
    return seq.ranges(v, sizes, "label").select("label", "range_id", "first", "last")


_R = f"""{_V}, rs AS (SELECT label, list_reduce(list_prepend([CAST(0 AS BIGINT)], list([pos] ORDER BY pos)), lambda a, x: CASE WHEN x[1] - a[-1] >= 2 THEN list_concat(a, x) ELSE a END) AS s FROM v GROUP BY label),
rn AS (SELECT label, count(*) AS n FROM sents GROUP BY label), ra AS (SELECT label, n, coalesce(s, [0]) AS s FROM rn LEFT JOIN rs USING (label)),
rg AS (SELECT label, n, s, unnest(s) AS first, generate_subscripts(s, 1) AS i FROM ra), rr AS (SELECT label, i - 1 AS range_id, first, coalesce(s[i + 1], n) - 1 AS last FROM rg)"""
RANGES_SQL = c.sql(f"+{_R} SELECT label, CAST(range_id AS INTEGER) AS range_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM rr", "sents")


def chapters_build(spark, d):
    """Chapters: the documents of the vectors of a label as its sentences, cut at the valleys, with titles."""
    v, sizes = _valleys(spark, d)
    docs = c.base(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    chunks = c.sentence_vectors(spark, d).join(docs, "vec_id").select("label", "pos", "text", (F.col("pos") * 5.0).alias("start"), (F.col("pos") * 5.0 + 4.567).alias("end"))
    m = seq.merged_ranges(chunks, seq.ranges(v, sizes, "label"), "label")
    t = seq.titles(m, ["label", "range_id"])
    return m.join(t, ["label", "range_id"]).select("label", "range_id", "start", "end", F.length("text").cast("long").alias("n"), "title")


def shot_grouping(spark, d):
    """Runs of similar vectors of each label: dynamic programming in numpy, one label a task."""
    s = c.sentence_vectors(spark, d).select("label", F.col("pos").alias("shot"), "v")
    return seq.optimal_scenes(s, "label", 4)


def mpeg7_times(spark, d):
    """Media times as MPEG-7 writes them, read back to seconds; other forms are 0."""
    from framelake.functions import text

    e = c.base(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.format_string("T%02d:%02d:%02d:%dF25", (F.col("event_id") / 3600).cast("int"), (F.col("event_id") / 60 % 60).cast("int"), F.col("event_id") % 60, F.col("event_id") % 25)).alias("t"))
    return e.select("event_id", text.mpeg7_seconds(F.col("t")).alias("seconds"))


MPEG7_SQL = "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE event_id + (event_id % 25) / CAST(25 AS DOUBLE) END AS seconds FROM events"

QUERIES = {
    "frame_lag_score": (frame_lag_score, LAG_SQL), "adaptive_cuts": (adaptive_cuts, CUTS_SQL), "scenes_from_cuts": (scenes_from_cuts, SCENES_SQL), "window_stats_pm5": (window_stats_pm5, WINDOW_SQL), "fixed_cuts": (fixed_cuts, FIXED_SQL),
    "flash_filter": (flash_filter, FLASH_SQL), "gaussian_smooth": (gaussian_smooth, SMOOTH_SQL), "valleys": (valleys, VALLEYS_SQL), "ranges": (ranges, RANGES_SQL), "chapters_build": (chapters_build, None), "shot_grouping": (shot_grouping, None), "mpeg7_times": (mpeg7_times, MPEG7_SQL),
}
