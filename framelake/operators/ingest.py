"""Ingest: transcripts with their videos, positional joins, listings, hardest negatives, empirical distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments_with_videos(chunks: DataFrame, videos: DataFrame) -> DataFrame:
    """Segments (video, turn, ...) with the columns of their video (id, ...), in order of video and turn; blank texts go."""
    rows = chunks.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.join(videos, rows["video"] == videos["id"]).drop(videos["id"]).orderBy("video", "turn")


def zipped(left: DataFrame, right: DataFrame, key: str, order_left: str, order_right: str) -> DataFrame:
    """Rows of both sides by their place in the order of their key; the longer side's rest goes. One shuffle by key for both."""
    at = lambda t, o: t.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(o)) - 1)
    return at(left, order_left).join(at(right, order_right), [key, "pos"])


def annotated(annotations: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Annotations with their image; those without one go."""
    return annotations.join(images, key)


def with_files(ids: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """ids that the listing of files has, too."""
    return ids.join(listing.select(key), key, "left_semi")


def hardest(rows: DataFrame, group: str, n: int) -> DataFrame:
    """The n best scores of a group, ties to the smaller det_id; a group's rows are cut to n before they are shuffled."""
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), "det_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_row(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of an order; each task keeps one."""
    return rows.orderBy(*order).limit(1)


def distinct_boxes(dets: DataFrame, image: str) -> DataFrame:
    """Each box of an image once."""
    return dets.select(image, *[F.col("box")[k].alias(k) for k in ("x1", "y1", "x2", "y2")]).distinct()


def empirical_cdf(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, p): the share of the group's rows at or below each value."""
    n = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return n.select(group, value, (F.sum("_n").over(upto) / F.sum("_n").over(whole)).alias("p"))
