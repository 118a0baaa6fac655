"""WARC fixity: Merkle trees over records and their ordered offset ranges, compared from the root down.

Records lie in files of FILE records each, in the order of (page_id, url, digest); a leaf is the SHA-256 of a record's file,
offset, length and bytes, an inner node that of its ordered children and the range they span. audit() compares roots, then only
the children of nodes that differ, level by level, down to records. A record that one replica lacks differs from any other.
Null url or html: written as empty. Null page_id: ordered first. Repeated rows: records of their own. Empty tables: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import cut, table, with_index

FANOUT, FILE = 64, 4096
#: The query's second replica: these remainders of page_id are damaged or lost there.
DAMAGED, LOST = (101, 7), (211, 5)


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record as text; its bytes are the text's UTF-8."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame) -> DataFrame:
    """(page_id, idx, file, offset, length, digest): where each record lies, and the digest of its bytes.

    A column bad, where there is one, is a second replica's digest (null: lost) and is carried along.
    """
    rec = record(F.col("page_id"), F.col("url"), F.col("html"))
    extra = ["bad"] if "bad" in pages.columns else []
    rows = cut(pages.select("page_id", "url", F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("digest"), *extra))
    rows = with_index(rows, ["page_id", "url", "digest"]).withColumn("file", (F.col("idx") / FILE).cast("long"))
    before = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("page_id", "idx", "file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest", *extra)


def leaves(records: DataFrame, digest: str = "digest") -> DataFrame:
    """(node, lo, hi, hash) of level 0; the hash covers the record's place and bytes, null where the record is lost."""
    place = F.concat_ws(":", "file", "offset", "length")
    return records.select(F.col("idx").alias("node"), F.col("idx").alias("lo"), F.col("idx").alias("hi"), F.when(F.col(digest).isNotNull(), F.sha2(F.concat_ws(":", place, digest), 256)).alias("hash"))


def tree(level0: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the root; a group never has more than fanout rows."""
    levels = [cut(level0)]
    rows = levels[0].count()
    while rows > 1:
        child = F.struct("node", "lo", "hi", F.coalesce("hash", F.lit("lost")).alias("hash"))
        up = levels[-1].groupBy((F.col("node") / fanout).cast("long").alias("parent")).agg(F.sort_array(F.collect_list(child)).alias("c"))
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["lo"], x["hi"], x["hash"])), ",")
        levels.append(cut(up.select(F.col("parent").alias("node"), F.element_at("c", 1)["lo"].alias("lo"), F.element_at("c", -1)["hi"].alias("hi"), F.sha2(text, 256).alias("hash"))))
        rows = levels[-1].count()
    return levels


def audit(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(idx, state) of records that differ: changed, lost_b or lost_a. Only children of differing nodes are read on."""
    if len(a) != len(b):
        raise ValueError("replicas are compared over the same manifest")
    suspect = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if suspect is not None:
            under = lambda t, s=suspect: t.join(s, (F.col("node") / fanout).cast("long") == F.col("suspect"), "left_semi")
            x, y = under(x), under(y)
        both = x.select("node", F.col("hash").alias("ha")).join(y.select("node", F.col("hash").alias("hb")), "node", "full")
        differ = both.where(~F.col("ha").eqNullSafe(F.col("hb")))
        suspect = cut(differ.select(F.col("node").alias("suspect"), F.when(F.col("ha").isNull(), "lost_a").when(F.col("hb").isNull(), "lost_b").otherwise("changed").alias("state")))
    return suspect.select(F.col("suspect").alias("idx"), "state")


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive, and a replica with damage by DAMAGED and LOST: the records that differ, located."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged, lost = (F.col("page_id") % m == r for m, r in (DAMAGED, LOST))
    other = record(F.col("page_id"), F.col("url"), F.concat(F.coalesce("html", F.lit("")), F.when(damaged, "?").otherwise("")))
    records = cut(archive(pages.withColumn("bad", F.when(~F.coalesce(lost, F.lit(False)), F.sha2(other, 256)))))
    found = audit(tree(leaves(records)), tree(leaves(records, "bad")))
    return records.join(found, "idx").select("page_id", "idx", "file", "offset", "length", "state")


SQL = f"""
WITH r AS (
  SELECT page_id, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages),
i AS (SELECT page_id, CAST(strlen(rec) AS BIGINT) AS length, row_number() OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256(rec)) - 1 AS idx FROM r),
f AS (SELECT page_id, idx, idx // {FILE} AS file, length,
    CAST(coalesce(sum(length) OVER (PARTITION BY idx // {FILE} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM i)
SELECT page_id, idx, file, "offset", length, CASE WHEN page_id % {LOST[0]} = {LOST[1]} THEN 'lost_b' ELSE 'changed' END AS state
FROM f WHERE page_id % {DAMAGED[0]} = {DAMAGED[1]} OR page_id % {LOST[0]} = {LOST[1]}
"""
