"""Cluster indexes, priors, fusion, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import vectors
from framelake.operators import clusters, prior
from framelake.sources import catalog as c

r = F.round


def _vectors(spark, d):
    return c.base(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _by_label(spark, d):
    """Clusters of a given assignment: level one by label, level two by label and half."""
    e = c.base(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("l1"), (F.col("label") * 2 + (F.col("vec_id") % 2).cast("int")).alias("l2"))


def ivf_assign(spark, d):
    """Online assignment in order of arrival; depends on every step before: no SQL."""
    return clusters.assign_online(_vectors(spark, d))


def ivf_assign_batch(spark, d):
    return clusters.assign_batch(_vectors(spark, d), 8, 4)


def ivf_probe_search(spark, d):
    q = _vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return clusters.probe(q, _by_label(spark, d), 5)


_L = "l AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label AS l1, label * 2 + vec_id % 2 AS l2 FROM embeddings), f AS (SELECT vec_id, l1, l2, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM l)"
_Q = "qv AS (SELECT vec_id AS query_id, v AS q FROM l WHERE vec_id % 50 = 0)"
PROBE_SQL = f"""WITH {_L}, {_Q}, c1 AS (SELECT l1, list(m ORDER BY i) AS c FROM (SELECT l1, i, avg(e) AS m FROM f GROUP BY ALL) GROUP BY l1), c2 AS (SELECT l1, l2, list(m ORDER BY i) AS c FROM (SELECT l1, l2, i, avg(e) AS m FROM f GROUP BY ALL) GROUP BY l1, l2),
z AS (SELECT ceil(sqrt(count(DISTINCT l1))) AS p1, greatest(1, least(floor(count(*) / count(DISTINCT l1)), ceil(sqrt(count(*) / count(DISTINCT l1))))) AS p2 FROM c2),
n1 AS (SELECT query_id, q, l1 FROM (SELECT query_id, q, l1, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, c), 6) DESC, l1) AS r FROM qv, c1), z WHERE r <= p1),
n2 AS (SELECT query_id, q, l2 FROM (SELECT query_id, q, l2, row_number() OVER (PARTITION BY query_id, l1 ORDER BY round(list_cosine_similarity(q, c), 6) DESC, l2) AS r FROM n1 JOIN c2 USING (l1)), z WHERE r <= p2),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, v), 6) AS sim FROM n2 JOIN l USING (l2))
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank, vec_id, sim FROM s) WHERE rank <= 5"""


def ivf_cluster_stats(spark, d):
    a = _by_label(spark, d)
    s = clusters.stats(a, "l2").select("clusters", *[r(k, 6).alias(k) for k in ("mean", "std", "cv")], "max", "min")
    return s.join(clusters.within(a, "l2").agg(r(F.sum("wss"), 5).alias("wss")), F.lit(True))


STATS_SQL = f"""WITH {_L}, n AS (SELECT l2, count(*) AS n FROM l GROUP BY l2), w AS (SELECT round(sum((e - m) * (e - m)), 5) AS wss FROM f JOIN (SELECT l2, i, avg(e) AS m FROM f GROUP BY ALL) USING (l2, i))
SELECT count(*) AS clusters, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(stddev_pop(n) / avg(n), 6) AS cv, max(n) AS max, min(n) AS min, any_value(wss) AS wss FROM n, w"""


def adaptive_parameters(spark, d):
    """Thresholds and probe counts at growing sizes."""
    n = spark.range(0, 18).select(F.pow(F.lit(2.0), F.col("id")).cast("long").alias("n"))
    t1, t2 = vectors.cluster_thresholds(F.col("n"))
    p1, p2 = vectors.probe_counts(F.col("n"), F.col("n") * 3)
    return n.select("n", r(t1, 6).alias("t1"), r(t2, 6).alias("t2"), p1.alias("p1"), p2.alias("p2"))


ADAPTIVE_SQL = """SELECT n, round(greatest(0.52, 0.72 - 0.04 * log10(greatest(n, 10) / CAST(10 AS DOUBLE))), 6) AS t1, round(greatest(0.68, 0.85 - 0.04 * log10(greatest(n, 10) / CAST(10 AS DOUBLE))), 6) AS t2,
CAST(greatest(1, least(n, ceil(sqrt(n)))) AS INTEGER) AS p1, CAST(2 AS INTEGER) AS p2 FROM (SELECT CAST(pow(2, unnest(range(18))) AS BIGINT) AS n)"""


def _triples(spark, d):
    return c.occurrences(spark, d).select(F.col("key").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))


def prior_grouping_sets(spark, d):
    return prior.counts(_triples(spark, d))


_G = "tr AS (SELECT key AS s, predicate AS p, object AS o FROM occ), ct AS (SELECT s, o, p, CAST(grouping(s, o, p) AS INTEGER) AS g, count(*) AS n FROM tr GROUP BY GROUPING SETS ((s, o, p), (s, p), (o, p), (p), (s, o), (s), (o), ()))"
SETS_SQL = c.sql(f"+{_G} SELECT * FROM ct", "occ")


def prior_backoff_score(spark, d):
    """Priors of the seen triples, each also asked with its subject and object changed over, from the counts of all triples."""
    t = _triples(spark, d)
    asked = t.unionByName(t.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))).distinct()
    return prior.backoff(asked, prior.counts(t), 4).select("s", "o", "p", r("prior", 6).alias("prior"))


BACKOFF_SQL = c.sql(f"""+{_G}, ask AS (SELECT s, p, o FROM tr UNION SELECT o, p, s FROM tr),
j AS (SELECT a.*, coalesce(so.n, 0) AS nso, coalesce(sop.n, 0) AS nsop, coalesce(ns.n, 0) AS ns, coalesce(sp.n, 0) AS nsp, coalesce(no.n, 0) AS no, coalesce(op.n, 0) AS nop, coalesce(np.n, 0) AS np, coalesce((SELECT n FROM ct WHERE g = 7), 0) AS nall FROM ask a
LEFT JOIN ct so ON so.g = 1 AND so.s = a.s AND so.o = a.o LEFT JOIN ct sop ON sop.g = 0 AND sop.s = a.s AND sop.o = a.o AND sop.p = a.p LEFT JOIN ct ns ON ns.g = 3 AND ns.s = a.s LEFT JOIN ct sp ON sp.g = 2 AND sp.s = a.s AND sp.p = a.p
LEFT JOIN ct no ON no.g = 5 AND no.o = a.o LEFT JOIN ct op ON op.g = 4 AND op.o = a.o AND op.p = a.p LEFT JOIN ct np ON np.g = 6 AND np.p = a.p)
SELECT s, o, p, round(CASE WHEN nso >= 2 THEN (nsop + 1) / (nso + 4) WHEN ns > 0 OR no > 0 THEN (CASE WHEN ns > 0 THEN (nsp + 1) / (ns + 4) ELSE 0 END + CASE WHEN no > 0 THEN (nop + 1) / (no + 4) ELSE 0 END + CASE WHEN nso > 0 THEN (nsop + 1) / (nso + 4) ELSE 0 END)
  / (CAST(ns > 0 AS INTEGER) + CAST(no > 0 AS INTEGER) + CAST(nso > 0 AS INTEGER)) ELSE (np + 1) / (nall + 4) END, 6) AS prior FROM j""", "occ")  # fmt: skip


def score_fusion(spark, d):
    """Classifier probability, prior and detection scores in one ranking of each video's scene."""
    occ = c.occurrences(spark, d)
    p = prior.backoff(_triples(spark, d).distinct(), prior.counts(_triples(spark, d)), 4)
    rows = occ.select((F.col("video_id") * 50 + F.col("scene")).alias("image"), F.col("key").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), F.col("confidence").alias("s_score"), (1 - F.col("l_partkey") % 100 / 200.0).alias("o_score"), (F.col("l_suppkey") % 10 / 20.0 + 0.5).alias("prob"), (F.col("l_orderkey") * 10_007 + F.col("l_partkey") * 13 + F.col("l_suppkey")).alias("id"))
    out = prior.fused(rows.join(p, ["s", "o", "p"]), "image", 0.5, 3)
    return out.select("image", "rank", "id", r("score", 6).alias("score"))


FUSION_SQL = c.sql(f"""+{_G}, pr AS (SELECT a.s, a.o, a.p, (a.n + 1) / CAST(b.n + 4 AS DOUBLE) AS pair, (x.n + 1) / CAST(y.n + 4 AS DOUBLE) AS sp, (u.n + 1) / CAST(v.n + 4 AS DOUBLE) AS op, b.n AS nso FROM ct a JOIN ct b ON b.g = 1 AND b.s = a.s AND b.o = a.o
  JOIN ct x ON x.g = 2 AND x.s = a.s AND x.p = a.p JOIN ct y ON y.g = 3 AND y.s = a.s JOIN ct u ON u.g = 4 AND u.o = a.o AND u.p = a.p JOIN ct v ON v.g = 5 AND v.o = a.o WHERE a.g = 0),
w AS (SELECT video_id * 50 + scene AS image, confidence AS ss, 1 - (l_partkey % 100) / CAST(200 AS DOUBLE) AS os, (l_suppkey % 10) / CAST(20 AS DOUBLE) + 0.5 AS prob, l_orderkey * 10007 + l_partkey * 13 + l_suppkey AS id, CASE WHEN nso >= 2 THEN pair ELSE (sp + op + pair) / 3 END AS prior
  FROM occ JOIN pr ON pr.s = key AND pr.o = object AND pr.p = predicate)
SELECT * FROM (SELECT CAST(image AS INTEGER) AS image, CAST(row_number() OVER (PARTITION BY image ORDER BY round(prob * sqrt(prior) * ss * os, 9) DESC, id) AS INTEGER) AS rank, id, round(prob * sqrt(prior) * ss * os, 6) AS score FROM w) WHERE rank <= 3""", "occ")  # fmt: skip


def train_negatives(spark, d):
    """Ordered pairs of an image that are no relationship, three for each that is; which ones is up to a seeded hash."""
    from framelake.operators import detection

    p = detection.ordered_pairs(c.detections(spark, d).where("score > 0.7"), "image").select("image", "s_id", "o_id")
    pos = p.where("s_id % 7 = o_id % 7")
    return prior.negatives(p, pos, ["image", "s_id", "o_id"])


def mnr_loss(spark, d):
    """Pairs of neighbouring ids, in batches of sixteen."""
    v = _vectors(spark, d)
    a = v.where("vec_id % 2 = 0").select(F.floor(F.col("vec_id") / 32).alias("batch"), F.col("vec_id").alias("i"), F.col("v").alias("a"))
    b = v.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("i"), F.col("v").alias("b"))
    return prior.mnr_loss(a.join(b, "i"), 0.5).select(r("loss", 6).alias("loss"))


MNR_SQL = f"""WITH {_L}, p AS (SELECT a.vec_id // 32 AS batch, a.vec_id AS i, a.v AS a, b.v AS b FROM l a JOIN l b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
s AS (SELECT x.batch, x.i, y.i AS j, list_cosine_similarity(x.a, y.b) / CAST(0.5 AS DOUBLE) AS s FROM p x JOIN p y USING (batch)),
a AS (SELECT avg(l) AS l FROM (SELECT ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END) AS l FROM s GROUP BY batch, i)), b AS (SELECT avg(l) AS l FROM (SELECT ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END) AS l FROM s GROUP BY batch, j))
SELECT round((a.l + b.l) / 2, 6) AS loss FROM a, b"""


def zero_shot_prior(spark, d):
    """Priors of subjects renamed so that none is known, by the vectors of the words nearest to them."""
    occ = c.occurrences(spark, d)
    t = _triples(spark, d)
    names = t.select(F.col("s").alias("word")).union(t.select("o")).distinct()
    vec = lambda w: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.pmod(F.xxhash64(w, i), F.lit(1000)) / 1000.0))
    words = names.select("word", vec(F.col("word")).alias("v")).union(names.select(F.concat(F.lit("new "), "word"), vec(F.col("word"))))
    asked = occ.select(F.concat(F.lit("new "), "key").alias("s"), F.concat(F.lit("new "), "object").alias("o"), F.col("predicate").alias("p")).distinct()
    return prior.zero_shot(asked, prior.counts(t), words, 4).select("s", "o", "p", r("prior", 6).alias("prior"))


QUERIES = {
    "ivf_assign": (ivf_assign, None), "ivf_assign_batch": (ivf_assign_batch, None), "ivf_probe_search": (ivf_probe_search, PROBE_SQL), "ivf_cluster_stats": (ivf_cluster_stats, STATS_SQL), "adaptive_parameters": (adaptive_parameters, ADAPTIVE_SQL),
    "prior_grouping_sets": (prior_grouping_sets, SETS_SQL), "prior_backoff_score": (prior_backoff_score, BACKOFF_SQL), "score_fusion": (score_fusion, FUSION_SQL), "train_negatives": (train_negatives, None), "mnr_loss": (mnr_loss, MNR_SQL), "zero_shot_prior": (zero_shot_prior, None),
}
