"""Two-level cluster index: online assignment, batch assignment, probing, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import vectors
from framelake.operators.search import ranked


def assign_online(rows: DataFrame, order: str = "vec_id", most_l1: int = 500, most_l2: int = 20, thresholds: tuple[float, float] | None = None) -> DataFrame:
    """(vec_id, l1, l2) as vectors arrive in order: each goes to the nearest cluster of level one, in it to the nearest of level
    two, or opens one where the similarity is below the threshold at that count; means follow.

    Every step depends on the one before, so this is one task by its meaning; it holds the centroids and a batch of the sorted
    rows at a time. assign_batch is the form for large tables.
    """
    import math

    def run(frames):
        import numpy as np
        import pandas as pd

        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-30)

        class Means:
            """Centroids and their unit vectors, in room that grows by doubling."""

            def __init__(self):
                self.size, self.counts = 0, []

            def add(self, x):
                if not self.size:
                    self.means = np.zeros((16, len(x)), np.float32)
                    self.units = self.means.copy()
                elif self.size == len(self.means):
                    self.means, self.units = (np.concatenate([m, np.zeros_like(m)]) for m in (self.means, self.units))
                self.counts.append(0)
                self.size += 1
                self.put(self.size - 1, x)
                return self.size - 1

            def put(self, k, mean):
                self.means[k] = mean
                self.units[k : k + 1] = unit(self.means[k : k + 1])

            def move(self, k, x):
                n = self.counts[k]
                self.put(k, (self.means[k] * n + x) / (n + 1))
                self.counts[k] = n + 1

        l1, l2, of, count = Means(), Means(), [], 0
        for f in frames:
            out = []
            for vec_id, v in zip(f["vec_id"], f["v"], strict=True):
                x = unit(np.asarray(v, np.float32)).astype(np.float32)
                scale = math.log10(max(10, count) / 10)
                t1, t2 = thresholds or (max(0.52, 0.72 - 0.04 * scale), max(0.68, 0.85 - 0.04 * scale))
                scores = l1.units[: l1.size] @ x if l1.size else None
                a = int(np.argmax(scores)) if l1.size else -1
                if a < 0 or (scores[a] < t1 and l1.size < most_l1):
                    a = l1.add(x)
                    of.append([])
                mine = of[a]
                s2 = l2.units[mine] @ x if mine else None
                b = int(np.argmax(s2)) if mine else -1
                if b < 0 or (s2[b] < t2 and len(mine) < most_l2):
                    mine.append(l2.add(x))
                    b = len(mine) - 1
                l1.move(a, x)
                l2.move(mine[b], x)
                count += 1
                out.append((vec_id, a, mine[b]))
            yield pd.DataFrame(out, columns=["vec_id", "l1", "l2"])

    return rows.select(*dict.fromkeys(["vec_id", "v", order])).coalesce(1).sortWithinPartitions(order).mapInPandas(run, "vec_id long, l1 int, l2 int")


def assign_batch(rows: DataFrame, k1: int, k2: int, sample: int = 20_000) -> DataFrame:
    """(vec_id, l1, l2) by two rounds of k-means on a sample of bounded size; rows are filed where they are."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    import numpy as np

    base = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(array_to_vector(F.col("v")).alias("features"), "v")
    first = KMeans(k=k1, seed=1, maxIter=10).fit(base)
    c1 = np.stack(first.clusterCenters())
    fine = KMeans(k=k1 * k2, seed=2, maxIter=10).fit(base)
    c2 = np.stack(fine.clusterCenters())
    parent = (c2 @ c1.T).argmax(1)

    def run(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                at = (np.stack(f["v"].to_numpy()) @ c2.T).argmax(1)
                yield pd.DataFrame({"vec_id": f["vec_id"], "l1": parent[at], "l2": at})

    return rows.select("vec_id", "v").mapInPandas(run, "vec_id long, l1 int, l2 int")


def centroids(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the vectors of a cluster, dimension by dimension."""
    flat = rows.select(*by, F.posexplode("v").alias("i", "e")).groupBy(*by, "i").agg(F.avg("e").alias("m"))
    return flat.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


def probe(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6, block: int = 65_536, share: int = 32_768) -> DataFrame:
    """(query_id, rank, vec_id, sim): the k best among the clusters a query probes. corpus: vec_id, v, l1, l2; queries: query_id, q.

    Centroids are few beside the vectors; queries meet them first and only the clusters they pick after. There about block
    queries meet about share vectors of a cluster at a time, by a matrix product, and k of each go on.
    """
    flat = corpus.select("l1", "l2", F.posexplode("v").alias("i", "e")).groupBy("l1", "l2", "i").agg(F.sum("e").alias("t"), F.count("e").alias("n"))
    means = lambda by: flat.groupBy(*by, "i").agg(F.try_divide(F.sum("t"), F.sum("n")).alias("m")).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    c1, c2 = means(["l1"]), means(["l1", "l2"])
    sizes = c2.agg(F.count_distinct("l1").alias("n1"), F.count("*").alias("n2"))
    n1, n2 = vectors.probe_counts(F.col("n1"), F.col("n2"))
    sizes = sizes.select(n1.alias("p1"), n2.alias("p2"))
    cos = lambda c: F.round(vectors.cosine("q", c), digits)
    near = queries.join(c1, F.lit(True)).withColumn("s", cos("c"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc(), "l1"))).join(F.broadcast(sizes), F.lit(True)).where("r <= p1").select("query_id", "q", "l1", "p2")
    cells = near.join(c2, "l1").withColumn("s", cos("c"))
    cells = cells.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "l1").orderBy(F.col("s").desc(), "l2"))).where("r <= p2").select("query_id", "q", "l2")
    hits = nearest_of_cells(cells, corpus.select("vec_id", "v", "l2"), queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).alias("blocks")), k, digits, share)
    return ranked(hits.select("query_id", "vec_id", F.round("sim", digits).alias("sim")), k)


def nearest_of_cells(cells: DataFrame, corpus: DataFrame, blocks: DataFrame, k: int, digits: int, share: int) -> DataFrame:
    """(query_id, vec_id, sim), unrounded: of each share of a cell (l2), a query's k best or more. blocks: one row, into how many the queries fall.

    A product finds who can be among the k once rounded; these are summed from left to right, as vectors.dot does, and
    ties go to the smaller vec_id. NaN comes first; no similarity, of what is null or of another length, last.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    def best(x, y):
        import decimal

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def lengths(lists):
            """-1 where there is nothing to compare."""
            n = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).copy()
            if lists.flatten().null_count:
                n[pc.list_parent_indices(lists).to_numpy()[pc.is_null(lists.flatten()).to_numpy(zero_copy_only=False)]] = -1
            return n

        def matrix(lists, at, d):
            return lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)

        def few(lists, at, d):
            """Of exact copies the first k; the others cannot be among the k."""
            if not d:
                return at[:k]
            _, group, n = np.unique(np.ascontiguousarray(matrix(lists, at, d)).view(np.dtype((np.void, 8 * d))).ravel(), return_inverse=True, return_counts=True)
            order = np.argsort(group, kind="stable")
            return at[np.sort(order[np.arange(len(at)) - (np.cumsum(n) - n)[group[order]] < k])]

        def units(lists, at, d):
            """Unit vectors as columns."""
            m = matrix(lists, at, d).T.copy()
            n = np.sqrt(sums(m, m))
            return np.divide(m, n, out=m, where=n > 0)

        def sums(a, b):
            total = np.zeros(a.shape[1])
            for p, q in zip(a, b, strict=True):
                total += p * q
            return total

        def rounded(s):
            """As Spark does it, from the decimal text; only where it matters."""
            t = s * 10.0**digits
            out = np.rint(t) / 10.0**digits
            for i in np.flatnonzero(np.abs(t - np.floor(t) - 0.5) < 1e-4):
                out[i] = float(decimal.Decimal(repr(float(s[i]))).quantize(decimal.Decimal(1).scaleb(-digits), decimal.ROUND_HALF_UP))
            return out

        if not len(x) or not len(y):
            return pa.table({"query_id": x.column("query_id").slice(0, 0), "vec_id": y.column("vec_id").slice(0, 0), "sim": pa.array([], pa.float64())})
        y = y.take(pc.sort_indices(y, [("vec_id", "ascending")], null_placement="at_start"))
        qs, vs = x.column("q").combine_chunks(), y.column("v").combine_chunks()
        of_q, of_v, found = lengths(qs), lengths(vs), []
        with np.errstate(all="ignore"):
            for d in np.unique(of_q):
                mine, same = np.flatnonzero(of_q == d), np.flatnonzero((of_v == d) & (d >= 0))
                rest = np.flatnonzero((of_v != d) | (d < 0))[: max(0, k - len(same))]
                found.append((np.repeat(mine, len(rest)), np.tile(rest, len(mine)), np.zeros(len(mine) * len(rest)), np.ones(len(mine) * len(rest), bool)))
                if not len(same):
                    continue
                same = few(vs, same, d)
                a, b = units(qs, mine, d), units(vs, same, d)
                step = max(1, 2**21 // len(same))
                for i in range(0, len(mine), step):
                    s = a[:, i : i + step].T @ b
                    s[np.isnan(s)] = np.inf
                    least = np.partition(s, -k, axis=1)[:, -k] if len(same) > k else np.full(len(s), -np.inf)
                    r, c = np.nonzero(s >= (least - 1.001 * 10.0**-digits - 1e-12)[:, None])
                    s = np.concatenate([sums(a[:, i + r[j : j + 2**14]], b[:, c[j : j + 2**14]]) for j in range(0, len(r), 2**14)])
                    order = np.lexsort((c, -np.where(np.isnan(s), np.inf, rounded(s)), r))
                    order = order[np.arange(len(r)) - np.searchsorted(r, r) < k]
                    found.append((mine[i + r[order]], same[c[order]], s[order], np.zeros(len(order), bool)))
        at_q, at_v, sims, none = (np.concatenate(z) for z in zip(*found, strict=True))
        return pa.table({"query_id": x.column("query_id").take(pa.array(at_q)), "vec_id": y.column("vec_id").take(pa.array(at_v)), "sim": pa.array(sims, mask=none)})

    large = F.broadcast(corpus.groupBy("l2").count().where(F.col("count") > share).select("l2", F.ceil(F.col("count") / share).alias("shares")))
    split = lambda rows: rows.where("l2 IS NOT NULL").join(large, "l2", "left").join(F.broadcast(blocks), F.lit(True)).withColumn("shares", F.coalesce("shares", F.lit(1).cast("long")))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = split(cells).select("query_id", vectors.doubles("q").alias("q"), "l2", part("query_id", "blocks").alias("b"), every("shares").alias("s"))
    c = split(corpus).select("vec_id", vectors.doubles("v").alias("v"), "l2", part("vec_id", "shares").alias("s"), every("blocks").alias("b"))
    out = StructType([cells.schema["query_id"], corpus.schema["vec_id"], StructField("sim", DoubleType())])
    return q.groupBy("l2", "b", "s").cogroup(c.groupBy("l2", "b", "s")).applyInArrow(best, out)


def stats(assigned: DataFrame, cluster: str) -> DataFrame:
    """One row on cluster sizes: number, mean, population deviation, coefficient of variation, extremes."""
    n = assigned.groupBy(cluster).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("clusters"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.try_divide(F.stddev_pop("n"), F.avg("n")).alias("cv"), F.max("n").alias("max"), F.min("n").alias("min"))


def within(corpus: DataFrame, cluster: str) -> DataFrame:
    """(cluster, n, wss): squared distances to the cluster's mean, summed."""
    j = corpus.join(centroids(corpus, [cluster]), cluster)
    d = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return j.withColumn("d", d).groupBy(cluster).agg(F.count("*").alias("n"), F.sum("d").alias("wss"))


def layer_counts(nodes: DataFrame, level: str = "level") -> DataFrame:
    """(layer, nodes): a node of level l is in layers 0 to l."""
    return nodes.select(F.explode(F.sequence(F.lit(0), F.col(level))).alias("layer")).groupBy("layer").agg(F.count("*").alias("nodes"))


def diverse(candidates, m: int):
    """Neighbour selection as a column: of candidates (array of structs d, id, v; nearest first) those nearer to the query than
    to any kept, filled up with the nearest left over to m."""
    def step(acc, x):
        apart = F.forall(acc, lambda k: F.sqrt(F.aggregate(F.zip_with(k["v"], x["v"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y)) > x["d"])
        return F.when((F.size(acc) < m) & apart, F.concat(acc, F.array(x))).otherwise(acc)

    kept = F.aggregate(candidates, F.slice(candidates, F.lit(1), F.lit(0)), step)
    rest = F.filter(candidates, lambda x: ~F.exists(kept, lambda k: k["id"] == x["id"]))
    return F.concat(kept, F.slice(rest, F.lit(1), F.lit(m) - F.size(kept)))
