"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in halves; each half is quantised by its own centroids, fitted by k-means on a sample of at most FIT rows (the
smallest hashes of vec_id), and every row is filed under its pair of centroids. A query orders the centroids of each half by
inner product and walks the pairs by the sum of the two with a heap, best first, until the entries met reach the share VISIT of
all rows; those entries are reranked by their exact inner product. The pairs a query has walked travel as a bitmap of bounded
size. Lists of nearby pairs are cut into shares of at most SHARE rows, queries into blocks of QUERIES, so that a hot pair or
vector loads no task more than another; of equal vectors a share needs k + 1, the smallest ids.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those whose length is not that of the
first sound vec_id, nor null ids. Of the rows of a repeated vec_id the least vector takes part, as query and as candidate, so an
id has one rank. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import cut, table

FIT, CENTROIDS, VISIT, SHARE, QUERIES, LISTS, ROUNDS = 16_384, 64, 0.5, 8192, 4096, 8, 12


def centroids(x, k: int, rounds: int = ROUNDS, seed: int = 5):
    """k-means; empty clusters keep their centroid."""
    import numpy as np

    rng = np.random.RandomState(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        for j in range(len(c)):
            mine = near == j
            if mine.any():
                c[j] = x[mine].mean(0)
    return c


def nearest(x, c):
    import numpy as np

    return np.concatenate([((c**2).sum(1)[None] - 2 * x[i : i + 8192] @ c.T).argmin(1) for i in range(0, len(x), 8192)] or [np.zeros(0, int)])


def walked(a, b, counts, enough: int):
    """Pairs (i, j) by rising a[i] + b[j], by multi-sequence over a heap, until their counts reach enough; as flags (len(a), len(b))."""
    import numpy as np

    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[order_a].tolist(), b[order_b].tolist()
    sizes = counts[np.ix_(order_a, order_b)].tolist()
    seen = [[False] * len(sb) for _ in sa]
    heap, met, last_a, last_b = [(sa[0] + sb[0], 0, 0)], 0, len(sa) - 1, len(sb) - 1
    pop, push = heapq.heappop, heapq.heappush
    while heap and met < enough:
        _, i, j = pop(heap)
        seen[i][j] = True
        met += sizes[i][j]
        if i < last_a and (j == 0 or seen[i + 1][j - 1]):
            push(heap, (sa[i + 1] + sb[j], i + 1, j))
        if j < last_b and (i == 0 or seen[i - 1][j + 1]):
            push(heap, (sa[i] + sb[j + 1], i, j + 1))
    out = np.zeros((len(sa), len(sb)), bool)
    out[np.ix_(order_a, order_b)] = seen
    return out


def best_of(q, own, flags, v, ids, cells, k: int):
    """(query row, vec_id, score): the k best of v for each query among the cells that its flags allow."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    v, ids, cells = v[order], ids[order], cells[order]
    _, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_inverse=True)
    at = np.argsort(same, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(same[at])) + 1]
    nth = np.empty(len(at), int)
    nth[at] = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    v, ids, cells = v[nth <= k], ids[nth <= k], cells[nth <= k]
    rows, found, scores = [], [], []
    for s in range(0, len(q), 256):
        x = q[s : s + 256] @ v.T
        x[~flags[s : s + 256][:, cells] | (own[s : s + 256, None] == ids[None])] = -np.inf
        least = np.partition(x, -k, axis=1)[:, -k] if x.shape[1] > k else np.full(len(x), -np.inf)
        # Products of a block may differ in the last places: all that may belong are summed anew, each in the same way.
        p, r = np.nonzero((x >= (least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0))))[:, None]) & np.isfinite(x))
        exact = np.einsum("ij,ij->i", q[s + p], v[r])
        order = np.lexsort((ids[r], -exact, p))
        p, r, exact = p[order], r[order], exact[order]
        first = np.r_[0, np.flatnonzero(np.diff(p)) + 1] if len(p) else np.zeros(0, int)
        keep = np.arange(len(p)) - np.repeat(first, np.diff(np.r_[first, len(p)])) < k
        rows.append(s + p[keep])
        found.append(ids[r[keep]])
        scores.append(exact[keep])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def search(rows: DataFrame, queries, k: int = 20, visit: float = VISIT, fit: int = FIT, size: int = CENTROIDS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, embedding) that the condition queries names, against all rows."""
    rows = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.where(good)
    schema = "query_id long, rank int, vec_id long, score double"
    first = rows.orderBy("vec_id").select(F.size("v")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = first[0]
    rows = rows.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))
    import numpy as np

    sample = np.stack(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit).select("v").toPandas()["v"].to_numpy())
    half = (d + 1) // 2
    if d == 1:
        sample = np.hstack([sample, np.zeros((len(sample), 1))])
    ca, cb = centroids(sample[:, :half], size), centroids(sample[:, half:], size)

    def filed(frames: Iterator):
        import pandas as pd

        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy())
                y = x[:, half:] if d > 1 else np.zeros((len(x), 1))
                yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "cell": nearest(x[:, :half], ca) * len(cb) + nearest(y, cb)})

    index = cut(rows.mapInPandas(filed, "vec_id long, v array<double>, cell int"))
    counts = np.zeros(len(ca) * len(cb), np.int64)
    for cell, n in index.groupBy("cell").count().collect():  # as many rows as there are pairs of centroids, at most
        counts[cell] = n
    total = int(counts.sum())
    lists = np.arange(len(ca)) * min(LISTS, len(ca)) // len(ca)
    held = [int(counts.reshape(len(ca), len(cb))[lists == x].sum()) for x in range(lists.max() + 1)]
    shares = [max(1, -(-n // SHARE)) for n in held]
    asked = index.where(queries)
    blocks = max(1, -(-asked.count() // QUERIES))

    def traverse(frames: Iterator):
        import pandas as pd

        table = counts.reshape(len(ca), len(cb))
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy())
                y = x[:, half:] if d > 1 else np.zeros((len(x), 1))
                a, b = -(x[:, :half] @ ca.T), -(y @ cb.T)
                flags = [walked(a[i], b[i], table, max(min(total, 4 * k), int(np.ceil(visit * total)))) for i in range(len(x))]
                near = [sorted(set(lists[w.any(1)].tolist())) for w in flags]
                yield pd.DataFrame({"query_id": f["vec_id"], "v": f["v"], "flags": [np.packbits(w).tobytes() for w in flags], "near": near})

    # The walk, the slow part, is dealt evenly.
    asked = asked.repartition(max(1, min(blocks * 32, 2 * asked.sparkSession.sparkContext.defaultParallelism)), "vec_id").mapInPandas(traverse, "query_id long, v array<double>, flags binary, near array<int>")
    per_list = F.array(*map(F.lit, shares))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("list", F.explode("near"))
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.element_at(per_list, F.col("list") + 1) - 1))).drop("near")
    list_of = F.element_at(F.array(*[F.lit(int(x)) for x in lists]), (F.col("cell") / len(cb)).cast("int") + 1)
    stock = index.withColumn("list", list_of).withColumn("share", F.pmod(F.xxhash64("vec_id"), F.element_at(per_list, F.col("list") + 1)).cast("int"))
    stock = stock.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def rerank(q, s):
        import pandas as pd

        if not len(q) or not len(s):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        flags = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in q["flags"]]), axis=1)[:, : len(counts)].astype(bool)
        own = q["query_id"].to_numpy()
        row, ids, score = best_of(np.stack(q["v"].to_numpy()), own, flags, np.stack(s["v"].to_numpy()), s["vec_id"].to_numpy(), s["cell"].to_numpy(), k)
        return pd.DataFrame({"query_id": own[row], "vec_id": ids, "score": score})

    keys = ["list", "share", "block"]
    found = asked.groupBy(*keys).cogroup(stock.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 20 = 0")
