"""Embedding near-dedup by cross-polytope hashing.

A table of hashes rotates vectors at random (three rounds of sign flips and a fast Hadamard transform); the bucket is the axis,
with sign, nearest to the rotated vector, and PARTS rotations are strung together as the corpus grows. Each vector is also put
into the PROBES - 1 buckets that come next. Vectors that are equal in every component are one before anything is compared, with
a count. In a bucket of one label, blocks of vectors are multiplied in double precision; a pair that met in an earlier bucket of
theirs is passed over, so every linked pair is counted once, and only counts and a spanning forest of each block leave the task.

Vectors that are null, zero or hold null or non-finite components, and rows with null labels, link with nothing; they are in the result.
Of the rows of a repeated vec_id one takes part, of the least label (as text), then of the least vector. Null vec_id: no part.
Vectors of different lengths do not link.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import components, cut, grouped, table

TABLES, PROBES, BUCKET, BLOCK, SEED = 10, 2, 2000, 1024, 11


def rotated(x, seed: int):
    """x (n, d) through three rounds of sign flips and Hadamard transforms, d filled up to a power of two."""
    import numpy as np

    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.RandomState(seed)
    for _ in range(3):
        y *= rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            z = y.reshape(len(y), d // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), d)
            h *= 2
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)


def buckets(x, tables: int, parts: int, probes: int = PROBES, seed: int = SEED):
    """(n, tables * probes) int64: the buckets of each vector, those of a table side by side; the first is its own."""
    import numpy as np

    out = np.empty((len(x), tables * probes), np.int64)
    for t in range(tables):
        own, second, loss = np.zeros(len(x), np.int64), [], []
        for k in range(parts):
            y = rotated(x, seed * 1009 + t * 31 + k)
            a = np.abs(y)
            order = np.argsort(-a, axis=1, kind="stable")[:, :probes]
            axis = order * 2 + (np.take_along_axis(y, order, 1) < 0)
            own = own * (2 * y.shape[1]) + axis[:, 0]
            second.append(axis)
            loss.append(np.take_along_axis(a, order[:, :1], 1) - np.take_along_axis(a, order, 1))
        width = 2 * y.shape[1]
        out[:, t * probes] = own
        # The other probes change the one part, to the axis, that costs least.
        cost = np.concatenate([x[:, 1:] for x in loss], axis=1)
        best = np.argsort(cost, axis=1, kind="stable")[:, : probes - 1]
        for m in range(best.shape[1]):
            part, nth = best[:, m] // (probes - 1), best[:, m] % (probes - 1) + 1
            code = own.copy()
            for k in range(parts):
                place = width ** (parts - 1 - k)
                here = part == k
                code[here] += (second[k][here, nth[here]] - second[k][here, 0]) * place
            out[:, t * probes + 1 + m] = code
    return out


def parts_for(rows: int, width: int = 128, bucket: int = BUCKET) -> int:
    """Rotations strung together so that a bucket holds about this many of rows spread evenly."""
    parts = 1
    while rows > bucket * width**parts:
        parts += 1
    return parts


def links_in(frame, least: float):
    """(id, n, low) of a bucket: links counted by weight, and an id to link with for the forest."""
    import numpy as np
    import pandas as pd

    x = np.stack(frame["unit"].to_numpy())
    h = np.stack(frame["h"].to_numpy())
    ids, weight, side, at = frame["id"].to_numpy(), frame["weight"].to_numpy(), frame["side"].to_numpy(), frame["at"].to_numpy()
    n = np.zeros(len(ids), np.int64)
    parent = np.arange(len(ids))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for i in range(0, len(one), BLOCK):
        for j in range(0, len(two), BLOCK):
            a, b = one[i : i + BLOCK], two[j : j + BLOCK]
            close = x[a] @ x[b].T >= least
            p, q = np.nonzero(close)
            p, q = a[p], b[q]
            keep = (ids[p] < ids[q]) if side[0] == 2 else ids[p] != ids[q]
            p, q = p[keep], q[keep]
            if not len(p):
                continue
            first = np.zeros(len(p), bool)
            for s in range(0, len(p), 200_000):
                u, v = p[s : s + 200_000], q[s : s + 200_000]
                first[s : s + 200_000] = met_first(h[u], h[v], at[u])
            p, q = p[first], q[first]
            np.add.at(n, p, weight[q])
            np.add.at(n, q, weight[p])
            for u, v in zip(p.tolist(), q.tolist(), strict=True):
                u, v = root(u), root(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
    low = ids[[root(i) for i in range(len(ids))]]
    linked = (n > 0) | (low != ids)
    return pd.DataFrame({"id": ids[linked], "n": n[linked], "low": low[linked]})


def met_first(hu, hv, at):
    """Whether the bucket at (a table's number) is the first that the rows of hu and hv share: in table order, then by code."""
    import numpy as np

    out = np.ones(len(hu), bool)
    tables = hu.shape[1] // PROBES
    table_of, code = at // (1 << 40), at % (1 << 40)
    for t in range(tables):
        a, b = hu[:, t * PROBES : (t + 1) * PROBES], hv[:, t * PROBES : (t + 1) * PROBES]
        shared = (a[:, :, None] == b[:, None, :]).any(2)
        low = np.where(shared, a, np.iinfo(np.int64).max).min(1)
        out &= ~((t < table_of) & shared.any(1))
        out &= ~((t == table_of) & (low < code))
    return out


def near_vectors(rows: DataFrame, least: float = 0.93, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vec_id of rows (vec_id, embedding, label)."""
    rows = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    good = F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    one = rows.where(good).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    sound = cut(one.select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h1"), F.hash("v", "label").alias("h2")))
    same = sound.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "v")).alias("r"), F.count("*").alias("weight"))
    reps = cut(same.select(F.col("r.vec_id").alias("id"), "r.label", "r.v", "weight", "h1", "h2"))
    parts = parts_for(reps.count())

    def hash_rows(frames: Iterator):
        import numpy as np
        import pandas as pd

        for f in frames:
            for _, g in f.groupby(f["v"].map(len)):
                x = np.stack(g["v"].to_numpy())
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"id": g["id"].to_numpy(), "label": g["label"].to_numpy(), "weight": g["weight"].to_numpy(), "unit": list(x), "h": list(buckets(x, tables, parts)), "size": x.shape[1]})

    keyed = cut(reps.select("id", "label", "weight", "v").mapInPandas(hash_rows, "id long, label string, weight long, unit array<double>, h array<long>, size int"))
    spots = keyed.select("id", "label", "size", F.posexplode("h").alias("k", "code")).withColumn("at", (F.col("k") / PROBES).cast("long") * F.lit(1 << 40) + F.col("code"))
    # A large bucket is cut into shares, and pairs of shares are compared apart: no task has more than two shares.
    counts = spots.groupBy("label", "size", "at").agg(F.count("*").alias("c")).where("c > 1").withColumn("shares", F.ceil(F.col("c") / BUCKET).cast("int"))
    placed = spots.join(counts, ["label", "size", "at"]).withColumn("share", F.pmod(F.xxhash64("id", "at"), F.col("shares")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda o: F.struct(F.least(o, F.col("share")).alias("x"), F.greatest(o, F.col("share")).alias("y"), F.when(o == F.col("share"), 2).when(o > F.col("share"), 0).otherwise(1).alias("side")))
    work = placed.select("id", "label", "size", "at", F.explode(pairs).alias("s")).select("id", "label", "size", "at", "s.x", "s.y", "s.side").join(keyed.select("id", "weight", "unit", "h"), "id")

    found = cut(grouped(work, ["label", "size", "at", "x", "y"], ["id"], lambda key, f: links_in(f, least), "id long, n long, low long"))
    n = found.groupBy("id").agg(F.sum("n").alias("n"))
    member = sound.join(reps.select("h1", "h2", "id", "weight"), ["h1", "h2"])
    comp = components(found.where("low <> id").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct().unionByName(member.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))))
    links = member.join(n, "id", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    every = rows.select("vec_id").distinct()
    out = every.join(links, "vec_id", "left").join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_vector_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
