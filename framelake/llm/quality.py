"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams, hashed into DIM places: one and two words, and one to three word shapes (case, the marks a
word ends with, whether it repeats the word before). Each is scaled by the log-count ratio of the classes, counted over all
a sample of at most COUNTED labelled training rows; a linear hinge-loss model is fitted by dual coordinate descent to unit
vectors of about FIT of these, and its margin is turned into a probability on a fifth of them that was kept out of the fit.
The sample's ids and labels, of bounded size, are broadcast, so that no text is moved.

Null and empty texts have no n-gram and get the score of the bias. Rows are scored one by one. A doc_id with several labels
counts as good if half of them or more are. Labels that are null are not used. Without labels of both classes every score is
the share of good ones among the labels, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import release, table

DIM, COUNTED, FIT, EPOCHS, COST, LEAST = 1 << 18, 40_000, 5000, 12, 1.0, 0.3
MARKS = ".,;:!?|*#$%&=+-_<>()[]{}\"'/\\"


def shape(w: str) -> str:
    core = w.strip(MARKS)
    kind = "0" if not core else "U" if core.isupper() and len(core) > 1 else "T" if core.istitle() else "l" if core.islower() else "d" if core.isdigit() else "m"
    tail = w[len(w.rstrip(MARKS)) :]
    return kind + (tail[:3] if core else w[:3])


def features(texts) -> list:
    """For each text the sorted distinct places (numpy int32) of its n-grams."""
    import numpy as np
    import pandas as pd

    words = [(t or "").split() for t in texts]
    flat = [w for ws in words for w in ws]
    if not flat:
        return [np.zeros(0, np.int32) for _ in words]
    codes, unique = pd.factorize(np.asarray(flat, object))
    h = pd.util.hash_array(np.asarray([w.lower() for w in unique], object), categorize=False)[codes]
    g = pd.util.hash_array(np.asarray([shape(w) for w in unique], object), categorize=False)[codes]
    out, at = [], 0
    shift, one, two, three = np.uint64(64 - DIM.bit_length() + 1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    with np.errstate(over="ignore"):
        for ws in words:
            n = len(ws)
            if not n:
                out.append(np.zeros(0, np.int32))
                continue
            w, c = h[at : at + n], codes[at : at + n]
            s = g[at : at + n].copy()
            s[1:][c[1:] == c[:-1]] ^= three
            x = np.concatenate([w * one, (w[:-1] * two + w[1:]) * one, (s ^ two) * one, (s[:-1] * three + s[1:]) * one, ((s[:-2] * two + s[1:-1]) * three + s[2:]) * one])
            x ^= x >> np.uint64(31)
            out.append(np.unique((x * two) >> shift).astype(np.int32))
            at += n
    return out


def ratios(good, bad):
    """Log-count ratios of smoothed class counts; places met fewer than three times say nothing."""
    import numpy as np

    r = np.log((good + 1) / (good + 1).sum()) - np.log((bad + 1) / (bad + 1).sum())
    r[good + bad < 3] = 0
    return r


def descend(rows: list, y, r, cost, epochs: int = EPOCHS, seed: int = 3):
    """Weights (DIM) and bias of the hinge loss by dual coordinate descent; rows: places, scaled by r to unit length; y: -1 or 1."""
    import numpy as np

    rng = np.random.RandomState(seed)
    w, bias, alpha = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    scale = [1 / max(1e-12, float(np.sqrt(r[x] @ r[x]))) for x in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            v = r[x] * scale[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            old = alpha[i]
            alpha[i] = min(max(old - gradient / (v @ v + 1), 0.0), cost[i])
            if alpha[i] != old:
                step = (alpha[i] - old) * y[i]
                w[x] += step * v
                bias += step
    return w, bias


def margins(rows: list, w, bias: float, r):
    import numpy as np

    out = np.empty(len(rows))
    for i, x in enumerate(rows):
        v = r[x]
        out[i] = (w[x] @ v) / max(1e-12, np.sqrt(v @ v)) + bias
    return out


def calibrated(m, good, rounds: int = 50):
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton steps on targets drawn in from 0 and 1."""
    import numpy as np

    pos, neg = good.sum(), len(good) - good.sum()
    t = np.where(good > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        d, q = p - t, p * (1 - p) + 1e-9
        h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum()]])
        step = np.linalg.solve(h, np.array([(d * m).sum() + 1e-3 * (a - 1), d.sum()]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def train(labelled: DataFrame, fit: int = FIT) -> dict:
    """The model from (text, good 0 / 1). The driver gets at most DIM counts and the places of about fit rows.

    Both come as Arrow columns, the places of a row as one run of bytes: as rows of Python numbers they would take ten times the memory.
    """
    import numpy as np

    def counted(frames: Iterator):
        import pandas as pd

        n = np.zeros((2, DIM), np.int64)
        size = [0, 0]
        for f in frames:
            for x, g in zip(features(f["text"]), f["good"], strict=True):
                n[int(g)][x] += 1
                size[int(g)] += 1
        used = np.flatnonzero(n.any(0))
        yield pd.DataFrame({"place": np.r_[used, -1], "bad": np.r_[n[0][used], size[0]], "good": np.r_[n[1][used], size[1]]})

    counts = labelled.select("text", "good").mapInPandas(counted, "place int, bad long, good long").groupBy("place").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    place, *each = (counts.column(c).to_numpy() for c in ("place", "bad", "good"))
    bad, good = (int(x[place < 0].sum()) for x in each)
    if not bad or not good:
        return {"share": good / (bad + good) if bad + good else 0.5}
    n = np.zeros((2, DIM))
    for k, x in enumerate(each):
        n[k][place[place >= 0]] = x[place >= 0]
    r = ratios(n[1], n[0])
    del counts, place, each, n
    release(labelled.sparkSession)

    def listed(frames: Iterator):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"x": [x.tobytes() for x in features(f["text"])], "good": f["good"], "order": f["order"]})

    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit / (bad + good)))
    sample = labelled.where(chosen).select("text", "good", F.xxhash64("text").alias("order")).mapInPandas(listed, "x binary, good int, order long").toArrow().sort_by([("order", "ascending"), ("good", "ascending")])
    rows, y = [np.frombuffer(x.as_buffer(), np.int32) for x in sample.column("x")], sample.column("good").to_numpy()
    out = np.arange(len(rows)) % 5 == 0
    if len(set(y[~out].tolist())) < 2 or len(set(y[out].tolist())) < 2:
        out[:] = False
    # Both classes weigh the same.
    inside = y[~out]
    cost = np.where(y > 0, COST * len(inside) / (2 * max(1, inside.sum())), COST * len(inside) / (2 * max(1, len(inside) - inside.sum())))
    train_rows = [x for x, o in zip(rows, out, strict=True) if not o]
    w, bias = descend(train_rows, np.where(inside > 0, 1.0, -1.0), r, cost[~out])
    kept_rows, kept_y = ([x for x, o in zip(rows, out, strict=True) if o], y[out]) if out.any() else (train_rows, inside)
    a, b = calibrated(margins(kept_rows, w, bias, r), kept_y)
    del sample, rows, train_rows, kept_rows
    release(labelled.sparkSession)
    return {"w": w.astype(np.float32), "r": r.astype(np.float32), "bias": bias, "a": a, "b": b}


def scores(texts, model: dict):
    import numpy as np

    if "share" in model:
        return np.full(len(texts), float(model["share"]))
    m = margins(features(texts), model["w"], model["bias"], model["r"])
    return 1 / (1 + np.exp(-np.clip(model["a"] * m + model["b"], -30, 30)))


def scored(docs: DataFrame, model: dict, keys: list[str]) -> DataFrame:
    """The columns keys, and score, of each row of docs."""

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            score = pa.array(scores(b.column("_text").to_pylist(), model), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), score], names=[*keys, "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*keys, F.col("text").alias("_text")).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", score double")


def accepted(docs: DataFrame, model: dict, least: float = LEAST) -> DataFrame:
    """The rows of docs whose score is at least so high, unchanged and where they are."""

    def run(batches: Iterator):
        import pyarrow as pa

        at = docs_columns.index("text")
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at).to_pylist(), model) >= least))

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, counted: int = COUNTED) -> dict:
    """The model of the labelled rows that are not held out: all of them, or counted of them by a hash of doc_id."""
    good = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    share = min(1.0, counted / max(1, good.count()))
    sample = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * share)).limit(counted + counted // 10)
    return train(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "good"))


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, fitted(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without those that the classifier, trained on their labelled rows, rejects."""
    return accepted(docs, fitted(docs, table(spark, sf_dir, "labels")))
