"""MinHash near-dedup with odd sketches.

A document's set holds the 64-bit hashes of its distinct shingles of words. Documents with equal sets are one class, found by
a hash of the sorted set. Of each class one document goes on: BANDS bands of ROWS MinHash values give bucket keys, and an odd sketch (the parity
of how many MinHash samples fall on each of BITS places) goes with them. In a bucket, documents are first paired with the
bucket's earliest only - in EARLY bands, then in the others as far as that leaves different components -; a pair is a candidate
if the XOR population count of the two sketches allows the similarity, with a margin of several deviations, and is confirmed on
full sets. Then documents of a bucket that are not in one component meet in the bucket's own task: sketches tell which of them
have a possible partner, these come again with their texts, and sets are compared there by products of blocks, so that pairs that
fail never become rows, and links no more than join what is apart. Components are the result, so pairs within one are not needed.

Words are runs of characters other than space and the five ASCII controls after backspace, A-Z lowered. Fewer words than a
shingle has: the whole sequence is the one element. No words, or null: empty set, linked with nothing. A doc_id that repeats is one document, linked if any of its texts
is, its size that of the largest. Null doc_id: no part. Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import WORD, components, cut, grouped, release, sieve, table

ROWS, BANDS, BITS, SAMPLES = 4, 24, 1024, 192
#: Sketches may understate a similarity by this much before a pair is given up: five deviations of the estimate and more.
MARGIN = 0.16
#: Documents of a bucket compared at once, and words hashed at once.
BLOCK, CHUNK = 512, 1 << 16
#: Documents and shingles of a share of a bucket.
SHARE, LOAD = 2000, 4_000_000
#: Bands of the first round, which settles most copies before the others are looked at.
EARLY = 4


def hashed(documents: list[list[str]], n: int) -> list:
    """For each list of words the sorted distinct 64-bit hashes of its shingles of n words (numpy uint64)."""
    import numpy as np
    import pandas as pd

    out, at = [None] * len(documents), 0
    while at < len(documents):
        end, words = at, []
        while end < len(documents) and (end == at or len(words) + len(documents[end]) <= CHUNK):
            words += documents[end]
            end += 1
        if words:
            codes, unique = pd.factorize(np.asarray(words, object))
            every = pd.util.hash_array(unique, categorize=False)[codes]
        start = 0
        for k in range(at, end):
            size = len(documents[k])
            if size:
                h, m = every[start : start + size], min(n, size)
                with np.errstate(over="ignore"):
                    x = np.full(size - m + 1, m, np.uint64)
                    for i in range(m):  # each place its own odd factor, and a stir, so that order counts
                        x = (x ^ (h[i : size - m + 1 + i] * np.uint64(0x9E3779B97F4A7C15 + 2 * i))) * np.uint64(0xD6E8FEB86659FD93)
                        x ^= x >> np.uint64(32)
                out[k] = np.unique(x)
            else:
                out[k] = np.zeros(0, np.uint64)
            start += size
        at = end
    return out


def samples(sets: list, count: int):
    """MinHash values, (len(sets), count) uint64, of non-empty sorted sets."""
    import numpy as np

    rng = np.random.RandomState(20250101)
    a = (rng.randint(0, 1 << 62, count, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    out, at = np.full((len(sets), count), np.iinfo(np.uint64).max, np.uint64), 0
    with np.errstate(over="ignore"):
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= CHUNK):
                size += len(sets[end])
                end += 1
            flat = np.concatenate(sets[at:end]) if end - at > 1 else sets[at]
            starts = np.cumsum([0, *map(len, sets[at : end - 1])])
            for i in range(0, len(flat), CHUNK):  # one part, but for a set larger than a chunk
                part = flat[i : i + CHUNK]
                x, y = np.empty_like(part), np.empty_like(part)
                for k in range(count):
                    np.multiply(part, a[k], out=x)
                    np.right_shift(x, np.uint64(29), out=y)
                    np.bitwise_xor(x, y, out=x)
                    out[at:end, k] = np.minimum(out[at:end, k], np.minimum.reduceat(x, starts))
            at = end
    return out


def mixed(x, seed: int):
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        return x * np.uint64(0x94D049BB133111EB)


def odd_sketch(values, bits: int = BITS):
    """(n, bits / 64) int64: the parity of how many samples fall on each place; the sample's number counts, too."""
    import numpy as np

    n, count = values.shape
    spot = np.stack([mixed(values[:, k], k + 1) >> np.uint64(40) for k in range(count)], 1) % np.uint64(bits)
    flat = (np.arange(n)[:, None] * bits + spot.astype(np.int64)).ravel()
    return np.packbits((np.bincount(flat, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def allowed(similarity: float, bits: int = BITS, count: int = SAMPLES, margin: float = MARGIN) -> float:
    """The largest XOR population count at which the similarity is still thought possible.

    Of count samples 2 (1 - J) count differ; m random flips of bits leave bits (1 - (1 - 2 / bits)^m) / 2 odd on average.
    """
    return bits * (1 - (1 - 2 / bits) ** (2 * (1 - similarity + margin) * count)) / 2


def shingled(texts, n: int) -> list:
    import re

    find = re.compile(WORD).findall
    # Only A-Z are lowered.
    return hashed([find(t.lower() if t.isascii() else t.encode().lower().decode()) if t else [] for t in texts], n)


def described(docs: DataFrame, n: int, rows: int = ROWS, bands: int = BANDS, count: int = SAMPLES) -> DataFrame:
    """(doc_id, n, c1, c2, keys, sketch) for each row: size and hash of its set, bucket keys, odd sketch; no keys without words."""

    def run(frames: Iterator):
        import numpy as np
        import pandas as pd

        for f in frames:
            sets = shingled(f["text"], n)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys, sketches = [None] * len(sets), [None] * len(sets)
            if full:
                values = samples([sets[k] for k in full], max(count, rows * bands))
                sketch = odd_sketch(values[:, :count])
                band = np.stack([np.bitwise_xor.reduce(np.stack([mixed(values[:, b * rows + r], 131 * b + r + 7) for r in range(rows)]), axis=0) for b in range(bands)], 1).view(np.int64)
                for at, k in enumerate(full):
                    keys[k], sketches[k] = band[at], sketch[at]
            with np.errstate(over="ignore"):
                c1 = [int(np.add.reduce(mixed(s, 1)).view(np.int64)) if len(s) else 0 for s in sets]
                c2 = [int(np.bitwise_xor.reduce(mixed(s, 2)).view(np.int64)) if len(s) else 0 for s in sets]
            yield pd.DataFrame({"doc_id": f["doc_id"], "n": [len(s) for s in sets], "c1": c1, "c2": c2, "keys": keys, "sketch": sketches})

    return docs.mapInPandas(run, "doc_id long, n long, c1 long, c2 long, keys array<long>, sketch array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on full sets.

    Texts travel, as they compress better than the hashes of their sets; a batch makes the set of a text once.
    """

    def run(frames: Iterator):
        import numpy as np
        import pandas as pd

        for f in frames:
            texts = pd.concat([f["ta"], f["tb"]], ignore_index=True)
            codes, unique = pd.factorize(texts)
            sets = shingled(list(unique), n)
            keep = np.zeros(len(f), bool)
            for i, (p, q) in enumerate(zip(codes[: len(f)], codes[len(f) :], strict=True)):
                x, y = sets[p], sets[q]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield f.loc[keep, ["a", "b"]]

    used = sieve(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    texts = docs.where(used(F.col("doc_id")))
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long").distinct()


def apart(frame):
    """Of the documents of one bucket, or of two shares of it: which pairs are to be compared here, block by block.

    Yields (i, j, mask): positions of a block of rows and one of columns, and the pairs of different components whose sizes allow
    a link and that meet in no earlier band. In one share each pair comes once.
    """
    import numpy as np

    comp, side, key = (frame[c].to_numpy() for c in ("comp", "side", "key"))
    keys = np.stack(frame["keys"].to_numpy()).astype(np.int64)
    band = int(np.argmax(keys[0] == key[0]))
    one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for i in range(0, len(one), BLOCK):
        for j in range(0, len(two), BLOCK):
            u, v = one[i : i + BLOCK], two[j : j + BLOCK]
            mask = comp[u, None] != comp[None, v]
            for k in range(band):
                mask &= keys[u, k][:, None] != keys[v, k][None]
            if side[0] == 2:
                mask &= u[:, None] > v[None]
            if mask.any():
                yield u, v, mask


def close_by(frame, limit: float, percent: int):
    """The documents that sketches allow to be linked with another of their bucket."""
    import numpy as np

    sizes = frame["n"].to_numpy()
    bits = np.unpackbits(np.stack(frame["sketch"].to_numpy()).astype(np.int64).view(np.uint8), axis=1).astype(np.float32)
    ones, found = bits.sum(1), np.zeros(len(frame), bool)
    for u, v, mask in apart(frame):
        mask &= ones[u, None] + ones[None, v] - 2 * (bits[u] @ bits[v].T) <= limit
        mask &= 100 * np.minimum(sizes[u, None], sizes[None, v]) >= percent * np.maximum(sizes[u, None], sizes[None, v])
        found[u[mask.any(1)]] = True
        found[v[mask.any(0)]] = True
    return frame.loc[found, ["key", "x", "y", "doc"]]


def linked(frame, n: int, percent: int):
    """Links between documents of one bucket, confirmed on full sets, no more than join what is apart. Pairs never become rows."""
    import numpy as np
    import pandas as pd

    codes, unique = pd.factorize(frame["text"])
    sets = shingled(list(unique), n)
    sizes = np.array([len(s) for s in sets])
    # Only shingles of two texts or more can be common; each gets a number.
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    numbers = np.cumsum(count > 1) - 1
    number, owner = numbers[number[shared]], owner[shared]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    total = int(number[-1]) + 1 if len(number) else 0

    def common(p, q):
        out, step = np.zeros((len(p), len(q)), np.float32), 4096
        place_p, place_q = np.full(len(sets), -1), np.full(len(sets), -1)
        place_p[p], place_q[q] = np.arange(len(p)), np.arange(len(q))
        for lo in range(0, total, step):
            a, b = np.searchsorted(number, [lo, lo + step])
            x, y = np.zeros((len(p), step), np.float32), np.zeros((len(q), step), np.float32)
            for m, place in ((x, place_p), (y, place_q)):
                at = place[owner[a:b]]
                m[at[at >= 0], number[a:b][at >= 0] - lo] = 1
            out += x @ y.T
        return out

    parent, doc = {}, frame["doc"].to_numpy()

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    comp, out = frame["comp"].to_numpy(), []
    for u, v, mask in apart(frame):
        p, up = np.unique(codes[u], return_inverse=True)
        q, vq = np.unique(codes[v], return_inverse=True)
        both = common(p, q)[up][:, vq].astype(np.int64)
        x, y = sizes[codes[u]][:, None], sizes[codes[v]][None]
        for i, j in zip(*np.nonzero(mask & (100 * both >= percent * (x + y - both))), strict=True):
            a, b = root(comp[u[i]]), root(comp[v[j]])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((doc[u[i]], doc[v[j]]))
    return pd.DataFrame(out, columns=["a", "b"]) if out else None


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each doc_id of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    info = cut(described(docs, n))
    full = info.where("n > 0")
    classes = cut(full.groupBy("c1", "c2", "n").agg(F.min(F.struct("doc_id", "keys", "sketch")).alias("r")))
    first = classes.select("c1", "c2", "n", F.col("r.doc_id").alias("first"))
    same = full.select("doc_id", "c1", "c2", "n").join(first, ["c1", "c2", "n"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    reps = classes.select(F.col("r.doc_id").alias("id"), "n", F.col("r.keys").alias("keys"), F.col("r.sketch").alias("sketch"))
    limit = allowed(percent / 100)

    def star(low: int, high: int) -> DataFrame:
        """Each document with the earliest of its bucket, for a range of bands."""
        flat = reps.select("id", F.explode(F.slice("keys", low + 1, high - low)).alias("key"))
        return flat.join(flat.groupBy("key").agg(F.min("id").alias("b")), "key").where("id > b").select(F.col("id").alias("a"), "b").distinct()

    def close(pairs: DataFrame) -> DataFrame:
        side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return cut(pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where(differ <= limit).select("a", "b").distinct())

    links = cut(confirmed(close(star(0, EARLY)), docs, n, percent))
    comp = cut(components(links))
    # The other bands, without the pairs that are known to be in one component.
    named = lambda x: comp.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    later = star(EARLY, BANDS).join(named("a"), "a", "left").join(named("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = links.unionByName(cut(confirmed(close(later), docs, n, percent)))
    release(spark)
    comp = cut(components(links))
    # What shares a bucket and is in different components as yet; a large bucket is cut into shares, of which two meet at a time.
    placed = reps.join(comp, "id", "left").select("id", "n", F.coalesce("component", "id").alias("comp"), F.explode("keys").alias("key"))
    several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("s")).where("lo <> hi").select("key", F.ceil(F.greatest(F.col("c") / SHARE, F.col("s") / LOAD)).cast("int").alias("shares"))
    placed = placed.join(several, "key").withColumn("share", F.pmod(F.xxhash64("id", "key"), F.col("shares")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda o: F.struct(F.least(o, F.col("share")).alias("x"), F.greatest(o, F.col("share")).alias("y"), F.when(o == F.col("share"), 2).when(o > F.col("share"), 0).otherwise(1).alias("side")))
    work = placed.select("key", "id", "comp", F.explode(others).alias("s")).select("key", "comp", "s.x", "s.y", "s.side", "id")
    work = cut(work.join(reps, "id").withColumnRenamed("id", "doc"))
    groups = ["key", "x", "y"]
    near = cut(grouped(work, groups, ["doc"], lambda key, f: close_by(f, limit, percent), "key long, x int, y int, doc long"))
    release(spark)
    # Where the sketches allow a link, the bucket's task gets the texts of those documents and tells by their sets.
    held = sieve(near, "doc")
    texts = docs.where(held(F.col("doc_id"))).select(F.col("doc_id").alias("doc"), "text")
    ready = work.drop("sketch").join(near, [*groups, "doc"], "left_semi").join(texts, "doc")
    more = cut(grouped(ready, groups, ["doc"], lambda key, f: linked(f, n, percent), "a long, b long"))
    release(spark)
    comp = components(links.unionByName(more).unionByName(same))
    sizes = info.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    out = sizes.join(comp, sizes.doc_id == comp.id, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without those that are in the component of an earlier one; a null doc_id stays."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
