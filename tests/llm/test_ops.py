import gc
import hashlib
import itertools
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import llm
from framelake.llm import license_scan, line_dedup, mixing, multi_index, near_dup, packing, quality, secret_scan, vector_dedup, warc_fixity
from framelake.llm.common import components, sieve, with_index

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def groups(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# --- shared helpers ---


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 100), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_index_is_gapless_and_ordered(spark):
    df = with_index(spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(97))), ["k", "id"])
    rows = sorted(df.collect(), key=lambda r: r.idx)
    assert [r.idx for r in rows] == list(range(1000)) and rows == sorted(rows, key=lambda r: (r.k, r.id))


def test_sieve_keeps_all_members(spark):
    df = spark.range(0, 3000, 3)
    held = sieve(df, "id")
    assert spark.range(3000).where("id % 3 = 0").where(held(F.col("id"))).count() == 1000
    assert spark.range(3000).where(held(F.col("id"))).count() < 1100


# --- 1 quality ---


def test_quality_held_out(spark):
    rows = llm.queries()["op1_quality_nbsvm"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    m = rows.merge(labels, on="doc_id")
    m = m[m.held_out]
    good, bad = m[m.quality == 1].score, m[m.quality == 0].score
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 5), (1, 1, 5), (2, 0, 5), (3, 1, 5), (8, 0, 5), (None, 1, 5), (9, None, 5), (10, 0, 5)], "doc_id long, quality int, text int")
    model = quality.fitted(odd, labels)
    assert quality.scored(odd, model, ["n_chars"]).where("score between 0 and 1").count() == odd.count()
    none = quality.fitted(odd, labels.limit(0))
    assert {r.score for r in quality.scored(odd, none, ["n_chars"]).collect()} == {0.5}
    assert quality.accepted(odd, none).count() == odd.count() and quality.accepted(odd.limit(0), model).count() == 0


def test_quality_fit_takes_few_bytes_a_place(spark):
    """Of some 400,000 places in the sample the driver's Python keeps no numbers of its own, which take 40 bytes each."""
    word = lambda k: F.concat(F.lit("w"), (F.xxhash64("id", F.lit(k)) % 100_000).cast("string"))
    rows = spark.range(600).select(F.concat_ws(" ", *[word(k) for k in range(350)]).alias("text"), (F.col("id") % 2).cast("int").alias("good"))
    quality.train(rows.limit(20), 20)
    gc.collect()
    tracemalloc.start()
    try:
        assert "w" in quality.train(rows, 600)
        assert tracemalloc.get_traced_memory()[1] < 25e6
    finally:
        tracemalloc.stop()


def test_coordinate_descent_solves_the_dual():
    rng = np.random.RandomState(0)
    x = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(60)]
    y = np.array([1.0 if 3 in set(v) or 7 in set(v) else -1.0 for v in x])
    r = rng.rand(50) + 0.5
    w, b = quality.descend(x, y, r, np.full(60, 1.0), 200)
    dense = np.zeros((60, 50))
    for i, v in enumerate(x):
        dense[i, v] = r[v] / np.linalg.norm(r[v])
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (dense @ w + b)).sum()
    best = loss(w, b)
    assert all(loss(w + 0.01 * rng.randn(50), b + 0.01 * rng.randn()) >= best - 1e-6 for _ in range(200))


# --- 2 packing ---


def pieces_ok(rows, docs, whole):
    by = defaultdict(list)
    for p in rows:
        by[p.doc_id].append(p)
    for doc, text in docs.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by[doc], key=lambda p: p.start)
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]] and sum(p.length for p in parts) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids) for p in parts)
    seqs = defaultdict(list)
    for p in rows:
        seqs[p.sequence_id].append((p.offset, p.length))
    waste = total = 0
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]]
        n = sum(n for _, n in s)
        assert n <= 1024
        waste += 0 if n & (n - 1) == 0 else 1024 - n
        total += n
    return waste / total


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in documents.collect()}
    rows = llm.queries()["op2_sequence_packing"](spark, SF).collect()
    assert pieces_ok(rows, docs, Tokenizer.from_file(packing.vocabulary())) < 0.02


def test_packing_odd_rows(spark, odd):
    rows = packing.pack(odd).collect()
    assert {(r.doc_id, r.doc_tokens) for r in rows} >= {(3, 1), (4, 1), (7, 1)} and sum(r.length for r in rows if r.doc_id == 8) == max(r.doc_tokens for r in rows)
    assert packing.pack(odd.limit(0)).count() == 0


def test_encoder_equals_tokenizer():
    e = packing.Encoder(packing.vocabulary())
    texts = ["a  b\n\n c \t d ", "<|endoftext|> x", "  lead", "it's 12.5! ok x  y  ", "x " * 10, " ", "\n", "don't. 'tis", "ab́c déjà  vu.", "x\x1c \x1cy", "end.\nNext", "a b c", "日本 語", "y" * 300 + " z", "one,two. three\r\nfour"]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_takes_many_lines_without_spaces():
    e = packing.Encoder(packing.vocabulary())
    for t in ("\n".join(f"row{k},{k * 7}" for k in range(5000)), " " + "word\n" * 5000, "a\nb\n\nc\nd\r\ne.\nf " * 1500, "1\n\u00e9\n." * 3000):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids, repr(t[:20])


def test_cuts_are_optimal():
    rng = np.random.RandomState(1)
    for _ in range(20):
        places = np.r_[0, np.cumsum(rng.randint(1, 7, 14))]
        costs, limit = rng.randint(0, 5, 15).astype(float), 16
        waste = lambda a, b: (0 if b - a in (8, 4) else limit - (b - a)) + packing.WINDOW
        best = [0.0] + [np.inf] * 14
        for j in range(1, 15):
            best[j] = min(best[i] + waste(places[i], places[j]) + costs[j] for i in range(j) if places[j] - places[i] <= limit)
        c = packing.cuts(places, costs, limit)
        assert sum(waste(places[a], places[b]) + costs[b] for a, b in itertools.pairwise(c)) == best[-1]


def test_cuts_are_at_document_and_sentence_ends():
    rng = np.random.RandomState(8)
    ends = np.zeros(101, bool)
    ends[100] = True
    docs = []
    for k in range(200):  # the last document is one sentence of five windows
        ids = rng.randint(1, 100, rng.randint(1, 900) if k < 199 else 5000)
        if k < 199:
            ids[rng.rand(len(ids)) < 0.05] = 100
        docs.append((k, np.append(ids, 0).astype("<u4")))
    rows = [r for part in packing.pieces(((d, x.tobytes()) for d, x in docs), ends, 0, stretch=20_000) for r in part]
    last, inner, waste, total = {}, 0, 0, 0
    for d, start, length, _, n, seq, offset in rows:
        last[seq] = (d, start + length, n, offset + length)
    for d, end, n, size in last.values():
        inner += end != n and docs[d][1][end - 1] != 100
        assert d == 199 or end == n or docs[d][1][end - 1] == 100
        waste += 0 if size & (size - 1) == 0 else 1024 - size
        total += size
    assert 4 <= inner <= 6 and waste / total < 0.02


# --- 3 lines ---


def plain_lines(docs):
    """Brute force over all pairs of lines; docs: (doc_id, text) in order."""
    lines = [(d, k, frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", x.lower()) if w)) for d, t in docs if t is not None for k, x in enumerate(t.split("\n"))]
    gone = set()
    for i, (d, k, s) in enumerate(lines):
        if s and any(t and 9 * len(s & t) >= 4 * (len(s) + len(t)) and (e, m) < (d, k) for e, m, t in lines[:i]):
            gone.add((d, k))
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs}


def test_lines_against_brute_force(spark, documents):
    few = documents.where("doc_id < 60")
    want = plain_lines(sorted((r.doc_id, r.text) for r in few.collect()))
    assert {r.doc_id: r.text for r in line_dedup.deduped(few).collect()} == want


def test_lines_many_variants(spark):
    rng = np.random.RandomState(4)
    base = [f"w{i}" for i in range(12)]
    docs = []
    for i in range(120):
        words = list(base)
        for k in rng.choice(12, rng.randint(0, 4), replace=False):
            words[k] = f"v{rng.randint(6)}"
        docs.append((i, " ".join(words) + "\n\ncommon line of five words"))
    got = {r.doc_id: r.text for r in line_dedup.deduped(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_lines(docs)


def test_words_of_lines_are_sorted_as_numbers(spark):
    """Their type says that none is null; else each comparison is one of objects. Places are exact for any id, earliest first."""
    lines = spark.createDataFrame([(1, 0, [3, 1, 2])], "doc long, line int, w array<long>")
    plan = line_dedup.distinct_sets(lines)._jdf.queryExecution().optimizedPlan()
    found = []

    def walk(e):
        if e.nodeName() == "SortArray":
            found.append(e.children().apply(0).dataType().containsNull())
        for k in range(e.children().size()):
            walk(e.children().apply(k))

    def nodes(p):
        for k in range(p.expressions().size()):
            walk(p.expressions().apply(k))
        for k in range(p.children().size()):
            nodes(p.children().apply(k))

    nodes(plan)
    assert found and not any(found)
    ids = [-(2**63), -(2**32) - 1, -(2**32), -1, 0, 7, 2**32 - 1, 2**32, 2**63 - 1]
    cases = list(itertools.combinations_with_replacement(ids, 2))
    near, far = line_dedup.places(F.col("doc"), F.col("line"))
    rows = spark.createDataFrame([(k, *x) for k, (a, b) in enumerate(cases) for x in ((b, 5), (a, 3), (a, 2**31 - 1))], "k int, doc long, line int")
    least = rows.groupBy("k").agg(F.min(near).alias("near"), F.min(far).alias("far"))
    assert {r[0]: r[1:] for r in least.select("k", *line_dedup.place_of("near", "far")).collect()} == {k: (a, 3) for k, (a, _) in enumerate(cases)}


def test_words_of_lines_are_plain_rows(spark, documents, monkeypatch):
    """They are not coded, and their folder goes before the last join."""
    made = []
    monkeypatch.setattr(line_dedup, "laid", lambda df, f=line_dedup.laid: made.append(f(df)) or made[-1])
    few = documents.where("doc_id < 60")
    assert line_dedup.deduped(few).count() == few.count()
    path = spark._jvm.org.apache.hadoop.fs.Path(made[0].written_to)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert made[0].columns == ["doc", "line", "w"] and len(made) == 1 and not files.exists(path)
    again = line_dedup.laid(line_dedup.hashed_lines(few))
    assert sorted(again.collect()) == sorted(line_dedup.hashed_lines(few).collect())
    assert files.exists(spark._jvm.org.apache.hadoop.fs.Path(again.written_to))


def test_lines_odd_rows(spark, odd):
    rows = {r.n_chars: r for r in line_dedup.deduped(odd).collect()}
    assert rows[3].text is None and rows[3].n_lines == 0 and rows[4].text == "" and rows[5].text == " \n\t "
    assert rows[0].text == rows[1].text != "" and rows[10].text == "" and rows[11].n_removed == 2
    assert line_dedup.deduped(odd.limit(0)).count() == 0


# --- 4 neighbours ---


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_multi_index_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(e.embedding).astype(float)
    ids = e.vec_id.to_numpy()
    got = llm.queries()["op4_multi_index"](spark, "/root/testdata/sf0.01").toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and np.allclose(mine.score, s[mine.vec_id]) and (np.diff(mine.score) <= 0).all()
        hits += len(set(mine.vec_id) & set(ids[np.argsort(-s, kind="stable")[:20]]))
        total += 20
    assert hits / total >= 0.9


def test_multi_index_odd_rows(spark):
    v = [float(k) for k in range(1, 9)]
    rows = [(0, v, 1), (20, v, 1), (None, v, 1), (1, None, 1), (2, [0.0] * 8, 1), (3, [float("nan"), *v[1:]], 1), (4, [None, *v[1:]], 1), (5, v[:4], 1), *[(k, v, None) for k in range(6, 12)], (12, [2 * a for a in v], 1)]
    got = multi_index.search(vectors(spark, rows), "vec_id % 20 = 0", k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 12), (0, 6), (0, 7), (20, 12), (20, 0), (20, 6)]
    assert multi_index.search(vectors(spark, []), "vec_id % 20 = 0").count() == 0


def test_multi_index_repeated_ids(spark):
    rng = np.random.RandomState(9)
    x = rng.randn(40, 8)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    once = multi_index.search(vectors(spark, rows), "vec_id % 20 = 0", k=5).collect()
    again = multi_index.search(vectors(spark, rows * 3), "vec_id % 20 = 0", k=5).collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, again)) and len({(r.query_id, r.rank) for r in again}) == len({(r.query_id, r.vec_id) for r in again}) == 10
    other = [(20, [9.0] * 8, 1), (33, [9.0] * 8, 1)]  # not the least vectors of their ids, as 9 is above all first components
    assert sorted(map(tuple, multi_index.search(vectors(spark, rows + other), "vec_id % 20 = 0", k=5).collect())) == sorted(map(tuple, once))


def test_heap_walks_pairs_in_order():
    rng = np.random.RandomState(0)
    a, b, n = rng.rand(6), rng.rand(7), rng.randint(0, 5, (6, 7))
    flags = multi_index.walked(a, b, n, 30)
    sums = a[:, None] + b[None]
    assert n[flags].sum() >= 30 and sums[flags].max() <= sums[~flags].min()


# --- 5 secrets ---


def base_spans(text):
    out = [("assign", m) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(((k, *m.span()) for k, m in out), key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets_against_plain_regexes(spark):
    got = {r.doc_id: r for r in llm.queries()["op5_secret_scan"](spark, "/root/testdata/sf0.01").collect()}
    n = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        want = base_spans(r.text)
        n += len(want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (got[r.doc_id].n_assign, got[r.doc_id].n_access, got[r.doc_id].n_hex) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))
    assert n


@pytest.mark.parametrize("text", ["é TOKEN = 'abcdef12' İ Secret:xyz", "password=pass password=token=abcdefg", "apikey:  \"q/w+e=r\" api_key = short", "AKIA" * 6 + "x", "a" * 24 + "g" + "f" * 23, "passwordpassword=abcdefgh", "ſecret=abcdef Key"])
def test_secret_spans_equal_plain(text):
    assert [s for s in secret_scan.spans(text) if s[0] in secret_scan.KINDS[:3]] == base_spans(text)


def test_secret_checksums():
    body = "Ab3" * 10
    good = "ghp_" + body + secret_scan.base62(zlib.crc32(body.encode()))
    assert ("github", 2, 42) in secret_scan.spans("x " + good) and not secret_scan.spans(good[:-1] + ("a" if good[-1] != "a" else "b"))
    assert secret_scan.spans("eyJhbGciOiJIUzI1NiJ9.e30.sig")[0][0] == "jwt" and not secret_scan.spans("eyJub25l.e30.sig")


def test_hostile_texts_are_scanned_in_linear_time():
    import base64
    import time

    deep = base64.urlsafe_b64encode(b'{"a":' + b"[" * 100_000).decode().rstrip("=")
    assert deep.startswith("eyJ") and secret_scan.spans(f"{deep}.e30.sig") == []
    begun = time.process_time()
    assert secret_scan.spans("eyJ" * 200_000) == [] and secret_scan.spans("eyJ" * 100_000 + ".") == []
    good = "eyJhbGciOiJIUzI1NiJ9.e30.sig"
    assert [s[0] for s in secret_scan.spans("eyJ" * 50_000 + " " + good)] == ["jwt"]
    assert time.process_time() - begun < 3


def test_secrets_odd_rows(spark, odd):
    rows = secret_scan.digest(odd).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == odd.count() and {r.base_sha256 for r in rows} == {empty} and sum(r.doc_id is None for r in rows) == 1
    assert secret_scan.digest(odd.limit(0)).count() == 0
    assert [tuple(r) for r in secret_scan.scan(spark.createDataFrame([(1, "é token=abcdef")], "doc_id long, text string")).collect()] == [(1, "assign", 2, 14, "token=abcdef")]


# --- 6 fixity ---


def test_fixity_locates_damage(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "page " * (i % 7)) for i in range(5000)] + [(None, None, None)], "page_id long, url string, html string")
    rows = warc_fixity.archive(pages.withColumn("bad", F.when(F.coalesce(F.col("page_id") != 77, F.lit(True)), F.when(F.col("page_id") == 4500, "x").otherwise(F.sha2(warc_fixity.record(F.col("page_id"), F.col("url"), F.col("html")), 256)))))
    rows = rows.cache()
    a, b = warc_fixity.tree(warc_fixity.leaves(rows)), warc_fixity.tree(warc_fixity.leaves(rows, "bad"))
    assert len(a) == 4 and a[-1].count() == 1
    found = {(r.page_id, r.state) for r in rows.join(warc_fixity.audit(a, b), "idx").collect()}
    assert found == {(77, "lost_b"), (4500, "changed")} and warc_fixity.audit(a, a).count() == 0
    assert warc_fixity.audit(*[warc_fixity.tree(warc_fixity.leaves(rows.limit(0)))] * 2).count() == 0


# --- 7 near copies ---


def sets_of(text, n):
    w = re.findall(WORD, (text or "").encode().lower().decode())
    return ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}) if w else set()


def plain_near(docs, n):
    s = {d: sets_of(t, n) for d, t in docs}
    pairs = [(a, b) for a, b in itertools.combinations(s, 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    return groups(s, pairs), {d: len(x) for d, x in s.items()}


@pytest.mark.parametrize("n", [2, 5])
def test_near_copies_against_brute_force(spark, documents, n):
    want, sizes = plain_near([(r.doc_id, r.text) for r in documents.collect()], n)
    got = near_dup.near_duplicates(documents, n).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_chain_without_a_common_hub(spark):
    rng = np.random.RandomState(5)
    words = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(40):  # each a small step from the one before, the ends far apart
        words[(i * 7) % 100] = f"x{rng.randint(10**6)}"
        docs.append((int((i * 17) % 40), " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()}
    assert got == plain_near(docs, 2)[0]


def test_near_copies_odd_rows(spark, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(odd, 2).collect()}
    assert got[1] == (9, 1) and got[9] == (9, 1) and got[2] == (10, 1) and got[3] == (0, 3) and got[5] == (0, 5) and got[6] == (1, 6) and None not in got and len(got) == 10
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_odd_sketch_estimates():
    rng = np.random.RandomState(2)
    base = rng.randint(0, 2**62, 2000).astype(np.uint64)
    for share in (0.0, 0.1, 0.2):
        other = base.copy()
        k = int(share / (2 - share) * 2000 * 2 / 2) if share else 0
        other[:k] = rng.randint(0, 2**62, k)
        sk = near_dup.odd_sketch(near_dup.samples([np.unique(base), np.unique(other)], near_dup.SAMPLES))
        apart = np.unpackbits((sk[0] ^ sk[1]).view(np.uint8)).sum()
        assert apart <= near_dup.allowed(1 - share)


# --- 8 mixing ---


def test_mix_meets_targets(spark):
    rows = llm.queries()["op8_source_mix"](spark, "/root/testdata/sf0.01").toPandas()
    again = llm.queries()["op8_source_mix"](spark, "/root/testdata/sf0.01").toPandas()
    key = ["doc_id", "taken"]
    assert rows.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert (rows.taken <= 3 * rows["size"]).all() and (rows.taken % rows["size"].clip(lower=1) == 0).all()
    by = rows.merge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), own=("size", "sum"))
    assert (by["size"] == by.own).all() and ((by.taken - by.target).abs() / by.target < 0.01).all() and abs(by.target.sum() - by.own.sum()) < 1e-6 * by.own.sum()


def test_mix_targets_are_capped(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["b"] == 30 and abs(sum(got.values()) - 1600) < 1e-9 and got[None] == 270 and abs(got["c"] / got["a"] - 3) < 1e-9


def test_flight_keeps_totals():
    import random

    rng = np.random.RandomState(3)
    size = rng.randint(1, 500, 300).astype(float).tolist()
    p = mixing.flight([0.37] * 300, size, random.Random(1))
    assert sum(0 < x < 1 for x in p) <= 2 and abs(sum(p) - 111) < 1e-6 and abs(np.dot(p, size) - 0.37 * sum(size)) < 1e-4
    q = mixing.flight([0.37] * 300, size, random.Random(1), land=True)
    assert set(q) <= {0.0, 1.0} and abs(np.dot(q, size) - 0.37 * sum(size)) < 5 and abs(sum(q) - 111) <= 2


def test_mix_odd_rows(spark, odd):
    got = mixing.mix(odd.drop("size", "copies"), mixing.words(), ["n_chars"]).collect()
    assert len(got) == odd.count() and {r.size for r in got if r.n_chars in (3, 4, 5, 8)} == {0} and all(0 <= r.copies <= 3 for r in got)
    assert mixing.mix(odd.drop("size", "copies").limit(0), mixing.words(), ["n_chars"]).count() == 0


# --- 9 licences ---


def test_licence_sentences_know_themselves(spark):
    rows = [(k, s) for k, s in license_scan.SENTENCES.items()]
    got = {r.k: r for r in license_scan.scan(spark.createDataFrame(rows, "k string, text string"), "k").collect()}
    assert all(got[k].sentences == k for k, _ in rows), [(k, got[k].sentences) for k, _ in rows if got[k].sentences != k]
    assert all(any(m in s.lower() for m in license_scan.MARKS) for s in license_scan.SENTENCES.values())


def test_licence_rules(spark):
    s = license_scan.SENTENCES
    mit = "Some code.\n\n" + "\n".join([s["mit_title"], "Copyright (c) 2024 X", s["mit_grant"].replace(" of ", "\n of ", 3), "", s["mit_keep"], s["mit_asis"] + " " + s["mit_liable"]]) + "\nint main()"
    bsd = " ".join(s[k] for k in ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_asis")).replace("met: ", "met:\n")
    rows = [(1, mit), (2, bsd), (3, s["bsd_source"]), (4, "junk line\n" + s["apache_short"] + "\n" + s["ccbync"]), (5, None), (6, "")]
    got = {r.doc_id: (r.licenses, r.others) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: ("BSD-3-Clause", ""), 3: ("", "bsd_source"), 4: ("Apache-2.0,CC-BY-NC-4.0", ""), 5: ("", ""), 6: ("", "")}


def test_licences_canonical_texts(spark):
    """Wrapped as published: numbered clauses, and a sentence without a full stop between two others."""
    grant = "Copyright (c) 2024, X\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    clauses = [
        "Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    ]
    asis = "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DAMAGE.\n"
    bsd = lambda n, mark, gap: grant + "".join(mark(k) + c + gap for k, c in enumerate(clauses[:n])) + asis
    apache = 'Copyright 2024 X\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n'
    commented = "".join(f" * {x}\n" for x in apache.split("\n"))
    rows = [(1, bsd(2, lambda k: f"{k + 1}. ", "\n\n")), (2, bsd(3, lambda k: f"{k + 1}. ", "\n")), (3, bsd(3, lambda k: f"  ({'abc'[k]}) ", "\n")), (4, bsd(2, lambda k: f"{k + 1}) ", "\n")), (5, bsd(3, lambda k: "* ", "\n")), (6, apache), (7, commented)]
    got = {r.doc_id: (r.licenses, r.sentences, r.others) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    two, three = "bsd_grant,bsd_source,bsd_binary,bsd_asis", "bsd_grant,bsd_source,bsd_binary,bsd_names,bsd_asis"
    whole = ("Apache-2.0", "apache_notice,apache_copy,apache_asis,apache_see")
    assert {k: v[:2] for k, v in got.items()} == {1: ("BSD-2-Clause", two), 2: ("BSD-3-Clause", three), 3: ("BSD-3-Clause", three), 4: ("BSD-2-Clause", two), 5: ("BSD-3-Clause", three), 6: whole, 7: whole}


def test_licences_odd_rows(spark, odd):
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(odd.limit(0)).count() == 0


# --- 10 vectors ---


def plain_vectors(rows):
    ok = {i: (np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    pairs = [(a, b) for a, b in itertools.combinations(ok, 2) if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= 0.93]
    ids = {r[0] for r in rows if r[0] is not None}
    n = Counter(i for p in pairs for i in p)
    return {i: (n[i], c) for i, c in groups(ids, pairs).items()}


def test_vectors_against_brute_force(spark):
    rng = np.random.RandomState(6)
    centers = rng.randn(12, 32)
    rows = [(int(i), (centers[i % 12] + rng.randn(32) * 0.18).tolist(), int(i % 3)) for i in range(400)] + [(400 + k, centers[0].tolist(), 0) for k in range(60)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [1.0] * 32, None), (904, [None] * 32, 1), (905, [1.0] * 16, 1), (None, [1.0] * 32, 1)]
    df = vectors(spark, rows)
    want = plain_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(df).collect()}
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want) and all(got[i][0] <= want[i][0] for i in want)
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_with_repeated_ids(spark):
    at = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0, 0.0]
    got = lambda rows: {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(vectors(spark, rows)).collect()}
    assert got([(1, at(0), 0), (1, at(0.05), 0), (1, at(0.05), 0), (2, at(0.1), 0), (3, at(0), 0)]) == {1: (2, 1), 2: (2, 1), 3: (2, 1)}
    assert got([(1, at(0.5), 0), (1, at(0), 1), (2, at(0), 0), (3, at(0), 1)]) == {1: (0, 1), 2: (0, 2), 3: (0, 3)}


def test_vectors_recall_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    e = rows.toPandas().sort_values("vec_id")
    x = np.stack(e.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = e.label.to_numpy()
    close = (x @ x.T >= 0.93) & (lab[:, None] == lab[None]) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(rows).collect()}
    found = sum(got.values())
    assert found <= close.sum() and found >= 0.99 * close.sum() and all(got[i] <= n for i, n in zip(e.vec_id, close.sum(1), strict=True))


def test_rotation_is_orthogonal():
    x = np.random.RandomState(0).randn(50, 64)
    y = vector_dedup.rotated(x, 3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(u @ u.T, y @ y.T)


# --- whole queries against their SQL ---


@pytest.mark.parametrize("name", ["op6_warc_fixity", "op9_license_scan"])
def test_queries_against_sql(spark, name, table_of):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got = llm.queries()[name](spark, "/root/testdata/sf0.01")
    want = con.sql(llm.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert table_of(got.select(cols)) == sorted(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM want").fetchall(), key=str)
