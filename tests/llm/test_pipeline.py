import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's result, written and read again."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    top = tmp_path_factory.mktemp("stages")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], SF).write.parquet(f"{top}/{k}")
        out.append(spark.read.parquet(f"{top}/{k}"))
    return out


def test_stages_keep_the_columns(stages):
    assert all(x.dtypes == stages[0].dtypes for x in stages[1:-1])


def test_classifier_removes_bad_and_keeps_good(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = corpus_pipeline.STAGES[0][1](spark, docs, sf).select("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert labels.where("quality = 0").join(left, "doc_id").count() <= 1
    good = labels.where("quality = 1")
    assert good.join(left, "doc_id").count() >= 0.99 * good.join(docs, "doc_id").count()


def test_lines_are_removed(stages):
    from test_ops import plain_lines

    want = plain_lines(sorted((r.doc_id, r.text) for r in stages[1].collect()))
    assert {r.doc_id: r.text for r in stages[2].collect()} == want
    assert stages[2].where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_copies_go(stages):
    from test_ops import plain_near

    want, _ = plain_near([(r.doc_id, r.text) for r in stages[2].collect()], 5)
    assert {r.doc_id for r in stages[3].collect()} == {d for d, c in want.items() if d == c}


def test_mix_repeats_rows(stages):
    per = stages[4].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 <= per <= 3 and stages[4].join(stages[3], "doc_id", "left_anti").count() == 0


def test_pack_covers_all(stages):
    from framelake.llm import packing
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary())
    tokens = sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    assert stages[5].agg(F.sum("length")).first()[0] == tokens


def test_run_equals_the_stages(spark, stages):
    a, b = (sorted((r.doc_id, r.start, r.length) for r in x.collect()) for x in (corpus_pipeline.run(spark, SF), stages[5]))
    assert sum(x[2] for x in a) == sum(x[2] for x in b) and len({x[0] for x in a} ^ {x[0] for x in b}) == 0
