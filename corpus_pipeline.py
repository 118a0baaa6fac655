"""A training corpus from documents: classify, remove repeated lines, remove near copies, mix sources, pack sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
documents. Near copies here are by shingles of five words at a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import line_dedup, mixing, near_dup, packing, quality
from framelake.llm.common import table, written

STAGES = [
    ("quality classifier", quality.stage),
    ("line dedup", line_dedup.stage),
    ("MinHash near-dedup", near_dup.stage),
    ("mixing sources to target weights", mixing.stage),
    ("packing", packing.stage),
]
#: Classifier, cube method and dynamic programming are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
