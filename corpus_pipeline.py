"""Corpus pipeline: documents pass quality rules, line dedup, near-duplicate removal, mixing and tokenization, in this order.

Each stage takes all that its predecessor kept, written as Parquet in the shared folder and read back. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortwave.llm import line_dedup, mixing, near_duplicates, quality_rules, sentencepiece
from cohortwave.llm.common import cut, read

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", near_duplicates.stage),
    ("source_mix", mixing.stage),
    ("sentencepiece", sentencepiece.stage),
]

#: A fitted chain, automata of merges and balanced sampling are beyond SQL; tests of the operators stand for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
