"""From raw documents to packed training sequences: toxic texts go, one text of each group of near copies stays, benchmark
leaks go, personal data is masked, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import leaks, near, packing, pii, toxicity
from tracelake.llm.common import discard, stored
from tracelake.llm.queries import table, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The network learns from all documents that have labels, then rejects among docs."""
    net = toxicity.train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, net)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a similarity of 0.8 or more."""
    return near.drop_near(docs, words=5, percent=80)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_pii(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("benchmark_decontamination", leak_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left.  Rows with nulls go through (a null text is no text; a null id is kept), repeated rows
    are copies of which one stays, no documents give no rows, and extra columns are carried along until packing."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir))
        discard(docs)  # a stage's table, once the next one stands
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the network nor the tokeniser can be written in SQL.
ORACLE_SQL = None
