"""The registered queries of this subpackage: each operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import alike, codes, leaks, licences, near, neighbours, packing, pages, pii, quality, resample, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; Python workers are told where this package is, should they not find it by themselves."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_pii_anchors(spark, sf_dir):
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op3_page_text(spark, sf_dir):
    return pages.extract_text(table(spark, sf_dir, "pages"))


def op4_posting_lists(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_licence_scan(spark, sf_dir):
    return licences.licence_digest(table(spark, sf_dir, "documents"))


def op6_quality_gam(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def op7_url_templates(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op8_partenum_join(spark, sf_dir):
    return near.near_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_winnowing(spark, sf_dir):
    return leaks.leak_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity_network(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_value_dictionaries(spark, sf_dir):
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark, sf_dir):
    return resample.resample_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_small_world_dedup(spark, sf_dir):
    return alike.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    found = (op1_best_fit_packing, op2_pii_anchors, op3_page_text, op4_posting_lists, op5_licence_scan, op6_quality_gam, op7_url_templates, op8_partenum_join, op9_winnowing, op10_toxicity_network, op11_value_dictionaries, op12_importance_resampling, op13_small_world_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_licence_scan": licences.digest_sql(), "op11_value_dictionaries": codes.codes_sql(), "op12_importance_resampling": resample.resample_sql()}
