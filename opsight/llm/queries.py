"""Registered queries of the subpackage and their SQL counterparts, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_pipeline import run as pipeline
from opsight.llm import (
    chat,
    collocations,
    context_mixing,
    fertility,
    jaccard_join,
    langid,
    latent_leaks,
    packing,
    prefix_counts,
    sentence_spans,
    surrogates,
    url_rules,
    whitening,
)
from opsight.llm.common import id_bucket, ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_association_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op2_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    made = surrogates.replace_all(table(spark, folder, "documents").select("doc_id", "text"))
    return made.withColumnRenamed("__entities", "n_entities")


def op5_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_spans.deduplicated(table(spark, folder, "documents"))


def op4_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, folder, "conversations"))


def op3_word_backoff(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = id_bucket("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op6_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    held_out = id_bucket("doc_id", 10) == 0
    found = context_mixing.scores(table(spark, folder, "documents"), ~held_out)
    return found.withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op7_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.judged(fertility.features(table(spark, folder, "documents")))


def op8_rare_first(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.linked(table(spark, folder, "documents"), size=4, percent=85).drop("key", "root")


def op9_latent_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return latent_leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("key")


def op10_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_prefix_counts(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_counts.answers(prefix_counts.prefix_index(table(spark, folder, "documents")))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


LLM_QUERIES: dict[str, Query] = {
    "op1_association_rules": op1_association_rules,
    "op4_snapshots": op4_snapshots,
    "op2_surrogates": op2_surrogates,
    "op5_sentence_spans": op5_sentence_spans,
    "op3_word_backoff": op3_word_backoff,
    "op6_context_mixing": op6_context_mixing,
    "op7_fertility": op7_fertility,
    "op8_rare_first": op8_rare_first,
    "op9_latent_leaks": op9_latent_leaks,
    "op10_best_fit": op10_best_fit,
    "op11_collocations": op11_collocations,
    "op12_prefix_counts": op12_prefix_counts,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}
LLM_ORACLES: dict[str, str] = {
    "op1_association_rules": url_rules.oracle(),
    "op4_snapshots": chat.ORACLE,
    "op8_rare_first": jaccard_join.oracle(4, 85),
    "op11_collocations": collocations.oracle(),
}
