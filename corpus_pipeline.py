"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, folder) and works on everything its predecessor kept; `run` writes each result to the
shared folder and reads it back. All stages but the last return the columns of their input. Null or empty texts leave
with the first stage; rows that repeat id and text count as copies and leave with the second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.llm import jaccard_join, langid, latent_leaks, packing, surrogates
from opsight.llm.common import kept, membership, null_safe_join, released, ship, split_by, stored, text_key

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id and text are not in `gone` (doc_id, key); only rows that may be in it are shuffled."""
    row = F.xxhash64("__id", "__key")
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": text_key("text")}).withColumn("__row", row)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    maybe, others = split_by(keyed, membership(gone.withColumn("__row", row), "__row"), "__row")
    maybe = null_safe_join(maybe, gone, ["__id", "__key"], "left_anti")
    return others.unionByName(maybe).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with an identified language stay."""
    ship(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of similar ones stays: the smallest by id, then by digest of the text."""
    ship(spark)
    with released(spark):
        groups = kept(jaccard_join.linked(docs, size=5, percent=80).select("doc_id", "key", "root"), "groups")
    here = F.struct("doc_id", "key")
    first = groups.where("root IS NOT NULL").groupBy("root").agg(F.min(here).alias("kept"))
    gone = stored(groups.join(first, "root").where(here != F.col("kept")).select("doc_id", "key"), "gone")
    rest = _without(docs, gone)
    if groups.groupBy("doc_id", "key").count().where("count > 1").limit(1).count():
        rest = rest.withColumn("__key", text_key("text")).dropDuplicates(["doc_id", "__key"]).drop("__key")
    return rest


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    ship(spark)
    with released(spark):
        found = latent_leaks.leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
        gone = kept(found.select("doc_id", "key"), "leaks")
    return _without(docs, gone)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data is replaced by surrogates; `n_chars` follows."""
    ship(spark)
    return surrogates.replace_all(docs).select(*docs.columns)


def packing_plan(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing_plan),
]

# model fitting, keyed permutations and tokenisation are beyond SQL; tests compare stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name)
    return docs
