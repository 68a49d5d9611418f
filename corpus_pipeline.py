"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of documents.

* ``language``: drops documents without letters and those predicted with a probability under 0.5;
  held-out rows are never trained on.
* ``near_duplicates``: texts whose sets of five-word shingles have a similarity of 0.8 or more; of each group the longest text,
  then the smallest doc_id stays (of wholly repeated rows one).
* ``decontaminate``: drops documents that hold a benchmark item, its numbers, names and units
  changed or not.
* ``mix``: repeats or leaves out documents so that sources come near their target weights; a
  document taken twice is two rows.
* ``tokens``: bit-plane segments; one row per document read back from them.

Null ids, texts, languages and sources, empty texts and empty tables follow the operators' rules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard, langid, mixing, template_decontam, token_planes
from graphloom.llm.common import shared_dir

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    predict = langid.predictor(docs, langid.fit(docs))
    found = docs.select(F.struct(*docs.columns).alias("row"), predict(F.col("text")).alias("found"))
    return found.where((F.col("found.lang") != "und") & (F.col("found.score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return template_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.planned(docs, F.array("source"), mixing.by_turns)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_planes.read_documents(token_planes.write_segments(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Training, fingerprints and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
