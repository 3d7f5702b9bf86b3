"""Corpus pipeline over ``documents``: quality rules, near duplicates, personal data, packing.

Each stage is a function of (spark, docs, sf_dir).  Its result is written as
Parquet and read again as the next one's input; all but the last return the columns
of their input.  Every stage reads all that the one before has kept:

* ``quality rules``: documents that the base rules or the isolation forest
  reject go (thresholds from the table ``labels``).
* ``n-gram Jaccard join``: of documents linked by five-word shingles at 0.8 or
  more, directly or through others, the one of the smallest doc_id stays.
  Rows that share a doc_id are one document (a repeated row goes); rows without
  a doc_id cannot be named by others and stay.
* ``PII``: personal data is replaced by surrogates.
* ``best-fit packing``: what is left as token pieces in sequences of 2048.

Nulls, empty texts, empty tables and further columns: as the operators say.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm import isolation, ngram_join, packing, surrogates
from innsight.llm.common import read, ship, stage
from innsight.llm.queries import KEY, SEQUENCE
from innsight.session import staging_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return isolation.kept_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    groups = ngram_join.jaccard_components(docs, words=5, percent=80)
    first = stage(groups.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct(), "first-of-group")
    kept = docs.join(first, docs["doc_id"] == first["__id"], "left_semi")
    # repeated rows have met on their doc_id
    kept = kept.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return kept.unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(docs, KEY).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=SEQUENCE)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: The forest, the surrogates and the tokenizer are beyond SQL: tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    base = f"{staging_dir(spark)}/llm-pipeline-{uuid.uuid4().hex}"
    for i, (name, step) in enumerate(STAGES):
        path = f"{base}/{i}-{name.replace(' ', '-')}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
