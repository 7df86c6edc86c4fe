"""From raw documents to tokens: five stages, each written as Parquet and read again by the next.

1. toxicity: documents the classifier rejects go;
2. near_copies: of each class of near copies the document with the smallest id stays;
3. suffixes: strings of 100 bytes that also start earlier are cut out of the texts;
4. leaks: documents that hold a benchmark item go;
5. bpe: the token ids of what is left, and the number of tokens.

Every stage works on all rows the one before kept, and all but the last return the columns of documents.
Null and empty texts pass through all stages; rows without an id are never copies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.llm import bpe, leaks, near_copies, suffixes, toxicity
from broadsheet.llm.queries import table, tokenizer_path
from broadsheet.session import shared_folder, ship_package


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    scored = toxicity.scored(spark, docs, table(spark, sf_dir, "labels"), to="_toxic")
    return scored.filter(F.col("_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_copies.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    cut = suffixes.deduplicated(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    encoded = bpe.encode(docs, tokenizer_path())
    return encoded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("suffixes", without_repeats),
    ("leaks", without_leaks),
    ("bpe", tokens),
]

# Learned scores, alignments and merges can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
