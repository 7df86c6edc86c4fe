"""The queries of these operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from broadsheet.llm import (
    bpe, discriminant, fill_middle, languages, leaks, licenses, main_text, near_copies, pieces, quality_rules, suffixes, toxicity, variants
)

TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int, key: str = "doc_id") -> Column:
    """Which of ``parts`` parts a row belongs to, by the checksum of its id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.classes(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op4_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = discriminant.scored(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return rows.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= discriminant.THRESHOLD).cast("int").alias("predicted"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = main_text.extracted(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = languages.predicted(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold(4) != 2)
    return rows.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_id", F.col("item_id").cast("long"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.scored(spark, docs, table(spark, sf_dir, "labels"), fold(3) != 1)
    return rows.select(
        "doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_near_copies": (op1_near_copies, None),
    "op2_licenses": (op2_licenses, licenses.oracle_sql()),
    "op3_quality_rules": (op3_quality_rules, quality_rules.oracle_sql()),
    "op4_discriminant": (op4_discriminant, None),
    "op5_main_text": (op5_main_text, None),
    "op6_languages": (op6_languages, None),
    "op7_leaks": (op7_leaks, None),
    "op8_bpe": (op8_bpe, None),
    "op9_suffixes": (op9_suffixes, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_pieces": (op11_pieces, None),
    "op12_fill_middle": (op12_fill_middle, fill_middle.oracle_sql()),
    "op13_variants": (op13_variants, None),
}
