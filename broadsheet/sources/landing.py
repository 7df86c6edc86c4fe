"""Readers for folders of landed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from broadsheet.schemas import RAW_PAYLOAD

_DECLARED = r"(?i)(?:encoding|charset)\s*=\s*[\"']?([A-Za-z0-9_-]+)"
_LATIN = ("iso-8859-1", "iso8859-1", "latin1", "latin-1", "windows-1252", "cp1252")


def read_payload_files(spark: SparkSession, path: str, platform: str, source_name: str) -> DataFrame:
    """One row per file: mails as bytes, as each part names its own charset; all else as text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.lit(platform).alias("platform"), F.lit(source_name).alias("source_name"),
        (F.col("content") if platform == "email" else decoded(F.col("content"))).alias("content"),
    )


def decoded(content: Column) -> Column:
    """Text of XML or HTML bytes by the charset they declare near their start, UTF-8 unless that is Latin.

    Bytes that aren't valid in UTF-8 become replacement characters.
    """
    start = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    charset = F.lower(F.regexp_extract(start, _DECLARED, 1))
    return F.when(charset.isin(*_LATIN), F.decode(content, "ISO-8859-1")).otherwise(F.make_valid_utf8(content.cast("string")))


def read_payload_table(spark: SparkSession, path: str) -> DataFrame:
    """Payloads landed as Parquet, the form to use for very many small documents."""
    return spark.read.schema(RAW_PAYLOAD).parquet(path)


def file_uid(path: Column) -> Column:
    """File name without folders and extension, the id of a landed mail."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
