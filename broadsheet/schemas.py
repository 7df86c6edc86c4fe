"""Table schemas and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


STRING, LONG, BOOL = T.StringType(), T.LongType(), T.BooleanType()
NTZ, STRINGS, VECTOR = T.TimestampNTZType(), T.ArrayType(T.StringType()), T.ArrayType(T.FloatType())

RAW_ARTICLE = _struct(
    uid=STRING, datetime=NTZ, source=STRING, sender=STRING, title=STRING, url=STRING,
    body=STRING, platform=STRING, raw_source=STRING, image_url=STRING,
)

ARTICLES = _struct(
    uid=STRING, datetime=NTZ, source=STRING, sender=STRING, title=STRING, url=STRING,
    summary=STRING, original_language_summary=STRING, detected_language=STRING,
    truncated=BOOL, content_type=STRING, topics=STRINGS, themes=STRINGS, keywords=STRINGS,
    subscription_marketing=BOOL, english_embedding=VECTOR, multilingual_embedding=VECTOR,
    raw_email=STRING, flag_status=STRING, ingested_at=NTZ,
)

ENTITIES = _struct(uid=STRING, entity_type=STRING, raw_name=STRING, canonical_name=STRING)

ENTITY_LEXICON = _struct(
    raw_name=STRING, canonical_name=STRING, entity_type=STRING, created_at=NTZ
)

SEARCH_HISTORY = _struct(
    id=LONG, username=STRING, search_text=STRING, space=STRING, searched_at=NTZ
)

SAVED_SEARCHES = _struct(
    id=LONG, username=STRING, search_text=STRING, space=STRING, threshold=T.DoubleType(),
    latest_id=STRING, created_at=NTZ, query_vector=T.ArrayType(T.DoubleType()),
)

NOTIFICATIONS = _struct(
    id=LONG, username=STRING, search_text=STRING, new_results_count=LONG,
    newest_title=STRING, created_at=NTZ, is_read=BOOL,
)

SOURCES = _struct(
    source_id=STRING, source_name=STRING, platform=STRING, ingest_url=STRING,
    primary_language=STRING, languages_spoken=STRING, geographic_focus=STRING,
    publisher_type=STRING, input_by=STRING, date_added=T.DateType(), gating_passed=BOOL,
    activity_passed=BOOL, telegram_passed=BOOL, is_verified=BOOL, is_deleted=BOOL,
)

RAW_PAYLOAD = _struct(path=STRING, platform=STRING, source_name=STRING, content=STRING)

ANALYSIS = _struct(
    detected_language=STRING, summary_en=STRING, summary_orig=STRING,
    publisher_metadata=_struct(author=STRING, publisher=STRING, platform=STRING, date=STRING),
    entities=T.ArrayType(_struct(raw_name=STRING, entity_type=STRING)),
    topics=STRINGS, themes=STRINGS, keywords=STRINGS,
    contains_text=BOOL, subscription_marketing=BOOL,
)

JUDGEMENT = _struct(
    semantic_accuracy=T.IntegerType(), tone_alignment=T.IntegerType(),
    nuance_retention=T.IntegerType(), idiomatic_mapping=T.IntegerType(), justification=STRING,
)


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order; those an older table lacks become typed nulls."""
    present = set(df.columns)
    return df.select(
        *[
            F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
        *[c for c in df.columns if c not in set(schema.names)],
    )
