"""Enrichment: model calls as pluggable Arrow-batched stages, and the rules around them.

A model is any picklable callable over a list of texts. Its stages cost money
and time, so every function that runs one materialises the result before
anything downstream can evaluate it twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from broadsheet.functions import textclean
from broadsheet.functions.repetition import is_degenerate
from broadsheet.schemas import ANALYSIS, JUDGEMENT
from broadsheet.session import cut_lineage

Infer = Callable[[list[str]], list[str | None]]
Embed = Callable[[list[str]], list[list[float] | None]]

# Fixed values.
ATTEMPTS = 3
LOW_RESOURCE = ("xh", "zu", "tn", "rw", "st", "ss", "wo")
NO_TEXT = "*(Media post containing no readable text)*"
IMAGE_NOTE = "\n\n*(Note: This content was extracted via multimodal LLM analysis from a shared image.)*"
REPEATS, BAD_JSON, EMPTY = "recurring characters detected", "malformed JSON/truncated", "empty response"
SCORES = ("semantic_accuracy", "tone_alignment", "nuance_retention", "idiomatic_mapping")

_REJECTS = T.ArrayType(T.StructType([
    T.StructField("attempt", T.IntegerType()), T.StructField("reason", T.StringType()),
    T.StructField("response", T.StringType()),
]))


def _reason(response: str | None, json_mode: bool) -> str | None:
    if not response:
        return EMPTY
    if is_degenerate(response):
        return REPEATS
    if json_mode:
        try:
            json.loads(response)
        except ValueError:
            return BAD_JSON
    return None


def _asked(model: Callable, values: list) -> list[tuple[object, str | None]]:
    """Answer and error for each value. A call that fails or answers too few or too
    many is repeated in halves, so only the values that fail alone are lost."""
    if not values:
        return []
    try:
        answers = list(model(values))
        if len(answers) != len(values):
            raise ValueError(f"{len(answers)} answers to {len(values)} inputs")
        return [(answer, None) for answer in answers]
    except Exception as error:  # a failing provider must not fail the job
        if len(values) == 1:
            return [(None, f"error: {error}")]
        half = len(values) // 2
        return _asked(model, values[:half]) + _asked(model, values[half:])


def infer(rows: DataFrame, prompt: str, model: Infer, json_mode: bool = True,
          attempts: int = ATTEMPTS) -> DataFrame:
    """Adds response, attempts and rejects; response is NULL after the last failure."""
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("response", T.StringType()),
         T.StructField("attempts", T.IntegerType()),
         T.StructField("rejects", _REJECTS)]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = batch[prompt].fillna("").tolist()
            accepted: list[str | None] = [None] * len(prompts)
            used = [0] * len(prompts)
            rejects: list[list[dict]] = [[] for _ in prompts]
            waiting = list(range(len(prompts)))
            for attempt in range(1, attempts + 1):
                if not waiting:
                    break
                retry = []
                for i, (answer, error) in zip(waiting, _asked(model, [prompts[i] for i in waiting]), strict=True):
                    used[i] = attempt
                    reason = error or _reason(answer, json_mode)
                    if reason is None:
                        accepted[i] = answer
                    else:
                        rejects[i].append({"attempt": attempt, "reason": reason, "response": answer})
                        retry.append(i)
                waiting = retry
            yield batch.assign(response=accepted, attempts=used, rejects=rejects)

    return cut_lineage(rows.mapInPandas(run, schema))


def answered(inferred: DataFrame) -> DataFrame:
    return inferred.filter("response is not null")


def dead_letters(inferred: DataFrame) -> DataFrame:
    """Rows that stayed without a usable response."""
    return inferred.filter("response is null")


def audit_rows(inferred: DataFrame, provider: str, model: str, prompt: str, at: Column) -> DataFrame:
    """One row per model call, accepted or rejected, for the audit log."""
    base = inferred.select(F.col(prompt).alias("prompt"), "response", "attempts", "rejects")
    rejected = base.select("prompt", F.explode("rejects").alias("r")).select(
        "prompt", F.col("r.response").alias("response"), F.col("r.attempt").alias("attempt"),
        F.col("r.reason").alias("rejected_reason"),
    )
    kept = base.filter("response is not null").select(
        "prompt", "response", F.col("attempts").alias("attempt"), F.lit(None).cast("string").alias("rejected_reason")
    )
    return kept.unionByName(rejected).select(
        at.cast("timestamp_ntz").alias("at"), at.cast("date").alias("day"), F.lit(provider).alias("provider"),
        F.lit(model).alias("model"), "prompt", "response", "attempt", "rejected_reason",
    )


def parsed(responses: DataFrame, response: str = "response") -> DataFrame:
    """Adds clean_response, analysis and is_valid (False: not JSON at all)."""
    clean = textclean.strip_fence(F.col(response))
    rows = responses.withColumn("clean_response", clean)
    return rows.withColumns({
        "analysis": F.from_json("clean_response", ANALYSIS),
        "is_valid": F.try_parse_json("clean_response").isNotNull(),
    })


def normalised(rows: DataFrame) -> DataFrame:
    """Defaults of an analysis: language, summaries and entities of text-less media."""
    a = F.col("analysis")
    no_text = F.coalesce(~a["contains_text"], F.lit(False))
    english = F.when(no_text, F.lit(NO_TEXT)).otherwise(a["summary_en"])
    language = F.when(no_text, F.lit("en")).otherwise(F.coalesce(a["detected_language"], F.lit("en")))
    original = F.when(no_text, F.lit(NO_TEXT)).otherwise(F.coalesce(a["summary_orig"], a["summary_en"]))
    return rows.withColumns({
        "language": language,
        "summary_en": english,
        "summary_orig": F.when(language == "en", english).otherwise(original),
        "entities_json": F.when(no_text, F.lit("[]")).otherwise(F.get_json_object("clean_response", "$.entities")),
        "topics": a["topics"], "themes": a["themes"], "keywords": a["keywords"],
        "subscription_marketing": a["subscription_marketing"],
    })


def translation_tier(language: Column) -> Column:
    """'low_resource', 'other' or 'none' (English needs no translation)."""
    return (
        F.when(language.isin(*LOW_RESOURCE), "low_resource")
        .when(language != "en", "other")
        .otherwise("none")
    )


def with_image_note(rows: DataFrame, image_url: str = "image_url") -> DataFrame:
    """Footnote on summaries read from an image that had text."""
    has_image = F.coalesce(F.col(image_url), F.lit("")) != ""
    textful = has_image & F.coalesce(F.col("analysis.contains_text"), F.lit(True))
    noted_en = F.concat("summary_en", F.lit(IMAGE_NOTE))
    noted_orig = F.when(F.col("summary_orig") != noted_en, F.concat("summary_orig", F.lit(IMAGE_NOTE)))
    return rows.withColumns({
        "summary_en": F.when(textful, noted_en).otherwise(F.col("summary_en")),
        "summary_orig": F.when(textful, F.coalesce(noted_orig, F.col("summary_orig"))).otherwise(F.col("summary_orig")),
    })


def needs_second_try(text: Column, first: Column) -> Column:
    return F.coalesce(F.trim(first) == "", F.lit(True)) | (first == text)


def translated(text: Column, language: Column, first: Column, second: Column) -> Column:
    """First translation, else second, else the original under a warning."""
    warning = F.concat(
        F.lit("[Translation Failed - Original Language: "), language, F.lit("]\n\n"), text
    )
    backup = F.when(F.coalesce(F.trim(second) == "", F.lit(True)), warning).otherwise(second)
    return F.when(needs_second_try(text, first), backup).otherwise(first)


def translate(rows: DataFrame, first: Infer, second: Infer) -> DataFrame:
    """Adds ``translation``; the second model only sees rows the first one failed."""
    tried = infer(rows, "text", first, json_mode=False).withColumnRenamed("response", "first")
    tried = tried.drop("attempts", "rejects")
    failed = needs_second_try(F.col("text"), F.col("first"))
    done = tried.filter(~failed).withColumn("second", F.lit(None).cast("string"))
    again = infer(tried.filter(failed), "text", second, json_mode=False)
    again = again.withColumnRenamed("response", "second").drop("attempts", "rejects")
    both = done.unionByName(again)
    value = translated(F.col("text"), F.col("language"), F.col("first"), F.col("second"))
    return both.withColumn("translation", value).drop("first", "second")


def _keyed(requests: DataFrame, model: str) -> DataFrame:
    key = textclean.translation_key(F.col("text"), F.col("language"), F.lit(model))
    return requests.withColumn("cache_key", key)


def _known(cache: DataFrame) -> DataFrame:
    return cache.groupBy("cache_key").agg(F.min("translation").alias("cached"))


def with_cache(requests: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Adds cache_key, cached translation and is_hit to (text, language) requests."""
    joined = _keyed(requests, model).join(_known(cache), "cache_key", "left")
    return joined.withColumn("is_hit", F.col("cached").isNotNull())


def cached_translations(requests: DataFrame, cache: DataFrame, model_name: str, model: Infer):
    """(requests with translation, new cache rows). Each distinct miss is computed once.

    Lookup and computation work on distinct texts, so a text that fills a third
    of the requests counts once; the requests themselves are joined only at the end.
    """
    keyed = _keyed(requests, model_name)
    distinct = keyed.select("cache_key", "text").dropDuplicates(["cache_key"])
    looked_up = cut_lineage(distinct.join(_known(cache), "cache_key", "left"))
    hits = looked_up.filter("cached is not null").select("cache_key", F.col("cached").alias("translation"))
    computed = infer(looked_up.filter("cached is null").select("cache_key", "text"), "text", model, json_mode=False)
    fresh = answered(computed).select("cache_key", F.col("response").alias("translation"))
    answers = hits.withColumn("is_hit", F.lit(True)).unionByName(fresh.withColumn("is_hit", F.lit(False)))
    filled = keyed.join(answers, "cache_key", "left")
    return filled.withColumn("is_hit", F.coalesce("is_hit", F.lit(False))), fresh


def embed(rows: DataFrame, texts: Sequence[str], vectors: Sequence[str], model: Embed) -> DataFrame:
    """Adds one vector column per text column; a blank text, or one the model fails on, has no vector."""
    kind = T.ArrayType(T.FloatType())
    schema = T.StructType([*rows.schema.fields, *[T.StructField(v, kind) for v in vectors]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            added = {}
            for text, vector in zip(texts, vectors):
                values = batch[text].fillna("").tolist()
                at = [i for i, v in enumerate(values) if v.strip()]
                column: list = [None] * len(values)
                for i, (found, _) in zip(at, _asked(model, [values[i] for i in at]), strict=True):
                    column[i] = found
                added[vector] = column
            yield batch.assign(**added)

    return cut_lineage(rows.mapInPandas(run, schema))


def embedding_texts(rows: DataFrame) -> DataFrame:
    """The two texts to embed: English summary, and original summary or else the English one."""
    is_blank = textclean.blank_to_null(F.col("summary_orig")).isNull()
    original = F.when(is_blank, F.col("summary_en")).otherwise(F.col("summary_orig"))
    return rows.withColumns({
        "text_en": textclean.embedding_text(F.col("summary_en"), F.col("topics"), F.col("themes")),
        "text_orig": textclean.embedding_text(original, F.col("topics"), F.col("themes")),
    })


def embedded(rows: DataFrame, model: Embed) -> DataFrame:
    """Rows with both vectors; a row that lacks one is left out."""
    both = embed(embedding_texts(rows), ["text_en", "text_orig"], ["english_embedding", "multilingual_embedding"], model)
    return both.filter("english_embedding is not null and multilingual_embedding is not null").drop("text_en", "text_orig")


def publisher_columns(rows: DataFrame) -> DataFrame:
    """author, source and content_type with their fallbacks to the raw article."""
    meta = F.col("analysis.publisher_metadata")

    def text(value: Column) -> Column:
        # A model may name several; a list arrives as its JSON text.
        return F.when(value.startswith("["), F.array_join(F.from_json(value, "array<string>"), ", ")).otherwise(value)

    return rows.withColumns({
        "author": F.coalesce(text(meta["author"]), F.lit("Unknown")),
        "content_type": F.coalesce(F.col("platform"), text(meta["platform"]), F.col("source")),
        "source": F.coalesce(text(meta["publisher"]), F.col("source")),
    })


def reembedded(articles: DataFrame, model: Embed) -> DataFrame:
    """Both vectors recomputed from stored summaries; a row keeps its old pair if either fails.

    New vectors are made in the pass over the table, so nothing is joined back.
    """
    old = articles.withColumns({"summary_en": F.col("summary"), "summary_orig": F.col("original_language_summary")})
    both = embed(embedding_texts(old), ["text_en", "text_orig"], ["new_en", "new_orig"], model)
    made = F.col("new_en").isNotNull() & F.col("new_orig").isNotNull()
    return both.withColumns({
        "english_embedding": F.when(made, F.col("new_en")).otherwise(F.col("english_embedding")),
        "multilingual_embedding": F.when(made, F.col("new_orig")).otherwise(F.col("multilingual_embedding")),
    }).select(articles.columns)


def judge_prompt(original: Column, english: Column) -> Column:
    return F.concat(
        F.lit("TEXT A (Original Language):\n"), original, F.lit("\n\nTEXT B (English Translation):\n"), english
    )


def judged(pairs: DataFrame, model: Infer) -> DataFrame:
    """Scores of translated pairs (uid, title, detected_language and both texts)."""
    prompts = pairs.filter("original_language_summary != '' and summary != ''").withColumn(
        "prompt", judge_prompt(F.col("original_language_summary"), F.col("summary"))
    )
    scored = answered(infer(prompts.drop("original_language_summary", "summary"), "prompt", model))
    verdict = F.from_json(textclean.strip_fence(F.col("response")), JUDGEMENT)
    return scored.withColumn("v", verdict).select(
        "uid", "title", F.col("detected_language").alias("lang"), *[F.col(f"v.{s}").alias(s) for s in SCORES],
        F.col("v.justification").alias("justification"),
    )


def judge_report(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    means = [F.round(F.avg(s), 2).alias(f"avg_{s}") for s in SCORES]
    return scores.groupBy(*by).agg(F.count("*").alias("n"), *means)


def compare_models(texts: DataFrame, prompt: str, models: dict[str, Infer]) -> DataFrame:
    """Every text through every model, with the seconds each answer took."""
    schema = T.StructType([
        *texts.schema.fields, T.StructField("model", T.StringType()),
        T.StructField("response", T.StringType()), T.StructField("seconds", T.DoubleType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, model in models.items():
                answers, seconds = [], []
                for text in batch[prompt].fillna(""):
                    start = time.perf_counter()
                    try:
                        answers.append(model([text])[0])
                    except Exception:  # recorded as a missing answer
                        answers.append(None)
                    seconds.append(time.perf_counter() - start)
                yield batch.assign(model=name, response=answers, seconds=seconds)

    return cut_lineage(texts.mapInPandas(run, schema))


def stage_times(measurements: DataFrame) -> DataFrame:
    """Mean seconds per model, provider and stage, with the total over stages."""
    per_stage = measurements.groupBy("provider", "model", "stage").agg(F.avg("seconds").alias("mean_seconds"))
    whole = per_stage.groupBy("provider", "model").agg(F.sum("mean_seconds").alias("mean_seconds"))
    return per_stage.unionByName(whole.withColumn("stage", F.lit("total")))
