"""Entity extraction, lexicon lookup and resolution of names to canonical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import similarity, textclean
from broadsheet.operators.ranking import number_within, top_per_group
from broadsheet.session import cut_lineage, spread

# Fixed value: least similarity at which two names are the same entity.
THRESHOLD = 0.88
# The best match is looked for at or above this first, and below it for names that have none there only: the more names
# there are, the more of them have one, and far fewer pairs meet.
_CLOSE = 0.92
# Names that are decided together at first; each further lot is twice as large.
_FIRST_LOT = 20_000

_ELEMENT = "struct<raw_name:string,name:string,entity_type:string,type:string>"
_TABLE = "struct<raw_name:array<string>,entity_type:array<string>,name:array<string>,type:array<string>>"


def clean_name(raw: Column) -> Column:
    return textclean.squish_ends(raw)


def name_key(raw: Column) -> Column:
    return F.lower(clean_name(raw))


def entity_array(entities_json: Column) -> Column:
    """array<struct<raw_name, entity_type>> from the shapes a model returns.

    A list of objects, a list of plain names (type Unknown) or one object of
    two parallel lists; entries without name or type are dropped.
    """
    def named(item: Column) -> Column:
        found = item["parsed"]
        is_object = item["text"].startswith("{")
        name = F.coalesce(F.nullif(found["raw_name"], F.lit("")), found["name"])
        kind = F.coalesce(F.nullif(found["entity_type"], F.lit("")), found["type"])
        return F.struct(
            F.when(is_object, name).otherwise(item["text"]).alias("raw_name"),
            F.when(is_object, kind).otherwise(F.lit("Unknown")).alias("entity_type"),
        )

    def zipped(table: Column) -> Column:
        return F.zip_with(
            F.coalesce(table["raw_name"], table["name"]), F.coalesce(table["entity_type"], table["type"]),
            lambda n, k: F.struct(n.alias("raw_name"), k.alias("entity_type")),
        )

    # Each nested step binds a parsed value once instead of parsing it per use.
    items = F.transform(
        F.from_json(entities_json, "array<string>"),
        lambda text: F.struct(text.alias("text"), F.from_json(text, _ELEMENT).alias("parsed")),
    )
    tables = F.transform(F.array(F.from_json(entities_json, _TABLE)), zipped)
    is_table = F.ltrim(entities_json).startswith("{")
    chosen = F.when(is_table, F.get(tables, F.lit(0))).otherwise(F.transform(items, named))
    return F.filter(
        chosen,
        lambda e: (F.coalesce(e["raw_name"], F.lit("")) != "") & (F.coalesce(e["entity_type"], F.lit("")) != ""),
    )


def mentions(analysed: DataFrame, entities_json: Column, order: Column) -> DataFrame:
    """One row per mention with its position in processing order."""
    exploded = analysed.select("uid", order.alias("batch_order"), F.posexplode(entity_array(entities_json)).alias("pos", "e"))
    return exploded.select(
        "uid", F.struct("batch_order", "pos").alias("seq"), F.col("e.raw_name").alias("raw_name"),
        F.col("e.entity_type").alias("entity_type"),
    )


def lexicon_by_key(lexicon: DataFrame) -> DataFrame:
    """One canonical name per case-folded raw name: the first one written."""
    return lexicon.groupBy(F.lower("raw_name").alias("key")).agg(
        F.min_by("canonical_name", F.struct("created_at", "raw_name")).alias("canonical_name")
    )


def exact_lookup(names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds ``canonical_name`` where the lexicon knows the name, whatever its type."""
    keyed = names.withColumn("key", name_key(F.col("raw_name")))
    return keyed.join(lexicon_by_key(lexicon), "key", "left")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of ``left(type, word)`` and ``right(type, word)`` scoring at least ``threshold``.

    Both sides hold distinct lower-case words. Words meet only on keys that
    every qualifying pair shares, instead of on their type alone; the keys are
    hashed to 8 bytes so the shuffle carries little, and a key that many words
    share is split by the adaptive skew join.
    """
    def keyed(df: DataFrame, side: str) -> DataFrame:
        with_keys = spread(df, "word").select("type", "word", similarity.join_keys_column(F.col("word"), threshold).alias("keys"))
        # A left word meets the right one either as the longer or as the shorter.
        first, second = ("longer", "shorter") if side == "left" else ("shorter", "longer")
        # The last three bits of a hashed key are its number of equal leading letters.
        hashed = lambda role, tag: F.transform(
            F.col(f"keys.{role}"),
            lambda k: F.shiftleft(F.xxhash64(F.col("type"), F.lit(tag), k), 3) + F.substring(k, 1, 1).cast("long"),
        )
        both = F.array_distinct(F.concat(hashed(first, 0), hashed(second, 1)))
        return with_keys.select(
            F.explode(both).alias("join_key"), F.col("type").alias(f"{side}_type"), F.col("word").alias(f"{side}_word"),
            F.col("keys.mask").alias(f"{side}_mask"), F.char_length("word").alias(f"{side}_length"),
        )

    prefix = F.col("join_key").bitwiseAND(F.lit(7).cast("long")).cast("int")
    # Exploded keys are far larger than the planner's estimate, so never broadcast them.
    met = keyed(left, "left").join(keyed(right, "right").hint("merge"), "join_key").filter(
        (F.col("left_type") == F.col("right_type"))
        & similarity.possible_match(
            F.col("left_length"), F.col("right_length"), F.col("left_mask"), F.col("right_mask"), prefix, threshold
        )
        & similarity.exactly_shared(F.col("left_word"), F.col("right_word"), prefix)
    )
    # A pair may meet on a few keys. Scoring it again is cheaper than shuffling all
    # candidates to make them distinct, so only qualifying pairs are made distinct.
    scored = met.select(
        F.col("left_type").alias("type"), "left_word", "right_word",
        similarity.jaro_winkler(F.col("left_word"), F.col("right_word")).alias("similarity"),
    )
    return scored.filter(F.col("similarity") >= threshold).distinct()


def _steps(threshold: float) -> list[float]:
    return [*(t for t in (_CLOSE,) if t > threshold), threshold]


def _without(words: DataFrame, matched: DataFrame) -> DataFrame:
    return words.join(matched.select("type", "word").distinct().hint("merge"), ["type", "word"], "left_anti")


def fuzzy_lookup(names: DataFrame, lexicon: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Best lexicon canonical of the same type per (type, word); ties by name."""
    canonicals = cut_lineage(lexicon.filter("canonical_name is not null").select(
        F.col("entity_type").alias("type"), F.lower("canonical_name").alias("word"), "canonical_name"
    ).distinct())
    others = canonicals.select("type", "word").distinct()
    kinds = F.broadcast(canonicals.select("type").distinct())  # as few as there are types of entities
    words = cut_lineage(names.select("type", "word").distinct().join(kinds, "type", "left_semi"))
    # Only equal words score 1, so they need no keys. (Scored, as a literal here fails in Spark's optimizer once checkpointed.)
    score = similarity.jaro_winkler(F.col("word"), F.col("word")).alias("similarity")
    found = words.join(canonicals.hint("merge"), ["type", "word"]).select("type", "word", "canonical_name", score)
    left = cut_lineage(_without(words, others))
    for least in _steps(threshold):
        pairs = cut_lineage(similar_pairs(left, others, least).select("type", F.col("left_word").alias("word"), "right_word", "similarity"))
        named = pairs.join(canonicals.withColumnRenamed("word", "right_word"), ["type", "right_word"])
        found = found.unionByName(named.select("type", "word", "canonical_name", "similarity"))
        left = cut_lineage(_without(left, pairs)) if least > threshold else left
    return _best(found)


def _best(options: DataFrame) -> DataFrame:
    return top_per_group(options, ["type", "word"], [F.desc("similarity"), F.asc("canonical_name")])


def resolve(mention_rows: DataFrame, lexicon: DataFrame, threshold: float = THRESHOLD):
    """(entities, new lexicon rows) for mentions (uid, seq, raw_name, entity_type).

    Reproduces one-after-another resolution in ``seq`` order, in which every
    name that finds no canonical becomes one that later names can match:

    1. one row per case-folded name, the first seen, with its type;
    2. exact lexicon hits are answered;
    3. names without any similar existing canonical may become canonicals;
       in lots of growing size, those similar to a canonical of an earlier lot
       are none; of the others a name whose earlier similar candidates are all
       decided is decided itself, round by round, each a join of small pair rows;
    4. every unanswered name takes the best of the existing canonicals and the
       new canonicals before it, else itself.
    """
    usable = mention_rows.filter((F.coalesce("raw_name", F.lit("")) != "") & (F.coalesce("entity_type", F.lit("")) != ""))
    usable = usable.withColumn("key", name_key(F.col("raw_name"))).filter("key != ''")
    first = usable.groupBy("key").agg(
        F.min("seq").alias("seq"),
        F.min_by(F.struct(clean_name(F.col("raw_name")).alias("name"), F.col("entity_type").alias("type")), "seq").alias("f"),
    ).select("key", "seq", F.col("f.name").alias("name"), F.col("f.type").alias("type"))
    known = lexicon_by_key(lexicon)
    first = cut_lineage(first.join(known, "key", "left"))
    answered = first.filter("canonical_name is not null").select("key", "canonical_name")
    open_names = first.filter("canonical_name is null").drop("canonical_name").withColumnRenamed("key", "word")
    if open_names.isEmpty():  # the usual case of a small batch: the lexicon knows all names
        entities = usable.join(answered, "key").select("uid", "entity_type", "raw_name", "canonical_name")
        return entities, open_names.select(F.col("name").alias("raw_name"), F.col("name").alias("canonical_name"), F.col("type").alias("entity_type"))

    existing = cut_lineage(fuzzy_lookup(open_names, lexicon, threshold))
    leaders = _new_canonicals(open_names, existing, threshold)
    options = existing.unionByName(leaders)
    best = _best(options).select("word", "type", "canonical_name")
    resolved = open_names.join(best, ["type", "word"], "left").select(
        F.col("word").alias("key"), "name", "type", F.coalesce("canonical_name", "name").alias("canonical_name")
    )
    resolved = cut_lineage(resolved)
    answers = answered.unionByName(resolved.select("key", "canonical_name"))
    entities = usable.join(answers, "key").select("uid", "entity_type", "raw_name", "canonical_name")
    additions = resolved.select(
        F.col("name").alias("raw_name"), "canonical_name", F.col("type").alias("entity_type")
    )
    return entities, additions


def _new_canonicals(open_names: DataFrame, existing: DataFrame, threshold: float) -> DataFrame:
    """(type, word, canonical_name, similarity): new canonicals that precede a name and may be its best match."""
    possible = _without(open_names.select("type", "word", "seq", "name"), existing)
    possible = cut_lineage(number_within(possible, [], ["seq"], "nth"))
    total, end, lot = possible.count(), 0, _FIRST_LOT
    chosen = possible.limit(0).select("type", "word", "seq", "name")
    # Names in order, lot by lot: those similar to a canonical of an earlier lot aren't compared with each other.
    while end < total:
        some = possible.filter((F.col("nth") > end) & (F.col("nth") <= end + lot)).select("type", "word", "seq", "name")
        for least in _steps(threshold) if end else ():
            some = cut_lineage(_without(some, similar_pairs(some.select("type", "word"), chosen.select("type", "word"), least).select("type", F.col("left_word").alias("word"))))
        chosen = cut_lineage(chosen.unionByName(_first_of_all(some, threshold)))
        end, lot = end + lot, 2 * lot

    leaders = chosen.select("type", F.col("word").alias("right_word"), F.col("seq").alias("right_seq"), F.col("name").alias("canonical_name"))
    left, found = cut_lineage(_without(open_names.select("type", "word", "seq"), chosen)), None
    for least in _steps(threshold):
        pairs = similar_pairs(left.select("type", "word"), chosen.select("type", "word"), least)
        named = pairs.withColumnRenamed("left_word", "word").join(left, ["type", "word"]).join(leaders, ["type", "right_word"])
        options = cut_lineage(named.filter("right_seq < seq").select("type", "word", "canonical_name", "similarity"))
        found = options if found is None else found.unionByName(options)
        if least > threshold:
            left = cut_lineage(_without(_without(left, options), existing.filter(F.col("similarity") >= least)))
    return found


def _first_of_all(possible: DataFrame, threshold: float) -> DataFrame:
    """Those of ``possible`` (type, word, seq, name) that become canonicals: no canonical before them is similar."""
    possible = cut_lineage(possible)
    pairs = similar_pairs(possible.select("type", "word"), possible.select("type", "word"), threshold)
    left = possible.select("type", F.col("word").alias("left_word"), F.col("seq").alias("left_seq"))
    right = possible.select("type", F.col("word").alias("right_word"), F.col("seq").alias("right_seq"))
    earlier = pairs.filter("left_word <> right_word").join(left, ["type", "left_word"]).join(right, ["type", "right_word"])
    waiting = cut_lineage(earlier.filter("right_seq < left_seq").select("type", F.col("left_word").alias("word"), F.col("right_word").alias("other")))
    decided = cut_lineage(
        possible.select("type", "word").join(waiting.select("type", "word"), ["type", "word"], "left_anti")
        .withColumn("is_canonical", F.lit(True))
    )
    verdicts = decided
    while not waiting.isEmpty():
        others = verdicts.select("type", F.col("word").alias("other"), "is_canonical")
        state = waiting.join(others, ["type", "other"], "left").groupBy("type", "word").agg(
            F.bool_or(F.col("is_canonical").isNull()).alias("undecided"),
            F.bool_or(F.coalesce("is_canonical", F.lit(False))).alias("has_canonical"),
        )
        # One canonical before it settles a name; otherwise all must be settled.
        ready = state.filter("has_canonical or not undecided").select(
            "type", "word", (~F.col("has_canonical")).alias("is_canonical")
        )
        verdicts = cut_lineage(verdicts.unionByName(ready))
        waiting = cut_lineage(waiting.join(verdicts.select("type", "word"), ["type", "word"], "left_anti"))
    return possible.join(verdicts.filter("is_canonical").select("type", "word"), ["type", "word"], "left_semi")


def lexicon_additions(lexicon: DataFrame, additions: DataFrame, now: Column) -> DataFrame:
    """Rows the lexicon gains: insert-or-ignore by exact raw name; the first of several additions wins."""
    fresh = additions.join(lexicon.select("raw_name"), "raw_name", "left_anti")
    return fresh.groupBy("raw_name").agg(
        F.min(F.struct("canonical_name", "entity_type")).alias("v")
    ).select("raw_name", "v.canonical_name", "v.entity_type", now.cast("timestamp_ntz").alias("created_at"))


def add_to_lexicon(lexicon: DataFrame, additions: DataFrame, now: Column) -> DataFrame:
    """The lexicon with its additions."""
    return lexicon.unionByName(lexicon_additions(lexicon, additions, now))
