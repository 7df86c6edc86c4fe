"""Quality rules with thresholds that follow the data.

Each text gets counts, and from them four shares as whole numbers. Per language and source a
quantile sketch of each share is gathered: counts of logarithmic bins with ``1 << DETAIL`` steps to a
power of two, exact to a sixteenth of the value, deterministic, and merged by adding counts, so tasks
pre-aggregate and a hot source costs one row a bin and task. A share far above what
is usual there, beyond the third quartile by more than ``REACH`` times the distance of the quartiles, fails
the rule. No threshold is fixed: ``WIDTHS`` only say how far apart quartiles count as at least, for groups whose middle half is
all alike. Small groups use the merged sketches of their language.

Defined cases: null text has no words, lines or symbols; null language or source is a group of its own; repeated
rows count and are judged each on its own; a corpus without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.session import cut_lineage

BLANK = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
DETAIL = 4
REACH = 6
LEAST_DOCUMENTS = 50
#: Least distance of the quartiles, what one event makes in a short text: a symbol in 250 characters, a line in fifteen, a
#: window in 50 words (in thousandths), and a quarter of a character in the mean word (in hundredths).
WIDTHS = {"symbols": 4, "dup_lines": 67, "repeats": 60, "word_size": 25}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first included."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def repeats(s: Column) -> Column:
            def again(x: Column, k: Column) -> Column:
                return (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))

            starts = F.array_sort(F.transform(F.filter(s, again), lambda x: x["i"]))
            none = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(starts, none, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

        return F.when(F.size(w) >= 3, _let(F.array_sort(windows), repeats)).otherwise(0)

    return _let(words, of)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(said, BLANK + "+"), "")
    bare = F.translate(said, _BLANKS, "")

    def lines(found: Column) -> Column:
        return F.struct(F.size(found).alias("all"), (F.size(found) - F.size(F.array_distinct(found))).alias("again"))

    spoken = _let(F.filter(F.split(said, "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0), lines)
    split = docs.withColumns({"_words": words, "_lines": spoken})
    return split.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(said) - F.length(F.translate(said, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.col("_lines.again").cast("long"), "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        "n_lines": F.col("_lines.all").cast("long"),
    }).drop("_words", "_lines")


def shares() -> dict[str, Column]:
    def part(above: str, below: str, unit: int) -> Column:
        return F.floor(unit * F.col(above) / F.greatest(F.col(below), F.lit(1))).cast("long")

    return {
        "symbols": part("n_symbols", "word_chars", 1000), "dup_lines": part("n_dup_lines", "n_lines", 1000),
        "repeats": part("n_repeat_words", "n_words", 1000), "word_size": part("word_chars", "n_words", 100),
    }


def bin_of(value: Column) -> Column:
    """Bin of a whole number: exact below 32, then 16 bins to each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - DETAIL - 1, F.lit(0))
    return (shift * (1 << DETAIL) + F.call_function("shiftright", value, shift.cast("int"))).cast("long")


def value_of(found: Column) -> Column:
    """Smallest whole number of a bin."""
    shift = F.greatest(F.floor(found / (1 << DETAIL)) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (found - shift * (1 << DETAIL)).cast("long"), shift)


def sketches(marked: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of bins for each group and measure: sketches that merge by adding."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), bin_of(F.col(name)).alias("bin")) for name in WIDTHS]))
    return marked.select(*groups, each.alias("x")).groupBy(*groups, "x.measure", "x.bin").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Number of documents and upper limit of each measure, from merged sketches."""
    merged = sketch.groupBy(*groups, "measure", "bin").agg(F.sum("n").alias("n"))
    # A sketch has a few hundred bins at most.
    held = merged.groupBy(*groups, "measure").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))

    def quartile(quarter: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
        step = F.aggregate(
            "bins", start,
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["bin"].isNull() & (4 * (a["seen"] + x["n"]) >= quarter * F.col("total")), x["bin"]).otherwise(a["bin"]).alias("bin")),
            lambda a: a["bin"],
        )
        return value_of(step)

    quartiles = held.withColumns({"q1": quartile(1), "q3": quartile(3)})

    def fence(width: int) -> Column:
        return F.col("q3") + REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(width))

    wide = [F.max(F.when(F.col("measure") == name, fence(width))).alias(f"most_{name}") for name, width in WIDTHS.items()]
    return quartiles.groupBy(*groups).agg(F.max("total").alias("n_group"), *wide)


def judged(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, counts, base_failed and kept of every row."""
    keys = {"_lang": F.coalesce(F.col(language).cast("string"), F.lit("")), "_source": F.coalesce(F.col(source).cast("string"), F.lit(""))}
    counted = counts(docs, text).select("doc_id", *[v.alias(k) for k, v in keys.items()],
                                        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    marked = cut_lineage(counted.withColumns(shares()))
    sketch = cut_lineage(sketches(marked, ["_lang", "_source"]))
    of_group = thresholds(sketch, ["_lang", "_source"])
    of_language = thresholds(sketch, ["_lang"]).withColumnsRenamed({"n_group": "n_lang"} | {f"most_{m}": f"lang_{m}" for m in WIDTHS})
    limits = of_group.join(of_language, "_lang").select(
        "_lang", "_source", *[F.when(F.col("n_group") >= LEAST_DOCUMENTS, F.col(f"most_{m}")).otherwise(F.col(f"lang_{m}")).alias(f"most_{m}") for m in WIDTHS]
    )
    fine = F.lit(True)
    for name in WIDTHS:
        fine &= F.col(name) <= F.col(f"most_{name}")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return marked.join(limits, ["_lang", "_source"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fine).alias("kept")
    )


def oracle_sql() -> str:
    bins = "greatest(length(bin({0})) - 5, 0) * 16 + ({0} >> greatest(length(bin({0})) - 5, 0))"
    value = "(({0} - greatest({0} // 16 - 1, 0) * 16) << greatest({0} // 16 - 1, 0))"
    measured = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {bins.format(m)} AS bin FROM shares" for m in WIDTHS)
    widths = " ".join(f"WHEN '{m}' THEN {w}" for m, w in WIDTHS.items())

    def limits(groups: str, prefix: str) -> str:
        wide = ", ".join(f"max(most) FILTER (measure = '{m}') AS {prefix}_{m}" for m in WIDTHS)
        q1, q3 = (f"min(bin) FILTER (4 * seen >= {k} * total)" for k in (1, 3))
        return f"""
        SELECT {groups}, max(total) AS {prefix}_n, {wide} FROM (
          SELECT {groups}, measure, any_value(total) AS total,
                 {value.format(q3)} + {REACH} * greatest({value.format(q3)} - {value.format(q1)}, CASE measure {widths} END) AS most
          FROM (SELECT {groups}, measure, bin, sum(n) OVER (PARTITION BY {groups}, measure ORDER BY bin) AS seen,
                       sum(n) OVER (PARTITION BY {groups}, measure) AS total
                FROM (SELECT {groups}, measure, bin, count(*) AS n FROM measured GROUP BY ALL))
          GROUP BY {groups}, measure)
        GROUP BY {groups}"""

    fine = " AND ".join(f"{m} <= CASE WHEN g_n >= {LEAST_DOCUMENTS} THEN g_{m} ELSE l_{m} END" for m in WIDTHS)
    return rf"""
    WITH texts AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
    windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) >= 3)),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(3) r(k) WHERE n > 1 GROUP BY doc_id),
    counted AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                       length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                       len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines
                FROM texts LEFT JOIN covered USING (doc_id)),
    shares AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
                      1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS word_size FROM counted),
    measured AS ({measured}),
    of_group AS ({limits("lang, source", "g")}), of_lang AS ({limits("lang", "l")}),
    judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed
               FROM shares JOIN of_group USING (lang, source) JOIN of_lang USING (lang))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fine} AS kept FROM judged
    """
