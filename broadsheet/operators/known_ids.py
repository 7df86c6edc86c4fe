"""Which ids a store knows: a mergeable Bloom filter for each bucket of ids, false hits settled exactly.

Ids are dealt to ``buckets`` by a hash. A bucket's filter is a row for each of its 64-bit words that has a bit set, so
filters of several batches merge by ``bit_or`` and are tables like all others. A lookup asks the filters first and reads
the ids themselves only of buckets in which some asked id may stand; a batch of new ids reads hardly any.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

FILTERS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("word", T.IntegerType()), T.StructField("bits", T.LongType())])
KNOWN = T.StructType([T.StructField("uid", T.StringType()), T.StructField("bucket", T.IntegerType())])


@dataclass(frozen=True)
class Layout:
    """``bits`` of each bucket's filter should be ten times the ids it will hold for one false hit in a hundred."""

    buckets: int = 64
    bits: int = 1 << 17
    hashes: int = 5


def bucket_of(uid: Column, layout: Layout) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(layout.buckets)).cast("int")


def _places(uid: Column, layout: Layout) -> Column:
    """array<struct<word, mask>>: where an id has its bits."""
    places = [F.pmod(F.xxhash64(uid, F.lit(k)), F.lit(layout.bits)).cast("int") for k in range(layout.hashes)]
    one = F.lit(1).cast("long")
    return F.array(*(F.struct(F.shiftright(p, 6).alias("word"), _shifted(one, p).alias("mask")) for p in places))


def _shifted(value: Column, place: Column) -> Column:
    return F.call_function("shiftleft", value, place.bitwiseAND(F.lit(63)))


def known(uids: DataFrame, layout: Layout) -> DataFrame:
    """Distinct ids with their buckets."""
    return uids.select("uid").distinct().withColumn("bucket", bucket_of(F.col("uid"), layout))


def filters(uids: DataFrame, layout: Layout) -> DataFrame:
    bits = known(uids, layout).select("bucket", F.explode(_places(F.col("uid"), layout)).alias("place"))
    return bits.groupBy("bucket", F.col("place.word").alias("word")).agg(F.bit_or("place.mask").alias("bits"))


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))


def maybe_known(uids: DataFrame, filter_rows: DataFrame, layout: Layout) -> DataFrame:
    """Those of the ids whose bits are all set, with their buckets: all known ones and few others."""
    asked = known(uids, layout).select("uid", "bucket", F.explode(_places(F.col("uid"), layout)).alias("place"))
    asked = asked.select("uid", "bucket", "place.word", "place.mask")
    seen = asked.join(filter_rows, ["bucket", "word"], "left")
    is_set = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    return seen.groupBy("uid", "bucket").agg(F.bool_and(is_set).alias("all_set")).filter("all_set").select("uid", "bucket")


def buckets_to_read(uids: DataFrame, filter_rows: DataFrame, layout: Layout) -> list[int]:
    """At most ``layout.buckets`` numbers."""
    return sorted(r["bucket"] for r in maybe_known(uids, filter_rows, layout).select("bucket").distinct().collect())
