"""Publication dates: an ordered list of formats, offsets folded to UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted formats, tried in this order.
FORMATS = (
    "d MMM yyyy HH:mm:ss Z",
    "yyyy-MM-dd HH:mm:ss Z",
    "yyyy-MM-dd'T'HH:mm:ss Z",
)


def utc_instant(wall: Column) -> Column:
    """UTC wall time (no zone) to the instant, whatever the session zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall).cast("timestamp")


def utc_wall(instant: Column) -> Column:
    """Instant to UTC wall time (no zone), whatever the session zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def normalised_date_text(raw: Column) -> Column:
    """Weekday and trailing zone comment dropped; the offset always as +hhmm."""
    text = F.trim(raw)
    text = F.regexp_replace(text, r"\s*\([^)]+\)$", "")
    text = F.regexp_replace(text, r"^[A-Za-z]{3},?\s+", "")
    text = F.regexp_replace(text, r"\s*(?:GMT|UTC|UT|Z)$", " +0000")
    text = F.regexp_replace(text, r"\s*([+-]\d{2}):?(\d{2})$", " $1$2")
    text = F.regexp_replace(text, r"(:\d{2})\.\d+", "$1")
    return F.when(text.rlike(r" [+-]\d{4}$"), text).otherwise(F.concat(text, F.lit(" +0000")))


def parse_date(raw: Column) -> Column:
    """UTC timestamp without zone, NULL when no format fits.

    A wall-clock default would make reruns differ, so the caller decides what
    an unreadable date becomes (see ``date_or``).
    """
    text = normalised_date_text(raw)
    # A trailing hyphenated date such as 2024-01-05 must not read as an offset.
    return utc_wall(F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in FORMATS]))


def date_or(raw: Column, fallback: Column) -> Column:
    return F.coalesce(parse_date(raw), fallback.cast("timestamp_ntz"))


def date_failed(raw: Column) -> Column:
    return parse_date(raw).isNull()
