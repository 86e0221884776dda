"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_BREAK = r"(?<=[.!?])\s+|\n+"


def normalized(c: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space; null stays null."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def slug(c: Column) -> Column:
    """Runs of anything but letters and digits become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def raw_key(kind: str, role: Column, place: Column, day: Column) -> Column:
    """Path of an immutable dated raw file."""
    return F.concat_ws("/", F.lit(kind), F.lit("raw"), slug(role), slug(place), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(".json")))


def sentences(c: Column) -> Column:
    """Array of trimmed, non-empty sentences: split after . ! ? and at line ends."""
    return F.filter(F.transform(F.split(c, SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")


def sentence_key(c: Column) -> Column:
    """What counts when sentences are compared: lower case letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), r"[^a-z0-9 ]", ""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_chunks(c: Column, size: int = 150) -> Column:
    """Array of texts of at most `size` words, in order; no words give no chunk."""
    w = words(c)
    n = F.ceil(F.size(w) / F.lit(size)).cast("int")
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * size + 1, size), " ")))


def without_covered_words(terms: Column) -> Column:
    """Drops single words that a kept two-word term covers, keeping the order."""
    return F.filter(terms, lambda t: F.contains(t, F.lit(" ")) | ~F.exists(terms, lambda o: F.contains(o, F.lit(" ")) & F.array_contains(F.split(o, " "), t)))


def topic_label(terms: Column, most: int = 4) -> Column:
    return F.array_join(F.slice(without_covered_words(terms), 1, most), ", ")


def money(c: Column) -> Column:
    """Dollars to the nearest thousand, halves away from zero: -14500 is -$15,000."""
    k = F.signum(c) * F.floor(F.abs(c) / 1000 + F.lit(0.5)) * 1000
    return F.concat(F.when(k < 0, "-$").otherwise("$"), F.format_number(F.abs(k).cast("long"), 0))


def percent(c: Column) -> Column:
    return F.concat(F.floor(c * 100 + F.lit(0.5)).cast("long").cast("string"), F.lit("%"))


def axis_bounds(low: Column, high: Column, step: int = 25_000) -> list[Column]:
    """Bounds of a chart that fall on multiples of `step`."""
    return [(F.floor(low / step) * step).cast("double").alias("axis_min"), (F.ceil(high / step) * step).cast("double").alias("axis_max")]


def signed_money(c: Column) -> Column:
    """As `money`, with + before what is above zero."""
    return F.when(F.abs(c) < 500, F.lit("$0")).otherwise(F.concat(F.when(c > 0, "+").otherwise(""), money(c)))


def age_in_days(at: Column, now: Column) -> Column:
    """Whole UTC days between two times."""
    from quarrymill.functions.postings import utc_day

    return F.datediff(utc_day(now), utc_day(at))


def scale_bounds(low: Column, high: Column, step: int = 10_000) -> list[Column]:
    """Bounds of a scale: a little beyond both ends, on multiples of `step`."""
    return [(F.floor(low * 0.92 / step) * step).cast("double").alias("scale_min"), (F.ceil(high * 1.05 / step) * step).cast("double").alias("scale_max")]


def share_bound(most: Column) -> Column:
    """The end of an axis of shares: the next tenth."""
    return F.ceil(F.round(most * 10, 9)) / 10
