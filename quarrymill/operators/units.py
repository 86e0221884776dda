"""Quantities recorded in different units (problem 4): pay in US dollars per year and the unit it was recorded in.

Distinct unit spellings (labels, and phrases beside the posting's own figures in its text) are mapped to units through an
inverted index of character n-grams and a weighted edit distance; the alias dictionary is then joined to all rows.

Defined cases. Null or blank spelling: no unit stated. A spelling near no alias: no unit stated. Null, 0, 1, negative or NaN
figures: not pay. Inverted figures are swapped in the result. A posting loaded several times counts once, with its latest
_loaded_at (ties: the greater unit name, then figures). An empty table gives no rows. Columns besides the named ones don't matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.joins import lookup
from quarrymill.session import cut

#: Units and how many of each make a year; YEAR_K is thousands of dollars a year.
PER_YEAR = {"HOUR": 2080.0, "DAY": 260.0, "WEEK": 52.0, "BIWEEK": 26.0, "MONTH": 12.0, "YEAR": 1.0, "YEAR_K": 1000.0}
#: Known spellings of each unit, lower case, with punctuation as a space.
ALIASES = {
    "HOUR": ["hour", "hours", "hourly", "per hour", "an hour", "hr", "hrs", "an hr", "per hr", "hrly", "p h", "ph", "each hour"],
    "DAY": ["day", "daily", "per day", "a day", "per diem", "p d", "each day", "day rate"],
    "WEEK": ["week", "weekly", "per week", "a week", "wk", "per wk", "wkly", "p w", "pw", "each week"],
    "BIWEEK": ["biweekly", "bi weekly", "biweek", "fortnight", "fortnightly", "per fortnight", "a fortnight", "every 2 weeks", "every two weeks", "every other week", "per 2 weeks", "per two weeks", "2wk", "2 wk", "2 week", "two week", "each 2 week", "each two week", "per 2 week", "per two week", "every 2 week", "every two week", "a two week", "each 2 weeks", "each two weeks", "2 weeks", "two weeks"],
    "MONTH": ["month", "monthly", "per month", "a month", "mo", "per mo", "mth", "mnth", "pcm", "p m", "per calendar month", "each month"],
    "YEAR": ["year", "yearly", "per year", "a year", "yr", "per yr", "yrly", "annual", "annually", "per annum", "annum", "pa", "p a", "each year"],
    "YEAR_K": ["k yr", "k year", "k per year", "k a year", "k annually", "k per annum", "k pa", "k p a", "kusd pa", "kusd per year", "kusd yr", "kusd", "usd k", "annual thousands", "annual 000s", "annual k", "year 000s", "year thousands", "year k", "yearly thousands", "thousands per year", "thousands a year", "thousands pa", "000s per year", "000 year", "yr 000s", "yr thousands", "yr k"],
}
#: A figure pair or single figure in text, with what follows it up to the unit's words.
_NUM = r"\d[\d,]*(?:\.\d+)?"
PAY_TEXT = rf"(?:\$|USD)\s?{_NUM}\s?[kK]?(?:\s*(?:-|–|—|to|and)\s*(?:\$|USD)?\s?{_NUM}\s?[kK]?)?\s*(?:/\s*|(?:per|an?|every|each)\s+)?(?:(?:2|two|other|calendar)[\s-]+)?[A-Za-z][A-Za-z-]*"
_PARTS = rf"^(?:\$|USD)\s?({_NUM})\s?([kK]?)(?:\s*(?:-|–|—|to|and)\s*(?:\$|USD)?\s?({_NUM})\s?([kK]?))?\s*(.*)$"


def plain(s: str) -> str:
    return re.sub(r"[^0-9a-z]+", " ", s.lower()).strip()


def grams(s: str) -> set[str]:
    t = f"^{s}$"
    return {t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)}


def weighted_distance(a: str, b: str) -> float:
    """Edit distance with swaps; spaces cost 0.2, vowels and doubled letters 0.5, digits 3, other characters 1."""

    def cost(c: str, before: str = "") -> float:
        return 0.2 if c == " " else 3.0 if c.isdigit() else 0.5 if c in "aeiou" or c == before else 1.0

    rows = [[0.0]]
    for j, c in enumerate(b):
        rows[0].append(rows[0][j] + cost(c, b[j - 1] if j else ""))
    for i, x in enumerate(a):
        row = [rows[i][0] + cost(x, a[i - 1] if i else "")]
        for j, y in enumerate(b):
            best = min(rows[i][j + 1] + cost(x, a[i - 1] if i else ""), row[j] + cost(y, b[j - 1] if j else ""), rows[i][j] + (0 if x == y else max(cost(x), cost(y))))
            if i and j and x == b[j - 1] and y == a[i - 1]:
                best = min(best, rows[i - 1][j - 1] + 0.7)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


class AliasIndex:
    """Inverted index from character n-grams to known spellings; `find` verifies the sharing ones by weighted edit distance."""

    def __init__(self, aliases: dict[str, list[str]], most: float = 0.25):
        self.entries = [(s, unit) for unit, all_ in aliases.items() for s in all_]
        self.exact = {s: unit for s, unit in self.entries}
        self.most = most
        self.index: dict[str, list[int]] = defaultdict(list)
        for i, (s, _) in enumerate(self.entries):
            for g in grams(s):
                self.index[g].append(i)

    def find(self, spelling: str | None) -> str | None:
        s = plain(spelling or "")
        if not s or s in self.exact:
            return self.exact.get(s)
        shared: dict[int, int] = defaultdict(int)
        for g in grams(s):
            for i in self.index.get(g, ()):
                shared[i] += 1
        best = (self.most, "", None)
        for i in shared:
            alias, unit = self.entries[i]
            if abs(len(alias) - len(s)) <= 4 and min(len(alias), len(s)) > 2:
                best = min(best, (weighted_distance(s, alias) / max(len(s), len(alias)), alias, unit))
        return best[2]


def alias_dictionary(spellings: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """(spelling, unit) for each distinct spelling that is a known one or near one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = AliasIndex(aliases)
        for b in batches:
            yield pd.DataFrame({"spelling": b["spelling"], "unit": [index.find(s) for s in b["spelling"]]}).dropna()

    return spellings.select("spelling").where(F.col("spelling").isNotNull()).distinct().mapInPandas(run, "spelling string, unit string")


def _number(c: Column) -> Column:
    return F.when(c != "", F.regexp_replace(c, ",", "").try_cast("double"))


def own_statement(text: Column, low: Column, high: Column) -> Column:
    """struct(spelling, thousands) of the first money phrase in `text` whose figures are the posting's own `low` and `high`.

    Both figures must be stated if both are recorded and differ. thousands: the text's figures are in thousands and so are the
    recorded ones. The whole text is searched.
    """
    one = F.coalesce(low, high)
    other = F.coalesce(high, low)
    lo, hi = F.least(one, other), F.greatest(one, other)

    def same(a: Column, b: Column) -> Column:
        return F.abs(a - b) < 0.006

    def parsed(m: Column) -> Column:
        a, b = _number(F.regexp_extract(m, _PARTS, 1)), _number(F.regexp_extract(m, _PARTS, 3))
        k = (F.regexp_extract(m, _PARTS, 2) != "") | (F.regexp_extract(m, _PARTS, 4) != "")
        b = F.coalesce(b, a)
        x, y = F.least(a, b), F.greatest(a, b)
        as_is = same(x, lo) & same(y, hi)
        times = same(x * 1000, lo) & same(y * 1000, hi) & k
        return F.struct(F.regexp_extract(m, _PARTS, 5).alias("spelling"), (k & as_is).alias("thousands"), (as_is | times).alias("own"))

    found = F.transform(F.regexp_extract_all(text, F.lit(PAY_TEXT), F.lit(0)), parsed)
    return F.get(F.filter(found, lambda p: p["own"]), F.lit(0))


def _pay(c: Column) -> Column:
    return F.when((c > 1) & ~F.isnan(c), c)


def recorded_units(df: DataFrame) -> DataFrame:
    """One row a posting: job_id, pay_unit (null: no pay recorded), low and high as recorded (placeholders are null).

    The unit stated in the text beside the posting's own figures holds, else the label's, else US dollars per year.
    """
    low, high = _pay(F.col("salary_min_raw")), _pay(F.col("salary_max_raw"))
    has = F.coalesce(low, high).isNotNull()
    lean = (
        df.where(F.col("job_id").isNotNull())
        .select("job_id", F.col("_loaded_at").alias("at"), low.alias("low"), high.alias("high"), F.when(has, F.nullif(F.upper(F.trim("salary_period_raw")), F.lit(""))).alias("label"), F.when(has & F.contains("description", F.lit("$")) | has & F.contains("description", F.lit("USD")), own_statement(F.col("description"), low, high)).alias("said"))
        .select("job_id", "at", "low", "high", "label", F.nullif(F.lower(F.trim("said.spelling")), F.lit("")).alias("phrase"), F.col("said.thousands").alias("thousands"))
    )
    lean = cut(lean)  # both the dictionary and the join read it; the texts are searched once
    words = lean.select(F.explode(F.array("label", "phrase")).alias("spelling"))
    known = cut(alias_dictionary(words))
    rows = lookup(lean, known.select(F.col("spelling").alias("label"), F.col("unit").alias("label_unit")), "label")
    rows = lookup(rows, known.select(F.col("spelling").alias("phrase"), F.col("unit").alias("phrase_unit")), "phrase")
    phrase = F.when(F.col("thousands") & (F.col("phrase_unit") == "YEAR"), "YEAR_K").otherwise(F.col("phrase_unit"))
    unit = F.when(F.coalesce("low", "high").isNotNull(), F.coalesce(phrase, F.col("label_unit"), F.lit("YEAR")))
    last = F.max(F.struct("at", unit.alias("pay_unit"), "low", "high")).alias("m")
    return rows.groupBy("job_id").agg(last).select("job_id", "m.pay_unit", "m.low", "m.high")


def pay_cases(df: DataFrame) -> DataFrame:
    """(job_id, pay_unit) of the postings whose pay isn't plain US dollars a year."""
    return recorded_units(df).where(F.col("pay_unit").isNotNull() & (F.col("pay_unit") != "YEAR")).select("job_id", "pay_unit")


def annual_pay(df: DataFrame) -> DataFrame:
    """(job_id, pay_unit, pay_min_year, pay_max_year): every posting's pay in US dollars a year; null where none is recorded."""
    factor = F.create_map(*[F.lit(x) for pair in PER_YEAR.items() for x in pair])[F.col("pay_unit")]
    lo, hi = F.coalesce("low", "high"), F.coalesce("high", "low")
    one_low, one_high = F.col("low").isNotNull(), F.col("high").isNotNull()
    both = one_low & one_high
    return recorded_units(df).select(
        "job_id", "pay_unit",
        F.round(F.when(both, F.least(lo, hi)).when(one_low, F.col("low")) * factor, 2).alias("pay_min_year"),
        F.round(F.when(both, F.greatest(lo, hi)).when(one_high, F.col("high")) * factor, 2).alias("pay_max_year"),
    )
