"""Column expressions over postings: pay, place, level, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.text import normalized

#: Periods of a year by label.
ANNUAL_FACTOR = {"HOUR": 2080, "DAY": 260, "WEEK": 52, "MONTH": 12, "YEAR": 1}
PLAUSIBLE = (20_000, 1_000_000)
#: Names and postal codes of the states, the district and Puerto Rico.
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT",
    "Delaware": "DE", "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL",
    "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE",
    "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC",
    "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Puerto Rico": "PR", "Rhode Island": "RI",
    "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA",
    "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}
#: Words of a title that show its level; the first level with a hit holds.
LEVEL_WORDS = {
    "intern": "intern|interns|internship|co-op|coop",
    "manager": "manager|director|head|vp|vice president|chief",
    "staff_plus": "staff|principal|distinguished|fellow|lead|architect",
    "senior": "senior|sr|iii|iv",
    "mid": "ii",
    "junior": "junior|jr|entry|associate|graduate|grad|early career|i",
}
LEVEL_RANK = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "staff_plus": 4, "manager": 4}
LEVELS = ["intern", "junior", "mid", "senior", "staff_plus", "manager", "unknown"]
#: Least years of experience for a level where the title says none.
YEARS_FOR = [("staff_plus", 7), ("senior", 4), ("mid", 2)]
LEAST_SAMPLE = 5


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def annual(amount: Column, period: Column) -> Column:
    """Pay a year, in whole dollars; null for an unknown period."""
    return F.round(amount * literal_map(ANNUAL_FACTOR)[F.upper(period)])


def salary_flag(low: Column, high: Column, period: Column) -> Column:
    """unknown_period, out_of_range, inverted_range or null, in this order of precedence."""
    factor = literal_map(ANNUAL_FACTOR)[F.upper(period)]

    def implausible(c: Column) -> Column:
        return c.isNotNull() & ~(c * factor).between(*PLAUSIBLE)

    any_ = low.isNotNull() | high.isNotNull()
    return F.when(any_ & factor.isNull(), "unknown_period").when(implausible(low) | implausible(high), "out_of_range").when(low > high, "inverted_range")


def midpoint(low: Column, high: Column) -> Column:
    return F.coalesce((low + high) / 2, low, high)


def state_code(c: Column) -> Column:
    """By full name as it is written, else a two-letter value in capitals, else null."""
    return F.coalesce(literal_map(STATES)[c], F.when(F.length(c) == 2, F.upper(c)))


def content_key(title: Column, employer: Column, city: Column) -> Column:
    """title|employer|city of the normalised values; a null title or employer is skipped, a null city is empty."""
    return F.concat_ws("|", normalized(title), normalized(employer), F.coalesce(normalized(city), F.lit("")))


def title_level(title: Column) -> Column:
    out = None
    for level, words in LEVEL_WORDS.items():
        hit = title.rlike(rf"(?i)\b({words})\b")
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def effective_level(stated: Column, years: Column) -> Column:
    out = F.when(stated.isNotNull(), stated)
    for level, least in YEARS_FOR:
        out = out.when(years >= least, level)
    return out.when(years.isNotNull(), "junior").otherwise("unknown")


def level_source(stated: Column, years: Column) -> Column:
    return F.when(stated.isNotNull(), "title").when(years.isNotNull(), "years").otherwise("none")


def near_level(a: Column, b: Column) -> Column:
    """At most one step apart; an unknown level is near to all."""
    rank = literal_map(LEVEL_RANK)
    return F.coalesce(F.abs(rank[a] - rank[b]) <= 1, F.lit(True))


def role_key(role: Column) -> Column:
    return F.md5(F.lower(role))


def location_key(city: Column, state: Column, country: Column) -> Column:
    """Key of the place; one key for all postings without city and state, whatever their country."""
    text = F.lower(F.concat_ws("|", F.coalesce(city, F.lit("")), F.coalesce(state, F.lit("")), F.coalesce(country, F.lit(""))))
    return F.when(city.isNull() & state.isNull(), F.md5(F.lit("unknown"))).otherwise(F.md5(text))


def utc(c: Column) -> Column:
    return F.to_utc_timestamp(c, F.current_timezone())


def utc_day(c: Column) -> Column:
    return F.to_date(utc(c))


def utc_week(c: Column) -> Column:
    """The Monday of the UTC week."""
    return F.to_date(F.date_trunc("week", utc(c)))


def gated(value: Column, n: Column, least: int = LEAST_SAMPLE) -> Column:
    return F.when(n >= least, value)


def sample_status(n: Column, least: int = LEAST_SAMPLE) -> Column:
    return F.when(n >= least, "ok").otherwise("too_few_to_report")


def relative(a: Column, b: Column, places: int = 4) -> Column:
    """a / b - 1, null unless b is positive."""
    return F.when(b > 0, F.round(a / b - 1, places))


def impact_status(value: Column, least: float = 500) -> Column:
    return F.when(value.isNull(), "not_enough_data").when(F.abs(value) < least, "no_measurable_effect").otherwise("value")
