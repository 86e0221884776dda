import datetime as dt

import pytest

from quarrymill.operators import units as U

SCHEMA = "job_id string, salary_min_raw double, salary_max_raw double, salary_period_raw string, description string, _loaded_at timestamp, at string, low double, unit string"
T0 = dt.datetime(2026, 9, 1)


def frame(spark, data):
    return spark.createDataFrame([(*d, *[None] * (9 - len(d))) for d in data], SCHEMA)


@pytest.mark.parametrize("spelling,unit", [
    ("HOUR", "HOUR"), ("/HR", "HOUR"), ("P/H", "HOUR"), ("hrly", "HOUR"), ("hourley", "HOUR"), ("Per Diem", "DAY"), ("dayly", "DAY"), ("WEKLY", "WEEK"), ("BI-WEEKLY", "BIWEEK"), ("biweeekly", "BIWEEK"), ("EVERY 2 WEEKS", "BIWEEK"),
    ("fortnigt", "BIWEEK"), ("each two-week", "BIWEEK"), ("PCM", "MONTH"), ("montly", "MONTH"), ("ANUALLY", "YEAR"), ("p.a.", "YEAR"), ("K/YR", "YEAR_K"), ("ANNUAL (THOUSANDS)", "YEAR_K"), ("YEAR (000s)", "YEAR_K"), ("KUSD PA", "YEAR_K"),
    ("", None), (None, None), ("negotiable", None), ("competitive", None), ("x" * 3000, None),
])
def test_spellings(spelling, unit):
    assert U.AliasIndex(U.ALIASES).find(spelling) == unit


def test_text_beats_label_and_label_beats_default(spark, rows):
    df = frame(spark, [
        ("own", 50.0, 60.0, "YEAR", "Pay $50–$60 an hour. Parking is $12 per day.", T0),
        ("label", 400.0, 500.0, "DAY", "Clients pay $250 an hour for our advice.", T0),
        ("plain", 100000.0, None, None, "no figures", T0),
        ("text_year", 90000.0, 100000.0, "HOUR", "We offer $90,000 to $100,000 per annum.", T0),
        ("thousands", 92.0, 118.0, None, "We offer $92k to $118K/yr plus benefits.", T0),
        ("scaled", 92000.0, 118000.0, None, "We offer $92k to $118k/yr plus benefits.", T0),
        ("two_week", 2000.0, 2500.0, None, "We offer $2,000-$2500 each two-week pay period.", T0),
        ("one_side", None, 31.5, None, "Pay: up to $31.50/hr.", T0),
        ("placeholder", 0.0, 1.0, "HOUR", None, T0),
        ("nothing", None, None, "HOUR", "Learning budget: $31 a year.", T0),
        ("inverted", 60.0, 50.0, None, "Rate $50 - $60 hourly (USD).", T0),
        ("half_placeholder", 1.0, 45.0, None, "Rate $45 hourly.", T0),
        (None, 50.0, 60.0, "HOUR", None, T0),
    ])
    assert dict(rows(U.pay_cases(df))) == {"own": "HOUR", "label": "DAY", "thousands": "YEAR_K", "two_week": "BIWEEK", "one_side": "HOUR", "inverted": "HOUR", "half_placeholder": "HOUR"}
    a = {r["job_id"]: (r["pay_unit"], r["pay_min_year"], r["pay_max_year"]) for r in U.annual_pay(df).collect()}
    assert a["own"] == ("HOUR", 104000.0, 124800.0) and a["thousands"] == ("YEAR_K", 92000.0, 118000.0) and a["scaled"] == ("YEAR", 92000.0, 118000.0)
    assert a["two_week"] == ("BIWEEK", 52000.0, 65000.0) and a["one_side"] == ("HOUR", None, 65520.0) and a["inverted"] == ("HOUR", 104000.0, 124800.0)
    assert a["nothing"] == (None, None, None) and a["placeholder"] == (None, None, None)
    assert len(a) == 12


def test_latest_load_counts_once(spark, rows):
    df = frame(spark, [("a", 50.0, None, "HOUR", None, T0), ("a", 50.0, None, "DAY", None, dt.datetime(2026, 9, 2)), ("a", 50.0, None, "DAY", None, dt.datetime(2026, 9, 2))])
    assert rows(U.pay_cases(df)) == [("a", "DAY")]


def test_empty_and_long_text(spark, rows):
    assert rows(U.pay_cases(frame(spark, []))) == []
    far = "word " * 50_000 + "Base pay $40 to $50/hr."
    assert rows(U.pay_cases(frame(spark, [("a", 40.0, 50.0, None, far, T0)]))) == [("a", "HOUR")]


def test_dictionary_beyond_the_broadcast_bound_joins_the_same(spark, rows):
    from quarrymill.operators.joins import lookup

    facts = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(300)], "i int, k string")
    entries = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    want = rows(lookup(facts, entries, "k"))
    assert want == rows(lookup(facts, entries, "k", salts=4, most=0)) == rows(lookup(facts, entries, "k", salts=1, most=0))


def test_counted_lookup_equals_plain_join(spark, rows, monkeypatch):
    from quarrymill.operators import joins

    facts = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(300)], "i int, k string")
    entries = spark.createDataFrame([("hot", 200, 1), *[(f"k{i}", 1, i) for i in range(0, 300, 6)]], "k string, n int, v int")
    want = rows(facts.join(entries.drop("n"), "k", "left"))
    assert rows(joins.lookup_counted(facts, entries, "k")) == want
    monkeypatch.setattr(joins, "within", lambda df: False)
    assert rows(joins.lookup_counted(facts, entries, "k", share=0.01)) == want
