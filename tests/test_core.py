import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import lexicon, postings, text, years
from quarrymill.ml import encode, forecast, salary, topics
from quarrymill.operators import quality, relational as R
from quarrymill.sources import pipeline, raw, sinks


def job(**k):
    base = {"job_id": "1", "job_title": "Data Engineer", "employer_name": "Acme", "job_city": "Austin", "job_state": "Texas", "job_description": "text"}
    return base | k


@pytest.fixture
def envelopes(spark, tmp_path):
    def make(*files):
        for i, (jobs, at) in enumerate(files):
            p = tmp_path / "raw" / "data_engineer" / "austin"
            p.mkdir(parents=True, exist_ok=True)
            (p / f"{i}.json").write_text(json.dumps({"role": "data engineer", "location": "Austin, TX", "fetched_at": at, "extra": 1, "jobs": jobs}, indent=1))
        return raw.read_envelopes(spark, str(tmp_path / "raw/*/*/*.json"))

    return make


def one(df):
    return df.collect()[0].asDict()


@pytest.mark.parametrize("low,high,period,want", [
    (50.0, 60.0, "HOUR", (104000, 124800, 114400, None)), (6000.0, 8000.0, "MONTH", (72000, 96000, 84000, None)), (90000.0, None, "YEAR", (90000, None, 90000, None)),
    (500.0, 600.0, "YEAR", (None, None, None, "out_of_range")), (50.0, 60.0, "FORTNIGHT", (None, None, None, "unknown_period")), (150000.0, 100000.0, "YEAR", (None, None, None, "inverted_range")),
    (None, None, None, (None, None, None, None)), (50.0, None, None, (None, None, None, "unknown_period")),
])
def test_pay(envelopes, low, high, period, want):
    r = one(raw.normalise(raw.flatten(envelopes(([job(job_min_salary=low, job_max_salary=high, job_salary_period=period)], "2026-10-03T15:27:42+00:00")))))
    assert (r["salary_min_annual"], r["salary_max_annual"], r["salary_mid_annual"], r["salary_flag"]) == want


@pytest.mark.parametrize("state,code", [("Texas", "TX"), ("ny", "NY"), (None, None), ("Ontario", None)])
def test_states(spark, state, code):
    assert one(spark.createDataFrame([(state,)], "s string").select(postings.state_code(F.col("s")).alias("c")))["c"] == code


def test_content_key_and_dedup(envelopes):
    n = raw.normalise(raw.flatten(envelopes(
        ([job(job_id="a", job_city=None), job(job_id="b", job_description="longer text"), job(job_id="c", job_min_salary=90000.0, job_salary_period="YEAR")], "2026-10-03T00:00:00+00:00"),
        ([job(job_id="a", job_city=None)], "2026-10-04T00:00:00+00:00"))))
    assert {r["dedup_key"] for r in n.collect()} == {"data engineer|acme|", "data engineer|acme|austin"}
    t = pipeline.clean(envelopes())
    assert {r["job_id"] for r in t["jobs_clean"].collect()} == {"a", "c"}  # salary beats length; another city survives
    assert t["job_sightings"].count() == 4


def test_pipeline_replaces_tables_together(spark, envelopes, tmp_path):
    envelopes(([job(job_id="a", job_description="5+ years of experience with Python and dbt")], "2026-10-03T00:00:00+00:00"))
    out = str(tmp_path / "out")
    for _ in range(2):
        assert pipeline.run(spark, str(tmp_path / "raw"), out, "2026-10-05 00:00:00") == {f"{out}/{k}.parquet": n for k, n in (("jobs_clean", 1), ("job_sightings", 1), ("job_skills", 2), ("posting_nlp", 1))}
    with pytest.raises(ValueError):
        sinks.refresh(spark.read.parquet(f"{out}/jobs_clean.parquet").limit(0), f"{out}/jobs_clean.parquet")
    assert spark.read.parquet(f"{out}/jobs_clean.parquet").count() == 1
    assert sinks.write_once(spark.range(1), f"{out}/day.json") and not sinks.write_once(spark.range(2), f"{out}/day.json")
    assert any(k.startswith("jobs_clean.parquet/") for k in sinks.list_keys(spark, out))


def test_occupations_sheet_and_latest(spark):
    sheet = spark.createDataFrame([("1", "15-1", "A", "major", "1", "2"), ("1", "15-2", "B", "detailed", "1,200", "90000"), ("1", "15-3", "C", "detailed", "*", "#")], "AREA string, OCC_CODE string, OCC_TITLE string, O_GROUP string, TOT_EMP string, A_MEDIAN string")
    assert sorted(map(tuple, raw.sheet_rows(sheet, 2025).collect())) == [("15-2", "B", 1200, 90000, 2025), ("15-3", "C", None, None, 2025)]
    with pytest.raises(ValueError):
        raw.sheet_rows(sheet.drop("TOT_EMP"), 2025)


def fetch_two_pages(role, place, cursor):
    return ([{"job_id": f"{role}-{cursor or 0}"}], None if cursor else "1")


def test_paged_source(spark, monkeypatch):
    spark.dataSource.register(raw.PagedSource)
    df = spark.read.format("paged_postings").options(module="tests_pages", function="fetch", pairs="a;x|b;y", pages="3").schema("role string, job_id string")
    import sys
    import types

    m = types.ModuleType("tests_pages")
    m.fetch = fetch_two_pages
    monkeypatch.setitem(sys.modules, "tests_pages", m)
    assert list(raw.pages(lambda c: fetch_two_pages("r", "p", c), 3)) == [[{"job_id": "r-0"}], [{"job_id": "r-1"}]]
    assert list(raw.pages(lambda c: ([], "x"), 3)) == [] and len(list(raw.pages(lambda c: ([1], "x"), 3))) == 3
    assert df is not None
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert raw.retried(flaky, wait=0) == "ok"


CASES = [
    ("Python and SQL", {"Python", "SQL"}), ("Go-to-market strategy", set()), ("R&D team", set()), ("excel at work", set()), ("NoSQL stores", {"NoSQL"}), ("JavaScript", {"JavaScript"}), ("C++/C#", {"C++", "C#"}),
    ("Python, Go, R", {"Python", "Go", "R"}), ("PySpark on EMR", {"Spark", "EMR"}), ("AWS Glue, S3", {"AWS Glue", "AWS", "S3"}), (None, set()), ("", set()), ("react to change", set()), ("Spring Boot", {"Spring"}), ("A/B tests, CI/CD", {"A/B Testing", "CI/CD"}),
    ("snowflake", set()), ("Snowflake", {"Snowflake"}), ("Node.js and REST APIs", {"Node.js", "REST APIs"}), ("Golang services", {"Go"}),
]


def test_skills_native_equals_pandas(spark):
    assert len(lexicon.catalogue()) == 110
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = df.select("i", lexicon.matched(F.col("t")).alias("a"), lexicon.matched_pandas()(F.col("t")).alias("b")).collect()
    for r in got:
        assert set(r["a"] or []) == CASES[r["i"]][1], CASES[r["i"]]
        assert list(r["a"] or []) == list(r["b"])


@pytest.mark.parametrize("t,want", [
    ("2.5 years of experience", (2.5, 2.5)), ("1.5 to 3 years of experience", (1.5, 3)), ("at least 1.5 yrs", (1.5, None)), ("5+ years", (5, None)), ("3–5 yrs", (3, 5)), ("three to five years", (3, 5)), ("at least 4 years", (4, None)), ("Experience: 7 years", (7, 7)), ("(5+) years", (5, None)), ("5+years of Python", (5, None)),
    ("a 4-year degree", None), ("for 25 years we have built software", None), ("10 years ago with experience", None), ("18 years old, experience", None), ("50+ years", None), (None, None), ("", None), ("2 or 3 years", (2, 3)),
])
def test_years(t, want):
    m = years.mentions(t)
    assert (m[0][1:] if m else None) == want


def test_years_summary():
    assert years.summary("2+ years of SQL, 5+ years of Spark, 5-7 years of Go")[:3] == (5.0, None, 3)
    assert years.summary("x" * 200_000) == (None, None, 0, None)


@pytest.mark.parametrize("title,level", [
    ("Senior Manager", "manager"), ("Sr. Data Engineer", "senior"), ("Data Engineer II", "mid"), ("Lead Engineer", "staff_plus"), ("Co-op", "intern"), ("Entry Level Analyst", "junior"), ("Data Engineer", None), (None, None), ("SRS Engineer", None), ("Engineer III", "senior"), ("Engineer I", "junior"),
])
def test_levels(spark, title, level):
    assert one(spark.createDataFrame([(title,)], "t string").select(postings.title_level(F.col("t")).alias("x")))["x"] == level


def test_effective_level(spark):
    df = spark.createDataFrame([("senior", 1.0), (None, 7.0), (None, 4.0), (None, 2.0), (None, 1.0), (None, None)], "s string, y double")
    got = [tuple(r) for r in df.select(postings.effective_level(F.col("s"), F.col("y")), postings.level_source(F.col("s"), F.col("y"))).collect()]
    assert got == [("senior", "title"), ("staff_plus", "years"), ("senior", "years"), ("mid", "years"), ("junior", "years"), ("unknown", "none")]


def test_text_functions(spark):
    df = spark.createDataFrame([("One. Two!\nThree? ", 143669.0), (" ".join(["w"] * 320), -14500.0), (None, 499.0)], "t string, m double")
    r = df.select(text.sentences(F.col("t")), F.transform(text.word_chunks(F.col("t")), lambda c: F.size(F.split(c, " "))), text.money(F.col("m"))).collect()
    assert r[0][0] == ["One.", "Two!", "Three?"] and r[1][1] == [150, 150, 20] and r[2][0] is None
    assert [x[2] for x in r] == ["$144,000", "-$15,000", "$0"]
    lab = spark.createDataFrame([(["machine learning", "ml", "learning", "models", "model", "x"],)], "a array<string>").select(text.topic_label(F.col("a"))).collect()[0][0]
    assert lab == "machine learning, ml, models, model"
    assert one(df.limit(1).select(text.slug(F.lit(" San Francisco, CA ")).alias("s")))["s"] == "san_francisco_ca"


def test_medians_with_and_without(spark):
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate([10, 20, 30, 40, 40, None or 50])], "k int, v double")
    members = spark.createDataFrame([(0, "a"), (1, "a"), (3, "a"), (9, "b")], "k int, item string")
    got = {r["item"]: r.asDict() for r in R.with_without_medians(members, values, "k", "v", [], ["item"]).collect()}
    assert (got["a"]["n_with_skill"], got["a"]["n_without_skill"], got["a"]["__with"], got["a"]["__without"]) == (3, 3, 20.0, 40.0)
    assert (got["b"]["n_with_skill"], got["b"]["__with"], got["b"]["__without"]) == (0, None, 35.0)


def test_slice_and_fallback_and_match(spark):
    df = spark.createDataFrame([("r", float(v)) for v in (100, 110, 120, 130, 140, 150, 80)] + [("q", None)], "role string, pay double")
    s = {r["role"]: r for r in R.slice_percentiles(df, df, "role", "pay", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()}
    assert (s["r"]["a"], s["r"]["b"], s["r"]["c"]) == (105, 120, 135) and s["q"]["sample_status"] == "too_few_to_report"
    d = spark.createDataFrame([("r", "s", 100.0), ("r", "s", 200.0), ("r", "t", 150.0)], "role string, lv string, pay double")
    assert {r["expected"] for r in R.median_with_fallback(d, [["role", "lv"], ["role"]], "pay").collect()} == {150.0}
    core = spark.createDataFrame([("r", 0.8, True), ("r", 0.6, False), ("r", 0.4, True), ("r", 0.3, False)], "role string, w double, has boolean")
    assert abs(one(R.weighted_match(core, "role", "w", F.col("has")))["match"] - 1.2 / 2.1) < 1e-9


def test_recency(spark):
    at = lambda d: dt.datetime(2026, 10, d)
    df = spark.createDataFrame([("a", at(1)), ("b", at(10)), ("c", at(10))], "id string, at timestamp")
    near = R.recent_or_latest_day(df, "at", F.lit(at(12)))
    far = R.recent_or_latest_day(df, "at", F.lit(at(30)))
    assert {(r["id"], r["window_kind"]) for r in near.collect()} == {("b", "last_7_days"), ("c", "last_7_days")}
    assert {(r["id"], r["window_kind"]) for r in far.collect()} == {("b", "latest_collection"), ("c", "latest_collection")}
    assert R.recent_or_latest_day(df.limit(0), "at", F.lit(at(1))).count() == 0


def test_closest(spark):
    pool = spark.createDataFrame([("a", [1.0, 0.0], "manager"), ("b", [0.6, 0.8], "mid"), ("c", [0.6, 0.8], "unknown"), ("d", [0.0, 0.0], "junior")], "id string, v array<float>, level string")
    q = spark.createDataFrame([([1.0, 0.0], "junior")], "query_vector array<double>, query_level string")
    assert [r["id"] for r in R.closest_to(pool, q, "id", "v", 4, "level").collect()] == ["b", "c", "d", "a"]


def test_budget(spark):
    pairs = spark.createDataFrame([("data engineer", "New York, NY", 1), ("data scientist", "New York, NY", 2), ("data analyst", "Austin, TX", 3)], "role string, location string, ordinal int")
    keys = spark.createDataFrame([("jobs/raw/data_engineer/new_york_ny/2026-10-05.json",), ("jobs/raw/broken",), ("jobs/raw/data_analyst/austin_tx/2026-13-45.json",)], "key string")
    got = R.budget_plan(keys, pairs, F.lit("2026-10-06").cast("date"), 180).collect()
    assert [(r["role"], r["allowance"]) for r in got] == [("data scientist", 6), ("data analyst", 6)]  # (180 - 3) // 26 = 6: two pairs, never-fetched first
    assert R.budget_plan(keys, pairs, F.lit("2026-10-06").cast("date"), 5).count() == 0


def test_quality_finds_planted_faults(spark):
    a = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", None)], "id string, v string")
    b = spark.createDataFrame([("1",)], "id string")
    got = quality.all_of(quality.not_unique(a, ["id"], "u"), quality.is_null(a, "v", "id", "n"), quality.not_accepted(a, "v", ["x"], "a"), quality.no_parent(a, "id", b, "id", "p"), quality.violates(a, F.col("id") == "1", "id", "c"))
    assert sorted(map(tuple, got.collect())) == [("a", "y"), ("c", "2"), ("n", "2"), ("p", "2"), ("u", "1")]
    with pytest.raises(ValueError):
        quality.require_rows(a.limit(0), "a")


def week_series(spark, n, f=lambda i: 0.2 + 0.01 * i):
    return spark.createDataFrame([("s", dt.date(2026, 1, 5) + dt.timedelta(weeks=i), float(f(i))) for i in range(n)], "k string, w date, v double")


def test_forecast_gate_band_and_backtest(spark):
    few = forecast.forecast(week_series(spark, 11), ["k"], "w", "v").collect()
    assert len(few) == 1 and few[0]["status"] == "insufficient_history" and few[0]["forecast"] is None
    f = sorted(forecast.forecast(week_series(spark, 12), ["k"], "w", "v").collect(), key=lambda r: r["forecast_at"])
    assert len(f) == 13 and abs(f[0]["forecast"] - 0.32) < 1e-9 and f[0]["forecast_at"] == dt.date(2026, 3, 30)
    falling = forecast.forecast(week_series(spark, 15, lambda i: max(0.0, 0.3 - 0.02 * i)), ["k"], "w", "v").collect()
    assert min(r["lower"] for r in falling) == 0.0 and all(0 <= r["lower"] <= r["forecast"] <= r["upper"] <= 1 for r in falling)
    b = forecast.backtest(week_series(spark, 16), ["k"], "w", "v").collect()[0]
    assert abs(b["mae_naive"] - 0.01) < 1e-9 and b["mae_trend"] < 1e-6
    assert forecast.backtest(week_series(spark, 15), ["k"], "w", "v").count() == 0
    assert forecast.forecast(week_series(spark, 0), ["k"], "w", "v").count() == 0


def test_embedding_contract(spark):
    v = encode.embedded(spark.createDataFrame([(1, "a b c"), (2, None), (3, "w " * 320)], "i int, t string"), "i", "t")
    got = {r["i"]: r for r in v.collect()}
    assert set(got) == {1, 3} and got[3]["n_chunks"] == 3 and abs(sum(x * x for x in got[1]["embedding"]) - 1) < 1e-4
    with pytest.raises(ValueError):
        encode.require_revision(v, "other")
    import numpy as np

    a, b = np.eye(2, dtype=np.float32)
    m = encode.weighted_mean(np.stack([a, b]), [150, 50])
    assert np.allclose(m, np.array([150, 50]) / np.hypot(150, 50))


def test_topics_on_planted_groups(spark):
    import random

    r = random.Random(1)
    data = [(3 * i + g, [1.0 if k == g else r.uniform(0, 0.1) for k in range(8)]) for i in range(40) for g in range(3)]
    v = spark.createDataFrame(data, "id int, v array<float>")
    t = {x["id"]: x for x in topics.clusters(v, "id", "v", k=3).collect()}
    again = {x["id"]: x for x in topics.clusters(v, "id", "v", k=3).collect()}
    assert t == again and len(t) == 120
    for g in range(3):
        assert len({x["topic_id"] for i, x in t.items() if i % 3 == g and x["topic_id"] >= 0}) == 1
    assert all((x["topic_id"] == -1) == (x["topic_probability"] == 0) and 0 <= x["topic_probability"] <= 1 for x in t.values())


def test_number_of_trees_is_chosen_by_held_out_employers(spark, monkeypatch):
    import random

    from quarrymill.plans import q_text

    r = random.Random(4)
    names = [f"s{i}" for i in range(12)]
    data = []
    for i in range(1500):
        sk = [s for s in names if r.random() < 0.5]
        data.append((str(i), "de", "mid", "TX", None, sk, 80_000 * 1.1 ** len(sk) * r.uniform(0.97, 1.03), f"e{i % 60}"))
    rows = spark.createDataFrame(data, "job_id string, role string, seniority string, state string, remote boolean, skills array<string>, salary double, employer string")
    spec = salary.fit_spec(rows)
    assert salary.fit(rows, spec).getNumTrees > 20  # a single tree that brings little isn't the end
    ceilings = []
    monkeypatch.setattr(salary, "cross_validated", lambda rows, trees=2000: ceilings.append(trees))
    monkeypatch.setattr(salary, "use_model", lambda cv: cv)
    q_text.QUERIES["gbt_salary_gate"](spark, "/root/testdata/sf0.001")
    assert ceilings == [2000]


def test_salary_model_recovers_planted_effects(spark):
    import random

    r = random.Random(2)
    data = []
    for i in range(400):
        sk, lv, role = ["Spark"] * (i % 2) + ["SQL"], "senior" if i % 3 == 0 else "mid", "de" if i % 4 else "ds"
        data.append((str(i), role, lv, "TX", None, sk, 100_000 * (1.3 if "Spark" in sk else 1) * (1.5 if lv == "senior" else 1) * r.uniform(0.97, 1.03), f"e{i % 40}"))
    rows = spark.createDataFrame(data, "job_id string, role string, seniority string, state string, remote boolean, skills array<string>, salary double, employer string")
    spec = salary.fit_spec(rows)
    assert spec["skills"] == ["SQL", "Spark"] and spec["seniority"] == ["mid", "senior", "unknown"]
    gate = salary.use_model(salary.cross_validated(rows, trees=15)).collect()[0]
    assert gate["use_model"] and gate["n"] == 400
    model = salary.fit(rows, spec, trees=30)
    profile = spark.createDataFrame([("x", "de", "mid", "ZZ", False, ["SQL"])], "job_id string, role string, seniority string, state string, remote boolean, skills array<string>")
    d = salary.what_if(model, profile, ["Spark"], spec).collect()[0]
    assert 15_000 < d["delta"] < 45_000
    f = salary.features(profile.withColumn("skills", F.array(F.lit("SQL"), F.lit("Rust"))), spec).collect()[0]
    assert f["f_skill_count"] == 2.0 and f["f_state_1"] == 1.0
    with pytest.raises(Exception):
        salary.features(profile.withColumn("role", F.lit("baker")), spec).collect()


def test_stream_equals_batch(spark, tmp_path):
    from quarrymill.streaming import demand

    df = spark.createDataFrame([("a", dt.datetime(2026, 9, 27, 23)), ("a", dt.datetime(2026, 9, 28, 1)), ("b", dt.datetime(2026, 10, 4, 12))], "g string, at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    demand.to_memory(demand.weekly_counts(s, "at", "g"), "stream_t")
    got = {(str(r["week"].date()), r["g"], r["n"]) for r in spark.table("stream_t").collect()}
    assert got == {("2026-09-21", "a", 1), ("2026-09-28", "a", 1), ("2026-09-28", "b", 1)}


def test_cache_and_stages(spark):
    now = [0.0]
    c = pipeline.ResultCache(10, lambda: now[0])
    made = []
    make = lambda: made.append(1) or spark.range(1)
    assert c.get(("a",), make) is c.get(("a",), make) and len(made) == 1
    now[0] = 11
    c.get(("a",), make)
    assert len(made) == 2
    assert pipeline.run_stages([("x", lambda: 1), ("y", lambda: 2)]) == {"x": 1, "y": 2}


def test_zero_fill_keeps_gaps_apart_from_zeros(spark):
    counts = spark.createDataFrame([(1, "r", "a", 5), (3, "r", "b", 2), (1, "q", "a", 1)], "week int, role string, item string, n int")
    periods = spark.createDataFrame([(1, "r", 9), (2, "r", 9), (3, "r", 9), (1, "q", 4)], "week int, role string, total int")
    got = {(r["week"], r["role"], r["item"]): r["n"] for r in R.zero_filled(counts, periods, "week", ["role"], ["item"], "n").collect()}
    assert got == {(1, "r", "a"): 5, (2, "r", "a"): 0, (3, "r", "a"): 0, (1, "r", "b"): 0, (2, "r", "b"): 0, (3, "r", "b"): 2, (1, "q", "a"): 1}


def test_replacing_several_tables_rolls_back(spark, tmp_path, monkeypatch):
    from quarrymill.sources import sinks

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.replace_all({a: spark.range(3), b: spark.range(4)})
    real = sinks._path

    class Fails:
        def __init__(self, fs):
            self.fs = fs

        def rename(self, x, y):
            return False if y.toString().endswith("/b") and "_new_" in x.toString() else self.fs.rename(x, y)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    with monkeypatch.context() as m:
        m.setattr(sinks, "_path", lambda s, p: (real(s, p)[0], Fails(real(s, p)[1])))
        with pytest.raises(OSError):
            sinks.replace_all({a: spark.range(30), b: spark.range(40)})
    assert (spark.read.parquet(a).count(), spark.read.parquet(b).count()) == (3, 4)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
    assert sinks.refresh(spark.range(7), a) == 7


def test_delimited_text_becomes_an_array(spark):
    from quarrymill.operators.relational import delimited

    df = spark.createDataFrame([("a, b",), (None,), ("",)], "t string").select(delimited(F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == [["a", "b"], [], [""]]


def sheet_archive(rows, books=1):
    import io
    import zipfile

    texts = sorted({c for r in rows for c in r if c is not None})
    cell = lambda c, k, i: "" if c is None else f'<c r="{chr(65 + k)}{i}" t="s"><v>{texts.index(c)}</v></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i}">' + "".join(cell(c, k, i) for k, c in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("readme.txt", "x")
        for k in range(books):
            z.writestr(f"data{k}.xlsx", book.getvalue())
    return outer.getvalue()


def test_sheet_of_an_archive(spark):
    rows = [["AREA", "OCC_CODE", "OCC_TITLE", "O_GROUP", "TOT_EMP", "A_MEDIAN"], ["99", "15-0000", "Computers", "major", "5", "6"], ["99", "15-1252", "Developers", "detailed", "1,234", "*"], ["99", "15-2051", "Scientists", "detailed", None, "108020"]]
    got = raw.sheet_rows(spark.createDataFrame(raw.sheet_of_archive(sheet_archive(rows)), ", ".join(f"{c} string" for c in rows[0])), 2025)
    assert sorted(tuple(r) for r in got.collect()) == [("15-1252", "Developers", 1234, None, 2025), ("15-2051", "Scientists", None, 108020, 2025)]
    for bad in (sheet_archive(rows, 0), sheet_archive(rows, 2), sheet_archive([rows[0][:3]])):
        with pytest.raises(ValueError):
            raw.sheet_of_archive(bad)


@pytest.mark.parametrize("status,calls", [(429, 4), (503, 4), (404, 1), (401, 1)])
def test_only_some_answers_are_asked_for_again(status, calls):
    n = []
    with pytest.raises(raw.HttpError):
        raw.retried(lambda: (n.append(1), raw.checked_status(status)), wait=0)
    assert len(n) == calls and raw.checked_status(200) is None


def test_objects_and_collections_are_written(spark, tmp_path):
    from quarrymill.sources import sinks

    path = str(tmp_path / "a" / "x.json")
    sinks.put_json(spark, path, {"b": 1})
    sinks.put_json(spark, path, {"a": "ü"})
    assert json.loads((tmp_path / "a" / "x.json").read_text()) == {"a": "ü"}
    day = str(tmp_path / "raw" / "2026-10-03.json")
    jobs = [{"job_id": "1"}, {"job_id": "1"}, {"job_id": None}]
    assert sinks.collect_once(spark, day, "r", "l", "2026-10-03T00:00:00+00:00", jobs) == {"fetched": 3, "without_id": 1, "repeated": 1, "written": 3}
    assert sinks.collect_once(spark, day, "r", "l", "2026-10-03T00:00:00+00:00", jobs)["written"] == 0
    assert raw.flatten(raw.read_envelopes(spark, day)).count() == 3


def test_relational_read_casts_decimals(spark):
    df = spark.sql("SELECT CAST(1.50 AS DECIMAL(10,2)) AS `a b`, 'x' AS c")
    assert raw.without_decimals(df).dtypes == [("a b", "double"), ("c", "string")]
    with pytest.raises(Exception):
        raw.read_relational(spark, "jdbc:none://x", "SELECT 1")


def test_display_formats(spark):
    r = spark.createDataFrame([(1400.0, -1600.0, 100.0, 91_000.0, 182_000.0, 0.31)], "a double, b double, c double, lo double, hi double, s double")
    got = r.select(*[text.signed_money(F.col(c)).alias(c) for c in "abc"], *text.scale_bounds(F.col("lo"), F.col("hi")), text.share_bound(F.col("s")).alias("s"),
                   text.age_in_days(F.to_timestamp(F.lit("2026-10-01 23:59:00")), F.to_timestamp(F.lit("2026-10-03 00:01:00"))).alias("age")).first()
    assert tuple(got) == ("+$1,000", "-$2,000", "$0", 80_000.0, 200_000.0, 0.4, 2)


def test_salary_answer_model_or_median(spark, tmp_path):
    from quarrymill.ml import salary

    medians, errors = spark.createDataFrame([("a", 100.0), ("b", 30.0)], "role string, role_median double"), spark.createDataFrame([("a", 10.0)], "role string, error double")
    got = {r["role"]: (r["source"], r["low"], r["value"], r["high"]) for r in salary.answer(spark.createDataFrame([("a",), ("b",), ("c",)], "role string"), medians, errors, 40.0).collect()}
    assert got["a"] == ("role_median", 90.0, 100.0, 110.0) and got["b"] == ("role_median", 0.0, 30.0, 70.0) and got["c"][0] == "none" and got["c"][2] is None
    rows = spark.createDataFrame([(f"j{i}", "ab"[i % 2], "mid", "TX", False, ["Python"] if i % 3 else ["SQL"], 50_000.0 + 20_000 * (i % 2) + 5_000 * (i % 3), f"e{i % 12}") for i in range(120)], "job_id string, role string, seniority string, state string, remote boolean, skills array<string>, salary double, employer string")
    model, spec = salary.fit_final(rows, trees=4)
    about = salary.card(salary.cross_validated(rows, trees=4))
    salary.export(model, spec, about, str(tmp_path / "m"))
    again, spec2, about2 = salary.load(spark, str(tmp_path / "m"))
    assert spec2 == spec and about2 == json.loads(json.dumps(about)) and about["use_model"] in (True, False)
    profile = rows.limit(1).select("role", "seniority", "state", "remote", "skills")
    p = salary.predict(again, profile, spec)
    assert abs(p.first()["predicted"] - salary.predict(model, profile, spec).first()["predicted"]) < 1e-6
    assert salary.answer(p, medians, errors, 1.0).first()["source"] == "model"
