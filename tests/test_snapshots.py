import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import snapshots as S

SCHEMA = "k string, at timestamp, name string, pay double, remote boolean, hash string, delivery string"
COLS = ["name", "pay", "remote"]


def t(day, hour=12):
    return dt.datetime(2026, 8, day, hour)


def run(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return S.changes_by_index(df, "k", "at", COLS)


def test_added_removed_changed_and_what_does_not_count(spark, rows):
    got = run(spark, [
        ("a", t(1), "Board", 1.0, True, "x", "y"), ("b", t(1), "Board", None, None, None, None), ("c", t(1), "Board", 2.0, False, None, None), ("e", t(1), " ", 0.0, None, None, None),
        ("a", t(8), " board ", 1.0, True, None, None),  # case and spaces don't count
        ("c", t(8), "Board", None, False, None, None),  # a value becomes null
        ("d", t(8), None, None, None, None, None),
        ("e", t(8), None, -0.0, None, None, None),  # blank equals null, -0.0 equals 0.0
        ("b", t(15), "Board", None, None, None, None), ("a", t(15), "B oard", 1.0, True, None, None),
    ])
    assert rows(got) == sorted([
        ("2026-08-08", "b", "removed"), ("2026-08-08", "c", "changed"), ("2026-08-08", "d", "added"),
        ("2026-08-15", "b", "added"), ("2026-08-15", "a", "changed"), ("2026-08-15", "c", "removed"), ("2026-08-15", "d", "removed"), ("2026-08-15", "e", "removed"),
    ], key=repr)


def test_latest_row_of_a_delivery_holds_and_repeats_do_not_matter(spark, rows):
    new = ("a", t(8, 15), "New", 1.0, None, None, None)
    got = run(spark, [("a", t(1), "New", 1.0, None, None, None), ("a", t(8, 9), "Old", 1.0, None, None, None), new, new])
    assert rows(got) == []


def test_nulls_empty_and_single_delivery(spark, rows):
    assert rows(run(spark, [])) == []
    assert rows(run(spark, [(None, t(1), "x", None, None, None, None), ("a", None, "x", None, None, None, None), ("b", t(1), None, None, None, None, None)])) == []


def test_null_in_another_column_is_another_content(spark, rows):
    got = run(spark, [("a", t(1), "x", None, True, None, None), ("a", t(8), None, None, True, None, None)])
    assert rows(got) == [("2026-08-08", "a", "changed")]


def frame(spark, d):
    return spark.createDataFrame(d, "key string, hash long")


def test_index_store_swaps_and_fetches_only_changes(spark, rows, tmp_path):
    store = S.SnapshotIndex(spark, str(tmp_path / "index"), buckets=4)
    assert rows(store.advance(frame(spark, [("a", 1), ("b", 2)]))) == []
    changes = store.advance(frame(spark, [("a", 1), ("b", 3), ("c", 4)]))
    assert rows(changes) == [("b", "changed"), ("c", "added")]
    assert rows(store.advance(frame(spark, [("c", 4)]))) == [("a", "removed"), ("b", "removed")]
    assert rows(store.current()) == [("c", 4)]
    old = spark.createDataFrame([("a", 10), ("b", 20)], "dedup_key string, v int")
    assert rows(S.fetch_values(changes, old, "dedup_key")) == [("b", 20)]
    assert sum(p.name.startswith("generation_") for p in (tmp_path / "index").iterdir()) == 2
    store.drop()
    assert not (tmp_path / "index").exists()


@pytest.mark.parametrize("step", ["generation", "_changes", "_swap", "_clean"])
def test_a_run_that_dies_between_steps_loses_no_change(spark, rows, tmp_path, monkeypatch, step):
    path = str(tmp_path / "index")
    S.SnapshotIndex(spark, path, buckets=2).advance(frame(spark, [("a", 1), ("b", 2)]), "1")

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(S.SnapshotIndex, step, dies)
        with pytest.raises(KeyboardInterrupt):
            S.SnapshotIndex(spark, path, buckets=2).advance(frame(spark, [("a", 5), ("c", 3)]), "2")
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("generation_")]:
        spark.sql(f"DROP TABLE `{name}`")  # as for a session of its own
    again = S.SnapshotIndex(spark, path, buckets=2)
    assert rows(again.advance(frame(spark, [("a", 5), ("c", 3)]), "2")) == [("a", "changed"), ("b", "removed"), ("c", "added")]
    assert rows(again.advance(frame(spark, [("a", 5)]), "3")) == [("c", "removed")]
    again.drop()


def test_probe_of_generations_exchanges_nothing(spark, tmp_path):
    store = S.SnapshotIndex(spark, str(tmp_path / "index"), buckets=4)
    for k in range(2):
        store.advance(frame(spark, [(str(i), i * k) for i in range(100)]), str(k))
    now = store.in_force()
    plan = S.probe(store.generation(now["before"], now), store.generation(now["generation"], now))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    store.drop()


def test_changed_values_are_fetched_for_changed_columns(spark, rows):
    df = spark.createDataFrame([
        ("a", t(1), "Board", 1.0, True, "x", "y"), ("b", t(1), "Board", 12345678.5, None, "x", "y"), ("c", t(1), "Board", None, None, "x", "y"),
        ("a", t(8), "board ", 2.0, None, "x", "y"), ("b", t(8), "Other", 12345678.5, None, "x", "y"), ("c", t(8), "Board", None, None, "x", "y"),
    ], SCHEMA)
    assert rows(S.changed_values(df, "k", "at", COLS)) == [
        ("2026-08-08", "a", "pay", "1.00", "2.00"), ("2026-08-08", "a", "remote", "true", None), ("2026-08-08", "b", "name", "board", "other")]
    assert rows(S.changed_values(df.limit(0), "k", "at", COLS)) == []


def test_against_brute_force(spark, rows):
    import random

    r = random.Random(3)
    data = [(f"k{r.randrange(30)}", t(1 + 7 * r.randrange(4), r.randrange(24)), r.choice(["x", " X", "y", None, ""]), r.choice([None, 1.0, 2.0]), r.choice([None, True]), None, None) for _ in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    got = rows(S.hashed(df, "k", "at", COLS))
    h = {(d, k): v for d, k, _, v in sorted(got, key=lambda r: (r[2], r[3]))}
    days, want = sorted({d for d, _ in h}), set()
    for p, d in zip(days, days[1:]):
        for k in {k for _, k in h}:
            a, b = h.get((p, k)), h.get((d, k))
            if a != b:
                want.add((str(d), k, "added" if a is None else "removed" if b is None else "changed"))
    assert set(rows(S.changes_by_index(df, "k", "at", COLS))) == want


def test_index_plan_has_one_exchange_by_key_after_combining(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("k"), F.current_timestamp().alias("at"), F.lit("x").alias("name"), F.lit(1.0).alias("pay"), F.lit(True).alias("remote"))
    plan = S.latest(S.hashed(df, "k", "at", COLS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
