import datetime as dt
import math
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.llm import canonical, cooccurrence, leaks, mixing, names, neighbours, percentiles, stuffing

T0 = dt.datetime(2026, 9, 1)


# 1 percentiles


def test_percentiles_within_error_and_merge(spark):
    r = random.Random(1)
    data = [("a" if i % 3 else "b", i % 4, r.choice([-1, 1]) * math.exp(r.uniform(-8, 14))) for i in range(4000)] + [("a", 0, 0.0)] * 50 + [("a", 1, 5.0)] * 500
    df = spark.createDataFrame(data, "g string, day int, v double")
    points = {"lo": 0.0, "q1": 0.25, "med": 0.5, "hi": 0.99, "max": 1.0}
    whole = percentiles.percentiles(percentiles.sketch(df, "v", ["g"], 0.01), ["g"], points, 0.01).collect()
    daily = percentiles.merge(percentiles.sketch(df, "v", ["g", "day"], 0.01), ["g"])
    assert {tuple(x) for x in percentiles.percentiles(daily, ["g"], points, 0.01).collect()} == {tuple(x) for x in whole}
    for row in whole:
        v = sorted(x[2] for x in data if x[0] == row["g"])
        assert row["n"] == len(v)
        for k, p in points.items():
            true = v[math.floor(p * (len(v) - 1))]
            assert abs(row[k] - true) <= 0.01 * abs(true) + 1e-9, (k, row[k], true)


def test_percentiles_of_nothing_nulls_and_odd_values(spark):
    df = spark.createDataFrame([(None, 1.0, 3), ("a", None, 3), ("a", float("nan"), 3), ("a", float("inf"), 3), ("b", 1e-12, 3), ("b", -1e300, 3)], "g string, v double, bucket int")
    got = {r["g"]: r for r in percentiles.percentiles(percentiles.sketch(df, "v", ["g"]), ["g"], {"m": 0.0, "x": 1.0}).collect()}
    assert set(got) == {None, "b"} and got["b"]["x"] == 0.0 and abs(got["b"]["m"] / -1e300 - 1) < 0.01 and got[None]["n"] == 1
    assert percentiles.percentiles(percentiles.sketch(df.limit(0), "v", ["g"]), ["g"], {"m": 0.5}).count() == 0
    with pytest.raises(ValueError):
        percentiles.growth(1.5)


# 2 names


@pytest.mark.parametrize("a,b,same", [
    ("Hekkusmil Kexnuk, Theodore - Software", "THEODORE HEKKUSMIL KEXUK SW", True), ("Robotics, Katsuggov Nepliv", "Katsuggov Nepliv Robotics Inc", True), ("hekfopsapkomhol.example", "Hekfopsap Komhol Labs", True),
    ("Mike Dogmilrel Maknim International", "Michael Dogmilrel Maknim Intl Ltd.", True), ("Lónkéxgíb & Garleb Insurance Inc", "Lonkexgib and Garleb Ins.", True), ("Berkatnim DI", "Michael Berkatnim Dikmeg International", True),
    ("Hekhekpev", "Hekhekpev Kipbob Systems Ltd.", True), ("Holhurrag Megkip Engineering, Inc. / Philadelphia office", "HOLHURRAG MEKGIP ENGRG", True), ("Rodrubpev-Lebnax Univ", "University of Rodrubpev Lebnax", True),
    ("Gibdikpin Valley Hospital", "Gibdikpin Fanmeg Data Solutions", False), ("Higbaldul Credit Union", "Higbaldul & Lebsok Laboratories", False), ("Puxgedfop GA", "Puxgedfop Nimlut Media", False),
    ("Dampinliv Holnuk Robotics", "Katsuggov Nepliv Robotics", False), ("Michael Berkatnim Dikmeg", "William Berkatnim Dikmeg", False),
])
def test_names_that_agree_or_contradict(a, b, same):
    x, y = names.form_of(a), names.form_of(b)
    assert names.agree(x, y) == same and names.agree(y, x) == same


def test_cosines_equal_brute_force_also_over_blocks(spark, monkeypatch):
    r = random.Random(4)
    forms = sorted({" ".join(sorted("".join(r.choice("abcde") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(1, 4)))) for _ in range(60)})
    df = spark.createDataFrame([(f, i) for i, f in enumerate(forms)], "form string, id long")
    sets = [set(names.grams_of(f)) for f in forms]
    n = {g: sum(g in s for s in sets) for s in sets for g in s}
    idf = {g: math.log(1 + len(forms) / c) for g, c in n.items()}
    norm = [math.sqrt(sum(idf[g] ** 2 for g in s)) for s in sets]
    want = {(i, j): c for i in range(len(forms)) for j in range(i + 1, len(forms)) if (c := sum(idf[g] ** 2 for g in sets[i] & sets[j]) / norm[i] / norm[j]) >= 0.15}
    for block in (4000, 7):
        monkeypatch.setattr(names, "BLOCK", block)
        got = {(x, y): c for x, y, c in names.similar_forms(df).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_products_of_names_are_not_exchanged(spark):
    forms = [f"{a}{b} robotics" for a in ("kat", "bob", "mil", "pev", "rub", "sok", "dul", "hek", "gar", "nim") for b in ("lon", "bid", "fop", "gun", "hur", "kex", "lad", "mor", "nax", "pot")]
    similar = names.similar_forms(spark.createDataFrame(list(enumerate(forms)), "id long, form string"))
    assert len(similar.collect()) == 900

    def exchanged(node):
        n = node.metrics().get("shuffleRecordsWritten").get().value() if node.nodeName() == "Exchange" else 0
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        children = node.children()
        return n + sum(map(exchanged, inner + [children.apply(i) for i in range(children.size())]))

    # each form once a block, here one; 6,350 rows when products were summed across tasks
    assert len(forms) <= exchanged(similar._jdf.queryExecution().executedPlan()) <= 2 * len(forms)


def test_names_are_compared_in_one_order(spark, monkeypatch):
    monkeypatch.setattr(names, "agree", lambda x, y: x < y)
    df = spark.createDataFrame([(3, "katmil"), (2, "katmil lonbid"), (1, "katmil lonbid nax")], "id long, form string")
    assert names.agreeing(df).count() == names.similar_forms(df).count() == 3


def test_filter_by_letters_loses_no_names_that_agree():
    r = random.Random(6)
    parts = ["kat", "bob", "mil", "pev", "rub", "so", "a", "robotics", "rbtcs", "data", "ds", "us", "7"]
    forms = sorted({" ".join(sorted("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(r.choice([1, 1, 2, 2, 3, 4, 9])))) for _ in range(150)})
    forms = sorted({*forms, *["".join(c for c in f if r.random() < 0.9 or c == " ").strip() or f for f in forms], *[f.replace(" ", "") for f in forms]})
    forms = [" ".join(f.split()) for f in forms]
    block = names.Block(range(len(forms)), forms, dict.fromkeys({g for f in forms for g in names.grams_of(f)}, 1.0))
    i, j = map(np.array, zip(*combinations(range(len(forms)), 2)))
    could = names.could_agree(block, i, block, j)
    agree = np.array([names.agree(forms[a], forms[b]) for a, b in zip(i, j)])
    assert agree.any() and not (agree & ~could).any() and could.mean() < 0.9
    assert not names.could_agree(block, i[:0], block, j[:0]).any()


def test_name_pairs(spark, rows):
    data = ["Acmelor Bintok Media", "ACMELOR BINTOK MEDIA", "Acmelor  Bintok Media", "Acmelor Bintko Med. Ltd", "Acmelor Credit Union", "Other Firmname", None, "", "  ", "Confidential", "N/A", "x" * 4000, "!!!", "Acmelor Bintok Media"]
    df = spark.createDataFrame([(n, "x") for n in data], "employer string, name string")
    group = sorted({"Acmelor Bintok Media", "ACMELOR BINTOK MEDIA", "Acmelor  Bintok Media", "Acmelor Bintko Med. Ltd"})
    assert rows(names.same_pairs(df)) == sorted(((a, b) for i, a in enumerate(group) for b in group[i + 1 :]), key=repr)
    assert rows(names.same_pairs(df.limit(0))) == []


@pytest.mark.parametrize("part", [200_000, 3])
def test_average_linkage_equals_one_merge_at_a_time(spark, monkeypatch, part):
    monkeypatch.setattr(names, "PART", part)
    r = random.Random(5)
    nodes = [f"n{i:02d}" for i in range(24)]
    sims = {(a, b): r.random() for i, a in enumerate(nodes) for b in nodes[i + 1 :] if r.random() < 0.35}
    label = {n: frozenset([n]) for n in nodes}
    while True:
        groups, best = sorted(set(label.values()), key=sorted), (0.3, None)
        for i, x in enumerate(groups):
            for y in groups[i + 1 :]:
                s = sum(sims.get((a, b), sims.get((b, a), 0)) for a in x for b in y) / (len(x) * len(y))
                if s >= best[0]:
                    best = (s, (x, y))
        if not best[1]:
            break
        x = best[1][0] | best[1][1]
        label |= dict.fromkeys(x, x)
    df = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a string, b string, sim double")
    got = {}
    for n, lab in names.average_linkage(df, 0.3).collect():
        got.setdefault(lab, set()).add(n)
    assert {frozenset(v) for v in got.values() if len(v) > 1} == {v for v in label.values() if len(v) > 1}


def test_components(spark, rows):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)] + [("x", "y"), ("y", "z")]
    assert rows(names.components(spark.createDataFrame(chain, "a string, b string"))) == sorted([(f"n{i:02d}", "n00") for i in range(13)] + [(c, "x") for c in "xyz"])
    assert rows(names.components(spark.createDataFrame([], "a string, b string"))) == []


def test_names_of_other_organisations_that_share_words_stay_apart(spark, rows):
    data = ["Gibdikpin Valley Hospital", "GIBDIKPIN VALLEY HOSP.", "Gibdikpin Fanmeg Data Solutions", "Gibdikpin Fanmeg Data Sol. LLC", "Lonlebgov Valley Hospital", "Lonelbgov Valley Hospital", "University of Sartik Monbel", "University of Hargun Veltor"]
    want = [("GIBDIKPIN VALLEY HOSP.", "Gibdikpin Valley Hospital"), ("Gibdikpin Fanmeg Data Sol. LLC", "Gibdikpin Fanmeg Data Solutions"), ("Lonelbgov Valley Hospital", "Lonlebgov Valley Hospital")]
    assert rows(names.same_pairs(spark.createDataFrame([(n,) for n in data], "employer string"))) == want


# 3 neighbours


def vectors(seed=0, n=400, size=32):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 4, size))
    x = np.concatenate([c + 0.25 * r.standard_normal((4, size)) for c in centres])
    return x * r.uniform(0.1, 5, (len(x), 1))


def brute(ids, x, k=5, least=0.8):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, out = np.round(x @ x.T, 9), set()
    for i in range(len(x)):
        c = sorted((-s[i, j], ids[j]) for j in range(len(x)) if ids[j] != ids[i] and s[i, j] >= least)
        out |= {tuple(sorted((ids[i], b))) for _, b in c[:k]}
    return out


def test_neighbours_against_brute_force(spark, rows):
    x = vectors().astype(np.float32)
    ids = [f"j{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "job_id string, embedding array<float>, cls int")
    got, want = set(rows(neighbours.similar_pairs(df, size=32))), brute(ids, x.astype(float))
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.98 * len(got)


def test_neighbours_copies_bad_vectors_and_repeats(spark, rows):
    v, other = [1.0, 2.0, 3.0, 4.0], [-4.0, 3.0, -2.0, 1.0]
    data = [(f"c{i:02d}", [e * (i + 1) for e in v]) for i in range(9)] + [("c00", v), ("z", [0.0] * 4), ("n", None), ("e", []), ("s", [1.0]), ("m", [1.0, None, 2.0, 3.0]), ("f", [float("nan"), 1.0, 1.0, 1.0]), (None, v), ("o", other)]
    df = spark.createDataFrame(data, "job_id string, embedding array<float>")
    ids = [f"c{i:02d}" for i in range(9)]
    want = {tuple(sorted((a, b))) for a in ids for b in [i for i in ids if i != a][:5]}
    assert set(rows(neighbours.similar_pairs(df, size=4))) == want
    assert rows(neighbours.similar_pairs(df.limit(0), size=4)) == [] and rows(neighbours.similar_pairs(df.where("job_id = 'o'"), size=4)) == []


def test_sorted_arrays_count_what_windows_hold():
    r = np.random.default_rng(3)
    p, width = r.standard_normal((50, 6)), 0.4
    arrays = neighbours.SortedArrays(p, 1.0)
    first, last = arrays.windows(p[:7], width)
    counts = np.zeros((7, 50), np.int16)
    arrays.count(counts, first, last - first)
    want = (np.abs(p[:7, None, :] - p[None]) <= width).sum(2)
    assert (counts == want).all()
    lo, hi = arrays.windows(p[:7], 0.9)  # widening counts only what is new
    arrays.count(counts, lo, first - lo)
    arrays.count(counts, last, hi - last)
    assert (counts == (np.abs(p[:7, None, :] - p[None]) <= 0.9).sum(2)).all()


@pytest.mark.parametrize("noise", [1e-4, 0.3])
def test_members_that_bytes_cannot_tell_apart_are_compared_exactly(spark, noise):
    r = np.random.default_rng(8)
    base = r.standard_normal(384)
    x = (base + noise * r.standard_normal((300, 384))).astype(np.float32)
    df = spark.createDataFrame([(f"j{i:05d}", v.tolist()) for i, v in enumerate(x)], "job_id string, embedding array<float>")
    got = {(int(a[1:]), int(b[1:])) for a, b in neighbours.similar_pairs(df).collect()}
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = five_best(x)
    assert len(got & want) >= 0.99 * len(want) and len(got) <= 1.02 * len(want)


def near_each_other(r, n, cosine=0.9, size=384):
    base = r.standard_normal(size)
    x = base / np.linalg.norm(base) + math.sqrt(1 / cosine - 1) * r.standard_normal((n, size)) / math.sqrt(size)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def five_best(x, least=0.8):
    s = x @ x.T
    np.fill_diagonal(s, -1)
    best = np.argpartition(-s, 5, axis=1)[:, :5]
    return {(min(i, j), max(i, j)) for i in range(len(x)) for j in best[i].tolist() if s[i, j] >= least}


@pytest.mark.parametrize("n", [100, 400, 3000])
def test_dense_groups_keep_the_five_best(spark, n):
    r = np.random.default_rng(n)
    x = np.concatenate([near_each_other(r, n), near_each_other(r, 40), r.standard_normal((300, 384)) / 20]).astype(np.float32)
    df = spark.createDataFrame([(f"j{i:05d}", v.tolist()) for i, v in enumerate(x)], "job_id string, embedding array<float>")
    got = {(int(a[1:]), int(b[1:])) for a, b in neighbours.similar_pairs(df).collect()}
    x = x.astype(float)
    want = five_best(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


@pytest.mark.parametrize("cosine", [0.82, 0.9])
def test_all_blocks_of_a_large_cell_meet(spark, monkeypatch, cosine):
    monkeypatch.setattr(neighbours, "PER_CELL", 10**6)  # one pivot, one cell, three blocks
    monkeypatch.setattr(neighbours, "TABLES", 1)
    r = np.random.default_rng(5)
    base = r.standard_normal(384)
    base *= math.sqrt(0.58 / (base @ base))
    own = r.standard_normal((1500, 384)) * math.sqrt((cosine - 0.58) / 384)
    x = (base + np.repeat(own, 6, 0) + r.standard_normal((9000, 384)) * math.sqrt((1 - cosine) / 384)).astype(np.float32)
    df = spark.createDataFrame([(f"j{i:05d}", v.tolist()) for i, v in enumerate(x)], "job_id string, embedding array<float>")
    got = {(int(a[1:]), int(b[1:])) for a, b in neighbours.similar_pairs(df).collect()}
    x = x.astype(float)
    want = five_best(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert len(want) > 10_000 and len(got & want) >= 0.98 * len(want) and got <= want


# 5 co-occurrence


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["b1", "b2", "b3", "b4", None]), st.sampled_from(["x", "y", "z", "w", "", None])), max_size=40))
def test_pairs_against_brute_force(spark, data):
    df = spark.createDataFrame([(*d, "c") for d in data], "basket string, item string, code string")
    sets = {}
    for b, i in data:
        if b is not None and i:
            sets.setdefault(b, set()).add(i)
    n = len(sets)
    want = {}
    for s in sets.values():
        for a in s:
            for b in s:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    got = {(r["item_a"], r["item_b"]): r for r in cooccurrence.pairs(df, "basket", "item").collect()}
    assert {k: r["n_both"] for k, r in got.items()} == want
    for (a, b), r in got.items():
        ca, cb, c = sum(a in s for s in sets.values()), sum(b in s for s in sets.values()), want[a, b]
        assert r["n_baskets"] == n and abs(r["lift"] - c * n / ca / cb) < 1e-9
        assert abs(r["odds_ratio"] - (c + 0.5) * (n - ca - cb + c + 0.5) / ((ca - c + 0.5) * (cb - c + 0.5))) < 1e-9


def test_more_items_than_are_sent_to_the_tasks_are_joined(spark, monkeypatch):
    r = random.Random(2)
    df = spark.createDataFrame([(b, f"i{r.randrange(60):02d}") for b in range(80) for _ in range(r.randrange(9))], "job_id long, skill string")
    want = {tuple(x) for x in cooccurrence.pairs(df, "job_id", "skill").collect()}
    monkeypatch.setattr(cooccurrence, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(cooccurrence, "BLOCK", 3)
    monkeypatch.setattr(cooccurrence, "RUN", 10)
    assert {tuple(x) for x in cooccurrence.pairs(df, "job_id", "skill").collect()} == want


def test_wide_baskets_and_pruning(spark):
    wide = [("big", f"i{k:03d}") for k in range(600)] + [(f"s{k}", x) for k in range(30) for x in ("hot", f"i{k % 3:03d}")] + [(f"q{k}", x) for k in range(5) for x in ("r1", "r2")]
    df = spark.createDataFrame(wide, "job_id string, skill string")
    assert cooccurrence.pairs(df, "job_id", "skill").where("item_a <> 'hot' and item_b <> 'hot'").count() == 600 * 599 // 2 + 1
    full = cooccurrence.pairs(df, "job_id", "skill").where("n_both >= 5 and n_both >= 0.003 * n_baskets and n_both * n_baskets >= 3 * n_a * n_b")
    pruned = cooccurrence.pairs(df, "job_id", "skill", 5, 0.003, 3.0)
    assert {tuple(r) for r in full.collect()} == {tuple(r) for r in pruned.collect()} and pruned.count() == 1


# 7 canonical values


REF = [("title", "T1", "Data Engineer"), ("title", "T2", "Data Scientist"), ("title", "T3", "Frontend Developer"), ("title", "T4", "Machine Learning Engineer"), ("state", "NC", "North Carolina"), ("state", "CA", "California"), ("state", "DC", "District of Columbia"), ("state", "NY", "New York")]
CASES = [
    ("title", "Sr. Data Enginere (Austin, CA) #12", "T1"), ("title", "Engineer, Data", "T1"), ("title", "DataEngineer", "T1"), ("title", "DE | Remote US", "T1"), ("title", "Data Scntst III - 6 month contract", "T2"), ("title", "front-end dev: Growth Team", "T3"),
    ("title", "ML Engr (f/m/d)", "T4"), ("title", "Civil Engineer", "UNMATCHED"), ("title", "Data Entry Clerk", "UNMATCHED"), ("title", "Senior", "UNMATCHED"), ("title", "???", "UNMATCHED"), ("title", "Data Engineer", None), ("title", "  ", None), ("title", None, None),
    ("title", "clerk " * 3000, "UNMATCHED"), ("title", "machine learning " * 3000, "T4"), ("title", "data engineer " * 2, "T1"), ("state", "Calif.", "CA"), ("state", "US-CA", "CA"), ("state", "n. carolina", "NC"), ("state", "Distrct of Columbia", "DC"), ("state", "D.C.", "DC"), ("state", "New Yrok (US)", "NY"), ("state", "Ontario", "UNMATCHED"), ("state", "N/A", "UNMATCHED"), ("state", "United States", "UNMATCHED"),
]


def test_canonical_cases(spark):
    data = [(f"{i}", v if k == "title" else None, v if k == "state" else None, T0, "x", "y") for i, (k, v, _) in enumerate(CASES)]
    jobs = spark.createDataFrame(data, "job_id string, title string, state string, _loaded_at timestamp, core string, value string")
    ref = spark.createDataFrame([*REF, ("title", None, "x"), ("state", "TX", "Texas")], "ref_kind string, ref_key string, ref_label string")
    got = [tuple(r) for r in canonical.mapped(jobs, ref).collect()]
    assert sorted(got) == sorted((f"{i}", k, key) for i, (k, _, key) in enumerate(CASES) if key)


def test_canonical_repeats_and_empty(spark, rows):
    ref = spark.createDataFrame(REF, "ref_kind string, ref_key string, ref_label string")
    jobs = spark.createDataFrame([("a", "DE", None, T0), ("a", "Data Scntst", None, dt.datetime(2026, 9, 3)), ("a", "Data Scntst", None, dt.datetime(2026, 9, 3)), (None, "DE", None, T0)], "job_id string, title string, state string, _loaded_at timestamp")
    assert rows(canonical.mapped(jobs, ref)) == [("a", "title", "T2")]
    assert rows(canonical.mapped(jobs.limit(0), ref)) == []
    assert rows(canonical.mapped(jobs, ref.limit(0))) == [("a", "title", "UNMATCHED")]


def test_lists_of_any_length_are_joined(spark, rows):
    tokens = [a + b + c + d for a in "bdfgklmnpr" for b in "aeiou" for c in "bdfgklmnpr" for d in "aeo"]
    labels = sorted({f"{tokens[i % len(tokens)]} {tokens[(i * 7 + i // len(tokens)) % len(tokens)]}" for i in range(24_000)})
    assert len(labels) > 20_000
    ref = spark.createDataFrame([("title", f"T{i}", label) for i, label in enumerate(labels)], "ref_kind string, ref_key string, ref_label string")
    jobs = spark.createDataFrame([("j", labels[777].upper(), None, T0), ("k", "quixotic zzz", None, T0), ("l", labels[5], None, T0)], "job_id string, title string, state string, _loaded_at timestamp")
    assert rows(canonical.mapped(jobs, ref)) == [("j", "title", "T777"), ("k", "title", "UNMATCHED")]


def test_titles_lose_places_of_long_state_lists(spark, rows):
    codes = [f"Q{a}{b}{c}" for a in "ABCDEFGHIJKLM" for b in "ABCDEFGHIJ" for c in "ABCDEFGHIJ"]
    ref = spark.createDataFrame([("title", "T1", "Data Engineer")] + [("state", c, f"Land of {c}") for c in codes], "ref_kind string, ref_key string, ref_label string").coalesce(1)
    jobs = spark.createDataFrame([("j", "Data Engineer, Foo QMJJ", None, T0)], "job_id string, title string, state string, _loaded_at timestamp")
    assert rows(canonical.mapped(jobs, ref)) == [("j", "title", "T1")]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_string_alignment_distance(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert canonical.osa(a, b, 2) == min(d[-1][-1], 3) and names.edits(a, b, 2) == min(d[-1][-1], 3)


# 8 leaks


WORDS = [f"{a}{b}{c}" for a in "bdfklm" for b in "aeiou" for c in "nrst"]


def sentence(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def test_leaks_against_planted_cases(spark, rows):
    r = random.Random(4)
    items = {i: sentence(r, 80) for i in range(6)}
    stock = sentence(r, 9)
    for w in items.values():
        w[:9] = stock
    docs, want = [], set()

    def add(words, found=()):
        docs.append((len(docs), words if isinstance(words, str) or words is None else " ".join(words), "t"))
        want.update((len(docs) - 1, i) for i in found)

    for i, w in items.items():
        add(sentence(r, 100) + w + sentence(r, 100), [i])
        add(sentence(r, 40) + [x if k % 11 else "altered" for k, x in enumerate(w[20:64])] + sentence(r, 60), [i])
        add(sentence(r, 40) + w[9:31] + sentence(r, 30) + w[40:66] + sentence(r, 10), [i])  # two runs
        add(sentence(r, 50) + w[30:52] + sentence(r, 50))  # a quarter
        add(stock + sentence(r, 80))  # a stock sentence
        add(sentence(r, 9) + list(reversed(w)))  # other order
    add("<p>" + " ".join(items[0]).upper().replace(" ", ",<br/>\n> ") + "</p>", [0])
    add(" ".join(w[:2] + "-\n" + w[2:] if k % 9 == 0 else w for k, w in enumerate(items[1])), [1])
    add(None)
    add("")
    add(" ".join(sentence(r, 30_000) + items[2]), [2])
    df = spark.createDataFrame([*docs, docs[0], (None, docs[0][1], "t")], "doc_id long, text string, held string")
    it = spark.createDataFrame([(i, " ".join(w), "s") for i, w in items.items()] + [(90, None, "s"), (91, " ", "s"), (None, "x y", "s")], "item_id long, item_text string, suite string")
    found = leaks.leaks(df, it)
    assert set(rows(found.select("doc_id", "item_id"))) == want and found.count() == len(want)
    assert rows(leaks.leaked_items(found, it))[0][:2] == (0, "s")
    assert leaks.leaks(df.limit(0), it).count() == 0 and leaks.leaks(df, it.limit(0)).count() == 0


def test_items_beyond_a_block_are_searched_too(spark, rows, monkeypatch):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    items = [[r.choice(vocabulary) for _ in range(70)] for _ in range(9)]
    docs = [(i, " ".join([r.choice(vocabulary) for _ in range(90)] + w[5:60] + [r.choice(vocabulary) for _ in range(90)])) for i, w in enumerate(items)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, item_text string")
    monkeypatch.setattr(leaks, "ITEMS", 2)
    assert len(leaks.item_blocks(it)) == 5
    assert rows(leaks.leaks(df, it).select("doc_id", "item_id")) == [(i, i) for i in range(9)]


def test_paraphrases_show_by_their_answer(spark, rows):
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    item, other = ([r.choice(vocabulary) for _ in range(60)] for _ in range(2))
    told = [w for i in range(0, 48, 3) for w in reversed(item[i : i + 3])] + item[48:]  # other order, same answer
    docs = [(1, " ".join(told)), (2, " ".join(item)), (3, " ".join(told[:48] + other[48:])), (4, " ".join(other))]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, item_text string")
    assert [x[:2] for x in rows(leaks.paraphrased(df, it))] == [(1, 1)] and [x[:2] for x in rows(leaks.leaks(df, it))] == [(2, 1)]


def test_held_share_of_one_run():
    r = random.Random(8)
    for _ in range(30):
        item = np.array([r.randrange(400) for _ in range(60)])
        a, b = sorted(r.sample(range(61), 2))
        doc = np.array([r.randrange(400, 900) for _ in range(50)] + list(item[a:b]) + [r.randrange(400, 900) for _ in range(50)])
        if b - a >= 10:
            assert abs(leaks.held_share(doc, item) - (b - a) / 60) <= 1 / 60
        elif b - a < 8:
            assert leaks.held_share(doc, item) == 0
    assert leaks.held_share(np.array([], np.int64), np.array([1])) == 0 and leaks.held_share(np.array([1]), np.array([], np.int64)) == 0


# 9 mixing


@pytest.fixture(scope="module")
def mixture(spark):
    data = [(i, " ".join(["word"] * (5 + i % 20)), "big") for i in range(300)] + [(1000 + i, "some short text here", "small") for i in range(10)] + [(2000, "x y z", None), (2001, "x y z", "unlisted"), (2002, None, "big"), (2003, "  ", "big"), (0, "word", "big"), (None, "a b", "big")]
    docs = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("none", 0.2, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_mix_budgets_repeats_and_report(mixture):
    docs, targets = mixture
    used, report = mixing.mix(docs, targets, total=4000)
    rep = {r["source"]: r for r in report.collect()}
    u = used.collect()
    assert set(rep) == {"big", "small", "none"} and rep["none"]["mixed_tokens"] == 0
    assert all(1 <= r["copies"] <= (2 if r["source"] == "big" else 3) for r in u) and len({r["doc_id"] for r in u}) == len(u)
    assert rep["small"]["mixed_tokens"] == 3 * rep["small"]["available_tokens"]
    assert rep["big"]["budget_tokens"] - 30 < rep["big"]["mixed_tokens"] <= rep["big"]["budget_tokens"]
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-4
    assert sum(r["tokens"] * r["copies"] for r in u if r["source"] == "big") == rep["big"]["mixed_tokens"]


def test_mix_is_repeatable_equals_plain_sort_and_takes_whole_epochs_first(mixture):
    docs, targets = mixture
    a, b = (sorted(map(tuple, mixing.mix(docs, targets, total=4000)[0].collect())) for _ in range(2))
    assert a == b
    sizes = mixing.sized(docs).where("source = 'big'").withColumn("h", F.xxhash64("doc_id", F.lit(42))).collect()
    left, want, got = 2000, {}, {r[0]: r[3] for r in a if r[1] == "big"}
    for r in sorted(sizes, key=lambda r: (-math.log(((r["h"] & (2**53 - 1)) + 0.5) / 2**53) / r["weight"], r["doc_id"])):
        left -= r["tokens"]
        if left < 0:
            break
        want[r["doc_id"]] = 1
    assert got == want
    assert {r[3] for r in mixing.mix(docs, targets, total=9000)[0].where("source = 'big'").collect()} == {1, 2}


def test_mix_of_nothing(mixture):
    docs, targets = mixture
    used, report = mixing.mix(docs.limit(0), targets)
    assert used.count() == 0 and report.count() == 3
    used, report = mixing.mix(docs, targets.limit(0))
    assert used.count() == 0 and report.count() == 0


# 10 stuffed pages


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.integers(2, 4), st.integers(1, 3))
def test_automaton_against_brute_force(seq, times, least):
    n, want = len(seq), [False] * len(seq)
    for i in range(n):
        for j in range(i + least, n + 1):
            if sum(seq[k : k + j - i] == seq[i:j] for k in range(n - (j - i) + 1)) >= times:
                want[i:j] = [True] * (j - i)
    assert stuffing.Automaton(seq).repeated(times, least) == want


PROSE = "The panel liked that the analyst reviewed the plan and wrote down why. You will own the pipeline and report to the team. We expect three years with it. "


@pytest.mark.parametrize("text,stuffed", [
    (None, False), ("", False), (" \n ", False), (PROSE, False), (PROSE * 2 + "\nSkills:\n- AWS\n- Spark\n- Kafka", False), (PROSE + "#aws #spark #kafka #sql", False), ("- " + PROSE.replace(". ", "\n - "), False),
    ("data engineer jobs near me | " * 40, True), ("#jobs_near_me\n" * 40 + PROSE, True), ("https://a.example/jobs Apply " * 30 + PROSE, True), ("[More](http://a.example/x) » " * 20, True), ("analytics engineer · Seattle · Neo4j · " * 10, True),
    ("Looking for cheap jobs in Boston? We list cheap jobs in Boston. Find cheap jobs in Boston now. " * 8 + PROSE, True), (PROSE * 2 + "data engineer jobs\n" * 3, False), (PROSE + "See https://a.example/guide", False), (PROSE * 4000, True),
])
def test_stuffed_pages(text, stuffed):
    n, _, outside, _, _, coverage = stuffing.measures(text)
    assert (2 * outside > n and coverage >= stuffing.COVER) == stuffed


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(2, 4), st.integers(2, 3))
def test_breaking_at_rare_pairs_changes_no_coverage(seq, times, least):
    assert list(stuffing.coverage(seq, times, least)) == stuffing.Automaton(seq).repeated(times, least)


def test_pages_need_coverage_and_no_list_of_words():
    assert stuffing.measures("Palka, Mibro, Serune, Toxil, Vanqo, Wepra, Zidon, Quvel, Karbo, Limne")[5] == 0.0  # different words only
    polish = "Zespół szuka osoby, która pisze jasno i dba o szczegóły. Biuro w tym mieście otwiera późno w piątki. "
    n, _, outside, *_ = stuffing.measures(polish * 2)
    assert 2 * outside < n
    assert stuffing.measures("praca zdalna dla programisty | " * 30)[5] == 1.0
    long = "tani kurs jazdy | praca w sklepie | " * 40_000
    assert stuffing.measures(long)[2] == 240_000


def test_stuffed_over_rows(spark, rows):
    df = spark.createDataFrame([(1, "#a_b\n" * 9, 5), (1, "#a_b\n" * 9, 5), (2, PROSE, 5), (3, None, 5), (None, "#a #b", 5)], "doc_id long, text string, n_words int")
    assert rows(stuffing.stuffed(df)) == [(1,)] and stuffing.page_measures(df).count() == 4 and stuffing.stuffed(df.limit(0)).count() == 0
