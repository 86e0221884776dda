"""Mapping free-entered values to a canonical list (problem 7).

Typed values are stripped of noise (level, place, terms, numbers) and become distinct cores; each distinct token of the cores is
joined to the reference vocabulary by edit distance (a deletion-neighbourhood index, verified by optimal string alignment), or as an
abbreviation or initialism; the corrected tokens are combined by soft TF-IDF to rank complete entries. A value whose best entry
stays under the threshold is reported as UNMATCHED. All work runs over distinct strings; results are joined back to all rows.

The vocabulary with its keys (spellings, initials, prefixes, deletions) is a table, and so is an inverted list from token to entries; tokens and values are joined to
them, so the list may have any length. An entry stands in the inverted list under its rarest tokens only: one that scores `LEAST` has hit one of those.

Defined cases. Null and blank values, and values that are letter for letter a label of their kind, give no row. A value with
nothing left besides noise is UNMATCHED. Equal scores: the smaller key. A job loaded several times counts once, with its latest
_loaded_at (ties: the greater value). Null ids give no row. An empty list makes every value UNMATCHED. Very long values are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.joins import lookup, lookup_counted
from quarrymill.session import broadcast_if_small, cut

#: States whose codes the pattern of places in titles may hold; more are refused.
MOST_STATES = 20_000
#: Least soft TF-IDF cosine of a match.
LEAST = 0.84
#: Words of level, work mode and terms that say nothing about the occupation.
TITLE_NOISE = frozenset(
    """jr junior sr senior lead staff principal associate entry level mid intern internship graduate grad i ii iii iv v remote hybrid
    onsite on site us usa only contract contractor month months week weeks temp temporary permanent perm full part time visa
    sponsorship urgent now hiring night day shift req requisition job id f m d w h x w2 c2c the a an of for and or in at with""".split()
) - {"site", "full", "time", "part"}
STATE_NOISE = frozenset("us usa u s a united states state of america the commonwealth".split())
#: Usual short forms that no rule of abbreviation gives.
TITLE_SYNONYMS = {"swe": "software engineer", "sde": "software engineer", "dba": "database administrator", "dwh": "data warehouse", "db": "database", "sw": "software", "fe": "frontend", "be": "backend", "fs": "full stack"}
#: Traditional short forms of state names.
STATE_SYNONYMS = {
    "ala": "alabama", "ariz": "arizona", "ark": "arkansas", "cal": "california", "cali": "california", "calif": "california", "colo": "colorado",
    "conn": "connecticut", "del": "delaware", "fla": "florida", "ill": "illinois", "ills": "illinois", "ind": "indiana", "kan": "kansas",
    "kans": "kansas", "mass": "massachusetts", "mich": "michigan", "minn": "minnesota", "miss": "mississippi", "mont": "montana",
    "neb": "nebraska", "nebr": "nebraska", "nev": "nevada", "okla": "oklahoma", "ore": "oregon", "oreg": "oregon", "penn": "pennsylvania",
    "penna": "pennsylvania", "tenn": "tennessee", "tex": "texas", "wash": "washington", "wis": "wisconsin", "wisc": "wisconsin", "wyo": "wyoming",
    "washingtondc": "district of columbia", "wva": "west virginia", "ncar": "north carolina",
}


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (insert, delete, replace, swap), most + 1 if greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if older and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        before = last
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def deletions(s: str, n: int) -> set[str]:
    out, level = {s}, {s}
    for _ in range(n):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out |= level
    return out


def edits_for(length: int) -> int:
    return 0 if length < 3 else 1 if length < 8 else 2


RUNS = "kind string, key string, word string, run array<string>"


def vocabulary_keys(listed: DataFrame, synonyms: dict[str, str], key_is_name: bool, noise: frozenset[str]) -> DataFrame:
    """(kind, key, word, run): what a token can stand for, a run of an entry's tokens, by the key under which it is looked up.

    kind e: joined spelling; x: initials, key of the entry, or synonym; l: first letter of a part of a longer name; d: spelling with
    characters left out; p: prefix of a token; s: first letter and two later letters of a token.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for key, label in zip(b["ref_key"], b["ref_label"]):
                ts = tuple(t for t in tokens_of(label) if t not in noise)
                if key_is_name:
                    out.add(("x", key.lower(), "", ts))
                for i in range(len(ts)):
                    for j in range(i + 1, len(ts) + 1):
                        word = "".join(ts[i:j])
                        out.add(("e", word, word, ts[i:j]))
                        out |= {("d", d, word, ts[i:j]) for d in deletions(word, edits_for(len(word)))}
                        if j - i > 1:
                            out.add(("x", "".join(t[0] for t in ts[i:j]), "", ts[i:j]))
                for t in set(ts):
                    if len(ts) > 1:
                        out.add(("l", t[0], t, (t,)))
                    out |= {("p", t[:n], t, (t,)) for n in range(2, len(t) - 1)}
                    out |= {("s", t[0] + x + y, t, (t,)) for i, x in enumerate(t[1:], 1) for y in t[i + 1 :]}
            yield pd.DataFrame([(k, key, w, list(r)) for k, key, w, r in sorted(out) if r], columns=["kind", "key", "word", "run"])

    keys = listed.mapInPandas(run, RUNS)
    if synonyms:
        keys = keys.unionByName(listed.sparkSession.createDataFrame([("x", s, "", tokens_of(long)) for s, long in synonyms.items()], RUNS))
    return cut(keys.distinct())


def readings_of(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """(token, readings): all readings (run, sim) of each token (token) that has any. Where the token is spelled out, only what it spells counts."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["token"]:
                out += [("l", t, t)] if len(t) == 1 else [("p", t, t)]
                out += [("s", t[:3], t)] if len(t) >= 3 else []
                out += [("d", d, t) for d in deletions(t, edits_for(len(t) + 1))]
            yield pd.DataFrame(out, columns=["kind", "key", "token"])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sims = []
            for kind, t, w in zip(b["kind"], b["token"], b["word"]):
                if kind == "d":
                    most = edits_for(len(t) + 1)
                    d = osa(t, w, most)
                    sims.append(1 - 0.03 * d if d <= min(most, edits_for(max(len(w), len(t)))) else 0.0)
                elif kind == "l":
                    sims.append(0.93)
                else:
                    sims.append(0.0 if len(t) > len(w) - 2 else 0.95 if kind == "p" else 0.92 if subsequence(t, w) else 0.0)
            out = pd.DataFrame({"token": b["token"], "run": b["run"], "sim": sims})
            yield out[out["sim"] > 0]

    spelled = keys.where("kind in ('e', 'x')").select(F.col("key").alias("token"), "run", F.when(F.col("kind") == "e", 1.0).otherwise(0.97).alias("sim"))
    exact = cut(tokens.join(spelled, "token"))
    rest = tokens.join(exact.select("token").distinct(), "token", "left_anti")
    met = rest.mapInPandas(keyed, "kind string, key string, token string").join(keys, ["kind", "key"]).select("kind", "token", "word", "run").distinct()
    found = exact.unionByName(met.mapInPandas(near, "token string, run array<string>, sim double"))
    best = found.groupBy("token", "run").agg(F.max("sim").alias("sim"))
    return best.groupBy("token").agg(F.collect_list(F.struct("run", "sim")).alias("readings"))


def inverted_list(listed: DataFrame, noise: frozenset[str]) -> tuple[DataFrame, float]:
    """((token, ref_key, terms: token and weight), the greatest weight): each entry under its rarest tokens, those without which its score stays under LEAST."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(key, t) for key, label in zip(b["ref_key"], b["ref_label"]) for t in sorted({t for t in tokens_of(label) if t not in noise})]
            yield pd.DataFrame(out, columns=["ref_key", "token"])

    n = listed.count()
    terms = cut(listed.mapInPandas(split, "ref_key string, token string"))
    idf = terms.groupBy("token").agg((1 + F.ln(F.lit(n + 1.0) / (F.count("*") + 0.5))).alias("idf"))
    weighted = cut(terms.join(idf, "token"))
    rare = weighted.agg(F.max("idf")).first()[0] or 1.0
    mass = F.col("idf") * F.col("idf")
    order = Window.partitionBy("ref_key").orderBy(F.desc("idf"), "token").rowsBetween(Window.unboundedPreceding, -1)
    first = weighted.withColumn("before", F.coalesce(F.sum(mass).over(order), F.lit(0.0))).withColumn("all", F.sum(mass).over(Window.partitionBy("ref_key")))
    first = first.where(F.col("before") <= (1 - LEAST * LEAST + 1e-9) * F.col("all")).select("token", "ref_key")
    entries = weighted.groupBy("ref_key").agg(F.sort_array(F.collect_list(F.struct("token", "idf"))).alias("terms"))
    return cut(first.join(entries, "ref_key")), rare


def best_entry(tokens: list[str], readings: dict[str, list[tuple[list[str], float]]], entries: list[tuple[str, dict[str, float]]], rare: float) -> tuple[str | None, float]:
    """The best of `entries` (key, weights of its tokens) for the tokens in their order; adjacent tokens may also be read as one ("front end")."""
    best, tokens = (0.0, None), list(dict.fromkeys(tokens))  # a repeated token says nothing new
    for units in {tuple(tokens), *merged(tokens, readings)}:
        for key, idf in entries:
            hit: dict[str, float] = {}
            loose = 0
            for u in units:
                fits = [(sum(v for _ in run), run, v) for run, v in readings.get(u, ()) if all(t in idf for t in run)]
                fits = [f for f in fits if any(t not in hit for t in f[1])]
                if fits:
                    _, run, v = max(fits)
                    for t in run:
                        hit[t] = max(hit.get(t, 0), v)
                else:
                    loose += 1
            own = math.sqrt(sum(w**2 for w in idf.values()))
            typed = math.sqrt(sum(idf[t] ** 2 for t in hit) + loose * rare**2)
            score = sum(v * idf[t] ** 2 for t, v in hit.items()) / (own * typed) if hit else 0.0
            if score > best[0] + 1e-9 or score > best[0] - 1e-9 and best[1] is not None and key < best[1]:
                best = (max(score, best[0]), key)
    return best[1], best[0]


def subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def merged(tokens: list[str], readings: dict) -> list[tuple[str, ...]]:
    """The tokens with adjacent ones joined where the joined word has a reading."""
    out = []
    for n in (2, 3):
        for i in range(len(tokens) - n + 1):
            joined = "".join(tokens[i : i + n])
            if joined in readings:
                out.append((*tokens[:i], joined, *tokens[i + n :]))
    return out


def tokens_of(s: str) -> list[str]:
    import re

    return [t for t in re.split(r"[^a-z0-9+#]+", s.lower()) if t]


_FROM, _TO = "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"


def title_core(c: Column, places: list[str]) -> Column:
    """Tokens of a title without place, level, terms and numbers."""
    s = F.translate(F.lower(F.regexp_replace(c, r"[ \s]+", " ")), _FROM, _TO)
    if places:
        codes = "|".join(sorted(p.lower() for p in places))
        s = F.regexp_replace(s, rf"(?:\s[-–—]\s|[|(,/])\s*[a-z.']+(?: [a-z.']+){{0,2}},?\s+(?:{codes})\b\)?", " ")
    s = F.regexp_replace(s, r"(?:[:|(,]|\s[-–—])\s*[a-z&]+(?: [a-z&]+)? (?:team|squad|group|dept|department|division|practice)\b\)?", " ")
    s = F.regexp_replace(s, r"(?:\breq(?:uisition)?\b|\bjob id\b|#)\W*\d+|\(?\b[fmdwhx](?:/[fmdwhx])+\b\)?|\b\d+ (?:month|week|year)s?\b|\bentry[ -]level\b|\bmid[ -]level\b|\bpart[ -]time\b|\bfull[ -]time\b|\bon[ -]site\b|\bw2\b|\b\d+\b", " ")
    return F.filter(F.split(s, r"[^a-z0-9+#]+"), lambda t: (t != "") & ~t.isin(*sorted(TITLE_NOISE)))


def state_core(c: Column) -> Column:
    s = F.translate(F.lower(F.regexp_replace(c, r"[ \s]+", " ")), _FROM, _TO)
    s = F.regexp_replace(s, r"\bu\.\s?s\.(?:\s?a\.)?", " ")
    return F.filter(F.split(s, r"[^a-z0-9+#]+"), lambda t: (t != "") & ~t.isin(*sorted(STATE_NOISE - {"a", "s", "u"})))


def map_values(rows: DataFrame, reference: DataFrame, kind: str, core: Column, synonyms: dict[str, str], key_is_name: bool, noise: frozenset[str]) -> DataFrame:
    """(job_id, ref_kind, ref_key) of `rows` (job_id, value); `core` makes the array of tokens of `value`."""
    listed = cut(reference.where((F.col("ref_kind") == kind) & F.col("ref_key").isNotNull() & F.col("ref_label").isNotNull()).select("ref_key", "ref_label").distinct())
    keys = vocabulary_keys(listed, synonyms, key_is_name, noise)
    index, rare = inverted_list(listed, noise)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tokens, found, entries in zip(b["tokens"], b["found"], b["entries"]):
                readings = {f["token"]: [(list(r["run"]), r["sim"]) for r in f["readings"]] for f in found}
                near = sorted((e["ref_key"], {t["token"]: t["idf"] for t in e["terms"]}) for e in entries) if entries is not None else []
                key, score = best_entry(list(tokens), readings, near, rare)
                out.append(key if score >= LEAST else "UNMATCHED")
            yield pd.DataFrame({"core": b["core"], "ref_key": out})

    labels = broadcast_if_small(listed.select(F.col("ref_label").alias("value")).distinct())
    typed = rows.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").join(labels, "value", "left_anti")
    values = cut(typed.groupBy("value").agg(F.count("*").alias("n")).select("value", "n", F.array_join(core, " ").alias("core")))
    cores = values.select("core").distinct().select("core", F.split("core", " ").alias("tokens"))

    def joins(n: int) -> Column:
        at = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice("tokens", i, n), ""))

    words = cores.select("core", "tokens", F.explode(F.array_distinct(F.concat("tokens", joins(2), joins(3)))).alias("token"))
    repaired = cut(readings_of(words.select("token").where("token <> ''").distinct(), keys))
    found = cut(lookup(words, repaired, "token").where(F.col("readings").isNotNull()))
    hits = found.select("core", F.explode(F.flatten(F.transform("readings", lambda r: r["run"]))).alias("token")).distinct()
    near = hits.join(index, "token").select("core", "ref_key", "terms").distinct().groupBy("core").agg(F.collect_list(F.struct("ref_key", "terms")).alias("entries"))
    per_core = found.groupBy("core").agg(F.first("tokens").alias("tokens"), F.collect_list(F.struct("token", "readings")).alias("found")).join(near, "core")
    # few bytes but much work a row: a fixed number of partitions isn't joined into one
    ranked = per_core.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(rank, "core string, ref_key string")
    known = values.join(ranked, "core", "left").select("value", "n", F.coalesce("ref_key", F.lit("UNMATCHED")).alias("ref_key"))
    return lookup_counted(typed, cut(known), "value").select("job_id", F.lit(kind).alias("ref_kind"), "ref_key")


def mapped(jobs: DataFrame, reference: DataFrame) -> DataFrame:
    """(job_id, ref_kind, ref_key) of the typed titles and states of all postings."""
    kept = jobs.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.max(F.struct(F.col("_loaded_at").alias("at"), F.col("title"), F.col("state"))).alias("m")).select("job_id", "m.title", "m.state")
    kept = cut(kept)
    places = sorted(r[0] for r in reference.where("ref_kind = 'state' and ref_key is not null").select("ref_key").distinct().limit(MOST_STATES + 1).collect())
    if len(places) > MOST_STATES:
        raise ValueError(f"the reference list has more than {MOST_STATES} states")
    titles = map_values(kept.select("job_id", F.col("title").alias("value")), reference, "title", title_core(F.col("value"), places), TITLE_SYNONYMS, False, TITLE_NOISE)
    states = map_values(kept.select("job_id", F.col("state").alias("value")), reference, "state", state_core(F.col("value")), STATE_SYNONYMS, True, STATE_NOISE)
    return titles.unionByName(states)
