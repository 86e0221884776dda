"""Variant spellings of names typed by people (problem 2).

Distinct spellings are reduced to forms: case, accents, legal forms, bracketed remarks and usual short forms of given names are evened out.
Forms become unit vectors of character n-grams weighted by TF-IDF over all forms, so what many names share, such as words of trade, counts for little
without a list of such words. A distributed sparse cosine join gives all pairs of at least `NEAR`: forms are dealt to blocks, each two blocks meet in one task, and the products of
weights of shared grams are summed there. All partners above the threshold are kept; there is no top-n cut, which would lose variants of names with many.
An exact check, in the same task, drops pairs that contradict each other: each side has a word that is no misspelling, abbreviation, joined form or initial of any of the other's.
Average linkage of the cosines groups the forms; pairs below `NEAR` or in contradiction count as 0. Connected parts of up to `PART` pairs are linked in a task each,
one merge at a time; larger ones in rounds, in which all pairs of clusters that are each other's nearest merge at once, which for average linkage gives the same groups.

Rows are combined to distinct spellings before the first exchange, so an employer with a third of all rows is one row. Products and candidates aren't exchanged or stored:
the exchange holds each form once for every block (forms / `BLOCK`). The work of a gram is the square of its forms all the same.

Defined cases. Null and blank names and names that name nobody (`NOBODY`) take no part. Equal spellings are one spelling; spellings that
differ in case, space or punctuation are different and pair up. Names without a letter or digit form groups of equal form. Ties between merges: the
smaller labels first. Very long names are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.joins import lookup
from quarrymill.session import broadcast_if_small, cut, stored

#: Least cosine of a candidate; least average cosine of a group.
NEAR, LINK = 0.15, 0.2
#: Characters of a gram; words are padded, so that first and last letters have grams of their own.
GRAM = 3
#: Forms of a block; two blocks meet in one task. Blocks are smaller where there are too few for all tasks, but not below LEAST_BLOCK.
BLOCK, LEAST_BLOCK = 4000, 400
#: Words of a form that `could_agree` looks at; forms of more are left to `agree`.
WORDS = 8
#: Pairs of a connected part that one task links.
PART = 200_000

#: Entries that name nobody.
NOBODY = frozenset(
    """confidential|company confidential|confidential company|confidential employer|employer confidential|confidential client|client confidential|undisclosed|undisclosed company|undisclosed employer
    |private|private advertiser|private company|private employer|anonymous|anonymous employer|not specified|not disclosed|not available|unspecified|unknown|unknown employer|unknown company|n a|na|none|null|nil|hidden
    |hidden employer|tba|tbd|company|employer|client|our client|various|various employers|name withheld|withheld|blind ad|no name|xxx|test""".replace("\n", "").replace("    ", "").split("|")
)
#: Legal forms, and words that link names.
LEGAL = frozenset("inc incorporated llc ltd limited corp corporation co company plc llp lp gmbh ag sa bv nv pty pbc pc and of the".split())
#: Given names and their short forms.
GIVEN = {
    "alexander": "alexander alex al sandy xander", "andrew": "andrew andy drew", "anthony": "anthony tony", "benjamin": "benjamin ben benny benji", "catherine": "catherine cathy", "charles": "charles charlie chuck", "christopher": "christopher chris", "daniel": "daniel dan danny",
    "david": "david dave", "deborah": "deborah debbie deb", "donald": "donald don", "edward": "edward ed eddie ned", "elizabeth": "elizabeth liz beth betty eliza lizzie betsy", "frederick": "frederick fred freddie", "henry": "henry hank harry", "james": "james jim jimmy jamie",
    "jennifer": "jennifer jen jenny", "john": "john jack johnny", "jonathan": "jonathan jon", "joseph": "joseph joe joey", "josephine": "josephine josie jo", "katherine": "katherine kate kathy katie kat kathryn", "kenneth": "kenneth ken kenny", "lawrence": "lawrence larry",
    "margaret": "margaret maggie meg peggy marge madge", "matthew": "matthew matt", "michael": "michael mike mick mickey", "nicholas": "nicholas nick", "patricia": "patricia pat patty trish", "patrick": "patrick paddy", "rebecca": "rebecca becky", "richard": "richard dick rick rich richie",
    "robert": "robert bob rob bobby robbie", "ronald": "ronald ron", "samuel": "samuel sam", "stephen": "stephen steve", "susan": "susan sue susie", "theodore": "theodore ted teddy theo", "thomas": "thomas tom tommy", "timothy": "timothy tim", "victoria": "victoria vicky tori", "william": "william bill will billy liam",
}
_GIVEN = {s: k for k, all_ in GIVEN.items() for s in all_.split()}


def plain(name: str) -> str:
    s = unicodedata.normalize("NFKD", name)
    return "".join(c for c in s if not unicodedata.combining(c))


def form_of(name: str) -> str | None:
    """The name's words in order of the alphabet, without what doesn't count; None if it names nobody or is blank."""
    s = plain(name).strip()
    bare = " ".join(re.findall(r"[a-z0-9]+", s.lower()))
    if bare in NOBODY or not bare:
        return None
    s = re.sub(r"^(?:https?://)?(?:www\.)?([\w-]{4,})\.[a-z]{2,8}(?:/\S*)?$", r"\1", s, flags=re.I)  # a web address
    s = re.sub(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", " ", s)
    s = re.sub(r"[/|,–—-]\s*[\w .']{0,60}\b(?:office|branch|campus|location|division|dept|department)\s*$", " ", s, flags=re.I)
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s)
    s = re.sub(r"\b((?:[A-Za-z]\.){2,})", lambda m: m.group(1).replace(".", ""), s)
    words = re.findall(r"[a-z0-9]+", s.lower())
    own = [_GIVEN.get(w, w) for w in words if w not in LEGAL]
    return " ".join(sorted(own or words)) or bare


def grams_of(form: str) -> list[str]:
    return sorted({t[i : i + GRAM] for w in form.split() for t in [f"^{w}$"] for i in range(len(t) - GRAM + 1)})


@lru_cache(100_000)
def _letters(word: str) -> int:
    """The word's characters as bits; where two share a bit, words only look more alike."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 37
    return bits


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, most + 1 if greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    if (_letters(a) & ~_letters(b)).bit_count() > most or (_letters(b) & ~_letters(a)).bit_count() > most:
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


def allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 10 else 3


def fits(a: str, b: str) -> bool:
    """Whether one word is the other misspelt (optimal string alignment) or abbreviated (first letter, then letters in order)."""
    if len(a) > len(b):
        a, b = b, a
    most = allowed(len(a))
    if edits(a, b, most) <= most:
        return True
    if len(a) < 2 or len(b) < len(a) + 2 or a[0] != b[0] or len(a) > 5 and 2 * len(a) > len(b):
        return False
    letters = iter(b)
    return all(c in letters for c in a)


def _take_joined(p: list[str], q: list[str]) -> None:
    """Takes a word of p that is several words of q written together, and those."""
    for x in list(p):
        inside = [y for y in q if len(y) >= 3 and y in x and y != x]
        if len(inside) > 1 and abs(len(x) - sum(map(len, inside))) <= allowed(len(x)):
            p.remove(x)
            for y in inside:
                q.remove(y)
            continue
        for y, z in combinations(q, 2):
            most = allowed(len(y) + len(z))
            if abs(len(x) - len(y) - len(z)) <= most and min(edits(x, y + z, most), edits(x, z + y, most)) <= most:
                p.remove(x)
                q.remove(y)
                q.remove(z)
                break


def _take_initials(p: list[str], q: list[str]) -> None:
    """Takes a short word of p whose letters begin words of q ("DI" for "Dikmeg International"), and those."""
    for x in [w for w in p if len(w) <= 4]:
        left, used = list(q), []
        for c in x:
            y = next((w for w in left if w[0] == c), None)
            if y is None:
                break
            left.remove(y)
            used.append(y)
        if len(used) == len(x):
            p.remove(x)
            for y in used:
                q.remove(y)


def agree(x: str, y: str) -> bool:
    """False if each form has a word that nothing in the other accounts for."""
    a, b = x.split(), y.split()
    for same in (str.__eq__, fits):
        for w in list(a):
            v = next((v for v in b if same(w, v)), None)
            if v is not None:
                a.remove(w)
                b.remove(v)
    for take in (_take_joined, _take_initials):
        if a and b:
            take(a, b)
        if a and b:
            take(b, a)
    return not (a and b)


def spellings(df: DataFrame, column: str) -> DataFrame:
    """(name, form) of the distinct spellings that name somebody."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame({"name": b["name"], "form": [form_of(n) for n in b["name"]]})
            yield out[out["form"].notna()]

    names = df.select(F.col(column).alias("name")).where(F.trim("name") != "").groupBy("name").agg(F.lit(1).alias("one")).select("name")
    return names.mapInPandas(run, "name string, form string")


def weights(forms: DataFrame, n: int) -> dict[str, float]:
    """The inverse frequency of each gram of n forms, on the driver: there are at most 49,284 grams of the 36 characters of forms and the padding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"gram": [g for f in b["form"] for g in grams_of(f)]}, dtype="object")

    counts = forms.select("form").mapInPandas(run, "gram string").groupBy("gram").agg(F.count("*").alias("df")).collect()
    return {g: math.log(1 + n / df) for g, df in counts}


class Block:
    """Forms as sparse unit vectors, and the words of each for `could_agree`."""

    def __init__(self, ids, forms, idf: dict[str, float]):
        self.ids, self.forms = np.asarray(ids), list(forms)
        self.rows = []
        for f in self.forms:
            w = {g: idf[g] for g in grams_of(f)}
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.rows.append({g: x / norm for g, x in w.items()})
        words = [f.split() for f in self.forms]
        self.count = np.array([len(w) for w in words])
        shape = (WORDS, len(words))
        self.whole, self.letters, self.first, self.size = np.zeros(shape, "int64"), np.zeros(shape, "uint64"), np.zeros(shape, "uint64"), np.zeros(shape, "int64")
        for i, w in enumerate(words):
            for k, x in enumerate(w[:WORDS]):
                self.whole[k, i], self.letters[k, i], self.first[k, i], self.size[k, i] = hash(x), _letters(x), _letters(x[0]), len(x)

    def postings(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """The forms of each gram and its weights in them."""
        held: dict[str, tuple[list[int], list[float]]] = {}
        for i, row in enumerate(self.rows):
            for g, w in row.items():
                at, of = held.setdefault(g, ([], []))
                at.append(i)
                of.append(w)
        return {g: (np.array(at), np.array(of)) for g, (at, of) in held.items()}


def could_agree(x: Block, i: np.ndarray, y: Block, j: np.ndarray) -> np.ndarray:
    """False only where `agree` is False, by what letters words have: each form has a word that nothing in the other can account for."""
    unknown = (x.count[i] > WORDS) | (y.count[j] > WORDS)
    many = int(max(x.count[i].max(initial=0), y.count[j].max(initial=0)))
    p, q = ([(b.whole[k][at], b.letters[k][at], b.first[k][at], b.size[k][at]) for k in range(min(WORDS, many))] for b, at in ((x, i), (y, j)))
    done_p, done_q = ([b.count[at] <= k for k in range(len(p))] for b, at in ((x, i), (y, j)))
    for k, (w, a, f, m) in enumerate(p):
        for o, (v, b, g, n) in enumerate(q):
            both, least = (m > 0) & (n > 0), np.minimum(m, n)
            edit = np.where(least < 4, 0, np.where(least < 6, 1, np.where(least < 10, 2, 3)))
            a_only, b_only = np.bitwise_count(a & ~b), np.bitwise_count(b & ~a)
            fit = (w == v) | ((a_only <= edit) & (b_only <= edit) & (np.abs(m - n) <= edit))
            fit |= (f == g) & (least > 1) & (np.abs(m - n) > 1) & (np.where(m < n, a_only, b_only) == 0)
            # a short word of initials, or one with initials in the other's short word
            fit |= (m <= 4) & ((g & ~a) == 0) | (n <= 4) & ((f & ~b) == 0)
            # a word that holds the other
            fit |= (n >= 3) & (m > n) & (b_only == 0) | (m >= 3) & (n > m) & (a_only == 0)
            fit &= both
            done_p[k] = done_p[k] | fit
            done_q[o] = done_q[o] | fit
    for one, two, done_one, done_two in ((p, q, done_p, done_q), (q, p, done_q, done_p)):
        for k, (_, a, _, m) in enumerate(one):
            for (o, (_, b, _, n)), (r, (_, c, _, l)) in combinations(enumerate(two), 2):
                # a word that is two words of the other
                at = np.flatnonzero((np.abs(m - n - l) <= 3) & (m > 0) & (n > 0) & (l > 0))
                whole, of = a[at], b[at] | c[at]
                at = at[(np.bitwise_count(whole & ~of) <= 3) & (np.bitwise_count(of & ~whole) <= 3)]
                done_one[k][at] = done_two[o][at] = done_two[r][at] = True
    return unknown | np.logical_and.reduce(done_p) | np.logical_and.reduce(done_q)


def near_rows(x: Block, y: Block, near: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in x and y of the pairs of cosine `near` and more and their cosines, in pieces; x may be y, then each pair once."""
    postings, got, n = y.postings(), [], 0
    for i, row in enumerate(x.rows):
        sums = np.zeros(len(y.forms))
        for g, w in row.items():
            if g in postings:
                at, of = postings[g]
                sums[at] += w * of
        j = np.flatnonzero(sums >= near)
        j = j[j > i] if x is y else j
        got.append((np.full(len(j), i), j, sums[j]))
        n += len(j)
        if n >= 50_000:
            yield tuple(map(np.concatenate, zip(*got)))
            got, n = [], 0
    if got:
        yield tuple(map(np.concatenate, zip(*got)))


def _met(forms: DataFrame, near: float, kept: Callable[[str, str], bool] | None = None) -> DataFrame:
    """(a, b, cosine, form_a, form_b), a < b, of the forms (id, form) of cosine `near` and more, of which `kept` says yes.

    The forms are dealt to blocks, and each two blocks meet in one task, which makes the vectors itself and sums products in place: what is exchanged is each form
    once for every block, not its products with others.
    """
    spark, n = forms.sparkSession, forms.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // BLOCK), min(-(-n // LEAST_BLOCK), math.ceil(2 * math.sqrt(parts))), 1)
    shared = spark.sparkContext.broadcast(weights(forms, n))

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("id")
        sides = [Block(s["id"], s["form"], shared.value) for _, s in pair.groupby("side")]
        out = []
        if pair["p"].iloc[0] == pair["q"].iloc[0] or len(sides) == 2:
            x, y = sides[0], sides[-1]
            for i, j, cosine in near_rows(x, y, near):
                if kept:
                    yes = np.flatnonzero(could_agree(x, i, y, j))
                    i, j, cosine = i[yes], j[yes], cosine[yes]
                    yes = np.array([kept(*sorted((x.forms[k], y.forms[o]))) for k, o in zip(i.tolist(), j.tolist())], bool)  # in one order, whatever the blocks
                    i, j, cosine = i[yes], j[yes], cosine[yes]
                out += [(min(a, b), max(a, b), c, x.forms[k], y.forms[o]) for a, b, c, k, o in zip(x.ids[i].tolist(), y.ids[j].tolist(), cosine.tolist(), i.tolist(), j.tolist())]
        return pd.DataFrame(out, columns=["a", "b", "cosine", "x", "y"])

    side = forms.select("id", "form", F.pmod("id", F.lit(blocks)).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    dealt = side.select("id", "form", "side", F.least("side", "o").alias("p"), F.greatest("side", "o").alias("q"))
    # few bytes but much work a row: a fixed number of partitions isn't joined into one
    return dealt.repartition(blocks * (blocks + 1) // 2, "p", "q").groupBy("p", "q").applyInPandas(run, "a long, b long, cosine double, x string, y string")


def similar_forms(forms: DataFrame, near: float = NEAR) -> DataFrame:
    """(a, b, cosine), a < b: the ids of all forms of cosine `near` and more."""
    return _met(forms, near).select("a", "b", "cosine")


def agreeing(forms: DataFrame, near: float = NEAR) -> DataFrame:
    """(a, b, sim), the forms themselves, of the pairs of cosine `near` and more that don't contradict each other, checked where they meet."""
    return _met(forms, near, agree).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("cosine").alias("sim"))


def linkage_in_rounds(edges: DataFrame, least: float = LINK) -> DataFrame:
    """(node, label) of the nodes that were grouped. `edges` (a, b, sim), a < b; absent pairs count as 0.

    Rounds are written as tables: a checkpoint keeps the size that Spark estimated, which joins square from round to round.
    A round merges all reciprocal nearest pairs; sums of similarities and sizes are kept, so averages stay exact.
    """
    e = stored(edges.select("a", "b", F.col("sim").alias("s"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    labels = stored(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        good = e.withColumn("avg", F.col("s") / (F.col("na") * F.col("nb"))).where(F.col("avg") >= least)
        ends = good.select(F.col("a").alias("x"), F.col("b").alias("y"), "avg", "a", "b").unionAll(good.select(F.col("b").alias("x"), F.col("a").alias("y"), "avg", "a", "b"))
        best = ends.groupBy("x").agg(F.min(F.struct((-F.round("avg", 9)).alias("k"), "a", "b")).alias("m")).select("x", "m.a", "m.b")
        merges = stored(best.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select(F.col("b").alias("old"), F.col("a").alias("new")))
        if merges.isEmpty():
            return labels
        found = broadcast_if_small(merges)  # counted once a round
        sizes = e.select(F.col("a").alias("x"), F.col("na").alias("n")).unionAll(e.select(F.col("b").alias("x"), F.col("nb").alias("n"))).distinct()
        named = sizes.withColumnRenamed("x", "old").join(found, "old", "left").select(F.coalesce("new", "old").alias("x"), "n").groupBy("x").agg(F.sum("n").alias("n"))
        moved = e.select("a", "b", "s").withColumnRenamed("a", "old").join(found, "old", "left").select(F.coalesce("new", "old").alias("a"), "b", "s")
        moved = moved.withColumnRenamed("b", "old").join(found, "old", "left").select("a", F.coalesce("new", "old").alias("b"), "s").where("a <> b")
        moved = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"))
        named = broadcast_if_small(stored(named))
        moved = moved.join(named.select(F.col("x").alias("a"), F.col("n").alias("na")), "a").join(named.select(F.col("x").alias("b"), F.col("n").alias("nb")), "b")
        e = stored(moved.select("a", "b", "s", "na", "nb"))
        labels = stored(labels.withColumnRenamed("label", "old").join(found, "old", "left").select("node", F.coalesce("new", "old").alias("label")))


def components(edges: DataFrame) -> DataFrame:
    """(node, part): the connected part of each node of `edges` (a, b), named by its smallest node."""
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parts = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("part")).withColumnRenamed("a", "node"))
    while True:
        # the smallest part among the neighbours', and the part that stands for one's own part
        near = both.join(parts.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("near"))
        own = parts.withColumnRenamed("part", "head").join(parts.select(F.col("node").alias("head"), F.col("part").alias("further")), "head")
        moved = stored(own.join(near, "node").select("node", F.least("further", "near").alias("part"), (F.least("further", "near") < F.col("head")).alias("moved")))
        parts = moved.select("node", "part")
        if moved.where("moved").isEmpty():
            return parts


def linked(edges: list[tuple[str, str, float]], least: float) -> dict[str, str]:
    """Label of each node after average linkage of one part, one merge at a time."""
    near: dict[str, dict[str, float]] = {}
    for a, b, s in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = s
    held = {n: [n] for n in near}
    heap = [(-round(s, 9), min(a, b), max(a, b)) for a, b, s in edges if s >= least]
    heapify(heap)
    while heap:
        s, a, b = heappop(heap)
        if b not in near.get(a, ()) or -round(near[a][b] / (len(held[a]) * len(held[b])), 9) != s:
            continue  # one of both has grown or is gone
        for c, t in near.pop(b).items():
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0.0) + t
                del near[c][b]
        del near[a][b]
        held[a] += held.pop(b)
        for c, t in near[a].items():
            mean = t / (len(held[a]) * len(held[c]))
            if mean >= least:
                heappush(heap, (-round(mean, 9), min(a, c), max(a, c)))
    return {n: label for label, nodes in held.items() for n in nodes}


def average_linkage(edges: DataFrame, least: float = LINK) -> DataFrame:
    """(node, label) of the nodes of `edges` (a, b, sim), a < b; absent pairs count as 0.

    Each connected part of up to PART edges is linked in one task; larger ones, which no task should hold, in rounds over all tasks.
    """
    edges = cut(edges)
    sized = edges.join(components(edges).withColumnRenamed("node", "a"), "a")
    many = cut(sized.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("part"))
    large = broadcast_if_small(many)
    small = sized.join(large, "part", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, out = None, [], {}
        for b in batches:
            for part, *edge in zip(b["part"], b["a"], b["b"], b["sim"]):
                if part != last and held:
                    out |= linked(held, least)
                    held = []
                last = part
                held.append(edge)
            if len(out) > 100_000:
                yield pd.DataFrame(out.items(), columns=["node", "label"])
                out = {}
        if held:
            out |= linked(held, least)
        yield pd.DataFrame(out.items(), columns=["node", "label"])

    done = small.select("part", "a", "b", "sim").repartition("part").sortWithinPartitions("part").mapInPandas(run, "node string, label string")
    return done if many.isEmpty() else done.unionByName(linkage_in_rounds(sized.join(large, "part", "left_semi").select("a", "b", "sim"), least))


def groups(df: DataFrame, column: str) -> DataFrame:
    """(name, label): the group of every spelling that names somebody."""
    names = cut(spellings(df, column))
    forms = cut(names.select("form").distinct().withColumn("id", F.xxhash64("form")))
    labels = average_linkage(agreeing(forms))
    # a form has few spellings next to the forms of all names, and a label is joined once per spelling: no form is hot
    return lookup(names, labels.select(F.col("node").alias("form"), "label"), "form", salts=1).select("name", F.coalesce("label", "form").alias("label"))


def same_pairs(df: DataFrame, column: str = "employer") -> DataFrame:
    """(employer_a, employer_b), a < b: spellings of the same organisation."""
    g = cut(groups(df, column))
    return g.alias("x").join(g.alias("y"), "label").where("x.name < y.name").select(F.col("x.name").alias("employer_a"), F.col("y.name").alias("employer_b"))
