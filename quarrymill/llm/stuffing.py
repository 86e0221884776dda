"""Keyword-stuffed and link-list pages (problem 10).

Each page's words, links and tags become symbols of a suffix automaton; the maximal substrings that occur `TIMES` times or more are repeated
phrases, and the characters under them are the page's coverage. A compound ("sql-jobs-near-me") has a symbol for each of its parts, all
numbers are one symbol, all links and tags are another. Coverage also decides where clauses are: a clause is a stretch between
separators, line breaks and sentence ends of `CLAUSE` words of which no more than half of the characters are covered. A page is stuffed
if more than half of its words lie outside of clauses and coverage there is at least `COVER`. No list of words and no language is involved: a list of
different bullet points or skills lacks coverage, and repeated phrases are no clauses even if punctuated.

The automaton takes time and space in proportion to the symbols that belong to a pair that occurs `TIMES` times; others can't lie under a
repeated phrase and are left out beforehand, which changes no result. Pages are independent: one pass, no exchange.

Defined cases. Null, empty and blank texts, and texts without a letter, digit or link, aren't stuffed. A link with its markup is one word. Repeated rows each get
their result. Whole texts are read, however long. Columns besides id and text don't matter.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Occurrences and symbols that make a substring a repeated phrase.
TIMES, PHRASE = 3, 2
#: Fewest and most words of a clause; longer stretches without any break are enumerations.
CLAUSE = (5, 60)
#: Least share of the characters outside of clauses that repeated phrases cover.
COVER = 0.25
#: Characters that a link or tag counts for.
LINK_SIZE = 8
#: What a token may be besides a word: a link or tag, the end of a sentence.
LINK, END = 2, 1
_LINK = re.compile(r"<a\s[^<>]*>[^<]*</a\s*>|\[[^\[\]\n]*\]\(\s*[^()\s]*\s*\)|(?:https?://|www\.)[^\s<>|»]+", re.I)
_TOKEN = re.compile(r"\x02|\n+|[|·•»;]|(?<=\s)[-–—](?=\s)|[^\s|·•»;\x02]+")
_SEPARATORS = frozenset("|·•»;-–—")
_WRAP = re.compile(r"(?<=[^\s.!?:\x02])(?:<br\s*/?>)?[ \t]*\n[ \t>]*(?=[a-z])")  # a line that goes on in the next
_END = re.compile(r"[.!?:]+[\"')\]]*$")
_PART = re.compile(r"\d[\d.,]*|[^\W\d_]+")


class Automaton:
    """Suffix automaton over a sequence of ints, with the number of occurrences of each state's substrings.

    Transitions are one dictionary for all states, and edges are chained in arrays, so that a long page takes no dictionary a word.
    """

    def __init__(self, seq: list[int]):
        link, length, count = array("q", [-1]), array("q", [0]), array("q", [0])
        to: dict[tuple[int, int], int] = {}
        first, after, symbol = array("q", [-1]), array("q"), array("q")  # edges of a state: a chain of symbols

        def edge(state: int, c: int, target: int) -> None:
            to[state, c] = target
            symbol.append(c)
            after.append(first[state])
            first[state] = len(symbol) - 1

        last, self.ends = 0, array("q")
        for c in seq:
            cur = len(link)
            link.append(0)
            length.append(length[last] + 1)
            count.append(1)
            first.append(-1)
            p = last
            while p != -1 and (p, c) not in to:
                edge(p, c, cur)
                p = link[p]
            if p != -1:
                q = to[p, c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    count.append(0)
                    first.append(-1)
                    e = first[q]
                    while e != -1:
                        edge(clone, symbol[e], to[q, symbol[e]])
                        e = after[e]
                    while p != -1 and to.get((p, c)) == q:
                        to[p, c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
            self.ends.append(cur)
        self.link, self.length = link, length
        order = sorted(range(1, len(length)), key=length.__getitem__)
        for v in reversed(order):
            if link[v] > 0:
                count[link[v]] += count[v]
        self.order, self.count = order, count

    def repeated(self, times: int, least: int) -> list[bool]:
        """For each position, whether a substring of `least` or more symbols with `times` or more occurrences covers it."""
        reach = array("q", bytes(8 * len(self.length)))  # longest suffix of the state's strings that occurs often enough
        for v in self.order:
            reach[v] = self.length[v] if self.count[v] >= times else reach[self.link[v]]
        covered, until = [False] * len(self.ends), len(self.ends)
        for i in range(len(self.ends) - 1, -1, -1):
            n = reach[self.ends[i]]
            if n >= least:
                until = min(until, i - n + 1)
            if i >= until:
                covered[i] = True
            if i <= until:
                until = len(self.ends)
        return covered


def coverage(seq: list[int], times: int = TIMES, least: int = PHRASE) -> np.ndarray:
    """For each symbol, whether a substring of `least` (two or more) symbols with `times` occurrences covers it.

    A repeated phrase consists of pairs that occur as often; all that isn't in such a pair becomes a break before the automaton is built.
    """
    covered = np.zeros(len(seq), bool)
    pairs = list(zip(seq, seq[1:]))
    often = {p for p, n in Counter(pairs).items() if n >= times}
    if not often:
        return covered
    at, lean, broken = [], [], -1
    kept = [p in often for p in pairs]
    for i, c in enumerate(seq):
        before, behind = i > 0 and kept[i - 1], i < len(kept) and kept[i]
        if before or behind:
            if not before and lean:
                lean.append(broken)
                at.append(-1)
                broken -= 1
            lean.append(c)
            at.append(i)
    hit = [i for i, c in zip(at, Automaton(lean).repeated(times, least)) if c and i >= 0]
    covered[hit] = True
    return covered


class Symbols:
    """Token -> (numbers of its symbols, their characters, LINK or END or 0), remembered from page to page within a worker."""

    MOST = 500_000

    def __init__(self):
        self.ids, self.known = {}, {}

    def fresh(self) -> dict:
        """What is known at the start of a page; numbers hold for the whole page. Forgetting starts over, so a worker's memory is bounded."""
        if len(self.known) > self.MOST:
            self.ids, self.known = {}, {}
        return self.known

    def add(self, token: str) -> tuple[tuple[int, ...], tuple[int, ...], int]:
        if token == "\x02" or (token[0] == "#" and len(token) > 1 and (token[1].isalnum() or token[1] == "_")):
            got = ((self.ids.setdefault("\x02", len(self.ids)),), (LINK_SIZE,), LINK)
        else:
            parts = ["0" if p[0].isdigit() else p for p in _PART.findall(token.lower())]
            got = (tuple(self.ids.setdefault(p, len(self.ids)) for p in parts), tuple(map(len, parts)), END if _END.search(token) else 0)
        self.known[token] = got
        return got


_SYMBOLS = Symbols()


def measures(text: str | None) -> tuple[int, int, int, int, float, float]:
    """(words, links and tags, words outside of clauses, covered words, coverage of all characters, coverage outside of clauses)."""
    nothing = (0, 0, 0, 0, 0.0, 0.0)
    if not text or not text.strip():
        return nothing
    known, add = _SYMBOLS.fresh(), _SYMBOLS.add
    symbols: list[int] = []
    size, starts, breaks = [], [], []  # of each symbol; first symbols of words; first symbols of segments
    links = 0
    for t in _TOKEN.findall(_WRAP.sub(" ", _LINK.sub(" \x02 ", text))):
        if t in _SEPARATORS or t[0] == "\n":
            breaks.append(len(symbols))
            continue
        own, chars, end = known.get(t) or add(t)
        if own:
            starts.append(len(symbols))
            if end == LINK:
                links += 1
                breaks.append(len(symbols))
            symbols += own
            size += chars
        if end:
            breaks.append(len(symbols))
    n = len(symbols)
    if not n:
        return nothing
    covered, chars = coverage(symbols), np.array(size)
    first, new = np.zeros(n, bool), np.zeros(n + 1, bool)
    first[starts] = True
    new[breaks] = True
    segment = np.cumsum(new[:n])
    words, whole, under = np.bincount(segment, first), np.bincount(segment, chars), np.bincount(segment, chars * covered)
    clause = (words >= CLAUSE[0]) & (words <= CLAUSE[1]) & (2 * under <= whole)
    out = ~clause[segment]
    outside = chars[out].sum()
    return len(starts), links, int((first & out).sum()), int((first & covered).sum()), float(chars[covered].sum() / chars.sum()), float(chars[covered & out].sum() / max(1, outside))


def page_measures(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_links, n_outside, n_covered, coverage, outside_coverage) of every row with an id."""
    kind = docs.schema[id_].dataType.simpleString()
    columns = ["n_words", "n_links", "n_outside", "n_covered", "coverage", "outside_coverage"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([measures(t) for t in b["t"]], columns=columns)
            out.insert(0, "doc_id", b["i"].values)
            yield out

    rows = docs.where(docs[id_].isNotNull()).select(docs[id_].alias("i"), docs[text].alias("t"))
    return rows.mapInPandas(run, f"doc_id {kind}, n_words long, n_links long, n_outside long, n_covered long, coverage double, outside_coverage double")


def stuffed(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id) of the stuffed pages, each once."""
    return page_measures(docs, id_, text).where(f"2 * n_outside > n_words and outside_coverage >= {COVER}").select("doc_id").distinct()
