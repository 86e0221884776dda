"""Years of experience asked for in text: numbers beside "years", accepted by context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_YEARS, CONTEXT, LEAD = 30, 8, 3
#: Numbers in words.
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
NUMBERS = {w: i for i, w in enumerate(_SMALL)} | {"thirty": 30}
#: Words that lead to, or stand around, a number of years.
LEAD_WORDS = frozenset("least minimum min over than".split())
CONTEXT_WORDS = frozenset("experience experienced exp".split())
_UNITS = frozenset("year years yr yrs".split())
_TOKEN = re.compile(r"\d[\d,]*(?:\.\d+)?|\w+|[^\w\s]")


def _number(t: str) -> float | None:
    t = t.lower().replace(",", "")
    return float(t) if re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", t) else NUMBERS.get(t)


def mentions(text: str | None) -> list[tuple[str, float, float | None]]:
    """(words, least, most or None) of each accepted mention, in order."""
    s = re.sub(r"[–—]", "-", text or "")
    s = re.sub(r"(\d\+)(?=[A-Za-z])", r"\1 ", s)
    s = re.sub(r"(\d)(?=(?:yrs?|years?)\b)", r"\1 ", s, flags=re.I)
    toks = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(s)]
    low = [t[0].lower() for t in toks]
    out, i = [], 0
    while i < len(toks):
        a = _number(toks[i][0])
        if a is None:
            i += 1
            continue
        j, b, plus = i + 1, None, False
        if j + 1 < len(toks) and low[j] in ("-", "to", "or") and _number(toks[j + 1][0]) is not None:
            b, j = _number(toks[j + 1][0]), j + 2
        if j < len(toks) and low[j] == "+":
            plus, j = True, j + 1
        if j < len(toks) and low[j] == ")":
            j += 1
        if j >= len(toks) or low[j] not in _UNITS:
            i += 1
            continue
        high = max(a, b) if b is not None else a
        after = low[j + 1] if j + 1 < len(toks) else ""
        lead = any(t in LEAD_WORDS for t in low[max(0, i - LEAD) : i])
        near = any(t in CONTEXT_WORDS for t in low[max(0, i - CONTEXT) : i] + low[j + 1 : j + 1 + CONTEXT])
        if after not in ("ago", "old") and high <= MOST_YEARS and (plus or b is not None or lead or near):
            least = min(a, b) if b is not None else a
            most = None if plus or lead and b is None else float(high)
            out.append((s[toks[i][1] : toks[j][2]], float(least), most))
        i = j + 1
    return out


def summary(text: str | None) -> tuple[float | None, float | None, int, str | None]:
    """The mention with the greatest least years (the first of equals), and how many there are."""
    m = mentions(text)
    if not m:
        return None, None, 0, None
    best = max(m, key=lambda x: x[1])
    return best[1], best[2], len(m), best[0]


def posting_years(jobs: DataFrame, key: str = "job_id", text: str = "description") -> DataFrame:
    """(key, years_min, years_max, years_mentions, years_evidence)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([summary(t) for t in b["t"]], columns=["years_min", "years_max", "years_mentions", "years_evidence"])
            out.insert(0, key, b["k"].values)
            yield out

    kind = jobs.schema[key].dataType.simpleString()
    return jobs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, years_min double, years_max double, years_mentions int, years_evidence string")
