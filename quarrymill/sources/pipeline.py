"""The stages of a run in order, and a cache of results with a lifetime."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.functions.lexicon import posting_skills
from quarrymill.functions.years import posting_years
from quarrymill.operators import relational as R
from quarrymill.sources import raw, sinks


def clean(envelopes: DataFrame) -> dict[str, DataFrame]:
    """jobs_clean (best copy of each content key), job_sightings (every collection) and job_skills."""
    n = raw.normalise(raw.flatten(envelopes))
    one = R.best_per_content(R.latest_per_key(n, ["job_id"], "fetched_at"))
    return {"jobs_clean": one, "job_sightings": raw.sightings(n), "job_skills": posting_skills(one)}


def run(spark: SparkSession, raw_root: str, out_root: str, loaded_at: str) -> dict[str, int]:
    """Raw envelopes -> cleaned tables with experience years, replaced together. Running again gives the same tables."""
    tables = clean(raw.read_envelopes(spark, f"{raw_root}/*/*/*.json"))
    tables["posting_nlp"] = posting_years(tables["jobs_clean"])
    return sinks.replace_all({f"{out_root}/{k}.parquet": sinks.with_loaded_at(df, loaded_at) for k, df in tables.items()})


def run_stages(stages: list[tuple[str, Callable[[], object]]], retries: int = 0) -> dict[str, object]:
    """Runs named stages in order; a stage that still fails after its retries ends the run."""
    out = {}
    for name, stage in stages:
        for k in range(retries + 1):
            try:
                out[name] = stage()
                break
            except Exception:
                if k == retries:
                    raise
    return out


class ResultCache:
    """Cached DataFrames by name and arguments for `seconds`; DataFrames can't be changed by a reader, so hits need no copy."""

    def __init__(self, seconds: float = 3600, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            return self.held[key][1]
        if key in self.held:
            self.held.pop(key)[1].unpersist()
        df = make().cache()
        self.held[key] = (now, df)
        return df
