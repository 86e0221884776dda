"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import canonical, cooccurrence, leaks, mixing, names, neighbours, percentiles, stuffing
from quarrymill.session import spread, table

ERROR = 0.01
POINTS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, "n", *[F.round(x, 2).alias(x) for x in POINTS])


def _days(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.sketch(table(spark, d, "jobs_clean"), "salary_mid_annual", ["search_role", "state_code", "ingest_date"], ERROR)


def p1_salary_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles for every role and state, and for each role alone, from the sketches of the days, merged."""
    by = ["search_role", "state_code"]
    both = percentiles.merge(_days(spark, d), by)
    cells = percentiles.percentiles(both, by, POINTS, ERROR).withColumn("grain", F.lit("role_state"))
    roles = percentiles.percentiles(percentiles.merge(both, by[:1]), by[:1], POINTS, ERROR).withColumn("state_code", F.lit(None).cast("string")).withColumn("grain", F.lit("role"))
    return _rounded(cells.unionByName(roles), "grain", *by)


def p1_daily_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The same for every day by itself."""
    by = ["search_role", "state_code", "ingest_date"]
    return _rounded(percentiles.percentiles(_days(spark, d), by, POINTS, ERROR).withColumn("ingest_date", F.col("ingest_date").cast("string")), *by)


def p1_daily_sketch(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable sketch itself: counts by day, role, state and bucket."""
    got = percentiles.sketch(table(spark, d, "jobs_clean"), "salary_mid_annual", ["ingest_date", "search_role", "state_code"], ERROR)
    return got.withColumn("ingest_date", F.col("ingest_date").cast("string"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_pairs(table(spark, d, "jobs_clean"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return names.groups(table(spark, d, "jobs_clean"), "employer").withColumnRenamed("name", "employer")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(spread(table(spark, d, "posting_vectors")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    got = cooccurrence.pairs(table(spark, d, "job_skills"), "job_id", "skill", least_count=5, least_share=0.003, least_lift=3.0)
    return got.select(F.col("item_a").alias("skill_a"), F.col("item_b").alias("skill_b"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    got = cooccurrence.pairs(table(spark, d, "job_skills"), "job_id", "skill")
    return got.select(F.col("item_a").alias("skill_a"), F.col("item_b").alias("skill_b"), "n_both", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 4).alias("odds_ratio"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.mapped(table(spark, d, "jobs_clean"), table(spark, d, "reference_values"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(p8_found(spark, d), table(spark, d, "eval_items"))


def p8_paraphrased(spark: SparkSession, d: str) -> DataFrame:
    return leaks.paraphrased(spread(table(spark, d, "documents")), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed(spread(table(spark, d, "documents")))


def p10_measures(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.page_measures(spread(table(spark, d, "documents")))


QUERIES = {
    "p1_salary_percentiles": p1_salary_percentiles, "p1_daily_percentiles": p1_daily_percentiles, "p1_daily_sketch": p1_daily_sketch,
    "p2_found": p2_found, "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p5_found": p5_found, "p5_pairs": p5_pairs,
    "p7_found": p7_found,
    "p8_found": p8_found, "p8_items": p8_items, "p8_paraphrased": p8_paraphrased,
    "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_measures": p10_measures,
}

_G = percentiles.growth(ERROR)
_FIRST = math.ceil(math.log(percentiles.SMALLEST) / math.log(_G)) - 1
_BUCKET = f"""CASE WHEN abs(salary_mid_annual) < {percentiles.SMALLEST} THEN 0
  ELSE CAST(sign(salary_mid_annual) AS INTEGER) * greatest(CAST(ceil(ln(abs(salary_mid_annual)) / {math.log(_G)!r}) AS INTEGER) - ({_FIRST}), 1) END"""
_VALUES = "FROM jobs_clean WHERE salary_mid_annual IS NOT NULL AND NOT isnan(salary_mid_annual) AND NOT isinf(salary_mid_annual)"
_MIDDLE = f"round(sign(b) * {2 / (_G + 1)!r} * exp((abs(b) + ({_FIRST})) * {math.log(_G)!r}), 2)"


def _disc(name: str, p: float) -> str:
    """The bucket of the value of rank floor(p (n-1)) among the sorted values themselves."""
    return f"list_extract(bs, CAST(floor({p} * (n - 1)) AS BIGINT) + 1) AS {name}"


def _p1(grains: list[tuple[str, list[str]]], columns: str) -> str:
    keys = ("search_role", "state_code", "ingest_date")
    g = " UNION ALL ".join(f"SELECT '{name}' AS grain, {', '.join(c if c in by else f'NULL AS {c}' for c in keys)}, list_sort(list(b)) AS bs, count(*) AS n FROM v GROUP BY {', '.join(by)}" for name, by in grains)
    return f"""WITH v AS (SELECT CAST(ingest_date AS VARCHAR) AS ingest_date, search_role, state_code, {_BUCKET} AS b {_VALUES}), g AS ({g}),
q AS (SELECT grain, search_role, state_code, ingest_date, n, {", ".join(_disc(k, p) for k, p in POINTS.items())} FROM g)
SELECT {columns}, n, {", ".join(f"{_MIDDLE.replace('(b)', f'({k})')} AS {k}" for k in POINTS)} FROM q"""


_P5 = """
WITH b AS (SELECT DISTINCT job_id, skill FROM job_skills WHERE job_id IS NOT NULL AND trim(skill) <> ''),
n AS (SELECT count(DISTINCT job_id) AS n FROM b),
c AS (SELECT skill, count(*) AS c FROM b GROUP BY skill),
p AS (SELECT x.skill AS skill_a, y.skill AS skill_b, count(*) AS n_both FROM b x JOIN b y ON x.job_id = y.job_id AND x.skill < y.skill GROUP BY 1, 2),
r AS (SELECT p.*, ca.c AS n_a, cb.c AS n_b, n.n FROM p JOIN c ca ON ca.skill = skill_a JOIN c cb ON cb.skill = skill_b CROSS JOIN n)
"""

ORACLES = {
    "p1_salary_percentiles": _p1([("role_state", ["search_role", "state_code"]), ("role", ["search_role"])], "grain, search_role, state_code"),
    "p1_daily_percentiles": _p1([("day", ["search_role", "state_code", "ingest_date"])], "search_role, state_code, ingest_date"),
    "p1_daily_sketch": f"SELECT CAST(ingest_date AS VARCHAR) AS ingest_date, search_role, state_code, {_BUCKET} AS bucket, count(*) AS n {_VALUES} GROUP BY 1, 2, 3, 4",
    "p5_found": _P5 + "SELECT skill_a, skill_b FROM r WHERE n_both >= 5 AND n_both >= 0.003 * n AND n_both * n >= 3 * n_a * n_b",
    "p5_pairs": _P5 + """SELECT skill_a, skill_b, n_both, n_a, n_b, round(n_both * 1e0 * n / n_a / n_b, 6) AS lift,
  round((n_both + 0.5e0) * (n - n_a - n_b + n_both + 0.5e0) / ((n_a - n_both + 0.5e0) * (n_b - n_both + 0.5e0)), 4) AS odds_ratio FROM r""",
}
