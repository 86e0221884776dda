"""Queries of the problems solved in the core: pay units (4) and snapshot changes (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import snapshots as S
from quarrymill.operators import units as U
from quarrymill.session import table

CHANGE_COLUMNS = ["publisher", "employment_type", "is_remote", "salary_min_raw", "salary_max_raw", "salary_period_raw", "apply_link"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return U.pay_cases(table(spark, d, "jobs_clean"))


def p4_annual_pay(spark: SparkSession, d: str) -> DataFrame:
    return U.annual_pay(table(spark, d, "jobs_clean"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return S.changes_by_index(table(spark, d, "posting_snapshots"), "dedup_key", "fetched_at", CHANGE_COLUMNS)


def p6_changed_values(spark: SparkSession, d: str) -> DataFrame:
    """Which columns changed, from what to what."""
    return S.changed_values(table(spark, d, "posting_snapshots"), "dedup_key", "fetched_at", CHANGE_COLUMNS)


def p6_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("snapshot_date", "change_kind").agg(F.count("*").alias("n_keys"))


_SQUEEZE = "nullif(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '')"
_P6 = f"""
WITH s AS (
  SELECT CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) AS d, dedup_key AS k, fetched_at, publisher, employment_type, is_remote,
         salary_min_raw, salary_max_raw, salary_period_raw, apply_link
  FROM posting_snapshots WHERE dedup_key IS NOT NULL AND fetched_at IS NOT NULL
), w AS (
  SELECT d, k, concat_ws('|', {", ".join(f"coalesce({_SQUEEZE.format(c=c)}, chr(1))" for c in ("publisher", "employment_type"))},
    coalesce(CAST(is_remote AS VARCHAR), chr(1)), coalesce(CAST(salary_min_raw AS VARCHAR), chr(1)), coalesce(CAST(salary_max_raw AS VARCHAR), chr(1)),
    {", ".join(f"coalesce({_SQUEEZE.format(c=c)}, chr(1))" for c in ("salary_period_raw", "apply_link"))}) AS v,
    row_number() OVER (PARTITION BY d, k ORDER BY fetched_at DESC) AS r FROM s
), one AS (SELECT d, k, v FROM w WHERE r = 1),
dates AS (SELECT d, lag(d) OVER (ORDER BY d) AS p FROM (SELECT DISTINCT d FROM one)),
a AS (SELECT dates.d, o.k, o.v FROM dates JOIN one o ON o.d = dates.d WHERE p IS NOT NULL),
b AS (SELECT dates.d, o.k, o.v FROM dates JOIN one o ON o.d = dates.p),
found AS (
SELECT strftime(coalesce(a.d, b.d), '%Y-%m-%d') AS snapshot_date, coalesce(a.k, b.k) AS dedup_key,
  CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL OUTER JOIN b ON a.d = b.d AND a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v)
"""

_NORMAL = {"publisher": True, "employment_type": True, "is_remote": False, "salary_min_raw": False, "salary_max_raw": False, "salary_period_raw": True, "apply_link": True}
_P6_VALUES = f"""
WITH s AS (
  SELECT CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) AS d, dedup_key AS k, fetched_at,
    {", ".join((_SQUEEZE.format(c=c) if text else c if c == "is_remote" else f"CAST({c} AS DECIMAL(28,2))") + f" AS {c}" for c, text in _NORMAL.items())}
  FROM posting_snapshots WHERE dedup_key IS NOT NULL AND fetched_at IS NOT NULL
), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d, k ORDER BY fetched_at DESC) AS r FROM s) WHERE r = 1),
dates AS (SELECT d, lag(d) OVER (ORDER BY d) AS p FROM (SELECT DISTINCT d FROM one)),
j AS (SELECT dates.d, n.k, {", ".join(f"o.{c} AS o_{c}, n.{c} AS n_{c}" for c in _NORMAL)}
  FROM dates JOIN one n ON n.d = dates.d JOIN one o ON o.d = dates.p AND o.k = n.k)
{" UNION ALL ".join(f"SELECT strftime(d, '%Y-%m-%d') AS snapshot_date, k AS dedup_key, '{c}' AS column_name, CAST(o_{c} AS VARCHAR) AS old_value, CAST(n_{c} AS VARCHAR) AS new_value FROM j WHERE o_{c} IS DISTINCT FROM n_{c}" for c in _NORMAL)}
"""

QUERIES = {"p4_found": p4_found, "p4_annual_pay": p4_annual_pay, "p6_found": p6_found, "p6_change_counts": p6_change_counts, "p6_changed_values": p6_changed_values}
ORACLES = {
    "p6_found": _P6 + "SELECT * FROM found",
    "p6_change_counts": _P6 + "SELECT snapshot_date, change_kind, count(*) AS n_keys FROM found GROUP BY 1, 2",
    "p6_changed_values": _P6_VALUES,
}
