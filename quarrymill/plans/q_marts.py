"""Queries over the star schema and marts of the postings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import postings as P
from quarrymill.ml import forecast, salary
from quarrymill.operators import relational as R
from quarrymill.operators.joins import lookup
from quarrymill.plans.marts import ROLE_SEED, Warehouse
from quarrymill.session import within
from quarrymill.sources.raw import normalise


def texts(df: DataFrame) -> DataFrame:
    """Dates and times as text and integers as bigint, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.date_format(c, "yyyy-MM-dd") if kind == "date" else F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else c.cast("long") if kind in ("int", "smallint") else c).alias(f.name))
    return df.select(*out)


def _of(name: str, drop: tuple[str, ...] = ()):
    return lambda spark, d: texts(getattr(Warehouse(spark, d), name).drop(*drop))


#: The time at which the fixed test tables are looked at.
NOW = "2026-10-30 00:00:00"
LEVEL_SQL = "CASE " + " ".join(f"WHEN regexp_matches(job_title, '\\b({w})\\b', 'i') THEN '{level}'" for level, w in P.LEVEL_WORDS.items()) + " END"
_SEED = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in ROLE_SEED)
_DAY = "CAST({} AT TIME ZONE 'UTC' AS DATE)"
_WEEK = "strftime(CAST(date_trunc('week', {} AT TIME ZONE 'UTC') AS DATE), '%Y-%m-%d')"

BASE = f"""
WITH stg_jobs AS (
  SELECT job_id, title AS job_title, employer AS employer_name, publisher, employment_type, is_remote, city, state_code, country AS country_code, posted_at, search_role, description,
    salary_min_annual, salary_max_annual, salary_mid_annual, salary_flag, apply_link, fetched_at, dedup_key
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY _loaded_at DESC NULLS LAST, fetched_at DESC NULLS LAST) AS r FROM jobs_clean WHERE job_id IS NOT NULL) WHERE r = 1),
stg_skills AS (SELECT job_id, skill AS skill_name, min(category) AS skill_category FROM job_skills WHERE job_id IS NOT NULL AND skill IS NOT NULL GROUP BY 1, 2),
stg_sightings AS (SELECT job_id, fetched_at, min(dedup_key) AS dedup_key, min(search_role) AS search_role FROM job_sightings GROUP BY 1, 2),
stg_bls AS (SELECT occupation_code AS soc_code, title AS occupation_title, median_wage AS median_annual_wage, total_employment, reference_year
  FROM (SELECT *, row_number() OVER (PARTITION BY occupation_code ORDER BY fetched_at DESC NULLS LAST, _loaded_at DESC NULLS LAST, median_wage DESC NULLS LAST, total_employment DESC NULLS LAST) AS r FROM bls_occupations) WHERE r = 1),
levelled AS (SELECT *, {LEVEL_SQL} AS lv FROM stg_jobs),
enriched AS (
  SELECT l.job_id, md5(lower(search_role)) AS role_key,
    CASE WHEN city IS NULL AND state_code IS NULL THEN md5('unknown') ELSE md5(lower(concat_ws('|', coalesce(city, ''), coalesce(state_code, ''), coalesce(country_code, '')))) END AS location_key,
    job_title, employer_name, publisher, employment_type, is_remote, city, state_code, country_code, search_role,
    strftime({_DAY.format("posted_at")}, '%Y-%m-%d') AS posted_date, {_WEEK.format("posted_at")} AS posted_week,
    coalesce(lv, 'mid') AS seniority, lv IS NOT NULL AS seniority_from_title, coalesce(lv, 'unknown') AS seniority_effective, CASE WHEN lv IS NOT NULL THEN 'title' ELSE 'none' END AS seniority_source,
    salary_min_annual, salary_max_annual, salary_mid_annual, salary_flag, salary_mid_annual IS NOT NULL AS has_salary, coalesce(n.c, 0) AS skill_count, apply_link, fetched_at, dedup_key
  FROM levelled l LEFT JOIN (SELECT job_id, count(*) AS c FROM stg_skills GROUP BY 1) n USING (job_id)),
skills_joined AS (SELECT s.*, e.search_role, e.has_salary, e.salary_mid_annual FROM stg_skills s JOIN enriched e USING (job_id)),
seed(search_role, soc_code, onet_soc_code, onet_title) AS (VALUES {_SEED}),
dim_role AS (SELECT md5(lower(search_role)) AS role_key, search_role AS role_name, seed.soc_code, onet_soc_code, onet_title, occupation_title AS bls_occupation_title, median_annual_wage AS bls_median_annual_wage,
  total_employment AS bls_total_employment, CAST(reference_year AS BIGINT) AS bls_reference_year FROM seed LEFT JOIN stg_bls ON stg_bls.soc_code = seed.soc_code),
dim_location AS (SELECT location_key, min(city) AS city, min(state_code) AS state_code, min(country_code) AS country_code, concat_ws(', ', min(city), min(state_code)) AS location_name, false AS is_unknown
  FROM enriched WHERE location_key <> md5('unknown') GROUP BY location_key UNION ALL SELECT md5('unknown'), NULL, NULL, NULL, 'Unknown', true),
bands AS (SELECT role_name, max(bls_median_annual_wage) AS bls, count(*) AS n_postings, count(*) FILTER (WHERE has_salary) AS n,
  quantile_cont(salary_mid_annual, 0.25) AS p25, quantile_cont(salary_mid_annual, 0.5) AS p50, quantile_cont(salary_mid_annual, 0.75) AS p75 FROM enriched JOIN dim_role USING (role_key) GROUP BY 1),
by_role_pairs AS (
  SELECT r.role_name, r.skill_name, r.skill_category, s.salary_mid_annual, p.job_id IS NOT NULL AS has
  FROM (SELECT DISTINCT search_role AS role_name, skill_name, skill_category FROM skills_joined) r
  JOIN (SELECT job_id, role_name, salary_mid_annual FROM enriched JOIN dim_role USING (role_key) WHERE has_salary) s USING (role_name)
  LEFT JOIN (SELECT DISTINCT job_id, skill_name FROM skills_joined) p ON p.job_id = s.job_id AND p.skill_name = r.skill_name),
all_pairs AS (
  SELECT r.skill_name, r.skill_category, s.salary_mid_annual, p.job_id IS NOT NULL AS has
  FROM (SELECT DISTINCT skill_name, skill_category FROM skills_joined) r CROSS JOIN (SELECT job_id, salary_mid_annual FROM enriched WHERE has_salary) s
  LEFT JOIN (SELECT DISTINCT job_id, skill_name FROM skills_joined) p ON p.job_id = s.job_id AND p.skill_name = r.skill_name),
"""


def _compare(pairs: str, keys: str, extra: str = "") -> str:
    return f"""SELECT {keys}{extra}, n1 AS n_with_skill, n0 AS n_without_skill, CASE WHEN n1 >= 5 AND n0 >= 5 THEN 'ok' ELSE 'too_few_to_report' END AS sample_status,
  round(m1) AS median_salary_with_skill, round(m0) AS median_salary_without_skill, CASE WHEN n1 >= 5 AND n0 >= 5 THEN round(m1 - m0) + 0e0 END AS median_salary_difference,
  CASE WHEN n1 >= 5 AND n0 >= 5 AND m0 > 0 THEN round(m1 / m0 - 1, 4) + 0e0 END AS median_salary_difference_pct
  FROM (SELECT {keys}, count(*) FILTER (WHERE has) AS n1, count(*) FILTER (WHERE NOT has) AS n0, quantile_cont(salary_mid_annual, 0.5) FILTER (WHERE has) AS m1,
    quantile_cont(salary_mid_annual, 0.5) FILTER (WHERE NOT has) AS m0 FROM {pairs} GROUP BY {keys})"""


_BY_ROLE = _compare("by_role_pairs", "role_name, skill_name, skill_category", ", n1 + n0 AS n_role_salaried")
DEMAND = f"""
sight AS (SELECT DISTINCT {_WEEK.format("fetched_at")} AS collection_week, search_role, dedup_key FROM stg_sightings WHERE dedup_key IS NOT NULL),
weeks AS (SELECT collection_week, search_role, count(DISTINCT dedup_key) AS role_postings FROM sight GROUP BY 1, 2),
pskills AS (SELECT DISTINCT j.dedup_key, s.skill_name, s.skill_category FROM stg_skills s JOIN stg_jobs j USING (job_id)),
seen AS (SELECT collection_week, search_role, skill_name, count(DISTINCT sight.dedup_key) AS n FROM sight JOIN pskills USING (dedup_key) GROUP BY 1, 2, 3),
items AS (SELECT DISTINCT search_role, skill_name, skill_category FROM sight JOIN pskills USING (dedup_key)),
demand AS (SELECT w.collection_week, w.search_role, i.skill_name, i.skill_category, coalesce(s.n, 0) AS postings_with_skill, w.role_postings, round(coalesce(s.n, 0) * 1e0 / w.role_postings, 4) AS share_of_role_postings
  FROM weeks w JOIN items i USING (search_role) LEFT JOIN seen s ON s.collection_week = w.collection_week AND s.search_role = w.search_role AND s.skill_name = i.skill_name),
"""
PROFILE = f"""
rp AS (SELECT role_name, count(*) AS n_role_postings FROM enriched JOIN dim_role USING (role_key) GROUP BY 1),
sp AS (SELECT search_role AS role_name, skill_name, skill_category, count(DISTINCT job_id) AS c FROM skills_joined GROUP BY 1, 2, 3),
pay AS ({_BY_ROLE}),
profile AS (SELECT sp.role_name, sp.skill_name, sp.skill_category, n_role_postings, c AS n_postings_with_skill, round(c * 1e0 / n_role_postings, 4) AS share_of_role_postings,
  row_number() OVER (PARTITION BY sp.role_name ORDER BY c DESC, sp.skill_name) AS demand_rank, coalesce(n_with_skill, 0) AS n_salaried_with_skill, coalesce(n_without_skill, 0) AS n_salaried_without_skill,
  coalesce(sample_status, 'too_few_to_report') AS salary_sample_status, median_salary_with_skill, median_salary_without_skill, median_salary_difference, median_salary_difference_pct
  FROM sp JOIN rp USING (role_name) LEFT JOIN pay ON pay.role_name = sp.role_name AND pay.skill_name = sp.skill_name),
"""


def sql(body: str, *more: str) -> str:
    return (BASE + "".join(more)).rstrip().rstrip(",") + "\n" + body


def fact_postings(spark, d):
    f = Warehouse(spark, d).fact.drop("experience_years_min", "experience_years_max", "fetched_at")
    return texts(f.withColumn("is_remote", F.col("is_remote").cast("string")))


def job_skill_array(spark, d):
    w = Warehouse(spark, d)
    return w.wide_postings.select("job_id", "role_name", "location_name", F.array_join("skills", ", ").alias("skills"), F.size("skills").cast("long").alias("n_skills"))


def stg_jobs_latest(spark, d):
    return texts(Warehouse(spark, d).stg_jobs.select("job_id", "job_title", "employer_name", "search_role", "state_code", "salary_mid_annual", "fetched_at"))


def best_per_content_key(spark, d):
    j = R.latest_per_key(Warehouse(spark, d).raw("jobs_clean"), ["job_id"], "fetched_at", [F.col("_loaded_at").desc_nulls_last()])
    return texts(R.best_per_content(j).select("dedup_key", "job_id", "salary_mid_annual", "fetched_at"))


def sightings_distinct(spark, d):
    return texts(Warehouse(spark, d).stg_sightings.groupBy("search_role", P.utc_day(F.col("fetched_at")).alias("day")).agg(F.count("*").alias("n"), F.countDistinct("dedup_key").alias("n_contents")))


def normalise_flags(spark, d):
    """Flags and annual pay by the cleaning rules from the raw pay of each posting's latest load."""
    j = R.best_per_key(Warehouse(spark, d).raw("jobs_clean").where("job_id is not null"), ["job_id"], [F.col("_loaded_at").desc_nulls_last(), F.col("fetched_at").desc_nulls_last()])
    n = normalise(j.select("job_id", "title", "employer", "city", "state", "salary_min_raw", "salary_max_raw", "salary_period_raw"))
    return n.select("job_id", F.col("salary_flag").alias("flag"), F.col("salary_min_annual").alias("low"), F.col("salary_max_annual").alias("high"), F.col("salary_mid_annual").alias("mid"))


def states(spark, d):
    return Warehouse(spark, d).raw("jobs_clean").groupBy(F.col("state").alias("typed")).agg(F.count("*").alias("n")).select("typed", P.state_code(F.col("typed")).alias("code"), "n")


def core_skills_flagged(spark, d):
    w = Warehouse(spark, d)
    own = [r for r in ("Python", "SQL", "Spark", "Airflow", "AWS")]
    core = w.role_profile.where("share_of_role_postings >= 0.10")
    return texts(core.select("role_name", "skill_name", "share_of_role_postings", "demand_rank", F.col("skill_name").isin(*own).alias("on_resume")))


def match_weighted(spark, d):
    core = core_skills_flagged(spark, d)
    return R.weighted_match(core, "role_name", "share_of_role_postings", F.col("on_resume")).select("role_name", F.round("match", 4).alias("match_pct"))


def top_missing_skills(spark, d):
    w = Warehouse(spark, d)
    own = spark.createDataFrame([(s,) for s in ("Python", "SQL", "Spark", "Airflow", "AWS")], "skill_name string")
    t = R.top_missing(w.role_profile, own, "role_name", "skill_name", "demand_rank")
    enough = (F.col("n_salaried_with_skill") >= 10) & (F.col("n_salaried_without_skill") >= 10) & (F.col("salary_sample_status") == "ok") & F.col("median_salary_difference").isNotNull()
    return texts(t.select("role_name", "skill_name", "share_of_role_postings", "demand_rank", F.when(enough, F.col("median_salary_difference")).alias("median_salary_difference"), F.when(enough, "ok").otherwise("too_few_salaries").alias("median_difference_status")))


def level_median(spark, d):
    f = Warehouse(spark, d).enriched.groupBy("search_role", "seniority_effective").agg(F.count("salary_mid_annual").alias("n"), R.percentile("salary_mid_annual", 0.5).alias("m"))
    return f.select("search_role", "seniority_effective", "n", P.sample_status(F.col("n")).alias("status"), P.gated(F.round("m", 2), F.col("n")).alias("median_salary"))


def slice_all_roles(spark, d):
    w = Warehouse(spark, d)
    f = w.enriched.select("search_role", "seniority_effective", "state_code", "salary_mid_annual")
    s = R.slice_percentiles(f, f, "search_role", "salary_mid_annual", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, (F.col("seniority_effective") == "senior") & (F.col("state_code") == "CA"))
    return s.select("search_role", "n_postings", "n_with_salary", "sample_status", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")])


def median_fallback(spark, d):
    e = Warehouse(spark, d).enriched.where("has_salary").select("job_id", "search_role", "seniority_effective", "salary_mid_annual")
    return R.median_with_fallback(e, [["search_role", "seniority_effective"], ["search_role"]], "salary_mid_annual").select("job_id", F.round("expected", 4).alias("expected"))


def mae_by_group(spark, d):
    e = Warehouse(spark, d).enriched.where("has_salary").select("job_id", "search_role", "seniority_effective", "salary_mid_annual")
    x = R.median_with_fallback(e, [["search_role", "seniority_effective"], ["search_role"]], "salary_mid_annual")
    return x.groupBy("search_role").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("expected") - F.col("salary_mid_annual"))), 3).alias("mae"))


def recency_pool(spark, d):
    e = Warehouse(spark, d).enriched.select("job_id", "search_role", "fetched_at")
    a = R.recent_or_latest_day(e, "fetched_at", F.to_timestamp(F.lit("2026-09-22 00:00:00")))
    b = R.recent_or_latest_day(e, "fetched_at", F.to_timestamp(F.lit("2027-01-01 00:00:00")))
    return a.unionByName(b).groupBy("window_kind", "search_role").agg(F.count("*").alias("n"))


def group_folds(spark, d):
    e = Warehouse(spark, d).enriched.where("has_salary")
    return e.select(R.group_fold(F.col("employer_name")).cast("long").alias("fold"), "employer_name").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("employer_name").alias("n_employers"))


def overview(spark, d):
    e = Warehouse(spark, d).enriched
    newest = e.agg(F.max("fetched_at").alias("m"))
    s = e.crossJoin(F.broadcast(newest)).agg(F.count("*").alias("n_postings"), F.count("salary_mid_annual").alias("n_salaried"), F.max("m").alias("newest"), F.count_if(F.col("fetched_at") >= F.col("m") - F.expr("INTERVAL 7 DAYS")).alias("n_recent"), F.round(F.avg(F.col("is_remote").cast("int")), 4).alias("share_remote"))
    w = Warehouse(spark, d)
    weeks = w.skill_demand.agg(F.countDistinct("collection_week").alias("weeks_observed"))
    medians, _ = role_errors(w)
    error = lookup(e.where("has_salary").select("search_role", "salary_mid_annual"), medians.withColumnRenamed("role", "search_role"), "search_role").agg(F.round(F.avg(F.abs(F.col("salary_mid_annual") - F.col("role_median"))), 2).alias("typical_error"))
    s = s.crossJoin(F.broadcast(weeks)).crossJoin(F.broadcast(error))  # one row each
    return texts(s.withColumns({"weeks_needed": F.lit(forecast.GATE).cast("long"), "pipeline_current": F.col("newest") >= F.to_timestamp(F.lit(NOW)) - F.expr("INTERVAL 2 DAYS")}))


def stratified(spark, d):
    e = Warehouse(spark, d).enriched
    kind = F.when(F.col("has_salary"), "salary").when(F.col("location_key") == F.md5(F.lit("unknown")), "no_location").otherwise("other")
    quota = F.when(F.col("kind") == "no_location", 2).otherwise(4)
    return texts(R.stratified_sample(e.withColumn("kind", kind), ["search_role", "kind"], "job_id", quota).select("search_role", "kind", "job_id", "sample_rank"))


def topic_share(spark, d):
    e = Warehouse(spark, d).enriched
    return R.share_of_group(e, ["seniority_effective"], ["search_role"]).select("seniority_effective", "search_role", "n", F.round("share", 6).alias("share"))


def stacked_parts(spark, d):
    n = Warehouse(spark, d).enriched.groupBy("search_role", "employment_type").agg(F.count("*").alias("n"))
    return R.parts_of_total(n, ["search_role"], "n").select("search_role", "employment_type", "n", F.round("share", 6).alias("share"))


def series_collected(spark, d):
    s = Warehouse(spark, d).skill_demand
    p = F.concat(F.date_format("collection_week", "yyyy-MM-dd"), F.lit("="), F.col("postings_with_skill").cast("string"))
    return s.groupBy("search_role", "skill_name").agg(F.array_join(F.array_sort(F.collect_list(p)), ";").alias("series"), F.count("*").alias("n_weeks"))


def salary_rows(w: Warehouse) -> DataFrame:
    """The salaried postings as the salary model takes them."""
    return w.wide_postings.where("has_salary").select(
        "job_id", F.col("role_name").alias("role"), F.col("seniority_effective").alias("seniority"), F.col("loc_state").alias("state"), F.col("is_remote").alias("remote"), "skills", F.col("salary_mid_annual").alias("salary"), F.col("employer_name").alias("employer"))


def features_one_hot(spark, d):
    """The model's features: level, remote, the role's single mark, a common skill, and the number of skills."""
    rows = salary_rows(Warehouse(spark, d))
    spec = salary.fit_spec(rows)
    f = salary.features(rows, spec)
    mark = lambda name, v: F.col(f"f_{name}_{spec[name].index(v)}").cast("long") if v in spec[name] else F.lit(0).cast("long")
    skill = F.col(f"f_skill_{spec['skills'].index('Python')}").cast("long") if "Python" in spec["skills"] else F.lit(0).cast("long")
    levels = [mark("seniority", lv).alias(f"level_{lv}") for lv in P.LEVELS]
    roles = sum((F.col(f"f_role_{i}") for i in range(len(spec["role"]))), F.lit(0.0)).cast("long")
    return f.select("job_id", *levels, F.col("f_remote").cast("long").alias("remote"), roles.alias("n_roles"), skill.alias("python"), F.col("f_skill_count").cast("long").alias("skill_count"))


def wage_gap_levels(spark, d):
    e = Warehouse(spark, d).enriched
    near = P.near_level(F.col("seniority_effective"), F.lit("mid"))
    return e.groupBy("search_role").agg(F.count_if(near).alias("n_near_mid"), F.count("*").alias("n"))


def impact_buckets(spark, d):
    p = Warehouse(spark, d).skill_salary_by_role
    return p.groupBy(P.impact_status(F.col("median_salary_difference")).alias("status")).agg(F.count("*").alias("n"))


def role_errors(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    """(role, role_median), (role, error): the median pay of each role and the mean distance from it."""
    e = w.enriched.where("has_salary").select(F.col("search_role").alias("role"), "salary_mid_annual")
    medians = e.groupBy("role").agg(R.percentile("salary_mid_annual", 0.5).alias("role_median"))
    errors = lookup(e, medians, "role").where("role_median is not null").groupBy("role").agg(F.avg(F.abs(F.col("salary_mid_annual") - F.col("role_median"))).alias("error"))
    return medians, errors


def estimate_range(spark, d):
    """The estimate of each role with pay, by its median, between the ends that its mean error gives."""
    medians, errors = role_errors(Warehouse(spark, d))
    got = salary.answer(medians.select("role").where("role is not null"), medians, errors, None)
    return got.select(F.col("role").alias("search_role"), F.round("low", 3).alias("low"), F.round("value", 3).alias("estimate"), F.round("high", 3).alias("high"))


def top_skills_15(spark, d):
    return Warehouse(spark, d).stg_skills.groupBy("skill_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill_name").limit(15)


def embedded_postings(spark, d):
    w = Warehouse(spark, d)
    has = w.raw("posting_vectors").where("embedding is not null").select("job_id").distinct()
    e = w.enriched.select("job_id", "search_role")
    a = e.join(has, "job_id", "left_semi").groupBy("search_role").agg(F.count("*").alias("n_with_vector"))
    b = e.join(has, "job_id", "left_anti").groupBy("search_role").agg(F.count("*").alias("n_without_vector"))
    return a.join(b, "search_role", "full_outer").select("search_role", F.coalesce("n_with_vector", F.lit(0)).alias("n_with_vector"), F.coalesce("n_without_vector", F.lit(0)).alias("n_without_vector"))


def shared_skills(spark, d):
    w = Warehouse(spark, d).wide_postings
    own = F.array(*[F.lit(s) for s in ("Python", "SQL", "Spark", "Airflow", "AWS")])
    s = R.shared_in_order(F.col("skills"), own)
    return w.where("role_name = 'data engineer'").select("job_id", F.array_join(s, ", ").alias("shared"), F.size(s).cast("long").alias("n_shared"))


_OWN = "('Python', 'SQL', 'Spark', 'Airflow', 'AWS')"
_FALL = """m0 AS (SELECT search_role, seniority_effective, quantile_cont(salary_mid_annual, 0.5) AS a FROM enriched WHERE has_salary GROUP BY 1, 2 HAVING count(*) >= 3),
m1 AS (SELECT search_role, quantile_cont(salary_mid_annual, 0.5) AS b FROM enriched WHERE has_salary GROUP BY 1),
fall AS (SELECT job_id, e.search_role, salary_mid_annual, coalesce(a, b, (SELECT quantile_cont(salary_mid_annual, 0.5) FROM enriched WHERE has_salary)) AS expected FROM enriched e
  LEFT JOIN m0 USING (search_role, seniority_effective) LEFT JOIN m1 ON m1.search_role = e.search_role WHERE has_salary),
"""
_F = "AT TIME ZONE 'UTC'"

QUERIES = {
    "stg_jobs_latest": stg_jobs_latest, "best_per_content_key": best_per_content_key, "sightings_distinct": sightings_distinct,
    "stg_bls_latest": _of("stg_bls"), "dim_role": _of("dim_role"), "dim_location": _of("dim_location"),
    "fact_postings": fact_postings,
    "mart_salary_bands": _of("salary_bands"), "mart_job_trends": _of("job_trends"), "mart_skill_demand": _of("skill_demand"), "mart_skill_salary": _of("skill_salary"),
    "mart_skill_salary_by_role": _of("skill_salary_by_role"), "mart_role_skill_profile": _of("role_profile"),
    "postings_wide": job_skill_array, "salary_normalise_flags": normalise_flags, "state_code_lookup": states, "core_skills_flagged": core_skills_flagged,
    "match_pct_weighted": match_weighted, "top_missing_skills": top_missing_skills, "level_median_status": level_median, "slice_percentiles_all_roles": slice_all_roles,
    "median_fallback_hierarchy": median_fallback, "mae_by_group": mae_by_group, "recency_latest_day_fallback": recency_pool, "group_folds": group_folds,
    "overview_scalars": overview, "stratified_md5_sample": stratified, "topic_share_of_group": topic_share, "parts_of_total": stacked_parts,
    "series_collect": series_collected, "feature_one_hot": features_one_hot, "near_level_counts": wage_gap_levels, "top15_skills": top_skills_15,
    "impact_status_buckets": impact_buckets, "estimate_range": estimate_range, "semi_anti_vectors": embedded_postings, "shared_skills_intersect": shared_skills,
}

_KIND = "CASE WHEN has_salary THEN 'salary' WHEN location_key = md5('unknown') THEN 'no_location' ELSE 'other' END"
ORACLES = {
    "stg_jobs_latest": sql(f"SELECT job_id, job_title, employer_name, search_role, state_code, salary_mid_annual, strftime(fetched_at {_F}, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM stg_jobs"),
    "best_per_content_key": f"""WITH j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY fetched_at DESC NULLS LAST, _loaded_at DESC NULLS LAST) AS r FROM jobs_clean) WHERE r = 1)
SELECT dedup_key, job_id, salary_mid_annual, strftime(fetched_at {_F}, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY dedup_key
  ORDER BY (salary_mid_annual IS NULL) ASC, length(description) DESC NULLS LAST, fetched_at DESC NULLS LAST, job_id ASC) AS r2 FROM j) WHERE r2 = 1""",
    "sightings_distinct": sql(f"SELECT search_role, strftime({_DAY.format('fetched_at')}, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT dedup_key) AS n_contents FROM stg_sightings GROUP BY 1, 2"),
    "stg_bls_latest": sql("SELECT soc_code, occupation_title, median_annual_wage, total_employment, CAST(reference_year AS BIGINT) AS reference_year FROM stg_bls"),
    "dim_role": sql("SELECT * FROM dim_role"), "dim_location": sql("SELECT * FROM dim_location"),
    "fact_postings": sql("SELECT job_id, role_key, location_key, posted_date, posted_week, seniority, seniority_from_title, seniority_effective, seniority_source, employment_type, CAST(is_remote AS VARCHAR) AS is_remote, publisher, salary_min_annual, salary_mid_annual, salary_max_annual, salary_flag, has_salary, skill_count, job_title, employer_name, apply_link FROM enriched"),
    "mart_salary_bands": sql("""SELECT role_name, n_postings, n AS n_with_salary, CASE WHEN n >= 5 THEN 'ok' ELSE 'too_few_to_report' END AS sample_status, CASE WHEN n >= 5 THEN round(p25) END AS salary_p25, CASE WHEN n >= 5 THEN round(p50) END AS salary_median,
  CASE WHEN n >= 5 THEN round(p75) END AS salary_p75, bls AS bls_median_annual_wage, CASE WHEN n >= 5 AND bls > 0 THEN round(p50 / bls - 1, 4) + 0e0 END AS median_vs_bls_pct FROM bands"""),
    "mart_job_trends": sql("""SELECT posted_week, role_name, coalesce(l.state_code, 'Unknown') AS state_code, count(*) AS postings, round(avg(CAST(is_remote AS INTEGER)), 4) AS share_remote, round(avg(CAST(has_salary AS INTEGER)), 4) AS share_with_salary
  FROM enriched e JOIN dim_role USING (role_key) JOIN dim_location l USING (location_key) GROUP BY 1, 2, 3"""),
    "mart_skill_demand": sql("SELECT * FROM demand", DEMAND),
    "mart_skill_salary": sql(_compare("all_pairs", "skill_name, skill_category")),
    "mart_skill_salary_by_role": sql(_BY_ROLE),
    "mart_role_skill_profile": sql("SELECT * FROM profile", PROFILE),
    "postings_wide": sql("""SELECT e.job_id, role_name, location_name, coalesce(s.skills, '') AS skills, coalesce(s.n, 0) AS n_skills FROM enriched e JOIN dim_role USING (role_key) JOIN dim_location USING (location_key)
  LEFT JOIN (SELECT job_id, string_agg(skill_name, ', ' ORDER BY skill_name) AS skills, count(*) AS n FROM stg_skills GROUP BY 1) s ON s.job_id = e.job_id"""),
    "salary_normalise_flags": """SELECT job_id, salary_flag AS flag, salary_min_annual AS low, salary_max_annual AS high, salary_mid_annual AS mid
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY _loaded_at DESC NULLS LAST, fetched_at DESC NULLS LAST) AS r FROM jobs_clean WHERE job_id IS NOT NULL) WHERE r = 1""",
    "state_code_lookup": "SELECT state AS typed, state_code AS code, count(*) AS n FROM jobs_clean GROUP BY 1, 2",
    "core_skills_flagged": sql(f"SELECT role_name, skill_name, share_of_role_postings, demand_rank, skill_name IN {_OWN} AS on_resume FROM profile WHERE share_of_role_postings >= 0.10", PROFILE),
    "match_pct_weighted": sql(f"SELECT role_name, round(sum(CASE WHEN skill_name IN {_OWN} THEN share_of_role_postings ELSE 0e0 END) / sum(share_of_role_postings), 4) AS match_pct FROM profile WHERE share_of_role_postings >= 0.10 GROUP BY 1", PROFILE),
    "top_missing_skills": sql(f"""SELECT role_name, skill_name, share_of_role_postings, demand_rank, CASE WHEN ok THEN median_salary_difference END AS median_salary_difference, CASE WHEN ok THEN 'ok' ELSE 'too_few_salaries' END AS median_difference_status
  FROM (SELECT *, n_salaried_with_skill >= 10 AND n_salaried_without_skill >= 10 AND salary_sample_status = 'ok' AND median_salary_difference IS NOT NULL AS ok, row_number() OVER (PARTITION BY role_name ORDER BY demand_rank) AS r FROM profile WHERE skill_name NOT IN {_OWN}) WHERE r <= 3""", PROFILE),
    "level_median_status": sql("SELECT search_role, seniority_effective, n, CASE WHEN n >= 5 THEN 'ok' ELSE 'too_few_to_report' END AS status, CASE WHEN n >= 5 THEN round(m, 2) END AS median_salary FROM (SELECT search_role, seniority_effective, count(salary_mid_annual) AS n, quantile_cont(salary_mid_annual, 0.5) AS m FROM enriched GROUP BY 1, 2)"),
    "slice_percentiles_all_roles": sql("""SELECT r.search_role, coalesce(n_postings, 0) AS n_postings, coalesce(n, 0) AS n_with_salary, CASE WHEN n >= 5 THEN 'ok' ELSE 'too_few_to_report' END AS sample_status,
  CASE WHEN n >= 5 THEN round(p25, 4) END AS p25, CASE WHEN n >= 5 THEN round(p50, 4) END AS p50, CASE WHEN n >= 5 THEN round(p75, 4) END AS p75
  FROM (SELECT DISTINCT search_role FROM enriched) r LEFT JOIN (SELECT search_role, count(*) AS n_postings, count(salary_mid_annual) AS n, quantile_cont(salary_mid_annual, 0.25) AS p25, quantile_cont(salary_mid_annual, 0.5) AS p50, quantile_cont(salary_mid_annual, 0.75) AS p75
  FROM enriched WHERE seniority_effective = 'senior' AND state_code = 'CA' GROUP BY 1) s USING (search_role)"""),
    "median_fallback_hierarchy": sql("SELECT job_id, round(expected, 4) AS expected FROM fall", _FALL),
    "mae_by_group": sql("SELECT search_role, count(*) AS n, round(avg(abs(expected - salary_mid_annual)), 3) AS mae FROM fall GROUP BY 1", _FALL),
    "recency_latest_day_fallback": sql(f"""SELECT 'last_7_days' AS window_kind, search_role, count(*) AS n FROM enriched WHERE fetched_at {_F} >= TIMESTAMP '2026-09-22' - INTERVAL 7 DAY AND EXISTS (SELECT 1 FROM enriched WHERE fetched_at {_F} >= TIMESTAMP '2026-09-22' - INTERVAL 7 DAY) GROUP BY 2
UNION ALL SELECT 'latest_collection', search_role, count(*) FROM enriched WHERE {_DAY.format('fetched_at')} = (SELECT max({_DAY.format('fetched_at')}) FROM enriched) GROUP BY 2"""),
    "group_folds": sql("SELECT CAST(('0x' || substr(md5(coalesce(employer_name, '')), 1, 8)) AS BIGINT) % 5 AS fold, count(*) AS n, count(DISTINCT employer_name) AS n_employers FROM enriched WHERE has_salary GROUP BY 1"),
    "overview_scalars": sql(f"""SELECT count(*) AS n_postings, count(salary_mid_annual) AS n_salaried, strftime(max(fetched_at) {_F}, '%Y-%m-%d %H:%M:%S') AS newest, count(*) FILTER (WHERE fetched_at >= (SELECT max(fetched_at) FROM enriched) - INTERVAL 7 DAY) AS n_recent, round(avg(CAST(is_remote AS INTEGER)), 4) AS share_remote ,(SELECT count(DISTINCT collection_week) FROM demand) AS weeks_observed, CAST(12 AS BIGINT) AS weeks_needed, max(fetched_at) AT TIME ZONE 'UTC' >= TIMESTAMP '{NOW}' - INTERVAL 2 DAY AS pipeline_current,
  (SELECT round(avg(abs(salary_mid_annual - m)), 2) FROM enriched JOIN (SELECT search_role, quantile_cont(salary_mid_annual, 0.5) AS m FROM enriched WHERE has_salary GROUP BY 1) USING (search_role) WHERE has_salary) AS typical_error FROM enriched""", DEMAND),
    "stratified_md5_sample": sql(f"SELECT search_role, kind, job_id, sample_rank FROM (SELECT search_role, {_KIND} AS kind, job_id, row_number() OVER (PARTITION BY search_role, {_KIND} ORDER BY md5(job_id)) AS sample_rank FROM enriched) WHERE sample_rank <= CASE WHEN kind = 'no_location' THEN 2 ELSE 4 END"),
    "topic_share_of_group": sql("SELECT seniority_effective, search_role, n, round(n * 1e0 / sum(n) OVER (PARTITION BY seniority_effective), 6) AS share FROM (SELECT seniority_effective, search_role, count(*) AS n FROM enriched GROUP BY 1, 2)"),
    "parts_of_total": sql("SELECT search_role, employment_type, n, round(n * 1e0 / sum(n) OVER (PARTITION BY search_role), 6) AS share FROM (SELECT search_role, employment_type, count(*) AS n FROM enriched GROUP BY 1, 2)"),
    "series_collect": sql("SELECT search_role, skill_name, string_agg(collection_week || '=' || postings_with_skill, ';' ORDER BY collection_week) AS series, count(*) AS n_weeks FROM demand GROUP BY 1, 2", DEMAND),
    "feature_one_hot": sql("SELECT e.job_id, " + ", ".join(f"CAST(coalesce(seniority_effective = '{lv}', false) AS BIGINT) AS level_{lv}" for lv in P.LEVELS) + """, CAST(coalesce(is_remote, false) AS BIGINT) AS remote, CAST(1 AS BIGINT) AS n_roles,
  CAST(coalesce(s.py, false) AND (SELECT count(*) >= 10 FROM enriched JOIN dim_role USING (role_key) JOIN dim_location USING (location_key) JOIN stg_skills USING (job_id) WHERE has_salary AND skill_name = 'Python') AS BIGINT) AS python, coalesce(s.n, 0) AS skill_count
  FROM enriched e JOIN dim_role USING (role_key) JOIN dim_location USING (location_key) LEFT JOIN (SELECT job_id, count(*) AS n, bool_or(skill_name = 'Python') AS py FROM stg_skills GROUP BY 1) s ON s.job_id = e.job_id WHERE has_salary"""),
    "near_level_counts": sql("SELECT search_role, count(*) FILTER (WHERE seniority_effective IN ('junior', 'mid', 'senior', 'unknown')) AS n_near_mid, count(*) AS n FROM enriched GROUP BY 1"),
    "impact_status_buckets": sql(f"SELECT CASE WHEN median_salary_difference IS NULL THEN 'not_enough_data' WHEN abs(median_salary_difference) < 500 THEN 'no_measurable_effect' ELSE 'value' END AS status, count(*) AS n FROM ({_BY_ROLE}) GROUP BY 1"),
    "estimate_range": sql("""SELECT search_role, round(greatest(m - avg(abs(salary_mid_annual - m)), 0e0), 3) AS low, round(m, 3) AS estimate, round(m + avg(abs(salary_mid_annual - m)), 3) AS high
  FROM enriched JOIN (SELECT search_role, quantile_cont(salary_mid_annual, 0.5) AS m FROM enriched WHERE has_salary GROUP BY 1) USING (search_role) WHERE has_salary GROUP BY search_role, m"""),
    "top15_skills": sql("SELECT skill_name, count(*) AS n FROM stg_skills GROUP BY 1 ORDER BY n DESC, skill_name LIMIT 15"),
    "semi_anti_vectors": sql("SELECT search_role, count(*) FILTER (WHERE v) AS n_with_vector, count(*) FILTER (WHERE NOT v) AS n_without_vector FROM (SELECT search_role, job_id IN (SELECT job_id FROM posting_vectors WHERE embedding IS NOT NULL) AS v FROM enriched) GROUP BY 1"),
    "shared_skills_intersect": sql(f"""SELECT e.job_id, coalesce(s.shared, '') AS shared, coalesce(s.n, 0) AS n_shared FROM enriched e JOIN dim_role USING (role_key) LEFT JOIN (SELECT job_id, string_agg(skill_name, ', ' ORDER BY skill_name) AS shared, count(*) AS n
  FROM stg_skills WHERE skill_name IN {_OWN} GROUP BY 1) s ON s.job_id = e.job_id WHERE role_name = 'data engineer'"""),
}
