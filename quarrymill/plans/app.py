"""What a user asks interactively: one lazy plan for each part of an answer. A résumé is a text, its own data one broadcast row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import lexicon as L
from quarrymill.functions import postings as P
from quarrymill.functions.years import posting_years
from quarrymill.ml import encode, forecast, salary
from quarrymill.operators import relational as R
from quarrymill.operators.joins import lookup
from quarrymill.plans.marts import Warehouse
from quarrymill.plans.q_marts import DEMAND, PROFILE, role_errors, salary_rows, sql, texts

RESUME = """Data engineer. Built batch and streaming pipelines with Python, SQL, Spark and Airflow on AWS.
Modelled warehouses with dbt and PostgreSQL, shipped services in Docker."""
CORE_SHARE, RECENT_DAYS, PER_SIDE = 0.10, 7, 10


def resume_skills(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "t string").select(F.explode(L.matched(F.col("t"))).alias("skill_name"))


class Analysis:
    """The parts of the answer to a résumé for one role."""

    def __init__(self, w: Warehouse, text: str, role: str, level: str = "unknown"):
        self.w, self.text, self.role, self.level = w, text, role, level
        self.skills = resume_skills(w.spark, text)

    def found(self) -> DataFrame:
        """Skills found with their demand in the role, most wanted first."""
        p = self.w.role_profile.where(F.col("role_name") == self.role).select("skill_name", "share_of_role_postings")
        return self.skills.join(p, "skill_name", "left").orderBy(F.desc_nulls_last("share_of_role_postings"), "skill_name")

    def core(self) -> DataFrame:
        p = self.w.role_profile.where(F.col("share_of_role_postings") >= CORE_SHARE).select("role_name", "skill_name", "share_of_role_postings", "demand_rank")
        return p.join(F.broadcast(self.skills.withColumn("on_resume", F.lit(True))), "skill_name", "left").withColumn("on_resume", F.coalesce("on_resume", F.lit(False)))

    def matches(self) -> DataFrame:
        return R.weighted_match(self.core(), "role_name", "share_of_role_postings", F.col("on_resume")).orderBy(F.desc("match"), "role_name")

    def missing(self, n: int = 3) -> DataFrame:
        """The role's most wanted skills that the résumé lacks; the difference only with enough salaries on both sides."""
        t = R.top_missing(self.w.role_profile.where(F.col("role_name") == self.role), self.skills, "role_name", "skill_name", "demand_rank", n)
        ok = (F.col("salary_sample_status") == "ok") & (F.col("n_salaried_with_skill") >= PER_SIDE) & (F.col("n_salaried_without_skill") >= PER_SIDE) & F.col("median_salary_difference").isNotNull()
        return t.select("skill_name", "skill_category", "share_of_role_postings", "demand_rank", F.when(ok, F.col("median_salary_difference")).alias("median_salary_difference"), F.when(ok, "ok").otherwise("too_few_salaries").alias("median_difference_status"))

    def level_salary(self) -> DataFrame:
        f = self.w.enriched.where((F.col("search_role") == self.role) & (F.col("seniority_effective") == self.level))
        n = F.count("salary_mid_annual")
        return f.agg(n.alias("n"), R.percentile("salary_mid_annual", 0.5).alias("m")).select("n", P.sample_status(F.col("n")).alias("status"), P.gated(F.col("m"), F.col("n")).alias("median_salary"))

    def salary(self, model=None, spec: dict | None = None, state: str | None = None, remote: bool = False) -> DataFrame:
        """The estimate for the résumé: the model's, if there is one, else the role's median; between the ends that the role's mean error gives."""
        medians, errors = role_errors(self.w)
        profile = self.skills.agg(F.sort_array(F.collect_list("skill_name")).alias("skills")).select(F.lit(self.role).alias("role"), F.lit(self.level).alias("seniority"), F.lit(state).cast("string").alias("state"), F.lit(remote).alias("remote"), "skills")
        if model is not None:
            profile = salary.predict(model, profile, spec)
        overall = lookup(self.w.enriched.where("has_salary").select("search_role", "salary_mid_annual"), medians.withColumnRenamed("role", "search_role"), "search_role").agg(F.avg(F.abs(F.col("salary_mid_annual") - F.col("role_median")))).first()[0]
        return salary.answer(profile, medians, errors, overall)

    def what_if(self, model, spec: dict, state: str | None = None, remote: bool = False) -> DataFrame:
        """(skill, delta): what each skill that the role's postings ask for often enough, and the résumé lacks, would change in the model's estimate."""
        rows = salary_rows(self.w).where(F.col("role") == self.role)
        own = {r["skill_name"] for r in self.skills.collect()}  # at most the catalogue
        asked = sorted(r["skill"] for r in salary.what_if_skills(rows).collect() if r["skill"] not in own)
        profile = self.w.spark.createDataFrame([(self.role, self.level, state, remote, sorted(own))], "role string, seniority string, state string, remote boolean, skills array<string>")
        return salary.what_if(model, profile, asked, spec)

    def postings(self, vectors: DataFrame, query: list[float], now, n: int = 10) -> DataFrame:
        """The role's recent postings closest to the résumé's vector: near levels first, then by similarity."""
        v = vectors.where("embedding is not null").groupBy("job_id").agg(F.max("embedding").alias("embedding"))
        pool = self.w.wide_postings.where(F.col("role_name") == self.role).join(v, "job_id")
        recent = R.recent_or_latest_day(pool, "fetched_at", now, RECENT_DAYS)
        q = self.w.spark.createDataFrame([(query, self.level)], "query_vector array<double>, query_level string")
        own = self.skills.agg(F.sort_array(F.collect_list("skill_name")).alias("own"))  # at most the catalogue
        r = R.closest_to(recent.select("job_id", "job_title", "employer_name", "location_name", "is_remote", "fetched_at", "salary_mid_annual", "seniority_effective", "skills", "window_kind", "embedding"), q, "job_id", "embedding", n, "seniority_effective")
        return r.crossJoin(F.broadcast(own)).withColumn("shared_skills", R.shared_in_order(F.col("skills"), F.col("own"))).drop("embedding", "query_vector", "query_level", "own", "skills")


def options(spark, d):
    """Roles, levels and states to choose from."""
    e = Warehouse(spark, d).enriched
    part = lambda kind, c: e.where(F.col(c).isNotNull()).select(F.lit(kind).alias("kind"), F.col(c).alias("value")).distinct()
    return part("role", "search_role").unionByName(part("level", "seniority_effective")).unionByName(part("state", "state_code"))


def role_matches(spark, d):
    return Analysis(Warehouse(spark, d), RESUME, "data engineer").matches().select("role_name", F.round("match", 4).alias("match"))


def skills_found(spark, d):
    return Analysis(Warehouse(spark, d), RESUME, "data engineer").found()


def missing(spark, d):
    return texts(Analysis(Warehouse(spark, d), RESUME, "data engineer").missing())


def level_salary(spark, d):
    return Analysis(Warehouse(spark, d), RESUME, "data engineer", "senior").level_salary()


def salary_estimate(spark, d):
    got = Analysis(Warehouse(spark, d), RESUME, "data engineer", "senior").salary()
    return got.select("role", "source", *[F.round(c, 3).alias(c) for c in ("low", "value", "high")])


def nearest_postings(spark, d):
    w = Warehouse(spark, d)
    q = [float(x) for x in encode.weighted_mean(encode.hashing_encoder(encode.chunks_of(RESUME)), [len(c.split()) for c in encode.chunks_of(RESUME)])]
    r = Analysis(w, RESUME, "data engineer", "senior").postings(w.raw("posting_vectors"), q, F.to_timestamp(F.lit("2026-09-22 00:00:00")))
    return r.select("job_id", "job_title", "near_level", F.round("similarity", 6).alias("similarity"), F.array_join("shared_skills", ", ").alias("shared_skills"), "window_kind")


def salaries(spark, d):
    """Percentiles a role for senior postings, beside the benchmark."""
    w = Warehouse(spark, d)
    e = w.enriched.select(F.col("search_role").alias("role_name"), "seniority_effective", "salary_mid_annual")
    s = R.slice_percentiles(e, w.dim_role, "role_name", "salary_mid_annual", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, F.col("seniority_effective") == "senior")
    b = w.dim_role.select("role_name", "bls_median_annual_wage")
    return s.join(F.broadcast(b), "role_name").select("role_name", "n_postings", "n_with_salary", "sample_status", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], "bls_median_annual_wage")


def skill_ranking(spark, d):
    """A role's skills by rank, with the weeks seen and needed for a forecast."""
    w = Warehouse(spark, d)
    weeks = w.skill_demand.where("search_role = 'data engineer'").agg(F.countDistinct("collection_week").alias("weeks_observed"))
    p = w.role_profile.where("role_name = 'data engineer'").select("skill_name", "skill_category", "share_of_role_postings", "demand_rank")
    return texts(p.crossJoin(F.broadcast(weeks)).withColumn("weeks_needed", F.lit(forecast.GATE).cast("long")))


def skill_history(spark, d):
    s = Warehouse(spark, d).skill_demand.where("search_role = 'data engineer' and skill_name = 'Python'")
    return texts(s.select("collection_week", "postings_with_skill", "role_postings", "share_of_role_postings"))


def insights(spark, d):
    """Levels and remote shares of each role."""
    e = Warehouse(spark, d).enriched
    n = e.groupBy("search_role", "seniority_effective").agg(F.count("*").alias("n"))
    r = e.groupBy("search_role").agg(F.round(F.avg(F.col("is_remote").cast("int")), 4).alias("share_remote"))
    return n.join(r, "search_role")


def levels_with_years(spark, d):
    w = Warehouse(spark, d)
    y = Warehouse(spark, d, posting_years(w.stg_jobs, "job_id", "job_description"))
    return y.enriched.groupBy("seniority_effective", "seniority_source").agg(F.count("*").alias("n"))


QUERIES = {
    "app_options": options, "app_role_matches": role_matches, "app_skills_found": skills_found, "app_missing_skills": missing, "app_level_salary": level_salary, "app_salary_estimate": salary_estimate, "app_nearest_postings": nearest_postings,
    "app_salaries": salaries, "app_skill_ranking": skill_ranking, "app_skill_history": skill_history, "app_insights": insights, "levels_with_years": levels_with_years,
}
_OWN = "('Python', 'SQL', 'Spark', 'Airflow', 'AWS', 'dbt', 'PostgreSQL', 'Docker')"
ORACLES = {
    "app_options": sql("SELECT DISTINCT 'role' AS kind, search_role AS value FROM enriched WHERE search_role IS NOT NULL UNION ALL SELECT DISTINCT 'level', seniority_effective FROM enriched UNION ALL SELECT DISTINCT 'state', state_code FROM enriched WHERE state_code IS NOT NULL"),
    "app_role_matches": sql(f"SELECT role_name, round(sum(CASE WHEN skill_name IN {_OWN} THEN share_of_role_postings ELSE 0e0 END) / sum(share_of_role_postings), 4) AS match FROM profile WHERE share_of_role_postings >= 0.10 GROUP BY 1", PROFILE),
    "app_skills_found": sql(f"SELECT o.skill_name, p.share_of_role_postings FROM (SELECT unnest({_OWN.replace('(', '[').replace(')', ']')}) AS skill_name) o LEFT JOIN (SELECT * FROM profile WHERE role_name = 'data engineer') p USING (skill_name)", PROFILE),
    "app_missing_skills": sql(f"""SELECT skill_name, skill_category, share_of_role_postings, demand_rank, CASE WHEN ok THEN median_salary_difference END AS median_salary_difference, CASE WHEN ok THEN 'ok' ELSE 'too_few_salaries' END AS median_difference_status
  FROM (SELECT *, n_salaried_with_skill >= 10 AND n_salaried_without_skill >= 10 AND salary_sample_status = 'ok' AND median_salary_difference IS NOT NULL AS ok FROM profile WHERE role_name = 'data engineer' AND skill_name NOT IN {_OWN} ORDER BY demand_rank LIMIT 3)""", PROFILE),
    "app_level_salary": sql("SELECT n, CASE WHEN n >= 5 THEN 'ok' ELSE 'too_few_to_report' END AS status, CASE WHEN n >= 5 THEN m END AS median_salary FROM (SELECT count(salary_mid_annual) AS n, quantile_cont(salary_mid_annual, 0.5) AS m FROM enriched WHERE search_role = 'data engineer' AND seniority_effective = 'senior')"),
    "app_salary_estimate": sql("""SELECT search_role AS role, 'role_median' AS source, round(greatest(m - avg(abs(salary_mid_annual - m)), 0e0), 3) AS low, round(m, 3) AS value, round(m + avg(abs(salary_mid_annual - m)), 3) AS high
  FROM enriched JOIN (SELECT search_role, quantile_cont(salary_mid_annual, 0.5) AS m FROM enriched WHERE has_salary GROUP BY 1) USING (search_role) WHERE has_salary AND search_role = 'data engineer' GROUP BY search_role, m"""),
    "app_salaries": sql("""SELECT role_name, coalesce(n_postings, 0) AS n_postings, coalesce(n, 0) AS n_with_salary, CASE WHEN n >= 5 THEN 'ok' ELSE 'too_few_to_report' END AS sample_status, CASE WHEN n >= 5 THEN round(p25, 4) END AS p25, CASE WHEN n >= 5 THEN round(p50, 4) END AS p50, CASE WHEN n >= 5 THEN round(p75, 4) END AS p75, bls_median_annual_wage
  FROM dim_role LEFT JOIN (SELECT search_role AS role_name, count(*) AS n_postings, count(salary_mid_annual) AS n, quantile_cont(salary_mid_annual, 0.25) AS p25, quantile_cont(salary_mid_annual, 0.5) AS p50, quantile_cont(salary_mid_annual, 0.75) AS p75 FROM enriched WHERE seniority_effective = 'senior' GROUP BY 1) s USING (role_name)"""),
    "app_skill_ranking": sql("SELECT skill_name, skill_category, share_of_role_postings, demand_rank, (SELECT count(DISTINCT collection_week) FROM demand WHERE search_role = 'data engineer') AS weeks_observed, CAST(12 AS BIGINT) AS weeks_needed FROM profile WHERE role_name = 'data engineer'", DEMAND, PROFILE),
    "app_skill_history": sql("SELECT collection_week, postings_with_skill, role_postings, share_of_role_postings FROM demand WHERE search_role = 'data engineer' AND skill_name = 'Python'", DEMAND),
    "app_insights": sql("SELECT search_role, seniority_effective, n, share_remote FROM (SELECT search_role, seniority_effective, count(*) AS n FROM enriched GROUP BY 1, 2) JOIN (SELECT search_role, round(avg(CAST(is_remote AS INTEGER)), 4) AS share_remote FROM enriched GROUP BY 1) USING (search_role)"),
}
