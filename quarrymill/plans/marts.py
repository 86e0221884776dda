"""Staging, star schema and marts as functions of a context that remembers what it has built."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions import postings as P
from quarrymill.operators import relational as R
from quarrymill.session import table

#: Benchmark occupation of each search role; the data analyst has none by decision.
ROLE_SEED = [
    ("data engineer", "15-1243", "15-1243.00", "Database Architects"),
    ("data scientist", "15-2051", "15-2051.00", "Data Scientists"),
    ("machine learning engineer", "15-2051", "15-2051.00", "Data Scientists"),
    ("data analyst", None, None, None),
    ("software engineer", "15-1252", "15-1252.00", "Software Developers"),
]


class Warehouse:
    """Lazy models over one folder of tables. `years`: optional (job_id, years_min, years_max, ...) from the texts."""

    def __init__(self, spark: SparkSession, sf_dir: str, years: DataFrame | None = None):
        self.spark, self.sf_dir, self.years = spark, sf_dir, years

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def stg_jobs(self) -> DataFrame:
        """One row a posting: its latest load, with the warehouse's names."""
        j = R.best_per_key(self.raw("jobs_clean").where("job_id is not null"), ["job_id"], [F.col("_loaded_at").desc_nulls_last(), F.col("fetched_at").desc_nulls_last()])
        new = {"title": "job_title", "title_normalized": "job_title_normalized", "employer": "employer_name", "employer_normalized": "employer_name_normalized", "state": "state_name", "country": "country_code", "salary_period_raw": "salary_period", "description": "job_description"}
        return j.withColumnsRenamed(new)

    @cached_property
    def stg_skills(self) -> DataFrame:
        s = self.raw("job_skills").where("job_id is not null and skill is not null")
        return s.groupBy("job_id", F.col("skill").alias("skill_name")).agg(F.min("category").alias("skill_category"))

    @cached_property
    def stg_sightings(self) -> DataFrame:
        s = self.raw("job_sightings")
        return s.groupBy("job_id", "fetched_at").agg(F.min(F.struct("dedup_key", "search_role", "search_location")).alias("m")).select("job_id", "fetched_at", "m.*")

    @cached_property
    def stg_bls(self) -> DataFrame:
        b = R.best_per_key(self.raw("bls_occupations"), ["occupation_code"], [F.col("fetched_at").desc_nulls_last(), F.col("_loaded_at").desc_nulls_last(), F.col("median_wage").desc_nulls_last(), F.col("total_employment").desc_nulls_last()])
        return b.select(F.col("occupation_code").alias("soc_code"), F.col("title").alias("occupation_title"), F.col("median_wage").alias("median_annual_wage"), "total_employment", "reference_year")

    @cached_property
    def enriched(self) -> DataFrame:
        n = self.stg_skills.groupBy("job_id").agg(F.count("*").alias("skill_count"))
        j = self.stg_jobs.join(n, "job_id", "left")
        if self.years is not None:
            j = j.join(self.years.select("job_id", F.col("years_min").alias("experience_years_min"), F.col("years_max").alias("experience_years_max")), "job_id", "left")
        else:
            j = j.withColumns({"experience_years_min": F.lit(None).cast("double"), "experience_years_max": F.lit(None).cast("double")})
        level, years = P.title_level(F.col("job_title")), F.col("experience_years_min")
        return j.select(
            "job_id", P.role_key(F.col("search_role")).alias("role_key"), P.location_key(F.col("city"), F.col("state_code"), F.col("country_code")).alias("location_key"),
            "job_title", "employer_name", "publisher", "employment_type", "is_remote", "city", "state_code", "country_code", "search_role", "posted_at",
            P.utc_day(F.col("posted_at")).alias("posted_date"), P.utc_week(F.col("posted_at")).alias("posted_week"),
            F.coalesce(level, F.lit("mid")).alias("seniority"), level.isNotNull().alias("seniority_from_title"),
            P.effective_level(level, years).alias("seniority_effective"), P.level_source(level, years).alias("seniority_source"),
            "experience_years_min", "experience_years_max", "salary_min_annual", "salary_max_annual", "salary_mid_annual", "salary_flag",
            F.col("salary_mid_annual").isNotNull().alias("has_salary"), F.coalesce("skill_count", F.lit(0)).alias("skill_count"), "apply_link", "fetched_at", "dedup_key",
        )

    @cached_property
    def skills_joined(self) -> DataFrame:
        e = self.enriched.select("job_id", "search_role", "city", "state_code", "posted_date", "posted_week", "seniority", "has_salary", "salary_mid_annual")
        return self.stg_skills.join(e, "job_id")

    @cached_property
    def role_seed(self) -> DataFrame:
        return self.spark.createDataFrame(ROLE_SEED, "search_role string, soc_code string, onet_soc_code string, onet_title string")

    @cached_property
    def dim_role(self) -> DataFrame:
        return self.role_seed.join(self.stg_bls, "soc_code", "left").select(
            P.role_key(F.col("search_role")).alias("role_key"), F.col("search_role").alias("role_name"), "soc_code", "onet_soc_code", "onet_title",
            F.col("occupation_title").alias("bls_occupation_title"), F.col("median_annual_wage").alias("bls_median_annual_wage"), F.col("total_employment").alias("bls_total_employment"), F.col("reference_year").alias("bls_reference_year"))

    @cached_property
    def dim_location(self) -> DataFrame:
        unknown = F.md5(F.lit("unknown"))
        known = self.enriched.where(F.col("location_key") != unknown).groupBy("location_key").agg(*[F.min(c).alias(c) for c in ("city", "state_code", "country_code")])
        known = known.select("*", F.concat_ws(", ", "city", "state_code").alias("location_name"), F.lit(False).alias("is_unknown"))
        one = self.spark.range(1).select(unknown.alias("location_key"), *[F.lit(None).cast("string").alias(c) for c in ("city", "state_code", "country_code")], F.lit("Unknown").alias("location_name"), F.lit(True).alias("is_unknown"))
        return known.unionByName(one)

    @cached_property
    def fact(self) -> DataFrame:
        return self.enriched.select(
            "job_id", "role_key", "location_key", "posted_date", "posted_week", "seniority", "seniority_from_title", "seniority_effective", "seniority_source", "experience_years_min", "experience_years_max",
            "employment_type", "is_remote", "publisher", "salary_min_annual", "salary_mid_annual", "salary_max_annual", "salary_flag", "has_salary", "skill_count", "job_title", "employer_name", "apply_link", "fetched_at")

    def _roles(self, *columns: str) -> DataFrame:
        return F.broadcast(self.dim_role.select("role_key", "role_name", *columns))  # one row a seeded role

    @cached_property
    def salary_bands(self) -> DataFrame:
        s = self.fact.join(self._roles("bls_median_annual_wage"), "role_key").groupBy("role_name").agg(
            F.max("bls_median_annual_wage").alias("bls_median_annual_wage"), F.count("*").alias("n_postings"), F.count_if("has_salary").alias("n_with_salary"),
            *[R.percentile("salary_mid_annual", p).alias(k) for k, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))])
        n = F.col("n_with_salary")
        return s.select("role_name", "n_postings", "n_with_salary", P.sample_status(n).alias("sample_status"), P.gated(F.round("p25"), n).alias("salary_p25"), P.gated(F.round("p50"), n).alias("salary_median"), P.gated(F.round("p75"), n).alias("salary_p75"), "bls_median_annual_wage", P.gated(P.relative(F.col("p50"), F.col("bls_median_annual_wage")), n).alias("median_vs_bls_pct"))

    @cached_property
    def job_trends(self) -> DataFrame:
        # the location's state is the least spelling of the key's postings, as in dim_location
        loc = self.dim_location.select("location_key", F.col("state_code").alias("loc_state"))
        f = self.fact.join(self._roles(), "role_key").join(loc, "location_key")
        return f.groupBy("posted_week", "role_name", F.coalesce("loc_state", F.lit("Unknown")).alias("state_code")).agg(
            F.count("*").alias("postings"), F.round(F.avg(F.col("is_remote").cast("int")), 4).alias("share_remote"), F.round(F.avg(F.col("has_salary").cast("int")), 4).alias("share_with_salary"))

    @cached_property
    def skill_demand(self) -> DataFrame:
        s = self.stg_sightings.where("dedup_key is not null").select(P.utc_week(F.col("fetched_at")).alias("collection_week"), "search_role", "dedup_key").distinct()
        weeks = s.groupBy("collection_week", "search_role").agg(F.count("*").alias("role_postings"))
        # one row a content and skill, so that rows count contents; a skill has one category, rarely more
        skills = self.stg_skills.join(self.stg_jobs.select("job_id", "dedup_key"), "job_id").groupBy("dedup_key", "skill_name").agg(F.collect_set("skill_category").alias("cats"))
        seen = s.join(skills, "dedup_key").groupBy("collection_week", "search_role", "skill_name").agg(F.count("*").alias("postings_with_skill"), F.array_distinct(F.flatten(F.collect_set("cats"))).alias("cats"))
        cats = F.array_distinct(F.flatten(F.collect_set("cats"))).alias("cats")
        filled = R.zero_filled(seen, weeks, "collection_week", ["search_role"], ["skill_name"], "postings_with_skill", [cats]).withColumn("skill_category", F.explode_outer("cats"))
        return filled.select("collection_week", "search_role", "skill_name", "skill_category", "postings_with_skill", "role_postings", F.round(F.col("postings_with_skill") / F.col("role_postings"), 4).alias("share_of_role_postings"))

    @cached_property
    def skill_salary(self) -> DataFrame:
        salaried = self.fact.where("has_salary").select("job_id", "salary_mid_annual")
        return R.compared(R.with_without_medians(self.skills_joined, salaried, "job_id", "salary_mid_annual", [], ["skill_name", "skill_category"]))

    @cached_property
    def skill_salary_by_role(self) -> DataFrame:
        salaried = self.fact.where("has_salary").join(self._roles(), "role_key").select("job_id", "role_name", "salary_mid_annual")
        members = self.skills_joined.select("job_id", F.col("search_role").alias("role_name"), "skill_name", "skill_category")
        m = R.with_without_medians(members, salaried, "job_id", "salary_mid_annual", ["role_name"], ["skill_name", "skill_category"])
        return R.compared(m.withColumn("n_role_salaried", F.col("n_with_skill") + F.col("n_without_skill")))

    @cached_property
    def role_profile(self) -> DataFrame:
        roles = self.fact.join(self._roles(), "role_key").groupBy("role_name").agg(F.count("*").alias("n_role_postings"))
        seen = self.skills_joined.groupBy(F.col("search_role").alias("role_name"), "skill_name", "skill_category").agg(F.countDistinct("job_id").alias("n_postings_with_skill"))
        pay = self.skill_salary_by_role.select("role_name", "skill_name", F.col("n_with_skill").alias("w"), F.col("n_without_skill").alias("wo"), "sample_status", "median_salary_with_skill", "median_salary_without_skill", "median_salary_difference", "median_salary_difference_pct")
        rank = F.row_number().over(Window.partitionBy("role_name").orderBy(F.desc("n_postings_with_skill"), "skill_name"))
        return seen.join(F.broadcast(roles), "role_name").join(pay, ["role_name", "skill_name"], "left").select(
            "role_name", "skill_name", "skill_category", "n_role_postings", "n_postings_with_skill", F.round(F.col("n_postings_with_skill") / F.col("n_role_postings"), 4).alias("share_of_role_postings"), rank.alias("demand_rank"),
            F.coalesce("w", F.lit(0)).alias("n_salaried_with_skill"), F.coalesce("wo", F.lit(0)).alias("n_salaried_without_skill"), F.coalesce("sample_status", F.lit("too_few_to_report")).alias("salary_sample_status"),
            "median_salary_with_skill", "median_salary_without_skill", "median_salary_difference", "median_salary_difference_pct")

    @cached_property
    def wide_postings(self) -> DataFrame:
        """Postings with role, place and skills in one row."""
        skills = self.stg_skills.groupBy("job_id").agg(F.array_sort(F.collect_list("skill_name")).alias("skills"))
        loc = self.dim_location.select("location_key", "location_name", F.col("state_code").alias("loc_state"))
        f = self.fact.join(self._roles(), "role_key").join(loc, "location_key").join(skills, "job_id", "left")
        return f.withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
