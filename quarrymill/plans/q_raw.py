"""Queries over the raw path and the sinks: envelopes are derived from the cleaned postings, read back, flattened and normalised, so that
the stored columns are what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import quality as Q
from quarrymill.operators import relational as R
from quarrymill.plans.marts import Warehouse
from quarrymill.plans.q_marts import BASE, DEMAND, PROFILE, sql, texts
from quarrymill.session import shared_dir, table
from quarrymill.sources import raw, sinks

#: Postings of one collection are written as envelopes of about this many, as pages of a collection are.
PAGES = 32


def envelopes_of(jobs: DataFrame) -> DataFrame:
    """The postings in the raw layout, one envelope a collection and page."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    fields = {**{b: F.col(b) for b in raw._RENAMED.values()}, "posted_at": F.date_format("posted_at", iso)}
    names = {**{b: a for a, b in raw._RENAMED.items()}, "posted_at": "job_posted_at_datetime_utc"}
    job = F.struct(*[c.alias(names[n]) for n, c in fields.items()], F.col("salary_period_raw").alias("job_salary_period"))
    page = F.pmod(F.xxhash64("job_id", "_loaded_at"), F.lit(PAGES)).alias("page")
    e = jobs.groupBy(F.col("search_role").alias("role"), F.col("search_location").alias("location"), F.date_format("fetched_at", iso).alias("fetched_at"), page).agg(F.collect_list(job).alias("jobs"))
    return e.drop("page")


def _written(spark: SparkSession, rows: DataFrame, read) -> DataFrame:
    """`rows` as JSON in the shared folder, read back through the raw schema."""
    path = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    rows.write.json(path)
    return read(spark, path, lines=True)


STORED = ["title_normalized", "employer_normalized", "state_code", "salary_flag", "salary_min_annual", "salary_max_annual", "salary_mid_annual", "dedup_key"]
KEPT = ["job_id", "title", "employer", "is_remote", "latitude", "posted_at", "salary_min_raw", "salary_period_raw", "search_role", "search_location", "ingest_date"]


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    return raw.normalise(raw.flatten(_written(spark, envelopes_of(table(spark, d, "jobs_clean")), raw.read_envelopes)))


def raw_round_trip(spark, d):
    n = _normalised(spark, d)
    return texts(n.select(*KEPT, *STORED).withColumn("is_remote", F.col("is_remote").cast("string")))


def raw_normalise(spark, d):
    """The cleaning rules over the raw columns as they are."""
    return raw.normalise(table(spark, d, "jobs_clean").drop(*STORED)).select("job_id", *STORED)


def raw_sightings(spark, d):
    s = raw.sightings(_normalised(spark, d)).where("job_id is not null")
    return s.groupBy("dedup_key").agg(F.count("*").alias("n"), F.date_format(F.min("ingest_date"), "yyyy-MM-dd").alias("first_day"))


def raw_occupations(spark, d):
    rec = F.struct("occupation_code", "title", "total_employment", "median_wage", "reference_year")
    e = table(spark, d, "bls_occupations").groupBy(F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("fetched_at")).agg(F.collect_list(rec).alias("records"))
    return texts(raw.occupations(_written(spark, e, raw.read_occupations)).select("occupation_code", "title", "total_employment", "median_wage", "reference_year"))


def sink_replace_all(spark, d):
    """Two tables are replaced together, twice; what is read back are the rows of the second time."""
    base = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    jobs, skills = table(spark, d, "jobs_clean").select("job_id", "title"), table(spark, d, "job_skills").select("job_id", "skill")
    sinks.replace_all({f"{base}/jobs": jobs.limit(1), f"{base}/skills": skills.limit(1)})  # what stood there before
    sinks.replace_all({f"{base}/jobs": jobs, f"{base}/skills": skills})
    parts = [spark.read.parquet(f"{base}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.countDistinct("job_id").alias("n_ids")) for n in ("jobs", "skills")]
    return parts[0].unionByName(parts[1])


def sink_write_once(spark, d):
    """A second write to the same name leaves the first as it is."""
    path = f"{shared_dir(spark)}/once-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    first, second = sinks.write_once(n, path), sinks.write_once(n.where("n_nationkey < 3"), path)
    return spark.read.schema("n_nationkey long, n_name string").json(path).withColumns({"first": F.lit(first), "second": F.lit(second)})


def data_tests(spark, d):
    """The whole-model assertions: a row an assertion with its violations."""
    w = Warehouse(spark, d)
    between = lambda df, c, key, name: Q.violates(df.where(F.col(c).isNotNull()), F.col(c).between(0, 1), key, name)
    checks = {
        "exactly_one_unknown_location": Q.violates(w.dim_location.agg(F.count_if("is_unknown").alias("n")).withColumn("k", F.lit("unknown")), F.col("n") == 1, "k", "exactly_one_unknown_location"),
        "salary_min_not_above_max": Q.violates(w.fact.where("salary_min_annual is not null and salary_max_annual is not null"), F.col("salary_min_annual") <= F.col("salary_max_annual"), "job_id", "salary_min_not_above_max"),
        "shares_between_0_and_1": Q.all_of(
            between(w.skill_demand, "share_of_role_postings", "skill_name", "shares_between_0_and_1"), between(w.job_trends, "share_remote", "role_name", "shares_between_0_and_1"),
            between(w.job_trends, "share_with_salary", "role_name", "shares_between_0_and_1"), between(w.role_profile, "share_of_role_postings", "skill_name", "shares_between_0_and_1")),
        "counts_add_up": Q.violates(w.skill_salary_by_role, F.col("n_with_skill") + F.col("n_without_skill") == F.col("n_role_salaried"), "skill_name", "counts_add_up"),
        "skill_count_reconciles": Q.violates(w.enriched.join(w.stg_skills.groupBy("job_id").agg(F.count("*").alias("n")), "job_id", "left"), F.col("skill_count") == F.coalesce("n", F.lit(0)), "job_id", "skill_count_reconciles"),
    }
    names = spark.createDataFrame([(k,) for k in checks], "check_name string")
    found = Q.all_of(*checks.values()).groupBy("check_name").agg(F.count("*").alias("n"))
    return names.join(F.broadcast(found), "check_name", "left").select("check_name", F.coalesce("n", F.lit(0)).alias("n_violations"))


def kinds_audit(spark, d):
    """How many postings of each kind a fixture would be drawn from."""
    e = Warehouse(spark, d).enriched
    kind = F.when(F.col("has_salary"), "salary").when(F.col("location_key") == F.md5(F.lit("unknown")), "no_location").otherwise("other")
    return e.groupBy("search_role", kind.alias("kind")).agg(F.count("*").alias("n"))


def delimited_words(spark, d):
    """Delimited text to array: null gives an empty one."""
    w = Warehouse(spark, d).wide_postings.select("job_id", F.array_join("skills", ", ").alias("text"))
    arr = R.delimited(F.when(F.col("text") != "", F.col("text")))
    return w.select("job_id", F.size(arr).cast("long").alias("n"), F.coalesce(F.get(arr, F.lit(0)), F.lit("")).alias("first"))


QUERIES = {
    "raw_round_trip": raw_round_trip, "raw_normalise": raw_normalise, "raw_sightings": raw_sightings, "raw_occupations": raw_occupations,
    "sink_replace_all": sink_replace_all, "sink_write_once": sink_write_once, "data_tests": data_tests, "kinds_audit": kinds_audit, "delimited_words": delimited_words,
}
_T = "strftime({} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"
ORACLES = {
    "raw_round_trip": f"""SELECT job_id, title, employer, CAST(is_remote AS VARCHAR) AS is_remote, latitude, {_T.format('posted_at')} AS posted_at, salary_min_raw, upper(salary_period_raw) AS salary_period_raw, search_role, search_location,
  strftime(ingest_date, '%Y-%m-%d') AS ingest_date, {", ".join(STORED)} FROM jobs_clean""",
    "raw_normalise": f"SELECT job_id, {', '.join(STORED)} FROM jobs_clean",
    "raw_sightings": "SELECT dedup_key, count(*) AS n, strftime(min(d), '%Y-%m-%d') AS first_day FROM (SELECT job_id, fetched_at, min(dedup_key) AS dedup_key, min(ingest_date) AS d FROM jobs_clean WHERE job_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "raw_occupations": """SELECT occupation_code, title, total_employment, median_wage, CAST(reference_year AS BIGINT) AS reference_year FROM (SELECT *, row_number() OVER (PARTITION BY occupation_code
  ORDER BY fetched_at DESC NULLS LAST, reference_year DESC NULLS LAST, total_employment DESC NULLS LAST) AS r FROM bls_occupations) WHERE r = 1""",
    "sink_replace_all": "SELECT 'jobs' AS name, count(*) AS n, count(DISTINCT job_id) AS n_ids FROM jobs_clean UNION ALL SELECT 'skills', count(*), count(DISTINCT job_id) FROM job_skills",
    "sink_write_once": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, true AS first, false AS second FROM nation",
    "data_tests": sql("""SELECT 'exactly_one_unknown_location' AS check_name, CAST(count(*) FILTER (WHERE is_unknown) <> 1 AS BIGINT) AS n_violations FROM dim_location
UNION ALL SELECT 'salary_min_not_above_max', count(*) FROM enriched WHERE salary_min_annual > salary_max_annual
UNION ALL SELECT 'shares_between_0_and_1', (SELECT count(*) FROM demand WHERE share_of_role_postings NOT BETWEEN 0 AND 1) + (SELECT count(*) FROM profile WHERE share_of_role_postings NOT BETWEEN 0 AND 1)
UNION ALL SELECT 'counts_add_up', count(*) FROM (SELECT search_role, count(*) FILTER (WHERE has_salary) AS n, count(salary_mid_annual) AS m FROM enriched GROUP BY 1) WHERE n <> m
UNION ALL SELECT 'skill_count_reconciles', count(*) FROM enriched e LEFT JOIN (SELECT job_id, count(DISTINCT skill) AS n FROM job_skills WHERE skill IS NOT NULL GROUP BY 1) s USING (job_id) WHERE e.skill_count <> coalesce(s.n, 0)""", DEMAND, PROFILE.removeprefix(DEMAND) if PROFILE.startswith(DEMAND) else PROFILE),
    "kinds_audit": sql("SELECT search_role, CASE WHEN has_salary THEN 'salary' WHEN location_key = md5('unknown') THEN 'no_location' ELSE 'other' END AS kind, count(*) AS n FROM enriched GROUP BY 1, 2"),
    "delimited_words": sql("SELECT e.job_id, coalesce(s.n, 0) AS n, coalesce(s.first, '') AS first FROM enriched e JOIN dim_role USING (role_key) LEFT JOIN (SELECT job_id, count(*) AS n, min(skill_name) AS first FROM stg_skills GROUP BY 1) s ON s.job_id = e.job_id"),
}
