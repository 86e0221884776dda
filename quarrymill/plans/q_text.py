"""Queries over texts, vectors, time series and generic tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions import lexicon as L
from quarrymill.functions import postings as P
from quarrymill.functions import text as T
from quarrymill.functions.years import posting_years
from quarrymill.ml import encode, forecast, topics
from quarrymill.operators import quality as Q
from quarrymill.operators import relational as R
from quarrymill.plans.marts import Warehouse
from quarrymill.plans.q_marts import BASE, DEMAND, salary_rows, sql, texts
from quarrymill.operators.joins import lookup
from quarrymill.session import broadcast_if_small, cut, spread, table


def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence").cast("long")).alias("chars"))


def boilerplate(spark, d):
    """Per document: sentences in all and those without sentences that stand under three titles or more.

    Only 64-bit hashes of sentences and titles are exchanged; shared ones are looked up by hash, and the texts are read again for what is kept.
    """
    docs = spread(table(spark, d, "documents"))
    keys = F.transform(T.sentences(F.col("text")), lambda x: F.xxhash64(T.sentence_key(x)))
    uses = docs.select(F.explode(F.array_distinct(keys)).alias("key"), F.xxhash64("title").alias("title"), F.col("title").isNotNull().alias("titled")).where("titled")
    shared = cut(uses.groupBy("key", "title").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n_titles")).where("n_titles >= 3").select("key", F.lit(True).alias("shared")))
    s = docs.select("doc_id", F.posexplode(keys).alias("pos", "key"))
    marked = lookup(s, shared, "key").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("shared").isNull()).alias("n_own"), F.collect_list(F.when(F.col("shared").isNull(), F.col("pos"))).alias("own"))
    kept = docs.select("doc_id", T.sentences(F.col("text")).alias("x")).join(marked, "doc_id")
    text = F.array_join(F.filter("x", lambda x, i: F.array_contains(F.col("own"), i)), "\n")
    return kept.select("doc_id", "n", "n_own", F.when(F.col("n_own") == 0, F.lit("(all kept)")).otherwise(F.md5(text)).alias("own_hash"))


def word_chunks(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(T.word_chunks(F.col("text"))).alias("pos", "chunk"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("chunk").alias("chunk_hash"))


def skills_native(spark, d):
    return L.posting_skills(spread(table(spark, d, "jobs_clean")).where("job_id is not null")).distinct().groupBy("skill", "category").agg(F.count("*").alias("n"))


def skills_pandas(spark, d):
    j = spread(table(spark, d, "jobs_clean")).where("job_id is not null")
    category = P.literal_map({n: c for n, c, _ in L.catalogue()})
    s = j.select("job_id", F.explode(L.matched_pandas()(L.posting_text())).alias("skill")).distinct()
    return s.groupBy("skill", category[F.col("skill")].alias("category")).agg(F.count("*").alias("n"))


def keyword_frequency(spark, d):
    """Terms of the postings' descriptions that at least three employers use."""
    docs = spread(Warehouse(spark, d).stg_jobs.where("job_description is not null").select("job_id", "job_description", "employer_name"))
    return topics.vocabulary(topics.terms(docs, "job_id", "job_description"), docs, "job_id", "employer_name")


def ctfidf(spark, d):
    docs = spread(table(spark, d, "documents")).where("text is not null and source is not null")
    t = topics.class_tfidf(topics.terms(docs, "doc_id", "text"), docs.select("doc_id", "source"), "doc_id", "source")
    return t.select("source", "term", F.round("score", 5).alias("score"), F.col("place").cast("long").alias("place"))


def topics_kmeans(spark, d):
    v = table(spark, d, "embeddings")
    return topics.clusters(v, "vec_id", "embedding").groupBy("topic_id").agg(F.count("*").alias("n"), F.round(F.avg("topic_probability"), 4).alias("strength"))


def topic_labels(spark, d):
    """Topics of the postings' vectors with words of their descriptions."""
    w = Warehouse(spark, d)
    v = w.raw("posting_vectors").where("embedding is not null and exists(embedding, x -> x <> 0)").groupBy("job_id").agg(F.max("embedding").alias("embedding"))
    t = topics.clusters(v, "job_id", "embedding", k=6)
    docs = w.stg_jobs.select("job_id", "job_description", "employer_name").join(t.select("job_id"), "job_id", "left_semi")
    found = topics.terms(docs, "job_id", "job_description")
    words = topics.vocabulary(found, docs, "job_id", "employer_name").select("term")
    return topics.labels(topics.class_tfidf(found.join(words, "term"), t, "job_id", "topic_id"), "topic_id")


def years_extract(spark, d):
    y = posting_years(Warehouse(spark, d).stg_jobs, "job_id", "job_description")
    return y.groupBy("years_min", "years_max").agg(F.count("*").alias("n"), F.sum(F.col("years_mentions").cast("long")).alias("mentions"))


def hashing_embed(spark, d):
    e = encode.require_revision(encode.embedded(spread(table(spark, d, "documents")), "doc_id", "text"))
    return e.select("doc_id", F.col("n_chunks").cast("long").alias("n_chunks"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("length"))


def cosine_top_k(spark, d):
    v = table(spark, d, "embeddings")
    q = v.join(F.broadcast(v.agg(F.min("vec_id").alias("vec_id"))), "vec_id").select(F.col("embedding").alias("query_vector"), F.col("vec_id").alias("q_id"))
    r = R.closest_to(v, q, "vec_id", "embedding", 11)
    return r.where("vec_id <> q_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


def cosine_level_near(spark, d):
    level = P.literal_map({i: lv for i, lv in enumerate(["intern", "junior", "mid", "senior", "staff_plus", "manager"])})
    v = table(spark, d, "embeddings").withColumn("level", level[F.col("label")])
    q = v.join(F.broadcast(v.agg(F.min("vec_id").alias("vec_id"))), "vec_id").select(F.col("embedding").alias("query_vector"), F.lit("junior").alias("query_level"))
    r = R.closest_to(v, q, "vec_id", "embedding", 10, "level")
    return r.select("vec_id", "near_level", F.round("similarity", 6).alias("similarity"))


def _daily(spark, d) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return e.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("day"))).select("event_type", "day", "share")


def forecast_trend_band(spark, d):
    f = forecast.forecast(_daily(spark, d), ["event_type"], "day", "share", step=1)
    return texts(f.select("event_type", "status", "n_points", "forecast_at", *[F.round(c, 6).alias(c) for c in ("last_value", "forecast", "lower", "upper")]))


def forecast_gate(spark, d):
    s = Warehouse(spark, d).skill_demand
    f = forecast.forecast(s, ["search_role", "skill_name"], "collection_week", "share_of_role_postings")
    return texts(f.select("search_role", "skill_name", "status", "n_points", "last_at", "last_value", F.round("forecast", 6).alias("forecast")))


def backtest(spark, d):
    return forecast.backtest(_daily(spark, d), ["event_type"], "day", "share").select("event_type", F.round("mae_trend", 6).alias("mae_trend"), F.round("mae_naive", 6).alias("mae_naive"))


def json_counts(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def budget(spark, d):
    """The planner over the collections of the sightings as if they were its fetch log."""
    s = table(spark, d, "job_sightings")
    keys = s.select(T.raw_key("jobs", F.col("search_role"), F.col("search_location"), P.utc_day(F.col("fetched_at"))).alias("key")).distinct()
    pairs = s.groupBy(F.col("search_role").alias("role"), F.col("search_location").alias("location")).agg(F.lit(1).alias("one")).select("role", "location", F.row_number().over(Window.orderBy("location", "role")).alias("ordinal"))
    return texts(R.budget_plan(keys, pairs, F.lit("2026-09-20").cast("date"), 9000))


def display(spark, d):
    b = Warehouse(spark, d).salary_bands.where("salary_p25 is not null")
    return b.select("role_name", T.money(F.col("salary_median")).alias("median_text"), T.percent(F.col("median_vs_bls_pct")).alias("gap_text"), F.initcap("role_name").alias("title_text"), *T.axis_bounds(F.col("salary_p25"), F.col("salary_p75")))


def slugs(spark, d):
    return table(spark, d, "job_sightings").select(T.slug(F.col("search_role")).alias("role_slug"), T.slug(F.col("search_location")).alias("place_slug")).distinct()


def keys_md5(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.select("n_name", P.role_key(F.col("r_name")).alias("region_key"), P.location_key(F.col("n_name"), F.col("r_name"), F.lit(None).cast("string")).alias("place_key"))


def levels_regex(spark, d):
    lv = P.title_level(F.col("title"))
    return table(spark, d, "jobs_clean").groupBy(F.coalesce(lv, F.lit("none")).alias("level")).agg(F.count("*").alias("n"))


def segment_bands(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), *[R.percentile("o_totalprice", p).alias(k) for k, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))])
    return j.select("c_mktsegment", "n", *[P.gated(F.round(k, 4), F.col("n")).alias(k) for k in ("p25", "p50", "p75")])


def brand_with_without(spark, d):
    o, l, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    m = l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("o_orderkey"), "p_brand").distinct()
    r = R.compared(R.with_without_medians(m, o.select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", [], ["p_brand"]))
    return r.select("p_brand", F.col("n_with_skill").alias("n_with"), F.col("n_without_skill").alias("n_without"), F.col("median_salary_difference").alias("difference"))


def pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def latest_event(spark, d):
    return texts(R.latest_per_key(table(spark, d, "events"), ["user_id"], "ts", [F.col("event_id").desc()]).select("user_id", "event_id", "event_type", "ts"))


def weekly_events(spark, d):
    e = table(spark, d, "events").select(F.to_date(F.date_trunc("week", F.col("ts"))).alias("week"), "event_type", "user_id")
    weeks = e.groupBy("week").agg(F.countDistinct("user_id").alias("users"))
    seen = e.groupBy("week", "event_type").agg(F.countDistinct("user_id").alias("n"))
    every = weeks.crossJoin(broadcast_if_small(e.select("event_type").distinct()))  # weeks and event types: two short lists
    return texts(every.join(seen, ["week", "event_type"], "left").select("week", "event_type", F.coalesce("n", F.lit(0)).alias("n"), "users"))


def dq_all(spark, d):
    w = Warehouse(spark, d)
    j, s, sk = w.raw("jobs_clean"), w.raw("job_sightings"), w.raw("job_skills")
    return Q.all_of(
        Q.not_unique(j, ["job_id"], "unique_job_id"), Q.not_unique(s, ["job_id", "fetched_at"], "unique_sighting"), Q.is_null(j, "title", "job_id", "title_not_null"),
        Q.not_accepted(j, "salary_flag", ["unknown_period", "out_of_range", "inverted_range"], "accepted_flag"), Q.no_parent(sk, "job_id", j, "job_id", "skill_has_posting"),
        Q.violates(j.where("salary_min_annual is not null and salary_max_annual is not null"), F.col("salary_min_annual") <= F.col("salary_max_annual"), "job_id", "min_not_above_max"),
        Q.violates(w.job_trends.where("share_with_salary is not null"), F.col("share_with_salary").between(0, 1), "role_name", "share_in_range"),
        Q.violates(w.skill_salary_by_role, F.col("n_with_skill") + F.col("n_without_skill") == F.col("n_role_salaried"), "skill_name", "counts_add_up"),
        Q.violates(w.dim_location.agg(F.count_if("is_unknown").alias("n")).withColumn("k", F.lit("unknown")), F.col("n") == 1, "k", "one_unknown_place"),
    ).groupBy("check_name").agg(F.count("*").alias("n"), F.min("detail").alias("first_detail"))


def table_counts(spark, d):
    w = Warehouse(spark, d)
    return Q.same_count(w.raw("jobs_clean").select("job_id").distinct(), w.stg_jobs)


def freshness(spark, d):
    return texts(Q.freshness(table(spark, d, "jobs_clean"), "_loaded_at", F.to_timestamp(F.lit("2026-10-30 00:00:00"))))


def salary_gate(spark: SparkSession, d: str) -> DataFrame:
    from quarrymill.ml import salary

    rows = salary_rows(Warehouse(spark, d))
    return salary.use_model(salary.cross_validated(rows))


def weekly_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sightings as a stream of files; beyond the reference, which has none."""
    import uuid

    from quarrymill.streaming import demand

    schema = table(spark, d, "job_sightings").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "job_sightings.parquet").parquet(d) if not _is_folder(spark, f"{d}/job_sightings.parquet") else spark.readStream.schema(schema).parquet(f"{d}/job_sightings.parquet")
    name = f"weekly_{uuid.uuid4().hex}"
    demand.to_memory(demand.weekly_counts(s, "fetched_at", "search_role"), name)
    return texts(spark.table(name).select(F.to_date("week").alias("week"), "search_role", "n"))


def _is_folder(spark: SparkSession, p: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(p)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


QUERIES = {
    "sentence_split": sentence_split, "boilerplate_sentences": boilerplate, "word_chunks": word_chunks, "skill_match_explode": skills_native, "skill_match_pandas": skills_pandas,
    "keyword_doc_frequency": keyword_frequency, "ctfidf_top_terms": ctfidf, "topics_kmeans": topics_kmeans, "topic_labels": topic_labels, "years_extract": years_extract, "hashing_embed": hashing_embed,
    "cosine_top_k": cosine_top_k, "cosine_level_near": cosine_level_near, "forecast_trend_band": forecast_trend_band, "forecast_gate_status": forecast_gate, "backtest_naive_vs_trend": backtest,
    "json_prop_counts": json_counts, "budget_plan": budget, "display_money_percent": display, "slug_keys": slugs, "surrogate_keys_md5": keys_md5, "seniority_case_regex": levels_regex,
    "salary_bands_gated": segment_bands, "skill_salary_with_without": brand_with_without, "pricing_summary": pricing_summary, "latest_per_key": latest_event, "weekly_demand_zero_fill": weekly_events,
    "dq_checks": dq_all, "row_count_reconciliation": table_counts, "source_freshness": freshness, "gbt_salary_gate": salary_gate, "stream_weekly_counts": weekly_stream,
}

_SPLIT = r"regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')"
_SENT = f"sent AS (SELECT doc_id, title, u.pos AS pos, trim(u.s) AS sentence FROM (SELECT doc_id, title, unnest(list_zip(range(len(x)), x)) AS z FROM (SELECT doc_id, title, {_SPLIT} AS x FROM documents WHERE text IS NOT NULL)), LATERAL (SELECT z[1] AS pos, z[2] AS s) u WHERE trim(u.s) <> '')"
_GENERIC = ", ".join(f"'{w}'" for w in sorted(topics.GENERIC))
_TERMS = f"""toks AS (SELECT doc_id, site, source, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(text, '[\\n\\t]', ' ', 'g'), '[^A-Za-z0-9 ]', '', 'g')), ' +'), lambda t: length(t) > 1 AND t NOT IN ({_GENERIC})) AS w FROM documents WHERE text IS NOT NULL),
uses AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM toks UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM toks WHERE len(w) > 1) GROUP BY 1, 2)"""
_SKILL_SIDE = "(^|[^A-Za-z0-9+#])(?:{})([^A-Za-z0-9+#]|$)"


def _skill_sql() -> str:
    """Existence patterns without look-around; the two special names have their own."""
    import re

    rows = []
    for name, category, p in L.catalogue():
        if name == "Go":
            x = r"(?:\b[Gg][Oo][Ll][Aa][Nn][Gg]\b)|(?:[,/(] ?Go\b)|(?:\bGo\s*[,/)])"
        elif name == "R":
            x = r"(?:^|[^A-Za-z0-9&/-])R(?:[^A-Za-z0-9&+#''-]|$)"
        else:
            body = re.search(r"\(\?:(.*)\)\(\?!", p, re.S).group(1)
            x = ("(?i)" if p.startswith("(?i)") else "") + _SKILL_SIDE.format(body)
        rows.append(f"('{name}', '{category}', '{x}')")
    return ", ".join(rows)


_NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_DAILY = "daily AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY CAST(ts AS DATE)) AS share FROM events GROUP BY 1, 2)"
_CLIP = "least(greatest({}, 0e0), 1e0)"
ORACLES = {
    "sentence_split": f"WITH {_SENT} SELECT doc_id, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM sent GROUP BY 1",
    "boilerplate_sentences": rf"""WITH {_SENT}, k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(sentence), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) AS key FROM sent),
shared AS (SELECT key FROM k GROUP BY 1 HAVING count(DISTINCT title) >= 3), j AS (SELECT k.*, shared.key IS NULL AS own FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE own) AS n_own, CASE WHEN count(*) FILTER (WHERE own) = 0 THEN '(all kept)' ELSE md5(string_agg(sentence, chr(10) ORDER BY pos) FILTER (WHERE own)) END AS own_hash FROM j GROUP BY 1""",
    "word_chunks": r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w, unnest(range((len(w) + 149) // 150)) AS pos FROM w)
SELECT doc_id, pos, md5(array_to_string(w[pos * 150 + 1 : pos * 150 + 150], ' ')) AS chunk_hash FROM c""",
    "skill_match_explode": f"WITH cat(skill, category, p) AS (VALUES {_skill_sql()}), t AS (SELECT job_id, concat_ws(chr(10), title, description) AS t FROM jobs_clean WHERE job_id IS NOT NULL) SELECT skill, category, count(DISTINCT job_id) AS n FROM t JOIN cat ON regexp_matches(t, p) GROUP BY 1, 2",
    "keyword_doc_frequency": "WITH j AS (SELECT job_id AS doc_id, description AS text, employer AS site, '' AS source FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY _loaded_at DESC NULLS LAST, fetched_at DESC NULLS LAST) AS r FROM jobs_clean WHERE job_id IS NOT NULL) WHERE r = 1 AND description IS NOT NULL), "
    + _TERMS.replace("FROM documents", "FROM j") + " SELECT term, count(DISTINCT site) AS n_owners FROM uses JOIN toks USING (doc_id) GROUP BY 1 HAVING count(DISTINCT site) >= 3",
    "ctfidf_top_terms": f"""WITH {_TERMS}, g AS (SELECT source, term, sum(n) AS n FROM uses JOIN toks USING (doc_id) WHERE source IS NOT NULL GROUP BY 1, 2), a AS (SELECT source, sum(n) AS words FROM g GROUP BY 1), b AS (SELECT term, sum(n) AS uses FROM g GROUP BY 1),
s AS (SELECT source, term, sqrt(n * 1e0 / words) * ln(1 + (SELECT avg(words) FROM a) / uses) AS score FROM g JOIN a USING (source) JOIN b USING (term))
SELECT source, term, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, term) AS place FROM s) WHERE place <= 10""",
    "cosine_top_k": f"""WITH q AS (SELECT vec_id AS q_id, embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, q_id, list_sum(list_transform(range(1, len(qv) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(qv[i] AS DOUBLE))) / ({_NORM.format('qv')} * {_NORM.format('embedding')}) AS similarity FROM embeddings CROSS JOIN q)
SELECT vec_id, round(similarity, 6) AS similarity FROM (SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 11) WHERE vec_id <> q_id""",
    "cosine_level_near": f"""WITH q AS (SELECT embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, label NOT IN (3, 4, 5) AS near_level, list_sum(list_transform(range(1, len(qv) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(qv[i] AS DOUBLE))) / ({_NORM.format('qv')} * {_NORM.format('embedding')}) AS similarity FROM embeddings CROSS JOIN q)
SELECT vec_id, near_level, round(similarity, 6) AS similarity FROM s ORDER BY near_level DESC, s.similarity DESC, vec_id LIMIT 10""",
    "forecast_trend_band": f"""WITH {_DAILY}, p AS (SELECT event_type, share, day, date_diff('day', min(day) OVER (PARTITION BY event_type), day) AS x FROM daily),
t AS (SELECT event_type, count(*) AS n, max(x) AS last_x, arg_max(share, x) AS last_value, max(day) AS last_at, avg(x) AS mx, regr_slope(share, x) AS b, regr_intercept(share, x) AS a, regr_sxx(share, x) AS sxx, regr_syy(share, x) AS syy, regr_sxy(share, x) AS sxy FROM p GROUP BY 1),
e AS (SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) AS sd, unnest(CASE WHEN n >= 12 THEN range(1, 14) ELSE [0] END) AS k FROM t), f AS (SELECT *, a + b * (last_x + k) AS y, {forecast.Z} * sd * sqrt(1 + 1e0 / n + pow(last_x + k - mx, 2) / sxx) AS h FROM e)
SELECT event_type, CASE WHEN k > 0 THEN 'forecast' ELSE 'insufficient_history' END AS status, n AS n_points, CASE WHEN k > 0 THEN strftime(last_at + CAST(k AS INTEGER), '%Y-%m-%d') END AS forecast_at, round(last_value, 6) AS last_value,
  CASE WHEN k > 0 THEN round({_CLIP.format('y')}, 6) END AS forecast, CASE WHEN k > 0 THEN round({_CLIP.format('y - h')}, 6) END AS lower, CASE WHEN k > 0 THEN round({_CLIP.format('y + h')}, 6) END AS upper FROM f""",
    "backtest_naive_vs_trend": f"""WITH {_DAILY}, p AS (SELECT event_type, share, date_diff('day', min(day) OVER (PARTITION BY event_type), day) AS x, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM daily),
f AS (SELECT t.event_type, t.x, t.share AS y, regr_slope(h.share, h.x) AS b, regr_intercept(h.share, h.x) AS a, arg_max(h.share, h.i) AS before FROM p t JOIN p h ON h.event_type = t.event_type AND h.i < t.i WHERE t.n >= 16 AND t.i > t.n - 4 GROUP BY 1, 2, 3)
SELECT event_type, round(avg(abs({_CLIP.format('a + b * x')} - y)), 6) AS mae_trend, round(avg(abs(before - y)), 6) AS mae_naive FROM f GROUP BY 1""",
    "json_prop_counts": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY 1",
    "slug_keys": "SELECT DISTINCT trim(regexp_replace(lower(search_role), '[^a-z0-9]+', '_', 'g'), '_') AS role_slug, trim(regexp_replace(lower(search_location), '[^a-z0-9]+', '_', 'g'), '_') AS place_slug FROM job_sightings",
    "surrogate_keys_md5": "SELECT n_name, md5(lower(r_name)) AS region_key, md5(lower(concat_ws('|', n_name, r_name, ''))) AS place_key FROM nation JOIN region ON n_regionkey = r_regionkey",
    "seniority_case_regex": "SELECT coalesce(CASE " + " ".join(f"WHEN regexp_matches(title, '\\b({w})\\b', 'i') THEN '{lv}'" for lv, w in P.LEVEL_WORDS.items()) + " END, 'none') AS level, count(*) AS n FROM jobs_clean GROUP BY 1",
    "salary_bands_gated": "SELECT c_mktsegment, n, CASE WHEN n >= 5 THEN round(p25, 4) END AS p25, CASE WHEN n >= 5 THEN round(p50, 4) END AS p50, CASE WHEN n >= 5 THEN round(p75, 4) END AS p75 FROM (SELECT c_mktsegment, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)",
    "skill_salary_with_without": """WITH m AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), g AS (SELECT b.p_brand, o_totalprice AS v, m.l_orderkey IS NOT NULL AS has FROM (SELECT DISTINCT p_brand FROM m) b CROSS JOIN orders o LEFT JOIN m ON m.p_brand = b.p_brand AND m.l_orderkey = o_orderkey)
SELECT p_brand, count(*) FILTER (WHERE has) AS n_with, count(*) FILTER (WHERE NOT has) AS n_without, CASE WHEN count(*) FILTER (WHERE has) >= 5 AND count(*) FILTER (WHERE NOT has) >= 5 THEN round(quantile_cont(v, 0.5) FILTER (WHERE has) - quantile_cont(v, 0.5) FILTER (WHERE NOT has)) END AS difference FROM g GROUP BY 1""",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "latest_per_key": "SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "weekly_demand_zero_fill": """WITH e AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, user_id FROM events), w AS (SELECT week, count(DISTINCT user_id) AS users FROM e GROUP BY 1), s AS (SELECT week, event_type, count(DISTINCT user_id) AS n FROM e GROUP BY 1, 2)
SELECT w.week, t.event_type, coalesce(s.n, 0) AS n, w.users FROM w CROSS JOIN (SELECT DISTINCT event_type FROM e) t LEFT JOIN s ON s.week = w.week AND s.event_type = t.event_type""",
    "row_count_reconciliation": "WITH a AS (SELECT count(*) AS n FROM (SELECT 1 FROM jobs_clean WHERE job_id IS NOT NULL GROUP BY job_id)), b AS (SELECT count(DISTINCT job_id) AS n FROM jobs_clean) SELECT a.n AS source_rows, b.n AS sink_rows, a.n = b.n AS equal FROM a, b",
    "source_freshness": "SELECT strftime(max(_loaded_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS newest, max(_loaded_at) AT TIME ZONE 'UTC' < TIMESTAMP '2026-10-30' - INTERVAL 2 DAY AS stale FROM jobs_clean",
    "dq_checks": BASE.rstrip().rstrip(",") + """
, f AS (
  SELECT 'unique_job_id' AS check_name, job_id AS detail FROM jobs_clean WHERE job_id IS NOT NULL GROUP BY job_id HAVING count(*) > 1
  UNION ALL SELECT 'unique_sighting', concat_ws('|', job_id, CAST(fetched_at AS VARCHAR)) FROM job_sightings WHERE job_id IS NOT NULL AND fetched_at IS NOT NULL GROUP BY job_id, fetched_at HAVING count(*) > 1
  UNION ALL SELECT 'title_not_null', job_id FROM jobs_clean WHERE title IS NULL
  UNION ALL SELECT DISTINCT 'accepted_flag', salary_flag FROM jobs_clean WHERE salary_flag NOT IN ('unknown_period', 'out_of_range', 'inverted_range')
  UNION ALL SELECT DISTINCT 'skill_has_posting', job_id FROM job_skills WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT job_id FROM jobs_clean WHERE job_id IS NOT NULL)
  UNION ALL SELECT 'min_not_above_max', job_id FROM jobs_clean WHERE salary_min_annual > salary_max_annual)
SELECT check_name, count(*) AS n, min(detail) AS first_detail FROM f WHERE detail IS NOT NULL OR true GROUP BY 1""",
    "stream_weekly_counts": "SELECT strftime(date_trunc('week', fetched_at AT TIME ZONE 'UTC'), '%Y-%m-%d') AS week, search_role, count(*) AS n FROM job_sightings GROUP BY 1, 2",
}
ORACLES["display_money_percent"] = sql("""SELECT role_name, (CASE WHEN p50 < 0 THEN '-$' ELSE '$' END) || format('{:,}', CAST(floor(abs(round(p50)) / 1000 + 0.5e0) * 1000 AS BIGINT)) AS median_text, CASE WHEN bls > 0 THEN CAST(CAST(floor(round(p50 / bls - 1, 4) * 100 + 0.5e0) AS BIGINT) AS VARCHAR) || '%' END AS gap_text,
  array_to_string(list_transform(string_split(role_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title_text, floor(round(p25) / 25000) * 25000 AS axis_min, ceil(round(p75) / 25000) * 25000 AS axis_max FROM bands WHERE n >= 5""")
ORACLES["forecast_gate_status"] = sql("""SELECT search_role, skill_name, CASE WHEN k > 0 THEN 'forecast' ELSE 'insufficient_history' END AS status, n AS n_points, last_at, last_value, CASE WHEN k > 0 THEN round(least(greatest(a + b * (last_x + 7 * k), 0e0), 1e0), 6) END AS forecast
  FROM (SELECT search_role, skill_name, count(*) AS n, max(x) AS last_x, max(collection_week) AS last_at, arg_max(share_of_role_postings, x) AS last_value, regr_slope(share_of_role_postings, x) AS b, regr_intercept(share_of_role_postings, x) AS a, unnest(CASE WHEN count(*) >= 12 THEN range(1, 14) ELSE [0] END) AS k
  FROM (SELECT *, date_diff('day', min(CAST(collection_week AS DATE)) OVER (PARTITION BY search_role, skill_name), CAST(collection_week AS DATE)) AS x FROM demand) GROUP BY 1, 2)""", DEMAND)
ORACLES["budget_plan"] = """WITH f AS (SELECT DISTINCT search_role AS role, search_location AS location, CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) AS d FROM job_sightings),
u AS (SELECT count(*) FILTER (WHERE date_trunc('month', d) = DATE '2026-09-01' AND d < DATE '2026-09-20') * 3 AS before, count(*) FILTER (WHERE d = DATE '2026-09-20') * 3 AS today FROM f),
a AS (SELECT greatest(9000 - before, 0) // 11 AS allowance, today FROM u), p AS (SELECT role, location, max(d) AS last_fetched, row_number() OVER (ORDER BY location, role) AS ordinal FROM f GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (ORDER BY last_fetched, ordinal) AS place FROM p WHERE last_fetched <> DATE '2026-09-20')
SELECT role, location, strftime(last_fetched, '%Y-%m-%d') AS last_fetched, CAST(allowance AS BIGINT) AS allowance, place FROM c CROSS JOIN a WHERE place <= greatest(allowance - today, 0) // 3"""
ORACLES["skill_match_pandas"] = ORACLES["skill_match_explode"]
