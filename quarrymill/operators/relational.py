"""Relational operators, each given its columns by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.postings import LEAST_SAMPLE, near_level
from quarrymill.session import broadcast_if_small, within


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. Spark pushes the rank limit below the exchange, so a hot key sends one row a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[Column] = ()) -> DataFrame:
    return best_per_key(df, keys, [F.col(at).desc_nulls_last(), *ties])


def best_per_content(df: DataFrame, key: str = "dedup_key", salary: str = "salary_mid_annual", text: str = "description", at: str = "fetched_at", id_: str = "job_id") -> DataFrame:
    """The most complete row of each content key: with salary, then longest text, then latest, then least id."""
    return best_per_key(df, [key], [F.col(salary).isNull().asc(), F.length(text).desc_nulls_last(), F.col(at).desc_nulls_last(), F.col(id_).asc()])


def share_of_group(df: DataFrame, group: Sequence[str], parts: Sequence[str], name: str = "share") -> DataFrame:
    """Rows counted by group and part, with the part's share of its group."""
    n = df.groupBy(*group, *parts).agg(F.count("*").alias("n"))
    return n.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def parts_of_total(df: DataFrame, group: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Each row's value as a share of its group's total; zero parts are dropped."""
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(*group))).where(F.col(value) != 0)


def percentile(value: str, p: float, times: str | None = None) -> Column:
    """Exact percentile with linear interpolation; `times` says how often each value counts."""
    return F.expr(f"percentile(`{value}`, {p}D{f', `{times}`' if times else ''})")


def with_without_medians(members: DataFrame, values: DataFrame, key: str, value: str, group: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Per group and item: how many valued rows have the item or not, and the median of both sides.

    `members` (key, group..., item...) distinct; `values` (key, group..., value). No row meets every item: rows are first counted by
    value, with and without items, so what is paired with the items are a group's distinct values.
    """
    g = list(group)
    all_ = values.where(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count("*").alias("n_all"))
    of_item = members.select(key, *g, *item).join(values.where(F.col(value).isNotNull()).select(key, value), key).groupBy(*g, *item, value).agg(F.count("*").alias("n_with"))
    items = members.select(*g, *item).distinct()
    grid = items.join(all_, g) if g else items.crossJoin(broadcast_if_small(all_))
    both = grid.join(of_item, [*g, *item, value], "left").select(*g, *item, value, F.coalesce("n_with", F.lit(0)).alias("n_with"), (F.col("n_all") - F.coalesce("n_with", F.lit(0))).alias("n_without"))
    return both.groupBy(*g, *item).agg(
        F.sum("n_with").alias("n_with_skill"), F.sum("n_without").alias("n_without_skill"),
        percentile(value, 0.5, "n_with").alias("__with"), percentile(value, 0.5, "n_without").alias("__without"),
    )


def compared(medians: DataFrame, least: int = LEAST_SAMPLE) -> DataFrame:
    """Status, rounded medians, and their difference where both sides have enough rows."""
    ok = (F.col("n_with_skill") >= least) & (F.col("n_without_skill") >= least)
    a, b = F.col("__with"), F.col("__without")
    return medians.withColumns({
        "sample_status": F.when(ok, "ok").otherwise("too_few_to_report"),
        "median_salary_with_skill": F.round(a), "median_salary_without_skill": F.round(b),
        "median_salary_difference": F.when(ok, F.round(a - b)),
        "median_salary_difference_pct": F.when(ok & (b > 0), F.round(a / b - 1, 4)),
    }).drop("__with", "__without")


def zero_filled(counts: DataFrame, periods: DataFrame, period: str, group: Sequence[str], item: Sequence[str], measure: str, carry: Sequence[Column] = ()) -> DataFrame:
    """Every item of a group in every period the group was seen; absent counts are 0, unseen periods stay absent.

    Counts (period, group..., item..., measure) are read once: each item keeps a map from period to count, as long as the calendar
    at most, and meets its group's periods by one join. `carry`: further aggregates of an item.
    """
    by = F.map_from_entries(F.collect_list(F.struct(period, measure))).alias("__by")
    items = counts.groupBy(*group, *item).agg(by, *carry)
    return periods.join(items, list(group)).withColumn(measure, F.coalesce(F.try_element_at("__by", F.col(period)), F.lit(0))).drop("__by")


def slice_of(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows with the wanted values; a column without one (None) filters nothing."""
    for column, value in wanted.items():
        df = df if value is None else df.where(F.col(column) == F.lit(value))
    return df


def slice_percentiles(df: DataFrame, groups: DataFrame, by: str, value: str, points: dict[str, float], where: Column | None = None, least: int = LEAST_SAMPLE) -> DataFrame:
    """Percentiles of a slice for every group of `groups`, also those without rows in it."""
    part = df if where is None else df.where(where)
    s = part.groupBy(by).agg(F.count("*").alias("n_postings"), F.count(value).alias("n_with_salary"), *[percentile(value, p).alias(k) for k, p in points.items()])
    n = F.coalesce("n_with_salary", F.lit(0))
    return groups.select(by).distinct().join(s, by, "left").select(
        by, F.coalesce("n_postings", F.lit(0)).alias("n_postings"), n.alias("n_with_salary"),
        F.when(n >= least, "ok").otherwise("too_few_to_report").alias("sample_status"), *[F.when(n >= least, F.col(k)).alias(k) for k in points])


def median_with_fallback(df: DataFrame, levels: Sequence[Sequence[str]], value: str, least: int = 3) -> DataFrame:
    """Each row with the median of its finest group of at least `least` rows, else of the next coarser, else of all.

    levels: from fine to coarse. Only the finest level is subject to `least`; coarser groups always count.
    """
    out = df
    names = []
    for i, keys in enumerate(levels):
        m = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(percentile(value, 0.5).alias(f"__m{i}"), F.count("*").alias("__n"))
        m = m.where(F.col("__n") >= least) if i == 0 else m
        out = out.join(m.drop("__n"), list(keys), "left")
        names.append(f"__m{i}")
    whole = df.agg(percentile(value, 0.5).alias("__all"))
    return out.crossJoin(F.broadcast(whole)).withColumn("expected", F.coalesce(*names, "__all")).drop(*names, "__all")


def weighted_match(core: DataFrame, by: str, weight: str, has: Column) -> DataFrame:
    """Share of the summed weight that is present, 0 where the sum is 0."""
    return core.groupBy(by).agg((F.sum(F.when(has, F.col(weight)).otherwise(0.0)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("m")).select(by, F.coalesce("m", F.lit(0.0)).alias("match"))


def top_missing(demand: DataFrame, have: DataFrame, by: str, item: str, rank: str, n: int = 3) -> DataFrame:
    """The n best-ranked items of each group that `have` doesn't hold."""
    rest = demand.join(have.select(item).distinct(), item, "left_anti")
    return rest.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(rank, item))).where(F.col("__r") <= n).drop("__r")


def recent_or_latest_day(df: DataFrame, at: str, now: Column, days: int = 7) -> DataFrame:
    """Rows of the last `days` before `now`; if there are none, the rows of the latest day. One plan, without a branch on the driver."""
    newest = df.agg(F.max(at).alias("__newest"))
    since = now - F.expr(f"INTERVAL {days} DAYS")
    from quarrymill.functions.postings import utc_day

    j = df.crossJoin(F.broadcast(newest))
    recent = F.col("__newest") >= since
    return j.where(F.when(recent, F.col(at) >= since).otherwise(utc_day(F.col(at)) == utc_day(F.col("__newest")))).withColumn("window_kind", F.when(recent, "last_7_days").otherwise("latest_collection")).drop("__newest")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in built-in functions, over doubles."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    length = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)) for v in (x, y)]
    return dot / F.nullif(length[0] * length[1], F.lit(0.0))


def closest_to(pool: DataFrame, query: DataFrame, id_: str, vector: str, n: int = 10, level: str | None = None) -> DataFrame:
    """The n rows of `pool` closest to the single row of `query` (query_vector[, query_level]): near levels first, then by similarity."""
    if not within(query, 1):
        raise ValueError("one query row expected")
    j = pool.crossJoin(F.broadcast(query)).withColumn("similarity", cosine(F.col(vector), F.col("query_vector")))
    near = near_level(F.col(level), F.col("query_level")) if level else F.lit(True)
    return j.withColumn("near_level", near).orderBy(F.desc("near_level"), F.desc("similarity"), id_).limit(n)


def shared_in_order(own: Column, other: Column) -> Column:
    return F.filter(own, lambda x: F.array_contains(other, x))


def delimited(text: Column, mark: str = ", ") -> Column:
    """The parts of a delimited text; null gives an empty array."""
    return F.coalesce(F.split(text, mark), F.array().cast("array<string>"))


def group_fold(key: Column, folds: int = 5) -> Column:
    """Fold of a group from its hash: a group is never split."""
    return (F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 8), 16, 10).cast("long") % folds).cast("int")


def stratified_sample(df: DataFrame, strata: Sequence[str], id_: str, n: Column | int) -> DataFrame:
    """The first n rows of each stratum by the MD5 of the id."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(id_).cast("string")))
    return df.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def budget_plan(keys: DataFrame, pairs: DataFrame, today: Column, budget: int, pages: int = 3) -> DataFrame:
    """Pairs to fetch today under a monthly request budget: (role, location, last_fetched, allowance, place).

    keys (key): paths jobs/raw/{role}/{location}/{yyyy-mm-dd}.json; malformed ones are ignored. pairs (role, location, ordinal).
    Every file of this month counts `pages` requests. What is left before today is spread over the days left; today's use is taken
    off. Pairs not fetched today come in the order of their last fetch, never-fetched first, then ordinal.
    """
    from quarrymill.functions.text import slug

    p = F.split("key", "/")
    parsed = keys.where(F.col("key").rlike(r"^jobs/raw/[^/]+/[^/]+/\d{4}-\d{2}-\d{2}\.json$")).select(F.get(p, F.lit(2)).alias("r"), F.get(p, F.lit(3)).alias("l"), F.expr("try_to_date(substring(element_at(split(key, '/'), 5), 1, 10))").alias("d")).where("d is not null")
    month = F.trunc("d", "month") == F.trunc(today, "month")
    used = parsed.agg(F.count_if(month & (F.col("d") < today)).alias("before"), F.count_if(F.col("d") == today).alias("now"))
    left = F.datediff(F.last_day(today), today) + 1
    allowance = F.floor(F.greatest(F.lit(budget) - F.col("before") * pages, F.lit(0)) / left)
    used = used.select(allowance.alias("allowance"), F.floor(F.greatest(allowance - F.col("now") * pages, F.lit(0)) / pages).alias("n_pairs"))
    last = parsed.groupBy("r", "l").agg(F.max("d").alias("last_fetched"))
    c = pairs.withColumns({"r": slug(F.col("role")), "l": slug(F.col("location"))}).join(last, ["r", "l"], "left").where(F.col("last_fetched").isNull() | (F.col("last_fetched") != today))
    w = Window.orderBy(F.col("last_fetched").asc_nulls_first(), "ordinal")  # the pairs are a short fixed list
    return c.withColumn("place", F.row_number().over(w)).crossJoin(F.broadcast(used)).where(F.col("place") <= F.col("n_pairs")).select("role", "location", "last_fetched", "allowance", "place")
