"""Salary model: features fixed at fit time, boosted trees on log pay, folds that never split an employer, a gate against medians."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.relational import group_fold
from quarrymill.session import cut

SKILL_FLOOR, WHAT_IF_FLOOR, FOLDS = 10, 5, 5
#: Step of a tree, most trees, and trees without a lower error after which no more are grown.
STEP, MOST_TREES, PATIENCE = 0.05, 2000, 50


def fit_spec(rows: DataFrame, floor: int = SKILL_FLOOR) -> dict[str, list[str]]:
    """Categories known to the model. Their numbers are bounded by the vocabulary, not by the rows."""
    def distinct(c: str) -> list[str]:
        return sorted(r[0] for r in rows.where(F.col(c).isNotNull()).select(c).distinct().collect())

    skills = rows.select(F.explode("skills").alias("s")).groupBy("s").count().where(F.col("count") >= floor)
    return {"role": distinct("role"), "seniority": sorted({*distinct("seniority"), "unknown"}), "state": sorted({*distinct("state"), "unknown"}), "skills": sorted(r["s"] for r in skills.collect())}


def features(rows: DataFrame, spec: dict[str, list[str]]) -> DataFrame:
    """Adds f_... columns: one-hot role, level and state (unseen ones are unknown), remote, skills, and the number of all skills.

    An unseen role is an error.
    """
    out = {"f_role_check": F.when(F.col("role").isin(*spec["role"]), 0.0).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce("role", F.lit("null")))).cast("double"))}
    out |= {f"f_role_{i}": (F.col("role") == r).cast("double") for i, r in enumerate(spec["role"])}
    for name in ("seniority", "state"):
        seen = F.when(F.col(name).isin(*spec[name]), F.col(name)).otherwise("unknown")
        out |= {f"f_{name}_{i}": (seen == v).cast("double") for i, v in enumerate(spec[name])}
    out["f_remote"] = F.coalesce(F.col("remote"), F.lit(False)).cast("double")
    out |= {f"f_skill_{i}": F.array_contains("skills", s).cast("double") for i, s in enumerate(spec["skills"])}
    out["f_skill_count"] = F.size("skills").cast("double")
    return rows.withColumns(out)


def assembled(rows: DataFrame, spec: dict) -> DataFrame:
    f = features(rows, spec)
    cols = [c for c in f.columns if c.startswith("f_")]
    return VectorAssembler(inputCols=cols, outputCol="features").transform(f).drop(*cols)


def trained(data: DataFrame, trees: int, seed: int) -> GBTRegressionModel:
    return GBTRegressor(maxDepth=3, stepSize=STEP, maxIter=trees, subsamplingRate=0.8, seed=seed, minInstancesPerNode=3).fit(data)


def tree_count(data: DataFrame, trees: int, seed: int) -> int:
    """The number of trees, at most `trees`, with the least error on the validation rows, once PATIENCE further trees brought no less.

    Trees are grown in doubling numbers; the same seed grows the same first ones again. Without rows on both sides nothing can be
    chosen, and PATIENCE trees are taken.
    """
    seen, held = data.where(~F.col("validation")), data.where("validation")
    if seen.isEmpty() or held.isEmpty():
        return min(trees, PATIENCE)
    grown = min(trees, 2 * PATIENCE)
    while True:
        errors = trained(seen, grown, seed).evaluateEachIteration(held, "squared")
        best = 0
        for m, e in enumerate(errors):
            if e < errors[best]:
                best = m
            if m - best >= PATIENCE:
                return best + 1
        if grown >= trees:
            return best + 1
        grown = min(trees, 2 * grown)


def prepared(rows: DataFrame, spec: dict) -> DataFrame:
    """(features, label: log pay, validation: a fifth of the employers)."""
    data = assembled(rows, spec).withColumns({"label": F.log("salary"), "validation": group_fold(F.concat_ws("#", F.lit("v"), "employer")) == 0})
    return cut(data.select("features", "label", "validation"))


def fit(rows: DataFrame, spec: dict, trees: int = MOST_TREES, seed: int = 42) -> GBTRegressionModel:
    """Boosted trees on log pay; their number is chosen by a fifth of the employers, and the model is then fitted on all rows."""
    data = prepared(rows, spec)
    return trained(data, tree_count(data, trees, seed), seed)


def fit_final(rows: DataFrame, trees: int = MOST_TREES, seed: int = 42) -> tuple[GBTRegressionModel, dict]:
    """(model of all rows, its spec): as many trees as the median of the folds' numbers."""
    spec, folds = fit_spec(rows), rows.withColumn("fold", group_fold(F.col("employer"), FOLDS))
    counts = sorted(tree_count(prepared(folds.where(F.col("fold") != k), spec), trees, seed) for k in range(FOLDS))
    return trained(prepared(rows, spec), counts[len(counts) // 2], seed), spec


def card(cv: DataFrame) -> dict:
    """What is to be known of a model: rows, errors of model and role medians, by role, and whether the model is to be used."""
    whole = use_model(cv).first()
    roles = cv.groupBy("role").agg(F.avg(F.abs(F.col("predicted") - F.col("salary"))).alias("m"), F.avg(F.abs(F.col("role_median") - F.col("salary"))).alias("r")).collect()
    return {"n": whole["n"], "mae_model": whole["mae_model"], "mae_role_median": whole["mae_role_median"], "use_model": whole["use_model"], "roles": {r["role"]: {"mae_model": r["m"], "mae_role_median": r["r"]} for r in roles}}


def export(model: GBTRegressionModel, spec: dict, about: dict, path: str) -> None:
    """Writes model, spec and card under `path`; what stood there is replaced."""
    from quarrymill.sources.sinks import put_json

    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    put_json(spark, f"{path}/card.json", {"spec": spec, "card": about})


def load(spark: SparkSession, path: str) -> tuple[GBTRegressionModel, dict, dict]:
    """(model, spec, card) as exported."""
    import json

    held = json.loads(spark.read.text(f"{path}/card.json", wholetext=True).first()[0])
    return GBTRegressionModel.load(f"{path}/model"), held["spec"], held["card"]


def answer(profile: DataFrame, medians: DataFrame, errors: DataFrame, overall: float | None) -> DataFrame:
    """The estimate for each profile (role[, predicted]): the model's value if there is one, else the role's median, with the role's mean error, else the overall one.

    medians (role, role_median), errors (role, error): a row a role. Without either error there is no range.
    """
    from_model = F.col("predicted") if "predicted" in profile.columns else F.lit(None).cast("double")
    j = profile.join(medians, "role", "left").join(errors, "role", "left").withColumn("value", F.coalesce(from_model, "role_median"))
    e = estimate(F.col("value"), F.col("error"), F.lit(overall).cast("double"))
    return j.withColumn("source", F.when(from_model.isNotNull(), "model").when(F.col("role_median").isNotNull(), "role_median").otherwise("none")).withColumn("e", e).drop("value", "role_median", "error").select("*", "e.low", "e.value", "e.high").drop("e")


def predict(model: GBTRegressionModel, rows: DataFrame, spec: dict) -> DataFrame:
    return model.transform(assembled(rows, spec)).withColumn("predicted", F.exp("prediction")).drop("features", "prediction")


def cross_validated(rows: DataFrame, trees: int = MOST_TREES) -> DataFrame:
    """Every row with the prediction of a model that saw none of its employer's rows, and the role median of those other rows."""
    rows = cut(rows.withColumn("fold", group_fold(F.col("employer"), FOLDS)))
    roles = fit_spec(rows)["role"]  # a role of the held-out fold alone has no pay to learn from, but is no error

    def one(k: int) -> DataFrame | None:
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        if train.isEmpty() or test.isEmpty():
            return None
        spec = fit_spec(train) | {"role": roles}  # levels, states and skills are those the training part knows
        medians = train.groupBy("role").agg(F.median("salary").alias("role_median"))
        return predict(fit(train, spec, trees), test, spec).join(medians, "role", "left").select("job_id", "role", "salary", "predicted", "role_median", "fold")

    with ThreadPool(FOLDS) as pool:  # folds are small jobs one after another, so they run side by side
        parts = [p for p in pool.map(inheritable_thread_target(rows.sparkSession)(one), range(FOLDS)) if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def use_model(cv: DataFrame) -> DataFrame:
    """One row: errors of model and role medians, and whether the model is to be used."""
    m = cv.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("salary"))).alias("mae_model"), F.avg(F.abs(F.col("role_median") - F.col("salary"))).alias("mae_role_median"))
    return m.withColumn("use_model", F.col("mae_model") < F.col("mae_role_median"))


def estimate(value, error, fallback_error):
    """low, value, high of an estimate with its error, not under 0."""
    e = F.coalesce(error, fallback_error)
    return F.struct(F.greatest(value - e, F.lit(0.0)).alias("low"), value.alias("value"), (value + e).alias("high"))


def what_if_skills(rows: DataFrame, floor: int = WHAT_IF_FLOOR) -> DataFrame:
    return rows.select("role", F.explode("skills").alias("skill")).groupBy("role", "skill").agg(F.count("*").alias("n")).where(F.col("n") >= floor)


def what_if(model: GBTRegressionModel, profile: DataFrame, skills: list[str], spec: dict) -> DataFrame:
    """(skill, delta): the change of the predicted pay if the single profile had the skill; largest first. One scoring for all."""
    spark = profile.sparkSession
    add = spark.createDataFrame([(s,) for s in ["", *skills]], "add string")
    v = profile.crossJoin(F.broadcast(add)).withColumn("skills", F.when(F.col("add") == "", F.col("skills")).otherwise(F.array_union("skills", F.array("add"))))
    p = predict(model, v, spec).select("add", "predicted")
    base = p.where("add = ''").select(F.col("predicted").alias("base"))
    return p.where("add <> ''").crossJoin(F.broadcast(base)).select(F.col("add").alias("skill"), (F.col("predicted") - F.col("base")).alias("delta")).orderBy(F.desc("delta"), "skill")

