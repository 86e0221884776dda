"""Topics: clusters of unit vectors with outliers, and words that tell a cluster from the others."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import topic_label
from quarrymill.operators.relational import cosine

#: Words too general for a topic: of English, and of postings.
GENERIC = frozenset(
    """a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how
    i if in into is it its just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their them then there these they this those through to too under until up very
    was we were what when where which while who whom why will with would you your yours""".split()
) | frozenset(
    """experience experienced work working team teams role roles job jobs position years year skills skill ability strong including required preferred requirements qualifications responsibilities
    candidate candidates opportunity opportunities company join using use new help support related knowledge understanding excellent level plus etc""".split()
)


def clusters(vectors: DataFrame, id_: str, vector: str, k: int = 10, cut_share: float = 0.1, seed: int = 42) -> DataFrame:
    """(id, topic_id, topic_probability): k clusters by cosine; the `cut_share` farthest of each cluster become topic -1 with
    probability 0. Deterministic for a seed."""
    v = vectors.where(F.col(vector).isNotNull()).select(id_, F.col(vector).cast("array<double>").alias("v")).withColumn("features", array_to_vector("v"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(v)
    spark = vectors.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "topic_id int, centre array<double>")
    p = model.transform(v).withColumnRenamed("prediction", "topic_id").join(F.broadcast(centres), "topic_id").withColumn("closeness", F.greatest(cosine(F.col("v"), F.col("centre")), F.lit(0.0)))
    limits = p.groupBy("topic_id").agg(F.percentile_approx("closeness", cut_share, 10_000).alias("least"))
    out = F.col("closeness") < F.col("least")
    return p.join(F.broadcast(limits), "topic_id").select(id_, F.when(out, -1).otherwise(F.col("topic_id")).alias("topic_id"), F.when(out, 0.0).otherwise(F.least("closeness", F.lit(1.0))).alias("topic_probability"))


def terms(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, term, n): words and neighbouring pairs without general words."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(text, r"[\n\t]", " "), r"[^A-Za-z0-9 ]", ""))
    w = F.filter(F.split(clean, " +"), lambda t: (F.length(t) > 1) & ~t.isin(*sorted(GENERIC)))
    d = docs.where(F.col(text).isNotNull()).select(F.col(id_), w.alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return d.select(id_, F.explode(F.concat("w", pairs)).alias("term")).groupBy(id_, "term").agg(F.count("*").alias("n"))


def vocabulary(found: DataFrame, docs: DataFrame, id_: str, owner: str, least: int = 3) -> DataFrame:
    """(term, n_owners) of the terms that `least` different owners use."""
    return found.join(docs.select(id_, owner), id_).groupBy("term").agg(F.countDistinct(owner).alias("n_owners")).where(F.col("n_owners") >= least)


def class_tfidf(found: DataFrame, groups: DataFrame, id_: str, group: str, top: int = 10) -> DataFrame:
    """(group, term, score, place): sqrt of the term's share of the group times ln(1 + mean words a group / uses of the term)."""
    g = found.join(groups.select(id_, group), id_).groupBy(group, "term").agg(F.sum("n").alias("n"))
    by_group = g.groupBy(group).agg(F.sum("n").alias("words"))
    by_term = g.groupBy("term").agg(F.sum("n").alias("uses"))
    mean = by_group.agg(F.avg("words").alias("mean_words"))
    s = g.join(by_group, group).join(by_term, "term").crossJoin(F.broadcast(mean)).withColumn("score", F.sqrt(F.col("n") / F.col("words")) * F.ln(1 + F.col("mean_words") / F.col("uses")))
    w = Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), "term")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(group, "term", "score", "place")


def labels(top_terms: DataFrame, group: str) -> DataFrame:
    """(group, top_words, label); group -1 is unassigned and has no words."""
    t = top_terms.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("words"))
    none = F.col(group) == -1
    return t.select(group, F.when(none, "").otherwise(F.array_join("words", ", ")).alias("top_words"), F.when(none, "unassigned").otherwise(topic_label(F.col("words"))).alias("label"))

