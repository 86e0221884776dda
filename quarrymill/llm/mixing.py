"""Mixing sources to target weights (problem 9).

Efraimidis-Spirakis sampling: each document draws an exponential key -ln(u)/w, with u from a hash of its id and w its quality weight;
the smallest keys of a source come first. A source whose budget exceeds its tokens is used in complete epochs first; the rest of its
budget is filled in key order by prefix sums of tokens.

No source is sorted in one task: keys fall into logarithmic ranges, of which none holds more than 1 / (e * `GRAIN`) of a source's documents whatever the weights are; tokens are summed per (source, range), the sums
of the ranges are accumulated (a window over some tens of thousand rows a source), and only the one range a source's budget ends in is ordered
inside. Keys depend on ids and the seed alone, so lost executors redraw the same sample.

Defined cases. Null or blank text, or a null id, can't be used. A repeated id counts once (its greatest token count, then source). Documents of
unlisted or null sources aren't used. A source without documents, or with a null or negative share, gives nothing. A source listed
twice has the sum of its shares and its greatest max_repeats; null max_repeats is 1. A source too small for its share gives all of
its documents max_repeats times: the report shows the shortfall, which isn't passed on to other sources: planned_share is what each source holds of the size asked for, actual_share of the
size that came out, and most_total_tokens the greatest size at which the source still holds its share. Equal keys: smaller id
first. Budgets are never exceeded; a source falls short by less than its next document. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.joins import lookup
from quarrymill.session import cut

#: Ranges of keys, per factor e.
GRAIN = 2048
#: A public vocabulary: ranks of byte pairs (.tiktoken), or a tokenizer's own file (.json). It must lie at this path on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-pair vocabulary of 50,256 entries splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict = {}


def _counts(path: str):
    """A function from texts to their numbers of tokens; the vocabulary is read once a worker."""
    if path.endswith(".tiktoken"):
        if path not in _loaded:
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _loaded[path] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(_loaded[path].encode_ordinary(t)) for t in texts]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].encode_special_tokens = True
    return lambda texts: [len(e) for k in range(0, len(texts), 64) for e in _loaded[path].encode_batch(texts[k : k + 64], add_special_tokens=False)]


def token_counter(path: str = TOKENIZER):
    """A pandas UDF with the number of tokens of each whole text under the public tokenizer file at `path` (on every executor)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = _counts(path)
        for s in batches:
            yield pd.Series(counts(s.fillna("").tolist()), dtype="int64")

    return count


def quality(text: Column) -> Column:
    """Share of letters, less for texts under 200 characters; between 0.02 and 1."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(letters * F.least(F.lit(1.0), F.length(text) / 200), F.lit(0.02))


def sized(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, weight) of the usable documents."""
    use = docs.where(F.col("doc_id").isNotNull() & (F.trim("text") != "")).select("doc_id", "source", "text")
    lean = use.select("doc_id", "source", token_counter(tokenizer)("text").alias("tokens"), quality(F.col("text")).alias("weight"))
    best = F.max(F.struct("tokens", "source", "weight")).alias("b")
    return lean.where(F.col("tokens") > 0).groupBy("doc_id").agg(best).select("doc_id", "b.source", "b.tokens", "b.weight")


def targets_of(targets: DataFrame) -> DataFrame:
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    return targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(share).alias("target_share"), F.max(F.coalesce(F.col("max_repeats").cast("long"), F.lit(1))).alias("max_repeats"))


def plan(sizes: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """A row a source: available and budgeted tokens, complete epochs, and what the fractional epoch may hold.

    total: tokens of the mix; by default as many as the listed sources hold once.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    p = targets_of(targets).join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("documents", F.lit(0)).alias("documents"))
    if total is None:
        total = p.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
    budget = F.floor(F.col("target_share") * F.lit(total) + F.lit(1e-6))
    # beyond this total the source can't hold its share any more
    most = F.when(F.col("target_share") > 0, F.floor(F.col("available") * F.col("max_repeats") / F.col("target_share")))
    epochs = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats"))).otherwise(F.lit(0))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(F.lit(0))
    return p.withColumn("planned", F.lit(total).cast("long")).withColumn("most_total", most).withColumn("budget", budget).withColumn("epochs", epochs).withColumn("rest", F.when(F.col("available") > 0, rest).otherwise(F.lit(0)))


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(documents used: doc_id, source, tokens, copies), (report: a row a source with target and actual share)."""
    sizes = cut(lookup(sized(docs, tokenizer), targets_of(targets).select("source", F.lit(True).alias("listed")), "source").where("listed").drop("listed"))
    sources = cut(plan(sizes, targets, total))
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit(2**53 - 1)).cast("double") + 0.5) / F.lit(float(2**53))
    keyed = sizes.withColumn("key", F.greatest(-F.ln(u) / F.col("weight"), F.lit(1e-300))).withColumn("bin", F.floor(F.ln("key") * GRAIN))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = keyed.groupBy("source", "bin").agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(up_to))
    # the first range that doesn't fit whole: what lies before it is taken, what lies behind isn't, and it alone is ordered inside
    ends = lookup(sums, sources.select("source", "rest"), "source").where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("t")).alias("before"))).alias("e"))
    cuts = cut(sources.select("source", "epochs", "rest").join(ends.select("source", F.col("e.bin").alias("last"), F.col("e.before").alias("before")), "source", "left"))
    all_ = lookup(keyed, cuts, "source")
    edge = all_.where(F.col("bin") == F.col("last"))
    order = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("extra", (F.col("before") + F.sum("tokens").over(order) <= F.col("rest")).cast("int"))
    rest = all_.where(F.coalesce(F.col("bin") != F.col("last"), F.lit(True))).withColumn("extra", F.coalesce(F.col("bin") < F.col("last"), F.lit(True)).cast("int"))
    used = cut(rest.unionByName(edge).select("doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).cast("long").alias("copies")).where("copies > 0"))
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.count("*").alias("used"))
    whole = used.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    report = sources.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.col("documents").alias("n_documents"), F.col("available").alias("available_tokens"), F.col("budget").alias("budget_tokens"),
        F.coalesce("used", F.lit(0)).alias("n_used"), F.coalesce("mixed", F.lit(0)).alias("mixed_tokens"),
        F.round(F.coalesce("mixed", F.lit(0)) / F.lit(float(max(1, whole))), 6).alias("actual_share"),
        F.round(F.coalesce("mixed", F.lit(0)) / F.greatest(F.col("planned"), F.lit(1)), 6).alias("planned_share"), F.col("most_total").alias("most_total_tokens"),
    )
    return used, report
