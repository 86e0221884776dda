"""Joins that hold up when a key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import BROADCAST_ROWS, within


def lookup(rows: DataFrame, entries: DataFrame, key: str, salts: int = 8, most: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of `rows` with the lookup table `entries` (unique by `key`); null keys find nothing.

    The lookup is broadcast when it was counted to have at most `most` rows. Otherwise it is repeated `salts` times and the rows
    are spread over the salts, so a key that holds a third of all rows, or null keys, never meet in one task. salts=1 is for rows
    whose keys can't be hot.
    """
    if within(entries, most):
        return rows.join(F.broadcast(entries), key, "left")
    if salts == 1:
        return rows.join(entries, key, "left")
    salted = entries.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c, t in rows.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int"))
    return spread.join(salted, [key, "__salt"], "left").drop("__salt")


def lookup_counted(rows: DataFrame, entries: DataFrame, key: str, n: str = "n", share: float = 0.001) -> DataFrame:
    """Left join of `rows` with `entries`, which has each key of `rows` and how often it occurs there (`n`).

    Keys with more than `share` of all rows, of which there can't be more than 1 / share, are broadcast; the others are too rare to be
    hot and meet by a plain exchange. Neither side is repeated.
    """
    if within(entries):
        return rows.join(F.broadcast(entries.drop(n)), key, "left")
    total = entries.agg(F.sum(n)).first()[0]
    hot = F.col(n) > share * total
    few = F.broadcast(entries.where(hot).drop(n).withColumn("__hot", F.lit(True)))
    marked = rows.join(few.select(key, "__hot"), key, "left")
    frequent = marked.where("__hot").drop("__hot").join(few.drop("__hot"), key)
    rare = marked.where("__hot is null").drop("__hot").join(entries.where(~hot).drop(n), key, "left")
    return frequent.unionByName(rare)
