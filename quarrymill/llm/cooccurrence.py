"""Items that appear together (problem 5).

A basket's distinct items are brought together by one exchange, after tasks have combined their own rows. Each pair of a basket's items becomes one
64-bit code (smaller item number in the high half). Every task sorts its codes in runs and
replaces each run by (code, count); the exchange then brings equal codes together, Spark's external sorter spills and merges the
sorted runs, and a run-length count over the merged order adds them up. No hash table of pairs is held anywhere.

Defined cases. Null or blank items aren't items; a row without basket id takes no part; repeated (basket, item) rows count once.
n is the number of baskets with at least one item. A basket with one item has no pair but counts in n. An empty table gives no
rows. Items are compared letter for letter and ordered by their bytes. Other columns, also ones named like the results, don't
matter. A basket of more than `BLOCK` items is cut into blocks of item positions that are dealt to all tasks, so neither a row nor a task holds all its pairs;
its distinct items, at most the vocabulary, are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.joins import lookup
from quarrymill.session import BROADCAST_ROWS, cut

#: Items of a basket that one block pairs with the rest of the basket.
BLOCK = 256
#: Codes that a task sorts at a time.
RUN = 4_000_000


def baskets_of(df: DataFrame, basket: str, item: str) -> DataFrame:
    """(items): the distinct items of each basket."""
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where(F.col("basket").isNotNull() & (F.trim("item") != ""))
    return rows.groupBy("basket").agg(F.collect_set("item").alias("items")).select("items")


def item_numbers(counts: DataFrame) -> DataFrame:
    """(item, c, code): numbers in byte order, so that packed pairs keep a < b. The distinct items are numbered after a range
    exchange: offsets come from one count a partition, never from one task holding all items."""
    ordered = cut(counts.repartitionByRange("item").sortWithinPartitions("item").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    if total >= 2**31:
        raise ValueError("more distinct items than a 64-bit pair code holds")
    at = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("part")] if offsets else F.lit(0)
    return ordered.select("item", "c", "part", at.alias("base")).mapInArrow(_number, "item string, c long, code int")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = 0
    for b in batches:
        code = np.arange(b.num_rows, dtype=np.int64) + seen + b.column("base").to_numpy(zero_copy_only=False)
        seen += b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("item"), b.column("c"), pa.array(code.astype(np.int32))], names=["item", "c", "code"])


def _runs(codes: list[np.ndarray]) -> pa.RecordBatch:
    values, n = np.unique(np.concatenate(codes), return_counts=True)  # sorts, then counts run lengths
    return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["code", "n"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (items in order, hi): pairs of the positions before hi with all later ones; out come sorted runs (code, n). Rows of equal shape are paired together."""
    held, size = [], 0
    for b in batches:
        lists = b.column("items")
        flat, lengths = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts, his = np.cumsum(lengths) - lengths, np.minimum(b.column("hi").to_numpy(zero_copy_only=False), lengths)
        for n, hi in np.unique(np.stack([lengths, his], 1), axis=0).tolist():
            i = np.repeat(np.arange(hi), n - 1 - np.arange(hi))
            if not len(i):
                continue
            j = np.arange(len(i)) - np.repeat(np.cumsum(n - 1 - np.arange(hi)) - (n - 1 - np.arange(hi)), n - 1 - np.arange(hi)) + i + 1
            rows = starts[(lengths == n) & (his == hi)]
            step = max(1, RUN // len(i))
            for k in range(0, len(rows), step):
                x = flat[rows[k : k + step, None] + np.arange(n)]
                held.append(((x[:, i] << 32) | x[:, j]).ravel())
                size += held[-1].size
                if size >= RUN:
                    yield _runs(held)
                    held, size = [], 0
    if held:
        yield _runs(held)


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up equal codes of an ordered stream; the last code of a batch waits for the next batch."""
    last = None
    for b in batches:
        code, n = b.column("code").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)
        if not len(code):
            continue
        if last is not None:
            code, n = np.r_[last[0], code], np.r_[last[1], n]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        sums = np.add.reduceat(n, starts)
        last = (code[starts[-1]], sums[-1])
        if len(starts) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(code[starts[:-1]]), pa.array(sums[:-1])], names=["code", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]])], names=["code", "n"])


def pair_counts(sets: DataFrame) -> DataFrame:
    """(code, n) from baskets (items: item numbers in order)."""
    small = sets.where(F.size("items") <= BLOCK).select("items", F.lit(BLOCK).alias("hi"))
    # a block carries only its own items and the later ones
    large = sets.where(F.size("items") > BLOCK).select("items", F.explode(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / BLOCK))).alias("b"))
    large = large.select(F.slice("items", (F.col("b") * BLOCK).cast("int") + 1, F.size("items")).alias("items"), F.lit(BLOCK).alias("hi"))
    dealt = large.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = small.unionAll(dealt).mapInArrow(_pairs, "code long, n long")
    return runs.repartition("code").sortWithinPartitions("code").mapInArrow(_run_lengths, "code long, n long")


def numbered(sets: DataFrame, numbers: DataFrame, n_items: int) -> DataFrame:
    """(items): the numbers of the kept items of each basket, in order. Up to BROADCAST_ROWS names are sent to the tasks; more are joined."""
    if n_items > BROADCAST_ROWS:
        rows = sets.withColumn("basket", F.monotonically_increasing_id()).select("basket", F.explode("items").alias("item"))
        coded = lookup(rows, numbers.select("item", "code"), "item").where(F.col("code").isNotNull())
        return coded.groupBy("basket").agg(F.sort_array(F.collect_list("code")).alias("items")).select("items").where(F.size("items") > 1)
    known = [(r["item"], r["code"]) for r in numbers.select("item", "code").collect()]
    sent = sets.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes = pa.array([i for i, _ in sent.value], pa.string()), np.array([c for _, c in sent.value], np.int64)
        for b in batches:
            lists = b.column("items")
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            row, code = row[at >= 0], codes[at[at >= 0]]
            order = np.lexsort((code, row))
            row, code, sizes = row[order], code[order], np.bincount(row, minlength=b.num_rows)
            wide = sizes > 1
            ends = np.r_[0, np.cumsum(sizes[wide])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(code[wide[row]].astype(np.int32)))], names=["items"])

    return sets.mapInArrow(run, "items array<int>")


def pairs(df: DataFrame, basket: str, item: str, least_count: int = 1, least_share: float = 0.0, least_lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_both, n_a, n_b, n_baskets, lift, odds_ratio) of each pair with at least least_count baskets and
    least_share of all baskets and least_lift times the baskets expected by chance. item_a < item_b.

    odds_ratio has the continuity correction of a half in each cell. An item that can't be in any such pair (too rare alone; or so
    frequent that even its own baskets are no least_lift times the chance) is left out before pairing; that loses no pair.
    """
    sets = cut(baskets_of(df, basket, item))
    n = sets.count()
    counts = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"))
    few = max(least_count, least_share * n)
    # n_both <= min(n_a, n_b), so lift * max(n_a, n_b) <= n for a pair that is wanted
    keep = (F.col("c") >= few) & ((F.col("c") * F.lit(float(least_lift)) <= n) if least_lift > 0 else F.lit(True))
    numbers = cut(item_numbers(counts.where(keep)))
    both = pair_counts(numbered(sets, numbers, numbers.count())).where(F.col("n") >= few)
    both = both.select(F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), F.col("n").alias("n_both"))
    names = numbers.select("code", "item", "c")
    out = lookup(both, names.select(F.col("code").alias("a"), F.col("item").alias("item_a"), F.col("c").alias("n_a")), "a")
    out = lookup(out, names.select(F.col("code").alias("b"), F.col("item").alias("item_b"), F.col("c").alias("n_b")), "b")
    out = out.where(F.col("n_both") * F.lit(n) >= F.lit(float(least_lift)) * F.col("n_a") * F.col("n_b"))
    return out.select("item_a", "item_b", "n_both", "n_a", "n_b", F.lit(n).cast("long").alias("n_baskets"), lift(n), odds_ratio(n))


def lift(n: int) -> Column:
    return (F.col("n_both").cast("double") * F.lit(n) / F.col("n_a") / F.col("n_b")).alias("lift")


def odds_ratio(n: int) -> Column:
    both, a, b = (F.col(c).cast("double") for c in ("n_both", "n_a", "n_b"))
    return ((both + 0.5) * (F.lit(n) - a - b + both + 0.5) / ((a - both + 0.5) * (b - both + 0.5))).alias("odds_ratio")
