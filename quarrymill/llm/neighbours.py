"""Most similar vectors for every vector (problem 3).

Collision-counting hashing. `PROJECTIONS` random projections of a cell's members are kept as one sorted array each. A query opens a
window around its own value in every array; a member inside a window collides. Windows start narrow and are widened by virtual rehashing (`LEVELS`):
only the members that a wider window adds are counted. A member that collides in `SHARE` of the projections is verified: its whole vector, in
bytes, is compared with the query's. A query ends once its k-th verified neighbour is at least as similar as the windows are wide,
so that nearer ones would have collided; the widest windows are those of the least similarity that is asked for. What the bytes can't decide, the
float vectors do: all pairs that are kept are compared exactly at the end, and queries with more than `TIED` members around their k-th are compared with those exactly.

A single projection's window holds a fixed share of a collection, so on its own the counting is quadratic. It therefore runs inside
cells: each vector goes to the cells of its nearest pivots in `TABLES` independent tables. Pivots are vectors drawn by hash, at most
`MOST_PIVOTS` a table (the bounded sample that the index is fitted on); every vector is indexed. Of pivots nearer than `APART` one is kept: a region where
all are near each other isn't split, as its neighbours would be dealt to different cells. A cell
beyond `MOST_CELL` members is dealt by hash to blocks of about that size, and each two blocks meet in a task of their own, so nothing is left out;
its work grows with the square of its members. Exact copies (equal direction) are one class: classes are combined before any exchange and never expanded to all pairs.

Defined cases. Null vectors, vectors with null or non-finite elements, of length zero, or of another size than `size` take no part; nor do null ids.
A posting loaded several times is one posting; if its loads differ, each load is compared and the most similar counts. Equal
similarity: smaller id first. Fewer than k neighbours, one vector, or an empty table: what there is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.joins import lookup_counted
from quarrymill.session import broadcast_if_small, cut

PROJECTIONS, TABLES, PROBES = 64, 3, 2
MOST_PIVOTS, PER_CELL, MOST_CELL = 8192, 100, 3000
#: Widths of the windows, as parts of the distance of the least similarity.
LEVELS = (0.5, 0.71, 1.0)
#: Share of windows that make a candidate: under that of pairs as far apart as the windows are wide (0.68), over that of chance.
SHARE = 0.55
#: Members that bytes can't tell from a query's k-th, beyond which they are compared exactly inside the cell.
TIED = 50
#: Cosine from which two pivots are one.
APART = 0.7
#: Greatest difference of a cosine by bytes from the exact one; usual vectors differ by a tenth of it.
DOUBT = 0.016
#: Counts (queries times members) held at a time.
HELD = 100_000


def unit_rows(rows: DataFrame, size: int) -> DataFrame:
    """(job_id, cls, vec): unit float32 vectors as bytes and the hash of their direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("embedding")
            good = np.flatnonzero(e.is_valid().to_numpy(zero_copy_only=False) & (e.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size))
            taken = b.take(pa.array(good))
            flat = taken.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
            norm = np.linalg.norm(flat, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            x = flat[ok] / norm[ok, None]
            cls = [xxhash.xxh64_intdigest(r.tobytes()) - 2**63 for r in (np.round(x, 6) + 0.0).astype(np.float32)]
            yield pa.RecordBatch.from_arrays(
                [taken.column("job_id").take(pa.array(np.flatnonzero(ok))), pa.array(cls, pa.int64()), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], names=["job_id", "cls", "vec"]
            )

    return rows.where("job_id is not null").select(F.col("job_id").cast("string").alias("job_id"), "embedding").mapInArrow(run, "job_id string, cls long, vec binary")


def thinned(x: np.ndarray) -> np.ndarray:
    """The unit rows of x without those nearer than `APART` to one that is kept before."""
    kept = x[:0]
    for s in range(0, len(x), 512):
        block = x[s : s + 512]
        block = block[(block @ kept.T < APART).all(1)]
        near, keep = block @ block.T >= APART, np.zeros(len(block), bool)
        for k in range(len(block)):
            keep[k] = not near[k, :k][keep[:k]].any()
        kept = np.concatenate([kept, block[keep]])
    return kept


class Pivots:
    """Two levels: about sqrt(P) groups of about sqrt(P) pivots; a query looks into its nearest groups only."""

    def __init__(self, x: np.ndarray, seed: int):
        self.mean = x.mean(0)
        x = thinned(x) - self.mean
        self.x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        g = max(1, math.isqrt(len(x)))
        self.heads = self.x[np.random.default_rng(seed).permutation(len(x))[:g]]
        of = (self.x @ self.heads.T).argmax(1)
        self.members = [np.flatnonzero(of == k) for k in range(g)]
        self.near = min(g, 6)

    def cells(self, v: np.ndarray) -> np.ndarray:
        """The PROBES nearest pivots of each row of v."""
        v = v - self.mean
        score = np.full((len(v), PROBES), -np.inf, np.float32)
        best = np.zeros((len(v), PROBES), np.int64)
        groups = np.argpartition(-(v @ self.heads.T), self.near - 1, axis=1)[:, : self.near]
        for k, m in enumerate(self.members):
            rows = np.flatnonzero((groups == k).any(1))
            if not len(rows) or not len(m):
                continue
            s = np.concatenate([score[rows], v[rows] @ self.x[m].T], 1)
            c = np.concatenate([best[rows], np.broadcast_to(m, (len(rows), len(m)))], 1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :PROBES]
            score[rows], best[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
        return np.where(np.isfinite(score), best, best[:, :1])


class SortedArrays:
    """One sorted array a projection over the members of a cell; the arrays lie behind one another so that one search finds all windows."""

    def __init__(self, values: np.ndarray, widest: float):
        self.n, self.m = values.shape
        order = np.argsort(values, axis=0, kind="stable")
        self.offset = np.arange(self.m) * (np.ptp(values, axis=0).max(initial=0.0) * 2 + np.abs(values).max(initial=0.0) * 2 + 4 * widest + 1.0)
        self.sorted = (np.take_along_axis(values, order, 0) + self.offset).T.ravel()
        self.order = order.T.astype(np.int32).ravel()

    def windows(self, asked: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First position and the one after the last of each (projection, query), windows of +-width around the query."""
        at = (asked + self.offset).T.ravel()
        return np.searchsorted(self.sorted, at - width, "left"), np.searchsorted(self.sorted, at + width, "right")

    def count(self, counts: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Adds to counts (queries, members) one collision for each member in the stretches."""
        total = int(size.sum())
        if total:
            ends = np.cumsum(size)
            at = np.repeat((first - (ends - size)).astype(np.int32), size) + np.arange(total, dtype=np.int32)
            row = np.tile(np.arange(len(counts), dtype=np.int32) * self.n, len(size) // len(counts))
            counts += np.bincount(np.repeat(row, size) + self.order[at], minlength=counts.size).reshape(counts.shape).astype(np.int16)


def sides_of(side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(queries, members they meet): all with all, or, of two blocks, each with the other only."""
    x, y = np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0])
    return [(x, y), (y, x)] if len(y) else [(x, x)]


def cell_nearest(cls: np.ndarray, q8: np.ndarray, side: np.ndarray, directions: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, cosine by bytes) of each query's k most similar members and those the bytes can't tell from them; (query, member) row numbers of queries with more than TIED of those.

    Windows widen until the k-th verified neighbour is as near as they are wide.
    """
    v = q8.astype(np.float32)
    norm = np.sqrt((v * v).sum(1, dtype=np.float64))
    values = (v / norm[:, None]).astype(np.float32) @ directions
    doubt = 2 * (1 / norm).max()  # a byte's step in a unit vector
    reach = math.sqrt(2 - 2 * least)
    need = round(SHARE * directions.shape[1])
    found, tied = [], []
    for asked, met in sides_of(side):
        arrays = SortedArrays(values[met], reach)
        step = max(1, HELD // len(met))
        for s in range(0, len(asked), step):
            rows = asked[s : s + step]
            sims = np.full((len(rows), len(met)), -np.inf, np.float64)
            counts, seen = np.zeros(sims.shape, np.int16), rows[:, None] == met
            live = np.arange(len(rows))
            lo = hi = None
            for part in LEVELS:
                width = part * reach
                first, last = arrays.windows(values[rows[live]], width)
                now = counts[live]
                if lo is None:
                    arrays.count(now, first, last - first)
                else:
                    arrays.count(now, first, lo - first)
                    arrays.count(now, hi, last - hi)
                counts[live] = now
                q, o = np.nonzero((now >= need) & ~seen[live])
                if len(q):
                    a, b = rows[live[q]], met[o]
                    sims[live[q], o] = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b])
                    seen[live[q], o] = True
                kth = kth_best(sims[live], k)
                go = kth < 1 - width * width / 2
                if part == LEVELS[-1] or not go.any():
                    break
                keep = np.tile(go, arrays.m)
                live, lo, hi = live[go], first[keep], last[keep]
            kept = sims >= np.maximum(kth_best(sims, k), least)[:, None] - doubt
            many = kept.sum(1) > TIED + k
            if many.any():
                q, o = np.nonzero(kept & many[:, None])
                tied.append(np.stack([rows[q], met[o]]))
            q, o = np.nonzero(kept & ~many[:, None])
            found.append((cls[rows[q]], cls[met[o]], sims[q, o]))
    a, b, sim = (np.concatenate(f) for f in zip(*found))
    asked, other = np.concatenate(tied, 1) if tied else np.zeros((2, 0), np.int64)
    return a, b, sim, asked, other


def kth_best(sims: np.ndarray, k: int) -> np.ndarray:
    return np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] >= k else np.full(len(sims), -np.inf)


def exact_best(cls: np.ndarray, vec: np.ndarray, side: np.ndarray, asks: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sim), a < b: the k most similar others of each row that asks by exact cosine, of at least `least`; those that tie with the last are kept."""
    v = vec.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found = [(cls[:0], cls[:0], np.zeros(0))]
    for x, y in sides_of(side):
        x = x[asks[x]]
        for start in range(0, len(x), 256):
            rows = x[start : start + 256]
            sim = v[rows] @ v[y].T
            sim[rows[:, None] == y] = -np.inf
            r, o = np.nonzero(sim >= np.maximum(kth_best(sim, k) - 1e-12, least)[:, None])
            found.append((cls[rows[r]], cls[y[o]], sim[r, o]))
    a, b, sim = (np.concatenate(f) for f in zip(*found))
    pairs, at = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_index=True)
    return pairs[:, 0], pairs[:, 1], sim[at]


def in_groups(batches: Iterator[pa.RecordBatch], key: list[str], data: str, kind: type) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, cls, data, side, asks) of each run of equal keys; the rows are sorted by key."""
    last, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in key], 1)
        c, side, asks = (b.column(n).to_numpy(zero_copy_only=False) for n in ("cls", "side", "asks"))
        v = np.frombuffer(b"".join(b.column(data).to_pylist()), kind).reshape(b.num_rows, -1)
        cuts = np.r_[0, np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1, len(keys)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if tuple(keys[i]) != last:
                if held:
                    yield last, *(np.concatenate(h) for h in zip(*held))
                last, held = tuple(keys[i]), []
            held.append((c[i:j], v[i:j], side[i:j], asks[i:j]))
    if held:
        yield last, *(np.concatenate(h) for h in zip(*held))


KEY = ["cell", "x", "y"]


def in_blocks(placed: DataFrame) -> DataFrame:
    """Adds x <= y, a pair of blocks of the row's cell, and side, the row's own block. A cell of up to MOST_CELL rows is one block."""
    large = cut(placed.groupBy("cell").count().where(F.col("count") > MOST_CELL).select("cell", F.ceil(F.col("count") / MOST_CELL).alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = placed.join(broadcast_if_small(large), "cell", "left").withColumn("side", F.pmod(F.xxhash64("cls", "cell"), blocks))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return met.select("cls", "q8", "cell", F.least("side", "o").alias("x"), F.greatest("side", "o").alias("y"), "side", F.lit(True).alias("asks"))


def pivot_tables(rows: DataFrame, size: int, seed: int) -> list[Pivots]:
    """The index: pivots of each table from a sample that is bounded by MOST_PIVOTS, drawn by the hash of the id; equal vectors count once."""
    per_table = max(1, min(MOST_PIVOTS, rows.count() // PER_CELL))
    want = min(1.0, per_table * TABLES / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("job_id", F.lit(seed)), F.lit(1_000_000)) < max(1, round(want * 1_000_000)))
    drawn = unit_rows(some, size).groupBy("cls").agg(F.first("vec").alias("vec")).orderBy("cls").select("vec").limit(2 * MOST_PIVOTS * TABLES)
    x = np.array([np.frombuffer(r[0], np.float32) for r in drawn.collect()] or [np.ones(size, np.float32)])
    return [Pivots(x[t::TABLES] if len(x) >= TABLES else x, seed + t) for t in range(TABLES)]


def placed_rows(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """(job_id, cls, q8, cells): the vectors in bytes and the cells they go to; one reading of the table."""
    sent = rows.sparkSession.sparkContext.broadcast(pivot_tables(rows, size, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                v = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.float32).reshape(-1, size)
                q8 = np.rint(v * (127 / np.abs(v).max(1, keepdims=True))).astype(np.int8)
                cells = np.concatenate([t.cells(v) + k * MOST_PIVOTS * 4 for k, t in enumerate(tables)], 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("job_id"), part.column("cls"), pa.array([r.tobytes() for r in q8], pa.binary()), pa.array(list(cells), pa.list_(pa.int64()))], names=["job_id", "cls", "q8", "cells"]
                )

    return unit_rows(rows, size).mapInArrow(place, "job_id string, cls long, q8 binary, cells array<long>")


def candidates(placed: DataFrame, size: int, least: float, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes (a, b), a < b, to be compared exactly; members (cls, cell, x, y, side, asks) of cells whose queries bytes can't rank)."""
    directions = np.random.default_rng(seed).standard_normal((size, PROJECTIONS)).astype(np.float32)
    signed = placed.groupBy("cls").agg(F.first("q8").alias("q8"), F.first("cells").alias("cells"))
    dealt = in_blocks(signed.select("cls", "q8", F.explode(F.array_distinct("cells")).alias("cell"))).repartition(*KEY).sortWithinPartitions(*KEY)
    names = ["a", "b", "sim", *KEY, "side", "asks"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, cls, q8, side, _ in in_groups(batches, KEY, "q8", np.int8):
            a, b, sim, asked, other = cell_nearest(cls, q8, side, directions, least, k)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim), *[pa.nulls(len(a), pa.int64())] * 4, pa.nulls(len(a), pa.bool_())], names=names)
            rows = np.union1d(asked, other)
            if len(rows):
                none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), *none, *[pa.array(np.full(len(rows), g)) for g in group], pa.array(side[rows]), pa.array(np.isin(rows, asked))], names=names)

    out = cut(dealt.mapInArrow(count, "a long, b long, sim double, cell long, x long, y long, side long, asks boolean"))
    # over all cells a query's k best by bytes hold, and those that bytes can't tell from them; a pair met in several cells has one rank
    w = Window.partitionBy("a")
    ranked = out.where("b is not null").select("a", "b", "sim").withColumn("r", F.dense_rank().over(w.orderBy(F.desc("sim"), "b")))
    kept = ranked.withColumn("kth", F.max(F.when(F.col("r") == k, F.col("sim"))).over(w)).where(F.coalesce(F.col("sim") >= F.col("kth") - DOUBT, F.lit(True)))
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), out.where("b is null").select(F.col("a").alias("cls"), *KEY, "side", "asks")


def class_vectors(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, vec): one vector of each wanted class."""
    return units.select("cls", "vec").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("vec").alias("vec"))


def compared(dense: DataFrame, units: DataFrame, least: float, k: int) -> DataFrame:
    """(a, b, sim): the k most similar of each dense query of a cell among the cell's members that bytes can't tell apart, as whole vectors."""
    met = dense.join(class_vectors(units, dense.select("cls").distinct()), "cls").select("cls", *KEY, "side", "asks", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cls, vec, side, asks in in_groups(batches, KEY, "vec", np.float32):
            yield pa.RecordBatch.from_arrays([pa.array(f) for f in exact_best(cls, vec, side, asks, least, k)], names=["a", "b", "sim"])

    return met.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, "a long, b long, sim double")


def verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(a, b, sim): the whole vectors of candidate classes, one a class, meet by two equi joins."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    vectors = class_vectors(units, wanted)
    j = pairs.join(vectors.select(F.col("cls").alias("a"), F.col("vec").alias("va")), "a").join(vectors.select(F.col("cls").alias("b"), F.col("vec").alias("vb")), "b")

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                va, vb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(b.num_rows, -1).astype(np.float64) for c in ("va", "vb"))
                sim = (va * vb).sum(1) / np.sqrt((va * va).sum(1) * (vb * vb).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim)], names=["a", "b", "sim"])

    return j.select("a", "b", "va", "vb").mapInArrow(dot, "a long, b long, sim double")


def smallest_ids(members: DataFrame, k: int) -> DataFrame:
    """(cls, ids): the k + 1 smallest ids of each class. Tasks keep k + 1 a class before the exchange."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for b in batches:
            kept = b if kept is None else pd.concat([kept, b])
            kept = kept.sort_values(["cls", "job_id"]).groupby("cls", sort=False).head(k + 1)
            if len(kept) > 200_000:
                yield kept
                kept = None
        if kept is not None:
            yield kept

    some = members.select("cls", "job_id").mapInPandas(local, "cls long, job_id string")
    w = Window.partitionBy("cls").orderBy("job_id")
    return some.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("cls").agg(F.sort_array(F.collect_list("job_id")).alias("ids"))


def nearest(rows: DataFrame, size: int, k: int = 5, least: float = 0.8, seed: int = 11) -> DataFrame:
    """(job_id, neighbour, sim, rank): each posting's k most similar others of at least `least`."""
    placed, units = cut(placed_rows(rows, size, seed)), unit_rows(rows, size)
    members = placed.select("job_id", "cls").distinct()
    pairs, dense = candidates(placed, size, least, k, seed)
    sims = verified(cut(pairs), units).where(F.col("sim") >= least)
    if not dense.isEmpty():
        sims = sims.unionByName(compared(dense, units, least, k)).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    sims = cut(sims)
    both = sims.select(F.col("a").alias("cls"), F.col("b").alias("other"), "sim").unionAll(sims.select(F.col("b").alias("cls"), F.col("a").alias("other"), "sim"))
    ids = cut(smallest_ids(members, k))
    # k classes in order of similarity hold the k nearest; classes that tie with the last are needed for the order of ids
    top = both.withColumn("r", F.rank().over(Window.partitionBy("cls").orderBy(F.desc("sim")))).where(F.col("r") <= k)
    near = top.join(ids.select(F.col("cls").alias("other"), "ids"), "other").select("cls", "sim", F.explode("ids").alias("neighbour"))
    own = ids.where(F.size("ids") > 1).select("cls", F.lit(1.0).alias("sim"), F.explode("ids").alias("neighbour"))
    best = near.unionByName(own)
    few = best.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("sim"), "neighbour"))).where(F.col("r") <= 3 * k + 3)
    few = few.groupBy("cls").agg(F.collect_list(F.struct("neighbour", "sim")).alias("few")).join(members.groupBy("cls").agg(F.count("*").alias("n")), "cls")
    # a class may hold a third of all postings: its few neighbours are sent to the postings, not the postings to one task
    joined = lookup_counted(members, cut(few), "cls").select("job_id", F.explode("few").alias("f")).select("job_id", "f.neighbour", "f.sim").where(F.col("job_id") != F.col("neighbour"))
    joined = joined.groupBy("job_id", "neighbour").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("job_id").orderBy(F.desc("sim"), "neighbour")
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(rows: DataFrame, size: int = 384, k: int = 5, least: float = 0.8) -> DataFrame:
    """(job_id_a, job_id_b): pairs of at least `least` where one is among the k most similar of the other."""
    n = nearest(rows, size, k, least)
    return n.select(F.least("job_id", "neighbour").alias("job_id_a"), F.greatest("job_id", "neighbour").alias("job_id_b")).distinct()
