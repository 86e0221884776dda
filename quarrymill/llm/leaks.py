"""Evaluation texts leaking into training text (problem 8).

Latent semantic retrieval. Texts are cut into words once; their 32-bit hashes are kept as a table, and all later steps read that. Words are hashed to `FEATURES` columns,
and passages of `PASSAGE` words, each half overlapping the next, are weighted by TF-IDF over all passages. A distributed randomised SVD (each task multiplies its
passages into a sketch, the sketches are added, the driver orthonormalises one matrix of fixed size) gives a basis; passages are
compared in it with the passages of the items by cosine, and a document with a passage of at least `NEAR` that has some of the item's pairs of neighbours is a candidate for the item. The items are a stated
query set against all passages, in blocks of `ITEMS`. A candidate is then checked as a whole: words common to both are kept where they lie in dense runs
(at most two of ten neighbours altered), the longest common subsequence over them is taken, and the item's share that it holds decides.
The answer check looks for paraphrases: candidates that don't hold the item in its order, but most of its words in any order and the words of its end, where the answer stands, in order (`paraphrased`).

What is exchanged has a size that FEATURES and RANK fix. More than ITEMS items are searched block by block over the same table of words.

Defined cases. Null and blank texts and items hold no words. Null ids give no row. Repeated rows give one pair. Markup, case, punctuation,
line breaks, end-of-line hyphens and accents in composed or decomposed form don't matter. Items of fewer than ten words must be
held in one run. Whole texts are read, however long. Empty tables give no rows. Equal items under other ids are each reported.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import stored

FEATURES, RANK, OVERSAMPLE = 2048, 200, 16
PASSAGE, STEP = 60, 30
#: Least latent cosine of a passage and a passage of an item for the check.
NEAR = 0.45
#: Words of a run's window, and how many of them must agree.
RUN, AGREE = 10, 8
#: Share of an item's pairs of neighbours without which a document can't hold HELD of its words: eight of ten words in a run leave five of nine pairs whole.
PAIRS = 0.22
#: Share of the item's words that a leak holds; a half, less the words lost at the ends of runs.
HELD = 0.48
#: Words of an item's end that hold its answer; share of them, and of all its words in any order, that a paraphrase has.
ANSWER, ANSWERED, BAG = 12, 0.9, 0.6
#: Items that are searched at a time, and sent to the tasks.
ITEMS = 20_000
BLOCKS, ROWS = 16, 256

_MARKUP = re.compile(r"<[^<>]{0,2000}>")
_HYPHEN = re.compile(r"(\w)[-­]\s*\n[\s>*#|]*(\w)")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    t = unicodedata.normalize("NFKC", html.unescape(_MARKUP.sub(" ", text)))
    return _WORD.findall(_HYPHEN.sub(r"\1\2", t).lower())


def hashes(words: list[str], known: dict[str, int]) -> list[int]:
    return [known[w] if w in known else known.setdefault(w, zlib.crc32(w.encode())) for w in words]


def word_table(texts: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, words): the hashes of the words of each text that has any; written once, as later steps read it several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            if len(known) > 1_000_000:
                known.clear()
            rows = [hashes(words_of(t), known) for t in b.column("text").to_pylist()]
            flat = np.fromiter((h for r in rows for h in r), np.uint32).view(np.int32)
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.LargeListArray.from_arrays(ends, pa.array(flat)).cast(pa.list_(pa.int32()))], names=["id", "words"])

    kind = texts.schema[id_].dataType.simpleString()
    rows = texts.select(F.col(id_).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.trim("text") != ""))
    return stored(rows.mapInArrow(run, f"id {kind}, words array<int>").where(F.size("words") > 0))


class Passages:
    """The words of a batch of texts in blocks of STEP words; a passage is a block and the next one of the same text."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        starts = np.cumsum(sizes) - sizes
        blocks = -(-sizes // STEP)
        self.owner = np.repeat(np.arange(len(sizes)), blocks)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        within = np.arange(len(flat)) - np.repeat(starts, sizes)
        self.block = np.repeat(np.cumsum(blocks) - blocks, sizes) + within // STEP
        #: a last block that isn't the only one lies within the passage before
        self.own = (self.place == 0) | (self.place < np.repeat(blocks, blocks) - 1)
        self.feature = (flat.view(np.uint32) % FEATURES).astype(np.int64)

    def counts(self, s: int, e: int) -> np.ndarray:
        """Uses of each feature by the passages s to e - 1."""
        last = min(e, len(self.owner) - 1)
        lo, hi = np.searchsorted(self.block, [s, last + 1])
        a = np.zeros((last + 1 - s) * FEATURES, np.float32)
        np.add.at(a, (self.block[lo:hi] - s) * FEATURES + self.feature[lo:hi], np.float32(1))
        a = a.reshape(-1, FEATURES)
        out, more = a[: e - s].copy(), a[1:]
        out[: len(more)] += more * (self.owner[s + 1 : last + 1] == self.owner[s:last])[:, None]
        return out


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, words of all rows, words of each row)."""
    for b in batches:
        if b.num_rows:
            w = b.column("words")
            yield b.column("id"), w.flatten().to_numpy(zero_copy_only=False), w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    counts *= idf
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    return counts


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES, np.int64), 0
    for _, flat, sizes in batches_of(batches):
        p = Passages(flat, sizes)
        for s in range(0, len(p.owner), ROWS):
            df += (p.counts(s, min(s + ROWS, len(p.owner))) > 0).sum(0)
        n += len(p.owner)
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([np.r_[df, n].tobytes()], pa.binary())], names=["block", "part"])


def _sum_of(parts: DataFrame, kind: type) -> DataFrame:
    """(block, part): the sums of the arrays of each block; tasks have added their own before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("block").to_pylist(), b.column("part").to_pylist()):
                x = np.frombuffer(part, kind)
                sums[k] = sums[k] + x if k in sums else x.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "part"])

    return parts.repartition(BLOCKS, "block").mapInArrow(run, "block long, part binary")


def fit(words: DataFrame, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(idf, basis of FEATURES x RANK) from all passages of all documents."""
    sc = words.sparkSession.sparkContext
    got = _sum_of(words.mapInArrow(_frequencies, "block long, part binary"), np.int64).collect()
    counted = np.frombuffer(got[0]["part"], np.int64) if got else np.zeros(FEATURES + 1, np.int64)
    df, total = counted[:-1], int(counted[-1])
    idf = np.log1p(total / (df + 0.5)).astype(np.float32)
    if not total:
        return np.ones(FEATURES, np.float32), np.eye(FEATURES, RANK, dtype=np.float32)
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, RANK + OVERSAMPLE)).astype(np.float32))[0].astype(np.float32)
    sent = sc.broadcast((idf, omega))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, omega = sent.value
        y = np.zeros((FEATURES, omega.shape[1]), np.float64)
        for _, flat, sizes in batches_of(batches):
            p = Passages(flat, sizes)
            for s in range(0, len(p.owner), ROWS):
                e = min(s + ROWS, len(p.owner))
                a = weighted(p.counts(s, e)[p.place[s:e] % 2 == 0], idf)  # each word once
                y += a.T @ (a @ omega)
        size = FEATURES // BLOCKS
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS)), pa.array([y[k * size : (k + 1) * size].tobytes() for k in range(BLOCKS)], pa.binary())], names=["block", "part"])

    y, size = np.zeros((FEATURES, RANK + OVERSAMPLE)), FEATURES // BLOCKS
    for r in _sum_of(words.mapInArrow(sketch, "block long, part binary"), np.float64).collect():
        y[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["part"]).reshape(size, -1)
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    kept = s > s.max(initial=0) * 1e-9
    return idf, u[:, kept][:, :RANK].astype(np.float32)


def held_share(doc: np.ndarray, item: np.ndarray) -> float:
    """Share of the item's words that lie, in the item's order, in dense common runs: a longest common subsequence over those runs."""
    m = len(item)
    if not m or not len(doc):
        return 0.0
    order = np.argsort(item, kind="stable")
    lo, hi = np.searchsorted(item[order], doc, "left"), np.searchsorted(item[order], doc, "right")
    n = hi - lo
    p = np.repeat(np.arange(len(doc)), n)
    if not len(p):
        return 0.0
    q = order[np.repeat(lo, n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)]
    wide = np.int64(m + RUN + 1)
    key = (p - q + m) * wide + q
    by = np.argsort(key, kind="stable")
    key, p, q = key[by], p[by], q[by]
    run = min(RUN, m)
    need = min(AGREE, -(-m * AGREE // RUN))
    end = np.searchsorted(key, key + run)
    good = end - np.arange(len(key)) >= need
    if not good.any():
        return 0.0
    mark = np.zeros(len(key) + 1, np.int64)
    np.add.at(mark, np.flatnonzero(good), 1)
    np.add.at(mark, end[good], -1)
    keep = np.cumsum(mark[:-1]) > 0
    d, p, q = (p - q)[keep], p[keep], q[keep]
    # longest chain that rises in both: patience over p, within a p from the last q
    by = np.lexsort((-q, p))
    tails, at, back = [], [], np.full(len(by), -1)
    for r, c in enumerate(by):
        k = bisect_left(tails, q[c])
        if k == len(tails):
            tails.append(q[c])
            at.append(r)
        else:
            tails[k], at[k] = q[c], r
        back[r] = at[k - 1] if k else -1
    r, chain = at[-1], []
    while r >= 0:
        chain.append(by[r])
        r = back[r]
    chain.reverse()
    qs, ds = q[chain], d[chain]
    gaps = np.diff(qs) - 1
    filled = gaps[(gaps <= 2) & (np.abs(np.diff(ds)) <= 1)].sum()  # altered words inside of runs
    return (len(qs) + filled) / m


def item_blocks(items: DataFrame) -> list[list[tuple]]:
    """The items (id, words) in blocks of at most ITEMS, each collected on its own as the search comes to it."""
    listed = word_table(items.select("item_id", "item_text").distinct(), "item_id", "item_text")
    n = -(-max(1, listed.count()) // ITEMS)
    return [listed.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k) for k in range(n)]


def _search(words: DataFrame, listed: DataFrame, idf: np.ndarray, basis: np.ndarray, kind: str, item_kind: str, answers: bool) -> DataFrame:
    rows = sorted(((r["id"], np.array(r["words"], np.int32)) for r in listed.collect()), key=lambda r: (r[0], r[1].tobytes()))
    sent = words.sparkSession.sparkContext.broadcast((idf, basis, rows))
    types = words.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis, rows = sent.value
        if not rows:
            return

        def latent(counts: np.ndarray) -> np.ndarray:
            v = weighted(counts, idf) @ basis
            return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

        def passages(p: Passages) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """(text number, latent vector) of the passages, in parts."""
            for s in range(0, len(p.owner), ROWS):
                e = min(s + ROWS, len(p.owner))
                own = p.own[s:e]
                yield p.owner[s:e][own], latent(p.counts(s, e)[own])

        owner, target = (np.concatenate(x) for x in zip(*passages(Passages(np.concatenate([w for _, w in rows]), np.array([len(w) for _, w in rows])))))
        pairs_of = lambda w: set((w[:-1] * 1_000_003 ^ w[1:]).tolist())
        texts = [w.astype(np.int64) for _, w in rows]
        words_in, pairs_in = [set(t.tolist()) for t in texts], [pairs_of(t) for t in texts]
        for ids, flat, sizes in batches_of(batches):
            seen, best = [], []
            for d, v in passages(Passages(flat, sizes)):
                cosine = v @ target.T
                r, c = np.nonzero(cosine >= NEAR)
                seen.append(d[r] * len(rows) + owner[c])
                best.append(cosine[r, c])
            found, at = np.unique(np.concatenate(seen), return_inverse=True)
            top = np.zeros(len(found), np.float32)
            np.maximum.at(top, at, np.concatenate(best))
            ends, out, last = np.cumsum(sizes), [], -1
            for pair, cosine in zip(found.tolist(), top.tolist()):
                d, k = divmod(pair, len(rows))
                if d != last:
                    last, doc = d, flat[ends[d] - sizes[d] : ends[d]].astype(np.int64)
                    words, pairs = set(doc.tolist()), pairs_of(doc)
                ordered = len(pairs & pairs_in[k]) >= PAIRS * len(pairs_in[k])
                bag = len(words & words_in[k]) / len(words_in[k]) if answers else 0.0
                if ordered or bag >= BAG:
                    out.append((d, k, cosine, held_share(doc, texts[k]) if ordered else 0.0, held_share(doc, texts[k][-ANSWER:]) if bag >= BAG else 0.0, bag))
            if out:
                d, k, *figures = zip(*out)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array([rows[i][0] for i in k]), *[pa.array(f, pa.float64()) for f in figures]], names=["doc_id", "item_id", "cosine", "held", "answer", "bag"])

    return words.mapInArrow(search, f"doc_id {kind}, item_id {item_kind}, cosine double, held double, answer double, bag double")


def candidates(docs: DataFrame, items: DataFrame, answers: bool = False) -> DataFrame:
    """(doc_id, item_id, cosine, held, answer, bag): documents near an item, the share of its words held in order, of its end's words in order, of its words in any order (these two only with `answers`)."""
    words = word_table(docs, "doc_id", "text")
    idf, basis = fit(words)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    found = reduce(DataFrame.unionAll, [_search(words, block, idf, basis, kind, item_kind, answers) for block in item_blocks(items)])
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "held", "answer", "bag")])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, held): the documents that hold an item for a good part, and the share of its words held."""
    return candidates(docs, items).where(F.col("held") >= HELD).select("doc_id", "item_id", "held")


def paraphrased(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine): the documents that hold an item's answer and most of its words, but not in its order."""
    c = candidates(docs, items, answers=True)
    return c.where((F.col("held") < HELD) & (F.col("answer") >= ANSWERED) & (F.col("bag") >= BAG)).select("doc_id", "item_id", "cosine")


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_documents) of the items that leaked."""
    n = found.groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.groupBy("item_id").agg(F.max("suite").alias("suite")).join(n, "item_id").select("item_id", "suite", "n_documents")
