"""Hard-negative mining by inner product, with segment summary filtering.

A vector is cut into segments; for each the mean and the deviation are stored. With
``L`` components in a segment, two vectors' products there sum to ``L`` times the means'
product, plus or minus at most ``L`` times the deviations' product. Summed over the
segments this bounds the score from both sides. The bounds are refined level by level,
``SEGMENTS`` coarse to fine, each on what the level before left; only what no bound
rules out is scored exactly.

Rows are dealt into chunks of about ``CHUNK_ROWS`` by a hash. Every chunk meets all
anchors, a block of them at a time, and sends for each anchor the few rows of its own
that can be among the first; those are merged per anchor. The first pass finds the
positives, the second the negatives, whose windows the positives' scores give. Rows
that the running k-th best score (or a window) excludes are never scored. Nothing is
approximate, nothing is broadcast.

Components become ``floor(scale * x)``; scores are integers. ``anchor``'s positives are
its first ``positives`` other rows of the same label; a positive's negatives are the
first ``negatives`` rows of other labels with
``low * positive_score <= 100 * negative_score <= 100 * positive_score``. Higher scores come first, ties
by smaller id.

Defined cases: rows with a null id, a null label, a null vector or a null or non-finite
component take no part, nor do vectors whose squared length after scaling reaches 2**56, so
that all scores are exact. Vectors are compared with those of equal length only; empty
ones score 0. A row that repeats in id, label and vector counts once. Rows with one id and other
contents are rows of their own; each is an anchor if its id is one. Positives with a
negative score have no negatives. An anchor without positives, and a positive without
negatives, gives no row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import Scratch

SEGMENTS = (4, 16)
CHUNK_ROWS = 1 << 17
BLOCK_ROWS, BLOCK_ANCHORS = 2048, 256
# a share of pairs left below this is scored pair by pair
SPARSE = 0.05
FOUND = pa.list_(pa.struct([("neg", pa.int64()), ("id", pa.int64())]))


def scaled(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with their integer vectors as 32-bit little-endian numbers."""
    for b in batches:
        vectors = b["vec"].combine_chunks() if isinstance(b["vec"], pa.ChunkedArray) else b["vec"]
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        # a null component becomes NaN here
        x = np.floor(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
        row = np.repeat(np.arange(len(sizes)), sizes)
        with np.errstate(over="ignore", invalid="ignore"):
            good = np.bincount(row, x * x, len(sizes)) < 2.0**56  # false for NaN and infinity
        data = np.where(good[row], x, 0).astype("<i4").tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
        vec = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        yield pa.record_batch({"id": b["id"], "label": b["label"], "vec": vec}).filter(pa.array(good))


class Summaries:
    """Vectors of one length with their segments' means and deviations at every level."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)
        self.length = np.sqrt((self.x ** 2).sum(1))
        if len(x) and self.length.max() ** 2 >= 2.0**53:
            self.x = x.astype(np.int64)  # slower, but exact beyond what a double holds
        self.levels = []
        for n in SEGMENTS:
            cuts = np.unique(np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int))
            if len(cuts) > 1:
                sizes = np.diff(cuts).astype(float)
                sums = np.add.reduceat(x.astype(np.float64), cuts[:-1], 1)
                squares = np.add.reduceat(x.astype(np.float64) ** 2, cuts[:-1], 1)
                # times the root of the segment's length, so that products need no factor
                self.levels.append((sums / np.sqrt(sizes), np.sqrt(np.maximum(squares - sums ** 2 / sizes, 0))))

    def rows(self, at) -> Summaries:
        out = object.__new__(Summaries)
        out.x, out.length, out.levels = self.x[at], self.length[at], [(m[at], d[at]) for m, d in self.levels]
        return out


def scores(a: Summaries, b: Summaries, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ``b`` and exact scores to ``a`` of all that can lie in ``least..most`` of a row of ``a``.

    Pairs outside have the score of the smallest integer; they are mostly not computed.
    """
    cols = np.arange(len(b.x))
    for level in range(len(a.levels)):
        (ma, da), (mb, db) = a.levels[level], b.levels[level]
        mean, dev = ma @ mb[cols].T, da @ db[cols].T
        # rounding of the bounds, far below one
        dev += 1e-9 * np.outer(a.length, b.length[cols]) + 1e-6
        alive = (mean + dev >= least[:, None]) & (mean - dev <= most[:, None])
        some = alive.any(0)
        cols, alive = cols[some], alive[:, some]
    out = np.full((len(a.x), len(cols)), np.iinfo(np.int64).min)
    if not a.levels:
        out[:] = 0
    elif alive.sum() < SPARSE * alive.size:
        i, j = np.nonzero(alive)
        out[i, j] = np.einsum("ij,ij->i", a.x[i], b.x[cols[j]])
    else:
        kind = np.int64 if np.int64 in (a.x.dtype, b.x.dtype) else np.float64
        exact = (a.x.astype(kind) @ b.x[cols].astype(kind).T).astype(np.int64)
        out[alive] = exact[alive]
    return cols, out


class Best:
    """The ``k`` best (score, id) for each anchor, from blocks of scores."""

    def __init__(self, anchors: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.who, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n = anchors

    def add(self, score: np.ndarray, ids: np.ndarray, most: np.ndarray) -> None:
        keep = (score >= self.floor[:, None]) & (score <= most[:, None])
        if score.shape[1] > self.k:
            held = np.where(keep, score, np.iinfo(np.int64).min)
            keep &= score >= np.partition(held, -self.k, axis=1)[:, -self.k][:, None]
        i, j = np.nonzero(keep)
        if not len(i):
            return
        who, value, ident = np.concatenate([self.who, i]), np.concatenate([self.score, score[i, j]]), np.concatenate([self.id, ids[j]])
        order = np.lexsort((ident, -value, who))
        who, value, ident = who[order], value[order], ident[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        first = place < self.k
        self.who, self.score, self.id = who[first], value[first], ident[first]
        full = place == self.k - 1
        self.floor = self.floor.copy()
        self.floor[who[full]] = np.maximum(self.floor[who[full]], value[full])


class Chunk:
    """The rows of a chunk, each once, by vector length and label."""

    def __init__(self, t: pa.Table):
        self.of: dict[int, tuple[np.ndarray, np.ndarray, Summaries]] = {}
        vecs = t["vec"].to_pylist()
        ids, labels, sizes = t["id"].to_numpy(), t["label"].to_numpy(), np.array([len(v) // 4 for v in vecs])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            at = at[np.lexsort((ids[at], labels[at]))]
            self.of[int(size)] = ids[at], labels[at], Summaries(matrix([vecs[i] for i in at], int(size)))


def matrix(vecs: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), size)


LOWEST = np.iinfo(np.int64).min + 1


def nearest_alike(chunk: Chunk, size: int, label: int, ids: np.ndarray, a: Summaries, k: int) -> Best:
    """The best other rows of the same label."""
    n = len(ids)
    best, most = Best(n, k, np.full(n, LOWEST)), np.full(n, np.iinfo(np.int64).max)
    row_ids, labels, rows = chunk.of[size]
    lo, hi = np.searchsorted(labels, [label, label + 1])
    for at in range(lo, hi, BLOCK_ROWS):
        end = min(at + BLOCK_ROWS, hi)
        cols, score = scores(a, rows.rows(slice(at, end)), best.floor, most)
        block_ids, cols = row_ids[at:end][cols], cols + at
        for i, j in zip(*np.nonzero(ids[:, None] == block_ids[None, :])):
            if (a.x[i] == rows.x[cols[j]]).all():  # the anchor itself
                score[i, j] = LOWEST - 1
        best.add(score, block_ids, most)
    return best


def in_windows(chunk: Chunk, size: int, label: int, positive: np.ndarray, a: Summaries, k: int, low: int) -> list[Best]:
    """For each of the positives' scores the best rows of other labels between ``low`` percent of it and it.

    ``positive``: anchors x positives, LOWEST where an anchor has fewer.
    """
    least = np.where(positive < 0, np.iinfo(np.int64).max, -((-low * np.maximum(positive, 0)) // 100))
    best = [Best(len(positive), k, least[:, j]) for j in range(positive.shape[1])]
    row_ids, labels, rows = chunk.of[size]
    others = np.flatnonzero(labels != label)
    top = positive.max(1)
    for at in range(0, len(others), BLOCK_ROWS):
        some = others[at:at + BLOCK_ROWS]
        cols, score = scores(a, rows.rows(some), np.min([b.floor for b in best], axis=0), top)
        for j, b in enumerate(best):
            b.add(score, row_ids[some][cols], positive[:, j])
    return best


def _found(no: np.ndarray, who: np.ndarray, score: np.ndarray, ident: np.ndarray) -> pa.RecordBatch:
    """One row for each anchor that has any; ``who`` ascends."""
    has, starts = np.unique(who, return_index=True)
    offsets = pa.array(np.append(starts, len(who)).astype(np.int32))
    pairs = pa.StructArray.from_arrays([pa.array(-score), pa.array(ident)], fields=list(FOUND.value_type))
    return pa.record_batch({"no": no[has], "found": pa.ListArray.from_arrays(offsets, pairs).cast(FOUND)})


def _meet(rows: DataFrame, anchors: DataFrame, chunks: int, search: Callable) -> DataFrame:
    """``search`` for every chunk and block of anchors of one label and length: ``no, found``."""
    every = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    both = rows.withColumn("kind", F.lit(0)).unionByName(every.withColumn("kind", F.lit(1)), True)
    dealt = both.repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind", "label", F.octet_length("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, chunk = None, [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            place = b["chunk"].to_numpy() * 2 + b["kind"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else []
            for lo, hi in zip(starts, [*starts[1:], len(place)]):
                part, (number, kind) = t.slice(lo, hi - lo), divmod(int(place[lo]), 2)
                if number != at:
                    at, held, chunk = number, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if held:
                    chunk, held = Chunk(pa.concat_tables(held)), []
                if chunk is not None:
                    yield from blocks(chunk, part)

    def blocks(chunk: Chunk, part: pa.Table) -> Iterator[pa.RecordBatch]:
        no, ids, labels = (part[c].to_numpy() for c in ("no", "id", "label"))
        vecs, scored = part["vec"].to_pylist(), part["scores"].to_pylist()
        kinds = np.array([len(v) // 4 for v in vecs]), labels
        change = np.flatnonzero((np.diff(kinds[0]) != 0) | (np.diff(kinds[1]) != 0)) + 1
        for lo, hi in zip([0, *change], [*change, len(ids)]):
            size, label = int(kinds[0][lo]), int(labels[lo])
            for at in range(lo, hi, BLOCK_ANCHORS) if size in chunk.of else ():
                end = min(at + BLOCK_ANCHORS, hi)
                a = Summaries(matrix(vecs[at:end], size))
                for_each = search(chunk, size, label, ids[at:end], a, scored[at:end])
                if len(for_each[0]):
                    yield _found(no[at:end], *for_each)

    return dealt.select("chunk", "kind", "no", "id", "label", "vec", "scores").mapInArrow(
        run, "no long, found array<struct<neg:bigint,id:bigint>>")


def hard_negatives(rows: DataFrame, is_anchor: Callable[[Column], Column], label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``is_anchor`` takes the id column."""
    scratch = Scratch(rows.sparkSession, "hard-negatives")
    usable = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("vec")).dropna()
    chunks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // chunk_rows))
    numbers = usable.mapInArrow(lambda b: scaled(b, scale), "id long, label long, vec binary").dropDuplicates()
    held = scratch.write(numbers.withColumn("chunk", F.pmod(F.xxhash64("id", "label", "vec"), F.lit(chunks)).cast("int")), "rows")
    held = held.select("chunk", F.lit(None).cast("long").alias("no"), "id", "label", "vec", F.lit(None).cast("array<long>").alias("scores"))
    anchors = scratch.write(held.where(is_anchor(F.col("id"))).select(
        F.monotonically_increasing_id().alias("no"), "id", "label", "vec", "scores"), "anchors")

    def alike(chunk, size, label, ids, a, _):
        best = nearest_alike(chunk, size, label, ids, a, positives)
        return best.who, best.score, best.id

    def windows(chunk, size, label, ids, a, scored):
        width = max(map(len, scored))
        positive = np.array([s + [LOWEST] * (width - len(s)) for s in scored])
        best = in_windows(chunk, size, label, positive, a, negatives, low)
        found = np.unique(np.concatenate([np.stack([b.who, -b.score, b.id], 1) for b in best]), axis=0)
        return found[:, 0], -found[:, 1], found[:, 2]

    first = _meet(held, anchors, chunks, alike).groupBy("no").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, positives).alias("pos"))
    having = scratch.write(anchors.drop("scores").join(first, "no").withColumn("scores", F.transform("pos", lambda p: -p["neg"])), "positives")
    near = _meet(held, having.drop("pos"), chunks, windows).groupBy("no").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))

    each = having.join(near, "no").select("no", F.col("id").alias("anchor_id"), "found", F.posexplode("pos").alias("nth", "p"))
    score = -F.col("p.neg")
    fit = F.filter("found", lambda x: (low * score <= 100 * -x["neg"]) & (-x["neg"] <= score))
    return each.select("anchor_id", F.col("p.id").alias("positive_id"), score.alias("positive_score"),
                       F.posexplode(F.slice(fit, 1, negatives)).alias("nth", "n")).select(
        "anchor_id", "positive_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        "positive_score", (-F.col("n.neg")).alias("negative_score"))
