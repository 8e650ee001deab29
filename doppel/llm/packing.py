"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` ids; only longer documents are cut,
and the first piece takes what is left over. A full piece is a sequence of its own.
The other pieces are dealt at random into shards of about ``shard_pieces``, and each
shard is packed alone, so nothing grows with the corpus but the number of shards.

Within a shard pieces of one length are interchangeable, so an individual is a list
of bins of lengths over the shard's histogram. Crossover injects the well-filled
bins of one parent into the other, drops the bins that would use a piece twice and
best-fits the displaced lengths; mutation takes apart the emptiest bins and some
others. A shard has ``islands`` populations, tasks of their own; after each epoch
their elites migrate to the next island through a written table. The best packing
of all islands is then matched with the pieces by (shard, length, rank).

Defined cases: a null text counts as empty and has the end id alone. Repeated rows
are packed one by one. Ids may be null. Columns other than id and text are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doppel.llm.common import Scratch, map_exact
from doppel.llm.tokens import ID, MAX_ENTRIES, library_ids, vocabulary

CAPACITY = 1024
WORK = 100_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 2, vocab: str | None = None,
           id_col: str = "doc_id", text_col: str = "text", memo_entries: int = MAX_ENTRIES) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of every document. ``memo_entries`` bounds the memory of a worker."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    end = np.array([end_id], ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = library_ids(vocab or vocabulary(), memo_entries)
        for batch in batches:
            at = 0
            for ids, ends in memo.runs(batch["text"]):
                n = len(ends)
                sizes = np.diff(ends, prepend=0) + 1
                stops = np.cumsum(sizes)
                whole = np.empty(int(stops[-1]), ID)
                body = np.ones(len(whole), bool)
                body[stops - 1] = False
                whole[body], whole[~body] = ids, end
                # the first piece is the shorter one
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(n), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = (sizes - 1) % capacity + 1
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                begin = (stops - sizes)[doc] + start
                raw = memoryview(whole).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist())]
                yield pa.record_batch({"id": batch["id"].slice(at, n).take(pa.array(doc)), "piece": piece.astype(np.int32), "start": start,
                                       "length": length, "ids_crc32": pa.array(crc, pa.int64())})
                at += n

    return src.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


Bins = list[list[int]]


def best_fit(lengths: list[int], bins: Bins, capacity: int, rng: random.Random | None = None) -> Bins:
    """Put the lengths, longest first or at random, each into the bin where the least room stays."""
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, b in enumerate(bins):
        at[capacity - sum(b)].append(i)
    rooms = sum(1 << room for room, of in enumerate(at) if of)
    lengths = rng.sample(lengths, len(lengths)) if rng else sorted(lengths, reverse=True)
    for x in lengths:
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            i = at[room].pop()
            if not at[room]:
                rooms ^= 1 << room
            bins[i].append(x)
        else:
            room, i = capacity, len(bins)
            bins.append([x])
        if not at[room - x]:
            rooms |= 1 << (room - x)
        at[room - x].append(i)
    return bins


def _fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more uneven filling, which leaves room in one place."""
    return len(bins), -sum((sum(b) / capacity) ** 2 for b in bins)


def crossover(a: Bins, b: Bins, counts: dict[int, int], capacity: int, rng: random.Random) -> Bins:
    """Bins of ``b`` filled at least to a random high level, then what of ``a`` is left, then best fit."""
    level = capacity * (1 - 0.05 * rng.random())
    left = dict(counts)
    child: Bins = []
    for chosen in ([x for x in b if sum(x) >= level and rng.random() < 0.7], a):
        for x in chosen:
            need: dict[int, int] = {}
            for v in x:
                need[v] = need.get(v, 0) + 1
            if all(left[v] >= n for v, n in need.items()):
                for v, n in need.items():
                    left[v] -= n
                child.append(list(x))
    child, free = replace(child, [v for v, n in left.items() for _ in range(n)], capacity)
    return best_fit(free, child, capacity)


def replace(bins: Bins, free: list[int], capacity: int) -> tuple[Bins, list[int]]:
    """Fill bins up by exchange: one or two of a bin's lengths for a free one that is longer and still fits.

    What comes free is shorter than what went in, so the rest is easier to place.
    """
    count: dict[int, int] = {}
    for v in free:
        count[v] = count.get(v, 0) + 1
    there = sum(1 << v for v in count)
    out: Bins = []
    for b in bins:
        room, b = capacity - sum(b), list(b)
        while room and there:
            # largest free length above a part of the bin, within the room; the best of single and paired lengths
            best = 0, 0, ()
            parts = [(v, (v,)) for v in set(b)]
            if len(b) <= 12:
                parts += [(x + y, (x, y)) for i, x in enumerate(b) for y in b[i + 1:]]
            for total, taken in parts:
                fits = (there & ((2 << (total + room)) - 1)) >> (total + 1)
                if fits:
                    best = max(best, (fits.bit_length(), total + fits.bit_length(), taken))
            if not best[0]:
                break
            gain, v, taken = best
            for x in taken:
                b.remove(x)
                count[x] = count.get(x, 0) + 1
                there |= 1 << x
            b.append(v)
            count[v] -= 1
            if not count[v]:
                there ^= 1 << v
            room -= gain
        out.append(b)
    return out, [v for v, n in count.items() for _ in range(n)]


def mutate(bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """Take apart the emptiest bins and a few others, and best-fit their lengths, now and then at random."""
    order = sorted(range(len(bins)), key=lambda i: sum(bins[i]))
    n = max(2, len(bins) // 100)
    gone = set(order[:n]) | set(rng.sample(range(len(bins)), min(n, len(bins))))
    kept, free = replace([b for i, b in enumerate(bins) if i not in gone], [v for i in gone for v in bins[i]], capacity)
    return best_fit(free, kept, capacity, rng if rng.random() < 0.2 else None)


def evolve(counts: dict[int, int], elites: list[Bins], capacity: int, rng: random.Random, population: int = 5,
           generations: int | None = None, work: int = WORK) -> list[Bins]:
    """The better individuals after some generations; stops at the lower bound.

    By default the number of generations follows from the work: about ``work`` lengths are placed.
    """
    lengths = [v for v, n in counts.items() for _ in range(n)]
    generations = generations or max(4, work // max(1, len(lengths)))
    bound = -(-sum(lengths) // capacity)
    people = [e for e in elites] or [best_fit(lengths, [], capacity)]
    while len(people) < population:
        people.append(mutate(people[0], capacity, rng))
    rank = lambda b: _fitness(b, capacity)
    people.sort(key=rank)
    for _ in range(generations):
        if len(people[0]) <= bound:
            break
        a, b = rng.sample(people[:4], 2)
        children = [crossover(a, b, counts, capacity, rng), mutate(people[0], capacity, rng)]
        people = sorted(people + children, key=rank)[:population]
    return people


def _to_bytes(bins: Bins) -> bytes:
    """Bins as 16-bit lengths, each bin ended by 0."""
    return np.array([v for b in bins for v in (*b, 0)], "<u2").tobytes()


def _from_bytes(data: bytes) -> Bins:
    out: Bins = [[]]
    for v in np.frombuffer(data, "<u2").tolist():
        if v:
            out[-1].append(v)
        else:
            out.append([])
    return out[:-1]


def _epoch(tasks: DataFrame, parts: int, capacity: int, epoch: int) -> DataFrame:
    """``shard, island, lengths, counts, elites`` to the same with new elites."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for shard, island, lengths, counts, elites in zip(pdf["shard"], pdf["island"], pdf["lengths"], pdf["counts"],
                                                              pdf["elites"]):
                rng = random.Random(f"{shard}/{island}/{epoch}")
                people = evolve(dict(zip(lengths.tolist(), counts.tolist())), [_from_bytes(e) for e in elites], capacity, rng)
                made.append([_to_bytes(p) for p in people[:2]])
            yield pdf.assign(elites=made)

    return tasks.repartition(parts, "shard", "island").mapInPandas(
        run, "shard long, island int, lengths array<int>, counts array<int>, elites array<binary>")


def _migrate(tasks: DataFrame, islands: int) -> DataFrame:
    """Each island keeps its best and takes the elites of the island before it."""
    moved = tasks.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"),
                         F.col("elites").alias("guests"))
    return tasks.join(moved, ["shard", "island"]).select(
        "shard", "island", "lengths", "counts", F.concat(F.slice("elites", 1, 1), "guests").alias("elites"))


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 2, vocab: str | None = None, id_col: str = "doc_id",
         text_col: str = "text", shard_pieces: int = 16_000, islands: int = 2, epochs: int = 2,
         memo_entries: int = MAX_ENTRIES) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.write(pieces(docs, capacity, end_id, vocab, id_col, text_col, memo_entries).withColumn(
        "row", F.monotonically_increasing_id()), "pieces")
    open_ = F.col("length") < capacity
    shards = max(1, -(-cut.where(open_).count() // shard_pieces))
    placed = cut.where(open_).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    histogram = placed.groupBy("shard", "length").agg(F.count(F.lit(1)).cast("int").alias("n"))
    # at most ``capacity`` lengths a shard
    tasks = histogram.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("length"), "n"))).alias("h"))
    tasks = tasks.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                         F.col("h.length").alias("lengths"), F.col("h.n").alias("counts"),
                         F.array().cast("array<binary>").alias("elites"))
    parts = min(shards * islands, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    for epoch in range(epochs):
        tasks = scratch.write(_epoch(tasks if epoch == 0 else _migrate(tasks, islands), parts, capacity, epoch), f"epoch-{epoch}")
    # one packing of each island, then the best of them
    best = tasks.groupBy("shard").agg(F.collect_list(F.col("elites")[0]).alias("all"))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, all_ in zip(pdf["shard"], pdf["all"]):
                bins = min((_from_bytes(e) for e in all_), key=lambda b: _fitness(b, capacity))
                seen: dict[int, int] = {}
                rows = []
                for i, b in enumerate(bins):
                    at = 0
                    for v in b:
                        seen[v] = seen.get(v, 0) + 1
                        rows.append((shard, v, seen[v], i, at))
                        at += v
                yield pd.DataFrame(rows, columns=["shard", "length", "rank", "bin", "offset"])

    slots = best.select("shard", "all").mapInPandas(explode, "shard long, length long, rank int, bin long, offset long")
    # a shard holds a bounded number of pieces, so its ranks do too
    rank = F.row_number().over(Window.partitionBy("shard", "length").orderBy("row"))
    packed = placed.withColumn("rank", rank).join(slots, ["shard", "length", "rank"])
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    shared = packed.select(*columns, (2 * (F.col("bin") * shards + F.col("shard"))).alias("sequence_id"), "offset")
    full = cut.where(~open_).select(*columns, (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(full).withColumnRenamed("id", id_col)
