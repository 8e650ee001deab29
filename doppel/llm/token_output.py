"""Token ids in a binary block format with an adaptive context-mixing range coder.

An id is predicted by three models of its block: order 2 (the id that followed
the same two ids last time), order 1 (the same after one id) and order 0 (adaptive
frequencies of the ids' high bytes). The first two put a point mass on their id,
in proportion to how often they were right in this block; the sum of the three is
the distribution by which the range coder narrows its interval, one step an id.

Blocks hold at most ``BLOCK`` ids, start from fresh models and carry the CRC-32 of
their ids, so any block can be decoded and checked alone. For speed, the blocks of
a batch are coded in lockstep: step ``t`` codes id ``t`` of every block by array
operations.

A file row is a *segment*: whole documents in ascending id order, about
``SEGMENT`` ids (one document of any length at least), with the document table,
its place (``part``, ``start`` in the part) and its blocks. Parts are ranges of
ids; ids of all documents before a part are a sum over the parts' totals.

Defined cases: a null text counts as empty and is written with the end id alone.
Rows with a null id come first. Repeated rows are written one after the other.
Columns other than id and text are not read. An empty table gives files without
segments and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doppel.llm.common import Scratch, map_exact
from doppel.llm.tokens import ID, library_ids, vocabulary

BLOCK = 2048
SEGMENT = 1 << 17
MAGIC = b"TIDS2"
U = np.uint64
BOT, HALF = U(1 << 32), U(32)
SLOT_BITS1, SLOT_BITS2 = 10, 11
SLOTS1, SLOTS2 = 1 << SLOT_BITS1, 1 << SLOT_BITS2
# masses of guesses are in ONEths, order-0 classes in PARTS, each of 256 units
ONE, PARTS, UNITS = np.uint32(1 << 16), 1 << 12, U(20)
# order 0: what an id adds to its class, and the steps at which the distribution is renewed
GAIN, REFRESH = 16, {0, 32, 128, 512, 1024, 1536}
MAX_ID = 1 << 16


class _Models:
    """The adaptive models of many blocks, coded in lockstep.

    The interval of a step is laid out as mass of the order-2 guess, mass of the
    order-1 guess, then the order-0 distribution (256 classes by high byte, even
    within a class). An id takes the first of the three that names it.
    """

    def __init__(self, n: int, search: bool = False):
        lanes = np.arange(n, dtype=np.uint32)
        self.search = search
        self.base0, self.base1, self.base2, self.parts = lanes << 8, lanes * SLOTS1, lanes * SLOTS2, lanes * PARTS
        self.counts = np.ones((n, 256), np.int32)
        self.after1, self.after2 = np.zeros(n * SLOTS1, np.uint16), np.zeros(n * SLOTS2, np.uint16)
        self.right1, self.right2 = np.full(n, ONE >> 3, np.uint32), np.full(n, ONE >> 3, np.uint32)
        self.last, self.before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.seen = 0

    def refresh(self, ids: np.ndarray) -> None:
        """Take the classes of the steps so far (rows of ``ids``) as the order-0 distribution of the next ones."""
        for at in range(self.seen, len(ids), 256):
            own = np.bincount((self.base0 + (ids[at:at + 256] >> 8)).ravel(), minlength=self.counts.size)
            self.counts += (GAIN * own).astype(np.int32).reshape(self.counts.shape)
        self.seen = len(ids)
        # every class has one of the parts, the others are dealt out by the counts
        ends = self.counts.cumsum(axis=1, dtype=np.int32)
        ends *= PARTS - 256
        ends //= ends[:, -1:] // (PARTS - 256)
        ends += np.arange(1, 257, dtype=np.int32)
        own = np.diff(ends, axis=1, prepend=np.int32(0))
        # first unit (20 bits) and width (12 bits) of a class
        self.classes = ((ends - own).astype(np.uint32) << 20 | own.astype(np.uint32)).ravel()
        if self.search:
            self.class_at = np.repeat(np.tile(np.arange(256, dtype=np.uint8), len(ends)), own.ravel())

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the first ``k`` blocks: mass of the order-2 guess, and of both guesses, in ``ONE``ths."""
        last = self.last[:k]
        self.slot1 = (self.base1[:k] + (last >> (32 - SLOT_BITS1))).astype(np.intp)
        self.slot2 = (self.base2[:k] + (last + self.before[:k] >> (32 - SLOT_BITS2))).astype(np.intp)
        self.guess1, self.guess2 = self.after1[self.slot1], self.after2[self.slot2]
        mass2 = self.right2[:k]
        mass1 = (ONE - mass2) * self.right1[:k] >> 16
        mass1 *= self.guess1 != self.guess2
        return mass2.astype(U), (mass2 + mass1).astype(U)

    def learn(self, k: int, ids: np.ndarray, is1: np.ndarray, is2: np.ndarray) -> None:
        for right, hit in ((self.right1[:k], is1), (self.right2[:k], is2)):
            # from 240 to 61215, so that no mass is nothing
            right -= right >> 4
            right += hit * np.uint32(3810) + np.uint32(15)
        self.after1[self.slot1] = ids
        self.after2[self.slot2] = ids
        np.multiply(self.last[:k], np.uint32(0x85EBCA6B), out=self.before[:k])
        np.multiply(ids, np.uint32(2654435761), out=self.last[:k], dtype=np.uint32)


def _longest_first(sizes: np.ndarray):
    """Order by falling size, and for each step how many blocks still run."""
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max(initial=0))
    return order, np.searchsorted(-sizes[order], -np.arange(steps), side="left")


def _split(width: np.ndarray, mass2: np.ndarray, masses: np.ndarray):
    """Widths for the order-2 guess and for both guesses, and of one order-0 unit."""
    one = width >> U(16)
    both = one * masses
    return one * mass2, both, (one << U(16)) - both >> UNITS


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Range-coded payloads of blocks of ids below ``MAX_ID``."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    order, running = _longest_first(sizes)
    n = len(blocks)
    if any(len(b) and int(b.max()) >= MAX_ID for b in blocks):
        raise ValueError(f"ids must be below {MAX_ID}")
    ids = np.zeros((len(running), n), np.uint16)
    for lane, b in enumerate(order):
        ids[:sizes[b], lane] = blocks[b]
    out = np.zeros((n, len(ids) // 2 + 8), np.uint32)
    at = np.zeros(n, np.int64)
    low, width = np.zeros(n, U), np.full(n, ~U(0), U)
    models = _Models(n)

    def carry(lanes):
        """Add one to the words given off."""
        place = at[lanes]
        while len(lanes):
            place = place - 1
            out[lanes, place] += np.uint32(1)
            over = out[lanes, place] == 0
            lanes, place = lanes[over], place[over]

    for t in range(len(ids)):
        if t in REFRESH:
            models.refresh(ids[:t])
        k = int(running[t])
        own_ids, lo, wi = ids[t, :k], low[:k], width[:k]
        mass2, masses = models.predict(k)
        two, both, unit = _split(wi, mass2, masses)
        is1, is2 = models.guess1 == own_ids, models.guess2 == own_ids
        of = models.classes[models.base0[:k] + (own_ids >> 8)]
        own = of & 4095
        start = both + unit * ((of >> 12) + own * (own_ids & 255))
        start = np.where(is2, U(0), np.where(is1, two, start))
        wi[:] = np.where(is2, two, np.where(is1, both - two, unit * own))
        models.learn(k, own_ids, is1, is2)
        lo += start
        over = np.flatnonzero(lo < start)
        if len(over):
            carry(over)
        go = np.flatnonzero(wi < BOT)
        if len(go):
            place = at[go]
            if t + 2 >= out.shape[1] and int(place.max()) + 2 >= out.shape[1]:
                out = np.pad(out, ((0, 0), (0, out.shape[1])))
            top = lo[go]
            out[go, place] = top >> HALF
            at[go] = place + 1
            lo[go] = top << HALF
            wi[go] <<= HALF
    # one word more names a value of the interval; the words that the reader lacks are zeros
    last = low + (BOT - U(1))
    carry(np.flatnonzero(last < low))
    payload: list[bytes] = [b""] * n
    for lane, b in enumerate(order):
        out[lane, at[lane]] = last[lane] >> HALF
        payload[b] = out[lane, :at[lane] + 1].astype(">u4").tobytes()
    return payload


def decode_blocks(payloads: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    order, running = _longest_first(sizes)
    n = len(payloads)
    words = max((len(p) // 4 for p in payloads), default=0) + 3
    code = np.zeros((n, words), np.uint32)
    for lane, b in enumerate(order):
        w = np.frombuffer(payloads[b], ">u4")
        code[lane, :len(w)] = w
    # how far the code's value lies above the interval's begin
    above = (code[:, 0].astype(U) << HALF) | code[:, 1]
    code = code.ravel()
    at = np.arange(n) * words + 2
    end = at + (words - 3)
    width = np.full(n, ~U(0), U)
    models = _Models(n, search=True)
    ids = np.zeros((len(running), n), np.uint16)
    for t in range(len(running)):
        if t in REFRESH:
            models.refresh(ids[:t])
        k = int(running[t])
        ab, wi, found = above[:k], width[:k], ids[t, :k]
        mass2, masses = models.predict(k)
        two, both, unit = _split(wi, mass2, masses)
        is2, guessed = ab < two, ab < both
        rest = ab - both
        value = np.minimum(rest // unit, U((PARTS << 8) - 1)).astype(np.uint32)
        hi = models.class_at[models.parts[:k] + (value >> 8)]
        of = models.classes[models.base0[:k] + hi]
        own, begin = of & 4095, of >> 12
        lo = (value - begin) // own
        found[:] = np.where(is2, models.guess2, np.where(guessed, models.guess1, (hi.astype(np.uint32) << 8) + lo))
        ab[:] = np.where(is2, ab, np.where(guessed, ab - two, rest - unit * (begin + own * lo)))
        wi[:] = np.where(is2, two, np.where(guessed, both - two, unit * own))
        models.learn(k, found, models.guess1 == found, models.guess2 == found)
        go = np.flatnonzero(wi < BOT)
        if len(go):
            place = at[go]
            ab[go] = (ab[go] << HALF) | code[place]
            at[go] = np.minimum(place + 1, end[go])
            wi[go] <<= HALF
    out: list[np.ndarray] = [np.zeros(0, ID)] * n
    for lane, b in enumerate(order):
        out[b] = ids[:sizes[b], lane].astype(ID)
    return out


def pack_segments(segments: list[np.ndarray]) -> list[bytes]:
    """Each segment's ids as ``MAGIC``, block count, block headers and payloads."""
    cut = [[s[i:i + BLOCK] for i in range(0, len(s), BLOCK)] for s in segments]
    coded = iter(encode_blocks([b for s in cut for b in s]))
    out = []
    for blocks in cut:
        payloads = [next(coded) for _ in blocks]
        heads = [struct.pack("<III", len(b), len(p), zlib.crc32(b.astype(ID).tobytes())) for b, p in zip(blocks, payloads)]
        out.append(b"".join([MAGIC, struct.pack("<I", len(blocks)), *heads, *payloads]))
    return out


def unpack_segments(data: list[bytes]) -> list[np.ndarray]:
    """The ids of segments; a block whose ids don't match its checksum is an error."""
    sizes, sums, payloads, per = [], [], [], []
    for d in data:
        if d[:5] != MAGIC:
            raise ValueError("not a segment of token ids")
        n = struct.unpack_from("<I", d, 5)[0]
        heads = [struct.unpack_from("<III", d, 9 + 12 * i) for i in range(n)]
        at = 9 + 12 * n
        for size, length, crc in heads:
            sizes.append(size)
            sums.append(crc)
            payloads.append(d[at:at + length])
            at += length
        per.append(n)
    blocks = decode_blocks(payloads, np.array(sizes, np.int64))
    for b, crc in zip(blocks, sums):
        if zlib.crc32(b.tobytes()) != crc:
            raise ValueError("a block of token ids is damaged")
    out, at = [], 0
    for n in per:
        out.append(np.concatenate([np.zeros(0, ID), *blocks[at:at + n]]))
        at += n
    return out


def write_ids(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = 0, id_col: str = "doc_id",
              text_col: str = "text", segment_ids: int = SEGMENT) -> None:
    """Encode every whole text, append ``end_id``, write segments in ascending id order."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
               .repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first()))
    end = np.array([end_id], ID).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, start = library_ids(vocab or vocabulary()), TaskContext.get().partitionId(), 0
        rows, segments, doc_ids, sizes, open_ids, n = [], [], [], [], [], 0

        def close():
            nonlocal doc_ids, sizes, open_ids, n, start
            rows.append((part, start, doc_ids, sizes))
            segments.append(np.frombuffer(b"".join(open_ids), ID))
            start += n
            doc_ids, sizes, open_ids, n = [], [], [], 0

        def flush():
            nonlocal rows, segments
            parts, starts, ids, counts = zip(*rows)
            made = pa.record_batch({"part": pa.array(parts, pa.int32()), "start": pa.array(starts, pa.int64()),
                                    "ids": pa.array(ids, pa.list_(pa.int64())), "sizes": pa.array(counts, pa.list_(pa.int32())),
                                    "data": pa.array(pack_segments(segments), pa.binary())})
            rows, segments = [], []
            return made

        for batch in batches:
            encoded = memo.encode_all(batch["text"])[::-1]
            for id_ in batch["id"].to_pylist():
                # taken off the list, so that segments are not held twice
                ids = encoded.pop() + end
                doc_ids.append(id_)
                sizes.append(len(ids) // 4)
                open_ids.append(ids)
                n += len(ids) // 4
                if n >= segment_ids:
                    close()
                    if len(segments) >= 64:
                        yield flush()
        if doc_ids:
            close()
        if segments:
            yield flush()

    ordered.mapInArrow(run, "part int, start long, ids array<long>, sizes array<int>, data binary").write.parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document, from the files."""
    files = spark.read.parquet(path)
    # one row per part: their number is that of the shuffle's partitions, not of rows
    totals = files.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                some = pdf.iloc[lo:lo + 64]
                out = []
                for part, start, doc_ids, sizes, ids in zip(some["part"], some["start"], some["ids"], some["sizes"],
                                                            unpack_segments([bytes(d) for d in some["data"]])):
                    raw, at = ids.tobytes(), 0
                    for id_, size in zip(doc_ids, sizes):
                        size = int(size)
                        out.append((part, None if id_ is None else int(id_), start + at, size,
                                    zlib.crc32(raw[4 * at:4 * (at + size)])))
                        at += size
                yield pd.DataFrame(out, columns=["part", "id", "within", "n_tokens", "ids_crc32"], dtype=object)

    # ids as text: an array with a null would come as floats
    texts = files.withColumn("ids", F.col("ids").cast("array<string>"))
    docs = map_exact(texts, run, "part int, id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(before), "part").select(
        "id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocab: str | None = None, end_id: int = 0, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Write the files below the shared folder and read them back."""
    scratch = Scratch(docs.sparkSession, "token-ids")
    write_ids(docs, f"{scratch.root}/files", vocab, end_id, id_col, text_col)
    return read_ids(docs.sparkSession, f"{scratch.root}/files").withColumnRenamed("id", id_col)
