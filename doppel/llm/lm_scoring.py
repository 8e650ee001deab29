"""Language-model scoring by context-tree weighting.

Bytes of the text (A-Z lower-cased, one end mark) are coded bit by bit. For every
place in a byte (the bits of it seen so far) there is a tree of contexts: the last
``depth`` bytes, the most recent one first. A node counts the zeros and ones that
followed its context in the training texts. Its Krichevsky-Trofimov estimate codes a
bit with probability ``(n_bit + 1/2) / (n0 + n1 + 1)``; its weighted probability is half
the estimate's probability of all its bits plus half the product of its children's. A
bit's probability is the mixture over all depths that these weights give, with the
counts of the whole training set: no sample, no pruning, no hashing of contexts. What
a byte costs depends on it and its ``depth`` predecessors only, its gram.

Plan: texts are dealt into portions of ``PORTION_BYTES``. Each portion packs its
distinct grams and words with their training counts, one row for each portion and shard
(the corpus counts follow the input). A gram's shard follows from its last two context bytes,
so that shards hold whole subtrees; what is above those, at most 255 * 257 nodes, goes
to all tasks. Shards total what the portions sent and answer each with the prices of the
grams and the counts of the words it asked for. Portions grow with the text, shards with
the power 2/3 of it, as distinct grams and words grow less than the text.

The base score is that of single words, ``[^\\x20\\x09-\\x0D]+`` and one end per text, with
add-half counts.

Defined cases: null text counts as empty, which is an end alone. Texts with a null id
are training texts under ``train`` columns made of the id, unless that column says
otherwise; a null ``train`` means training. Rows that repeat each give a row, and train as often
as they occur. Words and grams never seen in training have count 0. Without training
texts every bit costs one bit. Long texts are worked off in slices. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import Scratch

DEPTH = 4
EDGE = b"\xff"  # never in UTF-8
PORTION_BYTES = 10 << 20
SLICE = 2 << 20
U = np.uint64
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def grams(texts: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of all texts with their text's number, a bounded number at a time."""
    def done(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(parts), np.uint8)
        code = np.zeros(len(data) - depth, U)
        for k in range(depth + 1):
            code = code << U(8) | data[k:k + len(code)]
        sizes = np.array([len(p) for p in parts[1::2]])
        coded = np.ones(len(data), bool)
        starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
        coded[(starts[:, None] + np.arange(depth)).ravel()] = False
        return code[coded[depth:]], np.repeat(np.array(owners), sizes)

    parts: list[bytes] = []
    owners: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) + 1, SLICE):
            body = text[at:at + SLICE] + (EDGE if at + SLICE > len(text) else b"")
            parts += [(EDGE * depth + text[max(0, at - depth):at])[-depth:], body]
            owners.append(i)
            held += len(body)
            if held >= SLICE:
                yield done(parts, owners)
                parts, owners, held = [], [], 0
    if parts:
        yield done(parts, owners)


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + SLICE)
        end = blank.start() if blank else len(text)
        yield text[at:end].split()
        at = end


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series at x + 10."""
    z = x + 10.0
    down = np.log(x)
    for i in range(1, 10):
        down = down + np.log(x + i)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - down


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """Nodes of one depth, ascending by key: context bytes, then the bits of the byte seen so far after a leading one."""
    keys: np.ndarray
    of: np.ndarray      # node of each gram and bit
    n0: np.ndarray
    n1: np.ndarray
    stay: np.ndarray    # posterior weight of the node's own estimate
    logp: np.ndarray    # logarithm of the weighted probability

    def share(self, bits: np.ndarray) -> np.ndarray:
        """The node's own estimate of the bit of each gram and place."""
        return (np.where(bits, self.n1[self.of], self.n0[self.of]) + 0.5) / (self.n0 + self.n1 + 1.0)[self.of]


def bits_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each gram and place in its byte: bits seen so far with a leading one, and the bit; place by place."""
    byte = (codes & U(255)).astype(np.int64)
    return (np.concatenate([(1 << k) | (byte >> (8 - k)) for k in range(8)]),
            np.concatenate([(byte >> (7 - k)) & 1 for k in range(8)]).astype(bool))


def weighted(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability and weight of the own estimate; ``below``: sums over the children."""
    own = log_kt(n0, n1)
    if below is None:
        return own, np.ones(len(own))
    logp = np.log(0.5) + np.logaddexp(own, below)
    return logp, np.exp(np.log(0.5) + own - logp)


def levels_of(codes: np.ndarray, counts: np.ndarray, depth: int, top: int) -> dict[int, Level]:
    """Trees over whole subtrees of depth ``top`` and more, from distinct grams with training counts."""
    prefix, bits = bits_of(codes)
    n = np.tile(counts.astype(np.float64), 8)
    out: dict[int, Level] = {}
    for d in range(depth, top - 1, -1):
        context = (codes >> U(8)) & U((1 << 8 * d) - 1)
        keys, of = np.unique(np.tile(context << U(8), 8) | prefix.astype(U), return_inverse=True)
        n1 = np.bincount(of, n * bits, len(keys))
        n0 = np.bincount(of, n, len(keys)) - n1
        below = None
        if d < depth:
            child = out[d + 1].keys
            parent = (child >> U(8) & U((1 << 8 * d) - 1)) << U(8) | child & U(255)
            below = np.bincount(np.searchsorted(keys, parent), out[d + 1].logp, len(keys))
        logp, stay = weighted(n0, n1, below)
        out[d] = Level(keys, of, n0, n1, stay, logp)
    return out


@dataclass(frozen=True)
class Top:
    """Depths 0 and 1 for every context byte and place: the estimate for a one, and the own weight."""
    one0: np.ndarray
    stay0: np.ndarray
    one1: np.ndarray
    stay1: np.ndarray


def top_of(byte: np.ndarray, prefix: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> Top:
    """``byte, prefix, ...``: sums over the nodes of depth 2, one entry for each byte and place that has any."""
    logp1, stay1 = weighted(n0, n1, below)
    all0, all1, under = (np.bincount(prefix, x, 256) for x in (n0, n1, logp1))
    _, stay0 = weighted(all0, all1, under)
    one1, stays1 = np.full((256, 256), 0.5), np.full((256, 256), 0.5)
    one1[byte, prefix], stays1[byte, prefix] = (n1 + 0.5) / (n0 + n1 + 1.0), stay1
    return Top((all1 + 0.5) / (all0 + all1 + 1.0), stay0, one1, stays1)


def log10_of(codes: np.ndarray, counts: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """log10 probability of each gram's byte after its context."""
    levels = levels_of(codes, counts, depth, 2)
    prefix, bits = bits_of(codes)
    p = levels[depth].share(bits)
    for d in range(depth - 1, 1, -1):
        stay = levels[d].stay[levels[d].of]
        p = stay * levels[d].share(bits) + (1 - stay) * p
    byte = np.tile((codes >> U(8) & U(255)).astype(np.int64), 8)
    for one, stay in ((top.one1[byte, prefix], top.stay1[byte, prefix]), (top.one0[prefix], top.stay0[prefix])):
        p = stay * np.where(bits, one, 1 - one) + (1 - stay) * p
    return np.log10(p).reshape(8, -1).sum(0)


def _some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``SLICE`` bytes of text at a time."""
    ends = np.cumsum(pc.binary_length(batch["text"].cast(pa.binary())).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)) - at)
        yield batch.slice(at, n)
        at += n


def _texts(column: pa.Array) -> list[bytes]:
    return [t.lower() for t in column.cast(pa.binary()).to_pylist()]


_BLOBS = "p int, kind int, shard int, keys binary, counts binary"
GRAMS, WORDS, TEXTS = 0, 1, 2


def gram_shard(codes: np.ndarray, shards: int) -> np.ndarray:
    """By the last two context bytes."""
    return ((codes >> U(8) & U(0xFFFF)) * U(40503) >> U(4) & U(0xFFFF)) % U(shards)


def totals(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.add.reduceat(counts, starts)


def _rows(p: int, kind: int, shard: list[int], keys: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
    n = len(shard)
    return pa.record_batch({"p": np.full(n, p, np.int32), "kind": np.full(n, kind, np.int32), "shard": np.array(shard, np.int32),
                            "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _pack_portion(p: int, texts: list[tuple[bytes, bool]], depth: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Distinct grams and words of a portion with their training counts, a row for each shard; ``b''`` is the end."""
    train = np.array([t for _, t in texts])
    codes, counts = [], []
    for code, owner in grams([t for t, _ in texts], depth):
        marked = np.sort(code << U(1) | train[owner].astype(U))
        code = marked >> U(1)
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        codes.append(code[starts])
        counts.append(np.add.reduceat((marked & U(1)).astype(np.int64), starts))
    code, n = totals(np.concatenate(codes), np.concatenate(counts))
    shard = gram_shard(code, shards)
    order = np.argsort(shard, kind="stable")
    code, n, shard = code[order], n[order], shard[order]
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    yield _rows(p, GRAMS, shard[cuts[:-1]].tolist(), [code[i:j].tobytes() for i, j in zip(cuts, cuts[1:])],
                [n[i:j].tobytes() for i, j in zip(cuts, cuts[1:])])

    found: Counter = Counter()
    for text, counted in texts:
        for some in word_lists(text):
            found.update(some) if counted else found.update(dict.fromkeys(some, 0))
    found[b""] = int(train.sum())
    by_shard: dict[int, list[bytes]] = {}
    for word in found:
        by_shard.setdefault(crc32(word) % shards, []).append(word)
    yield _rows(p, WORDS, list(by_shard), [b"\n".join(w) for w in by_shard.values()],
                [np.array([found[x] for x in w], np.int64).tobytes() for w in by_shard.values()])


def _count_portions(batches: Iterator[pa.RecordBatch], depth: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by portion; a portion that holds far more than its share is packed in several goes."""
    at, held, size = None, [], 0
    for b in batches:
        for part in _some(b):
            for p, text, train in zip(part["p"].to_pylist(), _texts(part["text"]), part["train"].to_pylist()):
                if held and (p != at or size >= 2 * PORTION_BYTES):
                    yield from _pack_portion(at, held, depth, shards)
                    held, size = [], 0
                at = p
                held.append((text, train))
                size += len(text) + 64
    if held:
        yield from _pack_portion(at, held, depth, shards)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """What the portions sent to each shard of a task: ``(p, keys, counts)``."""
    rows = ((s, p, k, c) for b in batches for s, p, k, c in zip(*(b[x].to_pylist() for x in ("shard", "p", "keys", "counts"))))
    for _, group in groupby(rows, key=lambda x: x[0]):
        yield [x[1:] for x in group]


def _grams_of(sent: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    return totals(np.concatenate([np.frombuffer(k, U) for _, k, _ in sent]), np.concatenate([np.frombuffer(c, np.int64) for _, _, c in sent]))


def _top(shards: DataFrame, depth: int) -> Top:
    """Sums below the two upper depths, at most 255 rows for each of 256 bytes, to the driver."""
    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sent in _by_shard(batches):
            at = levels_of(*_grams_of(sent), depth, 2)[2]
            yield pa.record_batch({"byte": (at.keys >> U(8) & U(255)).astype(np.int32), "prefix": (at.keys & U(255)).astype(np.int32),
                                   "n0": at.n0, "n1": at.n1, "logp": at.logp})

    rows = shards.mapInArrow(below, "byte int, prefix int, n0 double, n1 double, logp double").groupBy("byte", "prefix").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("logp").alias("logp")).toArrow()
    byte, prefix, n0, n1, logp = (rows[c].to_numpy() for c in ("byte", "prefix", "n0", "n1", "logp"))
    return top_of(byte, prefix, n0, n1, logp)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each portion's known words with their counts in all texts; a row without portion has the shard's sums."""
    for sent in _by_shard(batches):
        found: Counter = Counter()
        for _, keys, counts in sent:
            for word, n in zip(keys.split(b"\n"), np.frombuffer(counts, np.int64).tolist()):
                found[word] += n
        keys_out, counts_out = [], []
        for _, keys, _ in sent:
            known = [w for w in keys.split(b"\n") if found[w]]
            # an empty list and the end alone would look alike
            keys_out.append(b"\n".join(known) if known else None)
            counts_out.append(np.array([found[w] for w in known], np.int64).tobytes())
        n = len(sent)
        yield pa.record_batch({"p": pa.array([p for p, _, _ in sent] + [None], pa.int32()), "keys": pa.array(keys_out + [None], pa.binary()),
                               "counts": pa.array(counts_out + [None], pa.binary()), "total": pa.array([None] * n + [sum(found.values())], pa.int64()),
                               "known": pa.array([None] * n + [sum(c > 0 for c in found.values())], pa.int64())})


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` of every row.

    ``score`` is the model's log10 probability of the text and its end; ``bits_per_byte``
    the code length this means for each byte, the end included.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-scoring")
    text = F.coalesce(text_col, F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    portions = max(cores, -(-size // PORTION_BYTES))
    shards = max(2 * cores, round(portions ** (2 / 3)))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    src = src.withColumn("p", F.pmod(F.xxhash64("id", "text"), F.lit(portions)).cast("int"))

    counted = scratch.write(src.drop("id").repartition(portions, "p").sortWithinPartitions("p").mapInArrow(
        lambda b: _count_portions(b, depth, shards), _BLOBS), "counted")
    sent = {kind: counted.where(F.col("kind") == kind).repartition(shards, "shard").sortWithinPartitions("shard") for kind in (GRAMS, WORDS)}
    words = scratch.write(sent[WORDS].mapInArrow(_count_words, "p int, keys binary, counts binary, total long, known long"), "words")
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    shared = spark.sparkContext.broadcast(_top(sent[GRAMS], depth))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked in _by_shard(batches):
            codes, counts = _grams_of(asked)
            logp = log10_of(codes, counts, depth, shared.value)
            for p, keys, _ in asked:
                values = logp[np.searchsorted(codes, np.frombuffer(keys, U))]
                yield pa.record_batch({"p": np.array([p], np.int32), "keys": pa.array([keys], pa.binary()), "counts": pa.array([values.tobytes()], pa.binary())})

    prices = sent[GRAMS].mapInArrow(price, "p int, keys binary, counts binary").withColumn("kind", F.lit(GRAMS))
    answers = prices.unionByName(words.where("keys IS NOT NULL").select("p", "keys", "counts", F.lit(WORDS).alias("kind")))
    dealt = answers.unionByName(src.withColumn("kind", F.lit(TEXTS)), True).repartition(portions, "p").sortWithinPartitions("p", "kind")
    denominator = total + 0.5 * (distinct + 1)
    unknown = float(np.log10(0.5 / denominator))
    id_type = dict(src.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion, sent, table, words = None, [], None, {}
        for batch in batches:
            place = batch["p"].to_numpy() * 4 + batch["kind"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else []
            for a, b in zip(starts, [*starts[1:], len(place)]):
                part, (p, kind) = batch.slice(a, b - a), divmod(int(place[a]), 4)
                if p != portion:
                    portion, sent, table, words = p, [], None, {}
                if kind == GRAMS:
                    sent += zip(part["keys"].to_pylist(), part["counts"].to_pylist())
                elif kind == WORDS:
                    for keys, counts in zip(part["keys"].to_pylist(), part["counts"].to_pylist()):
                        values = np.log10((np.frombuffer(counts, np.int64) + 0.5) / denominator)
                        words.update(zip(keys.split(b"\n"), values.tolist()))
                else:
                    if table is None:
                        codes, logp = np.concatenate([np.frombuffer(k, U) for k, _ in sent]), np.concatenate([np.frombuffer(v) for _, v in sent])
                        order = np.argsort(codes)
                        table, sent = (codes[order], logp[order]), []
                    for some in _some(part):
                        yield scored(some, *table, words)

    def scored(part: pa.RecordBatch, keys: np.ndarray, values: np.ndarray, words: dict[bytes, float]) -> pa.RecordBatch:
        texts = _texts(part["text"])
        model = np.zeros(len(texts))
        for code, owner in grams(texts, depth):
            distinct_codes, of = np.unique(code, return_inverse=True)
            place = np.searchsorted(keys, distinct_codes)
            model += np.bincount(owner, values[place][of], len(texts))
        n, seen, base = [], [], []
        for text in texts:
            known_here, sums, count = 0, 0.0, 0
            for some in [*word_lists(text), [b""]]:
                got = np.fromiter(map(words.get, some, repeat(unknown)), float, len(some))
                known_here, sums, count = known_here + int((got > unknown).sum()), sums + float(got.sum()), count + len(some)
            n.append(count), seen.append(known_here), base.append(sums)
        size = np.array([len(t) for t in texts])
        return pa.record_batch({"id": part["id"], "train": part["train"], "n_tokens": pa.array(n, pa.int64()),
                                "n_known": pa.array(seen, pa.int64()), "train_tokens": np.full(len(texts), total, np.int64),
                                "base_score": np.array(base, float), "score": model, "n_bytes": size.astype(np.int64),
                                "bits_per_byte": -model * np.log2(10) / (size + 1)})

    return dealt.select("p", "kind", "keys", "counts", "id", "text", "train").mapInArrow(
        run, f"id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
             "score double, n_bytes long, bits_per_byte double").withColumnRenamed("id", id_col)
