"""Removal of repeated passages with sharded suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else, in
any document or the same one, is removed; matches never cross documents, overlaps
count, and all strings are judged on the input.

Sharding. The *key* of a string is the smallest hash among its ``GRAM``-byte
substrings, so equal strings have equal keys. Neighbouring strings mostly share a
key; such a run, with the bytes it covers, is a *context*, and every string starts
in exactly one. Only contexts whose key occurs elsewhere, or whose smallest substring
occurs in them more than once, can hold a match:

* A context that occurs twice as a whole needs no further proof: all its strings
  repeat.
* Other such keys, with all their different contexts, go to shards
  of about ``SHARD_BYTES``, one copy of each context. A shard's suffix array is
  built by induced sorting; the permuted common prefixes say which strings have an
  equal neighbour.
* A key whose different contexts (at the edge of a passage that many documents
  quote) hold more than ``MAX_KEY_BYTES`` can't be sorted in a task's memory. Its
  strings are spread by the hash of each whole string and counted there.

The found ranges go back to all occurrences of their contexts.

Defined cases: a null text counts as empty. Each input row is a document of its
own, repeated rows too, so a row of at least ``LENGTH`` bytes that occurs twice is
removed whole. Rows with one id and one text get the same result. Ids may be null.
Columns other than id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import Scratch, map_exact
from doppel.llm.hashing import Substrings, U
from doppel.llm.suffix_array import permuted_lcp, suffix_array

LENGTH = 200
GRAM = 24
MAX_RUN = 2048
SHARD_BYTES = 1 << 20
MAX_KEY_BYTES = 2 << 20
SLICE = 1 << 17


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: of a block's rest and the next block's beginning."""
    n = len(values)
    padded = np.full(-(-n // width) * width, ~U(0), U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    rest = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(rest[:n - width + 1], ahead[width - 1:n])


def _repeated_grams(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Strings (one at least of each run) whose smallest substring is at two places of their run.

    A place is where some window has its minimum: where the largest minimum of the
    windows around it is its own value. Two such places of one run are neighbours
    and no further apart than a window.
    """
    around = ~_window_min(~np.pad(least, width - 1), width)
    at = np.flatnonzero(grams == around)
    near = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) <= width))
    x, y = at[near], at[near + 1]
    strings = np.concatenate([np.minimum(x, len(least) - 1), np.maximum(y - width + 1, 0)])
    return strings[least[strings] == np.concatenate([grams[x], grams[x]])]


def contexts(text: str | None, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``key, ctx, first, count, again``: a context covers strings starting at ``first`` and the next ``count - 1``.

    ``ctx`` hashes the bytes that the context covers; ``again`` tells that it may
    repeat a string within itself.
    """
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    out = []
    for at in range(0, max(0, len(data) - length + 1), SLICE):
        part = data[at:at + SLICE + length - 1]
        subs = Substrings(part)
        places = np.arange(len(part) - gram + 1)
        grams = subs.of(places, places + gram)
        least = _window_min(grams, length - gram + 1)
        new = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        ends = np.append(new[1:], len(least))
        if int((ends - new).max()) > MAX_RUN:
            new = np.concatenate([np.arange(a, b, MAX_RUN) for a, b in zip(new, ends)])
            ends = np.append(new[1:], len(least))
        again = np.zeros(len(new), bool)
        again[np.searchsorted(new, _repeated_grams(grams, least, length - gram + 1), side="right") - 1] = True
        out.append((least[new].view(np.int64), subs.of(new, ends + length - 1).view(np.int64), new + at, ends - new, again))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*out))


def _source(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Rows are told apart by id and text: equal rows have equal results."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("fp"), *more)


def context_table(src: DataFrame, length: int, gram: int) -> DataFrame:
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [contexts(t, length, gram) for t in pdf["text"]]
            each = [len(f[0]) for f in found]
            made = {n: np.concatenate([f[i] for f in found]) for i, n in enumerate(("key", "ctx", "first", "count", "again"))}
            yield pd.DataFrame({"id": pdf["id"].repeat(each).array, "fp": pdf["fp"].repeat(each).array} | made)

    return map_exact(src, run, f"id {kind}, fp long, key long, ctx long, first long, count int, again boolean")


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Starts within each part of strings that start at another place of the parts too."""
    sizes = np.array([len(p) for p in parts], np.int64)
    t = np.zeros(int(sizes.sum()) + len(parts) + 1, np.int64)
    room = np.zeros(len(t), np.int64)
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    for a, n, p in zip(at, sizes, parts):
        t[a:a + n] = np.frombuffer(p, np.uint8)
        t[a:a + n] += 2
        t[a + n] = 1
        room[a:a + n] = np.arange(n, 0, -1)
    sa = suffix_array(t, 258)
    common = permuted_lcp(t, sa, room)
    row = np.flatnonzero(common[sa] >= length)
    found = np.zeros(len(t), bool)
    found[sa[row]] = True
    found[sa[row - 1]] = True
    return [np.flatnonzero(found[a:a + n]) for a, n in zip(at, sizes)]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted starts as ``(first, last)`` runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


RANGES = "array<struct<first:int,last:int>>"


def _in_shards(rows: DataFrame, shards: int, length: int) -> DataFrame:
    """Ranges of repeated strings of the contexts ``key, ctx, content``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(pdf["content"].tolist(), length)
        made = pd.DataFrame({"key": pdf["key"], "ctx": pdf["ctx"], "ranges": [_ranges(f) for f in found]})
        return made[made["ranges"].map(len) > 0]

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    return rows.select("key", "ctx", "content", shard).groupBy("shard").applyInPandas(run, f"key long, ctx long, ranges {RANGES}")


def _by_string(rows: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """The same for contexts of keys with very many variants: their strings, spread by hash."""
    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, ctx, content in zip(pdf["key"], pdf["ctx"], pdf["content"]):
                data = np.frombuffer(content, np.uint8)
                first = np.arange(len(data) - length + 1)
                yield pd.DataFrame({"key": key, "ctx": ctx, "first": first, "h": Substrings(data).of(first, first + length).view(np.int64)})

    each = scratch.write(rows.mapInPandas(strings, "key long, ctx long, first int, h long"), "strings")
    twice = each.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # one start a range: a context has a bounded number of starts
    return each.join(twice, ["key", "h"], "left_semi").groupBy("key", "ctx").agg(
        F.sort_array(F.collect_list(F.struct("first", F.col("first").alias("last")))).alias("ranges"))


def find_repeats(docs: DataFrame, scratch: Scratch, length: int, gram: int, id_col: str, text_col: str,
                 max_key_bytes: int = MAX_KEY_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``id, fp, spans``: removed byte ranges ``(first, end)`` of documents that have any."""
    src = _source(docs, id_col, text_col)
    everything = scratch.write(context_table(src, length, gram), "contexts")
    common = everything.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where(
        "n > 1 OR again").select("key")
    shared = scratch.write(everything.join(common, "key", "left_semi"), "shared")
    scratch.drop("contexts")
    variants = scratch.write(shared.groupBy("key", "ctx", "count").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("first", "id", "fp")).alias("one"), F.max("again").alias("again")), "variants")
    per_key = variants.groupBy("key").agg(
        F.count(F.lit(1)).alias("different"), F.min("n").alias("least"), F.max("again").alias("again"),
        F.sum(F.col("count") + length - 1).alias("bytes")).where("(different > 1 OR again) AND least = 1")
    per_key = scratch.write(per_key, "per-key")
    total = per_key.where(F.col("bytes") <= max_key_bytes).agg(F.sum("bytes")).first()[0] or 0
    wanted = variants.join(per_key.select("key", (F.col("bytes") > max_key_bytes).alias("wide")), "key").select(
        "key", "ctx", "wide", "count", "one.*")
    # a document's contexts are bounded by its own length
    asked = wanted.groupBy("id", "fp").agg(F.collect_list(F.struct("key", "ctx", "wide", "first", "count")).alias("asked"))
    texts, a = src.dropDuplicates(["id", "fp"]) if _has_repeats(src) else src, asked
    joined = texts.alias("t").join(a.alias("a"), F.col("t.id").eqNullSafe(F.col("a.id")) & (F.col("t.fp") == F.col("a.fp"))).select("text", "asked")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, want in zip(pdf["text"], pdf["asked"]):
                data = text.encode("utf-8", "replace")
                rows += [(w["key"], w["ctx"], w["wide"], data[w["first"]:w["first"] + w["count"] + length - 1]) for w in want]
            yield pd.DataFrame(rows, columns=["key", "ctx", "wide", "content"])

    pieces = scratch.write(joined.mapInPandas(cut, "key long, ctx long, wide boolean, content binary"), "pieces")
    shards = max(1, -(-int(total) // shard_bytes))
    ranges = _in_shards(pieces.where("NOT wide"), shards, length).unionByName(_by_string(pieces.where("wide"), scratch, length))
    ranges = scratch.write(ranges, "ranges")
    whole = variants.where("n > 1").select("key", "ctx", F.array(F.struct(
        F.lit(0).alias("first"), (F.col("count") - 1).alias("last"))).cast(RANGES).alias("ranges"))
    proven = whole.unionByName(ranges.join(whole.select("key", "ctx"), ["key", "ctx"], "left_anti"))
    hits = shared.join(proven, ["key", "ctx"]).select("id", "fp", F.explode("ranges").alias("r"), F.col("first").alias("at"))
    hits = hits.select("id", "fp", (F.col("at") + F.col("r.first")).alias("first"), (F.col("at") + F.col("r.last") + length).alias("end"))
    return hits.groupBy("id", "fp").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def _has_repeats(src: DataFrame) -> bool:
    """Whether some (id, text) occurs in several rows; their contexts must be cut only once."""
    return not src.groupBy("id", "fp").count().where("count > 1").isEmpty()


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, end in sorted((s["first"], s["end"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [tuple(x) for x in out]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                 output: str = "digest", keep: list[str] | None = None, **limits) -> DataFrame:
    """One row per input row.

    ``output="digest"``: ``id, n_bytes, n_removed, n_spans, kept_sha256`` and the removed
    ``spans``; ``output="text"``: id, the columns ``keep`` and the remaining text (bytes
    of a character that lost others of its bytes are left out).
    """
    keep = keep or []
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    spans = find_repeats(docs, scratch, length, gram, id_col, text_col, **limits).withColumnsRenamed({"id": "_id", "fp": "_fp"})
    rows = _source(docs, id_col, text_col, *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = rows.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left").drop("fp", "_id", "_fp")
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("text", "spans"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for text, found in zip(pdf["text"], pdf["spans"]):
                data = (text or "").encode("utf-8", "replace")
                gone = _merged(found) if found is not None else []
                left, at = [], 0
                for first, end in gone:
                    left.append(data[at:first])
                    at = end
                left = b"".join([*left, data[at:]])
                if output == "text":
                    made.append((left.decode("utf-8", "ignore") if gone else text,))
                else:
                    made.append((len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), gone))
            names = ["text"] if output == "text" else ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pd.concat([pdf.drop(columns=["text", "spans"]).reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    tail = "text string" if output == "text" else ("n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                                   "spans array<struct<first:long,end:long>>")
    out = map_exact(rows, apply, f"{head}, {tail}")
    return out.withColumnRenamed("id", id_col).withColumnsRenamed({f"_keep_{c}": c for c in keep})
