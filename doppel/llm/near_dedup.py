"""Near-dedup with MinHash bands and odd sketches.

A text's set holds its distinct ``WIDTH``-word shingles (words
``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer words make one shingle of all;
no words make an empty set, which is linked with nothing). Two documents are linked
when the Jaccard similarity of their sets is at least ``threshold`` percent.

* Documents with equal sets form a class; only its smallest id goes on, with the
  smallest text hash if that id has several texts. The pair of both names the class.
* Bands of ``ROWS`` MinHash values each give buckets, so many that a linked pair
  misses every bucket with probability ``MISSED`` at most (24 bands at 85 %).
* The MinHash samples are folded into an *odd sketch*, a bitmap in which each
  sample flips one bit. The XOR of two sketches has few bits when the sets are
  similar, so its population count estimates the similarity; pairs far below the
  threshold (six standard errors) or of too different sizes are not verified.
* What is left is confirmed on the full sets.

Buckets are not expanded into pairs. First every member is paired with the bucket's
*hub*, the member that shares most bucket places with others; linked members are
merged into components. Only what is then still in different components of one
bucket is compared, inside a join whose condition is the sketch filter and which
gives a pair in the first band that it shares only.

Defined cases: a null text has no words. Each input row gives one output row. Rows
repeated with one id and text are one document. If one id has several texts, each
of them is a document of its own, judged by its own set. A null id is a document that
only copies can be linked to. Columns other than id and text are not read (but
returned by ``keep_one``). An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import Scratch, broadcast_if_small, map_exact
from doppel.llm.hashing import Substrings, U, mix
from doppel.operators.components import connected_components

WIDTH = 5
ROWS, MISSED = 5, 1e-6
# samples folded into an odd sketch, and 64-bit words of the sketch
SAMPLES, SKETCH_WORDS = 512, 32
_RNG = np.random.default_rng(77)
_FACTORS = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64) * U(2) + U(1)
_SHIFTS = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64)
_PLACES = mix(_RNG.integers(1, 2**63, WIDTH, dtype=np.uint64)) | U(1)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    if not text:
        return np.zeros(0, U)
    data = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    edge = np.diff(np.concatenate([[True], _WHITE[data], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    if not len(start):
        return np.zeros(0, U)
    words = Substrings(data).of(start, end)
    if len(words) < width:
        return mix((words * _PLACES[:len(words)]).sum(keepdims=True) + U(len(words)))
    n = len(words) - width + 1
    sums = words[:n] * _PLACES[0]
    for i in range(1, width):
        sums = sums + words[i:i + n] * _PLACES[i]
    return np.unique(mix(sums))


def band_count(threshold: int) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - (threshold / 100) ** ROWS))


def minhash(sets: np.ndarray, samples: int) -> np.ndarray:
    least = np.full(samples, ~U(0), U)
    for at in range(0, len(sets), 1024):
        np.minimum(least, (sets[at:at + 1024, None] * _FACTORS[:samples] + _SHIFTS[:samples]).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(1, len(least) // ROWS + 1, dtype=U)
    for row in least.reshape(-1, ROWS).T:
        keys = mix(keys * U(0x9E3779B97F4A7C15) + row)
    return keys


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Every sample (its number and value) flips one bit."""
    at = mix(least + np.arange(len(least), dtype=U) * U(0xD6E8FEB86659FD93)) % U(64 * SKETCH_WORDS)
    odd = np.bincount(at.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def max_flips(threshold: int, errors: float = 6.0) -> int:
    """Most differing sketch bits of a pair that may still reach the threshold.

    With k samples and n bits, a pair of similarity J is expected to differ in
    n/2 (1 - exp(-4 k (1 - J) / n)) bits. J is taken ``errors`` standard errors of
    the MinHash estimate below the threshold.
    """
    k, n, j = SAMPLES, 64 * SKETCH_WORDS, threshold / 100
    j -= errors * math.sqrt(j * (1 - j) / k)
    return math.ceil(n / 2 * (1 - math.exp(-4 * k * (1 - j) / n)))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, fp, text``; ``id`` and ``fp`` together tell documents apart."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))


def band_table(docs: DataFrame, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """``id, fp, n, f1, f2, bands``: text hash, set size, fingerprint of the set, band keys."""
    samples = ROWS * band_count(threshold)
    src = _source(docs, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                s = shingles(text)
                if len(s):
                    f1, f2 = s.sum(), np.bitwise_xor.reduce(mix(s + U(1)))
                    rows.append((len(s), f1.astype(np.int64), f2.astype(np.int64), band_keys(minhash(s, samples)).view(np.int64)))
                else:
                    rows.append((0, 0, 0, None))
            made = pd.DataFrame(rows, columns=["n", "f1", "f2", "bands"])
            made.insert(0, "id", pdf["id"].array)
            made.insert(1, "fp", pdf["fp"].array)
            yield made

    return map_exact(src, run, "id long, fp long, n long, f1 long, f2 long, bands array<long>")


def set_table(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, set, odd``: full set and odd sketch of the documents with a hash of ``id, fp`` in ``wanted.h``.

    ``id`` is the struct of ``id`` and ``fp``. Two documents with one hash would only give a set too many.
    """
    src = _source(docs, id_col, text_col).where("id IS NOT NULL")
    src = src.withColumn("h", F.xxhash64(F.struct("id", "fp"))).join(wanted, "h", "left_semi").drop("h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "fp": pdf["fp"], "n": [len(s) for s in sets], "set": [s.view(np.int64) for s in sets],
                                "odd": [odd_sketch(minhash(s, SAMPLES)) if len(s) else None for s in sets]})

    made = src.mapInPandas(run, "id long, fp long, n long, set array<long>, odd array<long>")
    return made.select(F.struct("id", "fp").alias("id"), "n", "set", "odd")


def _maybe_similar(a: str, b: str, threshold: int) -> Column:
    """Sizes and sketches allow the pair to reach the threshold."""
    flips = sum((F.bit_count(F.get(f"{a}.odd", F.lit(i)).bitwiseXOR(F.get(f"{b}.odd", F.lit(i)))) for i in range(SKETCH_WORDS)),
                F.lit(0))
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= threshold * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & (flips <= max_flips(threshold))


def _verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold."""
    b = pairs.join(sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b")), "b")
    both = b.join(sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a")), "a")
    both = both.withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(100 * F.col("common") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b").distinct()


def _hub_pairs(members: DataFrame, hubs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs of a bucket's hub with its other members that their sketches allow."""
    pairs = members.join(hubs, "key").where("id <> hub").select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    light = sets.select("id", "n", "odd")
    return (pairs.join(light.select(F.col("id").alias("a"), F.struct("n", "odd").alias("x")), "a")
            .join(light.select(F.col("id").alias("b"), F.struct("n", "odd").alias("y")), "b")
            .where(_maybe_similar("x", "y", threshold)).select("a", "b"))


def _relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that still hold more than one component."""
    comp = connected_components(links, "a", "b").select(F.col("node").alias("id"), F.col("label").alias("new"))
    now = members.join(comp, "id", "left").select("key", "band", "id", F.coalesce("new", "id").alias("comp"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where(
        "lo <> hi AND m > 2").select("key")
    return now.join(mixed, "key", "left_semi")


def link_classes(docs: DataFrame, bands: DataFrame, scratch: Scratch, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links ``a, b`` between classes; ``bands`` has one row per class, its ``id`` a struct of id and text hash."""
    keys = bands.select("id", F.posexplode("bands").alias("band", "key"))
    # buckets with the same members are one: that of the first band stands for them
    members = [F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")]
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("band").alias("band"), *members).where("m > 1")
    shared = shared.groupBy("m", "x", "y").agg(F.min(F.struct("band", "key")).alias("k")).select("m", "k.key")
    sized = scratch.write(keys.join(shared, "key"), "sized")
    score = sized.groupBy("id").agg(F.sum("m").alias("score"))
    members = scratch.write(sized.join(score, "id").select("key", "band", "id", "score"), "members")
    wanted = broadcast_if_small(scratch.write(members.select(F.xxhash64("id").alias("h")).distinct(), "wanted"))
    # rows that repeat one id and text have one set
    sets = scratch.write(set_table(docs, wanted, id_col, text_col).where("n > 0").dropDuplicates(["id"]), "sets")

    hubs = members.groupBy("key").agg(F.max_by("id", F.struct("score", -F.col("id.id"), "id.fp")).alias("hub"))
    links = scratch.write(_verify(_hub_pairs(members, hubs, sets, threshold), sets, threshold), "links")
    mixed = scratch.write(_relabel(members, links), "mixed")
    light = mixed.join(sets.select("id", "n", "odd"), "id").join(bands.select("id", "bands"), "id")
    x, y = light.alias("x"), light.alias("y")
    earlier = lambda side: F.slice(f"{side}.bands", F.lit(1), F.col("x.band"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp"))
                  & _maybe_similar("x", "y", threshold) & ~F.arrays_overlap(earlier("x"), earlier("y")))
    pairs = scratch.write(rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "rest")
    return links.unionByName(scratch.write(_verify(pairs, sets, threshold), "rest-links"))


def labelled(docs: DataFrame, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """``id, fp, n, label``, one row per input row.

    ``label`` is the smallest ``(id, fp)`` reachable over links, null for a text without words.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    bands = scratch.write(band_table(docs, threshold, id_col, text_col), "bands")
    some = bands.where("n > 0")
    # the smallest id that isn't null
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("least")
    classes = some.groupBy("n", "f1", "f2").agg(least)
    classes = scratch.write(classes.select("n", "f1", "f2", F.struct("least.id", "least.fp").alias("rep")), "classes")
    reps = classes.where("rep.id IS NOT NULL").select("rep.*")
    one = some.join(reps, ["id", "fp"], "left_semi").select(F.struct("id", "fp").alias("id"), "bands").dropDuplicates(["id"])
    links = link_classes(docs, one, scratch, threshold, id_col, text_col)
    comp = scratch.write(connected_components(links, "a", "b"), "components")
    labels = classes.join(comp, classes["rep"] == comp["node"], "left").select(
        "n", "f1", "f2", F.coalesce("label", "rep").alias("label"))
    return bands.select("id", "fp", "n", "f1", "f2").join(labels, ["n", "f1", "f2"], "left").select("id", "fp", "n", "label")


def near_dedup(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept``, one row per input row.

    ``component_id`` is the smallest id reachable over links; the row with that id
    is kept.
    """
    rows = labelled(docs, threshold, id_col, text_col)
    component = F.coalesce(F.col("label.id"), F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                       component.eqNullSafe(F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of every component, with the smallest id.

    If that id has several texts in the component, the text with the smallest hash
    stays; of rows that repeat one id and text, null ids too, any one does. Texts
    without words are linked with nothing, so only such repeats go.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    rows = labelled(docs, threshold, id_col, text_col)
    named = rows.where(F.col("label").isNull() | (F.col("label") == F.struct("id", "fp")))
    kept = scratch.write(named.groupBy(F.col("id").alias("_id"), F.col("fp").alias("_fp")).agg(F.count(F.lit(1)).alias("_rows")), "kept")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_fp"))
    found = docs.join(kept, same)
    once = found.where("_rows = 1").select(*docs.columns)
    if kept.where("_rows > 1").isEmpty():
        return once
    return once.unionByName(found.where("_rows > 1").dropDuplicates(["_id", "_fp"]).select(*docs.columns))
