"""Substring search of many needles in the names of a dimension of any size.

An inverted index instead of comparing every needle with every name: a name stands
under the hashes of its substrings of the sizes in ``SIZES`` that needles ask for, a needle
asks with one of its own of the largest size it has, the one that the fewest names have. What
meets there is checked exactly. All joins are on equal keys, needles and names may be many.

The index is many times as large as the names, which the planner's estimate does not see, so
the joins here say how they are done: only hashes of needles are broadcast, up to a fixed
number of them, all else is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (1, 2, 3, 6, 12)
BROADCAST_GRAMS = 1_000_000


def _grams(text: Column, size: Column) -> Column:
    """Hashes of the distinct substrings of ``size`` characters; none if the text is shorter."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.substring(text, i, size)))))


def substring_pairs(names: DataFrame, needles: DataFrame, name: str, needle: str) -> DataFrame:
    """Distinct ``_needle, _name`` where the name contains the needle, case and all; blank needles meet nothing."""
    asked = needles.select(F.col(needle).alias("_needle")).where("_needle <> ''").distinct()
    asked = asked.withColumn("_size", F.greatest(*[F.when(F.length("_needle") >= n, F.lit(n)) for n in SIZES], F.lit(1)))
    asked_grams = asked.select("_needle", "_size", F.explode(_grams(F.col("_needle"), F.col("_size"))).alias("_gram"))
    # a size that no needle has is not indexed
    seen = asked_grams.agg(F.collect_set("_size").alias("sizes"), F.approx_count_distinct("_gram").alias("grams")).first()
    few = seen["grams"] <= BROADCAST_GRAMS

    def only(index: DataFrame, grams: DataFrame) -> DataFrame:
        grams = grams.select("_gram").distinct()
        return index.join(F.broadcast(grams) if few else grams.hint("merge"), "_gram", "left_semi")

    none = F.expr("cast(array() as array<bigint>)")
    every = F.array_distinct(F.flatten(F.array(none, *[F.coalesce(_grams(F.col("_name"), F.lit(n)), none) for n in seen["sizes"]])))
    held = names.select(F.col(name).alias("_name")).distinct()
    index = held.select("_name", F.explode(every).alias("_gram"))
    frequent = only(index, asked_grams).groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # a gram that no name has settles its needle
    chosen = asked_grams.join(frequent.hint("merge"), "_gram", "left").groupBy("_needle").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("best"))
    chosen = chosen.where("best.n > 0").select("_needle", F.col("best.gram").alias("_gram"))
    return only(index, chosen).join(chosen.hint("merge"), "_gram").where(F.contains("_name", "_needle")).select("_needle", "_name")


def substring_hits(names: DataFrame, needles: DataFrame, name: str, needle: str) -> DataFrame:
    """Rows of ``needles`` joined with the rows of ``names`` whose ``name`` contains ``needle``.

    Column names of the two must differ. Equal needles are looked up once. Every hit is a row: to count
    hits use ``substring_counts``, which does not multiply equal needles by equal names.
    """
    found = substring_pairs(names, needles, name, needle)
    return (needles.join(found.hint("merge"), F.col(needle) == F.col("_needle")).drop("_needle")
            .join(names.hint("merge"), F.col("_name") == F.col(name)).drop("_name"))


def substring_counts(names: DataFrame, needles: DataFrame, name: str, needle: str, smallest: str) -> DataFrame:
    """``_needle, n_matches, smallest``: per distinct needle the rows of ``names`` that contain it and the least ``smallest`` of them."""
    found = substring_pairs(names, needles, name, needle)
    rows = names.groupBy(F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min(smallest).alias("_least"))
    return found.join(rows.hint("merge"), "_name").groupBy("_needle").agg(F.sum("_n").alias("n_matches"), F.min("_least").alias(smallest))
