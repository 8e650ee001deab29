"""Exact dedup by progressive refinement.

Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``. Groups shrink in three steps: by length of the normalised
text, then by the hash of its first characters, then by the full SHA-256; each
step only sees rows whose group of the step before had another member. Nothing
but ids, lengths and hashes is ever shuffled.

Of equal texts the row with the most code points in the original text stays,
then the smallest id (a null id counts as the smallest).

Defined cases: a null text counts as empty; empty texts form one group like any
other. Each input row gives one output row; rows repeated with one id all belong
to their group and count in ``group_size``, and all rows that carry the kept id
are marked kept. Columns other than id and text are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import WS, Scratch

PREFIX_CHARS = 128


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", "")


def _refine(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` are shared with another row.

    The counts are partial sums before the shuffle; the semi join is on the
    same keys, and its skewed side (one key with many rows) can be split.
    """
    shared = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return rows.join(shared, keys, "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest_all: bool = True) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256``, one row per input row.

    ``digest_all=False`` leaves ``text_sha256`` null for rows that the prefix
    step already proved unique, so that their content is not hashed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    norm = normalised(F.col(text_col))
    scan = docs.select(F.col(id_col).alias("id"), norm.alias("t"), F.length(text_col).alias("n_chars")).select(
        "id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.length("t").alias("len"),
        F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("prefix_hash"),
        *([F.unhex(F.sha2("t", 256)).alias("sha")] if digest_all else []))
    rows = scratch.write(scan, "keys")
    # each step is written, so that its join ends a stage of its own and a hot key's rows can be split
    same_length = scratch.write(_refine(rows, ["len"]), "same_length")
    survivors = scratch.write(_refine(same_length, ["len", "prefix_hash"]), "same_prefix")
    if not digest_all:
        # the content of survivors only: their ids select the rows that are read and hashed
        ids = scratch.write(survivors.select(F.col("id").alias("_id")).distinct(), "survivors")
        same = F.col("id").eqNullSafe(F.col("_id"))
        content = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(
            ids, same, "left_semi")
        content = content.select("id", normalised(F.col("t")).alias("t"), F.length("t").alias("n_chars")).select(
            "id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.length("t").alias("len"),
            F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("prefix_hash"),
            F.unhex(F.sha2("t", 256)).alias("sha"))
        survivors = scratch.write(content, "hashed")
        singles = rows.join(ids, same, "left_anti").withColumn(
            "sha", F.lit(None).cast("binary"))
        rows = survivors.unionByName(singles)
    best = F.struct((-F.col("n_chars")).alias("c"), F.col("id").alias("id"))
    groups = survivors.groupBy("len", "prefix_hash", "sha").agg(
        F.min(best)["id"].alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    r, g = rows.alias("r"), groups.alias("g")
    joined = r.join(g, ["len", "prefix_hash", "sha"], "left")
    grouped = F.col("n").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
