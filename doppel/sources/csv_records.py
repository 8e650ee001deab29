"""Records of delimited text whose quoted cells may hold line breaks, read in parallel.

A file is read as lines, many splits of it at once. Whether a line begins inside a
quoted cell depends on how many quotes stand before it in the file, on nothing else: a
doubled quote adds two and changes nothing. So every split counts its quotes, a prefix
sum over the splits (one row a split) says whether a split begins inside a cell, and a
running count inside the split says it for each line. The same sums number the records.
Only the lines of records with breaks in them are brought together; all others stay
where they were read. No file is read by one task.

Lines end with ``\\n`` or ``\\r\\n``. Empty lines between records are no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "﻿"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, pos, text, quotes``: lines in the order of ``pos`` within a split."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "\r$", "").alias("text"))
    return raw.withColumn("quotes", F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit(""))))


def file_order(file: Column) -> list[Column]:
    """Sort columns for the files of one table: folder, number of the part, name."""
    name = F.regexp_extract(file, r"([^/]*)$", 1)
    number = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long")
    return [F.regexp_extract(file, r"^(.*/)?[^/]*$", 1), number.asc_nulls_first(), name]


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(records, unclosed)`` of a file or a folder of files.

    ``records``: ``file, number, text, first`` - ``number`` counts from 1 over all files in order,
    ``first`` is true for a file's first record (its header). ``unclosed``: ``file, number``
    of files that end inside a quoted cell; their last record is left out of ``records``.
    """
    split = Window.partitionBy("file", "block").orderBy("pos")
    before, upto = split.rowsBetween(Window.unboundedPreceding, -1), split.rowsBetween(Window.unboundedPreceding, 0)
    lines = _lines(spark, path).withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    # records that start up to a line, if the split begins outside of a cell and if inside
    for state in (0, 1):
        starts = (F.col("inside") == state) & ((F.length("text") > 0) & (F.col("text") != BOM))
        lines = lines.withColumn(f"starts{state}", F.sum(starts.cast("long")).over(upto))

    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.max("starts0").alias("starts0"),
                                                F.max("starts1").alias("starts1"))
    # prefix sums over one row a split
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("begins", F.coalesce(F.sum("quotes").over(in_file), F.lit(0)) % 2)
    splits = splits.withColumn("n", F.when(F.col("begins") == 0, F.col("starts0")).otherwise(F.col("starts1")))
    in_order = Window.orderBy(*file_order(F.col("file")), "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
    whole = Window.partitionBy("file")
    splits = splits.withColumn("file_base", F.min("base").over(whole)).withColumn("file_n", F.sum("n").over(whole)).withColumn(
        "open", F.sum("quotes").over(whole) % 2 == 1)
    offsets = splits.select("file", "block", "begins", "base", "file_base", "file_n", "open")

    placed = lines.join(offsets, ["file", "block"])
    starts = F.when(F.col("begins") == 0, F.col("starts0")).otherwise(F.col("starts1"))
    inside = (F.col("inside") + F.col("begins")) % 2 == 1
    placed = placed.select(
        "file", "block", "pos", (F.col("base") + starts).alias("number"), "file_base", inside.alias("inside"),
        F.col("text"), (F.col("quotes") % 2 == 1).alias("odd"), (F.col("open") & (F.col("base") + starts == F.col("file_base") + F.col("file_n"))).alias("cut"))
    kept = placed.where(~F.col("cut") & (F.col("inside") | ((F.length("text") > 0) & (F.col("text") != BOM))))
    whole_lines = kept.where(~F.col("inside") & ~F.col("odd")).select("file", "number", "file_base", "text")
    parts = kept.where(F.col("inside") | F.col("odd")).groupBy("file", "number", "file_base").agg(
        F.sort_array(F.collect_list(F.struct("block", "pos", "text"))).alias("parts"))
    joined = parts.select("file", "number", "file_base", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    records = whole_lines.unionByName(joined).withColumn("first", F.col("number") == F.col("file_base") + 1).drop("file_base")
    records = records.withColumn("text", F.when(F.col("first"), F.regexp_replace("text", f"^{BOM}", "")).otherwise(F.col("text")))
    unclosed = offsets.where("open").select("file", (F.col("file_base") + F.col("file_n")).alias("number")).distinct()
    return records, unclosed
