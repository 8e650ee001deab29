"""Corpus pipeline: quality rules, line dedup, near-dedup, suffix-array dedup, packing.

Every stage takes the documents that its predecessor kept, with the columns of
``documents``, and its result is written and read again before the next one. The
last stage returns the packed pieces. ``n_chars`` follows the text through every
stage that changes it. Each stage calls one operator, whose docstring defines nulls,
empty and long texts, repeated rows and empty tables.

* quality_rules: documents that the current policy of the rule ledger rejects go.
* line_dedup: lines equal or within two byte edits of an earlier one go, and with
  them documents that thereby lost their last word (copies of earlier documents).
* near_dedup: of documents linked at 80 % of five-word shingles one row stays, that
  with the smallest id; repeated rows, also of one null id and text, are one document.
* suffix_dedup: bytes in passages of 200 bytes that start elsewhere too go; documents
  stay.
* packing: sequences of at most 1024 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm.common import NON_WS, Scratch, table
from doppel.llm.line_dedup import line_dedup
from doppel.llm.near_dedup import keep_one
from doppel.llm.packing import pack
from doppel.llm.quality_rules import passing
from doppel.llm.suffix_dedup import suffix_dedup

# a quarter of the usual memo: the workers of the other stages are in the same executors
MEMO_ENTRIES = 500_000


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]


def _with_new_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passing(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup(docs, keep=_others(docs))
    return _with_new_text(docs, left.where(~F.coalesce((F.col("n_dropped") > 0) & ~F.col("text").rlike(NON_WS), F.lit(False))))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, threshold=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_new_text(docs, suffix_dedup(docs, output="text", keep=_others(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, capacity=1024, end_id=2, memo_entries=MEMO_ENTRIES)


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]
# token ids and a search for few sequences can't be written in SQL; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
