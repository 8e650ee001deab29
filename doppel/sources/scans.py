"""Landed scans: pages of one or many paged API scans, their completeness and reading order.

A scan is what one request loop of the API returned: pages 1..last, each an envelope
``{"data": ..., "meta": {"pagination": {"current", "lastPage"}}}``. Many scans may land
in one folder; a key column tells them apart. The envelopes are parsed once, and both the
items and the check read the parsed rows.

Which pages of a scan are there is a bitmap: pages go into buckets, every bucket is one
bitmap aggregate with partial results before the shuffle, so a scan of any number
of pages needs neither a list of them nor a distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.session import ensure_checkpoint_dir


def kind(v: Column) -> Column:
    return F.when(v.isNull(), F.lit("NULL")).otherwise(F.schema_of_variant(v))


def parse_envelopes(envelopes: DataFrame, text_col: str = "value", scan_col: str | None = None) -> DataFrame:
    """``scan, page, last_page, readable, data`` of every envelope, parsed once and written.

    Text that is no JSON object gives a row with ``readable`` false. An envelope without
    pagination is page 1 of 1.
    """
    scan = F.col(scan_col).cast("string") if scan_col else F.lit("")
    env = envelopes.select(scan.alias("scan"), F.try_parse_json(F.col(text_col)).alias("env"))
    ensure_checkpoint_dir(envelopes.sparkSession)
    return env.select(
        "scan",
        F.coalesce(F.try_variant_get("env", "$.meta.pagination.current", "bigint"), F.lit(1)).alias("page"),
        F.try_variant_get("env", "$.meta.pagination.lastPage", "bigint").alias("last_page"),
        kind(F.col("env")).startswith("OBJECT").alias("readable"),
        F.try_variant_get("env", "$.data", "variant").alias("data")).checkpoint(eager=True)


def scan_status(parsed: DataFrame) -> DataFrame:
    """Per scan: ``landed`` envelopes, ``pages`` distinct ones, ``last_page`` (what the highest page says),
    ``missing`` pages of 1..last_page, ``doubled`` ones, ``first_gap`` (the first missing page), ``unreadable`` and ``complete``.
    """
    pages = parsed.where("readable AND page > 0")
    bits = pages.groupBy("scan", F.bitmap_bucket_number("page").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("page")).alias("bits"))
    found = bits.groupBy("scan").agg(F.sum(F.bitmap_count("bits")).alias("pages"))
    ends = parsed.groupBy("scan").agg(
        F.count(F.lit(1)).alias("landed"), F.sum((~F.col("readable")).cast("long")).alias("unreadable"),
        F.max(F.when(F.col("readable") & (F.col("page") > 0), F.struct("page", F.coalesce("last_page", "page").alias("last")))).alias("top"))
    last = F.coalesce(F.greatest(F.col("top.last"), F.col("top.page")), F.lit(0))
    status = ends.join(found, "scan", "left").select("scan", "landed", F.coalesce("pages", F.lit(0)).alias("pages"), last.alias("last_page"), "unreadable")
    status = status.withColumn("missing", F.col("last_page") - F.col("pages")).withColumn(
        "doubled", F.col("landed") - F.col("unreadable") - F.col("pages"))
    # the page after some page, or page 1, that is not there although there are pages to come
    heads = status.where("missing > 0").select("scan", F.lit(1).cast("long").alias("page"), "last_page")
    after = pages.join(status.where("missing > 0").select("scan", F.col("last_page").alias("_last")), "scan").select(
        "scan", (F.col("page") + 1).alias("page"), F.col("_last").alias("last_page"))
    gaps = heads.unionByName(after).where("page <= last_page").join(pages.select("scan", "page"), ["scan", "page"], "left_anti")
    first = gaps.groupBy("scan").agg(F.min("page").alias("first_gap"))
    complete = (F.col("missing") == 0) & (F.col("doubled") == 0) & (F.col("unreadable") == 0)
    return status.join(first, "scan", "left").withColumn("complete", complete)


def require_complete(parsed: DataFrame, max_pages: int | None = None) -> None:
    """Raise for the first scan, by key, that has too many pages, a gap, a double page or an unreadable one."""
    status = scan_status(parsed)
    broken = ~F.col("complete") if max_pages is None else (~F.col("complete") | (F.col("last_page") > max_pages))
    for s in status.where(broken).orderBy("scan").limit(1).collect():
        name = f"scan {s['scan']!r}: " if s["scan"] else ""
        if max_pages is not None and s["last_page"] > max_pages:
            raise ValueError(f"{name}more than {max_pages} pages")
        if s["unreadable"]:
            raise ValueError(f"{name}{s['unreadable']} pages are no JSON objects")
        if s["missing"]:
            raise ValueError(f"{name}incomplete page set: {s['pages']} pages of {s['last_page']}, the first missing is {s['first_gap']}")
        raise ValueError(f"{name}{s['doubled']} pages landed twice")


def items_of(parsed: DataFrame) -> DataFrame:
    """``scan, page, pos, item`` - ``pos`` is the reading order ``(scan, page, place in the page)``.

    ``data`` null or absent gives no rows, an array its elements, any other value one row.
    """
    data = kind(F.col("data"))
    items = F.when(data.startswith("ARRAY"), F.try_variant_get("data", "$", "array<variant>")).when(data != "NULL", F.array(F.col("data")))
    return parsed.select("scan", "page", F.posexplode(items).alias("place", "item")).select(
        "scan", "page", F.struct("scan", "page", "place").alias("pos"), "item")


def with_file_position(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Reading order of rows from files: ``(folder, part number, file name, split, row)`` as a sortable struct.

    To be called on the scan itself, before rows are moved or dropped.
    """
    path = F.col("_metadata.file_path")
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    return rows.withColumn(name, F.struct(
        F.regexp_extract(path, r"^(.*/)?[^/]*$", 1).alias("folder"), F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long").alias("part"),
        file.alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")))
