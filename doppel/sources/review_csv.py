"""Review CSV sink and source.

The sink writes the canonical 10-column review file: UTF-8 BOM, comma,
RFC-4180 quoting (doubled quotes), empty cells unquoted, rows in cluster
order. Spark writes one part file per partition of the sorted rows, each with
the header; read in name order the parts are the file order.

The source reads a human-edited review back: the delimiter is detected from
the header line (``,`` ``;`` TAB: of those whose header names a DupID and an
ID column, the one with most columns, ties to the earlier), header aliases
are resolved case-insensitively (first alias found wins, a repeated name
resolves to its last column), ragged rows are allowed, all-blank rows are
skipped but keep their line number, and DupID / ID must be positive integers. How records
with line breaks in quoted cells are found is told in ``csv_records``.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doppel.functions.normalize import utrim
from doppel.operators.ranking import dense_number
from doppel.session import ensure_checkpoint_dir
from doppel.sources.csv_records import BOM, read_records

# The canonical header, in column order.
REVIEW_HEADER = ["DupID", "ID", "Vorname", "Nachname", "E-Mail", "Straße", "Stadt", "Standort",
                 "Erstellungsdatum", "Einladungsstatus"]

# Accepted header aliases per field (lower case), first found wins.
HEADER_ALIASES = {
    "dup_id": ["dupid", "dup_id", "gruppe"],
    "person_id": ["id", "person_id", "personid", "ct_id", "churchtools_id"],
    "first_name": ["firstname", "first_name", "vorname"],
    "last_name": ["lastname", "last_name", "nachname"],
    "email": ["email", "e-mail", "mail"],
    "street": ["straße", "strasse", "street", "address"],
    "city": ["stadt", "city", "ort"],
    "campus_name": ["standort", "campus", "campus_name"],
    "created_at": ["erstellungsdatum", "created_at", "createdat"],
    "invitation_status": ["einladungsstatus", "invitation_status", "status"],
}
TEXT_FIELDS = ["first_name", "last_name", "email", "street", "city", "campus_name", "created_at",
               "invitation_status"]
DELIMITERS = [",", ";", "\t"]


def write_review_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write review rows (``doppel.operators.enrich.REVIEW_COLUMNS``) sorted by cluster."""
    out = rows.orderBy("dup_id", "person_id").select(
        *[F.coalesce(F.col(src).cast("string"), F.lit("")).alias((BOM if i == 0 else "") + name)
          for i, (src, name) in enumerate(zip(
              ["dup_id", "person_id", "first_name", "last_name", "email", "street", "city",
               "campus_name", "created_at", "invitation_status"], REVIEW_HEADER))])
    (out.write.mode(mode)
        .option("header", True).option("sep", ",").option("quote", '"').option("escape", '"')
        .option("emptyValue", "").option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("encoding", "UTF-8")
        .csv(path))


def _normalize_name(name: str) -> str:
    return name.strip().removeprefix(BOM).lower()


def map_columns(header: list[str]) -> dict[str, int]:
    """Field -> column index."""
    index = {}
    for i, name in enumerate(header):
        index[_normalize_name(name)] = i  # a repeated name resolves to the last column
    out = {}
    for field, aliases in HEADER_ALIASES.items():
        for alias in aliases:
            if alias in index:
                out[field] = index[alias]
                break
    return out


def detect_delimiter(header_line: str) -> str:
    """S12 on the header line."""
    header_line = header_line.removeprefix(BOM)
    best, best_score = None, 0
    for delim in DELIMITERS:
        try:
            header = next(csv.reader(io.StringIO(header_line), delimiter=delim, skipinitialspace=True))
        except (csv.Error, StopIteration):
            continue
        cols = map_columns(header)
        if "dup_id" not in cols or "person_id" not in cols:
            continue
        if len(header) > best_score:
            best, best_score = delim, len(header)
    if best is None:
        raise ValueError("review CSV header unreadable or DupID/ID column missing")
    return best


def read_review_csv(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(rows, invalid)``.

    ``rows``: ``dup_id, person_id`` (bigint), the eight text fields (trimmed,
    ``''`` when the column is missing) and ``line``, the number of the record in the
    file (header = 1; blank records are skipped but counted, empty lines are neither).
    Quoted cells may hold line breaks. ``invalid``: ``line, reason`` for rows
    whose DupID or ID is not a positive integer, and for a quote that is never closed;
    with ``strict`` any such row raises, as the reference does.

    Of several files each has the header; their records count on in the order of the parts.
    """
    ensure_checkpoint_dir(spark)
    records, unclosed = read_records(spark, path)
    # read by the header, the checks and the rows: found once
    records = records.checkpoint(eager=True)
    first = records.where("first").orderBy("number").select("text").limit(1).collect()
    if not first:
        raise ValueError("review CSV is empty")
    sep = detect_delimiter(first[0]["text"])
    header = next(csv.reader(io.StringIO(first[0]["text"]), delimiter=sep, skipinitialspace=True))
    cols = map_columns(header)
    width = len(header)
    cells = F.from_csv("text", ", ".join(f"_c{i} string" for i in range(width)), {
        "sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE", "multiLine": "true"})
    # every file's header is a record without a line of its own, but for the first
    headers = F.sum(F.col("first").cast("long")).over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    starts = records.where("first").select("file", headers.alias("_headers"))
    line = (F.col("number") - F.col("_headers") + 1).cast("long").alias("line")
    raw = records.where("NOT first").join(starts, "file").select(line, cells.alias("c")).select("line", "c.*")

    def field(name):
        return utrim(F.col(f"_c{cols[name]}")) if name in cols else F.lit("")

    blank = F.lit(True)
    for i in range(width):
        blank = blank & (utrim(F.col(f"_c{i}")) == "")
    parsed = raw.where(~blank).select(
        "line",
        field("dup_id").alias("_dup_text"), field("person_id").alias("_id_text"),
        *[field(f).alias(f) for f in TEXT_FIELDS])
    parsed = (parsed.withColumn("dup_id", F.expr("try_cast(_dup_text AS BIGINT)"))
                    .withColumn("person_id", F.expr("try_cast(_id_text AS BIGINT)")))
    bad = (F.col("dup_id").isNull() | (F.col("dup_id") <= 0) | F.col("person_id").isNull() | (F.col("person_id") <= 0))
    invalid = parsed.where(bad).select(
        "line",
        F.when(F.col("_dup_text") == "", F.lit("DupID fehlt"))
         .when(F.col("dup_id").isNull() | (F.col("dup_id") <= 0), F.format_string("ungültige DupID \"%s\"", "_dup_text"))
         .when(F.col("_id_text") == "", F.lit("ID fehlt"))
         .otherwise(F.format_string("ungültige ID \"%s\"", "_id_text")).alias("reason"))
    cut = unclosed.join(starts, "file").select(line, F.lit("Anführungszeichen nicht geschlossen").alias("reason"))
    invalid = invalid.unionByName(cut)
    rows = parsed.where(~bad).select("dup_id", "person_id", *TEXT_FIELDS, "line")
    if strict:
        first_bad = invalid.orderBy("line").limit(1).collect()
        if first_bad:
            raise ValueError(f"zeile {first_bad[0]['line']}: {first_bad[0]['reason']}")
        if rows.isEmpty():
            raise ValueError("csv enthält keine datensätze")
    return rows, invalid


def group_review(rows: DataFrame) -> DataFrame:
    """Rows with their cluster's primary, size and position.

    The primary is the first row of the cluster in file order
    (``min_by(person_id, line)``); ``pos`` is the 1-based position inside the
    cluster, from a distributed numbering of ``(dup_id, line)``.
    """
    stats = rows.groupBy("dup_id").agg(F.min_by("person_id", "line").alias("primary_id"),
                                       F.min("line").alias("primary_line"),
                                       F.count(F.lit(1)).alias("n_rows"))
    order = dense_number(rows, ["dup_id", "line"], "_g")
    first = order.groupBy("dup_id").agg(F.min("_g").alias("_g0"))
    return (rows.join(order, ["dup_id", "line"]).join(first, "dup_id").join(stats, "dup_id")
            .withColumn("pos", (F.col("_g") - F.col("_g0") + 1).cast("long"))
            .drop("_g", "_g0"))
