"""Enrichment and export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.functions import normalize as N
from doppel.functions.predicates import has_account

# Overlay rule of F30 per column kind: text wins when non-blank, ids when > 0,
# flags when not null.
TEXT_FIELDS = ["first_name", "last_name", "email", "campus_name", "street", "city", "created_at",
               "invitation_status", "cms_user_id", "last_login", "consent_date", "accepted_security"]
ID_FIELDS = ["campus_id"]
FLAG_FIELDS = ["is_system_user", "is_allowed_to_login"]

REVIEW_COLUMNS = ["dup_id", "person_id", "first_name", "last_name", "email", "street", "city",
                  "campus_name", "created_at", "invitation_status"]


def last_record_per_id(persons: DataFrame, order_col: str | None = None) -> DataFrame:
    """One record per person id, the last one by ``order_col`` (a reading order, see ``sources.scans``).

    Without such a column the greatest record counts, so that the result is defined.
    """
    # an aggregate rather than a window: partial maxima are kept before the shuffle
    row = F.struct(*[F.col(c) for c in persons.columns])
    ordered = order_col is not None and order_col in persons.columns
    return persons.groupBy("person_id").agg((F.max_by(row, order_col) if ordered else F.max(row)).alias("_row")).select("_row.*")


def overlay_details(base: DataFrame, details: DataFrame) -> DataFrame:
    """F30 + J3: left join on person id, detail value wins when it is set.

    A list counts as set when it has an element. Columns that only ``details`` has are
    added; unmatched base rows pass through unchanged. Of several detail rows of one
    person the last one (by ``_pos``) counts.
    """
    details = last_record_per_id(details, "_pos")
    d_cols = [c for c in details.columns if c not in ("person_id", "_pos")]
    lists = {f.name for f in details.schema.fields if f.dataType.typeName() == "array"}
    d = details.select("person_id", *[F.col(c).alias(f"_d_{c}") for c in d_cols])
    joined = base.join(d, "person_id", "left")
    out = []
    for c in base.columns:
        if c not in d_cols:
            out.append(F.col(c))
            continue
        dc = F.col(f"_d_{c}")
        if c in ID_FIELDS:
            out.append(F.when(F.coalesce(dc, F.lit(0)) > 0, dc).otherwise(F.col(c)).alias(c))
        elif c in FLAG_FIELDS:
            out.append(F.coalesce(dc, F.col(c)).alias(c))
        elif c in lists:
            out.append(F.when(F.size(dc) > 0, dc).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(N.nonblank(dc), dc).otherwise(F.col(c)).alias(c))
    added = [F.col(f"_d_{c}").alias(c) for c in d_cols if c not in base.columns]
    return joined.select(*out, *added)


def campus_label(campus_name, campus_id, names_id, names_name):
    """Own campus name if non-blank, else the name for id > 0, else ''."""
    return (F.when(N.nonblank(campus_name), N.utrim(campus_name))
             .when(F.coalesce(campus_id, F.lit(0)) > 0, N.utrim(names_name))
             .otherwise(F.lit("")))


def export_rows(groups: DataFrame, persons: DataFrame, campuses: DataFrame,
                details: DataFrame | None = None) -> DataFrame:
    """One review row per cluster member.

    Matching used the list records; the exported row shows the detail
    overlay. The cluster set is not recomputed after the overlay.
    """
    members = groups.select("dup_id", "person_id")
    # only members are looked at: the semi join comes before the choice of the last record
    base = persons.join(members.select("person_id").distinct(), "person_id", "left_semi")
    base = last_record_per_id(base, "_pos")
    if details is not None:
        base = overlay_details(base, details)
    names = campuses.where(F.col("id") > 0).select(F.col("id").cast("long").alias("_cid"),
                                                  F.col("name").alias("_cname"))
    # the campus dimension joins on the planner's size estimate: broadcast
    # when below the broadcast threshold, a shuffle join otherwise
    enriched = base.join(names, F.col("campus_id") == F.col("_cid"), "left")
    campus_name = F.col("campus_name") if "campus_name" in base.columns else F.lit("")
    account = has_account(F.col("invitation_status"),
                          *[F.col(c) if c in base.columns else None
                            for c in ["is_system_user", "is_allowed_to_login", "cms_user_id",
                                      "accepted_security", "last_login", "consent_date"]])
    emails = F.col("emails") if "emails" in base.columns else None
    rows = enriched.select(
        "person_id",
        N.blank("first_name").alias("first_name"),
        N.blank("last_name").alias("last_name"),
        N.primary_email("email", emails).alias("email"),
        N.blank("street").alias("street"),
        N.blank("city").alias("city"),
        campus_label(campus_name, F.col("campus_id"), F.col("_cid"), F.col("_cname")).alias("campus_name"),
        N.format_export_date("created_at").alias("created_at"),
        N.export_status_label("invitation_status", account).alias("invitation_status"))
    return members.join(rows, "person_id").select(*REVIEW_COLUMNS)


def export_summary(review_rows: DataFrame) -> DataFrame:
    """Number of rows and clusters (zero clusters = nothing to export)."""
    return review_rows.agg(F.count(F.lit(1)).alias("n_rows"),
                           F.count_distinct("dup_id").alias("n_clusters"))
