"""Normalisation functions as native Spark Column builders.

Every builder takes and returns a ``Column`` so that it runs inside
whole-stage codegen; nothing here is a Python UDF. Missing text is treated as
blank everywhere (``coalesce(x, '')``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex with UNICODE_CHARACTER_CLASS: \s is Unicode white space, the same
# set the reference trims and splits on.
_UNI_WS_EDGES = r"(?U)^\s+|\s+$"
# A token is a maximal run of letters and decimal digits; every other
# character (punctuation, hyphen, dot, white space) separates tokens.
_TOKEN = r"[\p{L}\p{Nd}]+"

# City suffix markers, tried in this order (first hit wins).
CITY_SUFFIX_MARKERS = [
    "an der", "a.d.", "a. d.", "in der", "i.d.", "i. d.", "am", "a.", "im", "i.",
    "in", "bei", "b.", "ob der", "o.d.", "o. d.", "vor der", "v.d.", "v. d.",
    "unter", "u.",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """``''`` for null, else the value."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def utrim(c: Column | str) -> Column:
    """Trim Unicode white space on both ends (Spark ``trim`` only strips ' ')."""
    return F.regexp_replace(blank(c), _UNI_WS_EDGES, "")


def nonblank(c: Column | str) -> Column:
    return utrim(c) != ""


def normalize_email(c: Column | str) -> Column:
    """trim, lower."""
    return F.lower(utrim(c))


def name_tokens(c: Column | str) -> Column:
    """``array<string>`` of lower-cased letter/digit runs."""
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(_TOKEN), 0)


def normalize_name(c: Column | str) -> Column:
    """tokens joined by one space."""
    return F.array_join(name_tokens(c), " ")


def _rtrim_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"\.+$", "")


def city_parts(c: Column | str) -> Column:
    """``struct(main, by)`` - main locality and optional suffix.

    A ``/`` after the first character splits; otherwise the first marker of
    ``CITY_SUFFIX_MARKERS`` (list order) found as `` marker `` splits. Trailing
    dots are removed from the suffix.
    """
    v = F.lower(utrim(c))
    slash = F.instr(v, "/")
    branches = F.when(v == "", F.struct(F.lit("").alias("main"), F.lit("").alias("by")))
    branches = branches.when(
        slash > 1,
        F.struct(utrim(F.substring(v, F.lit(1), slash - 1)).alias("main"),
                 _rtrim_dots(utrim(F.substring(v, slash + 1, F.lit(1 << 30)))).alias("by")))
    for marker in CITY_SUFFIX_MARKERS:
        pad = f" {marker} "
        pos = F.instr(v, pad)
        branches = branches.when(
            pos > 0,
            F.struct(utrim(F.substring(v, F.lit(1), pos - 1)).alias("main"),
                     _rtrim_dots(utrim(F.substring(v, pos + len(pad), F.lit(1 << 30)))).alias("by")))
    return branches.otherwise(F.struct(v.alias("main"), F.lit("").alias("by")))


def normalize_street(c: Column | str) -> Column:
    """lower, ``ß``->``ss``, tokens, ``...str`` -> ``...strasse``, joined by a space."""
    tokens = F.regexp_extract_all(F.replace(F.lower(blank(c)), F.lit("ß"), F.lit("ss")), F.lit(_TOKEN), 0)
    canonical = F.transform(tokens, lambda t: F.regexp_replace(t, "str$", "strasse"))
    return F.array_join(canonical, " ")


def primary_email(email: Column | str, emails: Column | str | None = None) -> Column:
    """``email`` when non-blank, else the first non-blank ``emails[].email``; trimmed."""
    own = utrim(email)
    if emails is None:
        return own
    listed = F.filter(F.transform(_col(emails), lambda e: utrim(e["email"])), lambda e: e != "")
    return F.when(own != "", own).otherwise(F.coalesce(F.try_element_at(listed, F.lit(1)), F.lit("")))


def pair_key(a: Column | str, b: Column | str) -> Column:
    """F8: unordered pair as ``struct(lo, hi)``."""
    return F.struct(F.least(_col(a), _col(b)).alias("lo"), F.greatest(_col(a), _col(b)).alias("hi"))


def campus_search_key(c: Column | str) -> Column:
    """lower case, only ``a``-``z`` kept."""
    return F.regexp_replace(F.lower(blank(c)), "[^a-z]", "")


def plain_group_name(c: Column | str) -> Column:
    """strip HTML tags, collapse white space."""
    no_tags = F.regexp_replace(blank(c), "<[^>]*>", "")
    return utrim(F.regexp_replace(no_tags, r"(?U)\s+", " "))


def comma_names(c: Column | str) -> Column:
    """comma list -> trimmed, non-empty names."""
    return F.filter(F.transform(F.split(blank(c), ","), utrim), lambda t: t != "")


def normalize_invitation_status(c: Column | str) -> Column:
    return F.lower(utrim(c))


def export_status_label(status: Column | str, has_account: Column) -> Column:
    """pending -> Eingeladen, accepted or any account -> Registriert, else NEU."""
    s = normalize_invitation_status(status)
    return (F.when(s == "pending", "Eingeladen")
             .when(s == "accepted", "Registriert")
             .when(has_account, "Registriert")
             .otherwise("NEU"))


def format_export_date(c: Column | str) -> Column:
    """``YYYY-MM-DD...`` -> ``DD.MM.YYYY`` when the date prefix is valid, else unchanged (trimmed)."""
    v = utrim(c)
    prefix = F.substring(v, 1, 10)
    parsed = F.try_to_date(prefix, "yyyy-MM-dd")
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}") & parsed.isNotNull(),
                  F.date_format(parsed, "dd.MM.yyyy")).otherwise(v)
