"""Match predicates as boolean Column builders.

They read pre-normalised columns (see ``doppel.operators.pairs.person_features``):
``first_t``/``last_t`` (token arrays), ``city_main``/``city_by``, ``street_n``,
``email_n``, ``campus_id``. Byte-length tests use ``octet_length`` because the
reference compares byte lengths (``ö.`` is not an initial).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doppel.functions.normalize import blank, nonblank, utrim


def tokens_subset(small: Column, large: Column) -> Column:
    """Non-empty, not longer than ``large``, every token contained."""
    return (F.size(small) > 0) & (F.size(small) <= F.size(large)) & (F.size(F.array_except(small, large)) == 0)


def _token_matches_initial(x: Column, y: Column) -> Column:
    return (x == y) | ((F.octet_length(x) == 1) & y.startswith(x)) | ((F.octet_length(y) == 1) & x.startswith(y))


def initials_match(a: Column, b: Column) -> Column:
    """Same length, each position equal or a one-byte prefix of the other."""
    pairs = F.zip_with(a, b, _token_matches_initial)
    return (F.size(a) == F.size(b)) & F.forall(pairs, lambda ok: ok)


def first_names_match(a: Column, b: Column) -> Column:
    """Equal, subset either way, or initials."""
    return ((F.size(a) > 0) & (F.size(b) > 0)
            & ((a == b) | tokens_subset(a, b) | tokens_subset(b, a) | initials_match(a, b)))


def last_names_match(a: Column, b: Column) -> Column:
    """Equal or subset either way (no initials)."""
    return ((F.size(a) > 0) & (F.size(b) > 0)
            & ((a == b) | tokens_subset(a, b) | tokens_subset(b, a)))


def suffix_compatible(a_by: Column, b_by: Column) -> Column:
    """Suffix part of P10: blank on either side, equal, or a one-byte abbreviation."""
    return ((a_by == "") | (b_by == "") | (a_by == b_by)
            | ((F.octet_length(a_by) == 1) & (F.octet_length(b_by) > 1) & b_by.startswith(a_by))
            | ((F.octet_length(b_by) == 1) & (F.octet_length(a_by) > 1) & a_by.startswith(b_by)))


def city_equal(a_main: Column, a_by: Column, b_main: Column, b_by: Column) -> Column:
    """P10: main names non-blank and equal, suffixes compatible."""
    return (a_main != "") & (b_main != "") & (a_main == b_main) & suffix_compatible(a_by, b_by)


def shared_email_couple(a: dict, b: dict) -> Column:
    """P5: same non-empty e-mail, same campus, same city and street, first names differ."""
    return ((a["email_n"] != "") & (a["email_n"] == b["email_n"])
            & (a["campus_id"] == b["campus_id"])
            & city_equal(a["city_main"], a["city_by"], b["city_main"], b["city_by"])
            & (a["street_n"] != "") & (a["street_n"] == b["street_n"])
            & ~first_names_match(a["first_t"], b["first_t"]))


def persons_match(a: dict, b: dict) -> Column:
    """P4 for the ordered pair (a, b): the e-mail rule decides alone when both
    e-mails are equal and non-empty; otherwise address + first name, first +
    last name, or swapped names (``a.first`` vs ``b.last``)."""
    same_email = (a["email_n"] != "") & (a["email_n"] == b["email_n"])
    same_city = city_equal(a["city_main"], a["city_by"], b["city_main"], b["city_by"])
    same_street = (a["street_n"] != "") & (a["street_n"] == b["street_n"])
    first = first_names_match(a["first_t"], b["first_t"])
    return (F.when(same_email, ~shared_email_couple(a, b))
             .otherwise((same_city & same_street & first)
                        | (first & last_names_match(a["last_t"], b["last_t"]))
                        | (first_names_match(a["first_t"], b["last_t"])
                           & last_names_match(a["last_t"], b["first_t"]))))


def side(prefix: str) -> dict:
    """Columns of one side of a pair, named ``{prefix}{column}``."""
    names = ["email_n", "campus_id", "first_t", "last_t", "city_main", "city_by", "street_n"]
    return {n: F.col(f"{prefix}{n}") for n in names}


# Keywords of a duplicate relationship label.
DUPLICATE_LABEL_KEYWORDS = ["duplikat", "duplicate", "dublette"]


def duplicate_label(c: Column | str) -> Column:
    """Label of P12: contains one of the duplicate keywords (case-insensitive)."""
    lowered = F.lower(utrim(c))
    out = F.lit(False)
    for kw in DUPLICATE_LABEL_KEYWORDS:
        out = out | F.contains(lowered, F.lit(kw))
    return out


def relationship_type_matches(type_id: Column, name: Column, wanted: int) -> Column:
    """Wanted <= 0 -> any; equal id; or unknown id (0) with a duplicate label."""
    if wanted <= 0:
        return F.lit(True)
    return (type_id == F.lit(wanted)) | ((F.coalesce(type_id, F.lit(0)) == 0) & duplicate_label(name))


def has_account(status: Column, is_system_user: Column | None = None, is_allowed_to_login: Column | None = None,
                cms_user_id: Column | None = None, accepted_security: Column | None = None,
                last_login: Column | None = None, consent_date: Column | None = None) -> Column:
    """Status accepted/pending, a true login flag, or any non-blank account field."""
    s = F.lower(utrim(status))
    out = s.isin("accepted", "pending")
    for flag in (is_system_user, is_allowed_to_login):
        if flag is not None:
            out = out | F.coalesce(flag, F.lit(False))
    for text in (cms_user_id, accepted_security, last_login, consent_date):
        if text is not None:
            out = out | nonblank(text)
    return out


__all__ = [
    "blank", "tokens_subset", "initials_match", "first_names_match", "last_names_match",
    "suffix_compatible", "city_equal", "shared_email_couple", "persons_match", "side",
    "duplicate_label", "relationship_type_matches", "has_account",
]
