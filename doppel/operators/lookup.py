"""Lookups and listings.

Name searches take a list or a table of search texts and match it against a dimension
of any size through an index of substrings (``name_search``).

Where the reference takes the first record of several, rows with a column ``pos`` (their
reading order, see ``sources.scans``) give the first; without it the smallest value is
taken, so that results are defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.functions import normalize as N
from doppel.functions.predicates import DUPLICATE_LABEL_KEYWORDS
from doppel.operators.enrich import last_record_per_id
from doppel.operators.name_search import substring_counts, substring_hits

# Exact duplicate labels, in tie-break priority order.
DUPLICATE_NAME_PRIORITY = ["duplikat", "dublette", "duplicate"]
DEFAULT_DUPLICATE_TYPE_ID = 8


def _arguments(spark: SparkSession, values: list[str] | DataFrame, col: str = "arg") -> DataFrame:
    """``pos, col`` of a list, or of a table that has these columns."""
    if isinstance(values, DataFrame):
        return values.select("pos", col)
    return spark.createDataFrame(list(enumerate(values)), f"pos long, {col} string")


def _first(value: str, pos: bool) -> F.Column:
    return F.min_by(value, "pos") if pos else F.min(value)


# ----------------------------------------------------------------- campuses

def resolve_campus(campuses: DataFrame, searches: list[str] | DataFrame) -> DataFrame:
    """F10 + F9 + O5 per search text.

    ``choice``: ``all`` (all/alle/*), ``id`` (a positive integer), ``error``
    (an integer <= 0 or a blank search), otherwise the substring search over
    normalised names gives ``unique`` / ``none`` / ``ambiguous``.
    Columns: ``search, choice, campus_id, n_matches, candidates``.
    """
    spark = campuses.sparkSession
    args = _arguments(spark, searches, "search")
    raw = N.utrim("search")
    as_int = F.expr("try_cast(regexp_replace(search, '(?U)^\\\\s+|\\\\s+$', '') AS BIGINT)")
    key = N.campus_search_key(raw)
    args = args.select("pos", "search",
                       F.when(F.lower(raw).isin("all", "alle", "*"), F.lit("all"))
                        .when(as_int.isNotNull() & (as_int > 0), F.lit("id"))
                        .when(as_int.isNotNull() | (key == ""), F.lit("error"))
                        .otherwise(F.lit("search")).alias("kind"),
                       as_int.alias("as_int"), key.alias("needle"))
    names = campuses.select(F.col("id").cast("long").alias("cid"), F.col("name").alias("cname"),
                            N.campus_search_key("name").alias("ckey"))
    searched = args.where(F.col("kind") == "search")
    hits = substring_hits(names, searched, "ckey", "needle")
    per = hits.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n_matches"), F.min("cid").alias("only_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cid", "cname"))), lambda x: x["cname"]), ", ")
         .alias("candidates"))
    out = args.join(per, "pos", "left")
    n = F.coalesce("n_matches", F.lit(0))
    return out.select(
        "search",
        F.when(F.col("kind") != "search", F.col("kind"))
         .when(n == 1, F.lit("unique")).when(n == 0, F.lit("none")).otherwise(F.lit("ambiguous")).alias("choice"),
        F.when(F.col("kind") == "id", F.col("as_int"))
         .when((F.col("kind") == "search") & (n == 1), F.col("only_id")).alias("campus_id"),
        n.cast("long").alias("n_matches"),
        F.coalesce("candidates", F.lit("")).alias("candidates"))


# ------------------------------------------------------------------- groups

def group_table(memberships: DataFrame) -> DataFrame:
    """Distinct groups ``(group_id, group_name)`` seen in the membership edges; the first name of each."""
    return (memberships.where(F.col("group_id") > 0)
            .groupBy("group_id").agg(_first("group_name", "pos" in memberships.columns).alias("group_name")))


def find_groups_by_name(groups: DataFrame, names: list[str] | DataFrame) -> DataFrame:
    """O5 (FindGroupByName) per name: plain name contains the trimmed name, case-sensitive.

    ``names`` is a list or a table ``pos, name``. Columns: ``pos, name, n_matches, group_id``
    (``group_id`` only when unique).
    """
    spark = groups.sparkSession
    args = _arguments(spark, names, "name").withColumn("name", N.utrim("name")).where(F.col("name") != "")
    plain = groups.select("group_id", N.plain_group_name("group_name").alias("plain"))
    # counted per distinct name first: equal names times the groups they hit are never rows
    counts = substring_counts(plain, args, "plain", "name", "group_id")
    hits = args.join(counts.hint("merge"), F.col("name") == F.col("_needle"))
    per = hits.groupBy("pos").agg(F.sum("n_matches").alias("n_matches"), F.min("group_id").alias("gid"))
    out = args.join(per.hint("merge"), "pos", "left")
    n = F.coalesce("n_matches", F.lit(0)).cast("long")
    return out.select("pos", "name", n.alias("n_matches"), F.when(n == 1, F.col("gid")).alias("group_id"))


def first_resolving_group(groups: DataFrame, names: list[str]) -> DataFrame:
    """O6 (FindGroupByNames): first candidate (case-insensitive dedupe) that resolves uniquely."""
    seen, unique = set(), []
    for name in names:
        name = name.strip()
        if name and name.lower() not in seen:
            seen.add(name.lower())
            unique.append(name)
    found = find_groups_by_name(groups, unique).where(F.col("n_matches") == 1)
    return found.agg(F.min_by("group_id", "pos").alias("group_id"), F.min_by("name", "pos").alias("name")) \
        .where(F.col("group_id").isNotNull())


def person_groups(memberships: DataFrame) -> DataFrame:
    """A person's groups, one row per (person, group id), plain names.

    Records without a name are passed over; a name that is only markup shows as blank.
    """
    ordered = "pos" in memberships.columns
    return (memberships
            .where((F.col("group_id") > 0) & N.nonblank("group_name"))
            .select(F.col("person_id").cast("long"), F.col("group_id").cast("long"),
                    N.plain_group_name("group_name").alias("group_name"), *(["pos"] if ordered else []))
            .groupBy("person_id", "group_id").agg(_first("group_name", ordered).alias("group_name")))


# ------------------------------------------------------------- persons

def persons_by_campus(persons: DataFrame, campus_id: int = 0, status_id: int = 0) -> DataFrame:
    """Campus and status filters, each only if above 0; pushed to the scan."""
    for column, wanted in (("campus_id", campus_id), ("status_id", status_id)):
        if wanted > 0:
            persons = persons.where(F.col(column) == F.lit(wanted))
    return persons


def group_member_ids(memberships: DataFrame, group_id: int) -> DataFrame:
    """Distinct positive person ids of one group."""
    return (memberships.where((F.col("group_id") == F.lit(group_id)) & (F.col("person_id") > 0))
            .select(F.col("person_id").cast("long")).distinct())


def persons_by_group(persons: DataFrame, memberships: DataFrame, group_id: int) -> DataFrame:
    """S3 with a group filter: the group's members replace any id list."""
    return persons.join(group_member_ids(memberships, group_id), "person_id", "left_semi")


def persons_by_ids(persons: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids(pos, person_id)`` -> person rows in list order; unknown ids dropped, repeats kept.

    Of several records of a person the last one (by ``_pos``) counts. The rows are dealt by
    ranges of the list's places, so written files read in order are the list's order.
    """
    wanted = persons.join(ids.select("person_id").distinct(), "person_id", "left_semi")
    return ids.join(last_record_per_id(wanted, "_pos").drop("_pos"), "person_id").orderBy("pos")


# ------------------------------------------------------- relationship types

def _label_score(label) -> F.Column:
    low = F.lower(N.utrim(label))
    kw = F.lit(0)
    for k in DUPLICATE_LABEL_KEYWORDS:
        kw = F.greatest(kw, F.when(F.contains(low, F.lit(k)), F.lit(50 + len(k)) - F.octet_length(low))
                        .otherwise(F.lit(0)))
    return (F.when(low == "", F.lit(0))
             .when(low.isin(*DUPLICATE_NAME_PRIORITY), F.lit(100))
             .otherwise(kw))


def relationship_types(types: DataFrame) -> DataFrame:
    """S10 + F31 + F15: ``id, name`` (display name), ``score``, ``prio``; ids <= 0 dropped."""
    t = types.where(F.col("id") > 0)
    pos = ["pos"] if "pos" in types.columns else []
    display = (F.when(N.nonblank("name"), N.utrim("name"))
                .when(N.nonblank("export_title"), N.utrim("export_title"))
                .otherwise(F.format_string("ID %d", F.col("id"))))
    score = F.greatest(*[_label_score(F.col(c)) for c in ["name", "degree_name_a", "degree_name_b", "export_title"]])
    low_name = F.lower(N.utrim("name"))
    prio = F.lit(len(DUPLICATE_NAME_PRIORITY))
    for i, p in reversed(list(enumerate(DUPLICATE_NAME_PRIORITY))):
        prio = F.when(low_name == p, F.lit(i)).otherwise(prio)
    return t.select(F.col("id").cast("int").alias("id"), display.alias("name"),
                    score.cast("int").alias("score"), prio.cast("int").alias("prio"), *pos)


def pick_duplicate_type(types: DataFrame) -> DataFrame:
    """A8 + F16: best score, then name priority, then lowest id. Empty when no type scores."""
    scored = relationship_types(types).where(F.col("score") > 0)
    order = F.struct((-F.col("score")).alias("s"), F.col("prio"), F.col("id"))
    return scored.agg(F.min_by(F.struct("id", "name", "score"), order).alias("best")) \
        .where(F.col("best").isNotNull()).select("best.id", "best.name", "best.score")


def resolve_duplicate_types(types: DataFrame, requests: DataFrame) -> DataFrame:
    """F17 for a table of requests ``req, type_id, default_id, name``, as one plan without driver actions.

    Rules in order: an id above 0 must exist; else the default id if it exists; else a
    name, compared with display names regardless of case, must have one match; else the best
    score. Columns: ``req, outcome, id, name, n_matches, candidates`` - ``outcome`` is the
    rule that found the type, or ``id missing``, ``name missing``, ``name ambiguous``,
    ``none``; ``candidates`` lists the matches of an ambiguous name as the message does.
    """
    listing = relationship_types(types)
    order = F.col("pos") if "pos" in listing.columns else F.struct("id", "name")
    listing = listing.withColumn("_order", order)
    by_id = listing.groupBy("id").agg(F.min_by("name", "_order").alias("name"))
    entry = F.struct("_order", F.format_string('"%s" (ID %d)', "name", "id").alias("text"), "id", "name")
    by_name = listing.groupBy(F.lower("name").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min(entry).alias("one"), F.sort_array(F.collect_list(entry)).alias("all"))
    best = pick_duplicate_type(types).select(F.struct("id", "name").alias("best"), F.lit(1).alias("one_row"))
    asked = requests.select(
        "req", F.coalesce(F.col("type_id").cast("long"), F.lit(0)).alias("want"), F.col("default_id").cast("long").alias("default_id"),
        N.utrim("name").alias("want_name"), F.lit(1).alias("one_row"))
    out = (asked.join(by_id.select(F.col("id").cast("long").alias("want"), F.struct("id", "name").alias("own")), "want", "left")
           .join(by_id.select(F.col("id").cast("long").alias("default_id"), F.struct("id", "name").alias("default")), "default_id", "left")
           .join(by_name.withColumnRenamed("key", "want_key"), (F.lower("want_name") == F.col("want_key")) & (F.col("want_name") != ""), "left")
           .join(best, "one_row", "left"))
    n = F.coalesce("n", F.lit(0))
    found = (F.when(F.col("want") > 0, F.when(F.col("own").isNotNull(), F.lit("id")).otherwise(F.lit("id missing")))
              .when(F.col("default").isNotNull(), F.lit("default"))
              .when(F.col("want_name") != "", F.when(n == 1, F.lit("name")).when(n == 0, F.lit("name missing")).otherwise(F.lit("name ambiguous")))
              .when(F.col("best").isNotNull(), F.lit("score")).otherwise(F.lit("none")))
    pick = (F.when(found == "id", F.col("own")).when(found == "default", F.col("default"))
             .when(found == "name", F.struct(F.col("one.id").alias("id"), F.col("one.name").alias("name"))).when(found == "score", F.col("best")))
    listed = F.when(found == "name ambiguous", F.array_join(F.transform("all", lambda x: x["text"]), ", ")).otherwise(F.lit(""))
    return out.select("req", found.alias("outcome"), pick.alias("t"), F.when(found.startswith("name"), n).otherwise(F.lit(0)).cast("long").alias("n_matches"),
                      listed.alias("candidates")).select("req", "outcome", "t.id", "t.name", "n_matches", "candidates")


def resolve_duplicate_type(types: DataFrame, type_id: int | None = None,
                           default_id: int | None = DEFAULT_DUPLICATE_TYPE_ID,
                           name: str | None = None) -> DataFrame:
    """F17 for one request: a row ``id, name, rule``; raises where the reference reports an error."""
    request = types.sparkSession.createDataFrame([(1, type_id, default_id, name)], "req int, type_id long, default_id long, name string")
    got = resolve_duplicate_types(types, request)
    row = got.first()
    shown = (name or "").strip()
    failed = {"id missing": f"Beziehungstyp mit ID {type_id} nicht gefunden", "name missing": f"Beziehungstyp \"{shown}\" nicht gefunden",
              "name ambiguous": f"mehrere Beziehungstypen passen zu \"{shown}\": {row.candidates}",
              "none": "Beziehungstyp für Duplikate nicht gefunden"}
    if row.outcome in failed:
        raise LookupError(failed[row.outcome])
    return got.select("id", "name", F.col("outcome").alias("rule"))
