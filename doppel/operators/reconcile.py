"""Reconcile an edited review with existing links and memberships.

Input review rows carry ``dup_id, person_id, line``. Outputs:

* ``results``: one row per cluster - ``dup_id, primary_id, success, linked,
  already_linked, vorgemerkt, status, message`` (ImportResult, F18, F19);
* ``links``: the links to create (S17) - ``person_id, related_person_id,
  relationship_type_id``; already existing ones are not repeated, so a re-run
  is idempotent;
* ``memberships``: primaries to add to the duplicate group (S18);
* ``summary``: A5.

The reference walks clusters in DupID order and rows in file order, with side
effects. Here every effect is an aggregate: the primary is
``min_by(person_id, line)``; a link found "already there" because an earlier
row of the same run created it (W4) is the non-first occurrence of its
canonical pair in ``(dup_id, line)`` order; rows after an invalid row of a
cluster are not processed (apply mode). No per-cluster window is used, so a
cluster holding a large share of all rows is still spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.functions import normalize as N
from doppel.functions.predicates import relationship_type_matches
from doppel.operators.ranking import running_sum

DEFAULT_GROUP_NAME = "Duplikate"


# Texts of the dry-run message, in pieces around the lists of ids.
MESSAGES = {
    "too_small": "übersprungen: weniger als zwei Personen",
    "failed": "Beziehungen prüfen fehlgeschlagen: ungültige Personen-IDs für Duplikat-Prüfung",
    "all_head": "Dry-Run: Person %d ist bereits mit ", "all_tail": " verknüpft",
    "some_head": "Dry-Run: Person %d mit ", "some_between": " verknüpfen (", "some_tail": " bereits verknüpft)",
    "none_head": "Dry-Run: würde Person %d mit ", "none_tail": " verknüpfen",
    "in_group": "; Person %d bereits in Gruppe %s", "to_group": "; Person %d würde in Gruppe %s aufgenommen",
}


@dataclass
class ReconcileResult:
    results: DataFrame
    links: DataFrame
    memberships: DataFrame
    summary: DataFrame


def existing_duplicate_pairs(relationships: DataFrame, rel_type_id: int) -> DataFrame:
    """Canonical ``(lo, hi)`` pairs already linked as duplicates (either direction)."""
    return (relationships
            .where(relationship_type_matches(F.col("relationship_type_id"), F.col("name"), rel_type_id))
            .where(F.col("person_id") != F.col("related_person_id"))
            .select(F.least("person_id", "related_person_id").cast("long").alias("lo"),
                    F.greatest("person_id", "related_person_id").cast("long").alias("hi"))
            .distinct())


def resolve_group(memberships: DataFrame, group_name: str) -> DataFrame:
    """O5 (FindGroupByName): groups whose plain name contains ``group_name`` (case-sensitive).

    Returns ``(n_matches, group_id)``; the group resolves when ``n_matches == 1``.
    """
    want = _wanted(group_name)
    groups = memberships.select("group_id", "group_name").dropDuplicates(["group_id"])
    hits = groups.where(F.contains(N.plain_group_name("group_name"), F.lit(want)))
    return hits.agg(F.count(F.lit(1)).alias("n_matches"), F.min("group_id").alias("group_id"))


def members_of_named_group(memberships: DataFrame, group_name: str) -> DataFrame:
    """Person ids whose groups' lower plain name contains the lower wanted name."""
    want = _wanted(group_name).lower()
    return (memberships
            .where(F.contains(F.lower(N.plain_group_name("group_name")), F.lit(want)))
            .select(F.col("person_id").cast("long").alias("person_id")).distinct())


def _wanted(group_name: str) -> str:
    """A blank group name means the default one."""
    return group_name.strip() or DEFAULT_GROUP_NAME


def _q(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _ids(cond, order="line", col="person_id"):
    """Comma list of ``col`` over rows matching ``cond``, in row order."""
    return F.array_join(F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(order), F.col(col))))),
        lambda x: x[col].cast("string")), ", ")


def reconcile(review: DataFrame, relationships: DataFrame, memberships: DataFrame,
              rel_type_id: int = 8, dry_run: bool = True, skip_group_add: bool = False,
              group_name: str = DEFAULT_GROUP_NAME, groups: DataFrame | None = None) -> ReconcileResult:
    """See the module's docstring. ``groups`` (``group_id, group_name``) lists all groups (S6);
    without it only groups that have a member are known."""
    rows = review.select(F.col("dup_id").cast("long"), F.col("person_id").cast("long"), F.col("line").cast("long"))
    stats = rows.groupBy("dup_id").agg(F.min_by("person_id", "line").alias("primary_id"),
                                       F.min("line").alias("primary_line"),
                                       F.count(F.lit(1)).alias("n_rows"))
    others = (rows.join(stats, "dup_id")
              .where((F.col("line") != F.col("primary_line")) & (F.col("n_rows") >= 2))
              .withColumn("invalid", F.col("person_id") == F.col("primary_id"))
              .withColumn("lo", F.least("primary_id", "person_id"))
              .withColumn("hi", F.greatest("primary_id", "person_id")))
    # first invalid row of a cluster (other == primary): the check fails there
    bad = others.where("invalid").groupBy("dup_id").agg(F.min("line").alias("bad_line"),
                                                        F.min_by("person_id", "line").alias("bad_id"))
    existing = existing_duplicate_pairs(relationships, rel_type_id).withColumn("exists", F.lit(True))
    others = (others.join(bad, "dup_id", "left")
              .join(existing, ["lo", "hi"], "left")
              .withColumn("exists", F.coalesce("exists", F.lit(False))))
    group_members = members_of_named_group(memberships, group_name).withColumn("in_group", F.lit(True))
    gname = _q(_wanted(group_name))

    if dry_run:
        per = others.groupBy("dup_id").agg(
            F.count(F.lit(1)).alias("n_others"),
            F.sum(F.col("exists").cast("long")).alias("n_exist"),
            F.max(F.col("bad_line").isNotNull()).alias("failed"),
            _ids(~F.col("exists")).alias("to_link"),
            _ids(F.col("exists")).alias("linked_ids"))
        res = (stats.join(per, "dup_id", "left")
               .join(group_members, stats["primary_id"] == group_members["person_id"], "left")
               .drop("person_id"))
        in_group = F.coalesce("in_group", F.lit(False)) & F.lit(not skip_group_add)
        note = (F.lit("") if skip_group_add else
                F.when(in_group, F.format_string("; Person %d bereits in Gruppe %s", "primary_id", F.lit(gname)))
                 .otherwise(F.format_string("; Person %d würde in Gruppe %s aufgenommen", "primary_id", F.lit(gname))))
        too_small = F.col("n_rows") < 2
        failed = F.coalesce("failed", F.lit(False))
        msg = (F.when(too_small, F.lit("übersprungen: weniger als zwei Personen"))
                .when(failed, F.lit("Beziehungen prüfen fehlgeschlagen: ungültige Personen-IDs für Duplikat-Prüfung"))
                .when((F.col("n_exist") > 0) & (F.col("n_exist") == F.col("n_others")),
                      F.format_string("Dry-Run: Person %d ist bereits mit %s verknüpft%s", "primary_id", "linked_ids", note))
                .when(F.col("n_exist") > 0,
                      F.format_string("Dry-Run: Person %d mit %s verknüpfen (%s bereits verknüpft)%s",
                                      "primary_id", "to_link", "linked_ids", note))
                .otherwise(F.format_string("Dry-Run: würde Person %d mit %s verknüpfen%s", "primary_id", "to_link", note)))
        ok = ~too_small & ~failed
        results = res.select(
            "dup_id",
            F.when(too_small, F.lit(0)).otherwise(F.col("primary_id")).cast("long").alias("primary_id"),
            ok.alias("success"),
            F.when(ok, F.col("n_others") - F.col("n_exist")).otherwise(F.lit(0)).cast("long").alias("linked"),
            F.when(ok, F.col("n_exist")).otherwise(F.lit(0)).cast("long").alias("already_linked"),
            (ok & in_group).alias("vorgemerkt"),
            too_small.alias("too_small"),
            msg.alias("message"))
        links = rows.sparkSession.createDataFrame([], "person_id bigint, related_person_id bigint, relationship_type_id int")
        memberships_out = rows.sparkSession.createDataFrame([], "person_id bigint, group_id bigint")
    else:
        # rows processed in apply mode: up to (excluding) the first invalid row
        processed = others.where(F.col("bad_line").isNull() | (F.col("line") < F.col("bad_line")))
        first_seen = (processed.groupBy("lo", "hi")
                      .agg(F.min(F.struct("dup_id", "line")).alias("_first")))
        processed = (processed.join(first_seen, ["lo", "hi"])
                     .withColumn("creates", ~F.col("exists") & (F.col("_first") == F.struct("dup_id", "line"))))
        per = processed.groupBy("dup_id").agg(
            F.sum(F.col("creates").cast("long")).alias("n_new"),
            F.sum((~F.col("creates")).cast("long")).alias("n_already"))
        fails = bad.select("dup_id", "bad_id")
        # one aggregate row: how many groups the target name resolves to
        grp = resolve_group(groups if groups is not None else memberships, group_name).first()
        n_matches, target_group = int(grp["n_matches"]), grp["group_id"]
        res = stats.join(per, "dup_id", "left").join(fails, "dup_id", "left")
        too_small = F.col("n_rows") < 2
        failed_check = F.col("bad_id").isNotNull()
        group_fail = F.lit(not skip_group_add and n_matches != 1)
        group_msg = F.lit(f"Gruppe {gname}: Gruppe nicht gefunden: {gname}" if n_matches == 0
                          else f"Gruppe {gname}: mehrere Gruppen passen zu {gname}")
        note = F.lit("") if skip_group_add else F.format_string("; Person %d in Gruppe %s", "primary_id", F.lit(gname))
        n_new = F.coalesce("n_new", F.lit(0))
        n_already = F.coalesce("n_already", F.lit(0))
        ok = ~too_small & ~failed_check & ~group_fail
        msg = (F.when(too_small, F.lit("übersprungen: weniger als zwei Personen"))
                .when(failed_check, F.format_string(
                    "Beziehung %d -> %d prüfen fehlgeschlagen: ungültige Personen-IDs für Duplikat-Prüfung",
                    "primary_id", "bad_id"))
                .when(group_fail, group_msg)
                .when((n_new > 0) & (n_already > 0),
                      F.format_string("Person %d: %d Beziehung(en) angelegt, %d bereits vorhanden%s",
                                      "primary_id", n_new, n_already, note))
                .when(n_already == F.col("n_rows") - 1,
                      F.format_string("Person %d: alle %d Duplikat-Beziehung(en) bereits vorhanden%s",
                                      "primary_id", n_already, note))
                .otherwise(F.format_string("Person %d mit %d Dublette(n) verknüpft%s", "primary_id", n_new, note)))
        results = res.select(
            "dup_id",
            F.when(too_small, F.lit(0)).otherwise(F.col("primary_id")).cast("long").alias("primary_id"),
            ok.alias("success"),
            F.when(ok, n_new).otherwise(F.lit(0)).cast("long").alias("linked"),
            F.when(ok, n_already).otherwise(F.lit(0)).cast("long").alias("already_linked"),
            F.lit(False).alias("vorgemerkt"),
            too_small.alias("too_small"),
            msg.alias("message"))
        links = (processed.where("creates")
                 .select(F.col("primary_id").alias("person_id"), F.col("person_id").alias("related_person_id"),
                         F.lit(rel_type_id).cast("int").alias("relationship_type_id")))
        if skip_group_add or n_matches != 1:
            memberships_out = rows.sparkSession.createDataFrame([], "person_id bigint, group_id bigint")
        else:
            already = memberships.select(F.col("person_id").cast("long"), F.col("group_id").cast("long"))
            memberships_out = (results.where("success")
                               .select(F.col("primary_id").alias("person_id"),
                                       F.lit(target_group).cast("long").alias("group_id"))
                               .join(already, ["person_id", "group_id"], "left_anti")
                               .distinct())

    status = (F.when(~F.col("success"), F.when(F.col("too_small"), F.lit("skipped")).otherwise(F.lit("failed")))
               .when((F.col("linked") == 0) & (F.col("already_linked") > 0), F.lit("skipped"))
               .when(F.col("vorgemerkt"), F.lit("skipped"))
               .otherwise(F.lit("ok")))
    results = results.withColumn("status", status).drop("too_small")
    return ReconcileResult(results, links, memberships_out, summarize(results))


def dry_run_messages(review: DataFrame, relationships: DataFrame, memberships: DataFrame, rel_type_id: int = 8,
                     skip_group_add: bool = False, group_name: str = DEFAULT_GROUP_NAME, chunk: int = 4000) -> DataFrame:
    """F19 in pieces: ``dup_id, section, chunk, text``; a cluster's texts in that order are its dry-run message.

    The ids of a cluster's others are cut into chunks of about ``chunk`` characters by prefix
    sums of their lengths, taken in ranges, so that no row and no task grows with a cluster.
    """
    rows = review.select(F.col("dup_id").cast("long"), F.col("person_id").cast("long"), F.col("line").cast("long"))
    stats = rows.groupBy("dup_id").agg(F.min_by("person_id", "line").alias("primary_id"), F.min("line").alias("primary_line"),
                                       F.count(F.lit(1)).alias("n_rows"))
    others = rows.join(stats, "dup_id").where((F.col("line") != F.col("primary_line")) & (F.col("n_rows") >= 2))
    others = others.withColumn("lo", F.least("primary_id", "person_id")).withColumn("hi", F.greatest("primary_id", "person_id"))
    existing = existing_duplicate_pairs(relationships, rel_type_id).withColumn("exists", F.lit(True))
    others = others.join(existing, ["lo", "hi"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    per = others.groupBy("dup_id").agg(F.count(F.lit(1)).alias("n_others"), F.sum(F.col("exists").cast("long")).alias("n_exist"),
                                       F.max(F.col("person_id") == F.col("primary_id")).alias("failed"))
    in_group = members_of_named_group(memberships, group_name).select(F.col("person_id").alias("primary_id"), F.lit(True).alias("in_group"))
    heads = stats.join(per, "dup_id", "left").join(in_group, "primary_id", "left")
    name = F.lit(_q(_wanted(group_name)))
    note = F.lit("") if skip_group_add else F.when(F.col("in_group"), F.format_string(MESSAGES["in_group"], "primary_id", name)).otherwise(
        F.format_string(MESSAGES["to_group"], "primary_id", name))
    small, failed = F.col("n_rows") < 2, F.coalesce("failed", F.lit(False))
    all_there, some_there = F.col("n_exist") == F.col("n_others"), F.col("n_exist") > 0

    def with_primary(text: str):
        return F.format_string(text, "primary_id")

    # section 0: head, 1: ids to link, 2: text between, 3: ids already linked, 4: tail
    head = (F.when(small, F.lit(MESSAGES["too_small"])).when(failed, F.lit(MESSAGES["failed"])).when(all_there, with_primary(MESSAGES["all_head"]))
             .when(some_there, with_primary(MESSAGES["some_head"])).otherwise(with_primary(MESSAGES["none_head"])))
    between = F.when(some_there & ~all_there, F.lit(MESSAGES["some_between"])).otherwise(F.lit(""))
    tail = F.concat(F.when(all_there, F.lit(MESSAGES["all_tail"])).when(some_there, F.lit(MESSAGES["some_tail"])).otherwise(F.lit(MESSAGES["none_tail"])), note)
    fixed = F.when(small | failed, F.array(F.struct(F.lit(0).alias("section"), head.alias("text")))).otherwise(
        F.array(*[F.struct(F.lit(i).alias("section"), t.alias("text")) for i, t in ((0, head), (2, between), (4, tail))]))
    texts = heads.select("dup_id", F.explode(fixed).alias("t")).select("dup_id", "t.section", F.lit(0).cast("long").alias("chunk"), "t.text").where("text <> ''")

    good = heads.where(~small & ~failed).select("dup_id")
    ids = others.join(good, "dup_id", "left_semi").select(
        "dup_id", F.when(F.col("exists"), 3).otherwise(1).alias("section"), "line", F.col("person_id").cast("string").alias("text"))
    # every id but a list's first has a separator before it; the first one's is taken off at the end
    placed = running_sum(ids.withColumn("size", F.length("text") + 2), ["dup_id", "section", "line"], "size", "before")
    starts = placed.groupBy("dup_id", "section").agg(F.min("before").alias("start"))
    cut = placed.join(starts, ["dup_id", "section"]).withColumn("chunk", F.floor((F.col("before") - F.col("start")) / chunk))
    lists = cut.groupBy("dup_id", "section", "chunk").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: x["text"]), ", ")
    lists = lists.select("dup_id", "section", "chunk", F.concat(F.when(F.col("chunk") > 0, F.lit(", ")).otherwise(F.lit("")), joined).alias("text"))
    return texts.unionByName(lists)


def summarize(results: DataFrame) -> DataFrame:
    """A5: ok / skipped / failed counts; linked total over ok, existing total over ok + skipped."""
    st = F.col("status")
    return results.agg(
        F.sum((st == "ok").cast("long")).alias("n_ok"),
        F.sum((st == "skipped").cast("long")).alias("n_skipped"),
        F.sum((st == "failed").cast("long")).alias("n_failed"),
        F.coalesce(F.sum(F.when(st == "ok", F.col("linked"))), F.lit(0)).cast("long").alias("linked_total"),
        F.coalesce(F.sum(F.when(st != "failed", F.col("already_linked"))), F.lit(0)).cast("long").alias("existing_total"),
        F.coalesce(F.max(st == "failed"), F.lit(False)).alias("any_failed"))
