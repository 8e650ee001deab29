"""Registered queries: landed API JSON -> typed tables.

Spark renders the fixture tables as API-style JSON (key spellings varied per
row, 100 items per page envelope), and the ingest jobs parse them back. The
oracles state the expected typed rows directly over the fixture tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.functions import normalize as N
from doppel.plans import duck as D
from doppel.sources.fixtures import fixture, fixture_cte
from doppel.operators.enrich import last_record_per_id
from doppel.operators.lookup import relationship_types
from doppel.operators.ranking import dense_number
from doppel.sources.fixtures import read_table
from doppel.sources.ingest import (checked_persons, decode_groups, decode_id_names, decode_members, decode_persons,
                                   decode_relationships, first_filled_source, load_persons, page_items)
from doppel.sources.scans import parse_envelopes, scan_status
from doppel.session import ensure_checkpoint_dir

PAGE_SIZE = 100


def person_json(persons: DataFrame) -> DataFrame:
    """``(person_id, json)``: camelCase, snake_case, nested and German key spellings by id % 4."""
    pid = F.col("person_id")
    v0 = F.to_json(F.struct(pid.alias("id"), F.col("first_name").alias("firstName"), F.col("last_name").alias("lastName"),
                            "email", "street", "city", F.col("campus_id").alias("campusId"),
                            F.col("created_at").alias("createdAt"), F.col("invitation_status").alias("invitationStatus"),
                            (pid % 3 == 0).alias("isSystemUser")))
    v1 = F.to_json(F.struct(pid.alias("id"), F.col("first_name").alias("firstName"), F.col("last_name").alias("lastName"),
                            F.array(F.struct(F.col("email"), F.lit(True).alias("isDefault"), F.lit(1).alias("contactLabelId")))
                             .alias("emails"),
                            F.col("street").alias("strasse"), F.col("city").alias("stadt"),
                            F.col("campus_id").cast("string").alias("campus_id"), "created_at", "invitation_status",
                            (pid % 2).cast("int").alias("is_system_user")))
    v2 = F.to_json(F.struct(pid.alias("id"), F.col("first_name").alias("firstName"), F.col("last_name").alias("lastName"),
                            "email",
                            F.array(F.struct(F.lit("").alias("street"), F.lit(" ").alias("place")),
                                    F.struct(F.col("street").alias("street"), F.col("city").alias("place"))).alias("addresses"),
                            F.struct(F.col("campus_id").alias("id"), F.concat(F.lit(" Campus "), F.col("campus_id").cast("string"))
                                     .alias("name")).alias("campus"),
                            F.struct(F.col("created_at").alias("createdDate")).alias("meta"),
                            F.array(F.struct(F.lit("").alias("date")), F.struct(F.lit("2024-01-15").alias("date")))
                             .alias("privacyPolicyAgreement")))
    v3 = F.to_json(F.struct(pid.alias("id"), F.col("first_name").alias("firstName"), F.col("last_name").alias("lastName"),
                            "email", F.col("street").alias("straße"), F.struct(F.col("city").alias("city")).alias("homeAddress"),
                            "campus_id", F.col("created_at").alias("cdate"),
                            F.struct(F.lit("2024-01-15").alias("date")).alias("acceptedSecurity"),
                            F.lit("true").alias("isAllowedToLogin")))
    k = pid % 4
    return persons.select("person_id", F.when(k == 0, v0).when(k == 1, v1).when(k == 2, v2).otherwise(v3).alias("json"))


def envelopes(items: DataFrame, key: str = "person_id") -> DataFrame:
    """Page envelopes of ``PAGE_SIZE`` items; one line of text per page (at most 100 items each)."""
    paged = items.withColumn("page", (F.floor((F.col(key) - 1) / PAGE_SIZE) + 1).cast("long"))
    last = paged.agg(F.max("page")).first()[0] or 0
    pages = paged.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "json"))),
                                                               lambda x: x["json"]), ",").alias("items"))
    return pages.select(F.format_string('{"data":[%s],"meta":{"pagination":{"current":%d,"lastPage":%d}}}',
                                        "items", "page", F.lit(last)).alias("value"))


def _person_pages(spark, sf_dir):
    return envelopes(person_json(fixture(spark, sf_dir, "persons")))


INGEST_COLUMNS = ["person_id", "first_name", "last_name", "email", "primary_email", "street", "city", "campus_id",
                  "campus_name", "created_at", "invitation_status", "is_system_user", "is_allowed_to_login",
                  "accepted_security", "consent_date"]


def ingest_persons(spark, sf_dir):
    p = decode_persons(page_items(_person_pages(spark, sf_dir)))
    return p.withColumn("primary_email", N.primary_email("email", "emails")).select(*INGEST_COLUMNS)


def paged_scan(spark, sf_dir):
    return page_items(_person_pages(spark, sf_dir)).groupBy("page").agg(F.count(F.lit(1)).alias("n_items"))


def relationship_json(rel: DataFrame) -> DataFrame:
    pid, rid = F.col("person_id"), F.col("related_person_id")
    k = pid % 3
    j0 = F.to_json(F.struct(pid.alias("id"), F.col("relationship_type_id").alias("relationshipTypeId"),
                            F.col("name").alias("relationshipName"),
                            F.struct(F.concat(F.lit("https://example.org/api/persons/"), rid.cast("string"), F.lit("/"))
                                     .alias("apiUrl")).alias("relative")))
    j1 = F.to_json(F.struct(F.struct(F.col("relationship_type_id").alias("id")).alias("relationshipType"),
                            F.lit("").alias("relationshipName"), F.col("name").alias("degreeOfRelationship"),
                            F.struct(F.concat(rid.cast("string"), F.lit("-p")).alias("domainIdentifier")).alias("relative")))
    j2 = F.to_json(F.struct(F.col("relationship_type_id").alias("relation_type_id"), F.col("name").alias("relationshipName"),
                            rid.alias("personId")))
    return rel.select("person_id", F.when(k == 0, j0).when(k == 1, j1).otherwise(j2).alias("json"))


def ingest_relationships(spark, sf_dir):
    j = relationship_json(fixture(spark, sf_dir, "relationships"))
    items = j.select("person_id", F.parse_json("json").alias("item"))
    return decode_relationships(items, F.col("person_id"))


def group_json(m: DataFrame) -> DataFrame:
    pid, gid = F.col("person_id"), F.col("group_id")
    j0 = F.to_json(F.struct(pid.alias("personId"),
                            F.struct(F.col("group_name").alias("title"),
                                     F.concat(F.lit("https://example.org/api/groups/"), gid.cast("string")).alias("apiUrl"))
                             .alias("group")))
    j1 = F.to_json(F.struct(gid.alias("id"), gid.alias("groupId"), F.col("group_name").alias("name")))
    return m.select("person_id", F.when(pid % 8 == 0, j0).otherwise(j1).alias("json"))


def ingest_groups(spark, sf_dir):
    j = group_json(fixture(spark, sf_dir, "memberships"))
    items = j.select("person_id", F.parse_json("json").alias("item"))
    return decode_groups(items, F.col("person_id"))


def page_texts(items: DataFrame, pages: list[str] = ["page"], order: str = "key") -> DataFrame:
    """Envelopes of items ``(..page columns.., order, json, last)``, one line of text per page."""
    grouped = items.groupBy(*pages).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "json"))),
                                                                 lambda x: x["json"]), ",").alias("items"), F.max("last").alias("last"))
    return grouped.withColumn("value", F.format_string('{"data":[%s],"meta":{"pagination":{"current":%d,"lastPage":%d}}}', "items", "page", "last"))


def _with_last(items: DataFrame) -> DataFrame:
    return items.withColumn("last", F.lit(items.agg(F.max("page")).first()[0] or 0))


def _scan_pages(spark, sf_dir):
    """A scan per campus, ten items a page; page 2 of some never landed, page 1 of others landed twice."""
    p = fixture(spark, sf_dir, "persons").selectExpr("campus_id AS scan", "person_id AS key", "concat('{\"id\":', person_id, '}') AS json")
    nth = dense_number(p, ["scan", "key"], "n")
    first = nth.groupBy("scan").agg(F.min("n").alias("n0"), F.count(F.lit(1)).alias("size"))
    paged = p.join(nth, ["scan", "key"]).join(first, "scan").selectExpr(
        "scan", "key", "json", "cast(floor((n - n0) / 10) + 1 AS bigint) AS page", "cast(ceil(size / 10) AS bigint) AS last")
    pages = page_texts(paged, ["scan", "page"])
    kept = pages.where("NOT (scan % 7 = 3 AND page = 2)")
    return kept.unionByName(kept.where("scan % 7 = 5 AND page = 1"))


def paged_scans(spark, sf_dir):
    return scan_status(parse_envelopes(_scan_pages(spark, sf_dir), scan_col="scan")).select(
        F.col("scan").cast("int").alias("scan"), "landed", "pages", "last_page", "missing", "doubled", "first_gap", "complete")


# how a record is broken, by id % 12; see the oracle for what is reported
_BROKEN = """CASE person_id % 12
  WHEN 0 THEN concat('{"id":"', person_id, '","firstName":"A"}')
  WHEN 1 THEN concat('{"id":', person_id, ',"firstName":7,"lastName":null}')
  WHEN 2 THEN concat('{"id":', person_id, ',"emails":[{"email":"a@mail.test","contactLabelId":"3x"},null]}')
  WHEN 3 THEN concat('{"id":', person_id, ',"emails":{"email":"a"}}')
  WHEN 4 THEN '{"id":0,"firstName":"A"}'
  WHEN 5 THEN '{"id":1.5,"email":true}'
  WHEN 6 THEN concat('{"id":', person_id, ',"emails":[null,7,{"isDefault":"yes"}]}')
  WHEN 7 THEN concat('{"id":', person_id, ',"lastName":{"a":1},"invitationStatus":[]}')
  WHEN 8 THEN concat('[', person_id, ']')
  WHEN 9 THEN 'null'
  ELSE concat('{"id":', person_id, ',"firstName":"A","emails":[{"email":null,"isDefault":true,"contactLabelId":4}],"isSystemUser":"x"}') END"""


def ingest_invalid(spark, sf_dir):
    """What becomes of every record of a scan with broken ones: ``ref`` tells the record by its place."""
    items = fixture(spark, sf_dir, "persons").selectExpr("person_id AS key", f"{_BROKEN} AS json",
                                                         f"cast(floor((person_id - 1) / {PAGE_SIZE}) + 1 AS bigint) AS page")
    read = page_items(page_texts(_with_last(items)))
    ref = ((F.col("pos.page") - 1) * PAGE_SIZE + F.col("pos.place") + 1).cast("long").alias("ref")
    outcome = F.when(F.size("errors") > 0, F.lit("error")).when(F.col("p.person_id") > 0, F.lit("good")).otherwise(F.lit("passed over"))
    return checked_persons(read, keep=("pos",)).select(ref, outcome.alias("outcome"), F.array_join("errors", "; ").alias("errors"))


def ingest_persons_last(spark, sf_dir):
    """Records that a scan repeats on later pages: the last one of a person counts."""
    p = fixture(spark, sf_dir, "persons").select("person_id", "city")
    old = p.selectExpr("person_id AS key", "to_json(struct(person_id AS id, city, 'alt' AS firstName)) AS json",
                       f"cast(floor((person_id - 1) / {PAGE_SIZE}) + 1 AS bigint) AS page")
    last = old.agg(F.max("page")).first()[0] or 0
    new = p.where("person_id % 6 = 0").selectExpr(
        "person_id AS key", "to_json(struct(person_id AS id, concat('Aue ', person_id) AS city)) AS json",
        f"cast({last} + floor((person_id / 6 - 1) / {PAGE_SIZE}) + 1 AS bigint) AS page")
    read, _ = load_persons(page_items(page_texts(_with_last(old.unionByName(new)))), keep=("pos",))
    return last_record_per_id(read, "pos").select("person_id", "first_name", "city")


def ingest_groups_first(spark, sf_dir):
    """A group that a person's scan lists twice, the second time by another name: the first counts."""
    m = fixture(spark, sf_dir, "memberships")
    first = m.selectExpr("person_id", "1 AS pos", "to_json(struct(group_id AS id, group_name AS name)) AS json")
    again = m.selectExpr("person_id", "2 AS pos", "to_json(struct(struct(group_id AS id, 'AAA' AS name) AS `group`)) AS json")
    items = first.unionByName(again).select("person_id", "pos", F.parse_json("json").alias("item"))
    return decode_groups(items, F.col("person_id"))


# member k of a group scan, in the forms the API has; every tenth has no usable id
_MEMBER = """CASE WHEN k % 10 = 0 THEN '{"personId":0,"person":{"id":5}}' WHEN k % 3 = 0 THEN concat('{"personId":', k * 37 % 5003, '}')
  WHEN k % 3 = 1 THEN concat('{"personId":"?","person":{"id":', k * 37 % 5003, '}}') ELSE concat('{"person":{"id":', k * 37 % 5003, '}}') END"""


def ingest_members(spark, sf_dir):
    """Members of a group in the order in which the scan first names them."""
    k = read_table(spark, sf_dir, "customer").where("c_custkey > 0").selectExpr("c_custkey AS k")
    items = k.selectExpr("k AS key", f"{_MEMBER} AS json", f"cast(floor((k - 1) / {PAGE_SIZE}) + 1 AS bigint) AS page")
    members = decode_members(page_items(page_texts(_with_last(items)))).select("person_id", "first_pos.page", "first_pos.place")
    return members.join(dense_number(members, ["page", "place"], "nth"), ["page", "place"]).select("person_id", "nth")


def ingest_campuses(spark, sf_dir):
    """Campuses come as one list without pagination."""
    n = read_table(spark, sf_dir, "nation").selectExpr("n_nationkey AS key", "CASE WHEN n_nationkey % 5 = 4 THEN concat('{\"id\":', n_nationkey, '}') "
                                                       "ELSE to_json(struct(n_nationkey AS id, concat(' ', n_name) AS name)) END AS json")
    text = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "json"))), lambda x: x["json"]), ",").alias("t"))
    rows, _ = decode_id_names(page_items(text.select(F.format_string('{"data":[%s]}', "t").alias("value"))))
    return rows.select("id", "name")


def _group_items(spark, sf_dir) -> DataFrame:
    json = """CASE WHEN p_partkey % 40 = 7 THEN concat('{"id":"', p_partkey, '","name":"x"}') WHEN p_partkey % 40 = 8 THEN concat('{"id":', p_partkey, ',"name":1}')
      ELSE to_json(struct(p_partkey AS id, concat('<b>', p_name, '</b>  ', p_brand, ' ', p_partkey) AS name)) END"""
    items = read_table(spark, sf_dir, "part").selectExpr("p_partkey AS key", f"{json} AS json", f"cast(floor(p_partkey / {PAGE_SIZE}) + 1 AS bigint) AS page")
    return page_items(page_texts(_with_last(items)))


def ingest_groups_table(spark, sf_dir):
    """All groups, and what a strict decode refuses of them."""
    rows, quarantine = decode_id_names(_group_items(spark, sf_dir), strict=False)
    return rows.select("id", "name", F.lit("").alias("errors")).unionByName(
        quarantine.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.array_join("errors", "; ").alias("errors")))


def ingest_relationship_types(spark, sf_dir):
    """Of five sources the first is not there, the second is no JSON, the third lists no types."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/doppel-types-{uuid.uuid4().hex}"
    t = fixture(spark, sf_dir, "relationship_types")
    json = F.to_json(F.struct("id", "name", F.col("degree_name_a").alias("degreeNameA"), F.col("degree_name_b").alias("degreeNameB"),
                              F.when(F.col("export_title") != "", F.col("export_title")).alias("exportTitle")))
    items = t.select(F.col("id").cast("long").alias("key"), json.alias("json"), (F.floor((F.col("id") - 1) / PAGE_SIZE) + 1).cast("long").alias("page"))
    good = page_texts(_with_last(items)).select("value")
    texts = {"broken": good.select(F.expr("substring(value, 1, length(value) - 3)").alias("value")),
             "empty": spark.createDataFrame([('{"data":[{"id":0,"name":"x"}],"meta":{"pagination":{"current":1,"lastPage":1}}}',)], "value string"),
             "good": good, "later": spark.createDataFrame([('{"data":{"id":1,"name":"later"}}',)], "value string")}
    for name, text in texts.items():
        text.write.text(f"{base}/{name}")
    found = first_filled_source(spark, [f"{base}/{name}" for name in ("absent", *texts)])
    return relationship_types(found).select("id", "name", "score")


# --------------------------------------------------------------------------- oracles

def _ctes(*names):
    return "WITH " + ",\n".join(f"{n} AS ({fixture_cte(n)})" for n in names) + "\n"


def _nb(x):
    return f"CASE WHEN {D.nonblank(x)} THEN {D.utrim(x)} END"


_PERSONS = _ctes("persons") + f"""SELECT person_id, first_name, last_name,
  CASE WHEN person_id % 4 = 1 THEN '' ELSE email END AS email, {D.utrim('email')} AS primary_email,
  coalesce({_nb('street')}, '') AS street, coalesce({_nb('city')}, '') AS city,
  CAST(CASE WHEN person_id % 4 IN (0, 3) AND campus_id > 0 THEN campus_id WHEN person_id % 4 = 2 THEN campus_id ELSE 0 END AS INTEGER) AS campus_id,
  CASE WHEN person_id % 4 = 2 THEN 'Campus ' || CAST(campus_id AS VARCHAR) ELSE '' END AS campus_name,
  coalesce({D.format_date(_nb('created_at'))}, '') AS created_at,
  CASE person_id % 4 WHEN 0 THEN invitation_status WHEN 1 THEN coalesce({_nb('invitation_status')}, '') ELSE '' END AS invitation_status,
  CASE person_id % 4 WHEN 0 THEN person_id % 3 = 0 WHEN 1 THEN person_id % 2 <> 0 END AS is_system_user,
  CASE WHEN person_id % 4 = 3 THEN true END AS is_allowed_to_login,
  CASE WHEN person_id % 4 = 3 THEN '2024-01-15' END AS accepted_security,
  CASE WHEN person_id % 4 = 2 THEN '2024-01-15' END AS consent_date
FROM persons"""

_INVALID = _ctes("persons") + """SELECT CAST(person_id AS BIGINT) AS ref,
  CASE WHEN person_id % 12 IN (4) THEN 'passed over' WHEN person_id % 12 IN (10, 11) THEN 'good' WHEN person_id % 12 = 9 THEN 'passed over' ELSE 'error' END AS outcome,
  CASE person_id % 12 WHEN 0 THEN 'id is not a whole number' WHEN 1 THEN 'firstName is not text'
    WHEN 2 THEN 'emails[0].contactLabelId is not a whole number' WHEN 3 THEN 'emails is not a list'
    WHEN 5 THEN 'id is not a whole number; email is not text' WHEN 6 THEN 'emails[1] is not an object; emails[2].isDefault is not a flag'
    WHEN 7 THEN 'lastName is not text; invitationStatus is not text' WHEN 8 THEN 'the record is not an object' ELSE '' END AS errors
FROM persons"""

_TYPES = _ctes("relationship_types") + """SELECT CAST(id AS INTEGER) AS id,
  CASE WHEN trim(name) <> '' THEN trim(name) WHEN export_title <> '' THEN export_title ELSE 'ID ' || id END AS name,
  CAST(greatest(""" + ", ".join(f"""CASE WHEN trim(lower({c})) = '' THEN 0 WHEN trim(lower({c})) IN ('duplikat', 'dublette', 'duplicate') THEN 100
    WHEN contains(lower({c}), 'duplikat') OR contains(lower({c}), 'dublette') THEN greatest(0, 58 - strlen(trim(lower({c}))))
    WHEN contains(lower({c}), 'duplicate') THEN greatest(0, 59 - strlen(trim(lower({c})))) ELSE 0 END""" for c in ("name", "degree_name_a", "degree_name_b", "export_title")) + """) AS INTEGER) AS score
FROM relationship_types WHERE id > 0"""

ORACLES = {
    "paged_scans": _ctes("persons") + """, n AS (SELECT campus_id AS scan, CAST(ceil(count(*) / 10.0) AS BIGINT) AS last_page FROM persons GROUP BY 1),
  s AS (SELECT *, CASE WHEN scan % 7 = 3 AND last_page >= 2 THEN 1 ELSE 0 END AS gone, CASE WHEN scan % 7 = 5 THEN 1 ELSE 0 END AS twice FROM n)
SELECT CAST(scan AS INTEGER) AS scan, last_page - gone + twice AS landed, last_page - gone AS pages,
  CASE WHEN gone = 1 AND last_page = 2 THEN 2 ELSE last_page END AS last_page, CAST(gone AS BIGINT) AS missing, CAST(twice AS BIGINT) AS doubled,
  CAST(CASE WHEN gone = 1 THEN 2 END AS BIGINT) AS first_gap, gone + twice = 0 AS complete FROM s""",
    "ingest_invalid": _INVALID,
    "ingest_persons_last": _ctes("persons") + f"""SELECT person_id, CASE WHEN person_id % 6 = 0 THEN '' ELSE 'alt' END AS first_name,
  CASE WHEN person_id % 6 = 0 THEN 'Aue ' || person_id ELSE {D.utrim('city')} END AS city FROM persons""",
    "ingest_groups_first": _ctes("memberships") + f"""SELECT CAST(person_id AS BIGINT) AS person_id, CAST(group_id AS BIGINT) AS group_id,
  {D.utrim('group_name')} AS group_name FROM memberships""",
    "ingest_members": """WITH m AS (SELECT c_custkey AS k, c_custkey * 37 % 5003 AS person_id FROM customer WHERE c_custkey > 0 AND c_custkey % 10 <> 0),
  f AS (SELECT person_id, min(k) AS k FROM m WHERE person_id > 0 GROUP BY person_id)
SELECT person_id, row_number() OVER (ORDER BY k) AS nth FROM f""",
    "ingest_campuses": """SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE ' ' || n_name END AS name
FROM nation WHERE n_nationkey > 0""",
    "ingest_groups_table": """SELECT CASE WHEN p_partkey % 40 IN (7, 8) THEN NULL ELSE p_partkey END AS id,
  CASE WHEN p_partkey % 40 IN (7, 8) THEN NULL ELSE '<b>' || p_name || '</b>  ' || p_brand || ' ' || p_partkey END AS name,
  CASE p_partkey % 40 WHEN 7 THEN 'id is not a whole number' WHEN 8 THEN 'name is not text' ELSE '' END AS errors
FROM part WHERE p_partkey > 0""",
    "ingest_relationship_types": _TYPES,
    "ingest_persons": _PERSONS,
    "paged_scan": _ctes("persons") + f"""SELECT CAST(floor((person_id - 1) / {PAGE_SIZE}.0) + 1 AS BIGINT) AS page,
  count(*) AS n_items FROM persons GROUP BY 1""",
    "ingest_relationships": _ctes("relationships") + f"""SELECT CAST(person_id AS BIGINT) AS person_id,
  CAST(related_person_id AS BIGINT) AS related_person_id, CAST(relationship_type_id AS INTEGER) AS relationship_type_id,
  {D.utrim('name')} AS name FROM relationships""",
    "ingest_groups": _ctes("memberships") + f"""SELECT CAST(person_id AS BIGINT) AS person_id, CAST(group_id AS BIGINT) AS group_id,
  {D.utrim('group_name')} AS group_name FROM memberships""",
}

QUERIES = {
    "paged_scans": paged_scans,
    "ingest_invalid": ingest_invalid,
    "ingest_persons_last": ingest_persons_last,
    "ingest_groups_first": ingest_groups_first,
    "ingest_members": ingest_members,
    "ingest_campuses": ingest_campuses,
    "ingest_groups_table": ingest_groups_table,
    "ingest_relationship_types": ingest_relationship_types,
    "ingest_persons": ingest_persons,
    "paged_scan": paged_scan,
    "ingest_relationships": ingest_relationships,
    "ingest_groups": ingest_groups,
}
