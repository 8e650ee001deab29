"""Registered queries: listings and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from doppel.functions import normalize as N
from doppel.operators import lookup as L
from doppel.plans import duck as D
from doppel.sources.fixtures import fixture, fixture_cte, read_table

GROUP_FOR_QUERY = 900
CAMPUS_FOR_QUERY = 3
GROUP_NAMES = ["Duplikate", "duplikate", "alt", " (alt)", "Gruppe X", ""]
CANDIDATE_NAMES = ["Gruppe X", "duplikate", "Duplikate", "DUPLIKATE", "alt"]


def _campus_searches(spark, sf_dir):
    """Search texts a user might type: region and nation names, ids, keywords."""
    regions = [r["r_name"] for r in read_table(spark, sf_dir, "region").select("r_name").collect()]
    return regions + ["all", "Alle", "*", "3", "0", "-2", "nation", "NATION_7", "  ", "zzz"]


def campus_search(spark, sf_dir):
    return L.resolve_campus(fixture(spark, sf_dir, "campuses"), _campus_searches(spark, sf_dir))


def group_lookup(spark, sf_dir):
    groups = L.group_table(fixture(spark, sf_dir, "memberships"))
    return L.find_groups_by_name(groups, GROUP_NAMES).select("name", "n_matches", "group_id")


def group_candidates(spark, sf_dir):
    groups = L.group_table(fixture(spark, sf_dir, "memberships"))
    return L.first_resolving_group(groups, CANDIDATE_NAMES)


def person_memberships(spark, sf_dir):
    return L.person_groups(fixture(spark, sf_dir, "memberships")).orderBy("person_id", "group_id", "group_name")


def relationship_type_listing(spark, sf_dir):
    return (L.relationship_types(fixture(spark, sf_dir, "relationship_types")).select("id", "name", "score")
            .orderBy("id", "name"))


def relationship_type_pick(spark, sf_dir):
    return L.resolve_duplicate_type(fixture(spark, sf_dir, "relationship_types"), default_id=None)


def relationship_type_resolve(spark, sf_dir):
    return L.resolve_duplicate_type(fixture(spark, sf_dir, "relationship_types"))


def persons_by_campus(spark, sf_dir):
    return L.persons_by_campus(fixture(spark, sf_dir, "persons"), CAMPUS_FOR_QUERY) \
        .select("person_id", "first_name", "last_name", "campus_id")


def persons_by_group(spark, sf_dir):
    return L.persons_by_group(fixture(spark, sf_dir, "persons"), fixture(spark, sf_dir, "memberships"),
                              GROUP_FOR_QUERY).select("person_id", "first_name", "last_name")


def persons_by_ids(spark, sf_dir):
    rel = fixture(spark, sf_dir, "relationships")
    ids = rel.select(F.col("person_id").alias("pos"), F.col("related_person_id").alias("person_id"))
    return L.persons_by_ids(fixture(spark, sf_dir, "persons"), ids).select("pos", "person_id", "first_name", "last_name")


def comma_name_lists(spark, sf_dir):
    """F12 over the membership group names (split on commas and brackets' neighbours)."""
    m = fixture(spark, sf_dir, "memberships")
    listed = m.select("person_id", F.explode(N.comma_names(F.regexp_replace("group_name", r"[()]", ","))).alias("name"))
    return listed.groupBy("person_id", "name").agg(F.count(F.lit(1)).alias("n"))


def _part_groups(spark, sf_dir):
    return read_table(spark, sf_dir, "part").selectExpr("p_partkey AS group_id", "concat('<b>', p_name, '</b>  ', p_brand, ' ', p_partkey) AS group_name")


def group_search(spark, sf_dir):
    """Many search texts against a group table that grows: unique, ambiguous and missing ones, short ones too."""
    part = read_table(spark, sf_dir, "part").where("p_partkey % 20 = 0")
    names = part.selectExpr("p_partkey AS pos", """CASE p_partkey % 120 WHEN 0 THEN concat(' ', p_name, ' ', p_brand, ' ', p_partkey, ' ') WHEN 20 THEN p_name
      WHEN 40 THEN concat('zz', p_partkey) WHEN 60 THEN concat('#', p_partkey % 7) WHEN 80 THEN upper(p_name) ELSE concat(p_brand, ' ', p_partkey) END AS name""")
    return L.find_groups_by_name(_part_groups(spark, sf_dir), names)


def relationship_type_requests(spark, sf_dir):
    """F17 over a table of requests: every rule and every way to fail."""
    t = fixture(spark, sf_dir, "relationship_types")
    twice = t.where("id % 5 = 0").withColumn("id", (F.col("id") + 100000).cast("int"))
    types = t.unionByName(twice)
    asked = read_table(spark, sf_dir, "supplier").where("s_suppkey > 0").selectExpr(
        "s_suppkey AS req", "CASE s_suppkey % 6 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey + 500000 ELSE 0 END AS type_id",
        "CASE WHEN s_suppkey % 6 = 2 THEN 8 WHEN s_suppkey % 6 = 3 THEN 999999 END AS default_id",
        "CASE s_suppkey % 6 WHEN 3 THEN ' ' WHEN 4 THEN concat(' mögliche DUBLETTE ', s_suppkey) WHEN 5 THEN concat('Kind ', s_suppkey + 5) ELSE 'x' END AS name")
    return L.resolve_duplicate_types(types, asked)


def persons_in_list_order(spark, sf_dir):
    """A list with repeats and unknown ids, in its order; of a person's records the last counts."""
    p = fixture(spark, sf_dir, "persons").select("person_id", "first_name", "city", F.lit(1).alias("_pos"))
    records = p.unionByName(p.where("person_id % 3 = 0").withColumn("city", F.concat(F.lit("neu "), "city")).withColumn("_pos", F.lit(2)))
    ids = read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS pos", "o_custkey % 2000 AS person_id")
    return L.persons_by_ids(records, ids).select("pos", "person_id", "first_name", "city")


def persons_by_status(spark, sf_dir):
    """P1 with a campus and a status."""
    p = fixture(spark, sf_dir, "persons").withColumn("status_id", (F.col("person_id") % 4).cast("int"))
    return L.persons_by_campus(p, CAMPUS_FOR_QUERY, 2).select("person_id", "campus_id", "status_id")


# --------------------------------------------------------------------------- oracles

def _ctes(*names):
    return "WITH " + ",\n".join(f"{n} AS ({fixture_cte(n)})" for n in names) + "\n"


def _plain(x):
    return D.utrim(f"regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '{D.WS}+', ' ', 'g')")


def _values(col, items):
    rows = ", ".join(f"({i}, '{v.replace(chr(39), chr(39) * 2)}')" for i, v in enumerate(items))
    return f"(VALUES {rows}) AS a(pos, {col})"


_SEARCH_TAIL = ["all", "Alle", "*", "3", "0", "-2", "nation", "NATION_7", "  ", "zzz"]


def _campus_oracle():
    raw = D.utrim("search")
    key = f"regexp_replace(lower({raw}), '[^a-z]', '', 'g')"
    as_int = f"TRY_CAST({raw} AS BIGINT)"
    tail = _values("search", _SEARCH_TAIL).replace("AS a(pos, search)", "AS t(pos, search)")
    return _ctes("campuses") + f""", args AS (
    SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, r_name AS search FROM region
    UNION ALL SELECT pos + 1000, search FROM {tail}),
  a2 AS (SELECT pos, search, {as_int} AS as_int, {key} AS needle,
    CASE WHEN lower({raw}) IN ('all', 'alle', '*') THEN 'all' WHEN {as_int} > 0 THEN 'id'
         WHEN {as_int} IS NOT NULL OR {key} = '' THEN 'error' ELSE 'search' END AS kind FROM args),
  hits AS (SELECT a.pos, count(*) AS n, min(c.id) AS only_id, string_agg(c.name, ', ' ORDER BY c.id) AS cands
    FROM a2 a JOIN campuses c ON contains(regexp_replace(lower(coalesce(c.name, '')), '[^a-z]', '', 'g'), a.needle)
    WHERE a.kind = 'search' GROUP BY a.pos)
SELECT search,
  CASE WHEN kind <> 'search' THEN kind WHEN coalesce(n, 0) = 1 THEN 'unique' WHEN coalesce(n, 0) = 0 THEN 'none' ELSE 'ambiguous' END AS choice,
  CASE WHEN kind = 'id' THEN as_int WHEN kind = 'search' AND n = 1 THEN CAST(only_id AS BIGINT) END AS campus_id,
  CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(cands, '') AS candidates
FROM a2 LEFT JOIN hits USING (pos)"""


def _group_lookup_oracle(select, names=None):
    names = [n.strip() for n in (GROUP_NAMES if names is None else names)]
    return _ctes("memberships") + f""", groups AS (SELECT group_id, min(group_name) AS group_name FROM memberships
    WHERE group_id > 0 GROUP BY group_id),
  args AS (SELECT * FROM {_values('name', names)} WHERE name <> ''),
  per AS (SELECT a.pos, count(*) AS n, min(g.group_id) AS gid FROM args a JOIN groups g
    ON contains({_plain('g.group_name')}, a.name) GROUP BY a.pos),
  res AS (SELECT pos, name, CAST(coalesce(n, 0) AS BIGINT) AS n_matches,
    CASE WHEN n = 1 THEN gid END AS group_id FROM args LEFT JOIN per USING (pos))
{select}"""


def _types_oracle(select):
    def score(c):
        low = f"lower({D.utrim(c)})"
        kws = ", ".join(f"CASE WHEN contains({low}, '{k}') THEN {50 + len(k)} - strlen({low}) ELSE 0 END"
                        for k in ["duplikat", "duplicate", "dublette"])
        return (f"(CASE WHEN {low} = '' THEN 0 WHEN {low} IN ('duplikat', 'dublette', 'duplicate') THEN 100 "
                f"ELSE greatest(0, {kws}) END)")
    low_name = f"lower({D.utrim('name')})"
    return _ctes("relationship_types") + f""", t AS (SELECT CAST(id AS INTEGER) AS id,
    CASE WHEN {D.nonblank('name')} THEN {D.utrim('name')} WHEN {D.nonblank('export_title')} THEN {D.utrim('export_title')}
         ELSE printf('ID %d', id) END AS name,
    CAST(greatest({score('name')}, {score('degree_name_a')}, {score('degree_name_b')}, {score('export_title')}) AS INTEGER) AS score,
    CASE {low_name} WHEN 'duplikat' THEN 0 WHEN 'dublette' THEN 1 WHEN 'duplicate' THEN 2 ELSE 3 END AS prio
  FROM relationship_types WHERE id > 0)
{select}"""


_REQUESTS = _types_oracle("").rstrip().replace("relationship_types AS (", "base_types AS (", 1).replace(
    ", t AS (", """, relationship_types AS (SELECT * FROM base_types UNION ALL
    SELECT CAST(id + 100000 AS INTEGER), name, degree_name_a, degree_name_b, export_title FROM base_types WHERE id % 5 = 0), t AS (""", 1) + """,
  req AS (SELECT s_suppkey AS req, CASE s_suppkey % 6 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey + 500000 ELSE 0 END AS want,
      CASE WHEN s_suppkey % 6 = 2 THEN 8 WHEN s_suppkey % 6 = 3 THEN 999999 END AS default_id,
      CASE s_suppkey % 6 WHEN 3 THEN '' WHEN 4 THEN 'mögliche DUBLETTE ' || s_suppkey WHEN 5 THEN 'Kind ' || (s_suppkey + 5) ELSE 'x' END AS name
    FROM supplier WHERE s_suppkey > 0),
  best AS (SELECT id, name FROM t WHERE score > 0 ORDER BY score DESC, prio, id LIMIT 1),
  byname AS (SELECT lower(name) AS k, count(*) AS n, min(id) AS id, arg_min(name, id) AS name,
      string_agg('"' || name || '" (ID ' || id || ')', ', ' ORDER BY id) AS listed FROM t GROUP BY 1),
  o AS (SELECT r.req, r.want, r.name AS asked, a.id AS a_id, a.name AS a_name, d.id AS d_id, d.name AS d_name, coalesce(b.n, 0) AS n,
      b.id AS b_id, b.name AS b_name, b.listed, (SELECT id FROM best) AS s_id, (SELECT name FROM best) AS s_name,
      CASE WHEN want > 0 THEN CASE WHEN a.id IS NOT NULL THEN 'id' ELSE 'id missing' END WHEN d.id IS NOT NULL THEN 'default'
           WHEN r.name <> '' THEN CASE WHEN coalesce(b.n, 0) = 1 THEN 'name' WHEN coalesce(b.n, 0) = 0 THEN 'name missing' ELSE 'name ambiguous' END
           WHEN (SELECT count(*) FROM best) = 1 THEN 'score' ELSE 'none' END AS outcome
    FROM req r LEFT JOIN t a ON a.id = r.want LEFT JOIN t d ON d.id = r.default_id LEFT JOIN byname b ON b.k = lower(r.name) AND r.name <> '')
SELECT req, outcome, CASE outcome WHEN 'id' THEN a_id WHEN 'default' THEN d_id WHEN 'name' THEN b_id WHEN 'score' THEN s_id END AS id,
  CASE outcome WHEN 'id' THEN a_name WHEN 'default' THEN d_name WHEN 'name' THEN b_name WHEN 'score' THEN s_name END AS name,
  CASE WHEN outcome LIKE 'name%' THEN n ELSE 0 END AS n_matches, CASE WHEN outcome = 'name ambiguous' THEN listed ELSE '' END AS candidates FROM o"""


ORACLES = {
    "group_search": """WITH g AS (SELECT p_partkey AS group_id, p_name || ' ' || p_brand || ' ' || p_partkey AS plain FROM part),
  a AS (SELECT p_partkey AS pos, trim(CASE p_partkey % 120 WHEN 0 THEN p_name || ' ' || p_brand || ' ' || p_partkey WHEN 20 THEN p_name WHEN 40 THEN 'zz' || p_partkey
      WHEN 60 THEN '#' || (p_partkey % 7) WHEN 80 THEN upper(p_name) ELSE p_brand || ' ' || p_partkey END) AS name FROM part WHERE p_partkey % 20 = 0),
  h AS (SELECT a.pos, count(*) AS n, min(g.group_id) AS gid FROM a JOIN g ON contains(g.plain, a.name) GROUP BY a.pos)
SELECT a.pos, name, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 THEN gid END AS group_id FROM a LEFT JOIN h ON h.pos = a.pos""",
    "relationship_type_requests": _REQUESTS,
    "persons_in_list_order": _ctes("persons") + """SELECT o_orderkey AS pos, p.person_id, first_name,
  CASE WHEN p.person_id % 3 = 0 THEN 'neu ' || city ELSE city END AS city FROM orders JOIN persons p ON p.person_id = o_custkey % 2000""",
    "persons_by_status": _ctes("persons") + """SELECT person_id, campus_id, CAST(person_id % 4 AS INTEGER) AS status_id FROM persons
  WHERE campus_id = 3 AND person_id % 4 = 2""",
    "campus_search": _campus_oracle(),
    "group_lookup": _group_lookup_oracle("SELECT name, n_matches, group_id FROM res"),
    # candidates after the case-insensitive dedupe: "Duplikate", "DUPLIKATE" repeat "duplikate"
    "group_candidates": _group_lookup_oracle(
        "SELECT group_id, name FROM res WHERE n_matches = 1 ORDER BY pos LIMIT 1", ["Gruppe X", "duplikate", "alt"]),
    "person_memberships": _ctes("memberships") + f"""SELECT CAST(person_id AS BIGINT) AS person_id, CAST(group_id AS BIGINT) AS group_id,
  min({_plain('group_name')}) AS group_name FROM memberships WHERE group_id > 0 AND {D.nonblank('group_name')}
  GROUP BY person_id, group_id""",
    "relationship_type_listing": _types_oracle("SELECT id, name, score FROM t"),
    "relationship_type_pick": _types_oracle(
        "SELECT id, name, 'score' AS rule FROM t WHERE score > 0 ORDER BY score DESC, prio, id LIMIT 1"),
    "relationship_type_resolve": _types_oracle("SELECT id, name, 'default' AS rule FROM t WHERE id = 8"),
    "persons_by_campus": _ctes("persons") + "SELECT person_id, first_name, last_name, campus_id FROM persons WHERE campus_id = 3",
    "persons_by_group": _ctes("persons", "memberships") + """SELECT person_id, first_name, last_name FROM persons
  WHERE person_id IN (SELECT person_id FROM memberships WHERE group_id = 900 AND person_id > 0)""",
    "persons_by_ids": _ctes("persons", "relationships") + """SELECT r.person_id AS pos, p.person_id, p.first_name, p.last_name
  FROM relationships r JOIN persons p ON p.person_id = r.related_person_id""",
    "comma_name_lists": _ctes("memberships") + f"""SELECT person_id, name, count(*) AS n FROM (
  SELECT person_id, {D.utrim('x')} AS name FROM memberships,
    unnest(string_split(regexp_replace(group_name, '[()]', ',', 'g'), ',')) AS u(x)) t
  WHERE name <> '' GROUP BY person_id, name""",
}

QUERIES = {
    "group_search": group_search,
    "relationship_type_requests": relationship_type_requests,
    "persons_in_list_order": persons_in_list_order,
    "persons_by_status": persons_by_status,
    "campus_search": campus_search,
    "group_lookup": group_lookup,
    "group_candidates": group_candidates,
    "person_memberships": person_memberships,
    "relationship_type_listing": relationship_type_listing,
    "relationship_type_pick": relationship_type_pick,
    "relationship_type_resolve": relationship_type_resolve,
    "persons_by_campus": persons_by_campus,
    "persons_by_group": persons_by_group,
    "persons_by_ids": persons_by_ids,
    "comma_name_lists": comma_name_lists,
}
