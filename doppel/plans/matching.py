"""Registered queries of the matching family.

Each query is a pair: a Spark job ``fn(spark, sf_dir) -> DataFrame`` and the
DuckDB oracle text over the driver's views. Pair lists that are quadratic in
a bucket are not registered as outputs; the e-mail and block phases are
checked through their components instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.functions import predicates as P
from doppel.operators.components import connected_components
from doppel.operators.groups import find_duplicate_groups
from doppel.operators.pairs import block_edges, block_keys, email_edges, person_features, written_features
from doppel.plans import duck as D
from doppel.sources.fixtures import fixture, with_fixtures

CAMPUS_FOR_QUERY = 3


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "persons")


def _features(spark, sf_dir):
    return person_features(_persons(spark, sf_dir))


def norm_email(spark, sf_dir):
    return _features(spark, sf_dir).select("person_id", "email_n")


def norm_name_tokens(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("person_id",
                    F.array_join("first_t", " ").alias("first_norm"),
                    F.array_join("last_t", " ").alias("last_norm"),
                    F.size("first_t").cast("long").alias("n_first"),
                    F.size("last_t").cast("long").alias("n_last"))


def norm_city(spark, sf_dir):
    return _features(spark, sf_dir).select("person_id", "city_main", "city_by")


def norm_street(spark, sf_dir):
    return _features(spark, sf_dir).select("person_id", "street_n")


def block_keys_q(spark, sf_dir):
    return block_keys(_features(spark, sf_dir))


def block_sizes(spark, sf_dir):
    return (block_keys(_features(spark, sf_dir)).groupBy("block_key")
            .agg(F.count(F.lit(1)).alias("n_persons")))


def _components_of(edges: DataFrame) -> DataFrame:
    return (connected_components(edges)
            .select(F.col("node").alias("person_id"), F.col("label").alias("component")))


def email_components(spark, sf_dir):
    return _components_of(email_edges(written_features(_persons(spark, sf_dir))))


def block_components(spark, sf_dir):
    return _components_of(block_edges(written_features(_persons(spark, sf_dir))))


def shared_mailbox_couples(spark, sf_dir):
    """P5 per mailbox: number of person pairs that are shared-mailbox couples.

    Counted over distinct couple-relevant nodes with multiplicities (a node
    pair contributes ``n_l * n_r``, a node with blank first names couples
    with itself ``n(n-1)/2`` times), so no person pair is listed.
    """
    f = _features(spark, sf_dir).where((F.col("email_n") != "") & (F.col("street_n") != "") & (F.col("city_main") != ""))
    cls = ["email_n", "campus_id", "street_n", "city_main"]
    nodes = f.groupBy(*cls, "city_by", "first_t").agg(F.count(F.lit(1)).alias("n"), F.min("person_id").alias("rep"))
    l = nodes.select(*cls, *[F.col(c).alias(f"l_{c}") for c in ["city_by", "first_t", "n", "rep"]])
    r = nodes.select(*cls, *[F.col(c).alias(f"r_{c}") for c in ["city_by", "first_t", "n", "rep"]])
    cross = (l.join(r, cls).where(F.col("l_rep") < F.col("r_rep"))
             .where(P.suffix_compatible(F.col("l_city_by"), F.col("r_city_by"))
                    & ~P.first_names_match(F.col("l_first_t"), F.col("r_first_t")))
             .select("email_n", (F.col("l_n") * F.col("r_n")).alias("pairs")))
    own = nodes.where(F.size("first_t") == 0).select("email_n", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    return (cross.unionByName(own).groupBy("email_n").agg(F.sum("pairs").cast("long").alias("couple_pairs"))
            .where(F.col("couple_pairs") > 0))


def entity_pair_rules(spark, sf_dir):
    """P4-P10 evaluated on the six person pairs of every fixture entity (ids 4e..4e+3)."""
    f = _features(spark, sf_dir).withColumn("entity", F.floor(F.col("person_id") / 4).cast("long"))
    cols = ["person_id", "email_n", "campus_id", "first_t", "last_t", "city_main", "city_by", "street_n"]
    a = f.select("entity", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = f.select("entity", *[F.col(c).alias(f"b_{c}") for c in cols])
    pa = {c: F.col(f"a_{c}") for c in cols}
    pb = {c: F.col(f"b_{c}") for c in cols}
    return (a.join(b, "entity").where(F.col("a_person_id") < F.col("b_person_id"))
            .select(F.col("a_person_id").alias("a_id"), F.col("b_person_id").alias("b_id"),
                    P.first_names_match(pa["first_t"], pb["first_t"]).alias("first_match"),
                    P.last_names_match(pa["last_t"], pb["last_t"]).alias("last_match"),
                    P.city_equal(pa["city_main"], pa["city_by"], pb["city_main"], pb["city_by"]).alias("city_match"),
                    ((pa["street_n"] != "") & (pa["street_n"] == pb["street_n"])).alias("street_match"),
                    P.shared_email_couple(pa, pb).alias("couple"),
                    P.persons_match(pa, pb).alias("is_match")))


def duplicate_groups(spark, sf_dir):
    """C1, clusters by DupID and members by id (O1, O2)."""
    return find_duplicate_groups(_persons(spark, sf_dir)).orderBy("dup_id", "person_id")


def duplicate_groups_campus(spark, sf_dir):
    return find_duplicate_groups(_persons(spark, sf_dir), campus_id=CAMPUS_FOR_QUERY)


def duplicate_groups_swapped(spark, sf_dir):
    """C1 with the optional block of exchanged first and last names."""
    return find_duplicate_groups(_persons(spark, sf_dir), swap_keys=True)


# a person directory with a hot mailbox and street, addresses in a list and ids beyond a double
_HOT = """SELECT CASE WHEN person_id % 5 = 0 THEN person_id + 9007199254740993 ELSE person_id END AS person_id, campus_id, first_name, last_name,
  CASE WHEN person_id % 12 = 0 THEN ' Office@example.org' ELSE email END AS email,
  CASE WHEN person_id % 4 = 3 THEN 'Hauptplatz 1' ELSE street END AS street, CASE WHEN person_id % 4 = 3 THEN 'Gera' ELSE city END AS city FROM persons"""


def duplicate_groups_hot(spark, sf_dir):
    """C1 where one mailbox and one street hold many persons, and half of the mail addresses stand in the list only."""
    p = spark.sql(_HOT.replace("FROM persons", "FROM {persons}"), persons=_persons(spark, sf_dir))
    listed = F.array(F.struct(F.lit(" ").alias("email")), F.struct(F.col("email")))
    p = p.withColumn("emails", listed).withColumn("email", F.when(F.col("person_id") % 2 == 0, F.lit("")).otherwise(F.col("email")))
    return find_duplicate_groups(p)


# --------------------------------------------------------------------------- oracles

_F = f"f AS ({D.features_sql()})"


def _q(body: str, recursive: bool = False) -> str:
    sql = with_fixtures("", ["persons"]).rstrip()
    sql = sql + f",\n{_F}"
    if body.lstrip().upper().startswith("SELECT"):
        sql += "\n" + body
    else:
        sql += ",\n" + body
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else sql


_EMAIL_EDGES = f"""edges AS (SELECT a.person_id AS src, b.person_id AS dst FROM f a JOIN f b
    ON a.email_n = b.email_n AND a.email_n <> '' AND a.person_id < b.person_id
    WHERE NOT {D.couple('a', 'b')})"""

_BLOCK_EDGES = f"""keys AS ({D.block_keys_sql('f')}),
  cand AS (SELECT DISTINCT ka.person_id AS x, kb.person_id AS y FROM keys ka JOIN keys kb
    ON ka.block_key = kb.block_key AND ka.person_id < kb.person_id),
  bedges AS (SELECT c.x AS src, c.y AS dst FROM cand c JOIN f a ON a.person_id = c.x JOIN f b ON b.person_id = c.y
    WHERE {D.persons_match('a', 'b')})"""

_ALL_EDGES = f"""{_EMAIL_EDGES.replace('edges AS', 'eedges AS', 1)},
  {_BLOCK_EDGES},
  edges AS (SELECT src, dst FROM eedges UNION SELECT src, dst FROM bedges)"""


def _groups_sql(campus: int | None, swapped: bool = False) -> str:
    keep = ""
    edges = _ALL_EDGES.replace(D.block_keys_sql("f"), D.block_keys_sql("f", swapped))
    if campus is not None:
        keep = (f"WHERE label IN (SELECT c.label FROM comp c JOIN persons p ON p.person_id = c.node "
                f"WHERE p.campus_id = {campus})")
    return _q(f"""{edges},
  {D.components_sql('edges')},
  kept AS (SELECT node, label FROM comp {keep})
SELECT CAST(dense_rank() OVER (ORDER BY label) AS BIGINT) AS dup_id, CAST(node AS BIGINT) AS person_id FROM kept""",
              recursive=True)


def _hot_sql() -> str:
    text = _groups_sql(None)
    return text.replace(f",\n{_F}", f",\n  hot AS ({_HOT}),\nf AS ({D.features_sql('hot')})", 1)


ORACLES = {
    "duplicate_groups_hot": _hot_sql(),
    "norm_email": _q("SELECT person_id, email_n FROM f"),
    "norm_name_tokens": _q("SELECT person_id, array_to_string(first_t, ' ') AS first_norm, "
                           "array_to_string(last_t, ' ') AS last_norm, CAST(len(first_t) AS BIGINT) AS n_first, "
                           "CAST(len(last_t) AS BIGINT) AS n_last FROM f"),
    "norm_city": _q("SELECT person_id, city_main, city_by FROM f"),
    "norm_street": _q("SELECT person_id, street_n FROM f"),
    "block_keys": _q(f"SELECT person_id, block_key FROM ({D.block_keys_sql('f')}) k"),
    "block_sizes": _q(f"SELECT block_key, count(*) AS n_persons FROM ({D.block_keys_sql('f')}) k GROUP BY block_key"),
    "email_components": _q(f"""{_EMAIL_EDGES},
  {D.components_sql('edges')}
SELECT CAST(node AS BIGINT) AS person_id, CAST(label AS BIGINT) AS component FROM comp""", recursive=True),
    "block_components": _q(f"""{_BLOCK_EDGES},
  {D.components_sql('bedges')}
SELECT CAST(node AS BIGINT) AS person_id, CAST(label AS BIGINT) AS component FROM comp""", recursive=True),
    "shared_mailbox_couples": _q(f"""SELECT a.email_n, CAST(count(*) AS BIGINT) AS couple_pairs FROM f a JOIN f b
  ON a.email_n = b.email_n AND a.person_id < b.person_id WHERE {D.couple('a', 'b')} GROUP BY a.email_n"""),
    "entity_pair_rules": _q(f"""SELECT a.person_id AS a_id, b.person_id AS b_id,
  {D.fnm('a.first_t', 'b.first_t')} AS first_match, {D.lnm('a.last_t', 'b.last_t')} AS last_match,
  {D.city_eq('a', 'b')} AS city_match, (a.street_n <> '' AND a.street_n = b.street_n) AS street_match,
  {D.couple('a', 'b')} AS couple, {D.persons_match('a', 'b')} AS is_match
FROM f a JOIN f b ON CAST(floor(a.person_id / 4.0) AS BIGINT) = CAST(floor(b.person_id / 4.0) AS BIGINT)
  AND a.person_id < b.person_id"""),
    "duplicate_groups": _groups_sql(None),
    "duplicate_groups_campus": _groups_sql(CAMPUS_FOR_QUERY),
    "duplicate_groups_swapped": _groups_sql(None, swapped=True),
}

QUERIES = {
    "duplicate_groups_hot": duplicate_groups_hot,
    "norm_email": norm_email,
    "norm_name_tokens": norm_name_tokens,
    "norm_city": norm_city,
    "norm_street": norm_street,
    "block_keys": block_keys_q,
    "block_sizes": block_sizes,
    "email_components": email_components,
    "block_components": block_components,
    "shared_mailbox_couples": shared_mailbox_couples,
    "entity_pair_rules": entity_pair_rules,
    "duplicate_groups": duplicate_groups,
    "duplicate_groups_campus": duplicate_groups_campus,
    "duplicate_groups_swapped": duplicate_groups_swapped,
}
