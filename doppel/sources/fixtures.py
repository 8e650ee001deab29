"""Person-directory fixture views derived from the driver's TPC-H-ish tables.

The driver tables hold no person directory, so every job reads one derived
from ``customer`` and ``nation``. The SQL text below is valid in Spark and in
DuckDB alike; Spark runs it with DataFrame arguments (``spark.sql(text,
customer=df)``), the DuckDB oracles inline it as CTEs over the registered
views. Four customers form one entity ``e``: ``v=0`` the original, ``v=1`` a
spelling variant, ``v=2`` a partner, ``v=3`` an unrelated person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PERSONS_SQL = """
SELECT k AS person_id,
  CASE WHEN k % 11 = 0 THEN 0 ELSE nk + 1 END AS campus_id,
  CASE v WHEN 1 THEN CASE e % 6 WHEN 0 THEN 'Tim R.' WHEN 1 THEN 'Eva Marie' WHEN 2 THEN 'ANNA' WHEN 3 THEN 'Konrad' WHEN 4 THEN last0 ELSE 'E.' END
         WHEN 2 THEN 'Bernd' WHEN 3 THEN 'Uwe'
         ELSE CASE e % 6 WHEN 0 THEN 'Tim Robert' WHEN 1 THEN 'Eva-Marie' WHEN 2 THEN 'Anna' WHEN 3 THEN 'Konrad' WHEN 4 THEN 'Sofia' ELSE 'Erika' END END AS first_name,
  CASE WHEN v = 3 THEN 'Solo' || suffix
       WHEN v = 1 AND e % 6 = 4 THEN 'Sofia'
       WHEN v = 1 AND e % 6 = 3 THEN 'Krug' || suffix
       WHEN v = 1 AND e % 6 = 2 THEN last0 || '-Schmidt'
       ELSE last0 END AS last_name,
  CASE WHEN v = 3 THEN CASE WHEN e % 2 = 0 THEN '' ELSE 'solo' || CAST(k AS VARCHAR(20)) || '@example.org' END
       WHEN v = 1 THEN CASE WHEN e % 6 = 5 THEN ' Fam' || CAST(e AS VARCHAR(20)) || '@Example.org ' ELSE '' END
       WHEN v = 2 THEN CASE WHEN e % 2 = 0 THEN '' ELSE 'fam' || CAST(e AS VARCHAR(20)) || '@example.org' END
       ELSE 'fam' || CAST(e AS VARCHAR(20)) || '@example.org' END AS email,
  CASE WHEN v = 3 THEN 'Gasse ' || CAST(k AS VARCHAR(20))
       ELSE CASE WHEN v = 1 THEN CASE e % 4 WHEN 0 THEN 'Talstraße ' WHEN 1 THEN 'Anna Seghers Str.' WHEN 2 THEN 'Lindenweg  ' ELSE 'BAHNHOFSTR. ' END
                 ELSE CASE e % 4 WHEN 0 THEN 'Talstr. ' WHEN 1 THEN 'Anna-Seghers-Straße ' WHEN 2 THEN 'Lindenweg ' ELSE 'Bahnhofstrasse ' END END
            || CAST(e % 97 + 1 AS VARCHAR(20)) END AS street,
  CASE WHEN v = 1 THEN CASE e % 5 WHEN 0 THEN 'Halle am Berg' WHEN 1 THEN 'Halle/B' WHEN 2 THEN 'Lauffen/Dorf' WHEN 3 THEN 'Gera' ELSE 'Halle am Berg' END
       ELSE CASE e % 5 WHEN 0 THEN 'Halle' WHEN 1 THEN 'Halle/B.' WHEN 2 THEN 'Lauffen/Dorf' WHEN 3 THEN ' gera' ELSE 'Halle a.d. Saale' END END AS city,
  CASE k % 4 WHEN 0 THEN '2026-05-20T22:26:37Z' WHEN 1 THEN '2026-06-14' WHEN 2 THEN '' ELSE '20.05.2026' END AS created_at,
  CASE k % 5 WHEN 0 THEN 'pending' WHEN 1 THEN ' Accepted ' ELSE '' END AS invitation_status
FROM (SELECT k, nk, e, v, suffix,
        CASE e % 5 WHEN 0 THEN 'Müller' WHEN 1 THEN 'Groß' WHEN 2 THEN 'Ünal' WHEN 3 THEN 'Weber' ELSE 'Berger' END || suffix AS last0
      FROM (SELECT c_custkey AS k, c_nationkey AS nk, CAST(floor(c_custkey / 4.0) AS BIGINT) AS e, c_custkey % 4 AS v,
              chr(CAST(97 + CAST(floor(c_custkey / 4.0) AS BIGINT) % 26 AS INT)) || chr(CAST(97 + CAST(floor(c_custkey / 104.0) AS BIGINT) % 26 AS INT)) || chr(CAST(97 + CAST(floor(c_custkey / 2704.0) AS BIGINT) % 26 AS INT)) AS suffix
            FROM {customer}) t1) t2
WHERE k > 0
"""

CAMPUSES_SQL = """
SELECT CAST(n_nationkey + 1 AS INT) AS id, ' ' || n_name || ' ' AS name FROM {nation}
"""

RELATIONSHIPS_SQL = """
SELECT CASE WHEN e % 2 = 0 THEN a ELSE a + 1 END AS person_id,
       CASE WHEN e % 2 = 0 THEN a + 1 ELSE a END AS related_person_id,
       CASE e % 4 WHEN 2 THEN 0 WHEN 3 THEN 5 ELSE 8 END AS relationship_type_id,
       CASE e % 4 WHEN 2 THEN 'Mögliche Dublette' ELSE 'Kontakt' END AS name
FROM (SELECT c_custkey AS a, CAST(floor(c_custkey / 4.0) AS BIGINT) AS e
      FROM {customer} WHERE c_custkey % 4 = 0 AND c_custkey > 0) t
WHERE e % 3 <> 1
"""

MEMBERSHIPS_SQL = """
SELECT a AS person_id, CAST(900 + e % 2 AS BIGINT) AS group_id,
       CASE e % 2 WHEN 0 THEN '<b>1</b>  Duplikate' ELSE 'duplikate (alt)' END AS group_name
FROM (SELECT c_custkey AS a, CAST(floor(c_custkey / 4.0) AS BIGINT) AS e
      FROM {customer} WHERE c_custkey % 4 = 0) t
WHERE e % 5 = 1
"""

PERSON_DETAILS_SQL = """
SELECT c_custkey AS person_id,
       CASE WHEN c_custkey % 3 = 0 THEN 'Neue Gasse ' || CAST(c_custkey AS VARCHAR(20)) ELSE '  ' END AS street,
       CASE WHEN c_custkey % 5 = 0 THEN 'Wiesbaden' ELSE '' END AS city,
       CASE WHEN c_custkey % 7 = 0 THEN '2020-01-01T08:00:00+02:00' ELSE '' END AS created_at,
       CASE WHEN c_custkey % 6 = 0 THEN 'accepted' ELSE '' END AS invitation_status,
       CASE WHEN c_custkey % 10 = 0 THEN 3 ELSE 0 END AS campus_id
FROM {customer} WHERE c_custkey > 0
"""

# Relationship types as the people API lists them (id, name, degree names,
# export title). Derived from ``supplier`` so that the listing and the pick
# (F15-F17, F31) scan a table that grows with the scale factor. Ids 1..9 carry
# the plain labels; larger ids add a number to the label, which lowers the
# keyword score, and every 7th row has a blank name so that the display name
# falls back to the export title or to ``ID n``.
RELATIONSHIP_TYPES_SQL = """
SELECT CAST(s_suppkey AS INT) AS id,
  CASE WHEN s_suppkey % 7 = 0 THEN '  '
       ELSE CASE s_suppkey % 9 WHEN 0 THEN 'Ehepartner' WHEN 1 THEN 'Kind' WHEN 2 THEN 'Mögliche Dublette' WHEN 3 THEN 'Duplikat'
                              WHEN 4 THEN 'Dublette' WHEN 5 THEN 'duplicate' WHEN 6 THEN 'Duplikat von' WHEN 7 THEN 'Geschwister' ELSE 'Pate' END
            || CASE WHEN s_suppkey > 9 THEN ' ' || CAST(s_suppkey AS VARCHAR(20)) ELSE '' END END AS name,
  CASE s_suppkey % 4 WHEN 0 THEN 'Elternteil' WHEN 1 THEN ' dublette ' ELSE '' END AS degree_name_a,
  CASE s_suppkey % 5 WHEN 0 THEN 'Kind' ELSE '' END AS degree_name_b,
  CASE WHEN s_suppkey % 14 = 0 THEN 'Export ' || CAST(s_suppkey AS VARCHAR(20)) ELSE '' END AS export_title
FROM {supplier}
WHERE s_suppkey > 0
"""

FIXTURE_SQL = {
    "persons": (PERSONS_SQL, ("customer",)),
    "campuses": (CAMPUSES_SQL, ("nation",)),
    "relationships": (RELATIONSHIPS_SQL, ("customer",)),
    "memberships": (MEMBERSHIPS_SQL, ("customer",)),
    "person_details": (PERSON_DETAILS_SQL, ("customer",)),
    "relationship_types": (RELATIONSHIP_TYPES_SQL, ("supplier",)),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame over the parquet tables of ``sf_dir``."""
    sql, sources = FIXTURE_SQL[name]
    frames = {src: read_table(spark, sf_dir, src) for src in sources}
    return spark.sql(sql, **frames)


def fixture_cte(name: str) -> str:
    """The same fixture as DuckDB SQL over the pre-registered views."""
    sql, sources = FIXTURE_SQL[name]
    return sql.format(**{src: src for src in sources})


def with_fixtures(body: str, names: list[str]) -> str:
    """Prefix a DuckDB query with the fixture CTEs it reads."""
    ctes = ",\n".join(f"{n} AS ({fixture_cte(n)})" for n in names)
    return f"WITH {ctes}\n{body}"
