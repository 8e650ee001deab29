"""Registered queries: export (C2, A6), review CSV (S11-S16), reconcile.

The review a human hands back is derived from the duplicate clusters: rows of
persons with ``person_id % 13 = 0`` were deleted, clusters with
``dup_id % 3 = 0`` list their members in descending id order (so the primary
is not the smallest id), clusters with ``dup_id % 7 = 0`` repeat their largest
member at the end (a pair met twice in one run), and clusters with
``dup_id % 11 = 0`` repeat their primary at the end (an invalid pair).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.operators.enrich import REVIEW_COLUMNS, export_rows, export_summary
from doppel.operators.groups import find_duplicate_groups
from doppel.operators.ranking import dense_number
from doppel.operators.reconcile import dry_run_messages, reconcile
from doppel.plans import duck as D
from doppel.plans.matching import ORACLES as MATCH_ORACLES
from doppel.sources.fixtures import fixture
from doppel.sources.review_csv import group_review, read_review_csv, write_review_csv
from doppel.session import ensure_checkpoint_dir, written

REL_TYPE_ID = 8


def _groups(spark, sf_dir):
    return find_duplicate_groups(fixture(spark, sf_dir, "persons"))


def export_review(spark, sf_dir):
    return export_rows(_groups(spark, sf_dir), fixture(spark, sf_dir, "persons"),
                       fixture(spark, sf_dir, "campuses"), fixture(spark, sf_dir, "person_details"))


def export_summary_q(spark, sf_dir):
    return export_summary(export_review(spark, sf_dir))


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints (a shared folder on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/doppel-{name}-{uuid.uuid4().hex}"


def review_csv_roundtrip(spark, sf_dir):
    path = _scratch(spark, "review")
    write_review_csv(export_review(spark, sf_dir), path)
    rows, _ = read_review_csv(spark, path)
    return rows


def review_csv_invalid(spark, sf_dir):
    """Rows a human broke: blank DupID (id % 17 = 0), text ID (id % 19 = 0)."""
    rows = export_review(spark, sf_dir)
    pid = F.col("person_id")
    out = rows.select(
        F.col("dup_id").alias("_sort_dup"), pid.alias("_sort_pid"),
        F.when(pid % 17 == 0, F.lit("")).otherwise(F.col("dup_id").cast("string")).alias("dup_id_text"),
        F.when(pid % 19 == 0, F.concat(F.lit("x"), pid.cast("string"))).otherwise(pid.cast("string")).alias("id_text"),
        *REVIEW_COLUMNS[2:])
    path = _scratch(spark, "review-invalid")
    _write_text_review(out, path)
    _, invalid = read_review_csv(spark, path, strict=False)
    return invalid


def review_csv_multiline(spark, sf_dir):
    """A review whose cells a human broke into lines (id % 5 = 0), with quotes (id % 3 = 0) and delimiters in them."""
    pid = F.col("person_id")
    rows = export_review(spark, sf_dir).withColumn("street", F.concat(
        "street", F.when(pid % 5 == 0, F.lit("\nHinterhaus\n\nTreppe 2")).otherwise(F.lit("")),
        F.when(pid % 3 == 0, F.lit('; "links", oben')).otherwise(F.lit(""))))
    path = _scratch(spark, "review-multiline")
    write_review_csv(rows, path)
    back, _ = read_review_csv(spark, path)
    return back.select("line", "dup_id", "person_id", "street", "city")


def _write_text_review(out: DataFrame, path: str) -> None:
    from doppel.sources.review_csv import BOM, REVIEW_HEADER
    cols = ["dup_id_text", "id_text"] + REVIEW_COLUMNS[2:]
    (out.orderBy("_sort_dup", "_sort_pid")
        .select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias((BOM if i == 0 else "") + h)
                  for i, (c, h) in enumerate(zip(cols, REVIEW_HEADER))])
        .write.mode("overwrite").option("header", True).option("escape", '"')
        .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path))


def review_rows(spark, sf_dir) -> DataFrame:
    """The edited review: ``dup_id, person_id, line``, written once as what follows reads it many times."""
    g = written(_groups(spark, sf_dir))
    base = g.where(F.col("person_id") % 13 != 0).withColumn("k", F.lit(0))
    stats = base.groupBy("dup_id").agg(F.min("person_id").alias("lo"), F.max("person_id").alias("hi"))
    repeat = (g.where(F.col("dup_id") % 7 == 0).groupBy("dup_id").agg(F.max("person_id").alias("person_id"))
              .withColumn("k", F.lit(1)))
    invalid = (stats.where(F.col("dup_id") % 11 == 0)
               .select("dup_id", F.when(F.col("dup_id") % 3 == 0, F.col("hi")).otherwise(F.col("lo")).alias("person_id"))
               .withColumn("k", F.lit(2)))
    rows = base.unionByName(repeat).unionByName(invalid)
    sort = F.when(F.col("dup_id") % 3 == 0, -F.col("person_id")).otherwise(F.col("person_id"))
    rows = rows.withColumn("sort", sort)
    numbered = dense_number(rows, ["dup_id", "k", "sort"], "_n")
    return written(rows.join(numbered, ["dup_id", "k", "sort"])
                   .select("dup_id", "person_id", (F.col("_n") + 1).cast("long").alias("line")))


def review_primary(spark, sf_dir):
    g = group_review(review_rows(spark, sf_dir))
    return g.select("dup_id", "primary_id", "n_rows").distinct()


def review_grouped(spark, sf_dir):
    return group_review(review_rows(spark, sf_dir)).select("dup_id", "person_id", "line", "pos")


def _reconcile(spark, sf_dir, dry_run):
    return reconcile(review_rows(spark, sf_dir), fixture(spark, sf_dir, "relationships"),
                     fixture(spark, sf_dir, "memberships"), rel_type_id=REL_TYPE_ID, dry_run=dry_run)


def reconcile_dry_run(spark, sf_dir):
    return _reconcile(spark, sf_dir, True).results


def reconcile_apply(spark, sf_dir):
    return _reconcile(spark, sf_dir, False).results


def links_to_create(spark, sf_dir):
    return _reconcile(spark, sf_dir, False).links


def memberships_to_add(spark, sf_dir):
    return _reconcile(spark, sf_dir, False).memberships


def reconcile_summary(spark, sf_dir):
    return _reconcile(spark, sf_dir, True).summary


def reconcile_apply_summary(spark, sf_dir):
    return _reconcile(spark, sf_dir, False).summary


def reconcile_messages(spark, sf_dir):
    """F19 in pieces of about 12 characters of ids."""
    return dry_run_messages(review_rows(spark, sf_dir), fixture(spark, sf_dir, "relationships"),
                            fixture(spark, sf_dir, "memberships"), rel_type_id=REL_TYPE_ID, chunk=12)


def export_accounts(spark, sf_dir):
    """C2 with account fields, e-mail lists and campus names in the details, several details of a person."""
    k = F.col("person_id")
    base = fixture(spark, sf_dir, "person_details").withColumn("_pos", F.lit(1)).withColumn(
        "is_system_user", k % 17 == 0).withColumn("is_allowed_to_login", F.when(k % 19 == 0, F.lit(True))).withColumn(
        "cms_user_id", F.when(k % 23 == 0, F.lit("u")).otherwise(F.lit(" "))).withColumn(
        "last_login", F.when(k % 29 == 0, F.lit("2026-01-02"))).withColumn("consent_date", F.when(k % 31 == 0, F.lit("2026-01-02"))).withColumn(
        "accepted_security", F.when(k % 37 == 0, F.lit("ja"))).withColumn("campus_name", F.when(k % 8 == 0, F.lit(" Eigener Standort "))).withColumn(
        "emails", F.when(k % 3 == 0, F.array(F.struct(F.lit(" ").alias("email")), F.struct(F.concat(F.lit(" l"), k.cast("string"), F.lit("@mail.test")).alias("email")))))
    newer = base.where("person_id % 9 = 0").withColumn("_pos", F.lit(2)).withColumn("city", F.lit("Zuletzt"))
    return export_rows(_groups(spark, sf_dir), fixture(spark, sf_dir, "persons"), fixture(spark, sf_dir, "campuses"), base.unionByName(newer))


# --------------------------------------------------------------------------- oracles

def _groups_cte() -> str:
    """The duplicate_groups oracle, re-opened so more CTEs can follow it."""
    text = MATCH_ORACLES["duplicate_groups"]
    head, select = text.rsplit("\nSELECT CAST(dense_rank()", 1)
    return head + ",\n  groups AS (SELECT CAST(dense_rank()" + select + ")"


_EXPORT = f"""
  base AS (SELECT * FROM persons WHERE person_id IN (SELECT person_id FROM groups)),
  det AS ({'SELECT * FROM person_details'}),
  ov AS (SELECT b.person_id, b.first_name, b.last_name, b.email,
           CASE WHEN {D.nonblank('d.street')} THEN d.street ELSE b.street END AS street,
           CASE WHEN {D.nonblank('d.city')} THEN d.city ELSE b.city END AS city,
           CASE WHEN {D.nonblank('d.created_at')} THEN d.created_at ELSE b.created_at END AS created_at,
           CASE WHEN {D.nonblank('d.invitation_status')} THEN d.invitation_status ELSE b.invitation_status END AS invitation_status,
           CASE WHEN coalesce(d.campus_id, 0) > 0 THEN d.campus_id ELSE b.campus_id END AS campus_id
         FROM base b LEFT JOIN det d ON d.person_id = b.person_id),
  export AS (SELECT g.dup_id, g.person_id, coalesce(o.first_name, '') AS first_name, coalesce(o.last_name, '') AS last_name,
      {D.utrim('o.email')} AS email, coalesce(o.street, '') AS street, coalesce(o.city, '') AS city,
      CASE WHEN coalesce(o.campus_id, 0) > 0 THEN coalesce({D.utrim('c.name')}, '') ELSE '' END AS campus_name,
      {D.format_date('o.created_at')} AS created_at,
      CASE lower({D.utrim('o.invitation_status')}) WHEN 'pending' THEN 'Eingeladen' WHEN 'accepted' THEN 'Registriert'
           ELSE 'NEU' END AS invitation_status
    FROM groups g JOIN ov o ON o.person_id = g.person_id
    LEFT JOIN campuses c ON c.id = o.campus_id AND c.id > 0)"""


def _export_sql(select: str) -> str:
    from doppel.sources.fixtures import fixture_cte
    extra = (f",\n  campuses AS ({fixture_cte('campuses')}),\n  person_details AS ({fixture_cte('person_details')}),"
             f"\n  relationships AS ({fixture_cte('relationships')}),\n  memberships AS ({fixture_cte('memberships')}),")
    return _groups_cte() + extra + _EXPORT + "\n" + select


_TEXT = ["first_name", "last_name", "email", "street", "city", "campus_name", "created_at", "invitation_status"]

_REVIEW = """,
  rbase AS (SELECT dup_id, person_id, 0 AS k FROM groups WHERE person_id % 13 <> 0),
  rstats AS (SELECT dup_id, min(person_id) AS lo, max(person_id) AS hi FROM rbase GROUP BY dup_id),
  rrows AS (SELECT * FROM rbase
    UNION ALL SELECT dup_id, max(person_id), 1 FROM groups WHERE dup_id % 7 = 0 GROUP BY dup_id
    UNION ALL SELECT dup_id, CASE WHEN dup_id % 3 = 0 THEN hi ELSE lo END, 2 FROM rstats WHERE dup_id % 11 = 0),
  review AS (SELECT dup_id, person_id, CAST(row_number() OVER (ORDER BY dup_id, k,
      CASE WHEN dup_id % 3 = 0 THEN -person_id ELSE person_id END) + 1 AS BIGINT) AS line FROM rrows),
  st AS (SELECT dup_id, arg_min(person_id, line) AS primary_id, min(line) AS primary_line, count(*) AS n_rows
         FROM review GROUP BY dup_id),
  oth AS (SELECT r.dup_id, r.person_id, r.line, s.primary_id, r.person_id = s.primary_id AS invalid,
            least(s.primary_id, r.person_id) AS lo, greatest(s.primary_id, r.person_id) AS hi
          FROM review r JOIN st s USING (dup_id) WHERE r.line <> s.primary_line AND s.n_rows >= 2),
  bad AS (SELECT dup_id, min(line) AS bad_line, arg_min(person_id, line) AS bad_id FROM oth WHERE invalid GROUP BY dup_id),
  ex AS (SELECT DISTINCT least(person_id, related_person_id) AS lo, greatest(person_id, related_person_id) AS hi
         FROM relationships WHERE person_id <> related_person_id AND (relationship_type_id = 8
           OR (coalesce(relationship_type_id, 0) = 0 AND """ + D.duplicate_label("name") + """))),
  o2 AS (SELECT o.*, b.bad_line, b.bad_id, (e.lo IS NOT NULL) AS ex FROM oth o LEFT JOIN bad b USING (dup_id)
         LEFT JOIN ex e ON e.lo = o.lo AND e.hi = o.hi),
  ingrp AS (SELECT DISTINCT person_id FROM memberships
            WHERE contains(lower(""" + "{PLAIN}" + """), 'duplikate'))"""


def _plain(x: str) -> str:
    return D.utrim(f"regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '{D.WS}+', ' ', 'g')")


def _review_sql(select: str) -> str:
    return _export_sql("").rstrip() + _REVIEW.replace("{PLAIN}", _plain("group_name")) + "\n" + select


_DRY = """,
  per AS (SELECT dup_id, count(*) AS n_others, sum(CAST(ex AS BIGINT)) AS n_exist, bool_or(bad_line IS NOT NULL) AS failed,
            coalesce(string_agg(CAST(person_id AS VARCHAR), ', ' ORDER BY line) FILTER (WHERE NOT ex), '') AS to_link,
            coalesce(string_agg(CAST(person_id AS VARCHAR), ', ' ORDER BY line) FILTER (WHERE ex), '') AS linked_ids
          FROM o2 GROUP BY dup_id),
  res AS (SELECT s.dup_id, s.primary_id, s.n_rows, p.n_others, p.n_exist, p.to_link, p.linked_ids, (i.person_id IS NOT NULL) AS in_group,
            s.n_rows < 2 AS too_small, coalesce(p.failed, false) AS fail
          FROM st s LEFT JOIN per p USING (dup_id) LEFT JOIN ingrp i ON i.person_id = s.primary_id),
  res2 AS (SELECT dup_id, CASE WHEN too_small THEN 0 ELSE primary_id END AS primary_id, NOT too_small AND NOT fail AS success,
      CASE WHEN NOT too_small AND NOT fail THEN n_others - n_exist ELSE 0 END AS linked,
      CASE WHEN NOT too_small AND NOT fail THEN n_exist ELSE 0 END AS already_linked,
      (NOT too_small AND NOT fail AND in_group) AS vorgemerkt, too_small,
      CASE WHEN too_small THEN 'übersprungen: weniger als zwei Personen'
           WHEN fail THEN 'Beziehungen prüfen fehlgeschlagen: ungültige Personen-IDs für Duplikat-Prüfung'
           WHEN n_exist > 0 AND n_exist = n_others THEN printf('Dry-Run: Person %d ist bereits mit %s verknüpft%s', primary_id, linked_ids, note)
           WHEN n_exist > 0 THEN printf('Dry-Run: Person %d mit %s verknüpfen (%s bereits verknüpft)%s', primary_id, to_link, linked_ids, note)
           ELSE printf('Dry-Run: würde Person %d mit %s verknüpfen%s', primary_id, to_link, note) END AS message
    FROM (SELECT *, CASE WHEN in_group THEN printf('; Person %d bereits in Gruppe "Duplikate"', primary_id)
                         ELSE printf('; Person %d würde in Gruppe "Duplikate" aufgenommen', primary_id) END AS note FROM res) r),"""

_APPLY = """,
  proc AS (SELECT * FROM o2 WHERE bad_line IS NULL OR line < bad_line),
  first_seen AS (SELECT lo, hi, min(struct_pack(d := dup_id, l := line)) AS f FROM proc GROUP BY lo, hi),
  proc2 AS (SELECT p.*, (NOT p.ex AND f.f = struct_pack(d := p.dup_id, l := p.line)) AS creates FROM proc p JOIN first_seen f USING (lo, hi)),
  per AS (SELECT dup_id, sum(CAST(creates AS BIGINT)) AS n_new, sum(CAST(NOT creates AS BIGINT)) AS n_already FROM proc2 GROUP BY dup_id),
  grp AS (SELECT count(*) AS n_matches, min(group_id) AS group_id FROM (SELECT group_id, first(group_name) AS group_name
          FROM memberships GROUP BY group_id) g WHERE contains(""" + "{PLAIN}" + """, 'Duplikate')),
  res AS (SELECT s.dup_id, s.primary_id, s.n_rows, coalesce(p.n_new, 0) AS n_new, coalesce(p.n_already, 0) AS n_already,
            b.bad_id, s.n_rows < 2 AS too_small, (SELECT n_matches FROM grp) <> 1 AS group_fail
          FROM st s LEFT JOIN per p USING (dup_id) LEFT JOIN bad b USING (dup_id)),
  res2 AS (SELECT dup_id, CASE WHEN too_small THEN 0 ELSE primary_id END AS primary_id,
      NOT too_small AND bad_id IS NULL AND NOT group_fail AS success,
      CASE WHEN NOT too_small AND bad_id IS NULL AND NOT group_fail THEN n_new ELSE 0 END AS linked,
      CASE WHEN NOT too_small AND bad_id IS NULL AND NOT group_fail THEN n_already ELSE 0 END AS already_linked,
      false AS vorgemerkt, too_small,
      CASE WHEN too_small THEN 'übersprungen: weniger als zwei Personen'
           WHEN bad_id IS NOT NULL THEN printf('Beziehung %d -> %d prüfen fehlgeschlagen: ungültige Personen-IDs für Duplikat-Prüfung', primary_id, bad_id)
           WHEN group_fail THEN CASE WHEN (SELECT n_matches FROM grp) = 0 THEN 'Gruppe "Duplikate": Gruppe nicht gefunden: "Duplikate"'
                                     ELSE 'Gruppe "Duplikate": mehrere Gruppen passen zu "Duplikate"' END
           WHEN n_new > 0 AND n_already > 0 THEN printf('Person %d: %d Beziehung(en) angelegt, %d bereits vorhanden; Person %d in Gruppe "Duplikate"', primary_id, n_new, n_already, primary_id)
           WHEN n_already = n_rows - 1 THEN printf('Person %d: alle %d Duplikat-Beziehung(en) bereits vorhanden; Person %d in Gruppe "Duplikate"', primary_id, n_already, primary_id)
           ELSE printf('Person %d mit %d Dublette(n) verknüpft; Person %d in Gruppe "Duplikate"', primary_id, n_new, primary_id) END AS message
    FROM res),"""

_RESULT = """
  results AS (SELECT dup_id, CAST(primary_id AS BIGINT) AS primary_id, success, CAST(linked AS BIGINT) AS linked,
      CAST(already_linked AS BIGINT) AS already_linked, vorgemerkt, message,
      CASE WHEN NOT success THEN CASE WHEN too_small THEN 'skipped' ELSE 'failed' END
           WHEN linked = 0 AND already_linked > 0 THEN 'skipped'
           WHEN vorgemerkt THEN 'skipped' ELSE 'ok' END AS status FROM res2)"""

_SUMMARY = """SELECT CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS n_ok,
  CAST(count(*) FILTER (WHERE status = 'skipped') AS BIGINT) AS n_skipped,
  CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS n_failed,
  CAST(coalesce(sum(linked) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS linked_total,
  CAST(coalesce(sum(already_linked) FILTER (WHERE status <> 'failed'), 0) AS BIGINT) AS existing_total,
  coalesce(bool_or(status = 'failed'), false) AS any_failed FROM results"""


def _dry_sql(select: str) -> str:
    return _review_sql("").rstrip() + _DRY + _RESULT + "\n" + select


def _apply_sql(select: str) -> str:
    return _review_sql("").rstrip() + _APPLY.replace("{PLAIN}", _plain("group_name")) + _RESULT + "\n" + select


_PIECES = """,
  ids AS (SELECT o.dup_id, CASE WHEN o.ex THEN 3 ELSE 1 END AS section, o.line, CAST(o.person_id AS VARCHAR) AS t FROM o2 o
          JOIN res r ON r.dup_id = o.dup_id WHERE NOT r.too_small AND NOT r.fail),
  placed AS (SELECT *, coalesce(sum(strlen(t) + 2) OVER (PARTITION BY dup_id, section ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ids),
  lists AS (SELECT dup_id, section, CAST(floor(pos / 12.0) AS BIGINT) AS chunk, string_agg(t, ', ' ORDER BY line) AS t FROM placed GROUP BY ALL),
  notes AS (SELECT *, CASE WHEN in_group THEN printf('; Person %d bereits in Gruppe "Duplikate"', primary_id)
      ELSE printf('; Person %d würde in Gruppe "Duplikate" aufgenommen', primary_id) END AS note FROM res),
  fixed AS (SELECT dup_id, 0 AS section, CASE WHEN too_small THEN 'übersprungen: weniger als zwei Personen'
        WHEN fail THEN 'Beziehungen prüfen fehlgeschlagen: ungültige Personen-IDs für Duplikat-Prüfung'
        WHEN n_exist = n_others THEN printf('Dry-Run: Person %d ist bereits mit ', primary_id)
        WHEN n_exist > 0 THEN printf('Dry-Run: Person %d mit ', primary_id) ELSE printf('Dry-Run: würde Person %d mit ', primary_id) END AS t FROM notes
    UNION ALL SELECT dup_id, 2, ' verknüpfen (' FROM notes WHERE NOT too_small AND NOT fail AND n_exist > 0 AND n_exist < n_others
    UNION ALL SELECT dup_id, 4, CASE WHEN n_exist = n_others THEN ' verknüpft' WHEN n_exist > 0 THEN ' bereits verknüpft)' ELSE ' verknüpfen' END || note
      FROM notes WHERE NOT too_small AND NOT fail)
SELECT dup_id, section, CAST(0 AS BIGINT) AS chunk, t AS text FROM fixed
UNION ALL SELECT dup_id, section, chunk, CASE WHEN chunk > 0 THEN ', ' ELSE '' END || t FROM lists"""


def _accounts_sql() -> str:
    """The export's text with richer details and an account rule of its own."""
    text = _export_sql("SELECT * FROM export")
    text = text.replace("det AS (SELECT * FROM person_details)", """det AS (
    SELECT person_id, street, CASE WHEN person_id % 9 = 0 THEN 'Zuletzt' ELSE city END AS city, created_at, invitation_status, campus_id FROM person_details)""")
    mail = "CASE WHEN " + D.nonblank("o.email") + " THEN o.email WHEN o.person_id % 3 = 0 THEN 'l' || o.person_id || '@mail.test' ELSE '' END"
    text = text.replace(D.utrim("o.email") + " AS email", D.utrim(mail) + " AS email")
    text = text.replace("CASE WHEN coalesce(o.campus_id, 0) > 0 THEN", "CASE WHEN o.person_id % 8 = 0 THEN 'Eigener Standort' WHEN coalesce(o.campus_id, 0) > 0 THEN")
    flags = " OR ".join(f"o.person_id % {n} = 0" for n in (17, 19, 23, 29, 31, 37))
    return text.replace("ELSE 'NEU' END AS invitation_status", f"ELSE CASE WHEN {flags} THEN 'Registriert' ELSE 'NEU' END END AS invitation_status")


ORACLES = {
    "reconcile_messages": _review_sql("").rstrip() + _DRY.split(",\n  res2 AS")[0] + _PIECES,
    "export_accounts": _accounts_sql(),
    "export_review": _export_sql("SELECT * FROM export"),
    "export_summary": _export_sql("SELECT count(*) AS n_rows, count(DISTINCT dup_id) AS n_clusters FROM export"),
    "review_csv_roundtrip": _export_sql(
        "SELECT dup_id, person_id, " + ", ".join(f"{D.utrim(c)} AS {c}" for c in _TEXT)
        + ", CAST(row_number() OVER (ORDER BY dup_id, person_id) + 1 AS BIGINT) AS line FROM export"),
    "review_csv_invalid": _export_sql(
        """SELECT line, CASE WHEN person_id % 17 = 0 THEN 'DupID fehlt' ELSE printf('ungültige ID "x%d"', person_id) END AS reason
  FROM (SELECT *, CAST(row_number() OVER (ORDER BY dup_id, person_id) + 1 AS BIGINT) AS line FROM export) t
  WHERE person_id % 17 = 0 OR person_id % 19 = 0"""),
    "review_csv_multiline": _export_sql(f"""SELECT CAST(row_number() OVER (ORDER BY dup_id, person_id) + 1 AS BIGINT) AS line, dup_id, person_id,
  {D.utrim("street || CASE WHEN person_id % 5 = 0 THEN chr(10) || 'Hinterhaus' || chr(10) || chr(10) || 'Treppe 2' ELSE '' END "
           "|| CASE WHEN person_id % 3 = 0 THEN '; \"links\", oben' ELSE '' END")} AS street, {D.utrim('city')} AS city FROM export"""),
    "review_primary": _review_sql("SELECT dup_id, primary_id, n_rows FROM st"),
    "review_grouped": _review_sql(
        "SELECT dup_id, person_id, line, CAST(row_number() OVER (PARTITION BY dup_id ORDER BY line) AS BIGINT) AS pos FROM review"),
    "reconcile_dry_run": _dry_sql("SELECT * FROM results"),
    "reconcile_apply": _apply_sql("SELECT * FROM results"),
    "links_to_create": _apply_sql(
        "SELECT primary_id AS person_id, person_id AS related_person_id, CAST(8 AS INTEGER) AS relationship_type_id FROM proc2 WHERE creates"),
    "memberships_to_add": _apply_sql(
        """SELECT DISTINCT CAST(r.primary_id AS BIGINT) AS person_id, CAST((SELECT group_id FROM grp) AS BIGINT) AS group_id
  FROM results r WHERE r.success AND (SELECT n_matches FROM grp) = 1
  AND NOT EXISTS (SELECT 1 FROM memberships m WHERE m.person_id = r.primary_id AND m.group_id = (SELECT group_id FROM grp))"""),
    "reconcile_summary": _dry_sql(_SUMMARY),
    "reconcile_apply_summary": _apply_sql(_SUMMARY),
}

QUERIES = {
    "reconcile_messages": reconcile_messages,
    "export_accounts": export_accounts,
    "export_review": export_review,
    "export_summary": export_summary_q,
    "review_csv_roundtrip": review_csv_roundtrip,
    "review_csv_invalid": review_csv_invalid,
    "review_csv_multiline": review_csv_multiline,
    "review_primary": review_primary,
    "review_grouped": review_grouped,
    "reconcile_dry_run": reconcile_dry_run,
    "reconcile_apply": reconcile_apply,
    "links_to_create": links_to_create,
    "memberships_to_add": memberships_to_add,
    "reconcile_summary": reconcile_summary,
    "reconcile_apply_summary": reconcile_apply_summary,
}
