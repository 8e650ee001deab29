import os
import tempfile

import pytest
from pyspark.sql import functions as F

from doppel.operators.reconcile import reconcile
from doppel.sources.review_csv import detect_delimiter, map_columns, read_review_csv, write_review_csv


def _write(text):
    d = tempfile.mkdtemp(prefix="doppel-csv-")
    with open(os.path.join(d, "dup.csv"), "w", encoding="utf-8") as fh:
        fh.write(text)
    return d


def test_bom_and_aliases(spark):
    path = _write("﻿DupID,ID,Vorname,Nachname\n1,101,Max,Muster\n\n1,102,Maxi,Muster\n")
    rows, _ = read_review_csv(spark, path)
    got = sorted((r.dup_id, r.person_id, r.first_name, r.line) for r in rows.collect())
    assert got == [(1, 101, "Max", 2), (1, 102, "Maxi", 3)]


@pytest.mark.parametrize("sep", [";", "\t"])
def test_other_delimiters(spark, sep):
    path = _write(sep.join(["Gruppe", "person_id", "Stadt"]) + "\n" + sep.join(["2", " 7", "Mainz, Rhein"]) + "\n")
    rows, _ = read_review_csv(spark, path)
    r = rows.first()
    assert (r.dup_id, r.person_id, r.city) == (2, 7, "Mainz, Rhein")


def test_quoted_comma_and_blank_record(spark):
    path = _write('DupID,ID,Straße\n1,5,"Weg 1, Hinterhaus"\n,,\n1,6,"Say ""hi"""\n')
    rows, _ = read_review_csv(spark, path)
    got = sorted((r.person_id, r.street, r.line) for r in rows.collect())
    assert got == [(5, "Weg 1, Hinterhaus", 2), (6, 'Say "hi"', 4)]


def test_invalid_rows(spark):
    path = _write("DupID,ID\n1,5\nx,6\n1,-3\n")
    with pytest.raises(ValueError, match="zeile 3"):
        read_review_csv(spark, path)
    _, invalid = read_review_csv(spark, path, strict=False)
    assert sorted((r.line, r.reason) for r in invalid.collect()) == [(3, 'ungültige DupID "x"'), (4, 'ungültige ID "-3"')]


def test_header_mapping_rules():
    assert map_columns(["ID", "dupid", "id"]) == {"dup_id": 1, "person_id": 2}
    assert detect_delimiter("DupID;ID;Vorname") == ";"
    with pytest.raises(ValueError):
        detect_delimiter("a,b,c")


def test_write_read_roundtrip(spark):
    rows = spark.createDataFrame(
        [(1, 10, "Max", "Muster", "m@x.org", 'Weg "1", a', "Mainz", "", "01.02.2024", "NEU"),
         (1, 11, " Max", "", "", "", "", "Nord", "", "Registriert")],
        "dup_id long, person_id long, first_name string, last_name string, email string, street string, "
        "city string, campus_name string, created_at string, invitation_status string")
    path = tempfile.mkdtemp(prefix="doppel-out-") + "/review"
    write_review_csv(rows, path)
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    assert text.startswith("﻿DupID,ID,Vorname,Nachname,E-Mail,Straße,Stadt,Standort,Erstellungsdatum,Einladungsstatus")
    assert '"Weg ""1"", a"' in text
    back, _ = read_review_csv(spark, path)
    assert sorted((r.person_id, r.street, r.first_name) for r in back.collect()) == [(10, 'Weg "1", a', "Max"), (11, "", "Max")]


def _review(spark, rows):
    return spark.createDataFrame(rows, "dup_id long, person_id long, line long")


def _rels(spark, rows):
    return spark.createDataFrame(rows, "person_id long, related_person_id long, relationship_type_id int, name string")


def _members(spark, rows):
    return spark.createDataFrame(rows, "person_id long, group_id long, group_name string")


def test_reconcile_dry_run_and_apply(spark):
    review = _review(spark, [(1, 10, 2), (1, 11, 3), (1, 12, 4), (2, 20, 5), (3, 30, 6), (3, 31, 7), (3, 11, 8),
                             (4, 40, 9), (4, 40, 10)])
    rels = _rels(spark, [(11, 10, 8, ""), (30, 31, 0, "Mögliche Dublette"), (10, 12, 5, "Kontakt")])
    members = _members(spark, [(10, 900, "<b>Duplikate</b>"), (99, 901, "andere")])
    dry = {r.dup_id: r for r in reconcile(review, rels, members, dry_run=True).results.collect()}
    assert (dry[1].linked, dry[1].already_linked, dry[1].vorgemerkt, dry[1].status) == (1, 1, True, "skipped")
    assert dry[1].message == ('Dry-Run: Person 10 mit 12 verknüpfen (11 bereits verknüpft); '
                              'Person 10 bereits in Gruppe "Duplikate"')
    assert (dry[2].primary_id, dry[2].status) == (0, "skipped")
    assert (dry[3].linked, dry[3].already_linked, dry[3].status) == (1, 1, "ok")
    assert dry[4].status == "failed"
    res = reconcile(review, rels, members, dry_run=False)
    app = {r.dup_id: r for r in res.results.collect()}
    assert (app[1].linked, app[1].already_linked, app[1].status) == (1, 1, "ok")
    assert app[1].message == 'Person 10: 1 Beziehung(en) angelegt, 1 bereits vorhanden; Person 10 in Gruppe "Duplikate"'
    assert sorted((r.person_id, r.related_person_id) for r in res.links.collect()) == [(10, 12), (30, 11)]
    assert sorted((r.person_id, r.group_id) for r in res.memberships.collect()) == [(30, 900)]
    s = res.summary.first()
    assert (s.n_ok, s.n_skipped, s.n_failed, s.linked_total, s.existing_total, s.any_failed) == (2, 1, 1, 2, 2, True)


def test_reconcile_sequential_link_seen_later(spark):
    # the pair (10, 11) is met twice in one apply run: created once, then found
    review = _review(spark, [(1, 10, 2), (1, 11, 3), (2, 10, 4), (2, 11, 5)])
    res = reconcile(review, _rels(spark, []), _members(spark, [(1, 900, "Duplikate")]), dry_run=False)
    app = {r.dup_id: r for r in res.results.collect()}
    assert (app[1].linked, app[1].already_linked, app[2].linked, app[2].already_linked) == (1, 0, 0, 1)
    assert app[2].status == "skipped"
    assert res.links.count() == 1
    dry = {r.dup_id: r for r in reconcile(review, _rels(spark, []), _members(spark, []), dry_run=True).results.collect()}
    assert (dry[2].linked, dry[2].already_linked) == (1, 0)
