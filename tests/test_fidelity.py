"""Single rules of ingest, overlay, reconcile and numbering on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from doppel.operators.enrich import overlay_details
from doppel.operators.ranking import dense_number
from doppel.operators.reconcile import reconcile
from doppel.sources import ingest
from doppel.sources.review_csv import group_review


def items(spark, *rows):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "pos long, j string").select(
        "pos", F.parse_json("j").alias("item"))


def test_ids_beyond_a_double(spark):
    big = (1 << 53) + 1
    got = ingest.decode_persons(items(spark, {"id": big, "campusId": (1 << 33) + 1})).first()
    assert (got.person_id, got.campus_id) == (big, (1 << 33) + 1)


def test_blank_spelling_gives_way_to_the_other(spark):
    rows = items(spark, {"id": 1, "invitationStatus": " ", "invitation_status": "pending"}, {"id": 2, "invitationStatus": "accepted"})
    got = {r.person_id: r.invitation_status for r in ingest.decode_persons(rows).collect()}
    assert got == {1: "pending", 2: "accepted"}


def test_quarantine(spark):
    rows = items(spark, {"id": "5"}, {"id": 6, "firstName": 7}, {"id": 8, "firstName": "A", "lastName": None}, {"id": 1.5}, {})
    got = [r.reason for r in ingest.invalid_persons(rows).collect()]
    assert sorted(got) == sorted(["id is not a whole number"] * 3 + ["firstName is not text"])


def test_relationship_ids(spark):
    rows = items(spark, {"relative": {"domainIdentifier": "p-12"}}, {"person": {"domainIdentifier": "p-13"}}, {"relative": {"domainIdentifier": "14"}})
    got = ingest.decode_relationships(rows, F.lit(1)).collect()
    assert sorted(r.related_person_id for r in got) == [12, 14]


def test_nested_group_falls_back_to_the_row(spark):
    rows = items(spark, {"id": 4, "name": "Outer", "group": {"title": "no id"}}, {"group": {"id": 5, "name": "First"}},
                 {"group": {"id": 5, "name": "Again"}}, {"name": "no id at all"})
    got = sorted(map(tuple, ingest.decode_groups(rows, F.lit(9)).collect()))
    assert got == [(9, 4, "Outer"), (9, 5, "First")]


@pytest.mark.parametrize("pages,last,ok", [((1, 2), 2, True), ((1, 3), 2, False), ((1, 2, 2), 2, False), ((2, 3), 2, False)])
def test_page_sets(spark, pages, last, ok):
    text = [(json.dumps({"data": [{"id": p}], "meta": {"pagination": {"current": p, "lastPage": last}}}),) for p in pages]
    df = spark.createDataFrame(text, "value string")
    if ok:
        assert ingest.page_items(df).count() == len(pages)
    else:
        with pytest.raises(ValueError):
            ingest.page_items(df)


def test_overlay(spark):
    base = spark.createDataFrame([(1, "A", ["x"]), (2, "B", ["y"])], "person_id long, city string, emails array<string>")
    details = spark.createDataFrame([(1, 1, "old", [], "n"), (1, 2, " ", [], "Nord"), (2, 1, "C", ["z"], None)],
                                    "person_id long, _pos int, city string, emails array<string>, campus_name string")
    got = overlay_details(base, details).orderBy("person_id").collect()
    assert [tuple(r) for r in got] == [(1, "A", ["x"], "Nord"), (2, "C", ["z"], None)]


def test_keys_of_two_columns_do_not_collide(spark):
    big = 1 << 32
    rows = spark.createDataFrame([(1, 10, big + 2), (1, 11, big + 5), (2, 12, 2), (2, 13, 3), (1 << 40, 14, 1)],
                                 "dup_id long, person_id long, line long")
    got = {(r.dup_id, r.line): (r.pos, r.primary_id) for r in group_review(rows).collect()}
    assert got == {(1, big + 2): (1, 10), (1, big + 5): (2, 10), (2, 2): (1, 12), (2, 3): (2, 12), (1 << 40, 1): (1, 14)}


def test_numbering_over_several_ranges(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 501).alias("k"))
    got = dense_number(df, "k", "n", rows_per_range=40).orderBy("k").collect()
    assert [(r.k, r.n) for r in got] == [(i, i + 1) for i in range(501)]


@pytest.mark.parametrize("name,found", [("100% Doppelt", True), ("  ", True), ("Unbekannt", False)])
def test_group_names(spark, name, found):
    """A per cent sign is text, a blank name is the default, an empty group can be the target."""
    review = spark.createDataFrame([(1, 5, 2), (1, 6, 3)], "dup_id long, person_id long, line long")
    links = spark.createDataFrame([], "person_id long, related_person_id long, relationship_type_id int, name string")
    members = spark.createDataFrame([], "person_id long, group_id long, group_name string")
    groups = spark.createDataFrame([(3, "100% Doppelt"), (4, "Duplikate")], "group_id long, group_name string")
    got = reconcile(review, links, members, dry_run=False, group_name=name, groups=groups)
    row = got.results.first()
    shown = name.strip() or "Duplikate"
    assert row.success is found and f'"{shown}"' in row.message
    assert got.memberships.count() == int(found)
    assert f'"{shown}"' in reconcile(review, links, members, group_name=name, groups=groups).results.first().message
