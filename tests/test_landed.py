"""Landed scans: completeness, strict decode, members, sources; lookups over them."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from doppel.operators import lookup as L
from doppel.operators.enrich import last_record_per_id
from doppel.operators.name_search import substring_hits
from doppel.operators.ranking import running_sum
from doppel.operators.reconcile import dry_run_messages, reconcile
from doppel.sources import ingest
from doppel.sources.scans import items_of, parse_envelopes, scan_status, with_file_position


def envelope(page, last, items):
    return json.dumps({"data": items, "meta": {"pagination": {"current": page, "lastPage": last}}})


def scans(spark, rows):
    return spark.createDataFrame(rows, "scan string, value string")


def items(spark, *records):
    return items_of(parse_envelopes(scans(spark, [("s", json.dumps({"data": list(records)}))])))


def test_every_scan_is_checked_on_its_own(spark):
    rows = [("whole", envelope(p, 3, [{"id": p}])) for p in (3, 1, 2)]
    rows += [("gap", envelope(p, 5, [])) for p in (1, 2, 4)] + [("late", envelope(2, 2, []))]
    rows += [("twice", envelope(p, 2, [])) for p in (1, 2, 2)] + [("plain", json.dumps({"data": {"id": 1}}))]
    rows += [("bad", "{"), ("bad", envelope(1, 1, [])), ("nothing", None), ("list", "[1]")]
    # pages far apart are in bitmaps of their own
    rows += [("far", envelope(p, 70_000, [])) for p in (1, 40_000, 70_000)]
    got = {r.scan: (r.pages, r.last_page, r.missing, r.doubled, r.first_gap, r.unreadable, r.complete)
           for r in scan_status(parse_envelopes(scans(spark, rows), scan_col="scan")).collect()}
    assert got == {"whole": (3, 3, 0, 0, None, 0, True), "gap": (3, 5, 2, 0, 3, 0, False), "late": (1, 2, 1, 0, 1, 0, False),
                   "twice": (2, 2, 0, 1, None, 0, False), "plain": (1, 1, 0, 0, None, 0, True), "bad": (1, 1, 0, 0, None, 1, False),
                   "nothing": (0, 0, 0, 0, None, 1, False), "list": (0, 0, 0, 0, None, 1, False), "far": (3, 70_000, 69_997, 0, 2, 0, False)}


@pytest.mark.parametrize("rows,said", [([("a", envelope(1, 1, [])), ("b", envelope(1, 2, []))], "'b'.*incomplete.*missing is 2"),
                                       ([("a", envelope(1, 1, []))] * 2, "landed twice"), ([("a", "x")], "no JSON"),
                                       ([("a", envelope(p, 3, [])) for p in (1, 2, 3)], "more than 2")])
def test_incomplete_scans_raise(spark, rows, said):
    with pytest.raises(ValueError, match=said):
        ingest.page_items(scans(spark, rows), scan_col="scan", max_pages=2)


def test_reading_order_of_items(spark):
    rows = [("b", envelope(1, 1, [7])), ("a", envelope(2, 2, [8, 9])), ("a", envelope(1, 2, [{"x": 1}, None]))]
    got = items_of(parse_envelopes(scans(spark, rows), scan_col="scan")).orderBy("pos").select("scan", "page", "pos.place", F.to_json("item").alias("j"))
    assert [tuple(r) for r in got.collect()] == [("a", 1, 0, '{"x":1}'), ("a", 1, 1, "null"), ("a", 2, 0, "8"), ("a", 2, 1, "9"), ("b", 1, 0, "7")]


STRICT = [({"id": "5"}, ["id is not a whole number"]), ({"id": 2.5}, ["id is not a whole number"]), ({"id": 6, "email": ["x"]}, ["email is not text"]),
          ({"id": 7, "emails": [{"email": 1, "contactLabelId": True}]}, ["emails[0].email is not text", "emails[0].contactLabelId is not a whole number"]),
          ({"id": 8, "invitationStatus": 1, "lastName": False}, ["lastName is not text", "invitationStatus is not text"]), ([1], ["the record is not an object"]),
          ("text", ["the record is not an object"])]
GOOD = [{"id": 9, "firstName": None, "emails": None}, {"id": 10, "emails": [None, {"email": "m@mail.test"}], "isSystemUser": {}, "street": 5}]


def test_strict_load(spark):
    rows = items(spark, *[r for r, _ in STRICT], *GOOD, {"id": 0}, {}, None)
    persons, quarantine = ingest.load_persons(rows, strict=False)
    assert sorted(r.person_id for r in persons.collect()) == [9, 10]
    assert sorted((json.dumps(json.loads(r.item), sort_keys=True), r.errors) for r in quarantine.collect()) == \
        sorted((json.dumps(r, sort_keys=True), e) for r, e in STRICT)
    with pytest.raises(ValueError, match="person parsen"):
        ingest.load_persons(rows)
    assert ingest.load_persons(items(spark, *GOOD))[0].count() == 2


def test_groups_and_campuses(spark):
    rows, quarantine = ingest.decode_id_names(items(spark, {"id": 3, "name": "Süd"}, {"id": 4}, {"id": 0, "name": "x"}, {"name": "y"}, {"id": 5, "name": 1}, 7), strict=False)
    assert sorted((r.id, r.name) for r in rows.collect()) == [(3, "Süd"), (4, "")]
    assert sorted(r.errors[0] for r in quarantine.collect()) == ["name is not text", "the record is not an object"]
    with pytest.raises(ValueError, match="name is not text"):
        ingest.decode_id_names(items(spark, {"id": 5, "name": 1}))


def test_members_in_first_seen_order(spark):
    rows = [("s", envelope(2, 2, [{"personId": 3}, {"person": {"id": 8}}, {"personId": 5}])),
            ("s", envelope(1, 2, [{"person": {"id": 5}}, {"personId": "9"}, {"personId": 0, "person": {"id": 4}}, {"personId": None, "person": {"id": 3}}, 12]))]
    got = ingest.decode_members(ingest.page_items(scans(spark, rows), scan_col="scan")).orderBy("first_pos")
    assert [r.person_id for r in got.collect()] == [5, 3, 8]


def test_first_filled_source(spark):
    base = tempfile.mkdtemp(prefix="doppel-sources-")
    texts = {"broken": '{"data":[{"id":1}', "empty": envelope(1, 1, [{"id": -1}]), "gap": envelope(1, 2, [{"id": 4, "name": "gap"}]),
             "good": envelope(1, 1, [{"id": 2, "name": " Kind "}, {"id": 3, "name": 4, "exportTitle": "E"}, {"id": "x"}]), "later": envelope(1, 1, [{"id": 9}]),
             "wrong": envelope(1, 1, [5])}
    for name, text in texts.items():
        with open(os.path.join(base, name), "w") as f:
            f.write(text + "\n")

    def of(*names):
        return ingest.first_filled_source(spark, [os.path.join(base, n) for n in names])

    got = of("absent", "broken", "empty", "gap", "good", "later").orderBy("pos")
    assert [(r.id, r.name, r.export_title) for r in got.collect()] == [(2, "Kind", ""), (3, "", "E")]
    assert of("later", "wrong").first().id == 9
    for names, error in ((("absent",), LookupError), (("broken", "empty"), LookupError), (("empty", "wrong", "good"), ValueError)):
        with pytest.raises(error):
            of(*names)


def types(spark, rows):
    return spark.createDataFrame(rows, "id int, name string, degree_name_a string, degree_name_b string, export_title string, pos int")


def test_requests_for_types(spark):
    t = types(spark, [(4, "Pate", "", "", "", 1), (5, "pate ", "", "", "", 0), (6, " ", "", "", "", 2), (9, "Dublette", "", "", "", 3), (4, "Zweiter", "", "", "", 4)])
    asked = spark.createDataFrame([(1, 4, None, ""), (2, 7, None, "x"), (3, 0, 9, "Pate"), (4, None, 77, "id 6"), (5, 0, 8, " PATE"), (6, 0, 8, "Onkel"), (7, 0, None, None)],
                                  "req int, type_id long, default_id long, name string")
    got = {r.req: (r.outcome, r.id, r.name, r.n_matches, r.candidates) for r in L.resolve_duplicate_types(t, asked).collect()}
    assert got == {1: ("id", 4, "Pate", 0, ""), 2: ("id missing", None, None, 0, ""), 3: ("default", 9, "Dublette", 0, ""), 4: ("name", 6, "ID 6", 1, ""),
                   5: ("name ambiguous", None, None, 2, '"pate" (ID 5), "Pate" (ID 4)'), 6: ("name missing", None, None, 0, ""), 7: ("score", 9, "Dublette", 0, "")}
    assert L.resolve_duplicate_types(t.where("id < 9"), asked.where("req = 7")).first().outcome == "none"
    with pytest.raises(LookupError, match='"pate" \\(ID 5\\)'):
        L.resolve_duplicate_type(t, default_id=None, name="pate")


def test_substring_index(spark):
    names = ["Duplikate", "<alt>", "a", "", "ab", "xab", "Grüße 1%_", "日本語の名前", "aaaa", "ab"]
    needles = ["a", "ab", "Dup", "likat", "", "zz", "%_", "日本語", "aaa", "aaaaa", "ab", "ße 1"]
    n = spark.createDataFrame(list(enumerate(names)), "id int, plain string")
    q = spark.createDataFrame(list(enumerate(needles)), "pos int, needle string")
    got = sorted((r.pos, r.id) for r in substring_hits(n, q, "plain", "needle").collect())
    assert got == sorted((i, j) for i, x in enumerate(needles) for j, y in enumerate(names) if x and x in y)
    plan = substring_hits(n, q, "plain", "needle")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_name_counts_broadcast_no_index(spark):
    """Equal needles and equal names are counted, not multiplied; only hashes of needles are broadcast."""
    rows = [(i, f"<b>large ring</b> Brand#{i % 7} {i % 400}") for i in range(800)]
    path = tempfile.mkdtemp(prefix="doppel-names-") + "/groups"
    spark.createDataFrame(rows, "group_id long, group_name string").write.parquet(path)
    texts = ["#1", "large ring", "Brand#3 3", "large ring Brand#3 3", "LARGE", "9", "ring Brand#2 2", "zz", "e"] * 40 + [""]
    names = spark.createDataFrame(list(enumerate(texts)), "pos long, name string")
    found = L.find_groups_by_name(spark.read.parquet(path), names)
    plain = [(i, n.replace("<b>", "").replace("</b>", "")) for i, n in rows]
    want = {t: [i for i, n in plain if t in n] for t in set(texts) - {""}}
    assert {(r.pos, r.name, r.n_matches, r.group_id) for r in found.collect()} == {
        (i, t, len(want[t]), want[t][0] if len(want[t]) == 1 else None) for i, t in enumerate(texts) if t}
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
    assert all("LeftSemi" in x for x in joins)


def test_records_by_reading_order(spark):
    path = tempfile.mkdtemp(prefix="doppel-order-")
    for part, rows in ((99999, [(1, "b"), (2, "x")]), (100000, [(1, "a")])):
        with open(os.path.join(path, f"part-{part}.json"), "w") as f:
            f.writelines(json.dumps({"person_id": i, "name": n}) + "\n" for i, n in rows)
    read = with_file_position(spark.read.schema("person_id long, name string").json(path))
    last = last_record_per_id(read, "pos").select("person_id", "name").collect()
    assert sorted(map(tuple, last)) == [(1, "a"), (2, "x")]
    groups = read.selectExpr("1 AS person_id", "person_id AS group_id", "name AS group_name", "pos")
    assert sorted((r.group_id, r.group_name) for r in L.person_groups(groups).collect()) == [(1, "b"), (2, "x")]
    # markup alone shows as blank, no name at all is passed over
    odd = spark.createDataFrame([(1, 2, "<b></b>"), (1, 3, " ")], "person_id long, group_id long, group_name string")
    assert [tuple(r) for r in L.person_groups(odd).collect()] == [(1, 2, "")]


def test_list_order(spark):
    persons = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "b", 1), (3, "c", 1)], "person_id long, name string, _pos int")
    ids = spark.createDataFrame([(5, 2), (1, 3), (3, 1), (4, 99), (9, 1)], "pos int, person_id long")
    assert [(r.pos, r.name) for r in L.persons_by_ids(persons, ids).collect()] == [(1, "c"), (3, "new"), (5, "b"), (9, "new")]


def test_running_sum(spark):
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("k"), (F.col("id") % 5).alias("v"))
    got = running_sum(df, ["k"], "v", "before", rows_per_range=40).orderBy("k").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.v


def test_messages_in_pieces(spark):
    review = spark.createDataFrame([(1, 10, 2)] + [(1, 100 + i, 3 + i) for i in range(40)] + [(2, 7, 50), (3, 8, 51), (3, 9, 52), (4, 5, 60), (4, 5, 61)],
                                   "dup_id long, person_id long, line long")
    links = spark.createDataFrame([(10, 100 + i, 8, "") for i in range(0, 40, 3)] + [(9, 8, 8, "")], "person_id long, related_person_id long, relationship_type_id int, name string")
    members = spark.createDataFrame([(8, 900, "Duplikate")], "person_id long, group_id long, group_name string")
    want = {r.dup_id: r.message for r in reconcile(review, links, members, dry_run=True).results.collect()}
    pieces = dry_run_messages(review, links, members, chunk=20).collect()
    assert max(len(p.text) for p in pieces if p.section in (1, 3)) < 30 and len(pieces) > 12
    got = {}
    for p in sorted(pieces, key=lambda p: (p.dup_id, p.section, p.chunk)):
        got[p.dup_id] = got.get(p.dup_id, "") + p.text
    assert got == want
