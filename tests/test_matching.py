"""Matching rules one by one, then whole clusterings against ``brute``."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from conftest import persons_df
from doppel.functions import normalize as N
from doppel.functions import predicates as P
from doppel.operators.groups import find_duplicate_groups
from doppel.operators.pairs import match_edges

COLUMNS = ["person_id", "campus_id", "first_name", "last_name", "email", "street", "city"]


def evaluate(spark, rule, *texts):
    names = [f"x{i}" for i in range(len(texts))]
    row = spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names))
    return row.select(rule(*map(F.col, names))).first()[0]


def cities_equal(a, b):
    a, b = N.city_parts(a), N.city_parts(b)
    return P.city_equal(a["main"], a["by"], b["main"], b["by"])


@pytest.mark.parametrize("same,pairs", [
    (True, [("Lauffen", "Lauffen am Neckar"), ("Lauffen/N", "Lauffen/Neckar"), ("Kehl i. Baden", "Kehl/Baden."),
            ("Neustadt an der Dosse", "neustadt a.d. dosse"), ("/Ulm", "/ulm"), ("Au/Iller", " Au/iller ")]),
    (False, [("Ulm", "Gera"), ("Neustadt an der Dosse", "Neustadt an der Orla"), ("", "Ulm"), ("", ""), ("Au/ä", "Au/ägeri"),
             ("Rot/a", "Rot/b")]),
])
def test_cities(spark, same, pairs):
    for a, b in pairs:
        assert evaluate(spark, cities_equal, a, b) is same, (a, b)
        assert brute.same_town(brute.town(a), brute.town(b)) is same, (a, b)


def test_streets(spark):
    for a, b in [("Ringstr. 9", "RINGSTRASSE 9"), ("Ringstraße 9", "Ringstr.9"), ("An-der-Mühle 1", "An der  Mühle 1")]:
        assert evaluate(spark, N.normalize_street, a) == evaluate(spark, N.normalize_street, b) == " ".join(brute.road(a))
    assert evaluate(spark, N.normalize_street, "Alte Str. 7") == "alte strasse 7"
    assert evaluate(spark, N.normalize_street, " \t") == ""


NAMES = ["", "Ute", "Ute Karla", "Karla Ute", "U.", "U. K.", "Ü.", "Ünal", "Karla-Sofie", "K", "Ute Ute"]


def test_names(spark):
    """Every pair of the list, first and last name rule."""
    rows = [(a, b) for a in NAMES for b in NAMES]
    a, b = N.name_tokens("a"), N.name_tokens("b")
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", P.first_names_match(a, b).alias("first"), P.last_names_match(a, b).alias("last")).collect():
        x, y = brute.words(r.a), brute.words(r.b)
        assert (r.first, r.last) == (brute.same_first(x, y), brute.same_last(x, y)), (r.a, r.b)


def clusters(df):
    members = {}
    for r in df.collect():
        members.setdefault(r["dup_id"], set()).add(r["person_id"])
    return sorted(tuple(sorted(m)) for m in members.values())


def test_campus_filter_keeps_whole_clusters(spark):
    p = persons_df(spark, [(11, 4, "Ute", "Kern", "ute@mail.test", "Am Hang 2", "Gera"),
                           (12, 5, "Ute", "Kern", "UTE@mail.test ", "Talweg 8", "Jena"),
                           (13, 6, "Ole", "Brandt", "ole@mail.test", "Markt 1", "Suhl")])
    assert clusters(find_duplicate_groups(p)) == clusters(find_duplicate_groups(p, campus_id=5)) == [(11, 12)]
    for campus in (6, 0, -1):
        assert clusters(find_duplicate_groups(p, campus_id=campus)) == []


def test_a_couple_with_one_mailbox(spark):
    """The two are not linked to each other, but each to a record of its own."""
    couple = [(21, 4, "Ute", "Kern", "kern@mail.test", "Am Hang 2", "Gera"), (22, 4, "Ole", "Kern", "kern@mail.test", "Am Hang 2", "Gera")]
    assert clusters(find_duplicate_groups(persons_df(spark, couple))) == []
    own = [(23, 0, "Ute", "Kern", "", "", ""), (24, 0, "Ole", "Kern", "", "", "")]
    assert clusters(find_duplicate_groups(persons_df(spark, couple + own))) == [(21, 23), (22, 24)]


def test_primary_email_from_the_list(spark):
    p = spark.createDataFrame([(1, 0, "", "", "", "", "", [("",), (" M@x.test",)]), (2, 0, "", "", "m@x.test", "", "", None)],
                              ", ".join(f"{c} {'bigint' if c.endswith('id') else 'string'}" for c in COLUMNS)
                              + ", emails array<struct<email string>>")
    assert clusters(find_duplicate_groups(p)) == [(1, 2)]


def random_rows(seed, n=120):
    rng = random.Random(seed)
    first = ["Ute", "Ute Karla", "U.", "Karla", "Ole", "Ole T.", "Ole Tom", "O", "", "Kern", "Kern Ute"]
    last = ["Kern", "Kern-Roth", "Roth", "Ute", "", "Ünal", "Ole"]
    where = [("Ringstr. 9", "Gera"), ("Ringstraße 9", "Gera"), ("Talweg 8", "Lauffen am Neckar"), ("Talweg 8", "Lauffen/N."), ("", "Gera"),
             ("Markt 1", "Lauffen"), ("Markt 1", "Lauffen an der Elbe"), ("Markt 1", "")]
    mail = ["", "", "a@mail.test", "A@mail.test ", "b@mail.test", "kern@mail.test"]
    rows = [(i, rng.choice([0, 1, 2]), rng.choice(first), rng.choice(last), rng.choice(mail), *rng.choice(where)) for i in range(1, n + 1)]
    # many copies of one record
    return rows + [(1000 + i, 1, "Ute", "Kern", "kern@mail.test", "Ringstr. 9", "Gera") for i in range(25)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_brute_force(spark, seed):
    rows = random_rows(seed)
    p, plain = persons_df(spark, rows), [dict(zip(COLUMNS, r)) for r in rows]
    edges = match_edges(p).checkpoint()
    assert clusters(find_duplicate_groups(p, edges=edges)) == brute.groups(plain)
    assert clusters(find_duplicate_groups(p, campus_id=2, edges=edges)) == brute.groups(plain, campus=2)


def test_swapped_names_option(spark):
    rows = [(1, 0, "Ute", "Kern", "", "", ""), (2, 0, "Kern", "Ute", "", "", ""), (3, 0, "Kern Ute", "Ute", "", "Markt 1", "Gera"),
            (4, 0, "Ute Kern", "Kern", "", "Markt 1", "Gera")]
    rows += [(10 + r[0], *r[1:]) for r in random_rows(9, 60)]
    p, plain = persons_df(spark, rows), [dict(zip(COLUMNS, r)) for r in rows]
    assert clusters(find_duplicate_groups(p, swap_keys=True)) == brute.groups(plain, swapped=True)


@pytest.mark.parametrize("row", [
    lambda i: (i, 1, "Ute", f"Name{i}", "", "Ringstr. 9", "Gera"),
    lambda i: (i, 1, f"Ute{i}", "Kern", "kern@mail.test", "Ringstr. 9", "Gera"),
    lambda i: (i, 1, f"Ute X{i}", "Kern", "kern@mail.test", "Ringstr. 9", "Gera"),
    lambda i: (i, 1, f"Ute X{i}", "Kern", "", "", ""),
])
def test_a_hot_bucket_has_few_edges(spark, row):
    """Many variants behind one address, mailbox or name: edges follow their number."""
    n = 300
    assert match_edges(persons_df(spark, [row(i) for i in range(1, n + 1)])).count() <= 2 * n


def test_exchanged_names_have_few_edges(spark):
    """n people of one name and n with it exchanged, at addresses of their own or in one mailbox."""
    for n, mail in ((60, ""), (60, "kern@mail.test")):
        rows = [(i, 1, *(("Anna", "Vogt") if i % 2 else ("Vogt", "Anna")), mail, f"Weg {i}", "Gera") for i in range(1, 2 * n + 1)]
        p = persons_df(spark, rows)
        assert clusters(find_duplicate_groups(p, swap_keys=True)) == [tuple(range(1, 2 * n + 1))]
        assert match_edges(p, swap_keys=True).count() <= 4 * n


def test_exchanged_names_visit_few_pairs(spark):
    """Further tokens that differ: no pair of them meets, though all share both leading tokens."""
    from doppel.operators.pairs import _two_part_pairs
    n = 200
    rows = [(i, [f"anna", f"x{i}"], ["vogt"]) for i in range(n)]
    left = spark.createDataFrame(rows, "l_rep long, l_first_t array<string>, l_last_t array<string>").withColumn("b", F.lit(1))
    right = spark.createDataFrame([(1000 + i, ["vogt"], ["anna", f"y{i}"]) for i in range(n)],
                                  "r_rep long, r_first_t array<string>, r_last_t array<string>").withColumn("b", F.lit(1))
    assert _two_part_pairs(left, right, ["b"], ("l_first_t", "r_last_t", True), ("l_last_t", "r_first_t", True)).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_exchanged_names_equal_brute_force(spark, seed):
    """Couples, orders of ids, initials and suffixes among exchanged names."""
    rng = random.Random(seed)
    names = ["Ute", "Kern", "Ute Kern", "Kern Ute", "U.", "K", "Ute K.", "Kern Maria", "U. M.", "Maria", "Ute Maria"]
    where = [("Markt 1", "Lauffen am Neckar"), ("Markt 1", "Lauffen am Inn"), ("Markt 1", "Lauffen"), ("Weg 2", "Gera"), ("", "")]
    rows = [(i, rng.choice([1, 1, 2]), rng.choice(names), rng.choice(names), rng.choice(["", "a@mail.test", "a@mail.test"]), *rng.choice(where))
            for i in range(1, 90)]
    for part in (rows[:12], rows[12:30], rows):
        plain = [dict(zip(COLUMNS, r)) for r in part]
        assert clusters(find_duplicate_groups(persons_df(spark, part), swap_keys=True)) == brute.groups(plain, swapped=True)
