"""What grows with the input is done once, and later steps see what is left of it."""

import itertools
import os
import random
import tempfile

from pyspark.sql import functions as F

import brute
from doppel.operators import components
from doppel.operators import pairs
from doppel.plans import review
from doppel.sources.review_csv import read_review_csv, write_review_csv


def test_later_rounds_see_inner_nodes_only(spark, monkeypatch):
    """A chain, stars on it and apart from it: single edges wait for their neighbour's label."""
    chain = [(1000 + i, 1001 + i) for i in range(12)]
    edges = chain + [(1000 + i % 13, 5000 + i) for i in range(200)] + [(1, 20_000 + i) for i in range(300)] + [(7, 7), (9, 8), (8, 9)]
    random.Random(1).shuffle(edges)
    seen, star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda e: seen.append(e.count()) or star(e))
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert {tuple(r) for r in got} == {(n, 1000 if n in range(1000, 6000) else 1 if n == 1 or n >= 20_000 else 8) for n in nodes}
    assert len(got) == len(nodes) and len(seen) > 1
    assert max(seen[1:]) < 230  # the 300 edges of a star apart take part in no later round


def test_swap_candidates_are_all(spark):
    """Every pair of small names in one block, against the rule itself; most nodes meet nothing."""
    words = ["ute", "karl", "u", "ina"]
    names = [list(x) for n in (1, 2, 3) for x in itertools.product(words, repeat=n)]
    rng = random.Random(5)
    rows = [(i, rng.choice(names), rng.choice(names)) for i in range(250)]
    made = spark.createDataFrame(rows, "rep long, first_t array<string>, last_t array<string>")
    made = made.withColumn("first0", F.col("first_t")[0]).withColumn("last0", F.col("last_t")[0])
    for block in (["first0", "last0"], ["first0"]):
        got = {(r.l_rep, r.r_rep) for r in pairs._swap_candidates(made, block, ["rep", "first_t", "last_t"]).collect()}
        assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1][0] == b[1][0]
                       and (len(block) == 1 or a[2][0] == b[2][0])
                       and brute.same_first(a[1], b[2]) and brute.same_last(a[2], b[1])}


def test_members_of_no_candidate_are_not_read(spark):
    """The swapped rule looks at members of names that met; without any there is no plan over the persons."""
    rows = [(i, 0, "", ["ute"], ["kern"], "", "", "", "ute", "kern") for i in range(1, 40)]
    people = spark.createDataFrame(rows, "person_id long, campus_id long, email_n string, first_t array<string>, last_t array<string>, "
                                         "city_main string, city_by string, street_n string, first0 string, last0 string")
    key = ["first_t", "last_t"]
    nodes = people.groupBy(*key).agg(F.min("person_id").alias("rep")).withColumn("first0", F.lit("ute")).withColumn("last0", F.lit("kern"))
    found = pairs._swapped_edges(people, nodes, pairs._swap_candidates(nodes, ["first0", "last0"], ["rep", *key]), key)
    assert found.collect() == [] and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_review_is_read_once(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="doppel-once-") + "/review"
    texts = ", ".join(f"'t' AS {c}" for c in review.REVIEW_COLUMNS[2:])
    write_review_csv(spark.sql(f"SELECT id + 1 AS dup_id, id + 5 AS person_id, {texts} FROM range(20)"), path)
    rows, _ = read_review_csv(spark, path)
    assert "FileScan" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.line, r.person_id) for r in rows.collect()) == [(i + 2, i + 5) for i in range(20)]
    groups = spark.range(1, 40).selectExpr("id % 9 + 1 AS dup_id", "id AS person_id")
    monkeypatch.setattr(review, "_groups", lambda spark, sf_dir: groups)
    lines = review.review_rows(spark, os.curdir)
    assert "Join" not in lines._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.line for r in lines.collect()) == list(range(2, lines.count() + 2))


def test_records_are_dealt_out(spark):
    """A file of one row group is normalised in many tasks; an id that comes twice stays twice."""
    rows = [(i, 1, "Ute", f"Kern{i}", "", "Ring 1", "Ulm") for i in [*range(1, 200), 7, 0]]
    one = spark.createDataFrame(rows, "person_id long, campus_id long, first_name string, last_name string, email string, street string, city string").coalesce(1)
    made = pairs.written_features(one)
    assert made.rdd.getNumPartitions() > 2
    assert sorted(r.person_id for r in made.collect()) == sorted([*range(1, 200), 7])


def test_a_token_that_a_block_shares_meets_nobody(spark):
    """Double names with a common second part make no square; true subsets are all found."""
    schema, block = "rep long, place string, last_t array<string>", ["place"]
    rows = [(i, "x", [f"kern{i}", "schmidt"]) for i in range(300)]
    rows += [(500, "x", ["schmidt"]), (501, "x", ["kern3"]), (502, "x", ["schmidt", "kern4", "lang"]), (503, "y", ["kern4", "schmidt"])]
    found = pairs._subset_candidates(spark.createDataFrame(rows, schema), block, "last_t", ["rep", "last_t"], rarest=True).collect()
    assert len(found) < 310 and {(3, 501), (4, 502)} <= {tuple(sorted((r.l_rep, r.r_rep))) for r in found}
    # ids that stand for two records, tokens that repeat
    rng = random.Random(8)
    rows = [(rng.randrange(60), rng.choice("xy"), [rng.choice("abcd") for _ in range(rng.randrange(4))]) for _ in range(120)]
    rows = [list(r) for r in {(r[0], r[1], tuple(r[2])) for r in rows}]
    made = spark.createDataFrame([(i, p, list(t)) for i, p, t in rows], schema)
    got = {(r.l_rep, r.r_rep, tuple(r.l_last_t), tuple(r.r_last_t), r.place)
           for r in pairs._subset_candidates(made, block, "last_t", ["rep", "last_t"], rarest=True).collect()}
    want = {(a[0], b[0], tuple(a[2]), tuple(b[2]), a[1]) for a in rows for b in rows if a[1] == b[1] and a[0] != b[0]
            and a[2] and set(a[2]) <= set(b[2]) and len(a[2]) <= len(b[2])}
    assert want <= got
