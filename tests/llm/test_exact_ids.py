"""Ids above 2**53 next to a null stay exact in every task that carries them."""

import random

from doppel.llm import bpe_trie, language_id, near_dedup, packing, suffix_dedup, token_output, warc

BIG = 2**53 + 1
IDS = [None, BIG, BIG + 2, 2**62 + 1, -BIG]


def words(n, seed=4):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(9999)}" for _ in range(n))


def docs(spark, texts):
    df = spark.createDataFrame(list(zip(IDS, texts, IDS)), "doc_id long, text string, other long")
    return df.coalesce(1)


def ids(got, column="doc_id"):
    return sorted((r[column] for r in got.collect()), key=str)


def test_one_row_each(spark):
    df, want = docs(spark, [words(40, i) for i in range(5)]), sorted(IDS, key=str)
    assert ids(near_dedup.near_dedup(df)) == ids(near_dedup.near_dedup(df), "component_id") == want
    assert ids(packing.pack(df)) == ids(token_output.token_files(df)) == want
    assert ids(bpe_trie.round_trip(df)) == ids(bpe_trie.encode(df)) == want
    assert ids(language_id.predict(df, language_id.fit(df.selectExpr("*", "'en' AS lang")))) == want


def test_repeated_passages_join_back(spark):
    got = suffix_dedup.suffix_dedup(docs(spark, [words(60)] * 5), output="text", keep=["other"]).collect()
    assert sorted(((r.doc_id, r.other, r.text) for r in got), key=str) == sorted(((i, i, "") for i in IDS), key=str)


def test_revisits(spark):
    rows = [(i, "u", "same", None, None) for i in IDS[1:4]] + [(2, "u", "alone", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, chunk string, id string").coalesce(1)
    got = warc.archive_round_trip(df).select("page_id", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(BIG, None), (BIG + 2, BIG), (2**62 + 1, BIG), (2, None)], key=str)
