"""Rule ledger and exact dedup against plain Python."""

import hashlib
import re

from doppel.llm import quality_rules as q
from doppel.llm.exact_dedup import exact_dedup

WORDS = [f"w{i}" for i in range(40)]
TEXTS = [None, "", " \n\t", "a b", " ".join(WORDS), " ".join(WORDS[:10] * 6), "###  $$$ " * 30, "x\n" * 50,
         " ".join(WORDS) + "\nsame line\nsame line\n \n\nsame line", "é" * 300 + " " + " ".join(WORDS), " ".join(["a"] * 5000)]
SCHEMA = "doc_id long, text string, n_words string, id string, doc string"


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "n", None, "d") for i, t in enumerate(texts)], SCHEMA)


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            covered |= {i + k for i in starts for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measurements(spark):
    got = q.ledger(docs(spark)).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [measures(t) for t in TEXTS]


def test_policies_and_ablation(spark):
    ledger = q.ledger(docs(spark)).cache()
    rows = {r.doc_id: r.fail_bits for r in ledger.collect()}
    for version, mask in q.POLICIES.items():
        kept = {r.doc_id for r in q.apply_policy(ledger, version).where("kept").collect()}
        assert kept == {i for i, b in rows.items() if not b & mask}
        for r in q.ablation(ledger, version).collect():
            assert r.n_failed == sum(bool(b & r.rule_bit) for b in rows.values())
            assert r.n_only == sum(b & mask == r.rule_bit for b in rows.values())
    kept = q.passing(docs(spark))
    assert kept.columns == ["doc_id", "text", "n_words", "id", "doc"] and {r.doc_id for r in kept.collect()} == {4, 8, 9}
    assert q.ledger(docs(spark, [])).count() == 0 and q.passing(docs(spark, [])).count() == 0


def test_exact_dedup(spark):
    rows = [(1, "a b"), (2, " a  b "), (3, None), (4, ""), (5, "\n\t"), (6, "x" * 500 + "1"), (7, "x" * 500 + "2"), (8, "ab"),
            (9, "ab\x0b"), (9, "ab\x0b"), (None, "a\rb  \n "), (10, "é"), (11, "e")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), -1 if i is None else i, i))
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)[2]
        want.append((i, keep, len(g), keep == i, hashlib.sha256(norm(t).encode()).hexdigest()))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, len string")
    assert sorted(map(tuple, exact_dedup(df).collect()), key=str) == sorted(want, key=str)
    lazy = exact_dedup(df, digest_all=False).drop("text_sha256").collect()
    assert sorted(map(tuple, lazy), key=str) == sorted((w[:4] for w in want), key=str)
    assert exact_dedup(df.limit(0)).count() == 0
