"""Suffix arrays and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from doppel.llm import suffix_dedup as sd
from doppel.llm.suffix_array import permuted_lcp, suffix_array


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(150):
        k = int(rng.integers(2, 6))
        t = np.append(rng.integers(1, k, int(rng.integers(1, 80))), 0)
        if trial % 5 == 0:
            t = np.append(np.tile(rng.integers(1, k, int(rng.integers(1, 5))), 20), 0)
        s = t.tolist()
        sa = suffix_array(t, k)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        room, r = np.zeros(len(s), np.int64), 0
        for i in range(len(s) - 1, -1, -1):
            r = 0 if s[i] < 2 else r + 1
            room[i] = r
        common = permuted_lcp(t, sa, room)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist()):
            n = 0
            while n < min(room[i], room[j]) and s[i + n] == s[j + n]:
                n += 1
            assert common[i] == n


def test_large_alphabet():
    rng = np.random.default_rng(2)
    t = np.append(np.tile(rng.integers(1, 3000, 700), 2), 0)
    s = t.tolist()
    assert suffix_array(t, 3000).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, length):
    """Removed byte positions of each row."""
    seen: dict[bytes, int] = {}
    data = [(t or "").encode() for _, t, *_ in rows]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i:i + length]] = seen.get(d[i:i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(25) for _ in range(4)]
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" * 700, "x"), (4, "ab" * 300 + "c", "x"), (5, "kurz", "x")]
    for i in range(6, 90):
        parts = [text(rng.randint(3, 60))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), text(rng.randint(0, 30))]
        rows.append((i, rng.choice([" ", "", "\n"]).join(parts), "x"))
    rows += [(200, rows[20][1], "x"), (201, rows[20][1], "y"), rows[30], rows[30], (None, rows[40][1], None), (None, text(80), "")]
    return rows


@pytest.mark.parametrize("limits", [{}, {"max_key_bytes": 150}, {"shard_bytes": 500}])
def test_against_brute_force(spark, limits):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = sd.suffix_dedup(df, length=40, gram=8, **limits).drop("spans").collect()
    want = [(r[0], *b) for r, b in zip(rows, brute(rows, 40))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_text_output_and_empty_table(spark):
    schema = "doc_id long, text string, id string, key string"
    rows = [(1, "x" * 30 + "ééé" * 10 + "1", "a", "k"), (2, "y" * 30 + "ééé" * 10 + "2", None, None), (3, None, "c", "k")]
    got = sd.suffix_dedup(spark.createDataFrame(rows, schema), length=20, gram=8, output="text", keep=["id", "key"])
    assert got.columns == ["doc_id", "id", "key", "text"]
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts == {1: "1", 2: "2", 3: None}
    assert sd.suffix_dedup(spark.createDataFrame([], schema)).count() == 0
