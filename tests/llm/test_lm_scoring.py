"""Context-tree weighting against its definition: a bit's probability is the ratio of the
root's weighted probabilities with and without it."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doppel.llm import lm_scoring as lm

SCHEMA = "doc_id long, text string, train boolean, gram string, p int"


def grams(text, depth):
    data = b"\xff" * depth + text + b"\xff"
    return [(data[i - depth:i], data[i]) for i in range(depth, len(data))]


def places(byte):
    return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]


class Plain:
    def __init__(self, texts, depth):
        self.depth, self.counts, self.children, self.memo = depth, {}, {}, {}
        for text in texts:
            for context, byte in grams(text, depth):
                for prefix, bit in places(byte):
                    for d in range(depth + 1):
                        node = (context[depth - d:], prefix)
                        self.counts.setdefault(node, [0, 0])[bit] += 1
                        if d:
                            self.children.setdefault((context[depth - d + 1:], prefix), set()).add(context[depth - d:])

    def logpw(self, context, prefix, path=None, bit=0):
        """With ``path`` the context of one more bit."""
        on = path is not None and path.endswith(context)
        if not on and (context, prefix) in self.memo:
            return self.memo[context, prefix]
        n = list(self.counts.get((context, prefix), (0, 0)))
        if on:
            n[bit] += 1
        own = math.lgamma(n[0] + .5) + math.lgamma(n[1] + .5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
        if len(context) < self.depth:
            below = set(self.children.get((context, prefix), ()))
            if on:
                below.add(path[self.depth - len(context) - 1:])
            own = math.log(.5) + np.logaddexp(own, sum(self.logpw(c, prefix, path, bit) for c in below))
        if not on:
            self.memo[context, prefix] = own
        return own

    def log10(self, text):
        return sum((self.logpw(b"", prefix, context, bit) - self.logpw(b"", prefix)) / math.log(10)
                   for context, byte in grams(text, self.depth) for prefix, bit in places(byte))


def brute(rows, depth):
    def lower(t):
        return (t or "").encode().lower()

    training = [lower(t) for _, t, train in rows if train is not False]
    plain = Plain(training, depth)
    counts = Counter(w for t in training for w in [*t.split(), b""])
    total = sum(counts.values())
    out = []
    for i, text, train in rows:
        words = [*lower(text).split(), b""]
        base = sum(math.log10((counts[w] + .5) / (total + .5 * (len(counts) + 1))) for w in words)
        out.append((i, train is not False, len(words), sum(w in counts for w in words), total, base, plain.log10(lower(text))))
    return out


def check(spark, rows, depth=lm.DEPTH):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r)[:7] for r in lm.score(df, F.col("train"), depth=depth).collect()), key=str)
    want = sorted(brute(rows, depth), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:], rel=1e-9) for w in want]
    return {g[0]: g for g in got}


def words(rng, n):
    return " ".join(rng.choice(["the", "House", "of", "wälder", "grün", "x1", "\tnight\n"]) for _ in range(n))


def test_equals_definition(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(1, 25)), i % 5 != 1) for i in range(25)]
    rows += [(2**53 + 1, None, True), (None, "no id", None), (77, "", False), (78, "   \n", False), (79, "never seen Ωmega", False),
             (2, rows[2][1], True), (2, "same id", False), (80, "a\x00b\xa0c", True)]
    got = check(spark, rows)
    assert got[77][2:4] == (1, 1) and got[None][1]


def test_other_depth_and_no_training(spark):
    check(spark, [(1, "abracadabra abra", True), (2, "cadabra", False)], depth=2)
    # without counts every estimate is a half
    assert check(spark, [(1, "abc", False)])[1][6] == pytest.approx(-4 * 8 * math.log10(2))


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []


def test_slices(monkeypatch):
    text = words(random.Random(1), 400).encode()
    whole = Counter(int(g) for codes, _ in lm.grams([b"", text, b"q"]) for g in codes)
    monkeypatch.setattr(lm, "SLICE", 64)
    parts = list(lm.grams([b"", text, b"q"]))
    assert len(parts) > 5 and Counter(int(g) for codes, _ in parts for g in codes) == whole
    assert sum((o == 1).sum() for _, o in parts) == len(text) + 1
    assert [w for some in lm.word_lists(text) for w in some] == text.split()


def test_held_out_texts_do_not_train(spark):
    rows = [(i, f"training text number {i}", True) for i in range(8)]
    one, other = (check(spark, [*rows, (50, held, False)], depth=3) for held in ("zzz zzz", "something else here"))
    assert all(one[i] == pytest.approx(other[i]) for i in range(8))


def test_order_of_words_is_learned(spark):
    """Words that follow each other in a fixed order: single words can't know, contexts do."""
    verse = "alpha beta gamma delta omega sigma".split()
    docs = spark.createDataFrame([(i, " ".join(verse[(i + j) % 6] for j in range(60)), i % 4 != 0, "", 0) for i in range(24)], SCHEMA)
    held = lm.score(docs, F.col("train")).where("NOT train").collect()
    assert len(held) == 6 and all(r.score > r.base_score / 3 and r.bits_per_byte < 0.2 for r in held)
