"""Language identification on held-out rows, packing as a valid and tight packing."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from doppel.llm import language_id as lid
from doppel.llm import packing
from doppel.llm.queries import op3_language_id
from doppel.llm.tokens import ID, vocabulary

SF = "/root/testdata/sf0.01"


def test_codewords_keep_apart():
    for n in range(2, 13):
        code = lid.codewords(n).astype(int)
        apart = (code[:, None] != code[None]).sum(2) + 99 * np.eye(n, dtype=int)
        assert apart.min() >= (1 if n == 2 else 2) and len({tuple(r) for r in code.tolist()}) == n


def test_slices_are_the_whole_text(monkeypatch):
    text = "Das ist ein Satz, 12 Wörter lang. " * 50
    whole = np.sort(np.concatenate(list(lid._slices(text))))
    monkeypatch.setattr(lid, "SLICE", 64)
    assert np.sort(np.concatenate(list(lid._slices(text)))).tolist() == whole.tolist()


def test_held_out_accuracy(spark):
    if not os.path.exists(SF):
        pytest.skip("test data not present")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = op3_language_id(spark, SF).where("held_out").collect()
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in truth)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) >= 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, "the house is the home of the man", "en", "x"), (2, "das Haus ist das Heim des Mannes", "de", "x"), (3, None, "en", "x"),
            (4, "12 - !", "de", None), (None, "the man and the house", None, "x"), (2, "das Haus", "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in lid.predict(df, lid.fit(df)).collect())
    assert got == [("1", "en"), ("2", "de"), ("2", "de"), ("3", "und"), ("4", "und"), ("None", "en")]
    assert {r.lang_pred for r in lid.predict(df, lid.fit(df.limit(0))).collect()} == {"und"}
    assert lid.predict(df.limit(0), lid.fit(df.where("lang = 'en'"))).count() == 0


def check_packing(rows, texts, capacity, end):
    tok = Tokenizer.from_file(vocabulary())
    want = []
    for i, t in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], ID)
        n = -(-len(ids) // capacity)
        cuts = [0, *(len(ids) - capacity * k for k in range(n - 1, 0, -1)), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_packing(spark):
    texts = [(i, "word " * (i * 37 % 211)) for i in range(300)] + [(None, "x"), (3, "x"), (3, "x"), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, length string").repartition(3)
    for shard in (16_000, 60):
        bins, bound = check_packing(packing.pack(df, capacity=64, shard_pieces=shard).collect(), texts, 64, 2)
        assert bins <= bound * 1.05 + 5
    assert packing.pack(df.limit(0)).count() == 0


def test_crossover_and_mutation_keep_the_pieces():
    import random
    rng = random.Random(1)
    counts = {v: rng.randint(1, 9) for v in range(1, 60)}
    lengths = sorted(v for v, n in counts.items() for _ in range(n))
    a = packing.best_fit(lengths, [], 64)
    b = packing.mutate(a, 64, rng)
    c = packing.crossover(a, b, counts, 64, rng)
    for bins in (a, b, c, packing._from_bytes(packing._to_bytes(c))):
        assert sorted(v for x in bins for v in x) == lengths and max(map(sum, bins)) <= 64
    # eight bins of three lengths that only fit one way
    hard = packing.evolve({30: 8, 21: 8, 13: 8}, [], 64, rng, generations=300)
    assert len(hard[0]) == 8


def test_fewer_sequences_than_best_fit(spark):
    """Lengths that fill sequences in one way only, which best-fit decreasing misses."""
    lengths = [30, 21, 13] * 8
    df = spark.createDataFrame([(i, " word" * (n - 1)) for i, n in enumerate(lengths)], "doc_id long, text string")
    plain = len(packing.best_fit(lengths, [], 64))
    assert packing.pack(df, capacity=64).select("sequence_id").distinct().count() == 8 < plain


def test_exchange_keeps_the_pieces():
    bins, free = packing.replace([[30, 20], [40], [5, 5, 50]], [33, 24, 55, 10], 64)
    assert sorted([v for b in bins for v in b] + free) == sorted([30, 20, 40, 5, 5, 50, 33, 24, 55, 10])
    assert max(map(sum, bins)) <= 64 and sum(map(sum, bins)) > 150


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅷ", "12 - !", "", "日本", "x"])
def test_letters(spark, text):
    """Numbers that are written as signs are no letters; a script without learned text still has letters."""
    df = spark.createDataFrame([(1, "the house is home", "en"), (2, "das Haus ist Heim", "de")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(9, text)], "doc_id long, text string")
    got = lid.predict(asked, lid.fit(df)).first()
    assert (got.lang_pred == "und") == (not any(c.isalpha() for c in text)) and (got.score > 0) == any(c.isalpha() for c in text)


def plain_prediction(train, text):
    """A second version, without slices, arrays of weights or Spark: counts, log ratios, losses."""
    import math
    langs = sorted({lang for _, lang in train})
    counts = {lang: np.zeros(lid.BUCKETS) for lang in langs}
    for t, lang in train:
        for g in np.concatenate(list(lid._slices(t))):
            counts[lang][g] += 1
    freq = {x: (counts[x] + 0.5) / (counts[x].sum() + 0.5 * lid.BUCKETS) for x in langs}
    code = lid.codewords(len(langs))
    loss = {x: 0.0 for x in langs}
    imp, evidence = [], []
    for b in range(code.shape[1]):
        plus = np.mean([freq[x] for x, c in zip(langs, code[:, b]) if c > 0], 0)
        minus = np.mean([freq[x] for x, c in zip(langs, code[:, b]) if c < 0], 0)
        w = (np.log(plus) - np.log(minus)).astype(np.float32)
        imp.append(max(1e-6, min(code[i, b] * float(freq[x] @ w) for i, x in enumerate(langs))))
        evidence.append(lid.TEMPER * sum(float(w[g]) for g in np.concatenate(list(lid._slices(text)))))
    for b, (i, z) in enumerate(zip(imp, evidence)):
        for x, c in zip(langs, code[:, b]):
            loss[x] += i / np.mean(imp) * math.log1p(math.exp(-max(-500, min(500, z * c))))
    best = min(langs, key=lambda x: loss[x])
    return best, 1 / sum(math.exp(loss[best] - loss[x]) for x in langs)


def test_equals_a_plain_version(spark):
    train = [("the house is the home of the man", "en"), ("das Haus ist das Heim des Mannes", "de"), ("la maison est la maison", "fr"), ("the end", "en")]
    asked = ["a house", "ein Haus", "une maison", "home Haus maison", "zzz"]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)], "doc_id long, text string, lang string")
    one = lid.fit(df)
    got = {r.said: (r.lang_pred, r.score) for r in lid.predict(spark.createDataFrame([(0, t) for t in asked], "doc_id long, text string"), one, keep={"said": F.col("text")}).collect()}
    for t in asked:
        lang, score = plain_prediction(train, t)
        assert got[t] == (lang, pytest.approx(score, rel=1e-4))
