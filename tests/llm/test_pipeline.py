"""The pipeline's stages on a small corpus, each against its own input."""

import random

import corpus_pipeline
from doppel.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    line = lambda n=25: " ".join(word() for _ in range(n))
    shared, passage = line(), line(60)
    rows = [(1, None), (2, ""), (3, "few words")]
    rows += [(i, f"{line()}\n{line()}\n{line()}") for i in range(10, 20)]
    rows.append((30, rows[-1][1]))
    rows += [(i, f"{line(40)}\n{shared}") for i in (40, 41)]
    base = line(300).split(" ")
    for i in (50, 51):
        t = list(base)
        t[i % 7] = word()
        rows.append((i, " ".join(t)))
    rows += [(i, f"{line(30)} {passage} {line(30)}") for i in (60, 61)]
    return [(i, t, None, "s", None if t is None else len(t), "e") for i, t in rows]


def test_stages(spark):
    scratch, docs = Scratch(spark, "test"), spark.createDataFrame(corpus(), SCHEMA)
    texts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, ""), name)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
            texts.append({r.doc_id: r.text for r in docs.collect()})
    quality, lines, near, suffix = texts
    assert quality.keys() == {i for i, *_ in corpus()} - {1, 2, 3}
    assert lines.keys() == quality.keys() - {30}
    assert lines[40] == quality[40] and lines[41] == quality[41].split("\n")[0]
    assert near.keys() == lines.keys() - {51}
    cut = lambda t: len(quality[t]) - len(suffix[t])
    assert cut(60) == cut(61) > 200 and all(suffix[i] == near[i] for i in near if i < 60)
    assert {r.doc_id for r in docs.collect()} == suffix.keys()


def test_one_row_of_each_component_stays(spark):
    """Rows that repeat an id and text, null ids with equal texts, and one id with near-equal texts keep one whole text."""
    rng = random.Random(3)
    text = lambda: [f"w{rng.randrange(3000)}" for _ in range(120)]
    a, b, c, d, e, f, g = (text() for _ in range(7))
    near = lambda t: [*t[:-1], "end"]
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (2, c), (2, near(c)), (None, d), (4, d), (None, e), (5, f), (5, g)]
    rows = [(i, " ".join(t), None, f"s{n}", 1, "e") for n, (i, t) in enumerate(rows)] + [(None, "", None, "s", 0, "e")] * 2
    docs = Scratch(spark, "test").write(spark.createDataFrame(rows, SCHEMA), "docs")
    near_dedup, suffix_dedup, packing = (stage for _, stage in corpus_pipeline.STAGES[2:])
    left = Scratch(spark, "test").write(near_dedup(spark, docs, ""), "left")
    got = [(r.doc_id, r.text) for r in left.collect()]
    want = {(1, " ".join(a)), (None, " ".join(b)), (4, " ".join(d)), (None, " ".join(e)), (5, " ".join(f)), (5, " ".join(g)), (None, "")}
    assert len(got) == 8 and set(got) - {(2, " ".join(c)), (2, " ".join(near(c)))} == want
    cut = Scratch(spark, "test").write(suffix_dedup(spark, left, ""), "cut")
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted(got, key=str)
    assert packing(spark, cut, "").where("piece = 0").count() == 8


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "test").write(stage(spark, docs, ""), name)
    assert docs.count() == 0
