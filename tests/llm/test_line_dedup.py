"""Line dedup: banded distance, candidate places and the whole operator against brute force."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from doppel.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, kind = rng.randrange(len(s)), rng.randrange(3)
        s[i:i + (kind > 0)] = [rng.choice("ab é")] if kind < 2 else []
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(8, 40)))
        rows.append((a, edited(rng, a, rng.randint(0, 5))))
    a, b = F.col("a").cast("binary"), F.col("b").cast("binary")
    df = spark.createDataFrame(rows, "a string, b string").where(F.abs(F.octet_length("a") - F.octet_length("b")) <= edits)
    for r in df.select("a", "b", ld.banded_distance(a, b, edits).alias("x"), ld.trimmed_distance(a, b, edits, 2).alias("y")).collect():
        want = min(distance(r.a.encode(), r.b.encode()), edits + 1)
        assert min(r.x, edits + 1) == want and min(r.y, edits + 1) == want


def brute(rows, edits, least):
    order = sorted({(i is not None, i or 0, at, line) for i, t, *_ in rows if t is not None for at, line in enumerate(t.split("\n"))
                    if len(line.encode()) >= least})
    first = {}
    for o in order:
        first.setdefault(o[3], o[:3])
    links = {x: [y for y in first if y != x and abs(len(x) - len(y)) <= edits and distance(x.encode(), y.encode()) <= edits] for x in first}
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, None, 0, 0, 0))
            continue
        kept, n = [], 0
        for at, line in enumerate(t.split("\n")):
            if line in first:
                n += len(links[line])
                if first[line] < (i is not None, i or 0, at) or any(first[y] < first[line] for y in links[line]):
                    continue
            kept.append(line)
        out.append((i, "\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept), n))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(6)) for _ in range(25)]
    rows = [(1, None, "x"), (2, "", "x"), (3, "\n\n", "x"), (None, base[0], "x"), (4, "short", "x"), (5, "short", "x"), (6, "z" * 3000, "")]
    for i in range(10, 70):
        rows.append((i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 5))), "y"))
    rows += [rows[12], (6000, "z" * 2999, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string").repartition(4)
    got = ld.line_dedup(df, edits=2, min_bytes=10).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, 2, 10), key=str)
    assert ld.line_dedup(df.limit(0)).count() == 0
    assert ld.line_dedup(df, keep=["at"]).columns == ["doc_id", "at", "text", "n_lines", "n_dropped", "n_links"]


def test_written_tables_leave_no_shuffle_files(spark):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffles():
        return {f for d in dirs for f in Path(d).rglob("shuffle_*")}

    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    docs = spark.createDataFrame([(i, f"a line that occurs in every text\nline number {i} of its own text") for i in range(40)], "doc_id long, text string")
    before = shuffles()
    left = ld.line_dedup(docs)
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
    assert left.agg(F.sum("n_dropped")).first()[0] >= 39
