"""Merkle manifest against a tree built in one piece."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from doppel.llm import merkle

BIG = 2**53 + 1
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, grp string, idx int"


def H(x):
    return sha256(x.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def whole_tree(nodes, fanout):
    """Root, and for each leaf the (left, right) text of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            run = i - i % fanout
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + fanout])))
        nodes, at = [H("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)], [i // fanout for i in at]
    return nodes[0], paths


def brute(rows, tampered, fanout=3):
    by = {}
    for r in rows:
        seen = H("".join(map(field, r[:4])) + field(r[4].replace("\n", "") if tampered(r) and r[4] is not None else r[4]))
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H("".join(map(field, r[:5]))), seen))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = whole_tree([x[2] for x in by[s]], fanout)
    if not order:
        return []
    root, above = whole_tree([trees[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, above):
        for (known, i, leaf, node), path in zip(by[s], trees[s][1]):
            path = path + top
            for left, right in path:
                node = H(left + node + right)
            out.append((i if known else None, leaf, trees[s][0], root, H("".join(a + b for a, b in path)), node, node == root))
    return out


def check(spark, rows, fanout=3, levels=1):
    df = spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA)
    odd = F.col("doc_id") % 2 == 1
    got = merkle.manifest(df, tamper={"text": F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))},
                          fanout=fanout, block_levels=levels)
    want = brute(rows, lambda r: r[0] is not None and r[0] % 2 == 1, fanout)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    return want


def doc(i, source, text, lang="en"):
    return (i, source, lang, None if text is None else len(text), text)


@pytest.mark.parametrize("fanout,levels,n", [(3, 1, 118), (2, 0, 45)])
def test_any_shape(spark, fanout, levels, n):
    """A hot source over many blocks, incomplete last subtrees, sources of one row, many sources."""
    rng = random.Random(n)
    rows = [doc(i, "hot", f"line {rng.random()}\nnext") for i in range(n)]
    rows += [doc(1000 + i, f"s{i % 11}", f"a\nb{i}") for i in range(4 * 11 + 3)] + [doc(5000, "alone", "x"), doc(5001, "Ünter", "y")]
    rng.shuffle(rows)
    assert {w[-1] for w in check(spark, rows, fanout, levels)} == {True, False}


def test_defined_cases(spark):
    same = [doc(3, "a", "twice\n")] * 4
    rows = [doc(None, "a", "no id"), doc(None, "a", "no id 2"), doc(None, None, None), doc(BIG, None, ""), doc(BIG + 2, None, "x\n"),
            doc(7, "", "empty name"), doc(7, "", "same id"), doc(8, "a", "long " * 50_000 + "\n", None), doc(9, "a", "grüße\n")]
    check(spark, rows + same)


def test_small_tables(spark):
    assert check(spark, []) == []
    lone = check(spark, [doc(1, "a", "a\n")])[0]
    assert lone[4] == H("") and not lone[-1]


def test_production_blocks_hold_whole_sources(spark):
    check(spark, [doc(i, f"s{i % 2}", f"t\n{i}") for i in range(60)], levels=merkle.BLOCK_LEVELS)
