"""Near-dedup against brute force over full shingle sets."""

import random
import re

import numpy as np

from doppel.llm import near_dedup as nd


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, threshold):
    sets = [shingle_set(t) for _, t in rows]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                common = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * common >= threshold * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [(i, len(s), x, x == i) for (i, _), s, x in zip(rows, sets, label)]


def test_shingles_and_sketch():
    for t in (None, "", "a", "A b c d", "a b c d e", "x " * 100, "Ä b\tc\nd e f g Ü"):
        assert len(nd.shingles(t)) == len(shingle_set(t))
    assert nd.shingles("a b").tolist() == nd.shingles(" A  B\n").tolist() != nd.shingles("a b c").tolist()
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**63, 4000, dtype=np.uint64)
    for share in (0.85, 0.9, 0.97):
        n = int(2000 * 2 * share / (1 + share))
        a, b = np.sort(pool[:2000]), np.sort(np.concatenate([pool[:n], pool[2000:4000 - n]]))
        x, y = (nd.odd_sketch(nd.minhash(s, nd.SAMPLES)) for s in (a, b))
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= nd.max_flips(85)


def test_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A b"), (4, "a B"), (5, "a b c")]
    for f in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 200]))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n string, bands string").repartition(4)
    for threshold in (85, 80):
        assert sorted(map(tuple, nd.near_dedup(df, threshold).collect())) == sorted(brute(rows, threshold))


def test_a_hot_family_and_repeated_rows(spark):
    """Copies that are similar to one base, but often not to each other."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(150):
        t = list(base)
        for _ in range(2):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    got = nd.near_dedup(spark.createDataFrame(rows + rows[:3], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 85) + brute(rows, 85)[:3])


def test_no_rows(spark):
    assert nd.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = nd.near_dedup(spark.createDataFrame([(None, "a b c"), (7, "a b c"), (None, None)], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1, 7, False), (7, 1, 7, True), (None, 0, None, True)], key=str)


def test_one_id_with_several_texts(spark):
    """Each text is judged by its own set: a near copy of the larger text is linked."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    small, large, other = ([word() for _ in range(n)] for n in (60, 200, 90))
    near = lambda t: " ".join([*t[:-1], "end"])
    rows = [(5, " ".join(small)), (5, " ".join(large)), (5, near(large)), (7, near(large)), (8, " ".join([*large, "more"])),
            (9, near(small)), (3, " ".join(other)), (6, near(other))]
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [
        (3, 3), (5, 5), (5, 5), (5, 5), (6, 3), (7, 5), (8, 5), (9, 5)]
