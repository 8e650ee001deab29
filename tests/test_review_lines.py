"""Review files with line breaks inside quoted cells, over many splits of a file."""

import csv
import io
import os
import random
import tempfile

import pytest

from doppel.sources.csv_records import read_records
from doppel.sources.review_csv import read_review_csv

HEADER = "﻿DupID;ID;Vorname;Straße\n"


def folder(*texts, name="part-{:05d}.csv"):
    path = tempfile.mkdtemp(prefix="doppel-lines-")
    for i, text in enumerate(texts):
        with open(os.path.join(path, name.format(i)), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return path


def cell(rng):
    words = ["Hof", "Hinter\nhaus", "a;b", 'sag "ja"', "x\r\ny", "\n\n", "  ", "", "Grün", "é" * 40, "\n;\n"]
    text = " ".join(rng.choice(words) for _ in range(rng.randrange(3)))
    return '"' + text.replace('"', '""') + '"' if rng.random() < 0.3 or any(c in text for c in '\n";\r') else text


def random_file(seed, n=150):
    rng = random.Random(seed)
    out = HEADER
    for i in range(n):
        out += rng.choice(["", "", "", "\n", "\r\n"])  # empty lines are no records
        out += ";".join([str(1 + i // 3), str(i + 1), cell(rng), cell(rng)]) if i % 11 else ";;; " if i % 2 else ';"";;'
        out += rng.choice(["\n", "\r\n"]) if i < n - 1 else rng.choice(["", "\n"])
    return out


def plain(text):
    rows = []
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    for line, record in enumerate((r for r in csv.reader(io.StringIO(text, newline=""), delimiter=";", skipinitialspace=True) if r), 1):
        record = [c.strip() for c in record]
        if line > 1 and any(record):
            rows.append((line, int(record[0]), int(record[1]), record[2], record[3]))
    return rows


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", [1, 2])
def test_many_splits_of_one_file(spark, small_splits, seed):
    text = random_file(seed)
    path = folder(text)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 8
    rows, invalid = read_review_csv(spark, path)
    got = sorted((r.line, r.dup_id, r.person_id, r.first_name, r.street) for r in rows.collect())
    assert got == plain(text) and invalid.isEmpty()


def test_breaks_beside_a_split(spark, small_splits):
    """A cell that spans several whole splits."""
    text = HEADER + '1;1;A;"' + "\n".join(["zeile " + "x" * 90] * 15) + '"\n1;2;B;Weg\n'
    rows, _ = read_review_csv(spark, folder(text))
    assert sorted((r.line, r.first_name, r.street.count("\n")) for r in rows.collect()) == [(2, "A", 14), (3, "B", 0)]


def test_parts_in_order_of_their_number(spark):
    parts = {2: '1;20;"a\nb";\n', 99999: "1;21;c;\n", 100000: '1;22;"d\n";\n', 1000000: "1;23;e;\n"}
    path = tempfile.mkdtemp(prefix="doppel-lines-")
    for n, body in parts.items():
        with open(os.path.join(path, f"part-{n:05d}-x.csv"), "w", encoding="utf-8") as f:
            f.write(HEADER + body)
    rows, _ = read_review_csv(spark, path)
    assert sorted((r.line, r.person_id) for r in rows.collect()) == [(2, 20), (3, 21), (4, 22), (5, 23)]


def test_a_quote_that_is_never_closed(spark):
    path = folder(HEADER + '1;1;A;Weg\n1;2;"B;Weg\n1;3;C;Weg\n')
    with pytest.raises(ValueError, match="zeile 3"):
        read_review_csv(spark, path)
    rows, invalid = read_review_csv(spark, path, strict=False)
    assert [r.person_id for r in rows.collect()] == [1]
    assert [tuple(r) for r in invalid.collect()] == [(3, "Anführungszeichen nicht geschlossen")]


def test_empty_files(spark):
    with pytest.raises(ValueError, match="empty"):
        read_review_csv(spark, folder(""))
    with pytest.raises(ValueError, match="keine datensätze"):
        read_review_csv(spark, folder(HEADER))
    records, unclosed = read_records(spark, folder("a\n\n\r\nb"))
    assert sorted((r.number, r.text) for r in records.collect()) == [(1, "a"), (2, "b")] and unclosed.isEmpty()
