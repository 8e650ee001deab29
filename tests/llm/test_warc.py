"""WARC archives: round trip, segments, revisits."""

import base64
import gzip
import hashlib
import re

import pyarrow as pa

from doppel.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, chunk string, id string")


ROWS = [(1, "http://a", "x\r\n\r\ny\r\n", None, None), (2, None, None, "c", "i"), (3, "http://c", "", None, None),
        (4, "http://d", "é\r\n" * 500, None, None), (5, "http://e", "é\r\n" * 500, None, None),
        (6, "u\r\nX: y", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", None, None), (7, "f", "\r\n\r\n\r\n\r\n", None, None),
        (8, "g", "x\r\n\r\ny\r\n", None, None), (None, "h", "lost", None, None)]


def want(rows, least=0):
    first, out = {}, []
    for id_, _, html, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (html or "").encode()
        ref = first.setdefault(data, id_) if len(data) >= least else id_
        out.append((id_, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if ref == id_ else "revisit", None if ref == id_ else ref))
    return out


def test_round_trip_with_small_chunks(spark):
    for least in (0, 1, 100):
        got = warc.archive_round_trip(pages(spark, ROWS), min_revisit_bytes=least, chunk_chars=7).drop("url")
        assert sorted(map(tuple, got.collect())) == want(ROWS, least)


def test_repeated_rows_and_empty_table(spark):
    rows = ROWS[:2] + ROWS[:1]
    got = warc.archive_round_trip(pages(spark, rows))
    assert got.where("page_id = 1").count() == 2 and got.where("record_type = 'revisit'").count() == 0
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_the_files_are_warc(spark, tmp_path):
    df = pages(spark, ROWS[:1])
    none = warc.find_revisits(warc.payload_digests(df, "page_id", "html"))
    warc.write_archives(warc.record_chunks(df, none, "page_id", "url", "html"), str(tmp_path / "w"))
    data = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("*.gz"))
    head, _, rest = data.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Content-Length: 8" in head
    assert rest == b"x\r\n\r\ny\r\n\r\n\r\n"


def test_an_id_with_several_payloads_and_null_ids(spark):
    rows = [(1, "a", "first"), (2, "b", "second"), (3, "c", "first"), (3, "d", "its own"), (4, "e", "first"), (4, "f", "second"),
            (None, "g", "alone " * 9), (None, "h", "first"), (None, "i", "pair"), (None, "j", "pair"), (5, "k", "first"), (5, "l", "first")]
    df = pages(spark, [(*r, None, None) for r in rows]).repartition(3)
    got = warc.archive_round_trip(df, chunk_chars=7, null_ids=True).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    refs = {"c": 1, "e": 1, "f": 2, "h": 1, "k": 1, "l": 1}
    want = [(i, u, len(t), digest(t), "revisit" if u in refs else "response", refs.get(u)) for i, u, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_the_query_writes_null_ids(spark, tmp_path):
    from doppel.llm.queries import op10_warc
    pages(spark, ROWS).write.parquet(str(tmp_path / "pages.parquet"))
    assert op10_warc(spark, str(tmp_path)).count() == len(ROWS)


def records(data):
    """A strict reader: header fields and content of each record of an archive."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].split(b"\r\n")
        assert version == b"WARC/1.1"
        fields = dict(x.decode().split(": ", 1) for x in lines)
        assert len(fields) == len(lines) and {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length"} <= set(fields)
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and re.fullmatch(r"<urn:[^<>\s]+>", fields["WARC-Record-ID"])
        size = int(fields["Content-Length"])
        content = data[end + 4:end + 4 + size]
        assert len(content) == size and data[end + 4 + size:end + 8 + size] == b"\r\n\r\n"
        out.append((fields, content))
        at = end + 8 + size
    return out


def test_every_record_has_what_the_format_asks(spark, tmp_path):
    df = pages(spark, [r for r in ROWS if r[0]]).repartition(3)
    revisits = warc.find_revisits(warc.payload_digests(df, "page_id", "html"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    warc.write_archives(warc.record_chunks(df, revisits, "page_id", "url", "html", chunk_chars=7), str(tmp_path / "w"), date="2026-05-01T10:00:00Z")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [records(gzip.open(p).read()) for p in (tmp_path / "w").glob("*.gz")]
    assert sum(bool(f) for f in files) > 1
    found, seen = {}, set()
    for f in files:
        for fields, content in f:
            assert fields["WARC-Date"] == "2026-05-01T10:00:00Z" and fields["WARC-Record-ID"] not in seen
            seen.add(fields["WARC-Record-ID"])
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Profile"] == warc.REVISIT_PROFILE and fields["WARC-Refers-To"] and not content
            elif fields["WARC-Type"] == "continuation":
                assert int(fields["WARC-Segment-Number"]) > 1
                found[fields["WARC-Segment-Origin-ID"]] += content
            else:
                found[fields["WARC-Record-ID"]] = content
    want_all = {f"<urn:x-page:{r[0]}:0>": (r[2] or "").encode() for r in ROWS if r[0] and r[0] not in (3, 5, 8)}
    assert found == want_all


def test_a_long_page_is_cut_in_bounded_batches():
    """Each chunk carries the digest so far; a batch holds about one chunk, whatever the page's length."""
    text = "été " * 400_000
    row = pa.record_batch({"id": [1], "url": ["u"], "refers_to": pa.array([None], pa.int64()), "payload_bytes": [len(text.encode())],
                           "sha": [hashlib.sha1(text.encode()).digest()], "payload": [text]})
    sha, seen = hashlib.sha1(), 0
    for batch in warc._cut(iter([row]), 1 << 12):
        assert sum(map(len, batch["content"].to_pylist())) <= warc.CHUNK_CHARS
        for part, digest, n, k in zip(*(batch[c].to_pylist() for c in ("content", "digest", "n_chunks", "chunk"))):
            sha.update(part.encode())
            assert digest == sha.digest() and k == seen and n == -(-len(text) // (1 << 12))
            seen += 1
    assert seen == n
