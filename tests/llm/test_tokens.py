"""BPE trie and token files against the tokenizers library, on odd texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from doppel.llm import bpe_trie, token_output
from doppel.llm.packing import pieces
from doppel.llm.tokens import ID, MAX_ENTRIES, IdMemo, library_ids, vocabulary

PIECES = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "ß", "中", "1", "23", "'s", "'ll", "!!", "<|endoftext|>",
          " <|endoftext|>", "the", "ing", "\x1c", " ", "🙂", "​", "A", "'", "-", "\r\n"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, ID)


def test_memo_and_trie_give_the_librarys_ids(library):
    lib, (_, trie) = library_ids(vocabulary()), bpe_trie.trie_ids(vocabulary())
    for t in odd_texts(3000, 1) + ["x" * 5000, " " * 300, "word " * 2000]:
        want = ids_of(library, t).tobytes()
        assert lib.encode(t) == want, t
        assert trie.encode(t) == want, t


def test_words_at_line_breaks_are_encoded_once(library):
    """n * n pairs of lines' ends and beginnings need the ids of 2 * n chunks, not of each pair."""
    lib, encoded = library_ids(vocabulary(), 50_000), []

    def encode_many(texts):
        encoded.extend(texts)
        return lib.encode_many(texts)

    memo, n = IdMemo(encode_many, ()), 30
    texts = [f"Start end{'x' * i}.\nBegin{'y' * j} z" for i in range(n) for j in range(n)]
    texts += ["a\n\nb c\n d e\nf\ng\u00a0\nh i\r\nj 's\n's", "\nx y\n", "é\n中\n\t!!\n23 \nq", "a\n", "a \n b"]
    for memo_ in (memo, lib):
        for t, got in zip(texts, memo_.encode_all(texts), strict=True):
            assert got == ids_of(library, t).tobytes(), t
    assert len({x for x in encoded if "end" in x or "Begin" in x}) <= 2 * n + 2
    assert not any("\n" in c[1:] for c in memo.memo if "Begin" in c)


def test_memo_stays_bounded():
    enc = bpe_trie.TrieEncoder(vocabulary())
    memo = IdMemo(enc.encode_many, tuple(enc.specials), max_entries=10)
    for t in ("a b c d e f g h", "i j k l m n o p", "a b c d e f g h"):
        assert np.frombuffer(memo.encode(t), ID).tolist() == [i for b in enc.encode_many([t]) for i in np.frombuffer(b, ID)]
    assert len(memo.memo) <= 20


ROWS = [(1, None, "x"), (2, "", "x"), (3, "Hello  world\n", "y"), (4, "né " * 4000, "y"), (5, "a <|endoftext|> b", None),
        (5, "a <|endoftext|> b", None), (None, "no id", "z")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_round_trip_query_columns(spark, library):
    got = sorted(bpe_trie.round_trip(docs(spark)).collect(), key=str)
    assert len(got) == len(ROWS)
    want = []
    for id_, t, _ in ROWS:
        ids = ids_of(library, t).tolist()
        want.append((id_, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe_trie.round_trip(docs(spark, [])).count() == 0


def test_coded_blocks_round_trip():
    rng = np.random.default_rng(3)
    for skew in (False, True):
        segments = [(rng.zipf(1.2, n) % 60000 if skew else rng.integers(0, 65536, n)).astype(ID)
                    for n in (0, 1, 7, 2048, 2049, 9000)] + [np.zeros(5000, ID)]
        for a, b in zip(segments, token_output.unpack_segments(token_output.pack_segments(segments))):
            assert a.tolist() == b.tolist()


def test_a_damaged_block_is_found():
    data = bytearray(token_output.pack_segments([np.arange(3000).astype(ID)])[0])
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        token_output.unpack_segments([bytes(data)])


def test_token_files(spark, library, tmp_path):
    rows = [r for r in ROWS if r[0] != 5] + [(10 + i, t, "") for i, t in enumerate(odd_texts(200, 4))]
    random.Random(1).shuffle(rows)
    token_output.write_ids(docs(spark, rows), str(tmp_path / "f"), segment_ids=300)
    got = token_output.read_ids(spark, str(tmp_path / "f")).orderBy(token_output.F.col("id").asc_nulls_first()).collect()
    start = 0
    for r, (id_, t, _) in zip(got, sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), strict=True):
        ids = ids_of(library, t).tolist() + [0]
        assert tuple(r) == (id_, start, len(ids), zlib.crc32(np.array(ids, ID).tobytes()))
        start += len(ids)
    assert token_output.token_files(docs(spark, [])).count() == 0


def test_memo_of_a_stage(spark):
    """The pipeline's workers hold a smaller memo; ids and pieces are those of the usual one."""
    small, usual = library_ids(vocabulary(), 20), library_ids(vocabulary())
    texts = [" ".join(f"w{i * j} und" for j in range(30)) for i in range(40)]
    assert small is not usual and [small.encode(t) for t in texts] == [usual.encode(t) for t in texts]
    assert len(small.new.number) + len(small.old.number) < 400 < len(usual.memo)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(pieces(docs, memo_entries=20).collect()) == sorted(pieces(docs).collect())
    assert corpus_pipeline.MEMO_ENTRIES < MAX_ENTRIES
