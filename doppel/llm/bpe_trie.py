"""Byte-level BPE encoding and decoding with a prefix-sharing trie.

Distinct words make a trie of bytes, held as their sorted list: what a word shares
with the one before it is the path from the root to where both part, so going
through the list is the depth-first walk. The walk gives every node the last token
of the encoding of its prefix: the longest vocabulary suffix of the
prefix that may follow the last token of the node where that suffix begins. A
sequence of tokens is the BPE encoding of its bytes exactly when each adjacent
pair is the encoding of its own bytes, so one pair test per candidate is enough,
and the state of a shared prefix is computed once for all words below it. Beside it the
walk keeps the longest end of the path with which a token begins, and thereby the list of
the tokens that end there. A pair is tested by the merges across its border alone. A
word's ids are read off backwards along its path.

Defined cases: a null text counts as empty and has no ids. Each input row gives
one output row; ids may repeat or be null. Columns other than id and text are
not read. An empty table gives an empty result. Text of any length is encoded
whole; memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.llm.tokens import ID, IdMemo, led, vocabulary

# Fixed value: the word pattern of byte-level BPE.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """Vocabulary files write bytes as printable characters; the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


# state of the trie's root
ROOT = 1 << 19


class TrieEncoder:
    def __init__(self, path: str, words_per_trie: int = 20_000):
        spec = json.load(open(path, encoding="utf-8"))
        back = _byte_of_char()
        raw = {t: bytes(back[c] for c in t) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.bytes |= {i: s.encode() for s, i in self.specials.items()}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[raw[a], raw[b]] = rank
        # the merge that makes a token, unless several can: their tokens are merged out when needed
        self.parts: dict[bytes, tuple[int, bytes, bytes]] = {}
        several = set()
        for (a, b), rank in self.merges.items():
            if self.parts.setdefault(a + b, (rank, a, b))[0] != rank:
                several.add(a + b)
        for token in several:
            self.parts[token] = self._last_merge(token)
        self.right_ends: dict[int, list[tuple[bytes, float]]] = {}
        self.left_ends: dict[int, list[tuple[bytes, float]]] = {}
        self.begins = {token[:i] for token in self.ids for i in range(len(token) + 1)}
        self.names, self.place_of, self.ending, self.steps = [b""], {b"": 0}, [[]], {}
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.pairs: dict[int, bool] = {}
        self.pattern = regex.compile(WORDS)
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.words_per_trie = words_per_trie
        self.known: dict[str, list[int]] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        """Plain merging by rank; the last merge stays in ``self.last``."""
        parts, self.last = [data[i:i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            rank, at = min((self.merges.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            a, b = parts[at], parts[at + 1]
            self.last = rank, a, b
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _last_merge(self, token: bytes) -> tuple[int, bytes, bytes]:
        """The merge by which a token comes about; any of its merges if its bytes never become it."""
        return self.last if self._merge(token) == [token] else self.parts[token]

    def _ends(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at one end of a token while it is put together, and the rank of the merge that takes it in."""
        part, until, out = self.bytes[token], float("inf"), []
        while True:
            out.append((part, until))
            if part not in self.parts:
                return out
            until, part = self.parts[part][0], self.parts[part][1 + side]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether the two tokens are the encoding of their bytes; at the root, the token of its own.

        They are if no merge across their border comes before the merges inside them that take
        in what it would join. Of equal ranks the one more to the left comes first.
        """
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        if last == ROOT:
            ok = self._merge(self.bytes[token]) == [self.bytes[token]]
        else:
            right = self.right_ends.get(last) or self.right_ends.setdefault(last, self._ends(last, 1))
            left = self.left_ends.get(token) or self.left_ends.setdefault(token, self._ends(token, 0))
            merge, never = self.merges.get, float("inf")
            ok = all((rank := merge((a, b), never)) >= until_a or rank > until_b or rank == never for a, until_a in right for b, until_b in left)
        self.pairs[last << 20 | token] = ok
        return ok

    def _step(self, key: int) -> int:
        """From a place on by a byte. A place is the longest end of a path with which a token begins; ``ending``
        has the tokens that end there, the longest first."""
        name = self.names[key >> 8] + bytes([key & 255])
        while name not in self.begins:
            name = name[1:]
        place = self.place_of.get(name)
        if place is None:
            place = self.place_of[name] = len(self.names)
            self.names.append(name)
            self.ending.append([(self.ids[name[i:]], len(name) - i) for i in range(len(name)) if name[i:] in self.ids])
        self.steps[key] = place
        return place

    def _encode_trie(self, words: list[str]) -> None:
        """Walk the trie of the words depth first; read the ids off where a word ends."""
        step, pair, size, known, ending = self.steps.get, self.pairs.get, self.size, self.known, self.ending
        states, places, path = [ROOT], [0], b""
        for data, word in sorted((w.encode(), w) for w in words):
            shared, n = 0, min(len(path), len(data))
            while shared < n and path[shared] == data[shared]:
                shared += 1
            del states[shared + 1:], places[shared + 1:]
            path, place = data, places[shared]
            for depth in range(shared + 1, len(data) + 1):
                key = place << 8 | data[depth - 1]
                place = step(key)
                if place is None:
                    place = self._step(key)
                for token, length in ending[place]:
                    last = states[depth - length]
                    ok = pair(last << 20 | token)
                    if ok or ok is None and self._may_follow(last, token):
                        break
                else:
                    raise ValueError(f"no token ends at byte {depth} of a word")
                states.append(token)
                places.append(place)
            out, d = [], len(data)
            while d:
                out.append(states[d])
                d -= size[states[d]]
            out.reverse()
            known[word] = out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        find = self.pattern.findall
        split: list[list] = []
        for t in texts:
            parts = self.split_specials.split(t) if self.split_specials else [t]
            split.append([w for i, p in enumerate(parts) for w in ((self.specials[p],) if i % 2 else find(p))])
        self._know([w for ws in split for w in ws if isinstance(w, str)])
        known = self.known
        return [np.array([i for w in ws for i in (known[w] if isinstance(w, str) else (w,))], ID).tobytes()
                for ws in split]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks without special tokens, each as ``led``: ids one after the other, and their numbers."""
        split = list(map(self.pattern.findall, map(led, chunks)))
        self._know([w for ws in split for w in ws])
        known = self.known
        ids = array("I")
        sizes = []
        for ws in split:
            before = len(ids)
            for w in ws:
                ids.extend(known[w])
            sizes.append(len(ids) - before)
        return np.array(ids, ID), np.array(sizes, np.int64)

    def _know(self, words: list[str]) -> None:
        fresh = list(set(words).difference(self.known))
        if len(self.known) + len(fresh) > 300_000:
            self.known.clear()
            fresh = list(set(words))
        for i in range(0, len(fresh), self.words_per_trie):
            self._encode_trie(fresh[i:i + self.words_per_trie])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_BY_PATH: dict[str, tuple[TrieEncoder, IdMemo]] = {}


def trie_ids(path: str) -> tuple[TrieEncoder, IdMemo]:
    """One encoder per worker process and vocabulary file."""
    if path not in _BY_PATH:
        enc = TrieEncoder(path)
        _BY_PATH[path] = enc, IdMemo(enc.encode_many, tuple(enc.specials), enc.encode_chunks)
    return _BY_PATH[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>`` of every whole text."""
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = out.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = trie_ids(path or vocabulary())
        for b in batches:
            at = 0
            for ids, ends in memo.runs(b["text"]):
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.record_batch({"id": b["id"].slice(at, len(ends)), "ids": pa.ListArray.from_arrays(offsets, ids.astype(np.int32))})
                at += len(ends)

    return out.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: encoded, decoded from the ids, both digested in the task."""
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = out.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, memo = trie_ids(path or vocabulary())
        decimal = {i: str(i).encode() for i in enc.bytes}.__getitem__
        for b in batches:
            at = 0
            for ids, ends in memo.runs(b["text"]):
                n, sums, decoded = np.diff(ends, prepend=0), [], []
                for a, z in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    own = ids[a:z].tolist()
                    sums.append(hashlib.sha256(b",".join(map(decimal, own))).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode(own).encode()).hexdigest())
                yield pa.record_batch({"id": b["id"].slice(at, len(ends)), "n_tokens": n.astype(np.int64), "ids_sha256": sums, "decoded_sha256": decoded})
                at += len(ends)

    return out.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
