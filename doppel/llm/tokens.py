"""Token ids of whole texts, chunk by chunk with a memo.

The byte-level pre-tokenizer always starts a new word at a space that a
character other than white space follows. A text without runs of white space
that begin with a space therefore falls into chunks at its spaces, and the ids
of the text are the ids of the chunks one after the other. A line break between two
characters other than white space is a word of its own; there a chunk begins, too, with
the break in place of the space. Chunks of a group of texts are
numbered by Arrow, each distinct one is looked up once, and the ids of all texts are
put together by one gather. A text to which this doesn't apply (a
space before other white space, white space before a final space, a special
token's string) is encoded as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ID = np.dtype("<u4")
# Python's notion of white space covers at least the Unicode property White_Space
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# bytes of text whose chunks are looked up at a time, and ids that are put together at a time
GROUP, PIECE = 16 << 20, 1 << 20
# chunks of a memo
MAX_ENTRIES = 1_500_000


def led(chunk: str) -> str:
    """A chunk with what it begins with in the text: its line break, or a space."""
    return chunk if chunk[:1] == "\n" else " " + chunk


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + size]`` one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def _strings(column: pa.Array) -> list[str]:
    """The strings of a column without nulls; ``to_pylist`` takes many times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


class _Runs:
    """Ids of chunks: a chunk's number, and by it the run of ids in one array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, ID), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def find(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))

    def add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Chunks that are not there yet, with their ids one after the other."""
        n, k = len(self.number), len(chunks)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + k > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[n:n + k] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n:n + k] = sizes
        self.used += len(ids)
        self.number.update(zip(chunks, range(n, n + k)))


def joined(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(encoded), ID), np.fromiter(map(len, encoded), np.int64, len(encoded)) // ID.itemsize


class IdMemo:
    """``encode_all(texts)`` gives the ids of each text as little-endian 32-bit bytes, ``runs`` the arrays.

    The memo has two generations of at most ``max_entries / 2`` chunks: a full one
    becomes the old one, from which chunks that occur again are taken over, so
    frequent chunks stay and memory is bounded. Chunks longer than ``max_chunk`` don't stay.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], specials: tuple[str, ...],
                 encode_chunks: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None,
                 max_entries: int = MAX_ENTRIES, max_chunk: int = 48):
        self.encode_many = encode_many
        self.encode_chunks = encode_chunks or (lambda chunks: joined(encode_many(list(map(led, chunks)))))
        self.max_entries, self.max_chunk = max_entries, max_chunk
        self.stops = {c: np.frombuffer(x, ID) for c, x in zip(".,", encode_many([".", ","]))}
        self.new, self.old = _Runs(), _Runs()
        spaces = "[" + re.escape(_SPACES) + "]"
        other = spaces.replace("[", "[^", 1)
        self.breaks = f"({other})\n({other})"
        self.whole = "|".join([f" {spaces}", rf"{spaces} \z", *map(re.escape, specials)])

    @property
    def memo(self) -> dict[str, int]:
        """The chunks of the new generation."""
        return self.new.number

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        return [ids[a:b].tobytes() for ids, ends in self.runs(texts) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def runs(self, texts: list[str | None] | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups of texts: ids of all of them, and where in these each text ends. Null has none.

        A list of texts is copied, a column of a record batch is not.
        """
        column = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False) + 1)
        at = 0
        while at < len(column):
            n = max(1, int(np.searchsorted(size, (size[at - 1] if at else 0) + GROUP)) - at)
            yield from self._group(column.slice(at, n))
            at += n

    def _group(self, texts: pa.LargeStringArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        whole = pc.match_substring_regex(texts, self.whole)
        # a space before each such line break: chunks that begin with one are met nowhere else
        split = pc.split_pattern(pc.replace_substring_regex(pc.if_else(whole, "", texts), self.breaks, "\\1 \n\\2"), " ")
        ends = split.offsets.to_numpy()
        ends = ends - ends[0]
        first = ends[:-1]
        # what has no space before it: first chunks, and texts that are encoded whole
        heads = pc.if_else(whole, texts, split.flatten().take(pa.array(first)))
        coded = split.flatten().dictionary_encode()
        del split
        index = coded.indices.to_numpy()
        inner = np.ones(len(index), bool)
        inner[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[index[inner]] = True
        number = np.full(len(used), -1, np.int64)
        long, number[used] = self._learn(_strings(coded.dictionary.filter(pa.array(used))))
        head_ids, head_sizes = joined(self.encode_many(_strings(heads)))
        runs = self.new
        # places of all chunks in the memo's ids, those of heads and long chunks behind them
        extra, extra_sizes = np.concatenate([head_ids, long[0]]), np.concatenate([head_sizes, long[1]])
        flat = np.concatenate([runs.flat[:runs.used], extra])
        n = len(runs.number)
        starts = np.concatenate([runs.starts[:n], runs.used + np.cumsum(extra_sizes) - extra_sizes])
        sizes = np.concatenate([runs.sizes[:n], extra_sizes])
        # _learn numbers long chunks from -2 down
        number = np.where(number < -1, n + len(head_sizes) - 2 - number, number)
        at = number.astype(np.int32)[index]
        at[first] = n + np.arange(len(first))
        total = np.concatenate([[0], np.cumsum(np.add.reduceat(sizes[at], first))])
        lo = 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PIECE, "right")) - 1)
            some = at[ends[lo]:ends[hi]]
            yield _gather(flat, starts[some], sizes[some]), total[lo + 1:hi + 1] - total[lo]
            lo = hi

    def _learn(self, chunks: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Have the chunks in the memo: ids and sizes of those too long to stay (numbered -2, -3, ..), and the numbers of all."""
        if len(self.new.number) > self.max_entries // 2:
            self.old, self.new = self.new, _Runs()
        number = self.new.find(chunks)
        places = np.flatnonzero(number < 0)
        if not len(places):
            return (np.zeros(0, ID), np.zeros(0, np.int64)), number
        missing = [chunks[i] for i in places.tolist()]
        if self.old.number:
            self._take_over(missing)
            unknown = [c for c in missing if c not in self.new.number]
        else:
            unknown = missing
        # a word and the full stop or comma behind it are encoded apart
        ended = [c for c in unknown if c[-1:] in self.stops and c[-2:-1].isalpha()]
        plain = dict.fromkeys(unknown)
        for c in ended:
            del plain[c]
        words = [w for w in dict.fromkeys(c[:-1] for c in ended) if w not in plain and w not in self.new.number]
        if self.old.number:
            self._take_over(words)
            words = [w for w in words if w not in self.new.number]
        plain = [*plain, *words]
        fresh = _Runs()
        if plain:
            fresh.add(plain, *self.encode_chunks(plain))
        for stop, ids in self.stops.items():
            mine = [c for c in ended if c[-1] == stop]
            for runs in (fresh, self.new):
                known = runs.find([c[:-1] for c in mine])
                some = np.flatnonzero(known >= 0)
                if len(some):
                    sizes = runs.sizes[known[some]]
                    made = np.empty(int(sizes.sum()) + len(some) * len(ids), ID)
                    ends = np.cumsum(sizes + len(ids))
                    tail = (ends[:, None] - np.arange(len(ids), 0, -1)).ravel()
                    body = np.ones(len(made), bool)
                    body[tail] = False
                    made[body], made[tail] = _gather(runs.flat, runs.starts[known[some]], sizes), np.tile(ids, len(some))
                    fresh.add([mine[i] for i in some.tolist()], made, sizes + len(ids))
                    mine = [mine[i] for i in np.flatnonzero(known < 0).tolist()]
        names = list(fresh.number)
        short = np.fromiter(map(len, names), np.int64, len(names)) <= self.max_chunk
        # numbers go on from the memo's, those of long chunks from -2 down
        placed = np.where(short, len(self.new.number) - 1 + np.cumsum(short), -1 - np.cumsum(~short))
        chosen, rest = np.flatnonzero(short), np.flatnonzero(~short)
        if len(rest):
            sizes = fresh.sizes[chosen]
            self.new.add([names[i] for i in chosen.tolist()], _gather(fresh.flat, fresh.starts[chosen], sizes), sizes)
        else:
            self.new.add(names, fresh.flat[:fresh.used], fresh.sizes[:len(names)])
        at = fresh.find(missing)
        number[places[at >= 0]] = placed[at[at >= 0]]
        taken = places[at < 0]
        number[taken] = self.new.find([chunks[i] for i in taken.tolist()])
        return (_gather(fresh.flat, fresh.starts[rest], fresh.sizes[rest]), fresh.sizes[rest]), number

    def _take_over(self, chunks: list[str]) -> None:
        """From the old generation into the new one what it has of the chunks."""
        at = self.old.find(chunks)
        some = np.flatnonzero(at >= 0)
        if len(some):
            sizes = self.old.sizes[at[some]]
            self.new.add([chunks[i] for i in some.tolist()], _gather(self.old.flat, self.old.starts[at[some]], sizes), sizes)


_BY_PATH: dict[tuple[str, int], IdMemo] = {}


def library_ids(path: str, max_entries: int = MAX_ENTRIES) -> IdMemo:
    """A memo over the tokenizers library; one per worker process, vocabulary file and size.

    It stays with the worker, which outlives the task and stands beside the steps that follow.
    """
    if (path, max_entries) not in _BY_PATH:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        def encode_many(texts: list[str]) -> list[bytes]:
            return [np.array(e.ids, ID).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

        special = {t.content for t in tok.get_added_tokens_decoder().values()}
        # bytes that each id stands for: byte-level tokens have one character per byte
        size = np.array([len(tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())], np.int64)

        def encode_chunks(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Many chunks in one text; where the lengths don't meet a chunk's end, one by one."""
            chunks = list(map(led, chunks))
            parts = [chunks[at:at + 100] for at in range(0, len(chunks), 100)]
            length = pc.binary_length(pa.array(chunks, pa.large_string())).to_numpy()
            made = [np.array(e.ids, ID) for e in tok.encode_batch_fast(list(map("".join, parts)), add_special_tokens=False)]
            ids, ends = np.concatenate(made), np.cumsum(length)
            reach = np.cumsum(size[ids])
            cut = np.searchsorted(reach, ends)
            if " " not in chunks and len(reach) == cut[-1] + 1 and (reach[cut] == ends).all():
                return ids, np.diff(cut, prepend=-1)
            sizes, at = [], 0
            for i, some in enumerate(parts):
                ends = np.cumsum(length[at:at + len(some)])
                at += len(some)
                reach = np.cumsum(size[made[i]])
                cut = np.searchsorted(reach, ends)
                if " " in some or len(reach) != cut[-1] + 1 or (reach[cut] != ends).any():
                    made[i], n = joined(encode_many(some))
                else:
                    n = np.diff(cut, prepend=-1)
                sizes.append(n)
            return np.concatenate(made), np.concatenate(sizes)

        _BY_PATH[path, max_entries] = IdMemo(encode_many, tuple(special), encode_chunks, max_entries)
    return _BY_PATH[path, max_entries]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, looked up where the task runs."""
    import public_tokenizers
    return public_tokenizers.path(name)
