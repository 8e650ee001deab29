"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit tells from a text's
byte n-grams on which side of the bit its language is. The classifiers are linear:
a bit's weight for an n-gram is the log ratio of its mean relative frequency among
the languages with the bit to that among those without. Decoding is by loss: a
codeword's loss is the weighted sum of the logistic losses of its bits, where a
bit weighs as much as its classifier separates the training languages. The nearest
codeword wins; a lead of less than ``MARGIN`` over the next is flagged.

N-grams are the pairs and triples of bytes of the lower-cased UTF-8 text, with
everything ASCII that is not a letter as a blank, hashed into ``BUCKETS`` classes.

Training reads a bounded sample: about ``fit_rows`` rows of each language, chosen by
a hash of id and text, whole texts. Rows with null text or language are not used.

Defined cases: ``und`` with score 0 if the text is null or has no letter, or if
nothing could be learned. Every input row gives one output row; ids may repeat or
be null. Columns other than id, text and language are not read, and the last only
for training. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import map_exact, workers_find_package

BUCKETS = 1 << 15
FIT_ROWS = 2000
MARGIN = 2.0
# weight of one n-gram's evidence in the loss; neighbours are far from independent
TEMPER = 0.25
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_BLANKS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SLICE = 1 << 20


def _slices(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, a bounded piece at a time."""
    data = b" " + text.lower().encode("utf-8", "replace").translate(_BLANKS) + b" "
    for at in range(0, len(data), SLICE):
        b = np.frombuffer(data[at:at + SLICE + 2], np.uint8).astype(np.uint32)
        pairs = b[:-1] * np.uint32(2654435761) + b[1:] * np.uint32(40503 << 12)
        triples = pairs[:-1] * np.uint32(31) + b[2:] * np.uint32(2246822519) + np.uint32(97)
        # a slice ends where the next begins: the pair and triple that cross belong to this one
        n = min(SLICE, len(b) - 1)
        yield np.concatenate([pairs[:n], triples[:n]]) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def codewords(n: int) -> np.ndarray:
    """``n`` rows of +1/-1. Few languages have every split as a bit; for more, the
    best of some seeded random codes by smallest distance between two rows."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        bits = [[1 if i == 0 or not split >> (i - 1) & 1 else -1 for i in range(n)] for split in range(1, 1 << (n - 1))]
        return np.array(bits, np.int8).T
    rng, best, far = np.random.default_rng(n), None, -1
    width = 8 * int(np.ceil(np.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + width * np.eye(n, dtype=int)
        mixed = (np.abs(code.astype(int).sum(0)) < n).all()
        if mixed and apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray        # language x bit, +1 / -1
    weights: np.ndarray     # n-gram class x bit
    importance: np.ndarray  # bit

    def losses(self, text: str) -> np.ndarray:
        margin = np.zeros(self.code.shape[1])
        for grams in _slices(text):
            margin += self.weights[grams].sum(0, dtype=np.float64)
        z = np.clip(TEMPER * margin, -500, 500)[None, :] * self.code
        return (self.importance * np.logaddexp(0, -z)).sum(1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0 to 1 and whether a second codeword is about as near."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = self.losses(text)
        near = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss[near[0]]))
        return self.languages[near[0]], float(1 / share.sum()), bool(loss[near[1]] - loss[near[0]] < MARGIN)


def model_of(counts: dict[str, np.ndarray]) -> Model:
    languages = sorted(counts)
    code = codewords(len(languages))
    freq = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in languages]).reshape(-1, BUCKETS)
    bits = code.shape[1]
    weights = np.zeros((BUCKETS, bits), np.float32)
    importance = np.ones(bits)
    for b in range(bits):
        weights[:, b] = np.log(freq[code[:, b] > 0].mean(0)) - np.log(freq[code[:, b] < 0].mean(0))
        importance[b] = max(1e-6, (code[:, b] * (freq @ weights[:, b])).min())
    return Model(languages, code, weights, importance / importance.mean() if bits else importance)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_rows: int = FIT_ROWS) -> Model:
    """Learn from a bounded sample; what reaches the driver is one count vector per language."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return model_of({})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_rows / n))])
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    workers_find_package(labelled.sparkSession)
    sample = rows.where(chance < share[F.col("lang")]).select("lang", "text").repartition(8)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                sums = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for grams in _slices(text):
                    sums += np.bincount(grams, minlength=BUCKETS)
        yield pd.DataFrame({"lang": list(found), "counts": [c.tobytes() for c in found.values()]}, dtype=object)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "counts": [total.tobytes()]})

    schema = "lang string, counts binary"
    # a vector of each task and language, summed where they meet; one a language goes to the driver
    summed = sample.mapInPandas(count, schema).groupBy("lang").applyInPandas(add, schema).collect()
    return model_of({r["lang"]: np.frombuffer(r["counts"], np.int64) for r in summed})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``id, lang_pred, score, ambiguous`` and the columns ``keep`` of every row."""
    keep = keep or {}
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(f"_{n}") for n, c in keep.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in src.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = pd.DataFrame([shared.value.predict(t) for t in pdf["text"]], columns=["lang_pred", "score", "ambiguous"])
            yield pd.concat([pdf.drop(columns="text").reset_index(drop=True), made], axis=1)

    out = map_exact(src, run, schema + ", lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col).withColumnsRenamed({f"_{n}": n for n in keep})
