"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule; a *policy* is a versioned mask over these bits, so
another policy or an ablation never reads the texts again: the verdict is
``fail_bits & mask = 0`` and ablations are bit operations on the ledger.

Defined cases: a null or empty text has no words, no symbols and no lines with
words, and fails ``few_words``. Every input row gives one ledger row, repeated
rows too. An id may be null. Columns of the input other than id and text are
not read. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import NON_WS, let, words_of

WINDOW = 8
SYMBOLS = r"[^#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL predicate over the measurements."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 20 * word_chars"),
    Rule("repeated_lines", 3, "n_dup_lines >= 3 and 100 * n_dup_lines > 40 * n_lines"),
    Rule("short_words", 4, "n_words > 0 and word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 40 * n_words"),
)
BASE_MASK = 0b11
# A policy is a version of the rule set; verdicts of old versions stay computable.
POLICIES = {1: BASE_MASK, 2: 0b111111}
CURRENT_POLICY = 2


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words that occur at least twice.

    Windows are compared by the 64-bit hash of their words. A text whose window
    hashes are all distinct ends after one hash set. Otherwise the (hash, start)
    pairs are sorted, the starts that share a hash with a neighbour are kept in
    text order, and each covers up to the next start or its full width.
    """
    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.when(
            i + 1 < F.size(starts), F.least(F.lit(WINDOW), F.get(starts, i + 1) - p)).otherwise(WINDOW))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated_starts(pairs: Column) -> Column:
        kept = F.filter(pairs, lambda x, i:
                        ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"]))
                        | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(kept, lambda x: x["p"]))

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(let(pairs, repeated_starts), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
                          lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, of_hashes))


def _word_measures(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _repeat_words(words).alias("n_repeat_words"))


def _line_measures(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, carry: bool = False) -> DataFrame:
    """One row per document: id, measurements and ``fail_bits``.

    ``carry`` adds the whole input row as the struct ``doc``, so that a policy can
    filter documents without a join.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_WS))
    out = docs.select(
        F.col(id_col),
        let(words_of(text), _word_measures).alias("w"),
        let(lines, _line_measures).alias("l"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("doc")] if carry else []))
    out = out.select(*(["doc"] if carry else []), F.col(id_col), "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
                     "l.n_lines")
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(0).cast("long"))
    return out.withColumn("fail_bits", bits)


def passes(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(ledger_df: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """Add ``kept``: no rule of the policy version failed."""
    return ledger_df.withColumn("kept", passes(POLICIES[version]))


def passing(docs: DataFrame, version: int = CURRENT_POLICY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that the policy keeps, with all their columns."""
    return ledger(docs, id_col, text_col, carry=True).where(passes(POLICIES[version])).select("doc.*")


def ablation(ledger_df: DataFrame, version: int = CURRENT_POLICY, rules=RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, and that only it rejects.

    One aggregate over the ledger: with the mask's bits at hand, a rule is the
    only cause exactly when the masked bits equal the rule's bit. The bits of
    all documents together (``bit_or``) tell which rules fired at all.
    """
    mask = POLICIES[version]
    used = [r for r in rules if mask >> r.bit & 1]
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    grouped = ledger_df.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    per_rule = grouped.select("bits", "n", F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("rule_bit")) for r in used])).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.rule_bit")) != 0
    return per_rule.groupBy("r.rule", "r.rule_bit").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.rule_bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.bit_or(F.when(hit, F.col("bits")).otherwise(0)).alias("fired_with"))
