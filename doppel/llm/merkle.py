"""Merkle manifest of a dataset: a tree per source, a tree over the sources, a proof per row.

Butterfly exchange: the leaves of a source, in order, are dealt into blocks of
``fanout ** block_levels`` and every block folds its own leaves. Blocks then work in
rounds. In round ``r`` the (at most ``fanout``) blocks whose numbers differ only in
digit ``r`` to the base ``fanout`` swap the roots of their subtrees. Each of them hashes
the common ancestor itself, the same work in every one of them, and appends the swapped
roots to its own upper proof. After the last round each block knows the root and the
whole path to it, and nothing has to be sent down. Where the last subtree of a round is
incomplete, its blocks also answer for the missing ones, each for an equal share, so
that no block has many partners. The subroots of the sources go through the same rounds.

A leaf is the SHA-256 of the row's columns; digests are lowercase hex and are hashed as
that text. A column is ``-`` if null, else its UTF-8 byte count, ``:`` and its value.

Defined cases: null ids come first in their source and are never tampered with; rows
with a null source form a source of their own, the first; rows that are equal in all
hashed columns are leaves of their own next to each other; of rows with one id and other
contents the smaller leaf comes first. Empty and very long texts are hashed like any
other, inside Spark. Columns not named in ``columns`` are not read. An empty table gives
an empty result. Every input row gives one output row.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.llm.common import Scratch

FANOUT = 3
BLOCK_LEVELS = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# leaves of one range partition while they are numbered
RANGE_ROWS = 500_000


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def up(nodes: list[str], fanout: int) -> list[str]:
    """The next level: every ``fanout`` consecutive nodes become their hash."""
    return [digest("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def numbered(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` (``grp, k1, k2`` and others) with ``idx`` (place in the group by ``k1, k2``, from 0) and ``n`` (group size).

    Sorted in range partitions; the offsets hold one count per range and group.
    """
    held = scratch.write(rows, f"{name}-rows")
    ranges = max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // RANGE_ROWS))
    # the last sort column only parts rows that are equal, so that many of them don't share one range
    order = ["grp", F.col("k1").asc_nulls_first(), "k2", "tie"]
    dealt = scratch.write(held.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order)
                          .sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id()), f"{name}-dealt")
    scratch.drop(f"{name}-rows")
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy("grp", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    listed = sizes.groupBy("grp").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("part", "c", "first"))).alias("parts"))
    starts = listed.select("grp", "n", F.expr("""inline(aggregate(parts,
        named_struct('sum', 0L, 'out', cast(array() as array<struct<part:bigint,base:bigint>>)),
        (s, x) -> named_struct('sum', s.sum + x.c, 'out', concat(s.out, array(named_struct('part', x.part, 'base', s.sum - x.first)))),
        s -> s.out))""")).withColumnRenamed("part", "p")
    return dealt.withColumn("p", part).join(starts, ["grp", "p"]).withColumn("idx", F.col("at") + F.col("base")).drop("p", "at", "base")


def _levels(n: int, fanout: int, levels: int) -> int:
    """How many levels a block folds: all of them, or fewer if it holds the whole tree."""
    if n > fanout ** levels:
        return levels
    height = 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def _block_roots(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``grp, block, blocks, node``: the root of every block's subtree."""
    size = fanout ** levels

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        nodes, n = rows.sort_by("idx")["node"].to_pylist(), rows["n"][0].as_py()
        for _ in range(_levels(n, fanout, levels)):
            nodes = up(nodes, fanout)
        return pa.table({"grp": [key[0].as_py()], "block": [key[1].as_py()], "blocks": [-(-n // size)], "node": nodes})

    return leaves.select("grp", "block", "idx", "n", "node").groupBy("grp", "block").applyInArrow(
        run, "grp string, block long, blocks long, node string")


def butterfly(blocks: DataFrame, scratch: Scratch, name: str, fanout: int) -> DataFrame:
    """Round by round swap of subtree roots: ``grp, block, node`` (by then the group's root) and ``path`` of every block."""
    state = scratch.write(blocks.withColumn("path", F.expr("cast(array() as array<struct<l:string,r:string>>)")), f"{name}-0")
    most, r, span = state.agg(F.max("blocks")).first()[0] or 1, 0, 1
    while span < most:
        digit, low = F.floor(F.col("block") / span) % fanout, F.col("block") % span
        # the blocks of the last subtree answer for those of its numbers that don't exist
        last = F.floor((F.col("blocks") - 1) / span) * span
        present = F.col("blocks") - last
        lows = F.when((F.col("block") >= last) & (present < span), F.sequence(low, F.lit(span - 1), present)).otherwise(F.array(low))
        sent = state.where(F.col("blocks") > span).select(
            "grp", F.floor(F.col("block") / (span * fanout)).alias("up"), digit.alias("digit"), low.alias("own"),
            F.explode(lows).alias("low"), "node", F.struct("block", "blocks", "path").alias("of"))
        met = sent.groupBy("grp", "up", "low").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("digit", "node"))), lambda x: x["node"]).alias("run"),
            F.collect_list(F.when(F.col("own") == F.col("low"), F.struct("digit", "of"))).alias("members"))
        # the digits of a run start at 0 and have no gaps: a member's digit is its place in the run
        place = F.col("m.digit").cast("int")
        swapped = met.select("grp", "run", F.explode("members").alias("m")).select(
            "grp", "m.of.block", "m.of.blocks", F.sha2(F.concat_ws("", "run"), 256).alias("node"),
            F.concat("m.of.path", F.array(F.struct(F.concat_ws("", F.slice("run", F.lit(1), place)).alias("l"),
                                                   F.concat_ws("", F.slice("run", place + 2, F.lit(fanout))).alias("r")))).alias("path"))
        done = state.where(F.col("blocks") <= span).select(*swapped.columns)
        r, span = r + 1, span * fanout
        state = scratch.write(swapped.unionByName(done), f"{name}-{r}")
        scratch.drop(f"{name}-{r - 1}")
    return state.select("grp", "block", "node", "path")


def local_paths(nodes: list[str], height: int, fanout: int) -> list[list[tuple[str, str]]]:
    """For each leaf of a block the siblings left and right of its ancestor, level by level."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    span = 1
    for _ in range(height):
        for i, path in enumerate(paths):
            j = i // span
            run = j - j % fanout
            path.append(("".join(nodes[run:j]), "".join(nodes[j + 1:run + fanout])))
        nodes, span = up(nodes, fanout), span * fanout
    return paths


def _of_blocks(leaves: DataFrame, tops: DataFrame, fanout: int, levels: int, finish, schema: str) -> DataFrame:
    """``finish(leaf rows, path of each leaf, row of the block)`` of each block."""
    def run(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows, of = rows.sort_by("idx"), top.to_pylist()[0]
        upper = [(x["l"], x["r"]) for x in of["path"]]
        local = local_paths(rows["node"].to_pylist(), _levels(rows["n"][0].as_py(), fanout, levels), fanout)
        return finish(rows, [p + upper for p in local], of)

    return leaves.groupBy("grp", "block").cogroup(tops.groupBy("grp", "block")).applyInArrow(run, schema)


def _source_paths(rows: pa.Table, paths: list, of: dict) -> pa.Table:
    return pa.table({"grp": rows["k1"], "subroot": rows["node"], "root": [of["node"]] * len(paths),
                     "above": pa.array([[{"l": a, "r": b} for a, b in p] for p in paths], _PATH)})


_PATH = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def _proofs(rows: pa.Table, paths: list, of: dict) -> pa.Table:
    above = [(x["l"], x["r"]) for x in of["above"]]
    paths = [p + above for p in paths]
    leaves, n = rows["node"].to_pylist(), len(paths)
    folded = [fold(seen or leaf, p) for seen, leaf, p in zip(rows["seen"].to_pylist(), leaves, paths)]
    return pa.table({"id": rows["id"], "leaf": leaves, "subroot": [of["subroot"]] * n, "root": [of["root"]] * n,
                     "proof_sha256": [digest("".join(a + b for a, b in p)) for p in paths],
                     "folded_root": folded, "verified": [x == of["root"] for x in folded]})


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = COLUMNS,
             tamper: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``tamper`` replaces columns by expressions over the table; such a row's ``folded_root``
    is recomputed from the changed leaf and the original siblings.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    leaf, seen = leaf_of([F.col(c) for c in columns]), leaf_of([(tamper or {}).get(c, F.col(c)) for c in columns])
    # null sorts before every source
    rows = docs.select(F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("grp"),
                       F.col(id_col).alias("k1"), leaf.alias("k2"), seen.alias("seen"))
    rows = rows.withColumn("seen", F.when(F.col("seen") != F.col("k2"), F.col("seen")))
    block = F.floor(F.col("idx") / fanout ** block_levels)
    leaves = scratch.write(numbered(rows, scratch, "rows").select(
        "grp", block.alias("block"), "idx", "n", F.col("k2").alias("node"), F.col("k1").alias("id"), "seen"), "leaves")
    tops = butterfly(_block_roots(leaves, fanout, block_levels), scratch, "of-source", fanout)

    roots = tops.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("k1"), F.col("node").alias("k2"))
    sources = scratch.write(numbered(roots, scratch, "sources").select(
        "grp", block.alias("block"), "idx", "n", F.col("k2").alias("node"), "k1"), "source-leaves")
    over = butterfly(_block_roots(sources, fanout, block_levels), scratch, "over-sources", fanout)
    above = _of_blocks(sources, over, fanout, block_levels, _source_paths,
                       "grp string, subroot string, root string, above array<struct<l:string,r:string>>")

    full = tops.drop("node").join(above, "grp")
    schema = f"id {dict(leaves.dtypes)['id']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _of_blocks(leaves, full, fanout, block_levels, _proofs, schema).withColumnRenamed("id", id_col)
