"""Connected components over an edge DataFrame.

Alternating *large-star* / *small-star* rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014). Every round is two
aggregations and two joins on node ids; the edge count never grows beyond the
input, and a hub with many neighbours is an aggregation key (map-side
partial min) plus a join whose skewed side AQE splits. The lineage is cut
after every round by a copy below ``spark.checkpoint.dir``, so that a lost
executor re-reads the last round instead of recomputing all of them.

The label of a component is its smallest node id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.session import written


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))


def _oriented(df: DataFrame, a: str, b: str) -> DataFrame:
    return (df.where(F.col(a) != F.col(b))
            .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
            .distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    # every neighbour larger than u is re-attached to the smallest of u's
    # closed neighbourhood
    nb = _neighbours(edges)
    m = nb.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _oriented(nb.where(F.col("v") > F.col("u")).join(m, "u").select("v", "m"), "v", "m")


def _small_star(edges: DataFrame) -> DataFrame:
    # u and all its smaller neighbours are re-attached to the smallest of them
    m = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(m, "hi").select(F.col("lo").alias("x"), F.col("m"))
    own = m.select(F.col("hi").alias("x"), F.col("m"))
    return _oriented(moved.union(own), "x", "m")


def _ends(edges: DataFrame) -> DataFrame:
    """``n, up, down`` of every node: edges to smaller nodes, and whether larger ones hang on it."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))


def _is_star_forest(edges: DataFrame) -> bool:
    """True when every node has one parent and every parent is a root."""
    return _ends(edges).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         max_rounds: int = 100) -> DataFrame:
    """``(node, label)`` for every node that has at least one edge.

    Self-loops are ignored; isolated nodes do not appear (the reference's
    union-find only holds ids that took part in a union).
    """
    current = written(_small_star(_large_star(written(_oriented(edges, src, dst)))))
    # A node with a single edge, to a smaller one, takes that one's label at the end and lets all others be:
    # after a round most nodes are such, and the rounds that follow see the rest only.
    inner = _ends(current).where("up <> 1 OR down > 0").where("up > 0").select(F.col("n").alias("hi"))
    core = written(current.join(inner, "hi", "left_semi").select("hi", "lo"))
    leaves = current.join(inner, "hi", "left_anti")
    for _ in range(max_rounds):
        if _is_star_forest(core):
            break
        core = written(_small_star(_large_star(core)))
    else:
        raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")
    members = core.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    known = members.union(core.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
    leaf_labels = leaves.join(known.withColumnRenamed("node", "lo"), "lo", "left").select(
        F.col("hi").alias("node"), F.coalesce("label", "lo").alias("label"))
    # every root holds a node: the smallest of its component is its label
    labelled = written(members.union(leaf_labels))
    return labelled.union(labelled.select(F.col("label").alias("node"), "label").distinct())
