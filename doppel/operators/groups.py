"""Duplicate clusters (C1): match edges -> components -> campus filter -> DupID."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.operators.components import connected_components
from doppel.operators.pairs import linking_edges
from doppel.operators.ranking import dense_number


def find_duplicate_groups(persons: DataFrame, campus_id: int | None = None,
                          edges: DataFrame | None = None, swap_keys: bool = False) -> DataFrame:
    """``(dup_id, person_id)`` for every person in a cluster of two or more.

    ``campus_id=None`` searches all campuses (FindAllGroups). With a campus id
    a cluster is kept when at least one member record is at that campus; the
    filter runs after clustering, never before it (FindGroups). A campus id
    <= 0 yields no clusters (P3). DupIDs are 1..n in order of each cluster's
    smallest person id (the reference's order depends on map iteration; the
    set of clusters is the same, SURVEY Q1). ``swap_keys`` also compares records with
    first and last name exchanged.
    """
    if campus_id is not None and campus_id <= 0:
        return _empty(persons)
    if edges is None:
        edges = linking_edges(persons, swap_keys)  # the components take each edge once
    comp = connected_components(edges).select(F.col("node").alias("person_id"), "label")
    if campus_id is not None:
        at_campus = persons.where(F.col("campus_id") == F.lit(campus_id)).select(F.col("person_id").cast("long"))
        labels = comp.join(at_campus, "person_id", "left_semi").select("label").distinct()
        comp = comp.join(labels, "label", "left_semi")
    numbered = dense_number(comp, "label", "dup_id")
    return (comp.join(numbered, "label")
            .select(F.col("dup_id").cast("long"), F.col("person_id").cast("long")))


def _empty(persons: DataFrame) -> DataFrame:
    return persons.sparkSession.createDataFrame([], "dup_id bigint, person_id bigint")
