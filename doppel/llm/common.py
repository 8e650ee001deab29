"""Helpers that several corpus operators share.

Intermediate tables go to the shared folder that ``spark.checkpoint.dir`` names:
a lost executor then costs a re-read, never a recomputation of the whole chain,
and no file is left where another executor cannot see it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from doppel.session import ensure_checkpoint_dir

WS = r"[\x20\x09-\x0D]"
NON_WS = r"[^\x20\x09-\x0D]"


def workers_find_package(spark: SparkSession) -> None:
    """Python workers of a session that wasn't started beside the package find it too.

    On a cluster the package is installed or shipped with ``--py-files``; this only
    adds the driver's own path to theirs.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one operator run below the shared checkpoint folder; ``conf`` holds while they are written."""

    def __init__(self, spark: SparkSession, name: str, conf: dict[str, str] | None = None):
        self.spark, self.conf = spark, conf or {}
        workers_find_package(spark)
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        before = {key: self.spark.conf.get(key, None) for key in self.conf}
        try:
            for key, value in self.conf.items():
                self.spark.conf.set(key, value)
            df.write.parquet(f"{self.root}/{name}")
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Free a table that no later result reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_NULLABLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
             pa.bool_(): pd.BooleanDtype()}


def map_exact(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` without floats in between: integers next to nulls keep all their digits.

    Integer columns come as pandas' nullable types. Integers inside of arrays don't.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in run(b.to_pandas(types_mapper=_NULLABLE.get) for b in batches):
            yield pa.RecordBatch.from_pandas(made, arrow, preserve_index=False)

    return rows.mapInArrow(each, schema)


# a broadcast of ids takes at most some tens of megabytes
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table of a few narrow columns if it has at most ``rows`` rows.

    A larger one is left to the planner, which then shuffles both sides of the join.
    """
    return F.broadcast(written) if written.count() <= rows else written


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used inside a lambda is evaluated again for every element; bound
    as a lambda variable of its own it is evaluated once per row.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a whole text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS + "+"), lambda w: w != "")
