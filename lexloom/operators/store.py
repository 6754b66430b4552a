"""Frames that are read more than once, and running sums without an ordering in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

SLICES = 1024


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's ``spark.checkpoint.dir``; a folder of this machine's own serves only a local session that names none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="lexloom-"))
    return df.checkpoint(eager=True)


def running(df: DataFrame, key: str, value, order: list, name: str) -> DataFrame:
    """df with the sum of value over all rows up to its own, in the order of a numeric key, then of ``order``.

    Sums run on two levels: of slices of the key's range, then inside a slice.
    """
    r = df.agg(F.min(key).alias("a"), F.max(key).alias("b"))
    at = F.when(F.col("b") > F.col("a"), F.floor((F.col(key) - F.col("a")) / (F.col("b") - F.col("a")) * (SLICES - 1))).otherwise(0)
    d = df.crossJoin(F.broadcast(r)).withColumn("_slice", F.coalesce(at, F.lit(SLICES))).drop("a", "b")
    sums = d.groupBy("_slice").agg(F.sum(value).alias("_n"))
    before = sums.select("_slice", F.coalesce(F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_slice").orderBy(key, *order).rowsBetween(W.unboundedPreceding, 0)
    return d.join(F.broadcast(before), "_slice").withColumn(name, F.col("_before") + F.sum(value).over(inside)).drop("_slice", "_before")
