"""Time-decayed memory: weights halve every HALF_LIFE days and never grow by the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

HALF_LIFE, ACTIVE, LEAST = 14.0, 0.5, 0.05


def decayed(weight: Column, day: Column, today: Column) -> Column:
    return weight * F.pow(F.lit(0.5), F.greatest(today - day, F.lit(0)) / HALF_LIFE)


def bump(log: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """Weight of each key after all its bumps, in closed form; log has day and delta."""
    return log.groupBy(*keys).agg(F.sum(decayed(F.col("delta"), F.col("day"), today)).alias("weight"), F.max("day").alias("day"))


def prune(records: DataFrame, cap: int, by: list[str], order: list) -> DataFrame:
    """Records of weight LEAST or more, at most cap of each group by weight."""
    w = W.partitionBy(*by).orderBy(F.desc("weight"), *order)
    return records.where(F.col("weight") >= LEAST).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def last_writer(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the greatest seq of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, "r.*")


def lookup(probes: DataFrame, levels: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Weight at the first level (exact, then coarser) that holds an active record for the probe; probes have id."""
    found = None
    for k, (records, keys) in enumerate(levels):
        hit = probes.join(records.where(F.col("weight") >= ACTIVE).select(*keys, "weight"), keys).select("id", F.lit(k).alias("level"), "weight")
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("id").agg(F.min(F.struct("level", -F.col("weight"))).alias("m")).select("id", F.col("m.level").alias("level"), (-F.col("m")["col2"]).alias("weight"))
