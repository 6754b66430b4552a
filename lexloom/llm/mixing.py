"""Mixing sources to target weights: a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all sizes; a target stops at
``MAX_EPOCHS`` times its source's size and the excess is shared again by weight (water filling in closed form over
prefix sums).  Schedule: over training time t in [0, 1] a source is drawn at the rate base * (1 + a * (2t - 1)); its
integral t + a * (t*t - t) is the source's cumulative demand, which is inverted at each document's cumulative offset
to give the document's training position, one for every pass over the source (pass k starts k source sizes later).
Progress is the share of all words that the schedules have consumed by then, the mean of the integrals by target.
``curriculum`` has a row a document, range-sorted by its first position; ``plan`` has a row a taken copy, by its own.

A source's documents follow one another in the order of md5(doc_id).  Prefix sums run on two levels (sums of hash
slices, then inside a slice), so no task holds a source.  A budget of b words over a source of S gives every document
b div S whole passes and the first b mod S words of the order one more; the document at the end of the budget is taken
in part, so a source's words meet its target to the word.

Edge cases: texts of any length are counted whole; other columns, whatever their names, are not read; a null text has
size 0; null sources form one source of their own; repeated rows count each and tie by
size, so reruns give the same rows; a source without words has target 0; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpoint, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Slope a of a source's schedule, repeating like the weights: early, even, late.
SLOPES = (-0.5, 0.0, 0.5)
#: Hex digits of md5(doc_id) that name a slice of a source; 16 ** digits slices a source.
SLICE_DIGITS = 3


def _cycle(values: tuple, rank: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col(rank) % len(values) + 1)


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with rank, weight, slope and target, by water filling; one row a source."""
    every = W.partitionBy(F.lit(0))
    s = sizes.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumns({"weight": _cycle(weights, "rank"), "slope": _cycle(SLOPES, "rank"), "cap": F.col("source_size") * max_epochs})
    order = every.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumns({
        "full": F.col("cap") / F.col("weight"),
        "at": F.row_number().over(order),
        "level": (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("full"), F.struct("at", "level"))).over(every)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")))
    s = s.withColumn("target", target)
    mean = F.sum(F.col("target") * F.col("slope")).over(every) / F.nullif(F.sum("target").over(every), F.lit(0.0))
    return s.select("source", "source_size", "rank", "slope", "target", F.coalesce(mean, F.lit(0.0)).alias("mean_slope"))


def _placed(docs: DataFrame, weights, max_epochs: int) -> DataFrame:
    d = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.col("doc_id").cast("string")).alias("h")
    ).withColumn("slice", F.coalesce(F.substring("h", 1, SLICE_DIGITS), F.lit("")))
    d = checkpoint(d)
    slices = d.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    goal = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_epochs)
    before = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("slice_at", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).alias("s")
    slices = slices.join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "slice", "slice_at", "source_size", "target", "slope", "mean_slope").alias("s")
    j = d.alias("d").join(slices, (F.col("d.slice") == F.col("s.slice")) & F.col("d.source").eqNullSafe(F.col("s.source")))
    j = j.select("doc_id", "d.source", "size", "h", "d.slice", "slice_at", "source_size", "target", "slope", "mean_slope")
    inside = W.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    j = j.withColumn("at", F.col("slice_at") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    j = j.withColumn("budget", F.floor(F.col("target") + 0.5))
    j = j.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    j = j.withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_size"))
    j = j.withColumn("taken", F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at"))))
    a = F.col("slope")

    def time(k: F.Column) -> F.Column:
        u = (F.col("at") + k * F.col("source_size")) / F.col("budget")
        root = (F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / F.nullif(2 * a, F.lit(0.0))
        return F.when(a == 0, u).otherwise(root)

    def consumed(t: F.Column) -> F.Column:
        return F.round(t + F.col("mean_slope") * (t * t - t), 6)

    last = F.when(F.col("rest") > F.col("at"), F.col("passes")).otherwise(F.col("passes") - 1)
    j = j.withColumn("times", F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), time)))
    j = j.withColumns({"positions": F.transform("times", lambda t: F.round(t, 6)), "progress": F.transform("times", consumed)})
    return j.select("doc_id", "source", "size", "source_size", "target", "taken", "positions", "progress")


def curriculum(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position, positions, progress), sorted by position, the first of positions (null where nothing is taken); progress has a value for each of positions."""
    return _placed(docs, weights, max_epochs).withColumn("position", F.col("positions")[0]).orderBy("position", "doc_id")


def plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, pass, words, position, progress), a row for every taken copy and for each document of which nothing is taken, sorted by position."""
    j = _placed(docs, weights, max_epochs).select("doc_id", "source", "size", "source_size", "target", "taken", F.posexplode_outer(F.arrays_zip("positions", "progress")).alias("pass", "x")).select("*", F.col("x.positions").alias("position"), F.col("x.progress").alias("progress"))
    words = F.when(F.col("pass").isNull(), F.lit(0)).otherwise(F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))).cast("long")
    return j.select("doc_id", "source", "size", "source_size", "target", "taken", "pass", words.alias("words"), "position", "progress").orderBy("position", "doc_id", "pass")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position", F.col("progress")[0].alias("progress"))


#: DuckDB SQL over a relation of documents named by {docs}.
SQL_OF = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
c AS (SELECT *, ([5, 2, 1])[rank % 3 + 1] AS weight, ([-0.5, 0.0, 0.5])[rank % 3 + 1]::DOUBLE AS slope, 3 * source_size AS cap FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS at_, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM c),
v AS (SELECT *, first(level) OVER () AS water FROM (SELECT o.*, (SELECT arg_min(level, at_) FROM o WHERE level <= cap / weight) AS lv FROM o)),
t AS (SELECT source, source_size, slope, CASE WHEN lv IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, lv * weight) END AS target FROM v),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, floor(t.target + 0.5)::BIGINT AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM j),
n AS (SELECT *, passes * size + greatest(0, least(size, budget - passes * source_size - at_)) AS taken, at_::DOUBLE / budget::DOUBLE AS u FROM k)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN round(t, 6) + 0.0 END AS position, CASE WHEN taken > 0 THEN round(t + ms * (t * t - t), 6) + 0.0 END AS progress
FROM (SELECT *, CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END AS t FROM n) CROSS JOIN (SELECT coalesce(sum(target * slope) / nullif(sum(target), 0), 0) AS ms FROM t)
"""
SQL = SQL_OF.replace("{docs}", "documents")
