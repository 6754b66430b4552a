"""Fusion of two scorers over candidate lists, and choice of its parameters on a grid.

A row has the arrays ng (first scorer, best first), ll and col (second and third), ok (0 or 1), masked and learn, one value
a candidate.  Picks are 0-based; ties keep the earlier candidate.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lexloom.functions.text import sigmoid
from lexloom.operators.evalstats import poisson_upper

GATE_T, MU = 1.0, 0.5


def fuse(ll: Column, col: Column, alpha: Column | float) -> Column:
    """ll of every candidate, moved by the third score's gain over the first candidate as far as ll opens the gate."""
    gain = lambda x, y: x + sigmoid((x - F.get(ll, F.lit(0))) / GATE_T) * (MU / alpha) * (y - F.get(col, F.lit(0)))
    return F.zip_with(ll, col, gain)


def pick(ng: Column, ll: Column, alpha: Column | float, tau: Column | float, delta: Column | float, masked: Column | None = None, learn: Column | None = None) -> Column:
    """Index of the candidate that replaces the first: the greatest ng + alpha * ll + learning gain, if it gains delta or more.

    Where ng leads by tau or more only candidates with a learning gain may replace the first.
    """
    n = F.size(ng)
    masked = F.transform(ng, lambda _: F.lit(False)) if masked is None else masked
    learn = F.transform(ng, lambda _: F.lit(0.0)) if learn is None else learn
    first = lambda a: F.get(a, F.lit(0))
    sure = first(ng) - F.get(ng, F.lit(1)) >= tau
    start = first(ng) + alpha * first(ll)
    score = lambda i: F.get(ng, i) + alpha * F.get(ll, i) + F.get(learn, i) - first(learn)
    usable = lambda i: (i > 0) & ~F.get(masked, i) & (~sure | (F.get(learn, i) > first(learn)))
    at = F.filter(F.transform(ng, lambda _, i: i), usable)
    best = F.array_max(F.transform(at, lambda i: F.struct(score(i).alias("s"), (-i).alias("i"))))
    return F.when((n >= 2) & (best["s"] > start) & (best["s"] - start >= delta), -best["i"]).otherwise(F.lit(0))


def finite(col: Column) -> Column:
    return F.forall(col, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def cells(rows: DataFrame, alphas: list[float], taus: list[float], deltas: list[float]) -> DataFrame:
    """(alpha, tau, delta, n, right, fixed, broken) of every point of the grid; a row meets the grid within itself and only sums leave it."""
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(t).alias("tau"), F.lit(d).alias("delta")) for a, t, d in itertools.product(alphas, taus, deltas)])
    r = rows.select("ng", "ll", "col", "ok", F.explode(grid).alias("g")).select("ng", "ll", "col", "ok", "g.*")
    r = r.withColumn("i", pick(F.col("ng"), fuse(F.col("ll"), F.col("col"), F.col("alpha")), F.col("alpha"), F.col("tau"), F.col("delta")))
    before, after = F.col("ok")[0], F.get("ok", F.col("i"))
    return r.groupBy("alpha", "tau", "delta").agg(
        F.count("*").alias("n"), F.sum(after).alias("right"), F.count_if((after == 1) & (before == 0)).alias("fixed"), F.count_if((after == 0) & (before == 1)).alias("broken")
    )


def choose(grid: DataFrame, weight: float, by: list[str] | None = None) -> DataFrame:
    """The cell of greatest fixed - weight * broken (of each group): then fewer broken, larger delta, smaller tau, smaller alpha."""
    order = [F.desc(F.col("fixed") - weight * F.col("broken")), F.asc("broken"), F.desc("delta"), F.asc("tau"), F.asc("alpha")]
    if not by:
        return grid.orderBy(*order).limit(1)
    return grid.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("k = 1").drop("k")


def select_plain(grid: DataFrame) -> DataFrame:
    """The cell with most right rows: then smaller tau, smaller alpha."""
    return grid.orderBy(F.desc("right"), "tau", "alpha").limit(1)


def within(grid: DataFrame, cap: float | Column, upper: bool = False) -> DataFrame:
    """Cells whose rate of broken rows, or its 95 % upper bound, is at most cap."""
    if upper:
        return grid.where(poisson_upper(F.col("broken")) / F.col("n") <= cap + 1e-12)
    return grid.where(F.col("broken") <= cap * F.col("n") + 1e-9)


def frontier(grid: DataFrame, weight: float, caps: list[float], upper: bool = False) -> DataFrame:
    """The choice under each cap; caps that no cell meets are left out."""
    g = grid.withColumn("cap", F.explode(F.array(*map(F.lit, caps))))
    return choose(within(g, F.col("cap"), upper), weight, ["cap"])


def subsets(rows: DataFrame, choice: str) -> DataFrame:
    """One row: rows right at first and those broken, rows wrong with a right candidate and those fixed, rows without any."""
    before, after, some = F.col("ok")[0] == 1, F.get("ok", F.col(choice)) == 1, F.exists("ok", lambda x: x == 1)
    return rows.agg(
        F.count("*").alias("n"), F.count_if(before).alias("n_right"), F.count_if(before & ~after).alias("broken"), F.count_if(~before & some).alias("n_wrong_in"),
        F.count_if(~before & some & after).alias("fixed"), F.count_if(~some).alias("n_wrong_out"),
    )


def alone(col: Column) -> Column:
    """Index of the second scorer's own best candidate, the earliest of equals."""
    best = F.array_max(F.transform(col, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))
    return F.when(F.size(col) < 2, 0).otherwise(-best["i"])


def diagnose(rows: DataFrame, column: str = "ll") -> DataFrame:
    """One row: headroom, what the second scorer alone would fix of it, and what it would keep."""
    before, some, own = F.col("ok")[0] == 1, F.exists("ok", lambda x: x == 1), alone(F.col(column))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(~before & some).alias("headroom"), F.count_if(~before & some & (F.get("ok", own) == 1)).alias("alone_head"), F.count_if(before).alias("n_right"),
        F.count_if(before & (own == 0)).alias("keep"), F.count_if(some).alias("oracle"),
    )


def unflagged(rows: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Rows without a flagged key."""
    return rows.join(flags.select(key), key, "left_anti")


def beats(new: DataFrame, shipped: DataFrame, weight: float) -> DataFrame:
    """One row: the conditions of replacing the shipped cell by a new one (each a frame of one row with fixed and broken), and all of them."""
    j = new.select(F.col("fixed").alias("f"), F.col("broken").alias("b")).crossJoin(shipped.select(F.col("fixed").alias("f0"), F.col("broken").alias("b0")))
    net, net0 = F.col("f") - weight * F.col("b"), F.col("f0") - weight * F.col("b0")
    j = j.select(((net > 0) & (net > net0)).alias("net"), (F.col("b") < F.col("b0")).alias("fewer_broken"), (F.col("f") >= F.col("b")).alias("no_loss"))
    return j.withColumn("passed", F.col("net") & F.col("fewer_broken") & F.col("no_loss"))


def reorder(ng: Column, bonus: Column) -> Column:
    """Order of the candidates by score and bonus, the earlier first of equals."""
    scored = F.transform(F.zip_with(ng, bonus, lambda a, b: a + b), lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.array_sort(scored), lambda x: x["i"])
