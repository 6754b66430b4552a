"""Queries over the statistics and the fusion operators, and their SQL.

Runs are made from ``labels``: a document is right in the base run if its quality is 1 and in the other if it is toxic.
Candidate lists are made from ``lineitem``: the lines of an order in the order of their numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import evalstats, fusion


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("row")).agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    size = (10 + F.col("row") % 7).alias("gold_len")
    run = lambda ok: d.select("row", F.col(ok).alias("ok"), F.when(F.col(ok) == 1, 0).otherwise(1 + F.col("row") % 5).cast("long").alias("errors"), size)
    return run("quality"), run("toxic")


_RUNS = (
    "d AS (SELECT doc_id AS row, min(quality) AS b, min(toxic) AS c, 10 + doc_id % 7 AS g, 1 + doc_id % 5 AS e FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id), "
    "p AS (SELECT row, b, c, g, CASE WHEN b = 1 THEN 0 ELSE e END AS be, CASE WHEN c = 1 THEN 0 ELSE e END AS ce FROM d) "
)
_TAIL = "least(1.0, 2 * list_sum(list_transform(range(0, least({f}, {b})::BIGINT + 1), lambda i: exp(lgamma({f} + {b} + 1) - lgamma(i + 1) - lgamma({f} + {b} - i + 1) - ({f} + {b}) * ln(2)))))"


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison of two runs: counts, exact p, error rates."""
    d = evalstats.compare(*runs(spark, sf_dir))
    return d.select("n", "base_ok", "cand_ok", "fixed", "broken", "net", F.round("p", 8).alias("p"), F.round("base_cer", 8).alias("base_cer"), F.round("cand_cer", 8).alias("cand_cer"))


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = evalstats.paired(*runs(spark, sf_dir))
    return j.select("row", (F.col("row") % 40).alias("cluster"), (F.col("c_ok") - F.col("b_ok")).alias("d_ok"), (F.col("c_errors") - F.col("b_errors")).alias("d_err"), "gold_len")


def bootstrap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of 50 draws of rows."""
    return evalstats.bootstrap(_differences(spark, sf_dir), "row", 50)


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of the gain, by 200 draws of whole clusters."""
    d = evalstats.interval(evalstats.bootstrap(_differences(spark, sf_dir), "cluster", 200, 7))
    return d.select("ok_low", "ok_high", F.round("err_low", 8).alias("err_low"), F.round("err_high", 8).alias("err_high"))


def _discordant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which the runs differ, by residue of the row."""
    j = evalstats.paired(*runs(spark, sf_dir))
    return j.groupBy((F.col("row") % 9).alias("part")).agg(F.count_if((F.col("b_ok") == 0) & (F.col("c_ok") == 1)).alias("fixed"), F.count_if((F.col("b_ok") == 1) & (F.col("c_ok") == 0)).alias("broken"))


def poisson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass at or below the count under its own upper bound, which is 5 % by definition, and that the bound lies above the count."""
    d = _discordant(spark, sf_dir).withColumn("u", evalstats.poisson_upper(F.col("fixed")))
    mass = F.aggregate(F.sequence(F.lit(0).cast("long"), "fixed"), F.lit(0.0), lambda s, i: s + F.exp(i * F.log("u") - F.col("u") - evalstats.ln_factorial(i)))
    return d.select("part", "fixed", F.round(mass, 8).alias("mass"), (F.col("u") > F.col("fixed")).alias("above"))


def detectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least detectable surplus for the rows in which the runs differ, up to 60 of them."""
    d = _discordant(spark, sf_dir).select("part", F.least(F.col("fixed") + F.col("broken"), F.lit(60)).alias("d"))
    return evalstats.mde(d, "d").select("part", F.col("d").cast("long").alias("d"), F.col("net").cast("long").alias("net"))


def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _discordant(spark, sf_dir).withColumn("target", F.col("part") == 0)
    return evalstats.verdict(cells)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag"))).alias("x")
    )
    each = lambda f: F.transform("x", f)
    return x.select(
        "row", each(lambda v, i: -0.4 * i).alias("ng"), each(lambda v: -v["l_extendedprice"] / 20000.0).alias("ll"), each(lambda v: v["l_discount"] * 20.0).alias("col"),
        each(lambda v: (v["l_returnflag"] == "R").cast("int")).alias("ok"), each(lambda v: v["l_tax"] >= 0.07).alias("masked"), each(lambda v: F.when(v["l_quantity"] > 45, 0.5).otherwise(0.0)).alias("learn"),
    )


_ROWS = (
    "x AS (SELECT l_orderkey AS row, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity, l_returnflag) - 1 AS i, "
    "-l_extendedprice / 20000e0 AS ll, l_discount * 20e0 AS col, (l_returnflag = 'R')::INT AS ok, l_tax >= 0.07e0 AS masked, CASE WHEN l_quantity > 45 THEN 5e-1 ELSE 0e0 END AS learn FROM lineitem), "
    "r AS (SELECT *, -4e-1 * i AS ng, first_value(ll) OVER w AS ll0, first_value(col) OVER w AS col0, first_value(learn) OVER w AS learn0, first_value(ok) OVER w AS ok0, count(*) OVER (PARTITION BY row) AS size FROM x WINDOW w AS (PARTITION BY row ORDER BY i)), "
)
_SIG = "CASE WHEN ll >= ll0 THEN 1 / (1 + exp(-(ll - ll0))) ELSE exp(ll - ll0) / (1 + exp(ll - ll0)) END"
_FUSED = "ll + (" + _SIG + ") * (0.5e0 / alpha) * (col - col0)"
ALPHAS, TAUS, DELTAS = (0.5, 1.1, 1.5), (0.3, 2.0), (0.0, 0.5)
_GRID = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({a}e0, {t}e0, {d}e0)" for a in ALPHAS for t in TAUS for d in DELTAS) + ") v(alpha, tau, delta)), "
_CELLS = (
    _ROWS + _GRID + f"f AS (SELECT r.*, g.*, ng + alpha * ({_FUSED}) - alpha * ll0 AS gain, ng + alpha * ({_FUSED}) AS s, 0 + alpha * ll0 AS s0 FROM r, g), "
    "b AS (SELECT row, alpha, tau, delta, ok0, ok, row_number() OVER (PARTITION BY row, alpha, tau, delta ORDER BY CASE WHEN i > 0 AND size >= 2 AND 0.4e0 < tau AND s > s0 AND s - s0 >= delta THEN s END DESC NULLS LAST, i) AS k FROM f), "
    "c AS (SELECT alpha, tau, delta, count(*) AS n, sum(ok)::BIGINT AS right_, count_if(ok = 1 AND ok0 = 0) AS fixed, count_if(ok = 0 AND ok0 = 1) AS broken FROM b WHERE k = 1 GROUP BY 1, 2, 3) "
)
_ORDER = "fixed - 1.5 * broken DESC, broken, delta DESC, tau, alpha"


def fusion_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that replaces the first of each list, with a mask and learning terms."""
    d = candidates(spark, sf_dir)
    at = fusion.pick(F.col("ng"), fusion.fuse(F.col("ll"), F.col("col"), 1.1), 1.1, 2.0, 0.1, F.col("masked"), F.col("learn"))
    return d.select("row", at.cast("long").alias("pick"))


def fusion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.cells(candidates(spark, sf_dir), ALPHAS, TAUS, DELTAS).withColumnRenamed("right", "right_")


def fusion_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells chosen by weight, by right rows, and by weight under a bound of the rate of broken rows."""
    grid = fusion.cells(candidates(spark, sf_dir), ALPHAS, TAUS, DELTAS)
    said = lambda d, how: d.select(F.lit(how).alias("how"), "alpha", "tau", "delta", "fixed", "broken")
    return said(fusion.choose(grid, 1.5), "weighted").unionByName(said(fusion.select_plain(grid.where("delta = 0")), "plain")).unionByName(said(fusion.choose(fusion.within(grid, 0.05), 1.5), "capped"))


def fusion_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.frontier(fusion.cells(candidates(spark, sf_dir), ALPHAS, TAUS, DELTAS), 1.5, [0.02, 0.05, 0.1, 0.5]).select("cap", "alpha", "tau", "delta", "fixed", "broken")


def fusion_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = candidates(spark, sf_dir)
    at = fusion.pick(F.col("ng"), fusion.fuse(F.col("ll"), F.col("col"), 1.1), 1.1, 2.0, 0.0)
    return fusion.subsets(d.withColumn("at", at), "at")


def fusion_diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.diagnose(candidates(spark, sf_dir))


def fusion_unflagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists without those of urgent orders, by number of candidates."""
    flags = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("row"))
    return fusion.unflagged(candidates(spark, sf_dir), flags, "row").groupBy(F.size("ng").cast("long").alias("size")).agg(F.count("*").alias("n"))


def fusion_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = fusion.cells(candidates(spark, sf_dir), ALPHAS, TAUS, DELTAS)
    return fusion.beats(fusion.choose(grid, 1.5), grid.where("alpha = 0.5 AND tau = 2.0 AND delta = 0.0"), 1.5)


def fusion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in the order of score and a bonus of 0.5 for those with a learning term, as the place of the first candidate."""
    d = candidates(spark, sf_dir)
    return d.select("row", (F.array_position(fusion.reorder(F.col("ng"), F.col("learn")), F.lit(0)) - 1).cast("long").alias("first_at"))


def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit errors and gold length of each nation's name against its region's; accepted where the first letters agree."""
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    e, n = evalstats.row_stats(F.col("r_name"), F.col("n_name"), F.substring("n_name", 1, 1) == F.substring("r_name", 1, 1))
    return j.select("n_nationkey", e.cast("long").alias("errors"), n.cast("long").alias("gold_len"))


BUILT = {f.__name__: f for f in (
    run_compare, bootstrap_totals, bootstrap_interval, poisson_bounds, detectable, run_verdict, fusion_picks, fusion_grid, fusion_choice, fusion_frontier, fusion_subsets, fusion_diagnose, fusion_unflagged,
    fusion_beats, fusion_order, row_errors,
)}

_W = " + ".join(f"(u >= {b!r}::DOUBLE)::BIGINT" for b in evalstats.POISSON_ONE)


def _draws(unit: str, draws: int, seed: int) -> str:
    return (
        f"u AS (SELECT {unit} AS unit, sum(c - b)::BIGINT AS d_ok, sum(ce - be)::BIGINT AS d_err, sum(g)::BIGINT AS gold FROM p GROUP BY 1), "
        f"h AS (SELECT *, ('0x' || left(md5('{seed}:' || draw || ':' || unit), 8))::BIGINT / 4294967296e0 AS u FROM (SELECT *, unnest(range({draws})) AS draw FROM u)), "
        f"w AS (SELECT *, {_W} AS w FROM h), "
        "t AS (SELECT draw, sum(w)::BIGINT AS units, sum(w * d_ok)::BIGINT AS d_ok, sum(w * d_err)::BIGINT AS d_err, sum(w * gold)::BIGINT AS gold FROM w GROUP BY draw) "
    )


_PARTS = "q AS (SELECT row % 9 AS part, count_if(b = 0 AND c = 1) AS fixed, count_if(b = 1 AND c = 0) AS broken FROM p GROUP BY 1) "
SQL = {
    "run_compare": f"WITH {_RUNS}, a AS (SELECT count(*) AS n, sum(b)::BIGINT AS base_ok, sum(c)::BIGINT AS cand_ok, count_if(b = 0 AND c = 1) AS fixed, count_if(b = 1 AND c = 0) AS broken, sum(be) AS be, sum(ce) AS ce, sum(g) AS g FROM p) "
    f"SELECT n, base_ok, cand_ok, fixed, broken, fixed - broken AS net, round({_TAIL.format(f='fixed', b='broken')}, 8) AS p, round(100 * be::DOUBLE / g, 8) AS base_cer, round(100 * ce::DOUBLE / g, 8) AS cand_cer FROM a",
    "bootstrap_totals": f"WITH {_RUNS}, {_draws('row', 50, 1)} SELECT draw, units, d_ok, d_err, gold FROM t",
    "bootstrap_interval": f"WITH {_RUNS}, {_draws('row % 40', 200, 7)}, a AS (SELECT list_sort(list(d_ok)) AS a, list_sort(list(CASE WHEN gold > 0 THEN d_err::DOUBLE / gold ELSE 0 END)) AS b FROM t) "
    "SELECT a[6] AS ok_low, a[196] AS ok_high, round(b[6], 8) AS err_low, round(b[196], 8) AS err_high FROM a",
    "poisson_bounds": f"WITH {_RUNS}, {_PARTS} SELECT part, fixed, 0.05::DOUBLE AS mass, true AS above FROM q",
    "detectable": f"WITH {_RUNS}, {_PARTS}, s AS (SELECT part, least(fixed + broken, 60)::BIGINT AS d FROM q), "
    f"c AS (SELECT d, c FROM (SELECT d, unnest(range(0, d + 1)) AS c FROM (SELECT DISTINCT d FROM s WHERE d > 0)) WHERE {_TAIL.format(f='c', b='(d - c)')} <= 0.05), "
    "n AS (SELECT d, c, unnest(range(d % 2, d + 1, 2)) AS net FROM c), "
    "w AS (SELECT d, net, sum(CASE WHEN net = d THEN (c = d)::INT::DOUBLE ELSE exp(lgamma(d + 1) - lgamma(c + 1) - lgamma(d - c + 1) + c * ln((d + net) / (2e0 * d)) + (d - c) * ln(1 - (d + net) / (2e0 * d))) END) AS power FROM n GROUP BY 1, 2), "
    "f AS (SELECT d, min(net) AS net FROM w WHERE power >= 0.8 - 1e-9 GROUP BY d) SELECT part, s.d, net FROM s LEFT JOIN f ON s.d = f.d",
    "run_verdict": f"WITH {_RUNS}, {_PARTS}, v AS (SELECT *, {_TAIL.format(f='fixed', b='broken')} AS pv FROM q), a AS (SELECT coalesce(bool_or(part = 0 AND fixed > broken AND pv < 0.05), false) AS gains, count_if(part <> 0 AND fixed < broken AND pv < 0.05) AS losses FROM v) SELECT gains, losses, gains AND losses = 0 AS passed FROM a",
    "fusion_picks": f"WITH {_ROWS} f AS (SELECT *, ng + alpha * ({_FUSED}) + learn - learn0 AS s, 0 + alpha * ll0 AS s0 FROM (SELECT *, 1.1e0 AS alpha FROM r)), "
    "b AS (SELECT row, i, row_number() OVER (PARTITION BY row ORDER BY CASE WHEN i > 0 AND NOT masked AND (0.4e0 < 2 OR learn > learn0) AND s > s0 AND s - s0 >= 0.1e0 THEN s END DESC NULLS LAST, i) AS k FROM f) SELECT row, i AS pick FROM b WHERE k = 1",
    "fusion_grid": f"WITH {_CELLS} SELECT * FROM c",
    "fusion_choice": f"WITH {_CELLS} SELECT 'weighted' AS how, alpha, tau, delta, fixed, broken FROM (SELECT * FROM c ORDER BY {_ORDER} LIMIT 1) UNION ALL SELECT 'plain', alpha, tau, delta, fixed, broken FROM (SELECT * FROM c WHERE delta = 0 ORDER BY right_ DESC, tau, alpha LIMIT 1) "
    f"UNION ALL SELECT 'capped', alpha, tau, delta, fixed, broken FROM (SELECT * FROM c WHERE broken <= 0.05 * n + 1e-9 ORDER BY {_ORDER} LIMIT 1)",
    "fusion_frontier": f"WITH {_CELLS} SELECT cap, alpha, tau, delta, fixed, broken FROM (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY {_ORDER}) AS k FROM c, (VALUES (0.02e0), (0.05e0), (0.1e0), (0.5e0)) v(cap) WHERE broken <= cap * n + 1e-9) WHERE k = 1",
    "fusion_subsets": f"WITH {_CELLS}, o AS (SELECT row, max(ok) AS some_ FROM x GROUP BY row), j AS (SELECT ok0, ok, some_ FROM b JOIN o USING (row) WHERE k = 1 AND alpha = 1.1 AND tau = 2 AND delta = 0) "
    "SELECT count(*) AS n, count_if(ok0 = 1) AS n_right, count_if(ok0 = 1 AND ok = 0) AS broken, count_if(ok0 = 0 AND some_ = 1) AS n_wrong_in, count_if(ok0 = 0 AND ok = 1) AS fixed, count_if(some_ = 0) AS n_wrong_out FROM j",
    "fusion_diagnose": f"WITH {_ROWS} o AS (SELECT row, max(ok) AS some_, max(ok0) AS ok0, max_by(ok, (ll, -i)) AS own, max_by(i, (ll, -i)) AS at_ FROM r GROUP BY row) "
    "SELECT count(*) AS n, count_if(ok0 = 0 AND some_ = 1) AS headroom, count_if(ok0 = 0 AND some_ = 1 AND own = 1) AS alone_head, count_if(ok0 = 1) AS n_right, count_if(ok0 = 1 AND at_ = 0) AS keep, count_if(some_ = 1) AS oracle FROM o",
    "fusion_unflagged": "SELECT size, count(*) AS n FROM (SELECT l_orderkey, count(*) AS size FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY 1) GROUP BY size",
    "fusion_beats": f"WITH {_CELLS}, a AS (SELECT fixed AS f, broken AS b FROM c ORDER BY {_ORDER} LIMIT 1), s AS (SELECT fixed AS f0, broken AS b0 FROM c WHERE alpha = 0.5 AND tau = 2 AND delta = 0), "
    "j AS (SELECT f - 1.5 * b > 0 AND f - 1.5 * b > f0 - 1.5 * b0 AS net, b < b0 AS fewer_broken, f >= b AS no_loss FROM a, s) SELECT *, net AND fewer_broken AND no_loss AS passed FROM j",
    "fusion_order": f"WITH {_ROWS} o AS (SELECT row, i, row_number() OVER (PARTITION BY row ORDER BY ng + learn DESC, i) - 1 AS k FROM r) SELECT row, k AS first_at FROM o WHERE i = 0",
    "row_errors": "SELECT n_nationkey, CASE WHEN left(n_name, 1) = left(r_name, 1) THEN 0 ELSE levenshtein(r_name, n_name) END AS errors, length(n_name) AS gold_len FROM nation JOIN region ON n_regionkey = r_regionkey",
}
