"""Lexicon layers: variant classes, admission, caps of variants, substring counts, sampling to a size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lexloom.operators.store import kept


def merge_variants(uni: DataFrame, bi: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts with variants as one word: uni (w, n) has a class's sum at every member; bi (v, w, c) sums classes, has the next word at the representative alone and the context at every member.

    classes has a row a member, member and rep (the representative is a member).
    """
    of = lambda d, c: d.join(classes.select(F.col("member").alias(c), F.col("rep").alias(f"{c}_rep")), c, "left").withColumn(c, F.coalesce(f"{c}_rep", c)).drop(f"{c}_rep")
    back = lambda d, c: d.join(classes.select(F.col("rep").alias(c), F.col("member").alias(f"{c}_member")), c, "left").withColumn(c, F.coalesce(f"{c}_member", c)).drop(f"{c}_member")
    u = back(of(uni.select("w", "n"), "w").groupBy("w").agg(F.sum("n").alias("n")), "w")
    b = of(of(bi.select("v", "w", "c"), "v"), "w").groupBy("v", "w").agg(F.sum("c").alias("c"))
    return u.select("w", "n"), back(b, "v").select("v", "w", "c")


def representatives(words: DataFrame, classes: DataFrame) -> DataFrame:
    """words (w) that stand for themselves: those in no class, and of each class the representative."""
    other = classes.where("member <> rep").select(F.col("member").alias("w"))
    return words.join(other, "w", "left_anti")


def substring_counts(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(w, c): occurrences of every candidate in the column text, overlaps counted; 0 where there is none.

    Substrings of the candidates' lengths are counted within a text first and joined by equality.
    """
    sizes = [r[0] for r in candidates.where("length(w) > 0").select(F.length("w")).distinct().collect()]
    if not sizes:
        return candidates.select("w", F.lit(0).cast("long").alias("c"))

    def parts(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1)))
        return F.when(F.length("text") >= n, F.transform(at, lambda i: F.substr("text", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    each = F.flatten(F.array(*map(parts, sorted(sizes))))
    seen = texts.where("text IS NOT NULL").select(F.explode(each).alias("w")).join(candidates.select("w").distinct(), "w", "left_semi")
    return candidates.select("w").join(seen.groupBy("w").agg(F.count("*").alias("c")), "w", "left").select("w", F.coalesce("c", F.lit(0)).alias("c"))


def literal_count(text: Column, word: Column) -> Column:
    """Occurrences of a word in a text from the left, none over another."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.greatest(F.length(word), F.lit(1))).cast("long")


def capped_variants(scores: DataFrame, order: DataFrame, gap: float = 0.01) -> DataFrame:
    """scores (reading, word, score) in which a lesser variant stands under the better ones of its reading; order has reading, less and more."""
    more = scores.select("reading", F.col("word").alias("more"), F.col("score").alias("top"))
    best = order.join(more, ["reading", "more"]).groupBy("reading", F.col("less").alias("word")).agg(F.max("top").alias("top"))
    return scores.join(best, ["reading", "word"], "left").withColumn("score", F.least("score", F.coalesce(F.col("top") - gap, F.col("score")))).drop("top")


def landing(pairs: DataFrame) -> DataFrame:
    """(word, last): where a removed spelling lands, following the pairs (word, to) to their end; words of a circle are left out.

    Each round doubles the steps, so a chain of n needs log2(n) rounds; every round is checkpointed.
    """
    at = kept(pairs.select("word", F.col("to").alias("last")).distinct())
    rounds = max(1, at.count()).bit_length() + 1
    for _ in range(rounds):
        step = at.select(F.col("word").alias("last"), F.col("last").alias("next"))
        now = kept(at.join(step, "last", "left").select("word", F.coalesce("next", "last").alias("last"), F.col("next").isNotNull().alias("moved")))
        at = now.select("word", "last")
        if not now.where("moved").take(1):
            return at
    open_ = at.join(pairs.select(F.col("word").alias("last")), "last", "left_semi").select("word")
    return at.join(open_, "word", "left_anti")


def admit(candidates: DataFrame, stages: list[tuple[str, Column | DataFrame]]) -> DataFrame:
    """candidates with stage: the first stage that refuses a row, or 'kept'.  A stage is a condition to pass, or a frame of refused words (w)."""
    d, first = candidates, F.lit(None).cast("string")
    for k, (name, rule) in enumerate(stages):
        if isinstance(rule, DataFrame):
            d = d.join(rule.select("w").distinct().withColumn(f"_hit{k}", F.lit(True)), "w", "left")
            first = F.coalesce(first, F.when(F.col(f"_hit{k}").isNotNull(), name))
        else:
            first = F.coalesce(first, F.when(~F.coalesce(rule, F.lit(False)), name))
    return d.withColumn("stage", F.coalesce(first, F.lit("kept"))).select(*candidates.columns, "stage")


def subset_sum(sizes: list[int], target: int) -> list[int] | None:
    """Places of sizes that add to a target, or None; exact, over a list of bounded length."""
    reach: dict[int, tuple[int, int]] = {0: (-1, -1)}
    for k, size in enumerate(sizes):
        for have in sorted(reach, reverse=True):
            if have + size <= target:
                reach.setdefault(have + size, (have, k))
    if target not in reach:
        return None
    out = []
    while target:
        target, k = reach[target]
        out.append(k)
    return out[::-1]


SLICES = 4096


def sample_to_cap(lines: DataFrame, key: str, size: str, cap: int, slack: int = 60, pool: int = 1000, seed: str = "lexloom") -> DataFrame:
    """lines whose sizes sum to the cap exactly (or all, if they sum to less): a prefix of a hash order, then a subset of the next ``pool`` lines for the rest.

    The prefix is cut on two levels, slices of the hash and then inside one slice, so no task orders all lines.
    """
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    d = lines.withColumn("_h", h).withColumn("_s", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    slices = d.groupBy("_s").agg(F.sum(size).alias("n"))
    total = slices.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total <= cap:
        return lines
    upto = slices.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(F.broadcast(upto.select("_s", "before")), "_s")
    inside = W.partitionBy("_s").orderBy("_h", key)
    d = d.withColumn("_at", F.col("before") + F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    head = d.where(F.col("_at") <= cap - slack)
    have = head.agg(F.coalesce(F.max("_at"), F.lit(0))).first()[0]
    rest = d.where(F.col("_at") > cap - slack).orderBy("_at").limit(pool).select(key, size).collect()
    chosen = subset_sum([r[size] for r in rest], cap - have) or []
    more = lines.sparkSession.createDataFrame([(rest[k][key],) for k in chosen], lines.select(key).schema)
    return head.select(*lines.columns).unionByName(lines.join(F.broadcast(more), key, "left_semi"))


def review(words: DataFrame, most: int = 200, rest: int = 200, seed: str = "lexloom") -> DataFrame:
    """words (w, n) to read before use: the most frequent, and as many of the others by a hash."""
    top = words.orderBy(F.desc("n"), "w").limit(most).withColumn("part", F.lit("top"))
    others = words.join(top.select("w"), "w", "left_anti")
    return top.unionByName(others.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "w"), 256), "w").limit(rest).withColumn("part", F.lit("other")))


def version_key(version: Column) -> Column:
    """Numeric parts of a version, in whose order versions sort."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))


def fits(counts: DataFrame, sizes: Column, steps: list[int], most: int) -> int | None:
    """The first least count of the steps with which the rows of counts (c, and a size each) have at most so many bytes; None for none."""
    r = counts.agg(*[F.coalesce(F.sum(F.when(F.col("c") >= k, sizes)), F.lit(0)).alias(str(k)) for k in steps]).first()
    return next((k for k in steps if r[str(k)] <= most), None)


def length_scores(words: DataFrame, least: int, low: int, high: int) -> DataFrame:
    """(size, score): the score at a quarter of the sorted scores (w, lp) of each length, carried on from the length before where fewer than ``least`` words have it."""
    sized = words.select(F.length("w").alias("size"), "lp").groupBy("size", "lp").agg(F.count("*").alias("c"))
    upto = W.partitionBy("size").orderBy("lp")
    d = sized.select("size", "lp", F.sum("c").over(upto).alias("upto"), F.sum("c").over(W.partitionBy("size")).alias("n")).where((F.col("n") >= least) & (F.col("upto") > F.floor(F.col("n") / 4)))
    d = d.groupBy("size").agg(F.min("lp").alias("own"))
    every = words.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("size")).join(d, "size", "left")
    return every.select("size", F.last("own", True).over(W.orderBy("size")).alias("score")).where("score IS NOT NULL")
