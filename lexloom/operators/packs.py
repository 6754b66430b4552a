"""Building word packs beside a lexicon: order of homophones, forced and capped words, exemptions, samples, and judging of answers.

Frames of words have reading and word; scores are log10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def named_rank(rows: DataFrame) -> DataFrame:
    """(reading, word, rank): the first place (column at) at which a word is named under a reading."""
    return rows.groupBy("reading", "word").agg(F.min("at").alias("rank"))


def first_named(rank: DataFrame, pack: DataFrame) -> DataFrame:
    """(reading, word): of the words that are in the pack, the one named first under each reading."""
    inside = rank.join(pack.select("word").distinct(), "word", "left_semi")
    return inside.groupBy("reading").agg(F.min_by("word", F.struct("rank", "word")).alias("word"))


def ordered(words: DataFrame, rank: DataFrame) -> DataFrame:
    """words (reading, word, shipped, sources) with place: named ones by rank, then shipped ones, then by number of sources, then by spelling."""
    order = W.partitionBy("reading").orderBy(F.col("rank").asc_nulls_last(), F.desc("shipped"), F.desc("sources"), "word")
    return words.join(rank, ["reading", "word"], "left").withColumn("place", F.row_number().over(order)).drop("rank")


def frozen(words: DataFrame, counts: DataFrame, total: int, model: str) -> DataFrame:
    """(word, n, total, model): counts that a model has of words, with its size and hash; words it does not have are left out."""
    return counts.where("n > 0").join(words.select("word").distinct(), "word", "left_semi").select("word", "n", F.lit(total).alias("total"), F.lit(model).alias("model"))


def forced(rows: DataFrame, first: DataFrame, decided: DataFrame, counts: DataFrame, total: int, margin: float = 0.5) -> DataFrame:
    """(word): words of the pack's rows (reading, word, floor) under decided readings that stand behind another word there, or whose share is under the floor by more than the margin."""
    on = rows.join(decided.select("reading").unionByName(first.select("reading")).distinct(), "reading", "left_semi")
    j = on.join(first.select("reading", F.col("word").alias("first")), "reading", "left").join(counts.select("word", "n"), "word", "left")
    keeps = F.coalesce(F.log10(F.when(F.col("n") > 0, F.col("n") / total)) >= F.col("floor") - margin, F.lit(False))
    return j.where(~F.col("word").eqNullSafe(F.col("first")) | ~keeps).select("word").distinct()


def kept_caps(rows: DataFrame, first: DataFrame, out: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(reading, word, score): rows (reading, word, score) named first and not forced, at most at their share."""
    j = rows.join(first, ["reading", "word"], "left_semi").join(out, "word", "left_anti").join(counts.where("n > 0").select("word", "n"), "word")
    return j.select("reading", "word", F.least("score", F.log10(F.col("n") / total)).alias("score"))


def undecided(found: DataFrame, decided: DataFrame, first: DataFrame, shipped: DataFrame) -> DataFrame:
    """Collisions (reading, word, now) that nobody has settled: now, the word that wins, is not shipped, and the pair is not decided in favour of it."""
    settled = decided.select("reading", "word").join(first.select("reading", F.col("word").alias("now")), "reading")
    return found.join(shipped.select(F.col("word").alias("now")).distinct(), "now", "left_anti").join(settled, ["reading", "word", "now"], "left_anti").select(*found.columns)


def sampled(rows: DataFrame, key: list[str], n: int, seed: str) -> DataFrame:
    """n rows in the order of a hash of seed and key."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]), 256), *key).limit(n)


def one_each(rows: DataFrame, group: str, key: list[str], n: int, seed: str) -> DataFrame:
    """One row of each group by a hash, equal rows once, n of them at most."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in (group, *key)]), 256)
    one = rows.groupBy(group).agg(F.min_by(F.struct(*key), F.struct(h, *key)).alias("x")).select("x.*").distinct()
    return sampled(one, key, n, seed)


def sent_on(rows: DataFrame, landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose word stays, and (word, last, reading) of those whose word lands elsewhere."""
    known = landing.select("word", "last")
    return rows.join(known, "word", "left_anti"), rows.join(known, "word").select("word", "last", "reading")


def rolled(pairs: DataFrame) -> DataFrame:
    """(target, sources): the titles that lead to a target, in order."""
    return pairs.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def exempt(scores: DataFrame, sole: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """Two lists of (reading, word): the dictionary's only reading is not the best and not at the floor; or it is at the floor under a better one.

    scores has every reading of a word with its score, sole the dictionary's words of one reading.
    """
    best = scores.groupBy("word").agg(F.max("score").alias("top"), F.count_distinct("reading").alias("n")).where("n >= 2")
    j = scores.groupBy("reading", "word").agg(F.max("score").alias("score")).join(best, "word").join(sole, ["reading", "word"], "left_semi").where("score < top")
    at_floor = F.abs(F.col("score") - floor) < 1e-9
    return j.where(~at_floor).select("reading", "word"), j.where(at_floor).select("reading", "word")


def trimmed(records: DataFrame, cap: int) -> DataFrame:
    """The cap heaviest records (weight, day, word) of all; of equals the later in order goes first."""
    return records.orderBy(F.desc("weight"), F.desc("day"), "word").limit(cap)


def accepted(candidate: Column, gold: Column, others: Column, normal=lambda x: x) -> Column:
    """Whether an answer is the gold text or another accepted one, all in normal form."""
    return (normal(candidate) == normal(gold)) | F.coalesce(F.exists(others, lambda x: normal(x) == normal(candidate)), F.lit(False))


def beam_metrics(rows: DataFrame, wide: int = 64, near: int = 16) -> DataFrame:
    """One row of counts over (answers, gold, oov): gold among the first answers, near and wide, and the first and wide ones of rows with an unknown word."""
    among = lambda k: F.array_contains(F.slice("answers", 1, k), F.col("gold"))
    return rows.agg(
        F.count("*").alias("n"), F.count_if(among(near)).alias("near"), F.count_if(among(wide)).alias("wide"), F.count_if(F.col("oov")).alias("oov"),
        F.count_if(F.col("oov") & (F.get("answers", F.lit(0)) == F.col("gold"))).alias("oov_first"), F.count_if(F.col("oov") & among(wide)).alias("oov_wide"),
    )


def disagreement(rows: DataFrame) -> DataFrame:
    """One row: rows with a confirmed reading, and those whose derived reading is another."""
    return rows.agg(F.count_if(F.col("reading").isNotNull()).alias("confirmed"), F.count_if(F.col("reading").isNotNull() & ~F.col("reading").eqNullSafe(F.col("derived"))).alias("other"))


def owned(packs: list[DataFrame]) -> DataFrame:
    """Words of any of the packs, each once."""
    out = packs[0].select("word")
    for p in packs[1:]:
        out = out.unionByName(p.select("word"))
    return out.distinct()


def disjoint(layers: list[DataFrame], keys: list[str]) -> bool:
    """Whether no key stands in two layers."""
    every = None
    for d in layers:
        d = d.select(*keys).distinct()
        every = d if every is None else every.unionByName(d)
    return not every.groupBy(*keys).count().where("count > 1").limit(1).count()


def tiered(candidates: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first candidates (by, word, tier, score) of each group: the best tier and score of a word, tiers in order, then score, length and spelling."""
    best = candidates.groupBy(*by, "word").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("x")).select(*by, "word", F.col("x.tier").alias("tier"), (-F.col("x.s")).alias("score"))
    return best.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("tier", F.desc("score"), F.length("word"), "word"))).where(F.col("place") <= limit)


def predictions(model: DataFrame, uni: DataFrame, contexts: DataFrame, limit: int) -> DataFrame:
    """(v, word, tier, score, place): successors of a context (tier 0), then the most frequent words (tier 1), each word once.

    model has v, w and p, uni has w and pb.  A context with fewer successors than the limit needs no more than twice the
    limit of frequent words, so only those are paired with contexts.
    """
    first = model.join(contexts.select("v").distinct(), "v", "left_semi").select("v", F.col("w").alias("word"), F.lit(0).alias("tier"), F.col("p").alias("score"))
    top = uni.orderBy(F.desc("pb"), F.length("w"), "w").limit(2 * limit).select(F.col("w").alias("word"), F.lit(1).alias("tier"), F.col("pb").alias("score"))
    return tiered(first.unionByName(contexts.select("v").distinct().crossJoin(F.broadcast(top))), ["v"], limit)


def scan_depth(entries: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    """(by, depth, full_): entries read in order until ``limit`` different words that are no successors have come; all entries if they never do.

    entries have word and successor (boolean).
    """
    o = W.partitionBy(*by).orderBy(*order)
    new = (F.row_number().over(W.partitionBy(*by, "word").orderBy(*order)) == 1) & ~F.col("successor")
    d = entries.withColumn("at", F.row_number().over(o)).withColumn("new", new.cast("int"))
    d = d.withColumn("seen", F.sum("new").over(o.rowsBetween(W.unboundedPreceding, 0)))
    reached = F.min(F.when(F.col("seen") >= limit, F.col("at")))
    return d.groupBy(*by).agg(F.coalesce(reached, F.max("at")).alias("depth"), reached.isNotNull().alias("full_"))


def differing(want: Column, got: Column) -> Column:
    """Pairs of characters in which two texts of one length differ; null for texts of different lengths."""
    both = F.zip_with(F.split(want, ""), F.split(got, ""), lambda a, b: F.struct(a.alias("want"), b.alias("got")))
    return F.when(F.length(want) == F.length(got), F.filter(both, lambda p: p["want"] != p["got"]))


def public(rows: DataFrame, names: list[str]) -> DataFrame:
    """Only the columns of an allow-list that are there, in its order."""
    return rows.select(*[c for c in names if c in rows.columns])
