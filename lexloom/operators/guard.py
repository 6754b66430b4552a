"""Held-out guard: which texts contain a held-out pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import TextProfile, sentences
from lexloom.operators.store import kept


def containment(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, item_id) where a text contains a whole pattern.

    A pattern's second to fourth words stand between spaces in any text that contains it, so they are an equi-join key;
    the whole pattern is then looked for.  Patterns of fewer than five words have no such key and are looked for in
    every text (a broadcast nested loop over the short patterns alone).
    """
    p = patterns.where("length(text) > 0").select("item_id", F.col("text").alias("pattern"), F.split("text", " ").alias("w"))
    long = p.where(F.size("w") >= 5).select("item_id", "pattern", F.expr("xxhash64(w[1], w[2], w[3])").alias("key"))
    t = texts.select("doc_id", "text", F.split("text", " ").alias("w"))
    keys = t.where(F.size("w") >= 3).select("doc_id", F.explode(F.array_distinct(F.expr("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"))).alias("key"))
    found = keys.join(long, "key").join(texts.select("doc_id", "text"), "doc_id").where("instr(text, pattern) > 0").select("doc_id", "item_id")
    short = p.where(F.size("w") < 5).select("item_id", "pattern")
    return found.unionByName(texts.join(short, F.expr("instr(text, pattern) > 0")).select("doc_id", "item_id")).distinct()


def report(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: units, units that are hit, patterns that hit."""
    n = texts.agg(F.count("*").alias("units"))
    return n.crossJoin(hits.agg(F.count_distinct("doc_id").alias("hit_units"), F.count_distinct("item_id").alias("hit_patterns")))


def reasons(texts: DataFrame, held: DataFrame, refused: str, profile: TextProfile, low: int, high: int) -> DataFrame:
    """(s, reason) for every sentence of the texts (doc_id, text): the first that holds of simplified (a refused character), no_letter, length, duplicate, eval_overlap; else kept.

    Only a kept sentence makes a later one a duplicate, so copies of an overlapping sentence all overlap.  Held-out
    sentences (item_id, text) of fewer than ``low`` characters remove nothing.  Sentences are judged once however often
    they stand, so a frequent sentence costs a sum.
    """
    s = texts.select(F.explode(sentences(F.col("text"), profile)).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    s = kept(s.withColumn("doc_id", F.xxhash64("s")))
    out = F.when(F.col("s").rlike(f"[{refused}]"), "simplified").when(~F.col("s").rlike(profile.unit), "no_letter").when(~F.length("s").between(low, high), "length")
    hit = containment(s.where(out.isNull()).select(F.col("s").alias("doc_id"), F.col("s").alias("text")), held.where(F.length("text") >= low).select("item_id", "text").dropDuplicates(["text"]))
    hit = hit.select(F.col("doc_id").alias("s")).distinct().withColumn("hit", F.lit(True))
    judged = s.join(hit, "s", "left").select("s", "n", F.coalesce(out, F.when(F.col("hit"), "eval_overlap")).alias("reason"))
    each = F.when(F.col("reason").isNotNull(), F.array_repeat("reason", F.col("n").cast("int"))).otherwise(F.concat(F.array(F.lit("kept")), F.array_repeat(F.lit("duplicate"), F.col("n").cast("int") - 1)))
    return judged.select("s", F.explode(each).alias("reason"))


def short_report(judged: DataFrame, held: DataFrame, low: int) -> DataFrame:
    """(text, n): for every held-out sentence under ``low`` characters the kept sentences that hold it; 0 where none does."""
    short = held.where(F.length("text") < low).select("text").distinct()
    found = containment(judged.where("reason = 'kept'").select(F.col("s").alias("doc_id"), F.col("s").alias("text")), short.select(F.col("text").alias("item_id"), "text"))
    return short.join(found.groupBy(F.col("item_id").alias("text")).agg(F.count("*").alias("n")), "text", "left").select("text", F.coalesce("n", F.lit(0)).alias("n"))


def remove(texts: DataFrame, reports: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """texts without the keys that any report names; fails where a report names a key that texts do not have."""
    named = reports[0].select(key)
    for r in reports[1:]:
        named = named.unionByName(r.select(key))
    named = named.distinct()
    if named.join(texts.select(key), key, "left_anti").limit(1).count():
        raise ValueError("a report names rows that are not there")
    return texts.join(named, key, "left_anti")
