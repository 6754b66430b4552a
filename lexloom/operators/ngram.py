"""n-gram counts and smoothed probabilities as joins and aggregates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lexloom.functions.text import LATIN, TextProfile, sentences, units
from lexloom.operators.store import kept

START, END = "<s>", "</s>"
DISCOUNT = 0.75
FLOOR = 0.5
#: Heads of n-grams that are broadcast at most.
HEADS = 200_000
#: Hashes of heads that are broadcast at most.
HASHES = 2_000_000
#: Distinct words that a worker counts before it hands them on.
WORDS = 500_000
#: The letters of LATIN one by one, which Java looks up in a table.
LETTERS = "".join(c for c in map(chr, range(256)) if re.fullmatch(LATIN.unit, c))
#: Characters outside of LATIN whose lower case is in it.
ODD = "\u0130\u0178\u1e9e\u212a\u212b"


def padded(docs: DataFrame, profile: TextProfile = LATIN, least: int = 1) -> DataFrame:
    """(doc_id, sid, u): units of every sentence of ``least`` units or more between the pads."""
    s = docs.select("doc_id", F.posexplode(sentences(F.col("text"), profile)).alias("sid", "s")).select("doc_id", "sid", units(F.col("s"), profile).alias("w"))
    return s.where(F.size("w") >= least).select("doc_id", "sid", F.concat(F.array(F.lit(START)), "w", F.array(F.lit(END))).alias("u"))


def windows(docs: DataFrame, n: int) -> DataFrame:
    """Every occurrence of a pair or triple (n) of ``padded`` for Latin texts, g1..gn, by one regular expression over a text.

    It matches units and ends of sentences; an end is less than "A" and stands for either pad.
    """
    pad, end, names = F.array(F.lit(".")), lambda x: F.col(x) < "A", [f"g{k + 1}" for k in range(n)]
    t = docs.select(F.concat(pad, F.regexp_extract_all("text", F.lit(f"[{LETTERS}]+|{LATIN.end}"), F.lit(0)), pad).alias("t"))
    g = t.select(F.explode(F.arrays_zip(*[F.slice("t", k + 1, F.size("t")) for k in range(n)])).alias("g")).select(*[F.col("g").getField(str(k)).alias(x) for k, x in enumerate(names)])
    g = g.where(F.col(names[-1]).isNotNull() & ~(end("g2") if n == 3 else end("g1") & end("g2")))
    return g.select(*[F.lower(x).alias(x) if x not in (names[0], names[-1]) else F.when(end(x), START if x == "g1" else END).otherwise(F.lower(x)).alias(x) for x in names])


def words(docs: DataFrame) -> DataFrame:
    """(w, n): occurrences of the units of ``padded`` for Latin texts; the pad at the end is one."""
    unit, sentence = re.compile(LATIN.unit), re.compile(f"{LATIN.unit}{LATIN.end.replace('[', '[^').replace('+', '*')}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()
        for b in batches:
            for x in b.column(0):
                if (t := x.as_py()) is not None:
                    c[END] += len(sentence.findall(t))
                    for odd in ODD:
                        t = t.replace(odd, " ")
                    c.update(unit.findall(t.lower()))
                    if len(c) > WORDS:
                        yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["w", "n"])
                        c.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["w", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 0")


def small(df: DataFrame, most: int = HEADS) -> DataFrame:
    """df to be broadcast, if it has ``most`` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def grams(pads: DataFrame, n: int, heads: DataFrame | None = None) -> DataFrame:
    """Counts of n-grams, columns g1..gn and c; only of those that begin with a row of heads (g1, ...), if given."""
    take = lambda i: F.struct(*[F.get("u", i + k).alias(f"g{k + 1}") for k in range(n)])
    g = pads.where(F.size("u") >= n).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("u") - n), take)).alias("g"))
    g = g.select("g.*")
    if heads is not None:
        g = g.join(small(heads), heads.columns, "left_semi")
    return g.groupBy(*[f"g{k + 1}" for k in range(n)]).agg(F.count("*").alias("c"))


def bigrams(pads: DataFrame) -> DataFrame:
    return grams(pads, 2).select(F.col("g1").alias("v"), F.col("g2").alias("w"), "c")


def weighted(*corpora: tuple[DataFrame, float]) -> DataFrame:
    """Weighted sum of count tables, rounded half to even after summing, zeros dropped."""
    every = None
    for d, x in corpora:
        d = d.withColumn("c", F.col("c") * float(x))
        every = d if every is None else every.unionByName(d)
    keys = [c for c in every.columns if c != "c"]
    return every.groupBy(*keys).agg(F.bround(F.sum("c")).cast("long").alias("c")).where("c > 0")


def counts(docs: DataFrame, profile: TextProfile = LATIN) -> tuple[DataFrame, DataFrame]:
    """Bigrams (v, w, c) and trigrams (u, v, w, c) from one pass over the texts; the trigrams are kept, for the bigrams are their sums.

    Every sentence begins with a trigram of the start pad, so its first bigram is that trigram's head.
    """
    tri = kept(grams(padded(docs, profile), 3).select(F.col("g1").alias("u"), F.col("g2").alias("v"), F.col("g3").alias("w"), "c"))
    head = tri.where(F.col("u") == START).select(F.col("u").alias("v"), F.col("v").alias("w"), "c")
    return tri.select("v", "w", "c").unionByName(head).groupBy("v", "w").agg(F.sum("c").alias("c")), tri


def _discounted(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """Kept rows with total, the sum of their context before pruning, and back; sums of a context are partial, so a frequent one is no task's own."""
    sums = rows.groupBy(*by).agg(F.sum("c").alias("total"), F.sum(F.when(F.col("c") >= least, F.col("c") - DISCOUNT)).alias("held"))
    sums = sums.where("held IS NOT NULL").select(*by, "total", (1 - F.col("held") / F.col("total")).alias("back"))
    return rows.where(F.col("c") >= least).join(sums, by)


def held(rows: DataFrame, by: list[str], totals: DataFrame) -> DataFrame:
    """(by, total, back) of the contexts of kept rows, like ``_discounted`` where the totals (by, total) before pruning are known."""
    sums = rows.groupBy(*by).agg(F.sum(F.col("c") - DISCOUNT).alias("held")).join(totals, by)
    return sums.select(*by, "total", (1 - F.col("held") / F.col("total")).alias("back"))


def followers(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """Counts (u, v, w, c) of the triples that begin with a row of heads (u, v), none missing; heads are met by hash, others with the hash of one may come too."""
    g, h = windows(docs, 3), heads.select(F.xxhash64("u", "v").alias("h")).distinct()
    g = g.withColumn("h", F.xxhash64("g1", "g2")).join(small(h, HASHES), "h", "left_semi")
    return g.groupBy(F.col("g1").alias("u"), F.col("g2").alias("v"), F.col("g3").alias("w")).agg(F.count("*").alias("c"))


def pruned(bi: DataFrame, least: int = 2) -> DataFrame:
    """Kept bigrams with the total of their context before pruning and its back-off weight 1 - sum(c - D) / total."""
    return _discounted(bi, ["v"], least)


def unigram(bi: DataFrame) -> DataFrame:
    """(w, pb): share of each unit, pads at the start left out."""
    u = bi.groupBy("w").agg(F.sum("c").alias("n"))
    return u.withColumn("pb", F.col("n") / u.agg(F.sum("n").alias("all")).select("all").scalar()).select("w", "pb")


def prob(model: DataFrame, uni: DataFrame) -> DataFrame:
    """P(w | v) = (c - D) / total + back * pb for kept pairs."""
    return model.join(uni, "w").withColumn("p", (F.col("c") - DISCOUNT) / F.col("total") + F.col("back") * F.col("pb"))


def lookup(probes: DataFrame, model: DataFrame, uni: DataFrame) -> DataFrame:
    """P(w | v) of any pairs (v, w): kept pairs, back-off in a known context, the unigram in an unknown one."""
    ctx = model.select("v", "back", "total").distinct()
    j = probes.join(uni, "w", "left").join(ctx, "v", "left").join(model.select("v", "w", "c"), ["v", "w"], "left")
    pb = F.coalesce("pb", F.lit(0.0))
    p = F.when(F.col("total").isNull(), pb).otherwise(F.coalesce((F.col("c") - DISCOUNT) / F.col("total"), F.lit(0.0)) + F.col("back") * pb)
    return j.select(*probes.columns, p.alias("p"))


def top_successors(model: DataFrame, k: int = 3) -> DataFrame:
    order = W.partitionBy("v").orderBy(F.desc("p"), F.length("w"), "w")
    return model.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def continuation(bi: DataFrame, least: int = 2, vocabulary: DataFrame | None = None) -> DataFrame:
    """(w, n): distinct predecessors with c >= least, the start pad left out; of a vocabulary (w) if one is given."""
    kept_ = bi.where((F.col("c") >= least) & (F.col("v") != START))
    if vocabulary is not None:
        kept_ = kept_.join(vocabulary.select(F.col("w").alias("v")), "v", "left_semi")
    return kept_.groupBy("w").agg(F.count("*").alias("n"))


def trigram_prob(tri: DataFrame, bi_prob: DataFrame) -> DataFrame:
    """Interpolated P(w | u, v), never under FLOOR * P(w | v); tri has u, v, w, c."""
    t = _discounted(tri, ["u", "v"], 2).join(bi_prob.select("v", "w", F.col("p").alias("p2")), ["v", "w"])
    return t.withColumn("p", F.greatest((F.col("c") - DISCOUNT) / F.col("total") + F.col("back") * F.col("p2"), FLOOR * F.col("p2")))


def without(tri: DataFrame, words: DataFrame) -> DataFrame:
    """Trigrams whose three words are all among words (w); contexts left empty go with their last trigram."""
    for c in ("u", "v", "w"):
        tri = tri.join(words.select(F.col("w").alias(c)), c, "left_semi")
    return tri.select("u", "v", "w", "c")
