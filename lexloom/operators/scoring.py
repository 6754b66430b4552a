"""Scoring terms of a language model as joins: word and end terms, class back-off, chains, counts beside digits and foreign words.

Probabilities are double columns; scores are log10.  Frames of probes keep their own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import log10
from lexloom.operators.ngram import DISCOUNT, END, START

#: Share of the model in a word's score, by profile.
LAMBDA = {"chat": 0.5, "formal": 0.7}
KN_BETA = 0.75
CLASS_SHARE, CLASS_EPS = 0.3, 0.1
UNSEEN_PENALTY, CAP_GAP = 1.0, 0.01
DIGIT_BETA, DIGIT_GAMMA, LONG_RUN = 1.0, 1.0, 10
FOREIGN_BETA, TRI_ADD, TRI_KINDS, UNSEEN_MIN, UNSEEN_MAX = 1.0, 0.5, 27, 5, 16
NEW_LOW, NEW_HIGH = -3.0, -1.0


def continuation_share(np1: DataFrame, beta: float = KN_BETA) -> DataFrame:
    """(w, n, share): beta * (N + 1) / sum of (N + 1); np1 has a row a word, w and n, the number of its contexts."""
    total = np1.agg(F.sum(F.col("n") + 1).alias("total"))
    return np1.crossJoin(F.broadcast(total)).select("w", "n", (beta * (F.col("n") + 1) / F.col("total")).alias("share"))


def back_off(words: DataFrame, shares: DataFrame, beta: float = KN_BETA) -> DataFrame:
    """words (w, lp) with pb, the single-word term: 10 ** lp, mixed with the continuation share where the word has one."""
    plain = F.pow(F.lit(10.0), F.col("lp"))
    return words.join(shares.select("w", "share"), "w", "left").withColumn("pb", F.when(F.col("share").isNull(), plain).otherwise(F.col("share") + (1 - beta) * plain)).drop("share")


def class_matrix(bi: DataFrame, classes: DataFrame, eps: float = CLASS_EPS) -> tuple[DataFrame, DataFrame, int]:
    """Counts of neighbouring classes (cv, cw, m), their rows (cv, row), and the number of classes; classes has w and k."""
    a, b = classes.select(F.col("w").alias("v"), F.col("k").alias("cv")), classes.select("w", F.col("k").alias("cw"))
    m = bi.join(a, "v").join(b, "w").groupBy("cv", "cw").agg(F.sum("c").alias("m"))
    return m, m.groupBy("cv").agg(F.sum("m").alias("row")), classes.agg(F.count_distinct("k")).first()[0]


def emission(uni: DataFrame, classes: DataFrame) -> DataFrame:
    """(w, k, emit): the share of a word in its class; uni has w and n."""
    j = classes.join(uni, "w", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = j.groupBy("k").agg(F.sum("n").alias("all"))
    return j.join(F.broadcast(total), "k").select("w", "k", F.when(F.col("all") > 0, F.col("n") / F.col("all")).otherwise(0.0).alias("emit"))


def pair_prob(probes: DataFrame, model: DataFrame, classes: tuple[DataFrame, DataFrame, DataFrame, int] | None = None, share: float = CLASS_SHARE, eps: float = CLASS_EPS) -> DataFrame:
    """probes (v, w, pb) with p = P(w | v): kept pairs by their count, others by the back-off, mixed with the classes where both words have one.

    model has v, w, c, total and back (kept pairs); classes are (emission, matrix, rows, number of classes).
    """
    j = probes.join(model.select("v", "back", "total").distinct(), "v", "left").join(model.select("v", "w", "c"), ["v", "w"], "left")
    back, low = F.coalesce("back", F.lit(1.0)), F.col("pb")
    if classes is not None:
        emit, m, rows, k = classes
        j = j.join(emit.select(F.col("w").alias("v"), F.col("k").alias("cv")), "v", "left").join(emit.select("w", F.col("k").alias("cw"), "emit"), "w", "left")
        j = j.join(F.broadcast(m), ["cv", "cw"], "left").join(F.broadcast(rows), "cv", "left")
        by_class = (F.coalesce("m", F.lit(0)) + eps) / (F.coalesce("row", F.lit(0)) + k * eps)
        low = F.when(F.col("cv").isNotNull() & F.col("cw").isNotNull(), (1 - share) * low + share * by_class * F.col("emit")).otherwise(low)
    p = F.when(F.col("c").isNotNull(), (F.col("c") - DISCOUNT) / F.col("total") + back * F.col("pb")).otherwise(back * low)
    return j.select(*probes.columns, p.alias("p"))


def word_term(p: Column, lp: Column, profile: str) -> Column:
    return LAMBDA[profile] * log10(p) + (1 - LAMBDA[profile]) * lp


def end_term(p: Column, profile: str) -> Column:
    return LAMBDA[profile] * log10(p)


def chains(sentences: DataFrame, key: list[str], model: DataFrame, uni: DataFrame, first_alone: bool = False) -> DataFrame:
    """(key, lc): log10 of each word after the one before it, and of the end; sentences have the array u of words.

    An unseen word counts (c + 1) / (N + V + 1); the end backs off to its own share.  With first_alone the first word
    stands for itself where no sentence of the model begins with it.
    """
    size = uni.where(F.col("w") != END).agg((F.sum("n") + F.count("*") + 1).cast("double").alias("n1"))
    pads = sentences.select(*key, F.concat(F.array(F.lit(START)), "u", F.array(F.lit(END))).alias("u"))
    pairs = pads.select(*key, F.explode(F.transform(F.sequence(F.lit(0), F.size("u") - 2), lambda i: F.struct(i.alias("i"), F.get("u", i).alias("v"), F.get("u", i + 1).alias("w")))).alias("x")).select(*key, "x.*")
    ends = uni.agg((F.sum(F.when(F.col("w") == END, F.col("n")).otherwise(0)) / F.sum("n")).alias("p_end"))
    j = pairs.join(uni.select("w", "n"), "w", "left").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(ends))
    j = j.withColumn("pb", F.when(F.col("w") == END, F.col("p_end")).otherwise((F.coalesce("n", F.lit(0)) + 1) / F.col("n1")))
    p = pair_prob(j.select(*key, "i", "v", "w", "pb"), model)
    if first_alone:
        begun = model.where(F.col("v") == START).select("w", F.lit(True).alias("begun"))
        p = p.join(begun, "w", "left").withColumn("p", F.when((F.col("i") == 0) & F.col("begun").isNull() & (F.col("w") != END), F.col("pb")).otherwise(F.col("p")))
    return p.groupBy(*key).agg(F.sum(log10(F.col("p"))).alias("lc"))


def layer_words(sentences: DataFrame, key: list[str], layer: DataFrame, base: DataFrame) -> DataFrame:
    """(key, k): words of each sentence that only the upper layer has, repeats counted; layer and base have w."""
    only = layer.select("w").distinct().join(base.select("w"), "w", "left_anti").withColumn("hit", F.lit(1))
    return sentences.select(*key, F.explode_outer("u").alias("w")).join(only, "w", "left").groupBy(*key).agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("k"))


def capped(rows: DataFrame, counts: DataFrame, total: int | Column) -> DataFrame:
    """rows (w, lp, layered) with score: a layer's word at most log10 of its share in the corpus, and less by a penalty if unseen there; others as they are."""
    j = rows.join(counts.select("w", "n"), "w", "left")
    seen = F.least(F.col("lp"), log10(F.col("n") / total))
    return j.withColumn("score", F.when(~F.col("layered"), F.col("lp")).when(F.coalesce("n", F.lit(0)) > 0, seen).otherwise(F.col("lp") - UNSEEN_PENALTY)).drop("n")


def demotion(probes: DataFrame, table: DataFrame, anywhere: str = "*") -> DataFrame:
    """probes (reading, word) with delta: of the word under its reading, else of the word under any, else 0; table has reading, word and delta."""
    one = probes.join(table.select("reading", "word", F.col("delta").alias("own")), ["reading", "word"], "left")
    every = table.where(F.col("reading") == anywhere).select("word", F.col("delta").alias("every"))
    return one.join(every, "word", "left").select(*probes.columns, F.coalesce("own", "every", F.lit(0.0)).alias("delta"))


def reading_term(t: Column, weight: float = 2.0, cap: float = 4.0) -> Column:
    return weight * F.greatest(t, F.lit(-cap))


def new_word_score(weight: Column) -> Column:
    """Score of a learned word, from the low to the high end as its weight grows."""
    return NEW_LOW + (NEW_HIGH - NEW_LOW) * (weight / (weight + 1))


def digit_counts(lines: DataFrame, word: str = "[A-Za-zÀ-ÖØ-öø-ÿ]+") -> DataFrame:
    """(kind, a, b, c): all counts beside digit runs in one pass over the items of a line (column text).

    Items are digit runs and words; any other mark between them is a border.  T: items; N: runs; S: runs that no word
    follows; C: items of a context; D: runs of a context; W: words after a run; Q: contexts of such runs; P: both; L: runs
    of a length (10 stands for more); X: characters of runs.  The context is the word before, or the start pad.
    """
    items = F.regexp_extract_all(F.lower("text"), F.lit(rf"[0-9]+|{word}|[^\s]"), F.lit(0))
    at = lines.where("text IS NOT NULL").select(items.alias("x")).where(F.size("x") > 0)
    is_word, is_run = (lambda x: x.rlike(f"^{word}$")), (lambda x: x.rlike("^[0-9]+$"))
    of = lambda x: F.when(is_word(x), x)
    rows = at.select(F.explode(F.transform("x", lambda x, i: F.struct(x.alias("x"), F.coalesce(of(F.get(F.col("x"), i - 1)), F.lit(START)).alias("v"), of(F.get(F.col("x"), i + 1)).alias("w")))).alias("r")).select("r.*")
    rows = rows.where(is_word(F.col("x")) | is_run(F.col("x")))
    row = lambda kind, a=F.lit(""), b=F.lit(""): F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    x, v, w = F.col("x"), F.col("v"), F.col("w")
    every = F.array(row("T"), row("C", v))
    runs = F.concat(
        F.array(row("N"), row("D", v), row("L", F.least(F.length(x), F.lit(LONG_RUN)).cast("string"))), F.transform(F.split(x, ""), lambda c: row("X", c)),
        F.when(w.isNull(), F.array(row("S"))).otherwise(F.array(row("W", w), row("Q", v), row("P", v, w))),
    )
    told = F.when(is_run(x), F.concat(every, runs)).otherwise(every)
    return rows.select(F.explode(told).alias("k")).select("k.*").groupBy("kind", "a", "b").agg(F.count("*").alias("c"))


def after_digits(probes: DataFrame, counts: DataFrame) -> DataFrame:
    """probes (v, w, pw) with p = P(w | v, digits): counts after runs of the context, over counts after any run, over pw."""
    n = counts.where("kind = 'N'").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    after = counts.where("kind = 'W'").select(F.col("a").alias("w"), F.col("c").alias("cw"))
    context = counts.where("kind = 'Q'").select(F.col("a").alias("v"), F.col("c").alias("cq"))
    both = counts.where("kind = 'P'").select(F.col("a").alias("v"), F.col("b").alias("w"), F.col("c").alias("cp"))
    j = probes.join(after, "w", "left").join(context, "v", "left").join(both, ["v", "w"], "left").crossJoin(F.broadcast(n))
    base = (F.coalesce("cw", F.lit(0)) + DIGIT_GAMMA * F.col("pw")) / (F.col("n") + DIGIT_GAMMA)
    p = F.when(F.col("cq").isNull(), base).otherwise((F.coalesce("cp", F.lit(0)) + DIGIT_GAMMA * base) / (F.col("cq") + DIGIT_GAMMA))
    return j.select(*probes.columns, p.alias("p"))


def digits_given(counts: DataFrame, beta: float = DIGIT_BETA) -> DataFrame:
    """(v, p): probability of a digit run in a context, drawn to its overall share."""
    total = counts.agg((F.sum(F.when(F.col("kind") == "N", F.col("c")).otherwise(0)) / F.sum(F.when(F.col("kind") == "T", F.col("c")))).alias("pd"))
    c = counts.where("kind = 'C'").select(F.col("a").alias("v"), F.col("c").alias("n"))
    d = counts.where("kind = 'D'").select(F.col("a").alias("v"), F.col("c").alias("d"))
    return c.join(d, "v").crossJoin(F.broadcast(total)).select("v", ((F.col("d") + beta * F.col("pd")) / (F.col("n") + beta)).alias("p"))


def run_lengths(counts: DataFrame) -> DataFrame:
    """(m, ended, going): share of runs of m digits, and of m or more; the last length stands for longer ones in both."""
    known = counts.where("kind = 'L'").agg(F.map_from_entries(F.collect_list(F.struct(F.col("a").cast("int"), "c"))).alias("l"), F.sum("c").alias("all"))
    of = lambda m: F.coalesce(F.element_at("l", m), F.lit(0))
    rows = known.select("l", "all", F.explode(F.sequence(F.lit(1), F.lit(LONG_RUN))).alias("m"))
    more = F.aggregate(F.sequence("m", F.lit(LONG_RUN)), F.lit(0).cast("long"), lambda s, k: s + of(k))
    return rows.select("m", (of(F.col("m")) / F.col("all")).alias("ended"), (more / F.col("all")).alias("going"))


def foreign_table(tokens: DataFrame, least_docs: int = 3, least: int = 1) -> dict[str, DataFrame]:
    """Count tables of foreign words (doc_id, w, weight): words kept (w, n), the mass of known words left out, and the shapes of all known words.

    A word is known if it stands in least_docs documents; kept if its weighted count is least or more.  Shapes are the
    letter trigrams of ^^word$ (g, c) and the lengths of unseen-sized words (m, c), each word once.
    """
    n = tokens.groupBy("w", "doc_id").agg(F.sum("weight").alias("n")).groupBy("w").agg(F.sum("n").alias("n"), F.count("*").alias("df")).where(F.col("df") >= least_docs)
    letters = n.where("w RLIKE '^[a-z]+$'")
    e = letters.select(F.concat(F.lit("^^"), "w", F.lit("$")).alias("e"))
    g = e.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("e") - 2), lambda i: F.substr("e", i, F.lit(3)))).alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    sizes = letters.where(F.length("w").between(UNSEEN_MIN, UNSEEN_MAX)).groupBy(F.length("w").alias("m")).agg(F.count("*").alias("c"))
    mass = n.agg(F.coalesce(F.sum(F.when(F.col("n") >= least, F.col("n"))), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.when(F.col("n") < least, F.col("n"))), F.lit(0)).alias("left"))
    return {"words": n.where(F.col("n") >= least).select("w", "n"), "mass": mass, "grams": g, "sizes": sizes}


def foreign_words(probes: DataFrame, table: dict[str, DataFrame]) -> DataFrame:
    """probes (w, distinct) with lp = log10 P(w): by its count; an unseen word of letters by the mass left out and its letters; else minus infinity."""
    den = F.col("kept") + F.col("left")
    j = probes.join(table["words"], "w", "left").crossJoin(F.broadcast(table["mass"]))
    new = j.where("n IS NULL").select("w", F.concat(F.lit("^^"), "w", F.lit("$")).alias("e"), F.length("w").alias("m")).where(F.col("w").rlike("^[a-z]+$") & F.col("m").between(UNSEEN_MIN, UNSEEN_MAX))
    g3 = table["grams"].select("g", F.col("c").alias("c3"))
    g2 = table["grams"].groupBy(F.substring("g", 1, 2).alias("h")).agg(F.sum("c").alias("c2"))
    each = new.select("w", "m", F.explode(F.transform(F.sequence(F.lit(1), F.length("e") - 2), lambda i: F.substr("e", i, F.lit(3)))).alias("g")).withColumn("h", F.substring("g", 1, 2))
    each = each.join(g3, "g", "left").join(g2, "h", "left")
    shape = each.groupBy("w", "m").agg(F.sum(F.log10((F.coalesce("c3", F.lit(0)) + TRI_ADD) / (F.coalesce("c2", F.lit(0)) + TRI_ADD * TRI_KINDS))).alias("lp"))
    every = table["sizes"].agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"))
    shape = shape.join(table["sizes"], "m", "left").crossJoin(F.broadcast(every))
    shape = shape.select("w", (F.col("lp") + F.log10((F.coalesce("c", F.lit(0)) + 1) / (F.col("all") + (UNSEEN_MAX - UNSEEN_MIN + 1)))).alias("shape"))
    lp = F.when(F.col("n").isNotNull(), F.log10(F.col("n") / den)).when(F.col("shape").isNotNull() & (F.col("left") > 0), F.log10(F.col("left") / den) + F.col("shape")).otherwise(F.lit(float("-inf")))
    return j.join(shape, "w", "left").select(*probes.columns, lp.alias("lp"))


def followers(probes: DataFrame, heads: DataFrame, pairs: DataFrame, gamma: float = 1.0) -> DataFrame:
    """probes (e, w, pw) with p = P(w | e), drawn to pw; heads has e and n, pairs has e, w and c."""
    j = probes.join(heads.select("e", "n"), "e", "left").join(pairs.select("e", "w", "c"), ["e", "w"], "left")
    return j.select(*probes.columns, ((F.coalesce("c", F.lit(0)) + gamma * F.col("pw")) / (F.coalesce("n", F.lit(0)) + gamma)).alias("p"))


def foreign_given(contexts: DataFrame, beta: float = FOREIGN_BETA) -> DataFrame:
    """(v, p): probability of a foreign word in a context, drawn to its overall share; contexts have v, e (foreign) and n (all)."""
    total = contexts.agg((F.sum("e") / F.sum("n")).alias("pe"))
    return contexts.crossJoin(F.broadcast(total)).select("v", ((F.col("e") + beta * F.col("pe")) / (F.col("n") + beta)).alias("p"))


def key_score(total: Column, term: Column, replaced: Column, same: Column, turned: Column, costs: tuple[float, float, float]) -> Column:
    """Score of a typed reading: its words' sum and reading term, less a cost for each key replaced, replaced by itself, or out of order."""
    return total + term - costs[0] * replaced - costs[1] * same - costs[2] * turned


def takes_foreign(foreign: Column, native: Column, theta: float) -> Column:
    return foreign > native + theta
