"""Dictionary segmentation as an Arrow UDF over a broadcast lexicon, or over the words of a text where the lexicon is large."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a lexicon that is broadcast, with WORD_BYTES a word for the dictionary that holds it.
LEXICON_BYTES, WORD_BYTES = 16 << 20, 200


def best_path(text: str, scores: dict[str, float], longest: int) -> list[str] | None:
    """Segmentation of the greatest score sum; the first found wins ties, shorter words first; None if the text isn't covered."""
    best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for size in range(1, min(longest, end) + 1):
            before = best[end - size]
            score = scores.get(text[end - size : end])
            if before is not None and score is not None and (best[end] is None or before[0] + score > best[end][0]):
                best[end] = (before[0] + score, size)
    if best[-1] is None:
        return None
    out, at = [], len(text)
    while at:
        out.append(text[at - best[at][1] : at])
        at -= best[at][1]
    return out[::-1]


def _log10_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log10(sum(10 ** (t - top) for t in terms))


def expected(text: str, scores: dict[str, float], longest: int, least: float = 0.0) -> dict[str, float]:
    """Expected count of every word over all segmentations, where it is ``least`` or more; sums run in logarithms, so a text of any length has them."""
    n = len(text)
    arcs = [(a, b, scores[text[a:b]]) for a in range(n) for b in range(a + 1, min(n, a + longest) + 1) if text[a:b] in scores]
    into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    out_of: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for a, b, p in arcs:
        into[b].append((a, p))
        out_of[a].append((b, p))
    ahead: list[float | None] = [0.0] + [None] * n
    back: list[float | None] = [None] * n + [0.0]
    for k in range(1, n + 1):
        if terms := [ahead[a] + p for a, p in into[k] if ahead[a] is not None]:
            ahead[k] = _log10_sum(terms)
    for k in range(n - 1, -1, -1):
        if terms := [back[b] + p for b, p in out_of[k] if back[b] is not None]:
            back[k] = _log10_sum(terms)
    total: dict[str, float] = {}
    for a, b, p in arcs if ahead[n] is not None else ():
        if ahead[a] is not None and back[b] is not None:
            total[text[a:b]] = total.get(text[a:b], 0.0) + 10 ** (ahead[a] + p + back[b] - ahead[n])
    return {w: e for w, e in total.items() if e >= least}


def expected_counts(texts: DataFrame, lexicon: DataFrame, least: float = 0.01, lexicon_bytes: int = LEXICON_BYTES) -> DataFrame:
    """(w, e): expected counts of words over all texts (column letters), of each text those of ``least`` or more.

    lexicon has w and c.  Fails for a lexicon of more than lexicon_bytes, which is not to be broadcast.
    """
    n = lexicon.agg(F.coalesce(F.sum(F.octet_length("w") + WORD_BYTES), F.lit(0)).alias("bytes"), F.coalesce(F.sum("c"), F.lit(1)).alias("total")).first()
    if n["bytes"] > lexicon_bytes:
        raise ValueError(f"a lexicon of {n['bytes']} bytes is not broadcast")
    scores = {r["w"]: math.log10(r["c"] / n["total"]) for r in lexicon.select("w", "c").toLocalIterator()}
    shared = texts.sparkSession.sparkContext.broadcast((scores, max(map(len, scores), default=0)))

    @F.pandas_udf("array<struct<w: string, e: double>>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else [{"w": w, "e": e} for w, e in expected(t, *shared.value, least).items()])

    return texts.select(F.inline(run("letters"))).groupBy("w").agg(F.sum("e").alias("e"))


def segmenter(spark: SparkSession, scores: dict[str, float]):
    """Column function text -> words, null where the lexicon doesn't cover the text."""
    shared = spark.sparkContext.broadcast((scores, max(map(len, scores), default=0)))

    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: best_path(t, *shared.value) if t is not None else None)

    return lambda text: run(F.col(text) if isinstance(text, str) else text) if not isinstance(text, Column) else run(text)


def segmented(texts: DataFrame, lexicon: DataFrame, lexicon_bytes: int = LEXICON_BYTES) -> DataFrame:
    """texts with words, the best segmentation of the column letters by the words w of count c; null where they don't cover it.

    A lexicon of more than lexicon_bytes is joined to the distinct substrings of each text that are as long as a word.
    """
    n = lexicon.agg(
        F.coalesce(F.sum(F.octet_length("w") + WORD_BYTES), F.lit(0)).alias("bytes"), F.coalesce(F.sum("c"), F.lit(1)).alias("total"), F.sort_array(F.collect_set(F.length("w"))).alias("sizes")
    ).first()
    score = lambda c: math.log10(c / n["total"])
    if n["bytes"] <= lexicon_bytes:
        return texts.withColumn("words", segmenter(texts.sparkSession, {r["w"]: score(r["c"]) for r in lexicon.select("w", "c").collect()})("letters"))
    sizes = list(n["sizes"])

    @F.pandas_udf("array<string>")
    def candidates(text: pd.Series) -> pd.Series:
        return text.map(lambda t: list({t[k : k + size] for size in sizes for k in range(len(t) - size + 1)}))

    @F.pandas_udf("array<string>")
    def run(text: pd.Series, words: pd.Series, counts: pd.Series) -> pd.Series:
        scores = [{w: score(c) for w, c in zip(ws, cs, strict=True)} for ws, cs in zip(words, counts, strict=True)]
        return pd.Series([best_path(t, s, max(map(len, s), default=0)) for t, s in zip(text, scores, strict=True)])

    letters = texts.select("letters").where("letters IS NOT NULL").distinct()
    found = letters.select("letters", F.explode(candidates("letters")).alias("w")).join(lexicon.select("w", "c"), "w").groupBy("letters").agg(F.collect_list(F.struct("w", "c")).alias("x"))
    none = F.array().cast("array<struct<w:string,c:bigint>>")
    best = letters.join(found, "letters", "left").withColumn("x", F.coalesce("x", none)).select("letters", run("letters", F.col("x.w"), F.col("x.c")).alias("words"))
    return texts.join(best, "letters", "left")
