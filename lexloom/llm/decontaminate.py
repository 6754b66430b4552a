"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Text is normalised by lower-casing A-Z; words are runs of ``[0-9a-z]`` and of non-ASCII characters.  A window is 13
consecutive words of an item, or all words of a shorter item.  Each document's token windows are hashed in place and
probed against the set of window hashes; only hits leave the row, are verified by their text and mapped to items.
Built-in functions only.

The set is broadcast only up to ``MAX_SET`` windows and ``MAX_SET_BYTES`` of text; beyond either bound the windows of
the documents are joined to those of the benchmark by 64-bit hash in a shuffle, and those that meet are verified by
their text, with the same result.

Edge cases: a null or empty text has no words and no hits; an item without words has no window; a null item_id marks
words but is no item of the list; rows are judged one by one, so repeated rows and repeated or null ids give a row
each; texts of any length are read whole; item_id may be of any type that casts to a string; with an empty benchmark
nothing is hit.  Other columns, whatever their names, are carried by ``remove`` only.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, words

N = 13
#: Contaminated if at least one word in SHARE is hit.
SHARE = 20
MAX_SET = 50_000
MAX_SET_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: str) -> F.Column:
    return words(F.translate(F.col(text), UPPER, LOWER), SEPARATOR)


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(win, len, h, items): every distinct window of the benchmark with the items that hold it."""
    b = benchmark.select(F.col("item_id").alias("item"), normal_words("text").alias("w")).where(F.size("w") > 0)
    b = b.withColumn("len", F.least(F.size("w"), F.lit(n)))
    b = b.select("item", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), i -> slice(w, i, len))")).alias("s"))
    return b.groupBy(F.array_join("s", " ").alias("win"), "len", "s").agg(F.collect_set("item").alias("items"))


def _hash(array: str, at: str, n: int) -> str:
    return "xxhash64(" + ", ".join(f"{array}[{at} + {k}]" for k in range(n)) + ")"


def _found(lengths: dict[int, list[int]]) -> str:
    """SQL array of (p, n, win) for the windows of ``w`` whose hash is in the set of their length."""
    parts = [
        f"transform(CASE WHEN size(w) < {n} THEN array() ELSE filter(sequence(0, size(w) - {n}), i -> {_hash('w', 'i', n)} IN ({','.join(f'{h}L' for h in hs)})) END,"
        f" p -> named_struct('p', p, 'n', {n}, 'win', array_join(slice(w, p + 1, {n}), ' ')))"
        for n, hs in sorted(lengths.items())
    ]
    return f"concat({', '.join(parts)})" if parts else "CAST(array() AS ARRAY<STRUCT<p: INT, n: INT, win: STRING>>)"


def _every(lengths: list[int]) -> str:
    """SQL array of (p, n, h), a hash for every window of ``w`` of these lengths."""
    return "concat(" + ", ".join(
        f"transform(CASE WHEN size(w) < {n} THEN array() ELSE sequence(0, size(w) - {n}) END, p -> named_struct('p', p, 'n', {n}, 'h', {_hash('w', 'p', n)}))" for n in lengths
    ) + ")"


def _beyond(d: DataFrame, wins: DataFrame, lengths: list[int]) -> DataFrame:
    """(rid, doc_id, n_words, f) where the set is too large to broadcast: windows leave the row as 64-bit hashes, and only those that meet one of the set come back."""
    d = stored(d)  # rid must not change between its two uses
    hashes = functools.reduce(DataFrame.unionByName, [wins.where(F.col("len") == k).select(F.lit(k).alias("n"), F.expr(_hash("s", "0", k)).alias("h")) for k in lengths]).distinct()
    met = d.select("rid", F.explode(F.expr(_every(lengths))).alias("x")).select("rid", "x.*").join(hashes, ["n", "h"], "left_semi")
    met = met.groupBy("rid").agg(F.collect_list(F.struct("p", "n")).alias("met"))
    return d.join(met, "rid", "left").select(
        "rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.expr("transform(met, x -> named_struct('p', x.p, 'n', x.n, 'win', array_join(slice(w, x.p + 1, x.n), ' ')))").alias("f")
    )


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, max_set: int = MAX_SET) -> DataFrame:
    """One row a document row: rid, doc_id, n_words, n_hit, hits (array of (p, n)), items (sorted strings)."""
    wins = item_windows(benchmark, n)
    size = wins.agg(F.count("*").alias("c"), F.sum(F.octet_length("win")).alias("b"), F.collect_set("len").alias("lens")).first()
    small = not size["c"] or size["c"] <= max_set and size["b"] <= MAX_SET_BYTES
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", normal_words("text").alias("w"))
    if small:
        lengths: dict[int, list[int]] = {}
        for k in size["lens"]:
            rows = wins.where(F.col("len") == k).select(F.expr(_hash("s", "0", k)).alias("h")).distinct().collect()
            lengths[k] = sorted(r["h"] for r in rows)
        d = d.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.expr(_found(lengths)).alias("f"))
    else:
        d = _beyond(d, wins, sorted(size["lens"]))
    d = d.select("rid", "doc_id", "n_words", F.explode_outer("f").alias("f")).select("rid", "doc_id", "n_words", "f.*")
    known = wins.select("win", "items")
    d = d.join(F.broadcast(known) if small else known, "win", "left")
    g = d.groupBy("rid", "doc_id", "n_words").agg(
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct("p", "n"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("i")
    )
    return g.select(
        "rid", "doc_id", "n_words",
        F.expr("CAST(size(array_distinct(flatten(transform(hits, x -> sequence(x.p, x.p + x.n - 1))))) AS BIGINT)").alias("n_hit"),
        "hits", F.expr("sort_array(transform(i, x -> CAST(x AS STRING)))").alias("items"),
    )


def judge(rows: DataFrame, share: int = SHARE) -> DataFrame:
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM
  (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM x),
y AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)),
h AS (SELECT y.rid, y.n, y.i, x.item_id FROM y JOIN x ON y.win = x.win AND y.n = x.n),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT rid, n, i FROM h)) GROUP BY rid),
q AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN q USING (rid)
"""
