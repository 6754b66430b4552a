"""Queries over the pack operators, and their SQL.  A part's type is a reading, its name a word, its brand a source, its size a place or count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import ngram, packs
from lexloom.operators.store import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("reading"), F.col("p_name").alias("word"), F.col("p_size").alias("size"), "p_brand", F.col("p_retailprice").alias("price"))


def _named(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    rank = packs.named_rank(p.where("size <= 10").withColumn("at", F.col("p_partkey")))
    return rank, packs.first_named(rank, p.where("size >= 5"))


def homophone_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the words of each reading: named ones (sizes up to 10), shipped ones (size over 25), number of brands, spelling."""
    p = _parts(spark, sf_dir)
    words = p.groupBy("reading", "word").agg((F.max("size") > 25).alias("shipped"), F.count_distinct("p_brand").alias("sources"))
    return packs.ordered(words, packs.named_rank(p.where("size <= 10").withColumn("at", F.col("p_partkey"))))


def first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_parts(spark, sf_dir))[1]


def forced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a pack forces, and the capped scores of those it names first and keeps; a word's count is the number of its parts."""
    p = _parts(spark, sf_dir)
    _, first = _named(p)
    counts, total = p.groupBy("word").agg(F.count("*").alias("n")), 100
    rows = p.where("size >= 5").select("reading", "word").distinct()
    out = packs.forced(rows.withColumn("floor", F.lit(-1.0)), first, p.where("size = 50").select("reading").distinct(), counts, total)
    caps = packs.kept_caps(rows.withColumn("score", F.lit(-1.5)), first, out, counts, total)
    return out.select(F.lit("").alias("reading"), "word", F.lit(None).cast("double").alias("score")).unionByName(caps.select("reading", "word", F.round("score", 8).alias("score")))


def open_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collisions (each part's word against the reading's dearest) that are not decided and whose winner is not shipped."""
    p = _parts(spark, sf_dir)
    rank, first = _named(p)
    win = p.groupBy("reading").agg(F.max_by("word", F.struct("price", "p_partkey")).alias("now"))
    found = p.select("reading", "word").distinct().join(win, "reading").where("word <> now")
    least = p.agg(F.min("p_brand")).first()[0]
    return packs.undecided(found, rank, first, p.where((F.col("size") > 40) & (F.col("p_brand") == least)).select("word")).groupBy("reading").agg(F.count("*").alias("n"))


def frozen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the benchmark's words in the documents, with the size and the hash of the model."""
    uni = kept(ngram.grams(ngram.padded(table(spark, sf_dir, "documents")), 1).select(F.col("g1").alias("word"), F.col("c").alias("n")))
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.units(F.col("text"))).alias("word"))
    r = uni.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    return packs.frozen(words, uni, r["n"] or 0, f"words-{r['words']}")


def pack_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 20 parts by a hash, and of 15 words, one a brand."""
    p = _parts(spark, sf_dir)
    a = packs.sampled(p.select("p_partkey"), ["p_partkey"], 20, "check").select(F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("x"))
    return a.unionByName(packs.one_each(p.select("p_brand", "word"), "p_brand", ["word"], 15, "cut").select(F.lit("word").alias("kind"), F.col("word").alias("x")))


def reading_exemptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of several readings whose reading in size 1, where it is the only one there, is not the dearest; by whether it is at the floor (the least price)."""
    p = _parts(spark, sf_dir)
    small = p.where("size = 1").groupBy("word").agg(F.count_distinct("reading").alias("n"), F.min("reading").alias("reading")).where("n = 1").select("reading", "word")
    floor = p.agg(F.min("price")).first()[0] or 0.0
    above, at = packs.exempt(p.select("reading", "word", F.col("price").alias("score")), small, floor)
    return above.withColumn("rule", F.lit("above")).unionByName(at.withColumn("rule", F.lit("floor")))


def redirect_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return packs.rolled(n.select(F.col("r_name").alias("target"), F.col("n_name").alias("source"))).select("target", F.array_join("sources", "|").alias("sources"))


def beam_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's dearest line is among its first lines, near (2) and wide (4); orders with a line of quantity 50 count as unknown."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("x"), F.max(F.struct("l_extendedprice", "l_partkey"))["l_partkey"].alias("gold"), F.bool_or(F.col("l_quantity") == 50).alias("oov")
    )
    return packs.beam_metrics(x.select(F.col("x.l_partkey").alias("answers"), "gold", "oov"), 4, 2)


def reading_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language tags of documents against the tag of their source's most frequent one."""
    d = table(spark, sf_dir, "documents").select("source", "lang")
    most = d.where("lang IS NOT NULL").groupBy("source", "lang").count().groupBy("source").agg(F.max_by("lang", F.struct("count", "lang")).alias("derived"))
    return packs.disagreement(d.join(F.broadcast(most), "source", "left").select(F.col("lang").alias("reading"), "derived"))


def tiered_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five predictions after every word of the benchmark: successors first, then frequent words."""
    bi = kept(ngram.bigrams(ngram.padded(table(spark, sf_dir, "documents"))))
    words = bi.where(F.col("w") != ngram.END)
    uni = ngram.unigram(words)
    p = ngram.prob(ngram.pruned(words), uni).withColumn("p", F.round("p", 8))
    v = table(spark, sf_dir, "benchmark").select(F.explode(T.units(F.col("text"))).alias("v"))
    return packs.predictions(p, uni.withColumn("pb", F.round("pb", 8)), v, 5)


def scan_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand read by price until 8 names of sizes over 20 have come."""
    p = _parts(spark, sf_dir).select("p_brand", "p_partkey", "price", "word", (F.col("size") <= 20).alias("successor"))
    return packs.scan_depth(p, ["p_brand"], [F.desc("price"), "p_partkey"], 8)


def differing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of characters in which the names of nations of one length differ from the nation's before, counted."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    j = n.join(n.select((F.col("k") + 1).alias("k"), F.col("a").alias("b")), "k")
    return j.select(F.explode(packs.differing(F.col("a"), F.col("b"))).alias("p")).groupBy("p.want", "p.got").agg(F.count("*").alias("n"))


def accepted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a nation's name starts like its region's, in lower case, or like another region's."""
    r = table(spark, sf_dir, "region")
    others = r.agg(F.array_sort(F.collect_list(F.substring("r_name", 1, 1))).alias("others"))
    j = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).crossJoin(F.broadcast(others))
    one = F.substring("n_name", 1, 1)
    return j.select("n_nationkey", packs.accepted(one, F.substring("r_name", 1, 1), F.array().cast("array<string>"), F.lower).alias("gold"), packs.accepted(one, F.substring("r_name", 1, 1), F.col("others"), F.lower).alias("any_"))


BUILT = {f.__name__: f for f in (
    homophone_order, first_names, forced_words, open_collisions, frozen_counts, pack_samples, reading_exemptions, redirect_lists, beam_rates, reading_checks, tiered_predictions, scan_depths, differing_pairs, accepted_answers,
)}

_P = "p AS (SELECT p_partkey, p_type AS reading, p_name AS word, p_size AS size, p_brand, p_retailprice AS price FROM part), rk AS (SELECT reading, word, min(p_partkey) AS rank FROM p WHERE size <= 10 GROUP BY 1, 2), fn AS (SELECT reading, word FROM (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY rank, word) AS k FROM rk WHERE word IN (SELECT word FROM p WHERE size >= 5)) WHERE k = 1) "


def sql(bi: str, units: str) -> dict[str, str]:
    return {
        "homophone_order": f"WITH {_P}, w AS (SELECT reading, word, max(size) > 25 AS shipped, count(DISTINCT p_brand) AS sources FROM p GROUP BY 1, 2) "
        "SELECT reading, word, shipped, sources, row_number() OVER (PARTITION BY reading ORDER BY rank NULLS LAST, shipped DESC, sources DESC, word) AS place FROM w LEFT JOIN rk USING (reading, word)",
        "first_names": f"WITH {_P} SELECT reading, word FROM fn",
        "forced_words": f"WITH {_P}, c AS (SELECT word, count(*) AS n FROM p GROUP BY word), r AS (SELECT DISTINCT reading, word FROM p WHERE size >= 5), de AS (SELECT reading FROM p WHERE size = 50 UNION SELECT reading FROM fn), "
        "o AS (SELECT DISTINCT r.word FROM r JOIN de USING (reading) LEFT JOIN fn ON r.reading = fn.reading LEFT JOIN c ON r.word = c.word WHERE fn.word IS DISTINCT FROM r.word OR log10(c.n / 100e0) < -1.5e0) "
        "SELECT '' AS reading, word, NULL::DOUBLE AS score FROM o UNION ALL SELECT r.reading, r.word, round(least(-1.5e0, log10(c.n / 100e0)), 8) FROM r JOIN fn USING (reading, word) JOIN c ON r.word = c.word WHERE r.word NOT IN (SELECT word FROM o)",
        "open_collisions": f"WITH {_P}, w AS (SELECT reading, max_by(word, (price, p_partkey)) AS now_ FROM p GROUP BY reading), f AS (SELECT DISTINCT p.reading, p.word, now_ FROM p JOIN w USING (reading) WHERE p.word <> now_), "
        "s AS (SELECT rk.reading, rk.word, fn.word AS now_ FROM rk JOIN fn USING (reading)) SELECT reading, count(*) AS n FROM f WHERE now_ NOT IN (SELECT word FROM p WHERE size > 40 AND p_brand = (SELECT min(p_brand) FROM p)) AND (reading, word, now_) NOT IN (SELECT reading, word, now_ FROM s) GROUP BY reading",
        "frozen_counts": f"WITH {bi}, g AS (SELECT x AS word, count(*) AS n FROM (SELECT unnest(u) AS x FROM pad) GROUP BY x), b AS (SELECT DISTINCT unnest({units.format(x='text')}) AS word FROM benchmark) "
        "SELECT word, n, (SELECT sum(n) FROM g)::BIGINT AS total, 'words-' || (SELECT count(*) FROM g) AS model FROM g WHERE word IN (SELECT word FROM b)",
        "pack_samples": f"WITH {_P}, a AS (SELECT p_partkey FROM p ORDER BY sha256('check:' || p_partkey), p_partkey LIMIT 20), o AS (SELECT DISTINCT word FROM (SELECT word, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('cut:' || p_brand || ':' || word), word) AS k FROM p) WHERE k = 1) "
        "SELECT 'part' AS kind, p_partkey::VARCHAR AS x FROM a UNION ALL SELECT 'word', word FROM (SELECT word FROM o ORDER BY sha256('cut:' || word), word LIMIT 15)",
        "reading_exemptions": f"WITH {_P}, s AS (SELECT word, min(reading) AS reading FROM p WHERE size = 1 GROUP BY word HAVING count(DISTINCT reading) = 1), b AS (SELECT word, max(price) AS top, count(DISTINCT reading) AS n FROM p GROUP BY word), x AS (SELECT reading, word, max(price) AS score FROM p GROUP BY 1, 2) "
        "SELECT reading, word, CASE WHEN abs(score - (SELECT min(price) FROM p)) < 1e-9 THEN 'floor' ELSE 'above' END AS rule FROM x JOIN b USING (word) JOIN s USING (reading, word) WHERE n >= 2 AND score < top",
        "redirect_lists": "SELECT r_name AS target, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS sources FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
        "beam_rates": "WITH x AS (SELECT l_orderkey AS k, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem), g AS (SELECT l_orderkey AS k, max_by(l_partkey, (l_extendedprice, l_partkey)) AS gold, bool_or(l_quantity = 50) AS oov FROM lineitem GROUP BY 1), "
        "m AS (SELECT k, any_value(oov) AS oov, min(CASE WHEN l_partkey = gold THEN i END) AS at_ FROM x JOIN g USING (k) GROUP BY k) SELECT count(*) AS n, count_if(at_ <= 2) AS near, count_if(at_ <= 4) AS wide, count_if(oov) AS oov, count_if(oov AND at_ = 1) AS oov_first, count_if(oov AND at_ <= 4) AS oov_wide FROM m",
        "reading_checks": "WITH m AS (SELECT source, max_by(lang, (n, lang)) AS derived FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1) SELECT count_if(lang IS NOT NULL) AS confirmed, count_if(lang IS NOT NULL AND lang IS DISTINCT FROM derived) AS other FROM documents LEFT JOIN m USING (source)",
        "tiered_predictions": f"WITH {bi}, b2 AS (SELECT * FROM bi WHERE w <> '</s>'), un2 AS (SELECT w, sum(c)::DOUBLE / (SELECT sum(c) FROM b2) AS pb FROM b2 GROUP BY w), t2 AS (SELECT *, sum(c) OVER (PARTITION BY v) AS total FROM b2), k2 AS (SELECT *, 1 - (sum(c - 0.75) OVER (PARTITION BY v))::DOUBLE / total AS back FROM t2 WHERE c >= 2), "
        f"c AS (SELECT DISTINCT unnest({units.format(x='text')}) AS v FROM benchmark), a AS (SELECT k2.v, k2.w AS word, 0 AS tier, round((c - 0.75)::DOUBLE / total + back * pb, 8) AS score FROM k2 JOIN un2 ON k2.w = un2.w WHERE k2.v IN (SELECT v FROM c) UNION ALL SELECT c.v, w, 1, pb FROM c CROSS JOIN (SELECT w, round(pb, 8) AS pb FROM un2 ORDER BY round(pb, 8) DESC, length(w), w LIMIT 10)), "
        "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v, word ORDER BY tier, score DESC) AS j FROM a) WHERE j = 1) SELECT v, word, tier, score, place FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY tier, score DESC, length(word), word) AS place FROM d) WHERE place <= 5",
        "scan_depths": f"WITH {_P}, a AS (SELECT p_brand, size > 20 AND row_number() OVER (PARTITION BY p_brand, word ORDER BY price DESC, p_partkey) = 1 AS new_, row_number() OVER o AS i, price, p_partkey FROM p WINDOW o AS (PARTITION BY p_brand ORDER BY price DESC, p_partkey)), "
        "s AS (SELECT p_brand, i, sum(new_::INT) OVER (PARTITION BY p_brand ORDER BY i) AS seen FROM a) SELECT p_brand, coalesce(min(i) FILTER (seen >= 8), max(i)) AS depth, count_if(seen >= 8) > 0 AS full_ FROM s GROUP BY 1",
        "differing_pairs": "WITH j AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey + 1 WHERE length(a.n_name) = length(b.n_name)), x AS (SELECT a[i] AS want, b[i] AS got FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM j)) SELECT want, got, count(*) AS n FROM x WHERE want <> got GROUP BY 1, 2",
        "accepted_answers": "SELECT n_nationkey, lower(left(n_name, 1)) = lower(left(r_name, 1)) AS gold, lower(left(n_name, 1)) IN (SELECT lower(left(r_name, 1)) FROM region) AS any_ FROM nation JOIN region ON n_regionkey = r_regionkey",
    }
