"""Queries over the driver's tables and their SQL.

``SHARED`` queries are one SQL text for Spark and the oracle; tables are written {name}.  The others are built from the
library's DataFrame functions and have an oracle of their own in ``OWN_SQL``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import evalstats, graph, guard, memory, ngram, segment
from lexloom.operators.store import kept, running
from lexloom.plans import analytics, models, packing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return lambda spark, sf_dir: spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


SHARED = {
    # Most PER_KEY entries a key
    "lexicon_top12": "SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM {part}) x WHERE rank <= 12",
    # Best layer entry of each word
    "lexicon_winner": "SELECT p_name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_size, p_partkey) AS k FROM {part}) x WHERE k = 1",
    # Rank in which ties count against
    "pess_rank": "SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank FROM {supplier}",
    # Position behind words of one reading
    "slang_rank": "SELECT p_partkey, p_type, dense_rank() OVER (PARTITION BY p_type ORDER BY p_size) - 1 AS behind FROM {part}",
    # Strictly descending chain min(score, previous - tie) in closed form, in whole steps
    "pack_chain": "SELECT p_partkey, p_brand, min(s + k) OVER (PARTITION BY p_brand ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k AS score FROM (SELECT p_partkey, p_brand, CAST(floor(p_retailprice) AS BIGINT) AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM {part}) x",
    # Cap under a partner's score
    "variant_cap": "SELECT a.p_partkey, round(CASE WHEN b.best IS NOT NULL AND a.p_retailprice > b.best - 0.01 THEN b.best - 0.01 ELSE a.p_retailprice END, 4) AS score FROM {part} a LEFT JOIN (SELECT p_type, max(p_retailprice) AS best FROM {part} WHERE p_size >= 40 GROUP BY p_type) b ON a.p_type = b.p_type AND a.p_size < 40",
    # Quartile by index, exact
    "exact_quartile": "SELECT p_brand, p_size AS q1 FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM {part}) x WHERE k = floor(n / 4) + 1",
    # Neighbours in order
    "adjacent_events": "SELECT event_type, nxt, count(*) AS c FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) x WHERE nxt IS NOT NULL GROUP BY event_type, nxt",
    # Several groupings in one pass
    "grouping_sets": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY GROUPING SETS ((lang, source), (lang), ())",
    "rollup_status": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    # Exact interpolated percentiles
    "percentiles": "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95, max(value) AS top FROM {events} GROUP BY event_type",
    # Exact cardinalities
    "cardinality": "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, count(*) AS n FROM {events}",
    # U1-U6
    "set_union": "SELECT s_nationkey AS k FROM {supplier} UNION SELECT c_nationkey FROM {customer}",
    "set_except": "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 48",
    "set_intersect": "SELECT c_custkey AS k FROM {customer} INTERSECT SELECT o_custkey FROM {orders}",
    # J4, J5
    "semi_join": "SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "anti_join": "SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority LIKE '1%')",
    # Outer join with default
    "outer_default": "SELECT c_custkey, coalesce(n, 0) AS n FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey",
    # Remap through a dictionary
    "remap": "SELECT n.n_name, r.r_name, count(*) AS n FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name",
    # Row metrics of two runs
    "row_metrics": "SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS right_, round(avg(quality), 8) AS top1, round(avg(toxic), 8) AS toxic FROM {labels}",
    # Constrained choice on a grid with lexicographic ties
    "grid_choose": "SELECT cap, tau, delta, fixed, broken FROM (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY fixed - broken DESC, broken, tau, delta) AS k FROM (SELECT c.cap, g.tau, g.delta, g.fixed, g.broken FROM (SELECT tau, delta, CAST(sum(CASE WHEN value > tau AND event_id % 10 >= delta THEN 1 ELSE 0 END) AS BIGINT) AS fixed, CAST(sum(CASE WHEN value > tau AND event_id % 10 < delta THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM {events} CROSS JOIN (SELECT * FROM (VALUES (10), (20), (40)) t(tau) CROSS JOIN (VALUES (1), (3), (5)) d(delta)) x GROUP BY tau, delta) g JOIN (SELECT * FROM (VALUES (100), (1000), (100000)) v(cap)) c ON g.broken <= c.cap) y) z WHERE k = 1",
    # Decayed weights in closed form
    "memory_bump": "SELECT user_id, event_type, round(sum(power(0.5, (m.today - e.day) / 14e0)), 6) AS weight, max(e.day) AS day FROM (SELECT user_id, event_type, datediff(DAY, DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM {events}) e CROSS JOIN (SELECT max(datediff(DAY, DATE '1970-01-01', CAST(ts AS DATE))) AS today FROM {events}) m GROUP BY user_id, event_type",
    # Prune and cap
    "memory_prune": "SELECT event_type, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS k FROM (SELECT event_type, user_id, count(*) AS n FROM {events} GROUP BY event_type, user_id) x WHERE n >= 2) y WHERE k <= 50",
    # chained admission with the latest group only
    "latest_only": "SELECT o_orderkey, o_custkey FROM (SELECT *, max(year(o_orderdate)) OVER () AS y FROM {orders}) x WHERE year(o_orderdate) = y",
    # Roll-up with control totals
    "attribution": "SELECT source, lang, count(*) AS n, count(DISTINCT text) AS texts, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY source, lang",
    # P15, on ASCII
    "edit_distance": "SELECT n_name, r_name, levenshtein(n_name, r_name) AS d FROM {nation} CROSS JOIN {region}",
    # Water filling of whole quotas by size
    "water_fill": "SELECT source, n, least(n, CAST(floor(level) AS BIGINT)) AS quota FROM {0} x".replace("{0}", "(SELECT s.source, s.n, l.level FROM (SELECT source, count(*) AS n FROM {documents} GROUP BY source) s CROSS JOIN (SELECT min(CASE WHEN lv <= n THEN lv END) AS level FROM (SELECT n, (300 - coalesce(sum(n) OVER (ORDER BY n, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(count(*) OVER (ORDER BY n, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM (SELECT source, count(*) AS n FROM {documents} GROUP BY source) a) b) l)"),
}


def _bi(spark, sf_dir):
    return ngram.bigrams(ngram.padded(table(spark, sf_dir, "documents")))


def slice_bigram_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest successors of every context of the pruned model."""
    bi = kept(_bi(spark, sf_dir))
    p = ngram.prob(ngram.pruned(bi), ngram.unigram(bi)).withColumn("p", F.round("p", 8))
    return ngram.top_successors(p).select("v", "w", "c", "total", "p", "rank")


def trigram_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    bi, tri = ngram.counts(table(spark, sf_dir, "documents"))
    bi = kept(bi)
    p2 = ngram.prob(ngram.pruned(bi), ngram.unigram(bi))
    return ngram.trigram_prob(tri, p2).select("u", "v", "w", "c", F.round("p", 8).alias("p"))


def kn_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.continuation(_bi(spark, sf_dir))


def ngram_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.grams(ngram.padded(table(spark, sf_dir, "documents")), 1).select(F.col("g1").alias("w"), "c")


def weighted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigrams of English weighted 1 and of the other languages weighted 2.5, rounded half to even."""
    d = table(spark, sf_dir, "documents")
    one = lambda where: ngram.grams(ngram.padded(d.where(where)), 1).select(F.col("g1").alias("w"), "c")
    return ngram.weighted((one("lang = 'en'"), 1.0), (one("lang <> 'en'"), 2.5))


def model_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.pruned(_bi(spark, sf_dir)).select("v", "w", "c", "total", F.round("back", 8).alias("back"))


def scrub_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("text"), {}
    for name, pattern in (("urls", T.URL), ("emails", T.EMAIL), ("phones", T.PHONE)):
        n[name] = F.regexp_count(t, F.lit(pattern)).cast("long").alias(name)
        t = F.regexp_replace(t, pattern, "\n")
    return table(spark, sf_dir, "documents").select("doc_id", *n.values(), F.length(T.scrub(F.col("text"))).cast("long").alias("left_chars"))


def clean_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failing reason of every sentence, counted: a refused character, no letter, length, duplicate, overlap with the benchmark."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.scrub(F.col("text")).alias("text"))
    held = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.sentences(F.col("text"))).alias("text"))
    return guard.reasons(d, held, "$%", T.LATIN, 4, 400).groupBy("reason").agg(F.count("*").alias("n"))


def short_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many kept sentences hold each short held-out sentence."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.scrub(F.col("text")).alias("text"))
    held = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.sentences(F.col("text"))).alias("text"))
    return guard.short_report(guard.reasons(d, held, "$%", T.LATIN, 12, 400), held, 12).select("text", "n")


def guard_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.containment(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def guard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.report(guard_hits(spark, sf_dir), table(spark, sf_dir, "documents"))


def hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.bucket(F.col("source"), F.col("doc_id").cast("string")).alias("bucket"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.units(F.col("text"))).alias("w"))
    return w.groupBy("w", "doc_id").agg(F.count("*").alias("n")).groupBy("w").agg(F.sum("n").alias("c"), F.count("doc_id").alias("df")).where("df >= 3")


def char_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(T.units(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    e = w.select("c", F.concat(F.lit("^^"), "w", F.lit("$")).alias("e"))
    return e.select("c", F.explode(F.expr("transform(sequence(1, length(e) - 2), i -> substr(e, i, 3))")).alias("g")).groupBy("g").agg(F.sum("c").alias("c"))


def recurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct letter pairs of the last 64 characters of each text, and how often the text itself has them."""
    known = T.pairs(F.col("text"), 64, T.LATIN)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(known).cast("long").alias("n"), T.hits(F.col("text"), known).cast("long").alias("hits"))


def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact p of quality against toxic on each source, from the paired counts alone."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    g = j.groupBy("source").agg(F.expr("count_if(quality = 0 AND toxic = 1)").alias("fixed"), F.expr("count_if(quality = 1 AND toxic = 0)").alias("broken"))
    return g.select("source", "fixed", "broken", F.round(evalstats.mcnemar(F.col("fixed"), F.col("broken")), 8).alias("p"))


def int8_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-symmetric int8 quantisation of the vectors: scale, sum of codes and of their sizes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("x"))
    e = e.select("vec_id", "x", (F.array_max(F.transform("x", F.abs)) / 127).alias("step"))
    q = F.transform("x", lambda v: F.rint(v / F.col("step")).cast("long"))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    return e.select("vec_id", F.round("step", 8).alias("scale"), add(q).alias("total"), add(F.transform(q, F.abs)).alias("size"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-bound hash of the benchmark's texts: the hash of the hashes of each 100 numbers' texts."""
    d = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").groupBy(F.floor(F.col("item_id") / 100).alias("part")).agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("x"))
    d = d.select("part", F.sha2(F.array_join("x.text", "\n"), 256).alias("h")).agg(F.array_sort(F.collect_list(F.struct("part", "h"))).alias("x"))
    return d.select(F.sha2(F.array_join("x.h", "\n"), 256).alias("sha"))


def spelling_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph that links a part's name to its brand and size."""
    e = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("b")).distinct()
    return graph.least_labels(e)


def running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order as long as their characters sum to 200,000 or less."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "n_chars")
    return running(d, "doc_id", F.col("n_chars"), ["n_chars"], "upto").where("upto <= 200000").select("doc_id", F.col("upto").cast("long").alias("upto"))


def split_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order, cut into two halves."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    n = d.count()
    return running(d, "conv_id", F.lit(1), ["turn"], "k").select("conv_id", "turn", F.when(F.col("k") <= (n + 1) // 2, 1).otherwise(2).alias("half"))


def last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("seq"))
    return memory.last_writer(e, ["user_id", "event_type"], "seq").select("user_id", "event_type", "event_id", "value")


def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the share of good documents of each source."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    low, high = evalstats.wilson(F.col("k"), F.col("n"))
    return j.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("k")).select("source", "n", "k", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


def memory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight that answers for each user's event type: of the pair, else of the type, else none; with the level."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_date(F.col("ts").cast("date")).alias("day"), F.lit(1.0).alias("delta"))
    today = F.lit(e.agg(F.max("day")).first()[0] or 0)
    probes = e.select("user_id", "event_type").distinct().withColumn("id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    levels = [(memory.bump(e, ["user_id", "event_type"], today), ["user_id", "event_type"]), (memory.bump(e.where("user_id % 2 = 0"), ["event_type"], today), ["event_type"])]
    return memory.lookup(probes, levels).select("id", "level", F.round("weight", 6).alias("weight"))


def speed_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of the measurements of each event type: a load over 99 after the window, or a backup before or after it (values under 0.2), spoils them."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("value").alias("after"), F.min_by("value", "event_id").alias("a"), F.max_by("value", "event_id").alias("b"))
    return e.select("event_type", evalstats.window_verdict(F.col("after"), F.col("a") < 0.2, F.when(F.col("b") > 0, F.col("b") < 0.2), 99.0).alias("verdict"))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best segmentation of the letters of each benchmark text by the lexicon of all words of the table."""
    units = table(spark, sf_dir, "benchmark").select("item_id", T.units(F.col("text")).alias("u"))
    lexicon = units.select(F.explode("u").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    joined = segment.segmented(units.select("item_id", F.array_join("u", "").alias("letters")), lexicon)
    return joined.select("item_id", F.array_join("words", " ").alias("words"))


def expected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected counts of words over all segmentations of the letters of each benchmark text."""
    units = table(spark, sf_dir, "benchmark").select(T.units(F.col("text")).alias("u"))
    lexicon = units.select(F.explode("u").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    return segment.expected_counts(units.select(F.array_join("u", "").alias("letters")), lexicon).select("w", F.round("e", 6).alias("e"))


def decayed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned, capped records of each event type by decayed weight."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_date(F.col("ts").cast("date")).alias("day"), F.lit(1.0).alias("delta"))
    today = e.agg(F.max("day").alias("t")).first()["t"] or 0
    r = memory.bump(e, ["user_id", "event_type"], F.lit(today)).withColumn("weight", F.round("weight", 6))
    return memory.prune(r, 20, ["event_type"], ["user_id"]).select("event_type", "user_id", "weight", "rank")


BUILT = {f.__name__: f for f in (
    slice_bigram_top3, trigram_interpolated, kn_continuation, ngram_unigrams, weighted_merge, model_build, scrub_counts, clean_reasons, short_hits, guard_hits, guard_report, hash_bucket, document_frequency,
    char_trigrams, recurrence_pairs, mcnemar_exact, int8_rows, content_hash, spelling_classes, running_cap, split_halves, last_writer, wilson, memory_lookup, speed_verdict, segmented, expected_words, decayed_records,
)}

_U = "list_transform(regexp_extract_all({x}, '[A-Za-zÀ-ÖØ-öø-ÿ]+'), lambda q: lower(q))"
_S = "list_filter(list_transform(regexp_split_to_array({x}, '[.!?;\\n]+'), lambda q: trim(q, ' ')), lambda q: q <> '')"
_PAD = (
    f"sent AS (SELECT doc_id, lang, unnest({_S.format(x='text')}) AS s FROM documents), u AS (SELECT lang, {_U.format(x='s')} AS w FROM sent), "
    "pad AS (SELECT lang, list_concat(list_concat(['<s>'], w), ['</s>']) AS u FROM u WHERE len(w) > 0), "
)
_BI = _PAD + (
    "bi AS (SELECT u[i] AS v, u[i + 1] AS w, count(*) AS c FROM (SELECT u, unnest(range(1, len(u))) AS i FROM pad) GROUP BY 1, 2), "
    "m AS (SELECT * FROM (SELECT *, sum(c) OVER (PARTITION BY v)::BIGINT AS total FROM bi) WHERE c >= 2), "
    "k AS (SELECT *, 1 - (sum(c - 0.75) OVER (PARTITION BY v))::DOUBLE / total AS back FROM m), "
    "un AS (SELECT w, sum(c)::DOUBLE / (SELECT sum(c) FROM bi) AS pb FROM bi GROUP BY w), "
    "p AS (SELECT k.v, k.w, k.c, k.total, k.back, (k.c - 0.75)::DOUBLE / k.total + k.back * un.pb AS p FROM k JOIN un ON k.w = un.w) "
)
_URL, _EMAIL = r"(?i)(?:(?:https?|ftp)://|www\.)[!-~]+", r"[0-9A-Za-z+%._-]+@(?:[0-9A-Za-z-]+\.)+[0-9A-Za-z-]+"
#: Phone numbers without look-around: those with +, then those with 0 and the mark before it, which is put back.
_PLUS, _ZERO = r"\+[0-9](?:[\s()（）-]*[0-9]){7,}[)）]?", r"(^|[^0-9.])[(（]?[0０](?:[\s()（）-]*[0-9]){7,}[)）]?"

_CLEAN = (
    f"a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_URL}', chr(10), 'g'), '{_EMAIL}', chr(10), 'g'), '{_PLUS.replace('{', '{{').replace('}', '}}')}', chr(10), 'g'), '{_ZERO.replace('{', '{{').replace('}', '}}')}', '\\1' || chr(10), 'g') AS text FROM documents), "
    f"s AS (SELECT doc_id, unnest(ss) AS t, generate_subscripts(ss, 1) AS sid FROM (SELECT doc_id, {_S.format(x='text')} AS ss FROM a)), b AS (SELECT DISTINCT unnest({_S.format(x='text')}) AS t FROM benchmark), "
    "l AS (SELECT t FROM b WHERE length(t) >= {low}), "
    "q AS (SELECT t, contains(t, '$') OR contains(t, '%') AS refused, regexp_matches(t, '[A-Za-zÀ-ÖØ-öø-ÿ]') AS letters, length(t) BETWEEN {low} AND 400 AS fits, EXISTS (SELECT 1 FROM l WHERE contains(x.t, l.t)) AS held FROM (SELECT DISTINCT t FROM s) x), "
    "r AS (SELECT t, CASE WHEN refused THEN 'simplified' WHEN NOT letters THEN 'no_letter' WHEN NOT fits THEN 'length' WHEN NOT held AND k > 1 THEN 'duplicate' WHEN held THEN 'eval_overlap' ELSE 'kept' END AS reason "
    "FROM (SELECT t, row_number() OVER (PARTITION BY t ORDER BY doc_id, sid) AS k FROM s) JOIN q USING (t)) "
)

OWN_SQL = {
    "slice_bigram_top3": f"WITH {_BI}, r AS (SELECT v, w, c, total, round(p, 8) AS p FROM p) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY p DESC, length(w), w) AS rank FROM r) WHERE rank <= 3",
    "model_build": f"WITH {_BI} SELECT v, w, c, total, round(back, 8) AS back FROM k",
    "kn_continuation": f"WITH {_BI} SELECT w, count(*) AS n FROM bi WHERE c >= 2 AND v <> '<s>' GROUP BY w",
    "ngram_unigrams": f"WITH {_PAD} g AS (SELECT unnest(u) AS w FROM pad) SELECT w, count(*) AS c FROM g GROUP BY w",
    "weighted_merge": f"WITH {_PAD} g AS (SELECT unnest(u) AS w, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END AS x FROM pad) SELECT w, round_even(sum(x), 0)::BIGINT AS c FROM g GROUP BY w HAVING round_even(sum(x), 0) > 0",
    "trigram_interpolated": f"WITH {_BI}, t AS (SELECT u[i] AS u, u[i + 1] AS v, u[i + 2] AS w, count(*) AS c FROM (SELECT u, unnest(range(1, len(u) - 1)) AS i FROM pad) GROUP BY 1, 2, 3), "
    "x AS (SELECT *, sum(c) OVER (PARTITION BY u, v)::BIGINT AS total FROM t), y AS (SELECT *, 1 - (sum(c - 0.75) OVER (PARTITION BY u, v))::DOUBLE / total AS back FROM x WHERE c >= 2) "
    "SELECT y.u, y.v, y.w, y.c, round(greatest((y.c - 0.75)::DOUBLE / y.total + y.back * p.p, 0.5 * p.p), 8) AS p FROM y JOIN p ON y.v = p.v AND y.w = p.w",
    "scrub_counts": f"WITH a AS (SELECT doc_id, len(regexp_extract_all(text, '{_URL}')) AS urls, regexp_replace(text, '{_URL}', chr(10), 'g') AS t FROM documents), "
    f"b AS (SELECT *, len(regexp_extract_all(t, '{_EMAIL}')) AS emails, regexp_replace(t, '{_EMAIL}', chr(10), 'g') AS t2 FROM a), "
    f"c AS (SELECT *, len(regexp_extract_all(t2, '{_PLUS}')) AS plus, regexp_replace(t2, '{_PLUS}', chr(10), 'g') AS t3 FROM b) "
    f"SELECT doc_id, urls, emails, plus + len(regexp_extract_all(t3, '{_ZERO}')) AS phones, length(regexp_replace(t3, '{_ZERO}', '\\1' || chr(10), 'g')) AS left_chars FROM c",
    "clean_reasons": f"WITH {_CLEAN.format(low=4)} SELECT reason, count(*) AS n FROM r GROUP BY 1",
    "short_hits": f"WITH {_CLEAN.format(low=12)}, h AS (SELECT DISTINCT t FROM b WHERE length(t) < 12), k AS (SELECT t FROM r WHERE reason = 'kept') SELECT h.t AS text, count(k.t) AS n FROM h LEFT JOIN k ON contains(k.t, h.t) GROUP BY 1",
    "guard_hits": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "guard_report": "WITH h AS (SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)) SELECT (SELECT count(*) FROM documents) AS units, count(DISTINCT doc_id) AS hit_units, count(DISTINCT item_id) AS hit_patterns FROM h",
    "hash_bucket": "SELECT doc_id, (('0x' || left(sha256(source || chr(9) || doc_id), 2))::INT) % 10 AS bucket FROM documents",
    "document_frequency": f"WITH w AS (SELECT doc_id, unnest({_U.format(x='text')}) AS w FROM documents) SELECT w, count(*) AS c, count(DISTINCT doc_id) AS df FROM w GROUP BY w HAVING count(DISTINCT doc_id) >= 3",
    "char_trigrams": f"WITH w AS (SELECT '^^' || unnest({_U.format(x='text')}) || '$' AS e FROM documents) SELECT g, count(*) AS c FROM (SELECT e[i:i + 2] AS g FROM (SELECT e, unnest(range(1, length(e) - 1)) AS i FROM w)) GROUP BY g",
    "recurrence_pairs": "WITH b AS (SELECT item_id, text, right(text, 64) AS r FROM benchmark), p AS (SELECT item_id, text, list_distinct(list_filter(list_transform(range(1, length(r)), lambda i: r[i:i + 1]), lambda q: regexp_full_match(q, '[A-Za-zÀ-ÖØ-öø-ÿ]+'))) AS ps FROM b) "
    "SELECT item_id, len(ps) AS n, len(list_filter(range(1, length(text)), lambda i: list_contains(ps, text[i:i + 1]))) AS hits FROM p",
    "mcnemar_exact": "WITH g AS (SELECT source, count_if(quality = 0 AND toxic = 1) AS fixed, count_if(quality = 1 AND toxic = 0) AS broken FROM labels JOIN documents USING (doc_id) GROUP BY source), t AS (SELECT source, sum(exp(lgamma(fixed + broken + 1) - lgamma(i + 1) - lgamma(fixed + broken - i + 1) - (fixed + broken) * ln(2))) AS tail FROM (SELECT source, fixed, broken, unnest(range(0, least(fixed, broken)::BIGINT + 1)) AS i FROM g) GROUP BY source) SELECT source, fixed::BIGINT AS fixed, broken::BIGINT AS broken, round(least(1.0, 2 * tail), 8) AS p FROM g JOIN t USING (source)",
    "int8_rows": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), s AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) / 127 AS scale FROM e), q AS (SELECT vec_id, scale, list_transform(x, lambda v: round_even(v / scale, 0)::BIGINT) AS q FROM s) "
    "SELECT vec_id, round(scale, 8) AS scale, list_sum(q)::BIGINT AS total, list_sum(list_transform(q, lambda v: abs(v)))::BIGINT AS size FROM q",
    "content_hash": "WITH p AS (SELECT item_id // 100 AS part, sha256(string_agg(text, chr(10) ORDER BY item_id)) AS h FROM benchmark GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY part)) AS sha FROM p",
    "spelling_classes": "WITH RECURSIVE e AS (SELECT DISTINCT p_name AS a, p_brand || '-' || p_size AS b FROM part), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT a, a FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.node AND r.root < g.b) SELECT node, min(root) AS root FROM r GROUP BY node",
    "running_cap": "SELECT doc_id, upto FROM (SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM documents) x WHERE upto <= 200000",
    "split_halves": "SELECT conv_id, turn, ntile(2) OVER (ORDER BY conv_id, turn) AS half FROM conversations",
    "last_writer": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1",
    "wilson": "SELECT source, n, k, round((p + 3.8416e0 / (2 * n) - 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4.0 * n * n))) / (1 + 3.8416e0 / n), 8) AS low, round((p + 3.8416e0 / (2 * n) + 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4.0 * n * n))) / (1 + 3.8416e0 / n), 8) AS high FROM (SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS k, CAST(sum(quality) AS DOUBLE) / count(*) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source) x",
    "memory_lookup": "WITH e AS (SELECT user_id, event_type, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events), t AS (SELECT max(day) AS today FROM e), a AS (SELECT user_id, event_type, sum(power(0.5, (today - day) / 14e0)) AS w FROM e, t GROUP BY 1, 2), b AS (SELECT event_type, sum(power(0.5, (today - day) / 14e0)) AS w FROM e, t WHERE user_id % 2 = 0 GROUP BY 1) "
    "SELECT user_id || '|' || a.event_type AS id, CASE WHEN a.w >= 0.5 THEN 0 ELSE 1 END AS level, round(CASE WHEN a.w >= 0.5 THEN a.w ELSE b.w END, 6) AS weight FROM a LEFT JOIN b ON a.event_type = b.event_type WHERE a.w >= 0.5 OR b.w >= 0.5",
    "speed_verdict": "SELECT event_type, CASE WHEN coalesce(a < 0.2, false) OR coalesce(b > 0 AND b < 0.2, false) THEN 'backup' WHEN after > 99 THEN 'load' WHEN a IS NULL OR b IS NULL OR b <= 0 THEN 'unknown' ELSE 'valid' END AS verdict FROM (SELECT event_type, max(value) AS after, arg_min(value, event_id) AS a, arg_max(value, event_id) AS b FROM events GROUP BY event_type)",
    "decayed_records": "WITH e AS (SELECT user_id, event_type, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events), t AS (SELECT max(day) AS today FROM e), r AS (SELECT event_type, user_id, round(sum(power(0.5, (today - day) / 14.0)), 6) AS weight FROM e, t GROUP BY 1, 2) SELECT event_type, user_id, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY weight DESC, user_id) AS rank FROM r WHERE weight >= 0.05) WHERE rank <= 20",
}

BUILT |= analytics.BUILT | models.BUILT | packing.BUILT
QUERIES = {**{n: shared(q) for n, q in SHARED.items()}, **BUILT}
SQL = {**{n: re.sub(r"\{(\w+)\}", r"\1", q).replace("datediff(DAY", "date_diff('day'") for n, q in SHARED.items()}, **OWN_SQL, **analytics.SQL, **models.sql(_BI), **packing.sql(_BI, _U)}
