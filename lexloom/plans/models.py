"""Queries over the scoring, lexicon, decoding and text operators, and their SQL.

The model is that of ``documents``; ``benchmark`` has the probes.  The SQL of the model is given as ``{BI}`` (bigrams bi,
kept ones k with back, unigrams un) and put in by ``sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import decode, lexicon, ngram, scoring
from lexloom.operators.store import kept

#: Bytes of a model of ``decoded``: a Python worker holds one at a time beside what it decodes.
DECODED_BYTES = 64 << 20
ACCENTS, PLAIN = "áéíóúüñöäçàèê", "aeiouunoacaee"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(ngram.bigrams(ngram.padded(table(spark, sf_dir, "documents"))))


def _unigrams(bi: DataFrame) -> DataFrame:
    return bi.groupBy("w").agg(F.sum("c").alias("n"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words of the benchmark."""
    return ngram.bigrams(ngram.padded(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))).where(F.col("w") != ngram.END).select("v", "w")


def _scored(probes: DataFrame, uni: DataFrame) -> DataFrame:
    """probes with lp, log10 of the share of w; -8 where the model has none."""
    total = uni.agg(F.sum("n").alias("total"))
    return probes.join(uni, "w", "left").crossJoin(F.broadcast(total)).withColumn("lp", F.when(F.col("n").isNull(), -8.0).otherwise(F.log10(F.col("n") / F.col("total")))).drop("n", "total")


def variant_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams in which words that differ by accents alone are one word, the least of them its representative."""
    bi = _bigrams(spark, sf_dir)
    uni = _unigrams(bi)
    word = uni.select("w", F.translate("w", ACCENTS, PLAIN).alias("f"))
    classes = word.join(word.groupBy("f").agg(F.min("w").alias("rep"), F.count("*").alias("n")).where("n > 1"), "f").select(F.col("w").alias("member"), "rep")
    u, b = lexicon.merge_variants(uni, bi, classes)
    return b.groupBy("v").agg(F.count("*").alias("successors"), F.sum("c").alias("c")).join(u.select(F.col("w").alias("v"), "n"), "v", "left")


def continuation_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of N + 1 over the vocabulary, and the words with a context of their own."""
    bi = _bigrams(spark, sf_dir)
    uni = _unigrams(bi).where(F.col("w") != ngram.END)
    n = uni.select("w").join(ngram.continuation(bi, 2, uni), "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.sum(F.col("n") + 1).alias("total"), F.count_if(F.col("n") > 0).alias("words"))


def word_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every word pair of the benchmark in the formal profile, with the continuation share in the back-off."""
    bi = _bigrams(spark, sf_dir)
    uni = _unigrams(bi).where(F.col("w") != ngram.END)
    n = uni.select("w").join(ngram.continuation(bi, 2, uni), "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"))
    p = scoring.pair_prob(scoring.back_off(_scored(_probes(spark, sf_dir), uni), scoring.continuation_share(n)), ngram.pruned(bi))
    return p.select("v", "w", F.round("pb", 10).alias("pb"), F.round(scoring.word_term(F.col("p"), F.col("lp"), "formal"), 6).alias("score"))


def class_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(w | v) with classes of words by length in pairs that the model has not kept."""
    bi = _bigrams(spark, sf_dir)
    uni = _unigrams(bi).unionByName(bi.where(F.col("v") == ngram.START).groupBy(F.col("v").alias("w")).agg(F.sum("c").alias("n")))
    k = F.when(F.col("w") == ngram.START, 7).when(F.col("w") == ngram.END, 8).otherwise(F.length("w") % 7)
    classes = uni.select("w", k.alias("k"))
    made = (scoring.emission(uni, classes), *scoring.class_matrix(bi, classes))
    probes = _scored(_probes(spark, sf_dir), _unigrams(bi)).withColumn("pb", F.pow(F.lit(10.0), "lp"))
    return scoring.pair_prob(probes, ngram.pruned(bi), made).select("v", "w", F.round("p", 10).alias("p"))


def chain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain score of every sentence of the benchmark, less a penalty for each word that only the benchmark has."""
    bi = _bigrams(spark, sf_dir)
    uni = _unigrams(bi)
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"), T.LATIN)).alias("sid", "s")).select("item_id", "sid", T.units(F.col("s")).alias("u")).where(F.size("u") > 0)
    lc = scoring.chains(b, ["item_id", "sid"], ngram.pruned(bi), uni, True)
    k = scoring.layer_words(b, ["item_id", "sid"], b.select(F.explode("u").alias("w")), uni)
    return lc.join(k, ["item_id", "sid"]).select("item_id", "sid", F.round("lc", 6).alias("lc"), "k", F.round(F.col("lc") - 1.5 * F.col("k"), 6).alias("col"))


def overlay_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as a layer of score -3, capped by their share in the documents; words of three letters or fewer are not of the layer."""
    uni = _unigrams(_bigrams(spark, sf_dir))
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.units(F.col("text"))).alias("w")).distinct()
    total = uni.agg(F.sum("n")).first()[0] or 1
    return scoring.capped(w.select("w", F.lit(-3.0).alias("lp"), (F.length("w") > 3).alias("layered")), uni, F.lit(total)).select("w", F.round("score", 8).alias("score"))


def demotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demotion of each part's brand and type: that of suppliers' rows for the brand, else that for any brand; with the reading and the learned-word terms."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("reading"), F.col("p_type").alias("word"), "p_size")
    rows = p.where("p_size = 1").groupBy("reading", "word").agg(F.min("p_partkey").alias("k")).select("reading", "word", (1.0 + F.col("k") % 5).alias("delta"))
    every = p.where("p_size = 2").groupBy("word").agg(F.min("p_partkey").alias("k")).select(F.lit("*").alias("reading"), "word", (0.5 + F.col("k") % 3).alias("delta"))
    d = scoring.demotion(p, rows.unionByName(every))
    return d.select("p_partkey", "delta", scoring.reading_term(-F.col("p_size") / 10.0).alias("term"), F.round(scoring.new_word_score(F.col("p_size").cast("double")), 8).alias("new"))


def _digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    return scoring.digit_counts(lines)


def digit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digits(spark, sf_dir)


def digit_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(w | v, digits) of every pair seen around digits, over words taken as equally likely."""
    counts = kept(_digits(spark, sf_dir))
    v, w = counts.where("kind = 'Q'").select(F.col("a").alias("v")), counts.where("kind = 'W'").select(F.col("a").alias("w"))
    near = counts.where("kind = 'P'").select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(w.select(F.lit("?").alias("v"), "w")).unionByName(v.select("v", F.lit("?").alias("w")))
    p = scoring.after_digits(near.select("v", "w", F.lit(0.001).alias("pw")), counts)
    return p.select("v", "w", F.round("p", 10).alias("p"))


def digit_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of digits after each context, and of the lengths of digit runs."""
    counts = kept(_digits(spark, sf_dir))
    given = scoring.digits_given(counts).select(F.lit("given").alias("kind"), F.col("v").alias("a"), F.round("p", 10).alias("p"), F.lit(0.0).alias("going"))
    sizes = scoring.run_lengths(counts).select(F.lit("length").alias("kind"), F.col("m").cast("string").alias("a"), F.round("ended", 10).alias("p"), F.round("going", 10).alias("going"))
    return given.unionByName(sizes)


def _foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of English documents as foreign words."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    return d.select("doc_id", F.explode(T.units(F.col("text"))).alias("w"), F.when(F.col("source") < "src5", 5).otherwise(1).alias("weight"))


def foreign_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 P of the benchmark's words as foreign words, kept at a weighted count of 40 or more; and whether that beats a native score of -6 by 0.5."""
    made = {k: kept(v) for k, v in scoring.foreign_table(_foreign(spark, sf_dir), 3, 40).items()}
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.units(F.col("text"))).alias("w")).distinct()
    lp = scoring.foreign_words(w, made)
    native = scoring.key_score(F.lit(-6.0), F.lit(0.5), F.length("w") % 2, F.lit(0), F.lit(0), (1.0, 0.5, 0.25))
    return lp.select("w", F.round(F.when(F.col("lp") > float("-inf"), F.col("lp")), 6).alias("lp"), scoring.takes_foreign(F.col("lp"), native, 0.5).alias("takes"))


def foreign_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter trigrams and lengths of the known foreign words."""
    made = scoring.foreign_table(_foreign(spark, sf_dir), 3, 40)
    return made["grams"].select("g", "c").unionByName(made["sizes"].select(F.col("m").cast("string").alias("g"), "c"))


def foreign_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(w | e) of the successors of each word that begins with th, and the share of such words after each word."""
    bi = _bigrams(spark, sf_dir)
    heads = bi.where("v LIKE 'th%'").groupBy(F.col("v").alias("e")).agg(F.sum("c").alias("n"))
    pairs = bi.where("v LIKE 'th%'").select(F.col("v").alias("e"), "w", "c")
    p = scoring.followers(pairs.where("c > 1").select("e", "w", F.lit(0.001).alias("pw")), heads, pairs)
    by = bi.groupBy("v").agg(F.sum(F.when(F.col("w").startswith("th"), F.col("c")).otherwise(0)).alias("e"), F.sum("c").alias("n"))
    given = scoring.foreign_given(by).select(F.lit("").alias("w"), F.col("v").alias("e"), "p")
    return p.select("e", "w", "p").unionByName(given.select("e", "w", "p")).select("e", "w", F.round("p", 10).alias("p"))


def variant_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best price of each brand's types, small sizes held under the large size of their brand."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("reading"), F.col("p_size").cast("string").alias("word")).agg(F.max("p_retailprice").alias("score"))
    order = p.where("word IN ('1', '2', '3')").select("reading", F.col("word").alias("less"), F.lit("50").alias("more"))
    return lexicon.capped_variants(p, order).select("reading", "word", F.round("score", 4).alias("score"))


def landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each part lands if it is sent on to the part before it with its brand and type."""
    p = table(spark, sf_dir, "part")
    before = F.lag("p_partkey").over(W.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    return lexicon.landing(p.select(F.col("p_partkey").alias("word"), before.alias("to")).where("to IS NOT NULL"))


def length_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower quartile of the words' scores by length, from the length before where fewer than 100 words have it."""
    uni = _unigrams(_bigrams(spark, sf_dir))
    return lexicon.length_scores(_scored(uni.select("w"), uni), 100, 2, 12).select("size", F.round("score", 8).alias("score"))


def graded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded score of the benchmark's words: that of their length, or their own share and a bonus if that is more."""
    uni = _unigrams(_bigrams(spark, sf_dir))
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.units(F.col("text"))).alias("w")).distinct().where(F.length("w").between(2, 12))
    by = lexicon.length_scores(_scored(uni.select("w"), uni), 100, 2, 12)
    j = _scored(w, uni).join(F.broadcast(by), F.length("w") == F.col("size"))
    return j.select("w", F.round(F.greatest("score", F.col("lp") + 0.75), 8).alias("score"))


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents by the stage that refuses them: known to the benchmark, too few documents, too short."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.units(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(T.units(F.col("text"))).alias("w"))
    return lexicon.admit(w, [("known", known), ("rare", F.col("df") >= 3), ("short", F.length("w") >= 4)]).groupBy("stage").agg(F.count("*").alias("n"))


def substring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of word beginnings of three and four letters in the benchmark, overlaps counted."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.units(F.col("text"))).alias("w")).where(F.length("w") >= 4)
    c = w.select(F.explode(F.array(F.substring("w", 1, 3), F.substring("w", 1, 4))).alias("w")).distinct()
    return lexicon.substring_counts(table(spark, sf_dir, "benchmark").select("text"), c)


def literal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of the first four characters of each document in it, none over another."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND length(text) >= 4")
    return d.select("doc_id", lexicon.literal_count(F.col("text"), F.substring("text", 1, 4)).alias("n"))


def sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of documents of 300,000 characters."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").alias("size"))
    return lexicon.sample_to_cap(d, "doc_id", "size", 300_000, 30_000).agg(F.sum("size").alias("chars"))


def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.review(_unigrams(_bigrams(spark, sf_dir)), 20, 20)


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions made of a nation's keys, in the order of their numeric parts."""
    n = table(spark, sf_dir, "nation").select(F.concat_ws(".", F.lit("v1"), F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("version"))
    key = lexicon.version_key(F.col("version"))
    return n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "version"))), lambda x: x["version"]), " ").alias("versions"))


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions on the names of parts: kind, optional forms, suffix, merged syllable, names in a cell, clauses, typed beginnings."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("s"), F.col("p_type").alias("t"))
    cell = F.concat(F.col("t"), F.lit("（x、(y)）、"), F.col("s"))
    return p.select(
        "p_partkey", T.kind(F.col("s"), "ae", "o", "r").alias("kind"), F.array_join(T.optional_forms(F.concat(F.lit("a["), F.substring("s", 1, 2), F.lit("]b[c]"))), "|").alias("forms"),
        T.without_suffix(F.col("t"), ["TIN", "EL", "L"]).alias("stem"), T.merged(F.lower("t"), [("s", "z"), ("i", "e")]).alias("merged"),
        F.array_join(T.names(cell, 2, 40, T.TextProfile(r"[\x20-\x7E]+", "", "")), "|").alias("names"), F.array_join(T.clauses(F.col("s"), r"\s+", 2, 6, T.LATIN), "|").alias("clauses"),
        T.compatible(F.transform(F.split("s", " "), lambda x: F.substring(x, 1, 1)), F.split("s", " ")).alias("fits"), T.record_key(F.when(F.col("p_partkey") % 2 == 0, "^").otherwise("k"), F.substring("s", 1, 1)).alias("key"),
        F.round(T.log10_sum(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: -(i + F.col("p_partkey") % 7).cast("double"))), 8).alias("sum"),
    )


def longest_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the benchmark with the longest of a few letter groups replaced from left to right."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(T.normal_form(F.col("text"), "é", "e", {"th": "1", "the": "2", "an": "3", "and": "4", "ion": "5"}), 256).alias("h"))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best words of the first ten words' consonants of each text of the benchmark, by single words, pairs and triples.

    A word's syllables are its consonants, so words with the same ones share a reading.  Pairs and triples are counted
    whole, but only of the contexts that the texts can read: the total of a context is the count of the words that it is
    of, so those that are pruned are counted and let go.  Texts are decoded in parts with models of DECODED_BYTES at most.
    """
    docs = table(spark, sf_dir, "documents")
    pair = ngram.windows(docs, 2).select(F.col("g1").alias("v"), F.col("g2").alias("w"))
    uni = kept(ngram.words(docs))
    consonants = lambda w: F.filter(F.split(w, ""), lambda c: ~c.rlike("[aeiouáéíóúüöäàèê]"))
    total = uni.agg(F.sum("n").alias("total"))
    lp = F.log10(F.col("n") / F.col("total"))
    readings = uni.where((F.col("w") != ngram.END) & (F.col("n") >= 3)).crossJoin(F.broadcast(total)).select(consonants(F.col("w")).alias("reading"), F.col("w").alias("word"), lp.alias("lp")).where(F.size("reading") > 0)
    read = F.flatten(F.transform(F.slice(T.units(F.col("text")), 1, 10), consonants))
    b = table(spark, sf_dir, "benchmark").select("item_id", read.alias("reading"))
    spans, words, known = decode.pieces(b, readings)
    heads = known.select(F.col("word").alias("v")).distinct()
    bi = kept(pair.join(ngram.small(heads), "v", "left_semi").groupBy("v", "w").agg(F.count("*").alias("c")).where("c >= 2"))
    # every sentence has a pad at either end
    one = ngram.held(bi, ["v"], uni.select(F.when(F.col("w") == ngram.END, ngram.START).otherwise(F.col("w")).alias("v"), F.col("n").alias("total")))
    # a context with a triple that is kept has a count of 3 or more
    context = decode.contexts(spans, known, bi.where("c >= 3"))
    tri = kept(ngram.followers(docs, context).where("c >= 3"))
    two = ngram.held(tri, ["u", "v"], context)
    # contexts stand alone too, so only words that can be read stay after them
    words_after = ngram.small(known.select(F.col("word").alias("w")).distinct())
    p, t = (kept(d.join(words_after, "w", "left_semi").join(ngram.small(x), by).unionByName(x, allowMissingColumns=True)) for d, x, by in ((bi, kept(one), ["v"]), (tri, kept(two), ["u", "v"])))
    best = decode.dealt(b, spans, words, known, p, t, beam=16, top=1, most=DECODED_BYTES)
    return b.join(best, "reading", "left").select("item_id", *[F.array_join(F.get(f"paths{n}", F.lit(0))["words"], " ").alias(f"best{n}") for n in (1, 2, 3)])


BUILT = {f.__name__: f for f in (
    variant_merge, continuation_total, word_terms, class_backoff, chain_scores, overlay_cap, demotions, digit_table, digit_next, digit_shares, foreign_scores, foreign_shapes, foreign_followers, variant_caps, landings, length_scores, graded_scores,
    admissions, substring_counts, literal_counts, sample_cap, review_list, version_order, text_forms, longest_forms, decoded,
)}

_UNITS = "list_transform(regexp_extract_all({x}, '[A-Za-zÀ-ÖØ-öø-ÿ]+'), lambda q: lower(q))"
_SENT = "list_filter(list_transform(regexp_split_to_array({x}, '[.!?;\\n]+'), lambda q: trim(q, ' ')), lambda q: q <> '')"
_PROBES = f"bs AS (SELECT item_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS sid FROM (SELECT item_id, {_SENT.format(x='text')} AS ss FROM benchmark)), bw AS (SELECT item_id, sid, {_UNITS.format(x='s')} AS w FROM bs), bu AS (SELECT item_id, sid, w, list_concat(['<s>'], w) AS u FROM bw WHERE len(w) > 0), pr AS (SELECT DISTINCT u[i] AS v, u[i + 1] AS w FROM (SELECT u, unnest(range(1, len(u))) AS i FROM bu)) "
_UNI = "uni AS (SELECT w, sum(c)::BIGINT AS n FROM bi GROUP BY w) "
_LP = "lp AS (SELECT pr.v, pr.w, CASE WHEN n IS NULL THEN -8e0 ELSE log10(n::DOUBLE / (SELECT sum(n) FROM {u})) END AS lp FROM pr LEFT JOIN {u} ON pr.w = {u}.w) "
_PAIR = "cx AS (SELECT DISTINCT v, back, total FROM k) "
_ITEMS = (
    "ln AS (SELECT lower(unnest(string_split(text, chr(10)))) AS t FROM documents WHERE text IS NOT NULL), it AS (SELECT regexp_extract_all(t, '[0-9]+|[A-Za-zÀ-ÖØ-öø-ÿ]+|[^\\s]') AS x FROM ln), "
    "ex AS (SELECT x[i] AS x, x[i - 1] AS p, x[i + 1] AS q, i FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM it)), "
    "rw AS (SELECT x, CASE WHEN i > 1 AND regexp_full_match(p, '[A-Za-zÀ-ÖØ-öø-ÿ]+') THEN p ELSE '<s>' END AS v, CASE WHEN regexp_full_match(q, '[A-Za-zÀ-ÖØ-öø-ÿ]+') THEN q END AS w, regexp_full_match(x, '[0-9]+') AS run FROM ex WHERE regexp_full_match(x, '[0-9]+|[A-Za-zÀ-ÖØ-öø-ÿ]+')), "
    "dg AS (SELECT 'T' AS kind, '' AS a, '' AS b FROM rw UNION ALL SELECT 'C', v, '' FROM rw UNION ALL SELECT 'N', '', '' FROM rw WHERE run UNION ALL SELECT 'D', v, '' FROM rw WHERE run UNION ALL SELECT 'L', least(length(x), 10)::VARCHAR, '' FROM rw WHERE run "
    "UNION ALL SELECT 'X', unnest(string_split(x, '')), '' FROM rw WHERE run UNION ALL SELECT 'S', '', '' FROM rw WHERE run AND w IS NULL UNION ALL SELECT 'W', w, '' FROM rw WHERE run AND w IS NOT NULL UNION ALL SELECT 'Q', v, '' FROM rw WHERE run AND w IS NOT NULL UNION ALL SELECT 'P', v, w FROM rw WHERE run AND w IS NOT NULL), "
    "dt AS (SELECT kind, a, b, count(*) AS c FROM dg GROUP BY 1, 2, 3) "
)
_FOREIGN = (
    f"ft AS (SELECT doc_id, unnest({_UNITS.format(x='text')}) AS w, CASE WHEN source < 'src5' THEN 5 ELSE 1 END AS x FROM documents WHERE lang = 'en'), "
    "fn AS (SELECT w, sum(x)::BIGINT AS n, count(DISTINCT doc_id) AS df FROM ft GROUP BY w HAVING count(DISTINCT doc_id) >= 3), fl AS (SELECT w, '^^' || w || '$' AS e FROM fn WHERE regexp_full_match(w, '[a-z]+')), "
    "fg AS (SELECT e[i:i + 2] AS g, count(*) AS c FROM (SELECT e, unnest(range(1, length(e) - 1)) AS i FROM fl) GROUP BY 1), fs AS (SELECT length(w) AS m, count(*) AS c FROM fl WHERE length(w) BETWEEN 5 AND 16 GROUP BY 1) "
)
_LENGTHS = (
    ", sl AS (SELECT length(w) AS size, log10(n::DOUBLE / (SELECT sum(n) FROM uni)) AS lp FROM uni), qs AS (SELECT size, lp FROM (SELECT size, lp, row_number() OVER (PARTITION BY size ORDER BY lp) AS k, count(*) OVER (PARTITION BY size) AS n FROM sl) WHERE n >= 100 AND k = n // 4 + 1), "
    "ls AS (SELECT size, score FROM (SELECT r.size, last_value(lp IGNORE NULLS) OVER (ORDER BY r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS score FROM (SELECT unnest(range(2, 13)) AS size) r LEFT JOIN qs ON r.size = qs.size) WHERE score IS NOT NULL) "
)
_MODEL_SQL = {
    "variant_merge": "WITH {BI}, " + _UNI + ", f AS (SELECT w, translate(w, '" + ACCENTS + "', '" + PLAIN + "') AS f FROM uni), g AS (SELECT f, min(w) AS rep FROM f GROUP BY f HAVING count(*) > 1), cl AS (SELECT f.w AS member, g.rep FROM f JOIN g USING (f)), "
    "b AS (SELECT coalesce(cv.rep, bi.v) AS v, coalesce(cw.rep, bi.w) AS w, sum(c) AS c FROM bi LEFT JOIN cl cv ON bi.v = cv.member LEFT JOIN cl cw ON bi.w = cw.member GROUP BY 1, 2), "
    "x AS (SELECT coalesce(cl.member, b.v) AS v, b.w, b.c FROM b LEFT JOIN cl ON b.v = cl.rep), uu AS (SELECT coalesce(cl.member, y.w) AS w, y.n FROM (SELECT coalesce(cl.rep, uni.w) AS w, sum(n) AS n FROM uni LEFT JOIN cl ON uni.w = cl.member GROUP BY 1) y LEFT JOIN cl ON y.w = cl.rep) "
    "SELECT x.v, count(*) AS successors, sum(x.c)::BIGINT AS c, any_value(uu.n)::BIGINT AS n FROM x LEFT JOIN uu ON x.v = uu.w GROUP BY x.v",
    "continuation_total": "WITH {BI}, " + _UNI + ", v AS (SELECT w FROM uni WHERE w <> '</s>'), n AS (SELECT w, count(*) AS n FROM bi WHERE c >= 2 AND v <> '<s>' AND v IN (SELECT w FROM v) GROUP BY w) SELECT sum(coalesce(n, 0) + 1)::BIGINT AS total, count_if(n > 0) AS words FROM v LEFT JOIN n USING (w)",
    "word_terms": "WITH {BI}, " + _UNI + ", ux AS (SELECT * FROM uni WHERE w <> '</s>'), n AS (SELECT ux.w, count(b.v) AS n FROM ux LEFT JOIN (SELECT v, w FROM bi WHERE c >= 2 AND v <> '<s>' AND v IN (SELECT w FROM ux)) b ON ux.w = b.w GROUP BY ux.w), " + _PROBES + ", " + _LP.format(u="ux") + ", " + _PAIR
    + ", s AS (SELECT lp.v, lp.w, lp, CASE WHEN n.n IS NULL THEN power(10e0, lp) ELSE 0.75e0 * (n.n + 1) / (SELECT sum(n + 1) FROM n) + 0.25e0 * power(10e0, lp) END AS pb FROM lp LEFT JOIN n ON lp.w = n.w), "
    "q AS (SELECT s.v, s.w, lp, pb, CASE WHEN k.c IS NOT NULL THEN (k.c - 0.75e0) / k.total + k.back * pb ELSE coalesce(cx.back, 1) * pb END AS pp FROM s LEFT JOIN cx ON s.v = cx.v LEFT JOIN k ON s.v = k.v AND s.w = k.w) "
    "SELECT v, w, round(pb, 10) AS pb, round(0.7e0 * log10(pp) + 0.3e0 * lp, 6) AS score FROM q",
    "class_backoff": "WITH {BI}, " + _UNI + ", ua AS (SELECT * FROM uni UNION ALL SELECT v, sum(c)::BIGINT FROM bi WHERE v = '<s>' GROUP BY v), kl AS (SELECT w, n, CASE w WHEN '<s>' THEN 7 WHEN '</s>' THEN 8 ELSE length(w) % 7 END AS k FROM ua), "
    "em AS (SELECT w, k, n::DOUBLE / sum(n) OVER (PARTITION BY k) AS emit FROM kl), mx AS (SELECT a.k AS cv, b.k AS cw, sum(c) AS m FROM bi JOIN kl a ON bi.v = a.w JOIN kl b ON bi.w = b.w GROUP BY 1, 2), mr AS (SELECT cv, sum(m) AS r FROM mx GROUP BY cv), "
    + _PROBES + ", " + _LP.format(u="uni") + ", " + _PAIR
    + ", s AS (SELECT lp.v, lp.w, power(10e0, lp) AS pb, a.k AS cv, b.k AS cw, b.emit FROM lp LEFT JOIN em a ON lp.v = a.w LEFT JOIN em b ON lp.w = b.w), "
    "q AS (SELECT s.*, (coalesce(m, 0) + 0.1e0) / (coalesce(r, 0) + (SELECT count(DISTINCT k) FROM kl) * 0.1e0) AS pc FROM s LEFT JOIN mx USING (cv, cw) LEFT JOIN mr ON s.cv = mr.cv) "
    "SELECT q.v, q.w, round(CASE WHEN k.c IS NOT NULL THEN (k.c - 0.75e0) / k.total + k.back * pb WHEN cv IS NOT NULL AND cw IS NOT NULL THEN coalesce(cx.back, 1) * (0.7e0 * pb + 0.3e0 * pc * emit) ELSE coalesce(cx.back, 1) * pb END, 10) AS p FROM q LEFT JOIN cx ON q.v = cx.v LEFT JOIN k ON q.v = k.v AND q.w = k.w",
    "chain_scores": "WITH {BI}, " + _UNI + ", " + _PROBES + ", " + _PAIR + ", n1 AS (SELECT (sum(n) + count(*) + 1)::DOUBLE AS n1 FROM uni WHERE w <> '</s>'), pe AS (SELECT sum(n) FILTER (w = '</s>')::DOUBLE / sum(n) AS pe FROM uni), "
    "x AS (SELECT item_id, sid, i, uu[i] AS v, uu[i + 1] AS w FROM (SELECT item_id, sid, list_concat(u, ['</s>']) AS uu, unnest(range(1, len(u) + 1)) AS i FROM bu)), "
    "s AS (SELECT x.*, CASE WHEN x.w = '</s>' THEN (SELECT pe FROM pe) ELSE (coalesce(n, 0) + 1) / (SELECT n1 FROM n1) END AS pb, n FROM x LEFT JOIN uni ON x.w = uni.w), "
    "q AS (SELECT s.*, CASE WHEN i = 1 AND s.w <> '</s>' AND k.c IS NULL THEN pb WHEN k.c IS NOT NULL THEN (k.c - 0.75e0) / k.total + k.back * pb ELSE coalesce(cx.back, 1) * pb END AS pp FROM s LEFT JOIN cx ON s.v = cx.v LEFT JOIN k ON s.v = k.v AND s.w = k.w), "
    "a AS (SELECT item_id, sid, sum(log10(pp)) AS lc, count_if(n IS NULL AND w <> '</s>') AS k FROM q GROUP BY 1, 2) SELECT item_id, sid, round(lc, 6) AS lc, k, round(lc - 1.5 * k, 6) AS col FROM a",
    "overlay_cap": "WITH {BI}, " + _UNI + f", w AS (SELECT DISTINCT unnest({_UNITS.format(x='text')}) AS w FROM benchmark) "
    "SELECT w.w, round(CASE WHEN length(w.w) <= 3 THEN -3e0 WHEN n IS NOT NULL THEN least(-3e0, log10(n::DOUBLE / (SELECT sum(n) FROM uni))) ELSE -4e0 END, 8) AS score FROM w LEFT JOIN uni ON w.w = uni.w",
    "review_list": "WITH {BI}, " + _UNI + ", t AS (SELECT w, n FROM uni ORDER BY n DESC, w LIMIT 20), o AS (SELECT w, n FROM uni WHERE w NOT IN (SELECT w FROM t) ORDER BY sha256('lexloom:' || w), w LIMIT 20) SELECT w, n, 'top' AS part FROM t UNION ALL SELECT w, n, 'other' FROM o",
    "length_scores": "WITH {BI}, " + _UNI + _LENGTHS + "SELECT size, round(score, 8) AS score FROM ls",
    "graded_scores": "WITH {BI}, " + _UNI + _LENGTHS[:-1] + f", w AS (SELECT DISTINCT unnest({_UNITS.format(x='text')}) AS w FROM benchmark), j AS (SELECT w.w, CASE WHEN n IS NULL THEN -8e0 ELSE log10(n::DOUBLE / (SELECT sum(n) FROM uni)) END AS lp FROM w LEFT JOIN uni ON w.w = uni.w) "
    "SELECT w, round(greatest(score, lp + 0.75), 8) AS score FROM j JOIN ls ON length(w) = size",
    "foreign_followers": "WITH {BI}, h AS (SELECT v AS e, sum(c) AS n FROM bi WHERE v LIKE 'th%' GROUP BY v), by_ AS (SELECT v, coalesce(sum(c) FILTER (w LIKE 'th%'), 0) AS e, sum(c) AS n FROM bi GROUP BY v) "
    "SELECT bi.v AS e, bi.w, round((c + 0.001e0) / (h.n + 1e0), 10) AS p FROM bi JOIN h ON bi.v = h.e WHERE c > 1 UNION ALL SELECT v, '', round((e + (SELECT sum(e)::DOUBLE / sum(n) FROM by_)) / (n + 1e0), 10) FROM by_",
}
_OTHER_SQL = {
    "demotions": "WITH s AS (SELECT p_brand, p_type, 1e0 + min(p_partkey) % 5 AS d FROM part WHERE p_size = 1 GROUP BY 1, 2), e AS (SELECT p_type, 0.5e0 + min(p_partkey) % 3 AS d FROM part WHERE p_size = 2 GROUP BY 1) "
    "SELECT p_partkey, coalesce(s.d, e.d, 0e0) AS delta, 2e0 * greatest(-p_size / 10e0, -4e0) AS term, round(-3 + 2 * (p_size::DOUBLE / (p_size + 1)), 8) AS new FROM part LEFT JOIN s USING (p_brand, p_type) LEFT JOIN e USING (p_type)",
    "digit_table": f"WITH {_ITEMS} SELECT kind, a, b, c FROM dt",
    "digit_next": f"WITH {_ITEMS}, nr AS (SELECT a AS v, b AS w FROM dt WHERE kind = 'P' UNION ALL SELECT '?', a FROM dt WHERE kind = 'W' UNION ALL SELECT a, '?' FROM dt WHERE kind = 'Q'), nd AS (SELECT coalesce(sum(c), 0) AS n FROM dt WHERE kind = 'N'), "
    "j AS (SELECT nr.v, nr.w, (coalesce(w.c, 0) + 0.001e0) / (nd.n + 1e0) AS base, q.c AS cq, coalesce(p.c, 0) AS cp FROM nr CROSS JOIN nd LEFT JOIN dt w ON w.kind = 'W' AND w.a = nr.w LEFT JOIN dt q ON q.kind = 'Q' AND q.a = nr.v LEFT JOIN dt p ON p.kind = 'P' AND p.a = nr.v AND p.b = nr.w) "
    "SELECT v, w, round(CASE WHEN cq IS NULL THEN base ELSE (cp + base) / (cq + 1e0) END, 10) AS p FROM j",
    "digit_shares": f"WITH {_ITEMS}, pd AS (SELECT sum(c) FILTER (kind = 'N')::DOUBLE / sum(c) FILTER (kind = 'T') AS pd FROM dt), l AS (SELECT a::INT AS m, c FROM dt WHERE kind = 'L') "
    "SELECT 'given' AS kind, d.a, round((d.c + pd) / (c.c + 1e0), 10) AS p, 0e0 AS going FROM dt d JOIN dt c ON c.kind = 'C' AND c.a = d.a CROSS JOIN pd WHERE d.kind = 'D' "
    "UNION ALL SELECT 'length', m::VARCHAR, round(coalesce((SELECT c FROM l WHERE l.m = r.m), 0)::DOUBLE / (SELECT sum(c) FROM l), 10), round(coalesce((SELECT sum(c) FROM l WHERE l.m >= r.m), 0)::DOUBLE / (SELECT sum(c) FROM l), 10) FROM (SELECT unnest(range(1, 11)) AS m) r",
    "foreign_shapes": f"WITH {_FOREIGN} SELECT g, c FROM fg UNION ALL SELECT m::VARCHAR, c FROM fs",
    "foreign_scores": f"WITH {_FOREIGN}, ma AS (SELECT coalesce(sum(n) FILTER (n >= 40), 0) AS kept, coalesce(sum(n) FILTER (n < 40), 0) AS left_ FROM fn), f2 AS (SELECT left(g, 2) AS h, sum(c) AS c FROM fg GROUP BY 1), "
    f"w AS (SELECT DISTINCT unnest({_UNITS.format(x='text')}) AS w FROM benchmark), nw AS (SELECT w, '^^' || w || '$' AS e, length(w) AS m FROM w WHERE w NOT IN (SELECT w FROM fn WHERE n >= 40) AND regexp_full_match(w, '[a-z]+') AND length(w) BETWEEN 5 AND 16), "
    "tg AS (SELECT w, m, e[i:i + 2] AS g FROM (SELECT w, m, e, unnest(range(1, length(e) - 1)) AS i FROM nw)), sh AS (SELECT w, m, sum(log10((coalesce(fg.c, 0) + 0.5e0) / (coalesce(f2.c, 0) + 13.5e0))) AS lp FROM tg LEFT JOIN fg ON tg.g = fg.g LEFT JOIN f2 ON left(tg.g, 2) = f2.h GROUP BY 1, 2), "
    "sx AS (SELECT w, lp + log10((coalesce(fs.c, 0) + 1e0) / ((SELECT coalesce(sum(c), 0) FROM fs) + 12)) AS shape FROM sh LEFT JOIN fs ON sh.m = fs.m), "
    "lp AS (SELECT w.w, CASE WHEN fn.n IS NOT NULL THEN log10(fn.n::DOUBLE / (kept + left_)) WHEN shape IS NOT NULL AND left_ > 0 THEN log10(left_::DOUBLE / (kept + left_)) + shape END AS lp FROM w CROSS JOIN ma LEFT JOIN fn ON w.w = fn.w AND fn.n >= 40 LEFT JOIN sx ON w.w = sx.w) "
    "SELECT w, round(lp, 6) AS lp, coalesce(lp > -5.5e0 - length(w) % 2 + 0.5e0, false) AS takes FROM lp",
    "variant_caps": "WITH p AS (SELECT p_brand AS reading, p_size::VARCHAR AS word, max(p_retailprice) AS score FROM part GROUP BY 1, 2), b AS (SELECT reading, score AS top FROM p WHERE word = '50') "
    "SELECT p.reading, word, round(CASE WHEN word IN ('1', '2', '3') AND top IS NOT NULL THEN least(score, top - 0.01) ELSE score END, 4) AS score FROM p LEFT JOIN b ON p.reading = b.reading",
    "landings": "SELECT word, last FROM (SELECT p_partkey AS word, first_value(p_partkey) OVER w AS last FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)) WHERE word <> last",
    "admissions": f"WITH w AS (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_UNITS.format(x='text')}) AS w FROM documents) GROUP BY w), k AS (SELECT DISTINCT unnest({_UNITS.format(x='text')}) AS w FROM benchmark) "
    "SELECT CASE WHEN k.w IS NOT NULL THEN 'known' WHEN df < 3 THEN 'rare' WHEN length(w.w) < 4 THEN 'short' ELSE 'kept' END AS stage, count(*) AS n FROM w LEFT JOIN k ON w.w = k.w GROUP BY 1",
    "substring_counts": f"WITH b AS (SELECT unnest({_UNITS.format(x='text')}) AS w FROM benchmark), c AS (SELECT DISTINCT unnest([left(w, 3), left(w, 4)]) AS w FROM b WHERE length(w) >= 4), "
    "x AS (SELECT unnest(list_concat(list_transform(range(1, length(text) - 1), lambda i: text[i:i + 2]), list_transform(range(1, length(text) - 2), lambda i: text[i:i + 3]))) AS w FROM benchmark) SELECT c.w, count(x.w) AS c FROM c LEFT JOIN x ON c.w = x.w GROUP BY c.w",
    "literal_counts": "SELECT doc_id, (length(text) - length(replace(text, left(text, 4), ''))) // 4 AS n FROM documents WHERE length(text) >= 4",
    "sample_cap": "SELECT least(300000, sum(length(text)))::BIGINT AS chars FROM documents",
    "longest_forms": "WITH g AS (SELECT item_id, array_to_string(list_transform(regexp_extract_all(replace(text, 'é', 'e'), '(?s)the|and|ion|an|th|.'), lambda x: CASE x WHEN 'th' THEN '1' WHEN 'the' THEN '2' WHEN 'an' THEN '3' WHEN 'and' THEN '4' WHEN 'ion' THEN '5' ELSE x END), '') AS t FROM benchmark) SELECT item_id, sha256(t) AS h FROM g",
    "version_order": "SELECT string_agg('v1.' || n_regionkey || '.' || n_nationkey, ' ' ORDER BY n_regionkey, n_nationkey) AS versions FROM nation",
    "text_forms": "WITH p AS (SELECT p_partkey, p_name AS s, p_type AS t, length(regexp_replace(p_name, '[^ae]', '', 'g')) AS r, length(regexp_replace(p_name, '[^o]', '', 'g')) AS m, length(regexp_replace(p_name, '[^r]', '', 'g')) AS tr FROM part), "
    "f AS (SELECT *, list_distinct(['ab', 'abc', 'a' || left(s, 2) || 'b', 'a' || left(s, 2) || 'bc']) AS fs FROM p) "
    "SELECT p_partkey, CASE WHEN r > 0 AND r >= tr THEN 'simp' WHEN r = 0 AND m > 0 AND tr = 0 THEN 'marker' ELSE 'trad' END AS kind, array_to_string(list_sort(fs), '|') AS forms, "
    "CASE WHEN suffix(t, 'TIN') AND length(t) >= 5 THEN left(t, length(t) - 3) WHEN suffix(t, 'EL') AND length(t) >= 4 THEN left(t, length(t) - 2) WHEN suffix(t, 'L') AND length(t) >= 3 THEN left(t, length(t) - 1) ELSE t END AS stem, translate(lower(t), 'ze', 'si') AS merged, "
    "array_to_string(list_filter([trim(t), trim(s)], lambda q: length(q) BETWEEN 2 AND 40), '|') AS names, array_to_string(list_filter(regexp_split_to_array(s, '\\s+'), lambda q: regexp_full_match(q, '[A-Za-zÀ-ÖØ-öø-ÿ]+') AND length(q) BETWEEN 2 AND 6), '|') AS clauses, "
    "true AS fits, CASE WHEN p_partkey % 2 = 0 THEN '^' || left(s, 1) ELSE 'k' END AS key, round(log10(list_sum(list_transform(range(1, 5), lambda i: power(10e0, -(i + p_partkey % 7))))), 8) AS sum FROM f",
}


def sql(bi: str) -> dict[str, str]:
    return {**{n: q.replace("{BI}", bi) for n, q in _MODEL_SQL.items()}, **_OTHER_SQL}
