"""Rule bitmask ledger: every rule runs once, policies are masks over the stored bits.

``ledger`` measures each document in one pass over its text, stores the measurements and one failure bit a rule.
A policy is a versioned mask; ``apply_policy`` keeps a document if ``failures & mask = 0`` and ``ablation`` counts, from
the bits alone, what each rule of a policy removes and what it alone removes.  Built-in functions only.

Edge cases: a null or empty text has no words and fails ``few_words``; rows are judged one by one, so repeated rows and
repeated or null ids give one ledger row each; input columns with clashing names are not read beyond ``doc_id`` and
``text``; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MIN_WORDS = 10
#: name -> predicate over the measurements that fails a document; the bit is the position.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeated_5grams": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "shouting": "n_shouts >= 10 AND 10 * n_shouts > 3 * n_words",
}
BASE = ("few_words", "repeated_5grams")
POLICIES = {"v1": BASE + ("symbols", "repeated_lines"), "v2": tuple(RULES)}
ACTIVE = "v2"

_SEP = r"[\\x20\\x09-\\x0D]+"
#: Words covered by 5-word windows that occur twice or more; sorting is skipped where no window repeats.
_REPEATS = """
CASE WHEN size(w) < 6 THEN 0L ELSE
 transform(array(transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))), g ->
  CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE
   transform(array(sort_array(transform(g, (h, i) -> named_struct('h', h, 'i', i)))), e ->
    transform(array(sort_array(transform(
      filter(sequence(0, size(e) - 1), j -> (j > 0 AND e[j].h = e[greatest(j - 1, 0)].h)
        OR (j < size(e) - 1 AND e[j].h = e[least(j + 1, size(e) - 1)].h)), j -> e[j].i))), s ->
     aggregate(transform(s, (p, k) -> CASE WHEN k = size(s) - 1 THEN 5L
        ELSE CAST(least(5, s[least(k + 1, size(s) - 1)] - p) AS BIGINT) END), 0L, (a, b) -> a + b))[0])[0]
  END)[0]
END"""
_MEASURES = f"""
transform(array(array_remove(split(t, '{_SEP}'), '')), w -> named_struct(
  'n_words', CAST(size(w) AS BIGINT), 'n_repeat_words', {_REPEATS}))[0]"""
_LINES = """
transform(array(filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')), l -> named_struct(
  'n_lines', CAST(size(l) AS BIGINT), 'n_dup_lines', CAST(size(l) - size(array_distinct(l)) AS BIGINT)))[0]"""


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, measurements..., failures bigint): bit k is set if rule k of ``RULES`` fails."""
    t = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    m = t.select(
        "doc_id",
        F.expr(_MEASURES).alias("m"),
        F.expr(_LINES).alias("l"),
        F.expr(r"CAST(char_length(t) - regexp_count(t, '[\\x20\\x09-\\x0D]') AS BIGINT)").alias("word_chars"),
        F.expr("CAST(regexp_count(t, '[#*$%&|<>]') AS BIGINT)").alias("n_symbols"),
        F.expr("CAST(regexp_count(t, '!!') AS BIGINT)").alias("n_shouts"),
    ).select("doc_id", "m.*", "word_chars", "n_symbols", "n_shouts", "l.*")
    bits = " | ".join(f"shiftleft(CAST({p} AS BIGINT), {k})" for k, p in enumerate(RULES.values()))
    return m.withColumn("failures", F.expr(bits))


def mask(policy: str | tuple[str, ...]) -> int:
    """Bits of a policy, by version or by the names of its rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << k for k, name in enumerate(RULES) if name in names)


def apply_policy(rows: DataFrame, policy: str | tuple[str, ...] = ACTIVE) -> DataFrame:
    """``base_failed`` and ``kept`` from the stored bits; the text is not read again."""
    base = F.col("failures").bitwiseAND(F.lit(mask(BASE))) != 0
    fails = F.col("failures").bitwiseAND(F.lit(mask(policy) | mask(BASE))) != 0
    return rows.withColumns({"base_failed": base, "kept": ~fails})


def ablation(rows: DataFrame, policy: str | tuple[str, ...] = ACTIVE) -> DataFrame:
    """For each rule of a policy: documents that fail it, and that only this rule of the policy removes."""
    p = mask(policy)
    held = F.col("failures").bitwiseAND(F.lit(p))
    names = [n for k, n in enumerate(RULES) if p >> k & 1]
    bit = {n: 1 << list(RULES).index(n) for n in names}
    sums = rows.agg(
        *[F.sum((held.bitwiseAND(F.lit(bit[n])) != 0).cast("long")).alias(f"f_{n}") for n in names],
        *[F.sum((held == F.lit(bit[n])).cast("long")).alias(f"o_{n}") for n in names],
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(f"f_{n}", F.lit(0)).alias("n_failed"), F.coalesce(f"o_{n}", F.lit(0)).alias("n_only")) for n in names])
    return sums.select(F.inline(pairs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_shouts", "failures"
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i:i + 4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
s AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(s.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '!!'))::BIGINT AS n_shouts
      FROM w LEFT JOIN s ON w.rid = s.rid),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
        + 8 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
        + 32 * (word_chars > 25 * n_words)::BIGINT + 64 * (n_shouts >= 10 AND 10 * n_shouts > 3 * n_words)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed,
  failures = 0 AS kept, n_lines, n_shouts, failures FROM f
"""
