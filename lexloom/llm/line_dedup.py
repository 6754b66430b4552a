"""Line dedup by winnowing over line hashes.

A document is the sequence of the 128-bit hashes of its non-blank lines, white space at their ends removed.  A window is
the fewest consecutive lines from a line on that have ``LEAST`` words together.  The least hash of a window (the last of
equals) is selected as a fingerprint, once however many windows select it.  A run of lines that stands in two places and
has ``LEAST`` words or more holds a whole window in both, which selects the same line in both: no such run is missed.

Fingerprints that are selected in one place only are dropped.  The others are extended both ways: by the fewest lines to
the right and by the fewest to the left that make the guaranteed run, as the keys of the runs around them.  A run's key is
joined to the first place, in the order of doc_id and line, where that run stands; later places are deleted.  Every line
of a longer repeated run lies in one of these, so the deleted lines are exactly those of the repeated runs.  Positions are
judged on the input, so what is kept never depends on what else is deleted.

A repeated fingerprint never lists its pairs: it is counted, and only the first place of a run is kept (both with partial
aggregation) and joined back.

Edge cases: null and empty texts have no lines and stay as they are; texts of any length are read whole; blank lines are
never deleted and do not part a run; a repeated run of fewer words than ``least`` stays; null ids come after all others;
rows with the same doc_id and text count as one document, so none of them is a repeat of the other; an empty table gives
an empty result.  Other columns are carried unchanged whatever their names; those named n_lines or n_removed are carried
as n_lines_in and n_removed_in.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, ordered_id, table, text_bytes

#: Words of the shortest run that is sure to be found.
LEAST = 5
_HALF = 1 << 63


def fingerprints(text: bytes, least: int = LEAST) -> Iterator[tuple[int, int, bool, list[int]]]:
    """(fingerprint, key of a run around it, whether it is the fingerprint's first run here, line numbers of the run) of a text."""
    import xxhash

    lines = [(k, s) for k, line in enumerate(text.split(b"\n")) if (s := line.strip())]
    hashes = [xxhash.xxh3_128_intdigest(s) for _, s in lines]
    upto = list(accumulate((len(s.split()) for _, s in lines), initial=0))
    runs: dict[tuple[int, int], int] = {}  # run -> line of its fingerprint
    ahead: dict[int, int] = {}
    for a in range(len(lines)):
        b = bisect_left(upto, upto[a] + least)
        if b < len(upto):
            ahead[a] = min(range(a, b), key=lambda k: (hashes[k], -k))
            runs[a, b] = ahead[a]
    for b in range(1, len(upto)):
        if upto[b] >= least:
            a = bisect_right(upto, upto[b] - least) - 1
            runs.setdefault((a, b), ahead[a])
    told = set()
    for (a, b), k in runs.items():
        key = hashes[a] if b == a + 1 else xxhash.xxh3_128_intdigest(b"".join(h.to_bytes(16) for h in hashes[a:b]))
        yield (hashes[k] >> 64) - _HALF, (key & (1 << 64) - 1) - _HALF, k not in told, [i for i, _ in lines[a:b]]
        told.add(k)


def _rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for i, t in enumerate(text_bytes(b.column(2))):
            for found in fingerprints(t or b"", least):
                for x, v in zip(out, (*found, i), strict=True):
                    x.append(v)
        at = pa.array(out[4], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.list_(pa.int32())), b.column(0).take(at), b.column(1).take(at)],
            ["fp", "run", "own", "lines", "o", "h"],
        )


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(o, h, gone): the numbers of the lines that go, for documents (o, h, text) that lose any."""
    rows = docs.select("o", "h", "text").mapInArrow(partial(_rows, least=least), "fp long, run long, own boolean, lines array<int>, o long, h long")
    shared = checkpoint(rows.groupBy("fp").agg(F.sum(F.col("own").cast("long")).alias("n")).where("n > 1"))
    met = join_hot(rows, shared, ["fp"], "n").select("fp", "run", "lines", "o", "h")
    here = F.struct("o", "h", F.col("lines")[0].alias("at"))
    first = checkpoint(met.groupBy("fp", "run").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = join_hot(met, first, ["fp", "run"], "n").where(here > F.col("first"))
    return later.select("o", "h", F.explode("lines").alias("line")).groupBy("o", "h").agg(F.collect_set("line").alias("gone"))


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the repeated lines deleted from text, and n_lines and n_removed."""
    text = F.col("text").cast("string")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ordered_id().alias("o"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), text.alias("text"))
    d = d.join(repeated_lines(d, least), ["o", "h"], "left")
    cut = F.expr("transform(array(split(text, '\\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), gone), i -> l[i]), '\\n'))[0]")
    n = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut)
    carried = [kept.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c + "_in" * (c in ("n_lines", "n_removed"))) for c in docs.columns]
    return d.select(*carried, n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return d.select("doc_id", "n_lines", "n_removed", F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


#: The runs themselves, without fingerprints: from each line on, and up to each line, the fewest lines of 5 words or more.
SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS line, regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s, s AS raw FROM
  (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
n AS (SELECT doc_id, line, s, row_number() OVER w AS k, sum(len(regexp_extract_all(s, '[^\x20\x09-\x0D]+'))) OVER w AS c FROM l WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
d AS (SELECT doc_id, list(s ORDER BY k) AS ss, list(line ORDER BY k) AS ls, list(c::BIGINT ORDER BY k) AS cs FROM n GROUP BY doc_id),
p AS (SELECT doc_id, ss, ls, cs, unnest(range(1, len(cs) + 1)) AS k FROM d),
r AS (SELECT doc_id, ss, ls, k AS a, len(list_filter(cs, lambda x: x < cs[k] - len(regexp_extract_all(ss[k], '[^\x20\x09-\x0D]+')) + 5)) + 1 AS b, len(cs) AS m FROM p
  UNION ALL SELECT doc_id, ss, ls, len(list_filter(cs, lambda x: x <= cs[k] - 5)) + 1 AS a, k AS b, len(cs) AS m FROM p WHERE cs[k] >= 5),
x AS (SELECT DISTINCT doc_id, a, b, ls[a:b] AS lines, array_to_string(ss[a:b], chr(10)) AS run FROM r WHERE b <= m),
y AS (SELECT doc_id, lines, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS k FROM x),
g AS (SELECT DISTINCT doc_id, unnest(lines) AS line FROM y WHERE k > 1),
k AS (SELECT l.doc_id, count(*) FILTER (l.s <> '') AS n_lines, count(g.line) AS n_removed,
  coalesce(string_agg(l.raw, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '') AS t FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, length(t) AS kept_chars, sha256(t) AS kept_sha256 FROM k
"""
