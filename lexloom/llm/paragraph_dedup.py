"""Substring dedup by paragraph MinHash banding.

A paragraph is a line of ``MIN_WORDS`` words or more.  Its shingles are the sets of 5 lower-cased words; ``BANDS`` bands
of ``ROWS`` minima are tuned for recall: a pair of similarity 0.8 meets in a band with probability 1 - (1 - 0.8^3)^10 =
0.9992.  Equal paragraphs collapse first.  Paragraphs that meet in a band are verified by the exact Jaccard similarity
of their shingles (``SIMILARITY`` or more), linked paragraphs form components, and all but the first paragraph of a
component, in the order of doc_id and line, are removed.

A passage that two long paragraphs share does not make them similar, so each document is also cut into pieces at places
that its words alone decide: before the word pair whose hash is least among those of ``REACH`` words on either side, and
around runs of one word.  A passage is cut alike wherever it stands, but for its ends.  A piece that also stands in a
document with a smaller doc_id is repeated; repeated pieces that follow one another and have ``MIN_WORDS`` words or more
are a passage and are removed.  Pieces are compared whole, so they need no bands.

A band never lists all pairs of a large group.  Up to ``BLOCK`` texts meet each other.  Texts of a larger band meet a few
hubs first, then more; in the end every text outside the band's largest component meets the texts of other components by
the rarest of its shingles, of which similar texts share one at a place that lets them share enough (an exact filter).
So every two texts of a band are compared, joined or cannot be similar, and no link between components is missed.

Edge cases: null and empty texts have no paragraph and no piece; lines under MIN_WORDS words are removed only within a
passage; null ids come after all others; rows with the same doc_id and text count as one document; rows that share a
doc_id, or have none, never lose a passage to each other (paragraphs they do, by line); texts of any length are read
whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, forget, join_hot, ordered_id, release, shrink, shuffle_parts, stored, table, text_bytes
from .textvec import lower, mix, prefix, sliding_min, span_hash, word_spans

MIN_WORDS, SHINGLE, SIMILARITY = 20, 5, 0.8
BANDS, ROWS = 10, 3
#: Words on either side of a cut that decide on it; pieces have more words than this, about twice as many on average.
REACH = 7
BLOCK, HUB_BLOCK, HUB_BYTES = 16, 32, 16 << 20
#: Hubs of a large band in each round before the last.
HUBS = (4, 64)
_MULT = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1))[None, :]
_OTHER = np.uint64(0xD1B54A32D192ED03)


class Words:
    """Words of a text: where they start and end, their hashes, and hashes of any run of them."""

    def __init__(self, text: bytes):
        data = lower(np.frombuffer(text, np.uint8))
        self.start, self.end = word_spans(data)
        self.line = np.searchsorted(np.flatnonzero(data == 10), self.start)
        self.hash = span_hash(prefix(data), self.start, self.end)
        self.sums = prefix(self.hash), prefix(mix(self.hash ^ _OTHER))

    def runs(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the words lo to hi."""
        return span_hash(self.sums[0], lo, hi), span_hash(self.sums[1], lo, hi)

    def paragraphs(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each line of min_words words or more, and the word after its last."""
        cut = np.concatenate(([0], np.flatnonzero(np.diff(self.line)) + 1, [len(self.line)])) if len(self.line) else np.zeros(1, np.int64)
        keep = np.diff(cut) >= min_words
        return cut[:-1][keep], cut[1:][keep]

    def pieces(self, reach: int = REACH) -> np.ndarray:
        """Borders of the pieces: 0, the cuts, the number of words."""
        h, n = self.hash, len(self.hash)
        if n < 2:
            return np.array([0, n] if n else [0])
        v = mix(h * np.uint64(3) + np.concatenate((h[1:], h[:1])))
        same = np.concatenate(([False], h[1:] == h[:-1]))
        v[same] = np.iinfo(np.uint64).max  # inside a run of one word there is no cut
        edge = np.full(reach, np.iinfo(np.uint64).max)
        least = sliding_min(np.concatenate((edge, v, edge)), 2 * reach + 1)
        cut = np.flatnonzero((v == least) & ~same)
        ends = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        long = np.diff(ends)[::2] >= 2 * reach
        return np.unique(np.concatenate(([0], cut, ends[::2][long] - 1, ends[1::2][long], [n])))


def shingles(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, with repeats, of the runs of words lo to hi, and where each run's begin; fewer words than a shingle are one."""
    h = np.concatenate((h, np.zeros(SHINGLE, np.uint64)))
    n = np.maximum(hi - lo - SHINGLE + 1, 1)
    at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    most = np.repeat(hi, n)
    s = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        s = s * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < most, h[at + k], np.uint64(k + 1))
    return mix(s), np.concatenate(([0], np.cumsum(n)))


def bands(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band keys of each paragraph of a text, one row a paragraph."""
    least = np.empty((len(at) - 1, BANDS * ROWS), np.uint64)
    lo = 0
    while lo < len(least):  # blocks of paragraphs, so that long texts need little memory
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 14), "right")) - 1)
        least[lo:hi] = np.minimum.reduceat(shingles[at[lo] : at[hi], None] * _MULT, at[lo:hi] - at[lo], axis=0)
        lo = hi
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(least), BANDS))
    for r in range(ROWS):
        key = mix(key * np.uint64(31) + least[:, r::ROWS])
    return key


def distinct(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of distinct shingles of each paragraph."""
    who = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((shingles, who))
    s, w = shingles[order], who[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (w[1:] != w[:-1])))
    return np.bincount(w[new], minlength=len(at) - 1)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(k, rows) for k in range(0, b.num_rows, rows))


UNITS = "o long, h long, line array<int>, dig array<binary>, size array<int>, bands array<bigint>, p1 array<bigint>, p2 array<bigint>"


def _digests(a: np.ndarray, b: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(np.stack((a, b), axis=1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, empty = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in _few(batches):
            n, m, cols = [], [], [[none], [empty], [empty], [none], [empty], [empty], [empty]]
            for t in text_bytes(b.column(2)):
                w = Words(t or b"")
                lo, hi = w.paragraphs(min_words)
                cut = w.pieces()
                n.append(len(lo))
                m.append(len(cut) - 1)
                found = [w.line[lo], *w.runs(lo, hi), none, empty, *w.runs(cut[:-1], cut[1:])]
                if len(lo):
                    s, at = shingles(w.hash, lo, hi)
                    found[3], found[4] = distinct(s, at), bands(s, at).ravel()
                for c, x in zip(cols, found, strict=True):
                    c.append(x)
            line, d1, d2, size, keys, p1, p2 = map(np.concatenate, cols)
            at, cut = (np.concatenate(([0], np.cumsum(x))).astype(np.int32) for x in (n, m))
            long = lambda x: pa.array(x.view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.array(line.astype(np.int32))), pa.ListArray.from_arrays(at, _digests(d1, d2)), pa.ListArray.from_arrays(at, pa.array(size.astype(np.int32))),
                    pa.ListArray.from_arrays(at * BANDS, long(keys)), pa.ListArray.from_arrays(cut, long(p1)), pa.ListArray.from_arrays(cut, long(p2)),
                ],
                ["o", "h", "line", "dig", "size", "bands", "p1", "p2"],
            )

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From band rows sorted by key: the pairs of bands of up to BLOCK texts, and the members of larger bands (``large``)."""

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = zip(*([np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)], *out), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ["k", "a", "b", "size", "n", "large"])

    def settle(k: int, m: np.ndarray, large: bool) -> tuple:
        if large:
            same = np.full(m.shape[1], k, np.int64)
            return same, m[0], same, m[1], m[2], np.ones(len(same), bool)
        i, j = np.triu_indices(m.shape[1], 1)
        near = 5 * np.minimum(m[1, i], m[1, j]) >= 4 * np.maximum(m[1, i], m[1, j])
        x, y = m[0, i[near]], m[0, j[near]]
        none = np.zeros(len(x), np.int64)
        return none, np.minimum(x, y), np.maximum(x, y), none, none, np.zeros(len(x), bool)

    key, held, large = None, np.zeros((3, 0), np.int64), False
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(0).to_numpy(zero_copy_only=False)
        m = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2, 3)])
        large = large and k[0] == key
        if held.shape[1]:
            k, m = np.concatenate((np.full(held.shape[1], key), k)), np.concatenate((held, m), axis=1)
        cut = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
        size = np.diff(cut)
        out = []
        for g in np.flatnonzero((size > 1) | (np.arange(len(size)) == 0))[: None if len(size) > 1 else 0]:
            if g < len(size) - 1 and (size[g] > 1 or large and g == 0):
                out.append(settle(int(k[cut[g]]), m[:, cut[g] : cut[g + 1]], size[g] > BLOCK or large and g == 0))
        large = bool(large and len(size) == 1) or bool(size[-1] > BLOCK)
        key, held = int(k[-1]), m[:, cut[-2] :]
        if large:  # a large band streams through
            out.append(settle(key, held, True))
            held = held[:, :0]
        yield batch(out)
    if held.shape[1] > 1:
        yield batch([settle(key, held, large)])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the wanted lines of a document."""
    for b in _few(batches):
        digs, sets = [], [np.zeros(0, np.uint64)]
        for t, want in zip(text_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
            lines = {x["line"]: x["dig"] for x in want}
            w = Words(t or b"")
            lo, hi = w.paragraphs(1)
            keep = np.array([k in lines for k in w.line[lo].tolist()], bool)
            lo, hi = lo[keep], hi[keep]
            if len(lo):
                s, at = shingles(w.hash, lo, hi)
                digs += [lines[k] for k in w.line[lo].tolist()]
                sets += [np.unique(s[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        ends = np.cumsum([len(x) for x in sets]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(digs, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], ["dig", "s"])


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, da, db): the pairs whose shingle sets are similar, as short names and digests."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("dig").alias("da"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("dig").alias("db"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return checkpoint(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b", "da", "db"))


def _rounds(large: DataFrame, links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All links needed for the components of large bands.

    In each round a few hubs of a band meet its members in other components, so that groups of copies become components.
    Members of a band's largest component are joined already; the others then meet all members in other components by
    prefixes, and after that any two members have been compared or cannot be similar.  Hubs travel in blocks with their
    sets, so that only links leave the row; blocks are broadcast while their sets hold HUB_BYTES or less, by count.
    """
    spark = large.sparkSession
    rows = large.count()
    if not rows:
        return links
    parts = max(shuffle_parts(spark), spark.sparkContext.defaultParallelism)  # few bytes, much work: not to be coalesced
    sets = shrink(sets, 8 * sets.count())  # a set weighs more than a row of numbers
    comp, new = None, links
    like = "h.id <> id AND h.c <> c AND 5 * least(size, h.size) >= 4 * greatest(size, h.size)"
    like += f" AND size(array_intersect(h.s, s)) * {1 + similarity}D >= {similarity}D * (size(s) + size(h.s)) - 1e-9D"
    for step in range(len(HUBS) + 1):
        edges = new.select("a", "b")  # components so far are stars, which join the new links
        comp = checkpoint(components(edges if comp is None else edges.unionByName(comp.select(F.col("node").alias("a"), F.col("root").alias("b")))))
        root = shrink(comp, comp.count()).select(F.col("node").alias("id"), "root")
        named = shrink(large, rows).join(root, "id", "left").select("k", "id", "size", "n", F.coalesce("root", "id").alias("c"))
        most = named.groupBy("k", "c").agg(F.count("*").alias("m")).groupBy("k").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.count("*").alias("comps")).where("comps > 1").select("k", "main")
        live = checkpoint(shrink(named, rows).join(most, "k"))
        rows = live.count()
        if not rows:
            return links
        large = live.select("k", "id", "size", "n")
        if step == len(HUBS):
            return links.unionByName(_verify(_prefixed(live, sets, similarity, rows), sets, similarity))
        rest = shrink(live, rows).where("c <> main") if step else shrink(live, rows)
        best = F.max(F.struct("n", "id", "size", "c"))
        rest = rest.groupBy("k", F.pmod(F.xxhash64("id"), F.lit(HUBS[step])).alias("slot")).agg(best.alias("hub")).select("k", F.floor(F.col("slot") / HUB_BLOCK).alias("block"), "hub.id", "hub.size", "hub.c")
        hubs = checkpoint(shrink(rest, rows))
        weight = hubs.agg(F.coalesce(F.sum(8 * F.col("size") + 64), F.lit(0))).first()[0]
        blocks = shrink(hubs, rows).join(sets, "id")
        blocks = (shrink(blocks, rows) if weight <= HUB_BYTES else blocks).groupBy("k", "block").agg(F.collect_list(F.struct("id", "size", "c", "dig", "s")).alias("hubs"))
        # a member's set is read once for all its bands; only hubs beyond HUB_BYTES make it travel to each band
        met = live.repartition(parts, "id").groupBy("id", "size", "c").agg(F.collect_list("k").alias("k")).join(sets.repartition(parts, "id"), "id")
        met = met.select("id", "size", "c", "dig", "s", F.explode("k").alias("k")).join(F.broadcast(blocks) if weight <= HUB_BYTES else blocks, "k")
        met = met.select("id", "dig", F.explode(F.expr(f"transform(filter(hubs, h -> {like}), h -> struct(h.id, h.dig))")).alias("h"))
        new = checkpoint(met.select(F.col("id").alias("a"), F.col("h.id").alias("b"), F.col("dig").alias("da"), F.col("h.dig").alias("db")))
        links = links.unionByName(new)
        forget(hubs)
        release(spark)


def _prefixed(live: DataFrame, sets: DataFrame, similarity: float, rows: int) -> DataFrame:
    """(a, b): pairs of a member outside its band's largest component and a member of another component that can be similar.

    Shingles are put in one order, rare ones first.  Two sets of n and m shingles are similar only if they share o =
    similarity / (1 + similarity) * (n + m) of them or more.  The first one they share stands at places i and j, and no
    more than n - i and m - j can be shared from there; so it is one of the first n - similarity * n + 1, and of the sizes m
    that are near enough to n only those with o <= n - i remain.  Sizes meet by classes of their logarithm.
    """
    t = similarity
    member = live.groupBy("id").agg(F.max("c").alias("c"), F.max((F.col("c") != F.col("main")).cast("int")).alias("outside"))
    token = shrink(member, rows).join(sets.select("id", "s"), "id").select("id", "c", "outside", F.size("s").alias("n"), F.explode("s").alias("t"))
    token = token.join(token.groupBy("t").agg(F.count("*").alias("df")), "t")
    order = token.groupBy("id").agg(F.first("c").alias("c"), F.first("outside").alias("outside"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    first = F.slice("o", F.lit(1), (F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1).cast("int"))
    head = checkpoint(order.select("id", "c", "outside", "n", F.posexplode(first).alias("i", "x")).where("x.df > 1").select("id", "c", "outside", "n", (F.col("n") - F.col("i")).alias("r"), F.col("x.t").alias("t")))
    kind = lambda x: F.floor(F.log(x.cast("double")) / np.log(1 / t) * 4)
    own = head.select(F.col("id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("m"), F.col("r").alias("q"), "t", kind(F.col("n")).alias("kind"))
    most = F.least(F.col("n") / t, F.col("r") * (1 + t) / t - F.col("n")) + 1e-9
    asked = head.where("outside = 1").withColumn("most", most).where(F.col("most") >= t * F.col("n") - 1e-9)
    asked = asked.withColumn("kind", F.explode(F.sequence(kind(t * F.col("n") - 1e-9), kind(F.col("most")))))
    share = t / (1 + t) * (F.col("n") + F.col("m")) - 1e-9
    near = (F.col("c") != F.col("cb")) & (F.col("m") <= F.col("most")) & (F.col("m") >= t * F.col("n") - 1e-9) & (F.col("q") >= share)
    met = asked.join(own, ["t", "kind"]).where(near)
    return checkpoint(met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct())


def clusters(d: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """(dig, keep): every repeated paragraph text and the place of the first paragraph of its component."""
    spark = d.sparkSession
    own = F.transform(F.sequence(F.lit(0), F.size("line") - 1), lambda k: F.slice("bands", k * BANDS + 1, F.lit(BANDS)))
    rows = units.where("size(line) > 0").select("o", "h", F.inline(F.arrays_zip("line", "dig", "size", own.alias("bands"))))
    place = F.struct("o", "h", "line")
    reps = stored(rows.groupBy("dig").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    # a band row names its text by 64 bits of the digest: a chance match adds a pair to verify, no more
    short = F.xxhash64("dig").alias("id")
    b = reps.select(F.explode("bands").alias("k"), short, "size", F.least("n", F.lit(1 << 30)).cast("int").alias("n"))
    release(spark)
    met = checkpoint(b.repartition("k").sortWithinPartitions("k").mapInArrow(_meet, "k long, a long, b long, size long, n long, large boolean"))
    pairs = checkpoint(met.where("NOT large").select("a", "b").distinct())
    large = checkpoint(met.where("large").select("k", F.col("a").alias("id"), "size", "n"))
    forget(met)
    release(spark)
    want = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(large.select("id")).distinct().join(reps.select("dig", "first", short), "id")
    want = want.groupBy(F.col("first.o").alias("o"), F.col("first.h").alias("h")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "dig")).alias("want"))
    sets = d.select("o", "h", "text").join(want, ["o", "h"]).select("text", "want").mapInArrow(_sets, "dig binary, s array<bigint>")
    sets = checkpoint(sets.dropDuplicates(["dig"])).withColumn("id", short)
    release(spark)
    links = _rounds(large, _verify(pairs, sets, similarity), sets, similarity)
    comp = components(links.select(F.col("da").alias("a"), F.col("db").alias("b")))
    release(spark)
    joined = reps.join(comp, reps["dig"] == comp["node"], "left").select("dig", "first", "last", F.coalesce("root", "dig").alias("root"))
    keep = joined.groupBy("root").agg(F.min("first").alias("keep"), F.max("last").alias("last")).where("keep < last")
    return joined.join(keep.select("root", "keep"), "root").select("dig", "keep")


def repeated_pieces(units: DataFrame) -> DataFrame:
    """(o, h, pieces: array of (piece, doc_id)): the pieces that a document with a smaller doc_id has too, and the first such document."""
    rows = units.select("o", "h", F.posexplode(F.arrays_zip("p1", "p2")).alias("piece", "p")).select("o", "h", "piece", "p.p1", "p.p2")
    first = checkpoint(rows.groupBy("p1", "p2").agg(F.min("o").alias("first"), F.max("o").alias("last"), F.count("*").alias("n")).where("first < last").select("p1", "p2", "first", "n"))
    later = join_hot(rows, first, ["p1", "p2"], "n").where("o > first")
    return later.groupBy("o", "h").agg(F.array_sort(F.collect_set(F.struct("piece", F.col("first").alias("doc_id")))).alias("pieces"))


def cut(text: bytes, lines: set[int], pieces: dict[int, int], min_words: int = MIN_WORDS) -> tuple[bytes, list[tuple[int, int, int]]]:
    """A text without the lines and the passages of the pieces, and the passages as (first word, word after the last, doc_id of the first piece).

    A line that loses all its words to passages goes with its line break.
    """
    w = Words(text)
    border = w.pieces()
    passages: list[tuple[int, int, int]] = []
    run: list[int] = []
    for k in [*sorted(pieces), -1]:
        if run and k != run[-1] + 1:
            if border[run[-1] + 1] - border[run[0]] >= min_words:
                passages.append((int(border[run[0]]), int(border[run[-1] + 1]), pieces[run[0]]))
            run = []
        run.append(k)
    keep = np.ones(len(text), bool)
    for a, b, _ in passages:
        keep[w.start[a] : w.start[b] if b < len(w.start) and w.line[b] == w.line[b - 1] else w.end[b - 1]] = False
    out, at = [], 0
    for k, line in enumerate(text.split(b"\n")):
        here = keep[at : at + len(line)]
        if k not in lines:
            left = line if here.all() else np.frombuffer(line, np.uint8)[here].tobytes()
            if left.strip() or len(left) == len(line):
                out.append(left)
        at += len(line) + 1
    return b"\n".join(out), passages


def _cutter(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            texts, counts, gone = [], [], []
            for t, lines, pieces in zip(text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                counts.append(len(Words(t).paragraphs(min_words)[0]) if t else 0)
                kept, passages = (t, [])
                if t and (lines or pieces):
                    kept, passages = cut(t, {x["line"] for x in lines or ()}, {x["piece"]: x["doc_id"] for x in pieces or ()}, min_words)
                texts.append(kept)
                gone.append([{"start": x, "end": y, "doc_id": i} for x, y, i in passages])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("doc_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), b.column(2), pa.array(gone, kind)], ["doc_id", "text", "n_paragraphs", "removed", "passages"])

    return run


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text, n_paragraphs, removed: array of (line, keep doc_id), passages: array of (first word, word after the last, doc_id that has it too)) for every row; text without the removed."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ordered_id().alias("o"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), F.col("text").cast("string").alias("text"))
    units = stored(d.select("o", "h", "text").mapInArrow(_units(min_words), UNITS))
    pieces = checkpoint(repeated_pieces(units))
    release(docs.sparkSession)
    known = clusters(d.select("o", "h", "text"), units, similarity)
    gone = units.where("size(line) > 0").select("o", "h", F.inline(F.arrays_zip("line", "dig"))).join(known, "dig").where(F.struct("o", "h", "line") > F.col("keep"))
    gone = gone.groupBy("o", "h").agg(F.array_sort(F.collect_set(F.struct("line", F.col("keep.o").alias("doc_id")))).alias("removed"))
    gone = gone.join(pieces, ["o", "h"], "full")
    out = "doc_id long, text string, n_paragraphs long, removed array<struct<line: int, doc_id: bigint>>, passages array<struct<start: int, end: int, doc_id: bigint>>"
    return d.join(gone, ["o", "h"], "left").select("doc_id", "text", "removed", "pieces").mapInArrow(_cutter(min_words), out)


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup(table(spark, sf_dir, "documents"))
    keep = F.array_sort(F.array_distinct(F.concat(F.coalesce("removed.doc_id", F.array().cast("array<bigint>")), "passages.doc_id")))
    n = F.coalesce(F.size("removed"), F.lit(0)) + F.size("passages")
    return d.select("doc_id", "n_paragraphs", n.cast("long").alias("n_removed"), keep.alias("repeat_of"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
