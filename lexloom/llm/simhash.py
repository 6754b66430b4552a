"""SimHash near-duplicates with pivot distance tables.

Fingerprints: texts are lower-cased on A-Z; XXH64 (seed 42) of every 3-word shingle, repeats included, votes on 64 bits.
Documents link where fingerprints differ in ``RADIUS`` bits or fewer; a class is a connected component.

Search: equal fingerprints collapse first, so exact copies of any number cost one row.  Distances to random reference
fingerprints alone cannot split 64-bit data (they concentrate near 32), so the references come in two sets.  The
single-bit references of a block give, by their distances, the block's bits: two fingerprints at most 2 apart agree on
2 of 4 blocks, hence on all coordinates of those references, and meet in one of 6 tables.  Inside a table's bucket the
distances to ``PIVOTS`` random references discard pairs by their largest coordinate difference (triangle inequality)
and the survivors are verified by their own distance.  A bucket of more than ``BUCKET`` fingerprints is dealt again by
references on finer blocks of its free bits (32, then 16, then 8 free bits: 256 fingerprints at most), so no task holds
a large bucket.  A bucket emits a link from each member to the least member it reaches, never all pairs.

Edge cases: a null or empty text, or one of white space, has fingerprint zero and links like any other; fewer than 3
words are one shingle; repeated rows give a row each; null ids never become a class id unless a class has no other;
an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, table, text_bytes
from .textvec import mix, popcount

SEED, SHINGLE, RADIUS = 42, 3, 2
PIVOTS = 16
BUCKET = 2048
BLOCKS = 4
#: Bits that each level of dealing leaves free.
FREE = (64, 32, 16)


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of a UTF-8 text."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return 0
    s = map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)))) if len(w) >= SHINGLE else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(SEED)), np.uint64)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        votes += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in text_bytes(b.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint) for every row, and the string row where docs has one."""
    row = ["row"] if "row" in docs.columns else []
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    return d.mapInArrow(_fingerprints, "doc_id long, fp long" + ", row string" * len(row))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _children(mask: int, free: int) -> list[int]:
    """Masks that add to an agreed mask two of the four blocks of its free bits."""
    bits = [k for k in range(64) if not mask >> k & 1][:free]
    size = free // BLOCKS
    blocks = [sum(1 << b for b in bits[k * size : (k + 1) * size]) for k in range(BLOCKS)]
    return [mask | blocks[a] | blocks[b] for a, b in combinations(range(BLOCKS), BLOCKS - RADIUS)]


def _groups(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(mask, fingerprints, large) for the runs of equal (mask, key) of a sorted stream; runs over the limit come in pieces."""
    held, key, large = [], None, False

    def out(end: bool):
        nonlocal held
        fp = np.concatenate(held) if held else np.zeros(0, np.int64)
        if len(fp) > 1 or large and len(fp):
            held = []
            yield key[0], fp, large
        elif end:
            held = []

    for b in batches:
        m, k, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(fp):
            continue
        cut = np.concatenate(([0], np.flatnonzero((np.diff(m) != 0) | (np.diff(k) != 0)) + 1, [len(fp)]))
        sizes = np.diff(cut)
        for g in np.unique(np.concatenate(([0], np.flatnonzero(sizes > 1), [len(sizes) - 1]))):
            lo, hi = cut[g], cut[g + 1]
            if key != (m[lo], k[lo]):
                yield from out(True)
                key, held, large = (m[lo], k[lo]), [], False
            held.append(fp[lo:hi])
            if limit and sum(map(len, held)) > limit:
                large = True
                yield from out(False)
    if key is not None:
        yield from out(True)


def bucket_links(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For distinct fingerprints of one bucket: the least member that each reaches by links inside the bucket."""
    x = np.sort(fp).view(np.uint64)
    table_ = popcount(x[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(table_[:, 0], kind="stable")
    first = table_[order, 0]
    a, b = [], []
    for lo in range(0, len(x), 256):
        rows = order[lo : lo + 256]
        cols = order[lo : np.searchsorted(first, first[min(lo + 255, len(x) - 1)] + RADIUS, "right")]
        near = np.ones((len(rows), len(cols)), bool)
        for p in range(table_.shape[1]):
            near &= np.abs(table_[rows, p][:, None] - table_[cols, p][None, :]) <= RADIUS
        i, j = np.nonzero(near)
        i, j = rows[i], cols[j]
        sure = (i != j) & (popcount(x[i] ^ x[j]) <= RADIUS)
        a.append(i[sure])
        b.append(j[sure])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(x))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return x.view(np.int64), x[label].view(np.int64)
        label = new


def _linker(limit: int | None):
    pivots = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, fp, large in _groups(batches, limit):
            if large:
                a, b, m = fp, fp, np.full(len(fp), mask)
            else:
                a, b = bucket_links(fp, pivots)
                a, b = a[a != b], b[a != b]
                m = np.zeros(len(a), np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int64())], ["a", "b", "m"])

    return run


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that join every two distinct fingerprints at most RADIUS apart, directly or through others."""
    found, todo, masks = None, distinct.select("fp", F.lit(0).cast("long").alias("m")), [0]
    for level, free in enumerate(FREE):
        children = {m: _children(m, free) for m in masks}
        deal = F.expr("map(" + ", ".join(f"{_signed(m)}L, array({', '.join(f'{_signed(c)}L' for c in cs)})" for m, cs in children.items()) + ")[m]")
        d = todo.select("fp", F.explode(deal).alias("m")).select("m", F.col("m").bitwiseAND(F.col("fp")).alias("k"), "fp")
        d = d.repartition("m", "k").sortWithinPartitions("m", "k")
        last = level == len(FREE) - 1
        out = checkpoint(d.mapInArrow(_linker(None if last else BUCKET), "a long, b long, m long"))
        part = out.where("m = 0").select("a", "b")
        found = part if found is None else found.unionByName(part)
        todo = out.where("m <> 0").select(F.col("a").alias("fp"), "m").distinct()
        masks = [c for cs in children.values() for c in cs]
        if last or todo.isEmpty():
            return found


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row, and the string row where docs has one; root is a class's own fingerprint."""
    f = checkpoint(fingerprints(docs))
    distinct = checkpoint(f.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(links(distinct))
    root = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"))
    return f.join(root.join(ids, "root").select("fp", "root", "component_id"), "fp").select(*f.columns, "root", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
