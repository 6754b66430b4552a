"""Suffix-array dedup of repeated byte strings, by the common-prefix interval tree.

A byte goes if it lies in a ``MIN_LEN``-byte string that also starts in a document with a smaller doc_id.

A suffix array of the whole corpus would be sorted by sampling and ranges; here suffixes are dealt by content instead, so
that all suffixes that share MIN_LEN bytes meet in one task: the key of a window of MIN_LEN bytes is the least hash of
its ``GRAM``-byte strings.  1. Texts that are equal collapse to the one of the least doc_id.  2. Keys that occur in one
document only are discarded (a bucket of keys at a time).  3. Documents cut the runs of windows with a shared key as
contexts; a batch settles at once all but its first document with a context.  4. A bucket builds the enhanced suffix
array (suffix order and common-prefix lengths) over the distinct contexts of each key, scans it with a stack into the
tree of common-prefix intervals, and keeps the intervals whose left extensions differ: maximal repeats with all their
occurrences.  Every occurrence of a repeat in a document after the repeat's first document is a removed span.  5. Buckets pack their
spans by slices of the documents, and a slice gathers and merges the spans of each document.

Bounds: buckets follow the size of the input; a key adds one row a batch and distinct context to its bucket; a key found
in more than ``HOT`` documents is dealt by its distinct windows instead, and so is periodic text.  Whether a key is hot is
told to all its documents alike, by one of ``CELLS`` cells of keys, so what is broadcast is bounded; a key that shares the
cell of a hot key is dealt by windows as well, which changes no result.  A batch hands on its contexts when it holds
``CUT_ROWS`` of them, and suffix arrays have the suffixes whose first MIN_LEN bytes are shared, ``SUFFIXES`` at a time.
Nothing is dropped or capped.

Edge cases: null and empty texts have 0 bytes; texts under MIN_LEN bytes lose nothing; null ids come after all others;
rows with one doc_id never remove from each other, and repeated rows are judged alike; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ordered_id, shuffle_parts, table, text_bytes
from .textvec import gram_hash, mix, sliding_min

MIN_LEN, GRAM = 50, 18
#: Input bytes that a bucket stands for.
BUCKET_BYTES = 8 << 20
#: Input bytes of the documents whose spans are gathered at once.
SLICE_BYTES = 64 << 20
#: Documents with a key beyond which it is dealt by windows.
HOT = 10_000
#: Cells of keys (a power of 2) that are hot or not as a whole; their numbers are all that is broadcast, 8 MB at most.
CELLS = 1 << 20
#: Bytes of contexts that are searched for shared windows at once; a key's contexts stay together.
SCAN_BYTES = 1 << 19
#: Suffixes in one suffix array; those that share MIN_LEN bytes stay together.
SUFFIXES = 1 << 16
#: Contexts and settled places that a batch holds before it hands them on.
CUT_ROWS = 150_000
#: Bytes by which suffixes are ordered (a context of one key has 82 at most, but for periodic text); common prefixes count up to here.
ORDER = 88


def window_keys(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Key of every window of MIN_LEN bytes of a text, and whether both halves of the window hold it, as in periodic text."""
    if len(text) < MIN_LEN:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    grams, half = gram_hash(np.frombuffer(text, np.uint8), GRAM), (MIN_LEN - GRAM + 1) // 2
    first, second = sliding_min(grams, half), sliding_min(grams[half:], MIN_LEN - GRAM + 1 - half)
    first = first[: len(second)]
    return np.minimum(first, second), first == second


def runs(keys: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of every run of like windows."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((keys[1:] != keys[:-1]) | (twice[1:] != twice[:-1]))
    return np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(keys) - 1]))


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows; touching spans join."""
    if not len(spans):
        return spans.reshape(0, 2)
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(s[:, 1])
    first = np.concatenate(([True], s[1:, 0] > end[:-1]))
    return np.stack((s[first, 0], end[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(s) - 1]))]), 1)


def _slices(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each key."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def _ids(keys: np.ndarray, n: int) -> np.ndarray:
    """What a bucket compares of a key: the bucket and 32 bits inside it; a chance match only adds a candidate."""
    return (_slices(keys, n).astype(np.uint64) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def _pack(o: np.ndarray) -> tuple[int, bytes]:
    """Numbers as 4-byte distances from the least, or as they are where these don't fit."""
    low = int(o.min())
    return (low, (o - low).astype(np.uint32).tobytes()) if int(o.max()) - low < 1 << 32 else (low, o.tobytes())


def _unpack(low: int, n: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32).astype(np.int64) + low if len(data) == 4 * n else np.frombuffer(data, np.int64)


def _blocks(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and starts (with the end) of the runs of a sorted array."""
    at = np.concatenate(([0], np.flatnonzero(cells[1:] != cells[:-1]) + 1)) if len(cells) else np.zeros(0, np.int64)
    return cells[at] if len(cells) else cells, np.concatenate((at, [len(cells)])).astype(np.int64)


def _by_document(o: np.ndarray, keys: np.ndarray, nb: int) -> Iterator[tuple]:
    order = np.argsort(o, kind="stable")
    o, keys = o[order], keys[order]
    values, at = _blocks(o)
    for v, lo, hi in zip(values.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield -1 - int(v) % nb, v, keys[lo:hi].tobytes(), None, None


KEYS = "b int, o long, keys binary, extra binary, many binary"


def _many(n: np.ndarray) -> bytes:
    """Places of the numbers over 1 and by how much they are."""
    at = np.flatnonzero(n > 1)
    return np.concatenate((at, n[at] - 1)).astype(np.uint32).tobytes()


def _key_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["b", "o", "keys", "extra", "many"])


def _offer(nb: int):
    """Keys of a batch: shared inside the batch (b < 0, to the document), and one document a key to the key's bucket, with the number of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1).to_numpy(zero_copy_only=False)
            each = [np.unique(k[runs(k, r)[0]]) for k, r in map(window_keys, (t or b"" for t in text_bytes(b.column(3))))]
            if not (keys := np.concatenate([np.zeros(0, np.uint64), *each])).size:
                continue
            o = np.repeat(ids, [len(k) for k in each])
            keys = _ids(keys, nb)
            order = np.argsort(keys, kind="stable")
            keys, o = keys[order], o[order]
            values, at = _blocks(keys)
            least = np.minimum.reduceat(o, at[:-1])
            many = np.repeat(np.diff(at) > 1, np.diff(at))
            rows = list(_by_document(o[many], keys[many], nb))
            cells, cut = _blocks((values >> np.uint64(32)).astype(np.int32))
            low, n = values.astype(np.uint32), np.diff(at)
            rows += [(c, p[0], low[x:y].tobytes(), p[1], _many(n[x:y])) for c, x, y in zip(cells.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True) for p in [_pack(least[x:y])]]
            yield _key_batch(rows)

    return run


SHARED = "o long, k long"


def _share(t: pa.Table) -> pa.Table:
    """A row for each document and key that is shared: those told by their batch, and a bucket's keys offered by more than one batch."""

    def table_(o: np.ndarray, keys: np.ndarray) -> pa.Table:
        return pa.table([pa.array(o, pa.int64()), pa.array(keys.view(np.int64))], ["o", "k"])

    if t.num_rows == 0:
        return table_(np.zeros(0, np.int64), np.zeros(0, np.uint64))
    b, data = t.column("b")[0].as_py(), t.column("keys").to_pylist()
    if b < 0:
        return table_(np.repeat(np.array(t.column("o").to_pylist(), np.int64), [len(x) // 8 for x in data]), np.frombuffer(b"".join(data), np.uint64))
    keys = np.frombuffer(b"".join(data), np.uint32)
    o = np.concatenate([_unpack(low, len(x) // 4, y) for low, x, y in zip(t.column("o").to_pylist(), data, t.column("extra").to_pylist(), strict=True)])
    order = np.argsort(keys, kind="stable")
    keys, o = keys[order], o[order]
    _, at = _blocks(keys)
    many = np.repeat(np.diff(at) > 1, np.diff(at))
    return table_(o[many], keys[many].astype(np.uint64) | np.uint64(b << 32))


def _hot_cells(hot: int):
    """Cells of a bucket's keys that more than hot documents have."""

    def run(t: pa.Table) -> pa.Table:
        cells = np.zeros(0, np.int64)
        if t.num_rows and t.column("b")[0].as_py() >= 0:  # a batch offers a key to its bucket once, in one row
            keys = [np.frombuffer(x, np.uint32) for x in t.column("keys").to_pylist()]
            more = [np.frombuffer(x, np.uint32).reshape(2, -1) for x in t.column("many").to_pylist()]
            more = [np.repeat(k[at], n) for k, (at, n) in zip(keys, more, strict=True)]
            if len(keys) + sum(map(len, more)) > hot:
                keys, n = np.unique(np.concatenate(keys + more), return_counts=True)
                cells = np.unique(keys[n > hot].astype(np.int64) & (CELLS - 1))
        return pa.table([pa.array(cells, pa.int64())], ["cell"])

    return run


CONTEXTS = "b int, k long, ctx binary, o long, h long, s binary, spans binary"
_CTX_TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _ctx_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CTX_TYPES, strict=True)], ["b", "k", "ctx", "o", "h", "s", "spans"])


def _packed(spans: dict, slices: int) -> list[tuple]:
    """Settled spans of many documents, a row for each slice of the documents (b < 0)."""
    parts: dict[int, list] = {}
    for (o, h), x in spans.items():
        parts.setdefault(o % slices, []).append((o, h, merged(np.array(x, np.int32))))
    rows = []
    for c, docs in parts.items():
        head = np.array([(o, h, len(x)) for o, h, x in docs], np.int64)
        rows.append((-1 - c, None, None, None, None, head.tobytes(), np.concatenate([x for *_, x in docs]).astype(np.int32).tobytes()))
    return rows


GATHERED = "o long, hs array<bigint>, ss array<binary>"


def _gather(t: pa.Table) -> pa.Table:
    """Spans of a slice of the documents, one row a document."""
    spans: dict[int, dict[int, list[bytes]]] = {}
    for head, data in zip(t.column("s").to_pylist(), t.column("spans").to_pylist(), strict=True):
        at = 0
        for o, h, n in np.frombuffer(head, np.int64).reshape(-1, 3).tolist():
            spans.setdefault(o, {}).setdefault(h, []).append(data[at : at + 8 * n])
            at += 8 * n
    hs, ss = [list(x) for x in spans.values()], [[b"".join(y) for y in x.values()] for x in spans.values()]
    return pa.table([pa.array(list(spans), pa.int64()), pa.array(hs, pa.list_(pa.int64())), pa.array(ss, pa.list_(pa.binary()))], ["o", "hs", "ss"])


def _cut(nb: int, slices: int, most: int = CUT_ROWS):
    """Contexts of a batch, or of as many of its documents as have ``most``: each with its first document to the bucket, all later ones settled here (b < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, bytes], tuple[int, int, list[int]]] = {}
        spans: dict[tuple[int, int], list] = {}
        again: list[tuple] = []
        settled = 0

        def meet(k: int, ctx: bytes, o: int, h: int, s: list[int]) -> None:
            nonlocal settled
            known = first.setdefault((k, ctx), (o, h, s))
            if known[2] is s:
                return
            if known[:2] == (o, h):
                known[2].extend(s)
                return
            if known[0] > o:
                first[k, ctx] = (o, h, s)
                known, (o, h, s) = (o, h, s), known
            if o > known[0]:
                spans.setdefault((o, h), []).extend((x, x + len(ctx)) for x in s)
                settled += len(s)
            else:  # another text with the same doc_id: the bucket settles both
                again.append((k, ctx, o, h, s))

        def handed_on() -> pa.RecordBatch:
            nonlocal settled
            rows = [(*x, o, h, np.array(s, np.int32).tobytes()) for x, (o, h, s) in first.items()] + [(k, ctx, o, h, np.array(s, np.int32).tobytes()) for k, ctx, o, h, s in again]
            first.clear()
            again.clear()
            cells = _slices(mix(np.array([r[0] for r in rows], np.int64).view(np.uint64)), nb).tolist() if rows else []
            rows = [(c, *r, None) for c, r in zip(cells, rows, strict=True)] + _packed(spans, slices)
            spans.clear()
            settled = 0
            return _ctx_batch(rows)

        for b in batches:
            for o, h, t, ks, hs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), text_bytes(b.column(3)), b.column(4), b.column(5), strict=True):
                t = t or b""
                own, twice = window_keys(t)
                lo, hi = runs(own, twice)
                shared = ks.values.to_numpy(zero_copy_only=False).view(np.uint64)
                ids = _ids(own[lo], nb)
                has = np.isin(ids, shared)
                lo, hi = lo[has], hi[has]
                k = own[lo]
                hot = np.isin(ids[has], shared[hs.values.to_numpy(zero_copy_only=False)]) | twice[lo]
                for key, s, e in zip(k[~hot].view(np.int64).tolist(), lo[~hot].tolist(), hi[~hot].tolist(), strict=True):
                    meet(key, t[s : e + MIN_LEN], o, h, [s])
                if hot.any():
                    whole = mix(gram_hash(np.frombuffer(t, np.uint8), MIN_LEN))
                    at = np.concatenate([np.arange(x, y + 1) for x, y in zip(lo[hot], hi[hot], strict=True)])
                    at = at[np.argsort(whole[at], kind="stable")]
                    values, cut = _blocks(whole[at])
                    for key, x, y in zip(values.view(np.int64).tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        p = int(at[x])
                        meet(key, t[p : p + MIN_LEN], o, h, at[x:y].tolist())
                if len(first) + len(again) + settled > most:
                    yield handed_on()
            yield handed_on()

    return run


def enhanced_suffix_array(data: np.ndarray, size: np.ndarray, base: np.ndarray, groups: np.ndarray, ctx: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, common prefix with the suffix before, byte to the left or -1) of the given suffixes, in order.

    Suffixes are ordered inside a group by their first ORDER bytes; common prefixes stop at the ends of the contexts.
    """
    at = base[ctx] + off
    left = np.minimum(size[ctx] - off, ORDER)
    grid = data[at[:, None] + np.arange(ORDER)[None, :]]
    grid[np.arange(ORDER)[None, :] >= left[:, None]] = 0
    words = grid.view(">u8").astype(np.uint64)
    order = np.lexsort((left, *(words[:, k] for k in reversed(range(words.shape[1]))), groups[ctx]))
    ctx, off, at, left, grid = ctx[order], off[order], at[order], left[order], grid[order]
    differ = grid[1:] != grid[:-1]
    common = np.where(differ.any(1), differ.argmax(1), ORDER)
    common = np.minimum(common, np.minimum(left[1:], left[:-1]))
    common[groups[ctx[1:]] != groups[ctx[:-1]]] = 0
    before = np.where(off > 0, data[at - 1].astype(np.int16), -1)
    return ctx, off, np.concatenate(([0], common)), before


def maximal_repeats(contexts: list[bytes], groups: np.ndarray, most: int = SUFFIXES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, contexts, offsets) of every repeat of MIN_LEN bytes or more that cannot be extended to the left.

    A repeat whose length was cut at ORDER is given at every offset, for its left extension is cut as well.  Suffixes whose
    first MIN_LEN bytes no other one of the group has are in no repeat; the others are taken ``most`` at a time, and those
    that share these bytes together.
    """
    size = np.array([len(c) for c in contexts])
    base = np.concatenate(([0], np.cumsum(size)))[:-1]
    data = np.frombuffer(b"".join(contexts) + bytes(ORDER), np.uint8)
    n = size - MIN_LEN + 1
    ctx = np.repeat(np.arange(len(contexts)), n)
    off = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)
    whole = gram_hash(data, MIN_LEN)[base[ctx] + off] ^ mix(groups.astype(np.uint64))[ctx]
    order = np.argsort(whole, kind="stable")
    _, at = _blocks(whole[order])
    times = np.diff(at)
    order = order[np.repeat(times > 1, times)]
    ends = np.cumsum(times[times > 1])
    done = 0
    while done < len(order):
        upto = int(ends[max(np.searchsorted(ends, done + most, "right") - 1, np.searchsorted(ends, done, "right"))])
        part = np.sort(order[done:upto])
        yield from _intervals(*enhanced_suffix_array(data, size, base, groups, ctx[part], off[part]))
        done = upto


def _intervals(ctx: np.ndarray, off: np.ndarray, lcp: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Common-prefix intervals of MIN_LEN bytes or more whose left extensions differ."""
    inside = lcp >= MIN_LEN
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    for lo, hi in zip(np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1), strict=True):
        # lo..hi-1 share MIN_LEN bytes; the stack holds open intervals as [length, first, left byte or None if they differ]
        depth, byte = lcp[lo + 1 : hi].tolist() + [0], before[lo:hi].tolist()
        stack: list[list] = []
        one = lambda k, byte=byte: byte[k] if byte[k] >= 0 else None
        for k, d in enumerate(depth):
            start, same = k, one(k)
            while stack and stack[-1][0] > d:
                length, first, left = stack.pop()
                left = left if left == same else None
                if left is None or length >= ORDER:
                    yield length, ctx[lo + first : lo + k + 1], off[lo + first : lo + k + 1]
                start, same = first, left
            if stack and stack[-1][0] == d:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == same else None
            elif d:
                stack.append([d, start, same])


def _settle(slices: int):
    """Spans of a bucket: whole contexts after their first document, and repeats between different contexts."""

    def run(t: pa.Table) -> pa.Table:
        if t.num_rows == 0 or t.column("b")[0].as_py() < 0:
            return t
        places: dict[tuple[int, bytes], list[tuple[int, int, bytes]]] = {}
        for b in t.to_batches(max_chunksize=10_000):
            for key, c, *place in zip(*(b.column(c).to_pylist() for c in ("k", "ctx", "o", "h", "s")), strict=True):
                places.setdefault((key, c), []).append(tuple(place))
        lose = lambda at, lo, hi: spans.setdefault(at[:2], []).extend((z + lo, z + hi) for z in np.frombuffer(at[2], np.int32).tolist())
        spans: dict[tuple[int, int], list] = {}
        kinds: dict[int, list[bytes]] = {}
        for (key, c), at in places.items():
            kinds.setdefault(key, []).append(c)
            if len(at) > 1:
                least = min(at)[0]
                for x in at:
                    if x[0] > least:
                        lose(x, 0, len(c))
        held: list[tuple[int, bytes]] = []
        total = 0

        def scan() -> None:
            nonlocal held, total
            if held:
                groups = np.unique(np.array([x[0] for x in held], np.int64), return_inverse=True)[1]
                least = np.array([min(places[x])[0] for x in held])
                for length, cs, offs in maximal_repeats([x[1] for x in held], groups):
                    docs = least[cs]
                    for c, p in zip(cs[docs > docs.min()].tolist(), offs[docs > docs.min()].tolist(), strict=True):
                        for x in places[held[c]]:
                            if x[0] == least[c]:
                                lose(x, p, p + length)
            held, total = [], 0

        for key, cs in kinds.items():
            if len(cs) > 1:
                held += [(key, c) for c in cs]
                total += sum(map(len, cs))
                if total > SCAN_BYTES:
                    scan()
        scan()
        return pa.Table.from_batches([_ctx_batch(_packed(spans, slices))])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for h, t, copy, hs, ss in zip(b.column(2).to_pylist(), text_bytes(b.column(3)), *(b.column(k).to_pylist() for k in (4, 5, 6)), strict=True):
            t = t or b""
            if copy and len(t) >= MIN_LEN:
                at = np.array([[0, len(t)]], np.int64)
            else:
                at = merged(np.frombuffer(b"".join(x for y, x in zip(hs or [], ss or [], strict=True) if y == h), np.int32).reshape(-1, 2).astype(np.int64))
            rest, end = [], 0
            for s, e in at.tolist():
                rest.append(t[end:s])
                end = e
            rest.append(t[end:])
            rest = b"".join(rest)
            for x, v in zip(out, (len(t), len(t) - len(rest), len(at), hashlib.sha256(rest).hexdigest(), at.astype(np.int32).ravel().tolist()), strict=True):
                x.append(v)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.int32()))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, most: int = CUT_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: start and end of each removed run) for every row."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ordered_id().alias("o"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    nb = max(shuffle_parts(spark), total // bucket_bytes)
    slices = max(shuffle_parts(spark), total // SLICE_BYTES)
    same = d.select("o", "h", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m"))
    first = same.groupBy("m").agg(F.min("o").alias("first"), F.max("o").alias("last")).where("first < last").select("m", "first")
    copies = same.join(first, "m").where("o > first").groupBy("o").agg(F.collect_set("h").alias("copies"))
    reps = d.join(copies, "o", "left").where("copies IS NULL OR NOT array_contains(copies, h)").select("doc_id", "o", "h", "text")
    offered = reps.mapInArrow(_offer(nb), KEYS)
    cells = offered.groupBy("b").applyInArrow(_hot_cells(hot), "cell long").distinct()
    shared = offered.groupBy("b").applyInArrow(_share, SHARED).withColumn("at", F.col("k").bitwiseAND(CELLS - 1)).join(F.broadcast(cells), F.col("at") == F.col("cell"), "left")
    shared = shared.groupBy("o").agg(F.collect_list("k").alias("keys"), F.collect_list(F.col("cell").isNotNull()).alias("extra"))
    cut = reps.join(shared, "o").select("doc_id", "o", "h", "text", "keys", "extra").mapInArrow(_cut(nb, slices, most), CONTEXTS)
    spans = cut.groupBy("b").applyInArrow(_settle(slices), CONTEXTS).groupBy("b").applyInArrow(_gather, GATHERED)
    whole = d.join(copies, "o", "left").join(spans, "o", "left")
    copy = F.coalesce(F.array_contains("copies", F.col("h")), F.lit(False)).alias("copy")
    return whole.select("doc_id", "o", "h", "text", copy, "hs", "ss").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
