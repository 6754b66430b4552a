"""Quality classifier by importance resampling.

Two generative models over hashed words and word pairs (``BUCKETS`` counts each): one of the raw text, counted over
all documents, and one of the target text, counted over the good documents (quality 1, not toxic) of at most
``LABELLED`` labelled rows, drawn by a hash of doc_id; every second good row is kept apart for the level below.  Target
counts are smoothed by ``SMOOTH`` pseudo-counts of the raw model, so a bucket seen too rarely to tell has ratio 1.  A
document's log importance weight is the log ratio of its likelihoods under the two, tempered to a text of ``LENGTH`` features (else
long documents are drawn or not by their length alone).  The sample drawn is the Gumbel top-k of log weight + Gumbel noise (a fixed hash of doc_id),
which is sampling without replacement in proportion to the weights; k is the number of documents whose weight per
feature reaches the level that all but ``MISS`` of the good documents kept apart reach.  The k-th key is found by
refining histograms of the keys, never by sorting documents in one task.

Edge cases: a null or empty text has no features, weight 0 per feature, and is kept or not like any other; labels of unknown documents and null labels are not used;
repeated labels of a document count as good only if all are; rows tied at the k-th key are all drawn; without good
labels the ratio is 0 and every document is drawn; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table, text_bytes
from .textvec import lower, mix, prefix, span_hash, word_spans

BUCKETS = 1 << 16
LABELLED = 20_000
SMOOTH = 3.0
MISS = 0.002
LENGTH = 200
SEED = 11
BINS = 4096


def features(text: bytes) -> np.ndarray:
    """Buckets of the words and word pairs of a text, repeats included."""
    data = lower(np.frombuffer(text, np.uint8))
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.int64)
    h = span_hash(prefix(data), start, end)
    two = mix(h[:-1] * np.uint64(3) + h[1:])
    return (np.concatenate((h, two)) >> np.uint64(48)).astype(np.int64)


def _counter(good: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                f = np.bincount(features(t or b""), minlength=BUCKETS)
                n[0] += f
                if good.value.get(i):
                    n[1] += f
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[0, at], pa.int64()), pa.array(n[1, at], pa.int64())], ["f", "raw", "good"])

    return run


def labelled(labels: DataFrame, most: int = LABELLED) -> dict[int, bool]:
    """doc_id -> good, for at most ``most`` labelled documents in the order of a hash."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return {r["doc_id"]: r["good"] for r in rows}


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Log ratio of every bucket, and the good documents kept apart."""
    good = sorted(i for i, v in labelled(labels).items() if v)
    apart = good[::2] if len(good) > 1 else good
    good = dict.fromkeys(good[1::2] or good, True)
    said = docs.sparkSession.sparkContext.broadcast(good)
    c = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(said), "f long, raw long, good long")
    c = c.groupBy("f").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    n = np.zeros((2, BUCKETS))
    n[0, c["f"]], n[1, c["f"]] = c["raw"], c["good"]
    if not n[1].sum():
        return np.zeros(BUCKETS), apart
    due = n[0] * (n[1].sum() / n[0].sum())
    return np.log((n[1] + SMOOTH) / (due + SMOOTH)), apart


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """The rows of docs with log_weight and n_features, and the string row where docs has one."""
    row = ["row"] if "row" in docs.columns else []
    table_ = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t or b"") for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([float(table_.value[x].sum()) for x in f], pa.float64()), pa.array([len(x) for x in f], pa.int64()), *b.columns[2:]], ["doc_id", "log_weight", "n_features", *row]
            )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    return d.mapInArrow(run, "doc_id long, log_weight double, n_features long" + ", row string" * len(row))


def kth(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value: the bin that holds it is split again until it holds one value."""
    r = keys.agg(F.min(column), F.max(column)).first()
    low, high = r[0], r[1]
    while low is not None and low < high and k > 0:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            return low
        inside = keys.where(F.col(column).between(low, high))
        b = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        rows = inside.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        for x in rows:
            if x["n"] >= k:
                low, high = x["lo"], x["hi"]
                break
            k -= x["n"]
        else:
            return low
    return low if low is not None else 0.0


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_weight, n_features, key, kept) for every row, and the string row where docs has one; kept rows are the Gumbel top-k."""
    ratio, fine = fit(docs, labels)
    u = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    rows = weights(docs, ratio).withColumn("rate", F.col("log_weight") / F.greatest("n_features", F.lit(1)))
    rows = checkpoint(rows.withColumn("key", LENGTH * F.col("rate") - F.log(-F.log(u))))
    spark = docs.sparkSession
    level = -float("inf")
    if fine:
        said = spark.createDataFrame([(i,) for i in fine], "doc_id long")
        known = rows.join(F.broadcast(said), "doc_id", "left_semi").select("rate").orderBy("rate").limit(int(MISS * len(fine)) + 1).collect()
        level = min(0.0, known[-1]["rate"]) if known else level
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("rate") >= level).alias("k")).first()
    least = kth(rows, "key", n["k"]) if n["k"] < n["n"] else -float("inf")
    return rows.select("doc_id", "log_weight", "n_features", "key", (F.col("key") >= least).alias("kept"), *(["row"] if "row" in rows.columns else []))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
