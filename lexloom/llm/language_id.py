"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: runs of letters, lower-cased and joined by one space, give character 1- to 3-grams hashed to ``BUCKETS``
features; a feature weighs (1 + ln tf) * idf and a text's vector has length one.  Document frequencies come from all
training rows.  Weights are trained by follow-the-regularised-leader (proximal) with L1 and L2 penalties on at most
about ``PER_LANG`` rows a language, drawn by a hash of doc_id (the documented bound of the labelled sample), one in
five of which is kept apart to fit the temperature that calibrates the probabilities.

Training rows are documents with a lang and crc32(doc_id as text) mod 4 other than 2.  Predictions read the text only.

Edge cases: ``und`` with score 0 if the text is null or has no letter, or if nothing can be learned; a null doc_id is
not held out and not learned from; repeated rows are predicted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textvec import mix

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
PER_LANG = 600
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 5e-3, 1e-4
FOLDS, HELD_OUT = 4, 2
_LETTER: list[np.ndarray] = []
BLOCK = 1 << 20


def _letters() -> np.ndarray:
    if not _LETTER:
        t = np.zeros(0x110000, bool)
        t[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        _LETTER.append(t)
    return _LETTER[0]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and how often each occurs; very long texts are counted block by block."""
    total = np.zeros(BUCKETS, np.int64)
    tail = np.zeros(0, np.uint64)
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_letters()[c], c, 32).astype(np.uint64)
        c = np.concatenate((tail if at else np.array([32], np.uint64), c, np.array([32], np.uint64) if at + BLOCK >= len(text) else np.zeros(0, np.uint64)))
        gap = c == 32
        c = c[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]
        done = len(tail) if at else 0
        for n in GRAMS:
            lo = max(0, done - n + 1)
            x = c[lo:]
            if len(x) >= n:
                g = np.full(len(x) - n + 1, n, np.uint64)
                for k in range(n):
                    g = g * np.uint64(0x110001) + x[k : len(x) - n + 1 + k]
                total += np.bincount((mix(g) >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
        tail = c[-2:]
    at = np.flatnonzero(total)
    return at, total[at]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(BUCKETS + 1, np.int64)
    for b in batches:
        for t in b.column(0).to_pylist():
            df[counts(t)[0]] += 1
            df[BUCKETS] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["f", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, tf = [], []
        for t in b.column(2).to_pylist():
            a, n = counts(t)
            at.append(a.astype(np.int32).tobytes())
            tf.append(n.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "lang", "f", "tf"])


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(tf)) * idf
    return x / max(1e-12, float(np.sqrt(np.dot(x, x))))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for softmax regression; weights are sparse by the L1 penalty."""

    def __init__(self, features: int, classes: int):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda v: -np.log(np.maximum(softmax(scores / np.exp(v))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def remainder(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, per_lang: int = PER_LANG) -> dict | None:
    """Model fitted on the rows that are not held out; None if no row can be learned from."""
    rows = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text rlike '\\\\p{L}'").where(remainder() != HELD_OUT).select("doc_id", "lang", "text")
    langs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not langs:
        return None
    names = sorted(langs)
    freq = rows.select("text").mapInArrow(_frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[freq["f"]] = freq["n"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    share = F.element_at(F.create_map(*[F.lit(v) for k in names for v in (k, min(1.0, per_lang / langs[k]))]), F.col("lang"))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    sample = drawn.mapInArrow(_vectors, "doc_id long, lang string, f binary, tf binary").toPandas().sort_values(["doc_id", "lang"])
    data = []
    for r in sample.itertuples():
        at = np.frombuffer(r.f, np.int32)
        data.append((at, weigh(np.frombuffer(r.tf, np.float32).astype(float), idf[at]), names.index(r.lang)))
    rng = np.random.default_rng(7)
    order = rng.permutation(len(data))
    held = order[: len(data) // 5]
    model = Ftrl(BUCKETS, len(names))
    for _ in range(EPOCHS):
        for k in rng.permutation(order[len(held) :]):
            model.learn(*data[k])
    w = model.weights(slice(None))
    scores = np.array([data[k][1] @ w[data[k][0]] for k in held]).reshape(-1, len(names))
    return {"langs": names, "w": w.astype(np.float32), "idf": idf.astype(np.float32), "t": temperature(scores, np.array([data[k][2] for k in held], int))}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = m.value
        for b in batches:
            lang, score = [], []
            for t in b.column(1).to_pylist():
                at, tf = counts(t) if v and t else ((), ())
                letters = v and t and _letters()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()
                if not letters:
                    lang.append("und")
                    score.append(0.0)
                    continue
                p = softmax(weigh(tf.astype(np.float32), v["idf"][at]) @ v["w"][at] / v["t"])
                lang.append(v["langs"][int(p.argmax())])
                score.append(min(1.0, float(p.max())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = predict(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return rows.select("doc_id", F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
