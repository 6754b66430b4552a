"""A corpus pipeline of five of the training-data operators, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, line_dedup, mixing, quality_classifier, simhash
from lexloom.llm.common import checkpoint, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row, a hash of all columns: rows that share it are alike, so stages judge by it and not by doc_id."""
    parts = [F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("-")) for c in COLUMNS]
    return docs.select(*COLUMNS, F.md5(F.concat_ws("|", *parts).cast("binary")).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the Gumbel top-k draws (op 9)."""
    d = keyed(docs)
    kept = quality_classifier.resample(d, table(spark, sf_dir, "labels")).where("kept").select("row").distinct()
    return d.join(kept, "row", "left_semi").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier, however short (op 3 with a guarantee of one word)."""
    d = line_dedup.dedup(docs.select(*COLUMNS), least=1)
    return d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash class (op 5): of the least doc_id, and one without doc_id only where the class has no other."""
    d = keyed(docs)
    first = simhash.classes(d).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")).select("x.row")
    return d.join(first, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark (op 7)."""
    d = keyed(docs)
    judged = decontaminate.judge(decontaminate.scan(d.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")))
    return d.join(judged.where("contaminated").select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training plan of the documents that are left, a row for every copy that is taken, sorted by position (op 6)."""
    return mixing.plan(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near), ("benchmark decontamination", clean), ("mixing", mix)]
#: SQL has neither the classifier nor SimHash; tests/llm hold the decisions of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
