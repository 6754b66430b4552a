"""Strict and tolerant readers and writers of the text formats; malformed rows are counted, their text is never shown."""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

HAN_ONLY = "^[一-鿿]+$"
#: Characters that some readers take for a line break and others do not.
ODD_BREAKS = "[\u000b\u000c\u001c-\u001e\u0085  ]"


def _refuse(bad: DataFrame, what: str = "malformed rows") -> None:
    n = bad.count()
    if n:
        raise ValueError(f"{n} {what}")


def articles(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(title, revision, text) of the pages of a wiki dump (compressed or not) in the main namespace that are no redirects, in any order."""
    page = spark.read.text(path, lineSep="</page>").where(F.col("value").contains("<page>")).select(F.regexp_extract("value", r"(?s)<page>(.*)", 1).alias("p"))
    page = page.where(F.col("p").rlike(r"<ns>\s*0\s*</ns>") & ~F.col("p").rlike(r"<redirect[\s/>]"))
    of = lambda name: F.regexp_extract("p", rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    d = page.select(of("title").alias("title"), F.regexp_extract("p", r"(?s)<revision>.*?<id>(\d+)</id>", 1).cast("long").alias("revision"), of("text").alias("text"))
    return d.limit(limit) if limit is not None else d


def wiki_text(text: Column) -> Column:
    """Running text of wiki markup: escaped marks are read, templates (nested up to three deep), comments, notes, tables, tags and quotes go, links and language choices keep what they show."""
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    for _ in range(3):
        text = F.regexp_replace(text, r"\{\{[^{}]*\}\}", "")
    shown = ((r"(?s)<!--.*?-->", ""), (r"(?s)<ref\b[^>]*(?:/>|>.*?</ref>)", ""), (r"(?s)\{\|.*?\|\}", ""), (r"-\{(?:[^{}|]*\|)?([^{}]*?)\}-", "$1"), (r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1"), (r"\[https?://\S+ ([^\]]*)\]", "$1"), (r"<[^>]+>", ""), (r"''+", ""))
    for pattern, keep in shown:
        text = F.regexp_replace(text, pattern, keep)
    return text


def lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(text) of a text file, compressed or not; of a .tsv the last field.  Invalid UTF-8 fails, or is replaced if not strict."""
    d = spark.read.text(path).select(F.col("value").alias("text"), F.input_file_name().alias("file"))
    if strict:
        _refuse(d.where(~F.is_valid_utf8("text")), "lines that are not UTF-8")
    text = F.make_valid_utf8("text")
    return d.select(F.when(F.col("file").rlike(r"\.tsv(?:\.[a-z0-9]+)?$"), F.element_at(F.split(text, "\t"), -1)).otherwise(text).alias("text"))


def evaluation_rows(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(ctx, gold, reading) from ``ctx|gold|reading``: strict takes rows of exactly 3 fields and skips others; else rows have 2 or 3, empty rows and comments are skipped and a row without separator fails."""
    d = spark.read.text(path)
    if strict:
        d = d.select(F.split("value", r"\|", -1).alias("f")).where(F.size("f") == 3)
    else:
        d = d.where("trim(value) <> '' AND NOT startswith(value, '#')").select(F.split("value", r"\|", 3).alias("f"))
        _refuse(d.where(F.size("f") < 2), "rows without a separator")
    return d.select(F.col("f")[0].alias("ctx"), F.col("f")[1].alias("gold"), F.split(F.coalesce(F.get("f", F.lit(2)), F.lit("")), " ").alias("reading"))


def numbered_rows(spark: SparkSession, path: str, han: bool = True) -> DataFrame:
    """(file, line, ctx, gold, reading) of row files, with the number of each line in its file.

    Fails on rows of other than 3 fields, on a gold text that is not all of the script (if han), on odd line breaks, and on
    a byte order mark but at the very beginning, where it goes.  A file is one value, so each must fit into a task.
    """
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("v"))
    _refuse(d.where(F.col("v").contains("﻿") | F.col("v").rlike(ODD_BREAKS)), "files with odd marks")
    rows = d.select("file", F.posexplode(F.split(F.regexp_replace("v", "\n$", ""), "\n")).alias("line", "row")).where("row <> ''")
    rows = rows.select("file", (F.col("line") + 1).alias("line"), F.split("row", r"\|", -1).alias("f"))
    bad = F.size("f") != 3
    _refuse(rows.where(bad | ~F.get("f", F.lit(1)).rlike(HAN_ONLY) if han else bad))
    return rows.select("file", "line", F.col("f")[0].alias("ctx"), F.col("f")[1].alias("gold"), F.split(F.col("f")[2], " ").alias("reading"))


def rowstats(spark: SparkSession, path: str) -> DataFrame:
    """(row, ok, errors, gold_len); fails unless all fields are digits, ok is 0 or 1, and rows run from 1 to their number."""
    d = spark.read.csv(path, sep="\t", schema="row string, ok string, errors string, gold_len string")
    _refuse(d.where(" OR ".join(f"NOT coalesce({c} rlike '^[0-9]+$', false)" for c in d.columns) + " OR ok NOT IN ('0', '1')"))
    d = d.select(*[F.col(c).cast("int").alias(c) for c in d.columns])
    _in_order(d, "row")
    return d


def write_rowstats(rows: DataFrame, path: str) -> None:
    """Writes (row, ok, errors, gold_len) as tab-separated lines; a row accepted as right has no errors."""
    rows.select("row", F.col("ok").cast("int"), F.when(F.col("ok").cast("int") == 1, 0).otherwise(F.col("errors")).alias("errors"), "gold_len").write.mode("overwrite").csv(path, sep="\t")


def _in_order(d: DataFrame, column: str) -> None:
    r = d.agg(F.count("*").alias("n"), F.count_distinct(column).alias("k"), F.min(column).alias("a"), F.max(column).alias("b")).first()
    if r["n"] and not (r["n"] == r["k"] == r["b"] and r["a"] == 1):
        raise ValueError("row numbers are not 1..n")


def overlay(spark: SparkSession, path: str) -> DataFrame:
    """(reading, word, score, tag) from exactly four tab-separated fields."""
    d = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    _refuse(d.where("size(f) <> 4 OR try_cast(f[2] AS DOUBLE) IS NULL"))
    return d.select(F.split(F.col("f")[0], "-").alias("reading"), F.col("f")[1].alias("word"), F.col("f")[2].cast("double").alias("score"), F.col("f")[3].alias("tag"))


def lexicon(spark: SparkSession, base: str, overlays: list[str]) -> DataFrame:
    """(reading, word, score, layer, rank): a base of ``reading word score`` lines and overlays, best first within a reading; equal scores keep the order of the layers and, in a layer, of words.

    Fails if an overlay repeats a reading and word of its own.
    """
    b = spark.read.text(base).select(F.split("value", " ", -1).alias("f"))
    _refuse(b.where("size(f) <> 3 OR try_cast(f[2] AS DOUBLE) IS NULL"))
    d = b.select(F.split(F.col("f")[0], "-").alias("reading"), F.col("f")[1].alias("word"), F.col("f")[2].cast("double").alias("score"), F.lit(0).alias("layer"))
    for k, path in enumerate(overlays, 1):
        o = overlay(spark, path).select("reading", "word", "score", F.lit(k).alias("layer"))
        _refuse(o.groupBy("reading", "word").count().where("count > 1"), "repeated rows in an overlay")
        d = d.unionByName(o)
    return d.withColumn("rank", F.row_number().over(W.partitionBy("reading").orderBy(F.desc("score"), "layer", "word")))


SCORES = "i int, n int, ng array<double>, ll array<double>, col array<double>, ok array<int>, ed array<int>, glen int, masked array<boolean>"


def scores(spark: SparkSession, path: str) -> DataFrame:
    """JSONL score records; fails unless i runs from 1 to the number of rows."""
    d = spark.read.schema(SCORES).json(path)
    _in_order(d, "i")
    return d


def json_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Versioned JSON results of a folder, with the file each came from."""
    return spark.read.schema(schema).json(folder, multiLine=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def table_file(spark: SparkSession, path: str, encoding: str = "utf-8-sig") -> DataFrame:
    """CSV files with one header, in the encoding of their publisher by its Python name (utf-8-sig drops a byte order mark); each file must fit into a task."""

    @F.pandas_udf("array<array<string>>")
    def rows(content: pd.Series) -> pd.Series:
        return content.map(lambda c: [r for r in csv.reader(io.StringIO(bytes(c).decode(encoding), newline="")) if r])

    d = spark.read.format("binaryFile").load(path).select("path", rows("content").alias("r"))
    names = d.orderBy("path").select(F.col("r")[0]).first()[0]
    _refuse(d.where(F.col("r")[0] != F.array(*map(F.lit, names))), "files with another header")
    row = d.select(F.explode(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0)))).alias("r"))
    return row.select(*[F.get("r", F.lit(k)).alias(n) for k, n in enumerate(names)])


LEARNED = "# context\treading\tword\tweight\tday"


def learned(spark: SparkSession, path: str) -> DataFrame:
    """(context, reading, word, weight, day) of a learning journal: parts in the order of their numbers, the last line of a (context, reading, word) wins.

    Fails on a line of other than five fields or with a weight or day that is no number.
    """
    d = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    d = d.where((F.col("value") != "") & (F.col("value") != LEARNED)).select("file", "block", "at", F.split("value", "\t", -1).alias("f"))
    _refuse(d.where("size(f) <> 5 OR try_cast(f[3] AS DOUBLE) IS NULL OR try_cast(f[4] AS BIGINT) IS NULL"))
    f = lambda k: F.col("f")[k]
    rows = d.select(f(0).alias("context"), f(1).alias("reading"), f(2).alias("word"), F.struct("file", "block", "at", f(3).cast("double").alias("weight"), f(4).cast("long").alias("day")).alias("x"))
    return rows.groupBy("context", "reading", "word").agg(F.max("x").alias("x")).select("context", "reading", "word", "x.weight", "x.day")


def append_learned(records: DataFrame, path: str, part: int) -> None:
    """Appends records (context, reading, word, weight, day), a row a key, as part number ``part`` of a journal folder."""
    line = F.concat_ws("\t", "context", "reading", "word", F.col("weight").cast("string"), F.col("day").cast("string"))
    records.select(line.alias("value")).write.mode("errorifexists").text(f"{path}/part={part:09d}")


def compact_learned(spark: SparkSession, path: str, to: str) -> None:
    """Writes what a journal holds now as a new journal of one part."""
    append_learned(learned(spark, f"{path}/*"), to, 0)


def content_hash(rows: DataFrame, key: str, text: str, slices: int = 1000) -> str:
    """Order-bound SHA-256 of a column: the hash of the hashes of each slice of ``slices`` numbers of an integer key."""
    d = rows.groupBy(F.floor(F.col(key) / slices).alias("part")).agg(F.array_sort(F.collect_list(F.struct(key, text))).alias("x"))
    d = d.select("part", F.sha2(F.array_join(F.col(f"x.{text}"), "\n"), 256).alias("h")).agg(F.array_sort(F.collect_list(F.struct("part", "h"))).alias("x"))
    return d.select(F.sha2(F.array_join("x.h", "\n"), 256)).first()[0]


def write_with_manifest(kept: DataFrame, counts: DataFrame, path: str, key: str | None = None, text: str | None = None) -> None:
    """Kept rows, and beside them a manifest: the counts by reason, the number of rows and, with a key, the hash of their texts."""
    kept.write.mode("overwrite").parquet(f"{path}/kept")
    spark = kept.sparkSession
    now = spark.read.parquet(f"{path}/kept")
    told = {"rows": now.count(), "counts": {str(r[0]): r[1] for r in counts.limit(1000).collect()}} | ({"sha256": content_hash(now, key, text)} if key else {})
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def unchanged(rows: DataFrame, path: str) -> bool:
    """Whether a table on disk holds exactly these rows, however they are ordered (rebuild and compare)."""
    there = rows.sparkSession.read.parquet(path)
    if sorted(there.columns) != sorted(rows.columns):
        return False
    there = there.select(*rows.columns)
    return rows.exceptAll(there).limit(1).count() == there.exceptAll(rows).limit(1).count() == 0


def markdown(rows: DataFrame, most: int = 500) -> str:
    """A small result as a Markdown table; fails beyond ``most`` rows.  A bar within a value is escaped."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in got)])
