"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words between ASCII white space, as a Java regular expression of what separates them.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a few numbers that a task can hold with ease, the least worth a partition of their own.
SHRINK_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    It is ``spark.checkpoint.dir``; a folder of this machine's own serves only a local session that names none (tests).
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="lexloom-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint that later checkpoints have replaced; df must not be read again."""
    path = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if path.isDefined():
        _delete(df.sparkSession, path.get())


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, for frames of which later steps read a few columns each."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that nothing refers to any more: they are cleaned when the JVM collects them."""
    gc.collect()
    spark._jvm.System.gc()


def words(text: str | Column, sep: str = SPACE) -> Column:
    """Array of the words of a text; empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), sep), "")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def signature(df: DataFrame) -> tuple[int, int]:
    """Number of rows and an order-free hash of them."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("x")).first()
    return r["n"], r["x"]


def shrink(df: DataFrame, rows: int) -> DataFrame:
    """Merge neighbouring partitions of a small frame, so that the shuffles after it write few files.

    One partition for ``SHRINK_ROWS`` rows, but no fewer than the session's cores; a large frame stays as it is.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SHRINK_ROWS)))


#: Keys that are broadcast at most where rows of frequent keys are not to meet in one task.
HOT_KEYS = 4096


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], count: str, most: int = HOT_KEYS) -> DataFrame:
    """Inner join of rows with a stored table of one row a key; keys are long, count is the number of a key's rows.

    Keys with more than one in ``most`` of all rows, of which there are fewer than ``most``, are broadcast; their rows are
    spread by a hash of their own where the others meet the table by shuffle, so no task gathers a frequent key's rows.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    rest = [c for c in table.columns if c not in keys and c != count]
    frequent = F.col(count) * most > total
    hot = table.where(frequent).select(*keys, F.struct(*rest, F.lit(True).alias("_")).alias("_hot"))
    cold = table.where(~frequent).select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*rest, F.lit(True).alias("_")).alias("_cold"))
    told = rows.join(F.broadcast(hot), keys, "left").select(*rows.columns, "_hot")
    own = [F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.col(keys[0])).alias(f"_{keys[0]}"), *[F.col(k).alias(f"_{k}") for k in keys[1:]]]
    met = told.select("*", *own).join(cold, [f"_{k}" for k in keys], "left").withColumn("_at", F.coalesce("_hot", "_cold")).where("_at IS NOT NULL")
    return met.select(*rows.columns, *[F.col(f"_at.{c}").alias(c) for c in rest])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b); root is the smallest node of the component.

    Alternating large-star and small-star steps, each on joins and minima by key, until the edges no longer change;
    every round is checkpointed and the round before it deleted.  Nothing but a count and a hash reaches the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    seen = signature(e)
    while seen[0]:
        now = shrink(e, seen[0])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = shrink(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), seen[0]).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, checkpoint(shrink(small.unionByName(low.select("u", F.col("m").alias("v"))), seen[0]).distinct())
        forget(before)
        now = signature(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def text_bytes(column) -> list:
    """An Arrow string column as bytes; None for null."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def ordered_id(name: str = "doc_id") -> Column:
    """doc_id with null after every other id."""
    return F.coalesce(F.col(name).cast("long"), F.lit((1 << 63) - 1))
