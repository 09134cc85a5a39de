"""Reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one if all runs on one machine; else it raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, written to the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a few numbers that one partition of a written table holds.
ROWS_A_FILE = 500_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most `rows` short rows, in as many partitions as they need: a small table is written as few files, however many partitions a shuffle has."""
    return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df checkpointed in partitions by key, as many as the session shuffles to; joins and groups by that key do not shuffle it again.

    A checkpoint of an adaptive plan forgets how its rows are dealt, so that adaptive execution is off while this one is written.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


#: Bits of a filter, and of a part of it that one row of the aggregation makes. 4 MB in all, whatever the number of keys.
FILTER_BITS, PART_BITS = 1 << 25, 1 << 15


def may_hold(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """rows with `may`: true for all rows whose long is among keys and for few others, by a bitmap of hashes of fixed size that is broadcast.

    Strangers pass in the share of the bitmap that is set, so that an exact join must follow; it has little to do as long as keys are few against FILTER_BITS.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    part = lambda c: F.floor(at(c) / PART_BITS).cast("int")
    placed = keys.select(part(F.col(key)).alias("part__"), (at(F.col(key)) % PART_BITS).alias("bit"))
    bits = placed.groupBy("part__").agg(F.bitmap_construct_agg("bit").alias("bits__"))  # 1024 rows of 4 KB at most
    bit = at(F.col(column)) % PART_BITS
    byte = F.conv(F.hex(F.substring(F.col("bits__"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.call_function("getbit", byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("part__", part(F.col(column))).join(F.broadcast(bits), "part__", "left").withColumn("may", held).drop("part__", "bits__")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows (written) less those whose key, a long, is among `gone`. Only rows that may be among them are shuffled."""
    marked = may_hold(rows, key, gone, key)
    return marked.where(~F.col("may")).select(rows.columns).union(marked.where("may").join(gone, key, "left_anti").select(rows.columns))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, tasks hand at most so many rows at a time to Python: for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
