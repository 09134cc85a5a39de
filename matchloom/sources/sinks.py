"""Sinks: no silent overwrite, idempotent writes, resumable ledgers, JSON lines, bundles with a manifest, sealed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_new(df: DataFrame, path: str, replace: bool = False) -> None:
    """Parquet that appears whole; an existing path raises unless `replace`."""
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_once(df: DataFrame, path: str) -> str:
    """'written', or 'same' if the path holds equal rows already; other rows there raise."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
        return "written"
    old = spark.read.parquet(path).select(df.columns)
    if not old.exceptAll(df).isEmpty() or not df.exceptAll(old).isEmpty():
        raise ValueError(f"{path} holds other rows")
    return "same"


#: Folders into which a ledger's keys are dealt.
LEDGER_PARTS = 64


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the ledger at `path` does not hold; returns how many. A second run adds none, and a null key is a key like others.

    The ledger lies in folders by a hash of the key (column ledger_part), and only folders of the new keys are read. One writer at a time: two could add one key each.
    """
    spark = df.sparkSession
    new = df.withColumn("ledger_part", F.pmod(F.xxhash64(key), F.lit(LEDGER_PARTS)).cast("int")).persist()
    fresh = new
    if exists(spark, path):
        parts = [r[0] for r in new.select("ledger_part").distinct().collect()]  # LEDGER_PARTS at most
        held = spark.read.parquet(path).where(F.col("ledger_part").isin(parts)).select(F.col("ledger_part").alias("p__"), F.col(key).alias("k__"))
        fresh = new.join(held, (F.col("ledger_part") == F.col("p__")) & F.col(key).eqNullSafe(F.col("k__")), "left_anti").persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").partitionBy("ledger_part").parquet(path)
    fresh.unpersist()
    new.unpersist()
    return n


def write_json_lines(df: DataFrame, path: str, compression: str | None = None) -> None:
    """JSON lines with nulls kept, in as many files as partitions."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").option("compression", compression or "none").json(path)


def canonical_json(columns: list[str]) -> Column:
    """JSON of the columns by name; NaN raises, as it has no JSON."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def sealed(df: DataFrame) -> DataFrame:
    """df with seal, the SHA-256 of its canonical JSON."""
    return df.withColumn("seal", F.sha2(canonical_json(df.columns), 256))


def broken_seals(df: DataFrame) -> DataFrame:
    """Rows whose seal is not that of their other columns."""
    return df.where(~F.col("seal").eqNullSafe(F.sha2(canonical_json([c for c in df.columns if c != "seal"]), 256)))


def write_bundle(df: DataFrame, path: str, key: str) -> dict:
    """rows/ in Parquet, one row a key (the first by all columns), and manifest/ with its counts and digest; returns the manifest."""
    from matchloom.operators.evaluation import table_digest
    from matchloom.operators.governance import first_wins

    rows = first_wins(df, key, [F.col(c) for c in df.columns])
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    written = df.sparkSession.read.parquet(f"{path}/rows")
    note = table_digest(written, sorted(written.columns)).withColumn("key", F.lit(key))
    note.write.mode("errorifexists").json(f"{path}/manifest")
    return note.first().asDict()
