"""Streams give what tables give, and a restart repeats nothing."""

from pyspark.sql import functions as F

from matchloom.streaming import journal

SCHEMA = "id long, ts timestamp, kind string, value double"


def test_journal_and_windows(spark, tmp_path):
    rows = spark.range(40).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").cast("double").alias("value"))
    rows.where("id < 25").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for _ in range(2):
        journal.journal(stream, str(tmp_path / "ledger"), "id", str(tmp_path / "c1")).awaitTermination(60)
    rows.where("id >= 20").write.mode("append").parquet(str(tmp_path / "in"))
    journal.journal(stream, str(tmp_path / "ledger"), "id", str(tmp_path / "c1")).awaitTermination(60)
    journal.journal(stream, str(tmp_path / "ledger"), "id", str(tmp_path / "c2")).awaitTermination(60)  # everything once more
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    assert sorted(r["id"] for r in ledger.collect()) == list(range(40))
    counts = journal.windowed_counts(stream, "ts", "kind", "10 minutes", "1 hour")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    table = journal.windowed_counts(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), "ts", "kind", "10 minutes", "1 hour")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, table.collect()))
