"""Streams: windowed counts with late rows, and an append-only journal that a restart does not repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchloom.sources.sinks import append_missing


def windowed_counts(rows: DataFrame, time: str, by: str, window: str, late: str) -> DataFrame:
    """(start, by, n, total of value): counts by event-time windows; rows later than `late` are too late. The same for streams and tables."""
    seen = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = seen.groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def journal(rows: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream has now to the ledger at `path`, each key once: a batch replayed after a loss finds its keys there."""

    def add(batch: DataFrame, _: int) -> None:
        append_missing(batch.dropDuplicates([key]), path, key)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
