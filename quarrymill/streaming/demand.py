"""Weekly counts over a stream of sightings: beyond the batch engine, same weeks and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def weekly_counts(events: DataFrame, at: str, group: str, width: str = "7 days", late: str = "14 days", offset: str = "4 days") -> DataFrame:
    """(week, group, n): tumbling weeks from Monday; rows later than `late` behind the newest are left out.

    1970-01-01 was a Thursday, so weeks start four days after the epoch's.
    """
    return events.withWatermark(at, late).groupBy(F.window(at, width, width, offset).alias("w"), F.col(group)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), group, "n")


def distinct_sightings(events: DataFrame, at: str, keys: list[str], late: str = "14 days") -> DataFrame:
    """The first of each key within the watermark; state older than `late` is dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def to_memory(counts: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Runs the stream over all that is there into a table in memory (for small results)."""
    q = counts.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
