"""The journal as a stream: windowed counts, sessions, duplicates, and the latest validated row as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str, pattern: str = "events.parquet") -> DataFrame:
    """A file stream of journal events, with a real timestamp for watermarks."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def counts(df: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Counts and sums by tumbling or sliding window; the watermark has no effect on a batch."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return df.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    w = F.session_window("ts", gap)
    return df.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def once(df: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest(df: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, event_id, value) of the latest purchase per key, updated as events come; state is one row per key."""

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (-1, -1, 0.0)
        for b in batches:
            for r in b.itertuples():
                best = max(best, (int(r.at), int(r.event_id), float(r.value)))
        state.update(best)
        yield pd.DataFrame({key: [k[0]], "event_id": [best[1]], "value": [best[2]]})

    src = df.where("event_type = 'purchase'").select(key, F.unix_micros("ts").alias("at"), "event_id", "value")
    return src.groupBy(key).applyInPandasWithState(keep, f"{key} long, event_id long, value double", "at long, event_id long, value double", "update", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, checkpoint: str, mode: str, name: str) -> DataFrame:
    """Run a stream over all there is now and return what its sink holds."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
