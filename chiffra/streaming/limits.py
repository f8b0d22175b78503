"""A rate limiter that queues what comes too early, and a cache whose entries expire: as stateful streams with timers, and as batches.

The limiter is a token bucket: ``burst`` requests at once, then one each ``every`` microseconds. A request that finds no token
waits for its turn instead of failing. What a request waits depends on those before it, so a stream keeps requests until the
watermark has passed them and lets them through in the order of their times; a timer at the earliest of them wakes the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def granted(requests: DataFrame, key: str, every: int, burst: int, at: str = "at", tie: str = "event_id") -> DataFrame:
    """``requests`` with ``granted_at``, in microseconds. The bucket is empty again ``every`` after each request it has served, so its
    time of being full is i every + max over j <= i of (at_j - (j - 1) every): a running maximum, and no fold."""
    order = Window.partitionBy(key).orderBy(at, tie)
    i = F.row_number().over(order).cast("long")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.withColumn("__i", i).withColumn("__slack", F.col(at) - (F.col("__i") - 1) * every)
    full = F.max("__slack").over(before) + (F.col("__i") - 1) * every
    return rows.withColumn("granted_at", F.greatest(F.col(at), F.coalesce(full - (burst - 1) * every, F.col(at)))).drop("__i", "__slack")


def looked_up(requests: DataFrame, key: str, ttl: int, at: str = "at", tie: str = "event_id") -> DataFrame:
    """(key, tie, hit): whether a request finds an entry that was loaded less than ``ttl`` microseconds before. A miss loads it.
    Whether one loads depends on the load before it, so the requests of a key are one array."""
    kind = requests.schema
    item = f"struct<{tie}:{kind[tie].dataType.simpleString()},hit:boolean>"
    start = F.struct(F.lit(None).cast("long").alias("loaded"), F.array().cast(f"array<{item}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        hit = F.coalesce(x[at] < s["loaded"] + ttl, F.lit(False))
        return F.struct(F.when(hit, s["loaded"]).otherwise(x[at]).alias("loaded"), F.concat(s["out"], F.array(F.struct(x[tie].alias(tie), hit.alias("hit")))).alias("out"))

    rows = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, tie))).alias("r"))
    return rows.select(key, F.inline(F.aggregate("r", start, step)["out"]))


class _InOrder(StatefulProcessor):
    """Requests (at, event_id) of a key, handed on in order once the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long")
        self.memory = handle.getValueState("memory", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for b in rows:
            for at, event in zip(b["at"], b["event_id"], strict=True):
                self.waiting.appendValue((int(at), int(event)))
                self.handle.registerTimer(int(at) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        if ready:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            memory = self.memory.get()[0] if self.memory.exists() else None
            out = []
            for at, event in ready:
                memory, value = self.decide(memory, at)
                out.append((key[0], event, value))
            self.memory.update((memory,))
            yield pd.DataFrame(out, columns=["key", "event_id", "value"])

    def close(self) -> None:
        pass


class TokenBucket(_InOrder):
    """``value`` is the time at which a request is let through."""

    def __init__(self, every: int, burst: int):
        self.every, self.burst = every, burst

    def decide(self, full: int | None, at: int) -> tuple[int, int]:
        go = at if full is None else max(at, full - (self.burst - 1) * self.every)
        return max(at, full or at) + self.every, go


class Expiring(_InOrder):
    """``value`` is 1 where a request finds an entry. The entry that expires is forgotten when the next request comes."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def decide(self, loaded: int | None, at: int) -> tuple[int, int]:
        hit = loaded is not None and at < loaded + self.ttl
        return loaded if hit else at, int(hit)


def in_order(requests: DataFrame, key: str, processor: StatefulProcessor, late: str = "10 minutes") -> DataFrame:
    """(key, event_id, value) of a stream of requests (key, ts, event_id). Those within ``late`` of the last seen wait for its end."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = requests.withWatermark("ts", late).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("at"), "event_id")
    return rows.groupBy("key").transformWithStateInPandas(processor, "key long, event_id long, value long", "append", "eventTime")
