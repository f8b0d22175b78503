"""The limiter and the expiring cache: batches against plain Python, streams against batches."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chiffra.streaming import journal as SJ
from chiffra.streaming import limits as L


def bucket(times, every, burst):
    """Tokens by the clock: a request takes one when there is one."""
    full, out = None, []
    for t in times:
        go = t if full is None else max(t, full - (burst - 1) * every)
        full = max(t, full if full is not None else t) + every
        out.append(go)
    return out


@pytest.mark.parametrize("every,burst", [(10, 1), (10, 4), (1, 2)])
def test_waits(spark, every, burst):
    rng = random.Random(every * burst)
    rows = [(k, i + 1000 * k, rng.choice([rng.randint(0, 300), 40, 41])) for k in range(4) for i in range(60)] + [(9, 9000, 5)]
    got = {r["event_id"]: r["granted_at"] for r in L.granted(spark.createDataFrame(rows, "k long, event_id long, at long"), "k", every, burst).collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((at, e) for x, e, at in rows if x == k)
        want = bucket([at for at, _ in mine], every, burst)
        assert [got[e] for _, e in mine] == want
        for a in range(len(want)):
            assert sum(want[a] <= w < want[a] + every for w in want) <= burst + 1


def test_streams_wait_as_batches_do(spark, tmp_path):
    """Every request but those behind the last watermark, each with the time that a replay of all gives it."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    path = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{path}/events.parquet").select("event_id", (F.col("user_id") % 3).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    every, ttl = 3_600_000_000, 7_200_000_000
    files = str(tmp_path / "in")
    rows = spark.read.parquet(f"{path}/events.parquet").withColumn("k", F.col("user_id") % 3).withColumn("part", F.ntile(3).over(Window.orderBy("ts")))
    for part in (1, 2, 3):  # one after the other, as a stream reads files by their times
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(files)
    try:
        stream = lambda: spark.readStream.schema(spark.read.parquet(files).schema).option("maxFilesPerTrigger", 1).parquet(files).withColumn("ts", F.col("ts").cast("timestamp"))
        end = batch.agg(F.max("at")).first()[0]
        for name, processor, want in (
            ("granted", L.TokenBucket(every, 3), {r["event_id"]: r["granted_at"] for r in L.granted(batch, "k", every, 3).collect()}),
            ("cached", L.Expiring(ttl), {r["event_id"]: int(r["hit"]) for r in L.looked_up(batch, "k", ttl).collect()}),
        ):
            out = SJ.drained(L.in_order(stream(), "k", processor), str(tmp_path / name), "append", name).collect()
            got = {r["event_id"]: r["value"] for r in out}
            passed = {r["event_id"] for r in batch.where(F.col("at") < end - 700_000_000).collect()}
            assert len(out) == len(got) and passed <= set(got)
            assert all(want[e] == v for e, v in got.items())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
