import heapq
import zlib
from collections import Counter

import pytest

from chiffra.llm import sharding
from chiffra.llm._common import join_groups, ranked


def plain_lpt(sizes, shards):
    heap = [(0, j) for j in range(shards)]
    for s in sorted(sizes, reverse=True):
        x, j = heapq.heappop(heap)
        heapq.heappush(heap, (x + s, j))
    return sorted(x for x, _ in heap)


@pytest.mark.parametrize("sizes", [[5, 5, 4, 3, 3, 1], [7] * 1000, list(range(1, 700)), [1] * 9999 + [5000], [3]])
def test_counts_are_those_of_the_plain_heap(sizes):
    took, loads = sharding.lpt_counts([(s, n, s) for s, n in Counter(sizes).items()], 16)
    assert sorted(loads) == plain_lpt(sizes, 16)
    assert {k: sum(v) for k, v in took.items()} == Counter(sizes)


def test_rows(spark):
    texts = ["é" * i for i in range(40)] + ["same"] * 300 + [None, None, ""]
    df = spark.createDataFrame([(i if i % 50 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    out = sharding.shard_documents(df.union(df.limit(3)), 4).collect()
    assert len(out) == len(texts) + 3
    home = {}
    for r in out:
        assert home.setdefault(bytes(r["group"]), r["shard"]) == r["shard"]
    for j in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == j)
        assert slots == list(range(len(slots)))
    assert {r["row"]["size"] for r in out} == {1}
    one = sharding.shard_documents(spark.createDataFrame([(1, "né")], "doc_id long, text string")).first()
    assert (one["size"], one["text_crc32"]) == (4, zlib.crc32("né".encode()))
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_loads_equal_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.shard_documents(d.select("doc_id", "text")).toPandas()
    sizes = out.assign(g=out["group"].map(bytes)).groupby("g")["size"].sum()
    got, want = sorted(out.groupby("shard")["size"].sum()), plain_lpt(list(sizes), 16)
    assert max(abs(a - b) for a, b in zip(got, want)) <= sizes.max() / 100


def test_rank_and_group_join_with_hot_keys(spark):
    from pyspark.sql import functions as F

    df = spark.range(6000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    got = ranked(df, ["k"], [F.col("v")], 6000, "r").collect()
    assert sorted(r["r"] for r in got if r["k"] == 0) == list(range(4000)) and {r["r"] for r in got if r["k"]} == {0}
    g = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"))
    j = join_groups(df, g, ["k"], "n", 6000)
    assert j.count() == 6000 and j.where("k = 0 and low <> 0").count() == 0


def test_rows_without_ids(spark, monkeypatch):
    from chiffra.llm import _common

    df = spark.createDataFrame([(i, str(i)) for i in range(200)] + [(None, "x"), (7, "again")], "doc_id long, __w string")
    ids = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "doc_id long")
    for words in (_common.FILTER_WORDS, 1):  # the second is a full bitmap
        monkeypatch.setattr(_common, "FILTER_WORDS", words)
        got = _common.without_ids(df.withColumnRenamed("__w", "v"), ids, "doc_id")
        assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got.collect()) == sorted([-1, 7] + [i for i in range(200) if i % 3])
