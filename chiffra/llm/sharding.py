"""Operator 1, sharding by longest processing time: groups of equal texts, largest first, to the least loaded shard.

The heap runs over size classes, not over groups: a size is kept to twelve significant bits, so there are at most
about 2,048 classes for each doubling of the size (below 4,096 bytes a class is one size) and the driver's table has
a proven bound of some 80,000 rows at any input. Groups of one class weigh the same to the heap, so the number that
each shard takes of a class follows from the class's count alone; which groups these are is settled by their rank in
the class, which is computed in parallel. Where classes are single sizes, the loads are those of the plain algorithm.

Null texts form one group of size 1 a row, apart from that of empty texts. A null doc_id is an ordinary value.
Repeated rows go to the same shard, each in a slot of its own. Of groups and shards that weigh the same, the order of the
groups' digests and the lowest shard decide. A very long text is a group of its size, kept whole. An empty table gives
an empty result; columns may have any names, since they travel in one struct. Slots depend on the rows and their number
(it sets the number of hash buckets), not on partitions or executors, apart from equal rows, which may change places.
"""

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm._common import documents, join_groups, ranked, stored

SHARDS = 16
#: Significant bits of a size that tell classes apart.
BITS = 12


def lpt_counts(classes: Iterable[tuple[int, int, float]], shards: int) -> tuple[dict[int, list[int]], list[float]]:
    """How many groups of each (class, groups, mean size) every shard takes, and the loads.

    Equal jobs go to the lowest of the levels ``load + k * size``; all below a level found by bisection are taken at
    once and the heap deals out the rest, which is what the heap alone would do job by job."""
    loads, took = [0.0] * shards, {}
    for key, n, size in sorted(classes, key=lambda c: (-c[2], c[0])):
        counts = [0] * shards
        if n > 4 * shards:
            lo, hi = min(loads), max(loads) + (n / shards + 2) * size
            below = lambda level: [max(0, int((level - x) // size)) for x in loads]  # noqa: B023, E731
            for _ in range(100):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(below(mid)) <= n else (lo, mid)
            counts = below(lo)
        heap = [(x + c * size, j) for j, (x, c) in enumerate(zip(loads, counts, strict=True))]
        heapq.heapify(heap)
        for _ in range(n - sum(counts)):
            x, j = heapq.heappop(heap)
            counts[j] += 1
            heapq.heappush(heap, (x + size, j))
        loads = [x + c * size for x, c in zip(loads, counts, strict=True)]
        took[key] = counts
    return took, loads


def written_order(docs: DataFrame) -> DataFrame:
    """``docs``, read from Parquet files, with the files' order (``__file``, from 0) and a row's place in its file (``__at``)."""
    rows = docs.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))
    paths = sorted((r["__path"] for r in rows.select("__path").distinct().collect()), key=lambda p: (len(p), p))
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), "__file int, __path string")
    return rows.join(F.broadcast(files), "__path").drop("__path")


def shard_documents(docs: DataFrame, shards: int = SHARDS, written: bool = False) -> DataFrame:
    """(row, size, text_crc32, group, shard, slot): ``row`` holds the document's columns without its text. Slots follow the
    order in which the files of ``docs`` hold the rows where ``written`` is true, else the rows' hashes."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != "text"]
    place = ["__file", "__at"] if written else []
    docs = written_order(docs) if written else docs
    rows = stored(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"null")).alias("group"),
            *(place or [F.monotonically_increasing_id().alias("__at")]),
        ),
        "shard-rows",
    )
    shift = F.greatest(F.length(F.bin("load")) - BITS, F.lit(0))
    groups = stored(
        rows.groupBy("group").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("copies")).withColumn("shift", shift).withColumn("class", F.expr("shiftleft(shiftright(load, shift), shift)")).drop("shift"),
        "shard-groups",
    )
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg("load").alias("mean"), F.sum("copies").alias("rows")).collect()
    took, _ = lpt_counts([(r["class"], r["n"], r["mean"]) for r in classes], shards)
    upto = [(k, [sum(v[: j + 1]) for j in range(shards)]) for k, v in took.items()]
    deal = spark.createDataFrame(upto, "class long, upto array<long>")
    total = sum(r["rows"] for r in classes)
    placed = ranked(groups, ["class"], [F.col("group")], sum(r["n"] for r in classes)).join(F.broadcast(deal), "class")
    placed = placed.select("group", "copies", F.size(F.filter("upto", lambda c: c <= F.col("rank"))).alias("shard"))
    out = join_groups(rows, stored(placed, "shard-placed"), ["group"], "copies", total).drop("copies")
    if not written:
        # Equal rows differ in nothing but the number that the stored table gives them, which spreads them over buckets.
        return ranked(out, ["shard"], [F.xxhash64("row"), F.col("group"), F.col("__at")], total, "slot").drop("__at")
    return ranked(out, ["shard"], [F.col(c) for c in place], total, "slot", F.struct("__file", F.expr("__at div 100000"))).drop(*place)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
