"""Operator 8, mixing sources to target weights by Pfair scheduling.

A source's rows, in an order drawn from their hashes, form blocks of ``block_rows`` rows. With target weight w its
i-th block is released at (i - 1) / w and due at i / w; each slot goes to the released block that is due earliest. As the
weights sum to one, no deadline is missed, so a source is never a whole block ahead of or behind its target, at any
length and for the targets themselves (weights are doubles, and time is compared to a billionth). Time is virtual: it
runs faster by the share of the sources that a fluid mixture would have used up by then, so that the others go on with
their weights scaled up, and the same bound holds against that mixture. ``phase`` counts those sources. No row is left
out or repeated.

The driver makes the schedule, with a heap of the sources, and every block looks up its slot in it. Each slot follows from
those before, so that is one pass, of some two microseconds a block; blocks have ``block_rows`` rows at any size. It holds
some hundred bytes a source and ``CHUNK`` blocks: what is decided goes to a table of the shared folder in between. A plan
of up to ``MOST_SENT`` blocks is broadcast, a longer one meets the rows in a shuffle, ``PIECE`` blocks of a source a row.

Default targets are the square roots of the sources' row counts. Null is a source of its own. Sources without a target
get the smallest target given; targets for absent sources are ignored. The last block of a source may be short. Blocks
due at the same time go by the source's name, null last. Repeated rows each get a place of their own; where ``docs`` is
read from files, their place there spreads them over tasks. Texts are only carried along, null, empty or very long.
Columns may have any names: they travel in one struct. An empty table gives an empty result. Which row gets which place
in its source depends on the number of rows (it sets the number of hash buckets), not on partitions or executors.
"""

import functools
import heapq
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm._common import documents, place_of, ranked, stored

BLOCK_ROWS = 8
#: Blocks in a row of the plan at most, in a plan that is broadcast, and between two writes of the plan.
PIECE, MOST_SENT, CHUNK = 1024, 2_000_000, 8_000_000


def slots(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """(source, phase) of each slot in turn: earliest deadline first among the blocks that are released."""
    total = math.fsum(weights)
    w = [x / total for x in weights]
    placed = [0] * len(blocks)
    on = [j for j, n in enumerate(blocks) if n]
    ends = sorted((blocks[j] / w[j], j) for j in on)  # of the fluid mixture, in virtual time
    rest = [0.0] * (len(ends) + 1)
    for k in range(len(ends) - 1, -1, -1):
        rest[k] = rest[k + 1] + w[ends[k][1]]
    later, ready, now, phase = [(0.0, j) for j in on], [], 0.0, 0
    for _ in range(sum(blocks)):
        while later and (later[0][0] <= now * (1 + 1e-12) + 1e-9 or not ready and later[0][0] <= now + 1e-6):
            _, j = heapq.heappop(later)
            heapq.heappush(ready, ((placed[j] + 1) / w[j], j))
        _, j = heapq.heappop(ready if ready else later)
        placed[j] += 1
        yield j, phase
        if placed[j] < blocks[j]:
            heapq.heappush(later, (placed[j] / w[j], j))
        left = 1.0  # of this slot's service, for the fluid mixture to hand out
        while phase < len(ends) and (ends[phase][0] - now) * rest[phase] <= left:
            left -= (ends[phase][0] - now) * rest[phase]
            now, phase = ends[phase][0], phase + 1
        if phase < len(ends):
            now += left / rest[phase]


def schedule(blocks: list[int], weights: list[float]) -> list[tuple[array, array]]:
    """(slots, phases) of each source's blocks."""
    out = [(array("q"), array("i")) for _ in blocks]
    for t, (j, phase) in enumerate(slots(blocks, weights)):
        out[j][0].append(t)
        out[j][1].append(phase)
    return out


def _pieces(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int, array, array]]:
    """(source, piece, phases, slots): the phases and slots of each source's blocks, ``PIECE`` blocks at a time."""
    held, number = {}, [0] * len(blocks)
    for t, (j, phase) in enumerate(slots(blocks, weights)):
        phases, at = held.setdefault(j, (array("i"), array("q")))
        phases.append(phase)
        at.append(t)
        if len(at) == PIECE:
            yield j, number[j], *held.pop(j)
            number[j] += 1
    for j, (phases, at) in held.items():
        yield j, number[j], phases, at


_KINDS = {"source": pa.string(), "piece": pa.int64(), "phases": pa.list_(pa.int32()), "slots": pa.list_(pa.int64())}


def _plan(spark: SparkSession, blocks: list[int], weights: list[float], names: list[str | None]) -> DataFrame:
    """(source, piece, phases, slots) as a table; beyond ``CHUNK`` blocks it is written in parts as it comes about."""
    parts, rows, size = [], [], 0

    def part() -> DataFrame:
        columns = [[names[r[0]] for r in rows], [r[1] for r in rows], *([np.asarray(r[k]) for r in rows] for k in (2, 3))]
        return spark.createDataFrame(pa.table({c: pa.array(v, t) for (c, t), v in zip(_KINDS.items(), columns, strict=True)}), "source string, piece long, phases array<int>, slots array<long>")

    for r in _pieces(blocks, weights):
        rows.append(r)
        size += len(r[3])
        if size >= CHUNK:
            parts.append(stored(part(), "mix-plan"))
            rows, size = [], 0
    parts.append(part())
    return functools.reduce(DataFrame.unionByName, parts)


def _placed(docs: DataFrame, targets: dict[str | None, float] | None, source: str, block_rows: int) -> tuple[DataFrame, int]:
    """The placed rows and the number of slots."""
    place = place_of(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source}`").cast("string").alias("source"), (F.lit(0) if place is None else place).alias("place"))
    counts = sorted(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    given = targets or {r["source"]: math.sqrt(r["n"]) for r in counts}
    weights = [max(given.get(r["source"], min(given.values())), 1e-12) for r in counts]
    total = sum(r["n"] for r in counts)
    blocks = [-(-r["n"] // block_rows) for r in counts]
    table = _plan(docs.sparkSession, blocks, weights, [r["source"] for r in counts])
    order = [F.xxhash64("row", F.lit(1)), F.xxhash64("row", F.lit(2)), F.col("place")]
    nth = ranked(rows, ["source"], order, total, "nth").withColumn("block", F.expr(f"nth div {block_rows}"))
    on = nth["source"].eqNullSafe(table["source"]) & (F.expr(f"block div {PIECE}") == table["piece"])
    out = nth.join(F.broadcast(table) if sum(blocks) <= MOST_SENT else table, on)
    k = (F.col("block") % PIECE + 1).cast("int")
    return out.select("row", nth["source"], "block", (F.col("nth") % block_rows).cast("int").alias("block_row"), F.element_at("phases", k).alias("phase"), F.element_at("slots", k).alias("slot")), sum(blocks)


def mix_sources(docs: DataFrame, targets: dict[str | None, float] | None = None, source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, source, block, block_row, phase, slot): ``row`` holds the columns of ``docs``; (slot, block_row) is the order."""
    return _placed(docs, targets, source, block_rows)[0]


def in_order(docs: DataFrame, targets: dict | None = None) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture; (slot, block_row) is unique. Slots are gapless, so equal ranges of
    them are the partitions, and no sampling pass is needed to find their bounds."""
    placed, slots = _placed(docs, targets, "source", BLOCK_ROWS)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.expr(f"cast(slot * {parts} div {max(1, slots)} as int)")
    return placed.repartitionById(parts, part).sortWithinPartitions("slot", "block_row").select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(stored(documents(spark, sf_dir).select("doc_id", "source"), "mix"))
    return out.select("row.doc_id", "source", "block", "block_row", "phase", "slot")
