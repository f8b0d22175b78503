"""Operator 11, filter interaction audit: what each filter removes in every order, with exact duplicates by partition refinement.

Duplicates: texts are split by their length in code points and then by the hash of one block after another, each ``GROWTH``
times as long as the one before; what is alone in its class drops out before the next block. A broadcast bitmap of fixed
size tells which rows share a class, so that texts stay where they are; rows that are let through by mistake drop out in
the next round, or in the last step, which compares the full texts of what is left: one copy of each distinct text of a
task travels, whatever the size of its group. Classes in which hashes have agreed and texts haven't are told apart by
their texts. All but the smallest doc_id of equal texts fail.

Counting: a document's failed filters are the bits of a mask. Documents are counted by part and mask, so what goes
through all orders is one row a part, and each figure of an order is a sum over masks.

A null text counts as empty, and empty texts are equal. A null part is the part of the empty string. A null doc_id is
neither smaller nor larger than another, so its row never fails as a duplicate, and it has no labels. Rows that share
doc_id and text are not smaller than one another; each counts. A doc_id is labelled with a quality or toxicity of 1 if any
of its label rows is; other values and null don't count. Texts are compared whole, however long. An empty table gives an
empty result. Other columns are not read; columns of any name may stand beside.
"""

import itertools
import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm._common import documents, dropped, join_groups, marked_ids, stored

#: Code points of the first block, and how much longer each block is than the one before.
FIRST, GROWTH = 256, 64

_WORDS = r"[^\x20\x09-\x0D]+"


def default_filters() -> dict[str, Column]:
    """Failure conditions over ``text``, ``words`` (array) and ``length`` (code points)."""
    n = F.size("words")
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct("words")) < 65 * n,
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 5 * F.col("length"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def _block(k: int) -> tuple[int, int]:
    """Start (from 0) and size of the k-th block."""
    size = FIRST * GROWTH**k
    return (size - FIRST) // (GROWTH - 1), size


def _refined(cls: Column, k: int, keep: int) -> Column:
    """The class of a text once its k-th block is known too."""
    start, size = _block(k)
    deeper = F.xxhash64(cls, F.substr("text", F.lit(start + 1), F.lit(size))).bitwiseAND(keep)
    return F.when(F.col("length") > start, deeper).otherwise(cls)


def _shared(rows: DataFrame) -> DataFrame:
    """The classes of two rows or more."""
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class")


def refined(rows: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``rows`` (with text, length and class after the first block) that still share a class after the last block."""
    keep = (1 << hash_bits) - 1 if hash_bits < 64 else -1
    longest = rows.agg(F.max("length").alias("n")).first()["n"] or 0
    k = 1
    while _block(k)[0] < longest:
        rows = rows.withColumn("class", _refined(F.col("class"), k, keep))
        hits = stored(_shared(rows), "audit-classes")
        marked, hit = marked_ids(rows, hits, "class")
        rows = marked.where(hit).select(*rows.columns)
        k += 1
    return rows


def duplicates(rows: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Those of ``rows`` (doc_id, text, length, class) that are still in company after the last block, without their text and
    with ``copy``: a smaller doc_id has the same text. The others are no copies."""
    left = refined(rows, hash_bits)
    texts = left.groupBy("class", "text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = stored(texts.groupBy("class").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1"), "audit-firsts")
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    others = [c for c in rows.columns if c not in ("text", "length")]
    narrow = left.select(*others)
    one = join_groups(narrow, classes.where("texts = 1").select("class", "first", "n"), ["class"], "n", total, "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    copies = one.select(*[c for c in others if c != "class"], copy.alias("copy"), "class")
    mixed = classes.where("texts > 1").select("class")
    if not mixed.isEmpty():
        several = left.join(mixed, "class").join(texts.select("class", "text", "first"), ["class", "text"])
        copies = copies.join(mixed, "class", "left_anti").unionByName(several.select(*others, copy.alias("copy")))
    return copies.drop("class")


def orders(letters: str) -> Column:
    """array<struct> of every order's steps: the filter's bit, and the masks that are kept, removed and redundant there."""
    steps, masks = [], range(1 << len(letters))
    for order in itertools.permutations(letters):
        before = 0
        for i, letter in enumerate(order):
            bit = 1 << letters.index(letter)
            kept = [m for m in masks if not m & (before | bit)]
            removed = [m for m in masks if m & bit and not m & before]
            redundant = [m for m in masks if m & bit and m & before]
            steps.append({"filter_order": "".join(order), "step": i + 1, "bit": bit, "kept_masks": kept, "removed_masks": removed, "redundant_masks": redundant})
            before |= bit
    kind = "array<struct<filter_order:string,step:int,bit:int,kept_masks:array<int>,removed_masks:array<int>,redundant_masks:array<int>>>"
    return F.from_json(F.lit(json.dumps(steps)), kind)


def audited(cells: DataFrame, letters: str) -> DataFrame:
    """The audit of (part, mask, n, good, toxic): one row per part, order and step."""
    per = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("by_mask"))
    masks = F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))
    count = lambda name: F.transform(masks, lambda m: F.coalesce(F.try_element_at("by_mask", m)[name], F.lit(0).cast("long"))).alias(name)
    arrays = per.select("part", count("n"), count("good"), count("toxic")).select("*", F.inline(orders(letters)))
    add = lambda counts, of: F.aggregate(of, F.lit(0).cast("long"), lambda s, m: s + F.get(F.col(counts), m))
    n_orders = math.factorial(len(letters))
    share = F.aggregate(
        F.filter(masks, lambda m: m.bitwiseAND(F.col("bit")) != 0),
        F.lit(0).cast("long"),
        lambda s, m: s + F.get(F.col("n"), m) * (n_orders / F.bit_count(m)).cast("long"),
    )
    return arrays.select(
        "part", "filter_order", "step",
        add("n", F.col("kept_masks")).alias("kept"), add("n", F.col("removed_masks")).alias("removed"), add("n", F.col("redundant_masks")).alias("redundant"),
        F.get("n", F.col("bit")).alias("unique_fails"), add("good", F.col("removed_masks")).alias("good_lost"), add("toxic", F.col("removed_masks")).alias("toxic_lost"), share.alias("shapley"),
    )


def masked(docs: DataFrame, filters: Mapping[str, Column] | None = None, duplicate: str = "E", part: str = "source", hash_bits: int = 64) -> tuple[DataFrame, str]:
    """(doc_id, part, mask) of every document and the filters' letters in the order of their bits. The filter ``duplicate``
    is that of exact copies and has the highest bit."""
    filters = filters or default_filters()
    letters = "".join(filters) + duplicate
    keep = (1 << hash_bits) - 1 if hash_bits < 64 else -1
    text = F.coalesce(F.col("text"), F.lit(""))
    lengths = docs.select(F.col("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.length(text).cast("long").alias("length"))
    first = lengths.withColumn("class", F.xxhash64("length", F.substr("text", F.lit(1), F.lit(FIRST))).bitwiseAND(keep))
    hits = stored(_shared(first), "audit-classes")
    marked, hit = marked_ids(first, hits, "class")
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    counted = marked.select("doc_id", "part", "text", "length", "class", hit.alias("hit"), F.regexp_extract_all("text", F.lit(_WORDS), 0).alias("words"))
    # Texts of rows that are alone in their class are not stored.
    rows = stored(counted.select("doc_id", "part", bits.alias("mask"), "length", "class", F.when(F.col("hit"), F.col("text")).alias("text")), "audit-rows")
    found = duplicates(rows.where("text is not null"), hash_bits)
    last = 1 << len(filters)
    # A row that leaves the refinement early has no pair; it is counted with those that never had one.
    alone = rows.select("doc_id", "part", "mask", F.lit(1).alias("n"))
    copies = found.where("copy").select("doc_id", "part", "mask", F.lit(1).alias("n"))
    every = alone.unionByName(copies.withColumn("n", F.lit(-1))).unionByName(copies.withColumn("mask", F.col("mask") + last))
    dropped(hits)
    return every, letters


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, duplicate: str = "E", part: str = "source", hash_bits: int = 64) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    every, letters = masked(docs, filters, duplicate, part, hash_bits)
    label = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good or toxic")
    # Rows of one doc_id are added up before they meet its label, so no doc_id is hot in the join.
    rows = every.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n > 0").join(label, "doc_id", "left")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return audited(rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic")), letters)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


SQL = {
    "op11_filter_audit": r"""with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, min(doc_id) over (partition by t) f from d),
m as (select doc_id, part, (case when len(ws) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 4 else 0 end) + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
    + (case when doc_id > f then 16 else 0 end) mask from w),
l as (select doc_id, coalesce(bool_or(quality = 1), false) good, coalesce(bool_or(toxic = 1), false) toxic from labels group by 1),
c as (select part, mask, count(*) n, count(*) filter (good) g, count(*) filter (toxic) x from m left join l using (doc_id) group by 1, 2),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) a, unnest([1, 2, 4, 8, 16]) b),
o as (select p.a || q.a || r.a || s.a || t.a filter_order, [p.b, q.b, r.b, s.b, t.b] bits from f p, f q, f r, f s, f t where len(list_distinct([p.a, q.a, r.a, s.a, t.a])) = 5),
steps as (select filter_order, i step, bits[i] bit, list_sum(bits[1:i]) upto, list_sum(bits[1:i]) - bits[i] before from o, unnest(range(1, 6)) u(i))
select part, filter_order, step::int step, coalesce(sum(n) filter (mask & upto = 0), 0)::bigint kept,
    coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint removed, coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0)::bigint redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint unique_fails, coalesce(sum(g) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint good_lost,
    coalesce(sum(x) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint toxic_lost,
    coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) filter (mask & bit <> 0), 0)::bigint shapley
from steps, c group by part, filter_order, step, bit""",
}
