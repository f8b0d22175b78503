"""Answers against their sources: sentences joined by similarity, summaries by coverage, numbers audited."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chiffra.functions import text as T
from chiffra.sources.index import kept


#: Words of the left sets that are sent out, at 8 bytes each.
MOST_SENT = 500_000


def sharing(rows: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """``rows`` (s, ...) of which a share of ``least`` of the set or more is in ``words`` (w), and few others; none that is empty. It goes
    by hashes of words, so a set stays where it is; with more than ``MOST_SENT`` words all rows with a word pass."""
    known = words.select(F.xxhash64("w").alias("h")).distinct().limit(MOST_SENT + 1).toArrow()["h"].to_numpy()
    if len(known) > MOST_SENT:
        return rows.where(F.size("s") > 0)
    sent = rows.sparkSession.sparkContext.broadcast(np.sort(known))

    @F.arrow_udf("boolean")
    def enough(hashes: pa.Array) -> pa.Array:
        words, size, h = sent.value, np.diff(hashes.offsets.to_numpy()), hashes.flatten().to_numpy()
        hit = np.searchsorted(words, h, "right") > np.searchsorted(words, h)
        held = np.bincount(np.repeat(np.arange(len(size)), size), hit, len(size))
        return pa.array((size > 0) & (held >= least * size - 1e-9))

    return rows.where(enough(F.transform("s", lambda w: F.xxhash64(w))))


def similar_sets(left: DataFrame, right: DataFrame, least: float, first: bool = False) -> DataFrame:
    """(a, b, sim) of ``left`` (a, s) and ``right`` (b, s), token sets whose Jaccard similarity is ``least`` or more; with ``first``, of
    right rows of equal sets the smallest b stands for all.

    Sets of ``right`` that hold too few words of ``left`` go where they are read, before any shuffle. The others are written
    once, rows of equal sets as one, and all later steps read that table. Words are ordered by how many of those sets hold them. Two sets as
    similar as that share ceil(least |s|) words or more, so the rarest shared one is, counted from the most frequent, at
    that place or behind it; only words there are joined, of sets whose sizes allow it. So a word that many sets hold gives
    no pairs of its own, as it comes last."""

    def distinct(t: DataFrame, name: str, of: Column) -> DataFrame:
        return kept(t.groupBy(F.array_sort("s").alias("s")).agg(of.alias(name)).withColumn("set", F.monotonically_increasing_id()), f"sets-{name}")

    l = distinct(left.where(F.size("s") > 0), "a", F.collect_list("a"))
    words = l.select(F.explode("s").alias("w")).distinct()
    r = distinct(sharing(right, words, least), "b", F.array(F.min("b")) if first else F.collect_list("b"))
    df = r.select(F.explode("s").alias("w")).join(words, "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def prefix(t: DataFrame) -> DataFrame:
        held = t.select("set", F.size("s").alias("size"), F.explode("s").alias("w")).join(df, "w")
        nth = F.row_number().over(Window.partitionBy("set").orderBy(F.col("df").desc(), F.col("w").desc()))
        return held.withColumn("nth", nth).where(F.col("nth") >= F.ceil(least * F.col("size") - 1e-9)).select("set", "size", "w")

    x, y = prefix(l).withColumnsRenamed({"set": "x", "size": "nx"}), prefix(r).withColumnsRenamed({"set": "y", "size": "ny"})
    fits = (F.col("nx") >= least * F.col("ny") - 1e-9) & (F.col("ny") >= least * F.col("nx") - 1e-9)
    pairs = x.join(y, "w").where(fits).select("x", "y").distinct()
    both = pairs.join(l.withColumnsRenamed({"set": "x", "s": "sx"}), "x").join(r.withColumnsRenamed({"set": "y", "s": "sy"}), "y").withColumn("sim", T.jaccard_of(F.col("sx"), F.col("sy"))).where(F.col("sim") >= least)
    return both.select(F.explode("a").alias("a"), "b", "sim").select("a", F.explode("b").alias("b"), "sim")


def attached(sentences: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, block, overlap): the block of the answer's own context (keys, block, words) that holds most of a sentence's
    words (keys, position, words); the first on ties, and the first of all where nothing is shared."""
    s = sentences.select(*keys, "position", F.size("words").alias("n"), F.explode("words").alias("w"))
    met = s.join(blocks.select(*keys, "block", F.explode("words").alias("w")), [*keys, "w"]).groupBy(*keys, "position", "block").agg((F.count(F.lit(1)) / F.first("n")).alias("overlap"))
    best = met.groupBy(*keys, "position").agg(F.max_by(F.struct("block", "overlap"), F.struct(F.round("overlap", 12), -F.col("block"))).alias("b"))
    first = blocks.groupBy(*keys).agg(F.min("block").alias("first"))
    out = sentences.select(*keys, "position").join(best, [*keys, "position"], "left").join(first, keys)
    return out.select(*keys, "position", F.coalesce("b.block", "first").alias("block"), F.coalesce("b.overlap", F.lit(0.0)).alias("overlap"))


def summary(candidates: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, step, rank, pos, gain): up to ``most`` sentences (key, rank, pos, covers: the question's words that it holds), each the
    one that adds most words not covered yet, the first on ties; none that adds nothing.

    Of sentences that cover the same words the first stands for all, so a question brings as many rows to the choice as there
    are different coverages. A gain only falls as more is covered, so the choice is within 63 % of the best possible one."""
    one = candidates.where(F.size("covers") > 0).groupBy(key, F.array_sort("covers").alias("covers")).agg(F.min(F.struct("rank", "pos")).alias("at"))
    held = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "covers"))).alias("all"))
    kind = candidates.select("rank", "pos").schema
    at = f"struct<rank:{kind['rank'].dataType.simpleString()},pos:{kind['pos'].dataType.simpleString()}>"
    start = F.struct(F.array().cast("array<string>").alias("covered"), F.array().cast(f"array<struct<step:int,at:{at},gain:int>>").alias("chosen"))

    def choose(s: Column, step: Column) -> Column:
        gains = F.transform("all", lambda x, i: F.struct(F.size(F.array_except(x["covers"], s["covered"])).alias("gain"), (-i).alias("first"), x["at"].alias("at"), x["covers"].alias("covers")))
        best = F.array_max(gains)
        more = F.struct(F.array_union(s["covered"], best["covers"]).alias("covered"), F.concat(s["chosen"], F.array(F.struct(step.alias("step"), best["at"].alias("at"), best["gain"].alias("gain")))).alias("chosen"))
        return F.when(best["gain"] > 0, more).otherwise(s)

    picked = held.select(key, F.inline(F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, choose)["chosen"]))
    return picked.select(key, "step", "at.rank", "at.pos", "gain")


def number_audit(answers: DataFrame, sources: DataFrame, key: str, pattern: str = r"[0-9]+(?:[.,  ][0-9]+)*") -> DataFrame:
    """(key, total, supported, accuracy): how many numbers of each answer (key, text) stand in its source (key, text), digit for
    digit, whatever separates the digits; an answer without numbers is accurate. Each different number meets its source once."""
    digits = lambda t: t.select(key, F.explode(F.transform(F.regexp_extract_all("text", F.lit(pattern), 0), lambda x: F.regexp_replace(x, "[^0-9]", ""))).alias("d"))
    asked = digits(answers).groupBy(key, "d").agg(F.count(F.lit(1)).alias("n"))
    met = asked.join(digits(sources).distinct().withColumn("known", F.lit(1)), [key, "d"], "left")
    per = met.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("supported"))
    out = answers.select(key).join(per, key, "left").select(key, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("supported", F.lit(0)).alias("supported"))
    return out.withColumn("accuracy", F.coalesce(F.col("supported") / F.nullif("total", F.lit(0)), F.lit(1.0)))
