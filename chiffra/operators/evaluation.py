"""Evaluation statistics: ROUGE, Wilcoxon, kappa, Kendall, latency, verdicts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chiffra.functions import text as T
from chiffra.functions.numbers import let


def words(c: Column) -> Column:
    return F.regexp_extract_all(T.normalised(c), F.lit("[a-z0-9]+"), 0)


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    if not a or not b:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(b))}
    y = np.array([code[w] for w in b])
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        if (k := code.get(w)) is not None:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == k, row[:-1] + 1, 0)))
    return int(row[-1])


@F.pandas_udf(DoubleType())
def rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """ROUGE-L F1 of two word arrays."""
    out = []
    for a, b in zip(candidate, reference, strict=True):
        a, b = list(a) if a is not None else [], list(b) if b is not None else []
        n = _lcs(a, b)
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out)


def ngrams(c: Column, n: int) -> Column:
    """The n-grams of a word array, as strings. The array is computed once, not once a place."""
    if n == 1:
        return c
    return let(c, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))))


def rouge_n_recall(candidate: Column, reference: Column, n: int) -> Column:
    """Share of the reference's distinct n-grams that the candidate has."""
    share = lambda r: F.when(F.size(r) == 0, 0.0).otherwise(F.size(F.array_intersect(r, ngrams(candidate, n))) / F.size(r))
    return let(F.array_distinct(ngrams(reference, n)), share)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


#: Up to so many differences without ties and zeros the test's p is exact.
EXACT_UP_TO = 50


def rank_sums(n: Column) -> Column:
    """For n ranks, in how many of the 2^n ways to choose among them the chosen add up to 0, 1, 2, ...: each rank's generating
    polynomial 1 + x^k is multiplied in by a shifted sum."""
    add = lambda s, k: F.transform(F.sequence(F.lit(0), F.size(s) + k - 1), lambda i: F.coalesce(F.get(s, i), F.lit(0.0)) + F.coalesce(F.get(s, i - k), F.lit(0.0)))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(1.0)), add))


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, to some 15 digits behind the point."""
    step = lambda s, k: F.struct((s["term"] * 2 * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * 2 * x * x / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(x.alias("term"), x.alias("sum")), step)["sum"]
    return F.when(x > 6, 0.0).otherwise(1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series)


def signed_rank_p(w: Column, n: Column, z: Column, exact: Column, alternative: str = "two-sided") -> Column:
    """p of the statistic: the exact distribution of rank sums, or the normal one. ``w`` is the smaller sum for the two-sided test,
    the positive one for "greater"."""
    ways = rank_sums(F.when(exact, n).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    upto = total(F.slice(ways, F.lit(1), F.floor(w).cast("int") + 1))
    over = total(F.slice(ways, F.ceil(w).cast("int") + 1, F.size(ways)))
    if alternative == "two-sided":
        return F.when(exact, F.least(F.lit(1.0), 2 * upto / F.pow(F.lit(2.0), n))).otherwise(erfc(F.abs(z) / math.sqrt(2)))
    upper = erfc(F.abs(z) / math.sqrt(2)) / 2
    return F.when(exact, over / F.pow(F.lit(2.0), n)).otherwise(F.when(z >= 0, upper).otherwise(1 - upper))


def wilcoxon(pairs: DataFrame, by: list[str], alternative: str = "two-sided") -> DataFrame:
    """Signed-rank test of (by, a, b): win, loss, tie, statistic ``w``, ``z`` with tie correction, and ``p``; zeros are dropped, equal
    sizes share their average rank. p is exact without ties and zeros up to ``EXACT_UP_TO`` differences. All three are null where
    nothing differs. Differences of one size are counted before they are ranked, so the window runs over sizes."""
    d = pairs.withColumn("d", F.round(F.col("a") - F.col("b"), 12))
    counts = d.groupBy(*by).agg(F.count_if(F.col("d") > 1e-12).alias("win"), F.count_if(F.col("d") < -1e-12).alias("loss"), F.count_if(F.abs("d") <= 1e-12).alias("tie"))
    sizes = d.where("d <> 0").groupBy(*by, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    run = Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("r", F.coalesce(F.sum("t").over(run), F.lit(0)) + (F.col("t") + 1) / 2)
    agg = sizes.groupBy(*by).agg(F.sum(F.col("up") * F.col("r")).alias("wp"), F.sum((F.col("t") - F.col("up")) * F.col("r")).alias("wm"), F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).alias("tt"))
    w = F.least("wp", "wm") if alternative == "two-sided" else F.col("wp")
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tt") / 48
    out = counts.join(agg, by, "left").select(*by, "win", "loss", "tie", w.alias("w"), ((w - n * (n + 1) / 4) / F.sqrt(F.nullif(var, F.lit(0.0)))).alias("z"), "n", (F.coalesce(F.col("tt") == 0, F.lit(False)) & (F.col("tie") == 0) & (n <= EXACT_UP_TO)).alias("exact"))
    return out.withColumn("p", signed_rank_p(F.col("w"), n, F.col("z"), F.col("exact"), alternative)).drop("n", "exact")


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of (a, b), with the number of pairs and the observed agreement; null where chance agreement is 1."""
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "k").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("ab"))
    po, pe = F.col("same") / F.col("t"), F.col("ab") / (F.col("t") * F.col("t"))
    return total.crossJoin(chance).select(F.col("t").alias("n"), po.alias("observed"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def inversions(ranked: DataFrame) -> DataFrame:
    """(n): pairs in which the row that comes first by (x, y) has the larger y. Ranks of y are taken bit by bit: rows that
    agree in all higher bits and differ in this one are counted by a running sum, so there are as many passes as bits and
    no pair is formed."""
    by_y = ranked.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    rank = by_y.withColumn("r", F.row_number().over(Window.orderBy("y")).cast("long") - 1).select("y", "r")  # the values of one ranking
    levels = F.sequence(F.lit(0), F.lit(31))
    bits = ranked.join(rank, "y").withColumn("level", F.explode(levels)).withColumn("group", F.expr("shiftright(r, level + 1)")).withColumn("bit", F.expr("shiftright(r, level) & 1"))
    before = Window.partitionBy("level", "group").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, -1)
    return bits.withColumn("ones", F.coalesce(F.sum("bit").over(before), F.lit(0))).agg(F.coalesce(F.sum(F.when(F.col("bit") == 0, F.col("ones"))), F.lit(0)).alias("n"))


def kendall(pairs: DataFrame) -> DataFrame:
    """Kendall's tau-b of ranked items (id, x, y), by counting inversions."""
    tied = lambda *c: pairs.groupBy(*c).agg(F.count(F.lit(1)).alias("t")).agg(F.coalesce(F.sum(F.col("t") * (F.col("t") - 1) / 2), F.lit(0.0)).alias("_".join(["t", *c])))
    all_ = pairs.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("all"))
    c = all_.crossJoin(tied("x")).crossJoin(tied("y")).crossJoin(tied("x", "y")).crossJoin(inversions(pairs.select("x", "y")).withColumnRenamed("n", "discordant"))  # one row each
    c = c.withColumn("concordant", F.col("all") - F.col("t_x") - F.col("t_y") + F.col("t_x_y") - F.col("discordant"))
    tau = (F.col("concordant") - F.col("discordant")) / F.nullif(F.sqrt((F.col("all") - F.col("t_x")) * (F.col("all") - F.col("t_y"))), F.lit(0.0))
    return c.select(F.col("concordant").cast("long").alias("concordant"), F.col("discordant").cast("long").alias("discordant"), tau.alias("tau"))


def relevant(hits: DataFrame, want: DataFrame) -> DataFrame:
    """``hits`` (qid, file, page, page_end, …) of questions with relevant pages (qid, file, pages), and ``rel``: whether the hit
    covers a relevant page of its file. Files meet by equality; the interval is looked up in the pages of one file."""
    asked = hits.join(want.select("qid").distinct(), "qid", "left_semi")
    j = asked.join(want, ["qid", "file"], "left")
    return j.withColumn("rel", F.coalesce(F.exists("pages", lambda p: p.between(F.col("page"), F.col("page_end"))), F.lit(False))).drop("pages")


def ideal_gain(n: Column, k: int = 5) -> Column:
    """The gain of a ranking whose first places are all relevant, of ``n`` relevant pages (1 at least)."""
    return F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def configuration_means(judged: DataFrame, want: DataFrame, k: int = 5) -> DataFrame:
    """(config, n, success_1, success_5, mrr, ndcg_5): means over questions of rows (config, qid, rank, rel)."""
    n = want.groupBy("qid").agg(F.sum(F.size("pages")).alias("pages"))
    top = lambda c, at: F.max(F.when(F.col("rel") & (F.col("rank") <= at), c).otherwise(0.0))
    gain = F.sum(F.when(F.col("rel") & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    per = judged.groupBy("config", "qid").agg(top(1.0, 1).alias("s1"), top(1.0, k).alias("s5"), F.coalesce(F.max(F.when(F.col("rel"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"), gain.alias("dcg")).join(n, "qid")
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return per.groupBy("config").agg(F.count(F.lit(1)).alias("n"), mean("s1", "success_1"), mean("s5", "success_5"), mean("rr", "mrr"), mean(F.col("dcg") / ideal_gain(F.col("pages"), k), "ndcg_5"))


def verdict(c: str) -> Column:
    """Aggregate: any false is not validated, else any null is inconclusive, else validated."""
    return F.when(F.count_if(~F.col(c)) > 0, "not validated").when(F.count_if(F.col(c).isNull()) > 0, "inconclusive").otherwise("validated")
