"""Year-over-year variations, trends and saliency of table cells; reconciliation of totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chiffra.functions import numbers as N

LEVEL = r"(?i)^\s*(effectifs?|nombres?|valeurs?|montants?)\s*$"


def first_cells(values: DataFrame, keys: list[str], until: str | None = None) -> DataFrame:
    """One cell per series and year: the first by value_id; none after ``until`` (a column)."""
    v = values.where("value is not null and year is not null")
    if until:
        v = v.where(F.col("year") <= F.col(until))
    return v.groupBy(*keys, "year").agg(F.min_by(F.struct("value", "value_id"), "value_id").alias("c")).select(*keys, "year", "c.*")


def extended(cells: DataFrame, keys: list[str], sub: str = "sub") -> DataFrame:
    """A level sub-column ("Nombre", "Montant", ...) also has the years of the plain series that it lacks itself."""
    level = cells.where(F.col(sub).rlike(LEVEL)).select(*keys).distinct()
    rest = [k for k in keys if k != sub]
    plain = cells.where(F.col(sub) == "").drop(sub)
    inherited = level.join(plain, rest).join(cells.select(*keys, "year"), [*keys, "year"], "left_anti")
    return cells.unionByName(inherited.select(cells.columns))


def change(v, ref, dec: int = 0, dec_pct: int = 1):
    """(absolute change, relative change in per cent; null where the reference is 0)"""
    return F.round(v - ref, dec), F.round(100 * (v - ref) / F.nullif(ref, F.lit(0.0)), dec_pct)


def variations(cells: DataFrame, keys: list[str], year: int | None = None, dec: int = 0, dec_pct: int = 1) -> DataFrame:
    """Each cell against every earlier year of its series, with both cells' ids. ``year`` keeps one current year.

    The earlier years are gathered along the window, so a series is shuffled once and no range join is needed."""
    w = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    past = F.collect_list(F.struct(F.col("year").alias("ref_year"), F.col("value").alias("ref"), F.col("value_id").alias("ref_id"))).over(w)
    out = cells.withColumn("past", past)
    if year is not None:
        out = out.where(F.col("year") == year)
    out = out.select(*keys, "year", "value", "value_id", F.explode("past").alias("p")).select(*keys, "year", "value", "value_id", "p.*")
    a, r = change(F.col("value"), F.col("ref"), dec, dec_pct)
    return out.withColumn("var_abs", a).withColumn("var_rel", r)


def cross_edition(current: DataFrame, previous: DataFrame, keys: list[str], dec: int = 0) -> DataFrame:
    """Undated cells against the cell of the same key in every earlier edition; the last cell of an edition counts."""
    last = previous.groupBy(*keys, "edition").agg(F.max_by(F.struct("value", "value_id"), "value_id").alias("c")).select(*keys, F.col("edition").alias("ref_edition"), F.col("c.value").alias("ref"), F.col("c.value_id").alias("ref_id"))
    out = current.join(last, keys).where("ref_edition < edition")
    a, r = change(F.col("value"), F.col("ref"), dec)
    return out.withColumn("var_abs", a).withColumn("var_rel", r)


def variations_of_writings(cells: DataFrame, keys: list[str], dec_pct: int = 1) -> DataFrame:
    """Each cell (keys, year, value, writing, value_id) against every earlier year of its series. The absolute change has as
    many decimals as the longer of the two writings; both changes come with their own writing."""
    w = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    past = F.collect_list(F.struct(F.col("year").alias("ref_year"), F.col("value").alias("ref"), F.col("writing").alias("ref_writing"), F.col("value_id").alias("ref_id")))
    v = cells.withColumn("__p", past.over(w)).select("*", F.inline("__p")).drop("__p")
    v = v.withColumn("decimals", F.greatest(N.decimals(F.col("writing")), N.decimals(F.col("ref_writing"))))
    scale = F.pow(F.lit(10.0), F.col("decimals").cast("double"))
    v = v.withColumn("var_abs", F.round(F.round((F.col("value") - F.col("ref")) * scale, 6), 0) / scale)
    v = v.withColumn("var_rel", F.round(100 * (F.col("value") - F.col("ref")) / F.nullif("ref", F.lit(0.0)), dec_pct))
    text = F.translate(F.call_function("format_number", F.abs("var_abs"), F.col("decimals")), ",.", " ,")
    signed = F.when((F.col("var_abs") < 0) & text.rlike("[1-9]"), F.concat(F.lit("-"), text)).otherwise(text)
    return v.withColumn("abs_text", signed).withColumn("rel_text", N.formatted(F.col("var_rel"), dec_pct))


def successive(cells: DataFrame, keys: list[str], order: str = "year") -> DataFrame:
    """Relative change in per cent from the value before; rows after a zero or at the start have none."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag("value").over(w)
    return cells.withColumn("change", F.when(prev != 0, 100 * (F.col("value") - prev) / prev))


def trend(changes: DataFrame, keys: list[str], order: str = "year", n: int = 3) -> DataFrame:
    """``trend`` after each change: rising, falling, one-off or short, by the last ``n`` changes."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    c = changes.where("change is not null")
    label = F.when(F.count("change").over(w) < n, "short").when(F.min("change").over(w) > 0, "rising").when(F.max("change").over(w) < 0, "falling").otherwise("one-off")
    return c.withColumn("trend", label)


def saliency(changes: DataFrame, keys: list[str], order: str = "year", least: int = 3, bonus: Column | None = None) -> DataFrame:
    """|change| over the standard deviation of the changes before it, or |change| with too short or flat a history, and a
    bonus, as for a documented objective. The history ends before the row, so it never holds the change itself."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    c = changes.where("change is not null").withColumn("n_history", F.count("change").over(w)).withColumn("sd", F.stddev_pop("change").over(w))
    use = (F.col("n_history") >= least) & (F.col("sd") > 0)
    return c.withColumn("score", F.when(use, F.abs("change") / F.col("sd")).otherwise(F.abs("change")) + (F.lit(0.0) if bonus is None else bonus)).withColumn("base", F.when(use, "sd").otherwise("change"))


def ordered_dedup(candidates: DataFrame, by: str, key1: str, key2: str, most: int) -> DataFrame:
    """Rows of each list (by), in order of ``rank``, such that none shares ``key1`` or ``key2`` with a row taken before; at most
    ``most`` a list. What is taken depends on what was taken, so each list is scanned in order, as one array: a list is
    the evolutions of one report."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.col(key1).alias("a"), F.col(key2).alias("b"))))
    a_type, b_type = candidates.schema[key1].dataType.simpleString(), candidates.schema[key2].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{a_type}>").alias("a"), F.array().cast(f"array<{b_type}>").alias("b"), F.array().cast("array<int>").alias("ranks"))

    def take(s: Column, x: Column) -> Column:
        new = ~F.array_contains(s["a"], x["a"]) & ~F.array_contains(s["b"], x["b"]) & (F.size(s["ranks"]) < most)
        return F.when(F.coalesce(new, F.lit(True)), F.struct(F.concat(s["a"], F.array(x["a"])).alias("a"), F.concat(s["b"], F.array(x["b"])).alias("b"), F.concat(s["ranks"], F.array(x["rank"])).alias("ranks"))).otherwise(s)

    taken = candidates.groupBy(by).agg(F.aggregate(items, start, take)["ranks"].alias("r")).select(by, F.explode("r").alias("rank"))
    return candidates.join(taken, [by, "rank"], "left_semi")


def incoherent_totals(totals: DataFrame) -> DataFrame:
    """Totals of one year that come with more than one reference value: (name, total, references) from rows
    (name, total, ref, source)."""
    per = totals.groupBy("name", "total", "ref").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("name", "total").agg(F.count(F.lit(1)).alias("n_refs"), F.array_sort(F.collect_list("ref")).alias("refs")).where("n_refs > 1")
