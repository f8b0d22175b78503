"""Charts paired with tables, codes carried over editions, readers' decisions consolidated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chiffra.functions import text as T
from chiffra.functions.numbers import let


def overlap_share(shown: Column, held: Column) -> Column:
    """Share of the shown values that a table holds, exactly or rounded to one or no decimals."""
    one, none = F.transform(held, lambda v: F.bround(v, 1)), F.transform(held, lambda v: F.bround(v, 0))
    hit = F.filter(shown, lambda v: F.array_contains(held, v) | F.array_contains(one, F.bround(v, 1)) | F.array_contains(none, F.bround(v, 1)))
    return F.when(F.size(shown) == 0, 0.0).otherwise(F.size(hit) / F.size(shown))


def propose(charts: DataFrame, tables: DataFrame, title_weight: float = 0.5, value_weight: float = 0.5, least: float = 0.35) -> DataFrame:
    """The best table of each chart and the runner-up. Charts (edition, chart, title, values) meet the tables (edition,
    table, title, values) of their edition only; ties go to the higher title score, value score and table number."""
    c = charts.select("edition", "chart", T.token_set(F.col("title")).alias("ct"), F.col("values").alias("cv"))
    t = tables.select("edition", "table", T.token_set(F.col("title")).alias("tt"), F.col("values").alias("tv"))
    s = c.join(t, "edition").withColumn("si", T.jaccard_of(F.col("ct"), F.col("tt"))).withColumn("sv", overlap_share(F.col("cv"), F.col("tv")))
    s = s.withColumn("score", F.round(title_weight * F.col("si") + value_weight * F.col("sv"), 9))
    w = Window.partitionBy("edition", "chart").orderBy(F.col("score").desc(), F.col("si").desc(), F.col("sv").desc(), F.col("table").desc())
    top = s.withColumn("n", F.row_number().over(w)).where("n <= 2")
    first = lambda c_, n: F.max(F.when(F.col("n") == n, F.col(c_)))
    out = top.groupBy("edition", "chart").agg(first("table", 1).alias("table"), first("score", 1).alias("score"), first("si", 1).alias("title_score"), first("sv", 1).alias("value_score"), first("table", 2).alias("table_2"), first("score", 2).alias("score_2"))
    return out.withColumn("status", F.when(F.col("score") >= least, "candidate").otherwise("to check"))


def consolidated(pairings: DataFrame, readings: DataFrame) -> DataFrame:
    """(chart, status, table): the first two distinct readers agree or not; fewer readers leave the pairing as it is.
    A reader's later decision replaces the earlier one."""
    r = readings.withColumn("who", F.lower(F.trim("reader")))
    last = r.groupBy("chart", "who").agg(F.max_by(F.struct("decision", "new_table"), "at").alias("d"), F.min("at").alias("since"))
    nth = Window.partitionBy("chart").orderBy("since", "who")
    two = last.withColumn("n", F.row_number().over(nth)).where("n <= 2").groupBy("chart").agg(F.max(F.when(F.col("n") == 1, F.col("d"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("d"))).alias("b"))
    p = pairings.join(two, "chart", "left")
    of = lambda x: F.when(F.col(f"{x}.decision") == "corrected", F.col(f"{x}.new_table")).otherwise(F.col("table"))
    agree = (F.col("a.decision") == F.col("b.decision")) & of("a").eqNullSafe(of("b"))
    status = F.when(F.col("b").isNull(), F.col("status")).when(agree & (F.col("a.decision") == "rejected"), "rejected").when(agree, "valid").otherwise("to check")
    table = F.when(F.col("b").isNotNull() & agree & (F.col("a.decision") == "corrected"), F.col("a.new_table")).otherwise(F.col("table"))
    return p.select("chart", status.alias("status"), table.alias("table"))


def propagated(rows: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Fill in a missing ``code`` from the first pairing (keys, code, rank) of the same table."""
    first = codes.groupBy(*keys).agg(F.min_by("code", F.struct("rank", "code")).alias("__code"))
    return rows.join(first, keys, "left").withColumn("code", F.coalesce("code", "__code")).drop("__code")


def attribute_codes(charts: DataFrame, least: float = 0.55) -> DataFrame:
    """(series, edition, chart, code): a stable code per chart (series, edition, chart, title and, where a person has set it,
    code). A chart takes over the code whose last title is most like its own (``least`` at least, ties to the later name),
    unless its edition has used that code already; else a new one from its words, numbered if taken.

    A series is one array in order of editions, charts with a set code first, and codes are a fold over it whose state is
    what each code stands for by then: as long as the codes of one series."""
    given = F.col("code") if "code" in charts.columns else F.lit(None).cast("string")
    item = F.struct("edition", given.isNull().alias("open"), "chart", given.alias("given"), T.slug(F.col("title")).alias("slug"), T.token_set(T.bare_title(F.col("title"))).alias("words"))
    rows = charts.groupBy("series").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    known_type, code_type = "array<struct<code:string,words:array<string>,edition:int>>", "array<string>"
    start = F.struct(F.array().cast(known_type).alias("known"), F.array().cast(code_type).alias("codes"))

    def give(state: Column, x: Column) -> Column:
        known = state["known"]
        free = F.filter(known, lambda k: (k["edition"] != x["edition"]) & F.arrays_overlap(k["words"], x["words"]))
        best = F.array_max(F.transform(free, lambda k: F.struct(T.jaccard_of(k["words"], x["words"]).alias("sim"), k["code"].alias("code"))))
        names = F.transform(F.sequence(F.lit(1), F.size(known) + 1), lambda n: F.when(n == 1, x["slug"]).otherwise(F.concat(x["slug"], F.lit("-"), n.cast("string"))))
        fresh = F.get(F.filter(names, lambda n: ~F.exists(known, lambda k: k["code"] == n)), F.lit(0))
        code = F.coalesce(x["given"], F.when(best["sim"] >= least, best["code"]), fresh)

        def put(c: Column) -> Column:
            now = F.struct(c.alias("code"), x["words"].alias("words"), x["edition"].cast("int").alias("edition"))
            return F.struct(F.concat(F.filter(known, lambda k: k["code"] != c), F.array(now)).cast(known_type).alias("known"), F.concat(state["codes"], F.array(c)).alias("codes"))

        return let(code, put)

    out = rows.select("series", F.explode(F.arrays_zip("rows", F.aggregate("rows", start, give)["codes"].alias("codes"))).alias("z"))
    return out.select("series", "z.rows.edition", "z.rows.chart", F.col("z.codes").alias("code"))


def worklist(pairings: DataFrame, readings: DataFrame, reader: str) -> DataFrame:
    """(group, chart, position): what a reader has left to read: pairings (group, chart, status) without a decision that the
    reader, whatever the case of the name, hasn't read yet (readings: chart, reader), in order; the first is next."""
    mine = readings.where(F.lower(F.trim("reader")) == reader.strip().lower()).select("chart").distinct()
    left = pairings.where(~F.col("status").isin("valid", "rejected")).join(mine, "chart", "left_anti")
    return left.select("group", "chart", F.row_number().over(Window.partitionBy("group").orderBy("chart")).alias("position"))
