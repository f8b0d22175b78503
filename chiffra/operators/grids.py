"""HTML tables with merged cells: every cell at its place in the grid, and values under the forest of the labels above and beside.

A header that spans columns is an interval of them, and the headers that hold a column are nested by their rows; a label
that spans rows likewise. A row with a label alone, and no values, heads the rows under it. Where a span is missing, an
empty header cell belongs to the one on its left and an empty label to the one above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chiffra.functions.numbers import let
from chiffra.operators.tables import is_number, is_value

#: The most header rows of a table, and the share of words among a label column's cells.
MOST_HEADERS, WORDS = 4, 0.6

_CELL = "struct<row:int,col:int,rows:int,cols:int,text:string>"


def placed_cells(html: Column) -> Column:
    """array<struct<row, col, rows, cols, text>> of a table's HTML: a cell takes the first column of its row that no cell from
    above reaches into. A span of 0 or without a number is 1; a cell that isn't closed ends with the next one or its row."""
    marks = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>|<t[dh]\b[^>]*>.*?(?=</?t[dhr]\b|</table|\z)"), 0)
    span = lambda tag, name: F.greatest(F.lit(1), F.coalesce(F.nullif(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']?(\d{{1,3}})", 1), F.lit("")).cast("int"), F.lit(1)))
    plain = lambda tag: F.trim(F.regexp_replace(F.replace(F.replace(F.replace(F.replace(F.regexp_replace(F.regexp_replace(tag, r"(?is)^<t[dh]\b[^>]*>", ""), r"<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" ")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")), r"(?U)\s+", " "))
    start = F.struct(F.lit(-1).alias("row"), F.array().cast("array<int>").alias("free"), F.array().cast(f"array<{_CELL}>").alias("cells"), F.lit(0).alias("from"))

    def put(s: Column, tag: Column) -> Column:
        """``free`` holds for each column the first row that no cell reaches into; ``from`` the next column of this row."""
        opened = F.struct((s["row"] + 1).alias("row"), s["free"].alias("free"), s["cells"].alias("cells"), F.lit(0).alias("from"))
        row = F.greatest(s["row"], F.lit(0))
        open_ = F.filter(F.transform(s["free"], lambda f, i: F.when((f <= row) & (i >= s["from"]), i)), lambda i: i.isNotNull())
        col = F.coalesce(F.try_element_at(open_, F.lit(1)), F.greatest(F.size(s["free"]), s["from"]))

        def taken(c: Column) -> Column:
            cell = F.struct(row.alias("row"), c["col"].alias("col"), c["rows"].alias("rows"), c["cols"].alias("cols"), plain(tag).alias("text"))
            reach = lambda i: F.when((i >= c["col"]) & (i < c["col"] + c["cols"]), row + c["rows"]).otherwise(F.coalesce(F.get(s["free"], i), F.lit(0)))
            free = F.transform(F.sequence(F.lit(0), F.greatest(F.size(s["free"]), c["col"] + c["cols"]) - 1), reach)
            return F.struct(row.alias("row"), free.alias("free"), F.concat(s["cells"], F.array(cell)).alias("cells"), (c["col"] + c["cols"]).alias("from"))

        here = F.struct(col.alias("col"), span(tag, "rowspan").alias("rows"), span(tag, "colspan").alias("cols"))
        return F.when(tag.rlike("(?i)^<tr"), opened).otherwise(let(here, taken))

    return F.aggregate(marks, start, put)["cells"]


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_no, row, col, rows, cols, text) of the cells of every table that holds no other table."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(?:(?!<table\b).)*?</table>"), 0)
    t = pages.select(key, F.posexplode(tables).alias("table_no", "html"))
    return t.select(key, "table_no", F.inline(placed_cells(F.col("html"))))


def values(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, column, year, text) of a table's values: the labels beside and above each, outermost first.

    Headers are the rows before the first with a value, or with a single label that heads rows; label columns those on the left that hold mostly words. Cells meet
    their labels by the columns and rows these span, so joins are equalities within a table."""
    t = Window.partitionBy(*keys)
    c = cells.withColumn("is_value", is_value(F.col("text")))
    row = Window.partitionBy(*keys, "row")
    c = c.withColumn("title", (F.col("row") > 0) & (F.count(F.nullif("text", F.lit(""))).over(row) == 1) & (F.max(F.when(F.col("text") != "", F.col("col"))).over(row) == 0))
    c = c.withColumn("depth", F.least(F.lit(MOST_HEADERS), F.coalesce(F.min(F.when(F.col("is_value") | F.col("title"), F.col("row"))).over(t), F.lit(0))))
    body = c.where("row >= depth")
    # Leading columns of words.
    per = body.where("text <> ''").groupBy(*keys, "col").agg((F.avg((~is_number(F.col("text"))).cast("double")) >= WORDS).alias("words"))
    stop = per.where("not words").groupBy(*keys).agg(F.min("col").alias("n_labels"))
    c = c.join(stop.withColumn("n_labels", F.greatest("n_labels", F.lit(1))), keys)
    # Headers over their columns; an empty one without a span belongs to the one on its left.
    left = Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    heads = c.where("row < depth").select(*keys, "row", "text", "n_labels", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("cols") - 1)).alias("col"))
    heads = heads.where("col >= n_labels").withColumn("text", F.last(F.nullif("text", F.lit("")), ignorenulls=True).over(left)).where("text is not null")
    path = lambda by, name: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(by, "text"))), lambda s: s["text"])), name)
    columns = heads.groupBy(*keys, "col").agg(path("row", " · ").alias("column"))
    # Labels beside their rows; a row without values heads those under it up to the next such row.
    kinds = c.where("row >= depth").groupBy(*keys, "row").agg(F.max((F.col("is_value") & (F.col("col") >= F.col("n_labels"))).cast("int")).alias("has"))
    down = Window.partitionBy(*keys, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    labels = c.where("row >= depth and col < n_labels").select(*keys, "col", "text", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rows") - 1)).alias("row"))
    labels = labels.join(kinds, [*keys, "row"])
    over = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    alone = labels.where("has = 0 and text <> ''").groupBy(*keys, "row").agg(path("col", " / ").alias("group"))
    groups = kinds.join(alone, [*keys, "row"], "left").withColumn("group", F.last("group", ignorenulls=True).over(over)).where("has = 1").select(*keys, "row", "group")
    beside = labels.where("has = 1").withColumn("text", F.last(F.nullif("text", F.lit("")), ignorenulls=True).over(down)).where("text is not null")
    beside = beside.groupBy(*keys, "row").agg(path("col", " / ").alias("own"))
    found = c.where("is_value and col >= n_labels and row >= depth").select(*keys, "row", "col", "text")
    out = found.join(columns, [*keys, "col"], "left").join(beside, [*keys, "row"], "left").join(groups, [*keys, "row"], "left")
    label = F.coalesce(F.nullif(F.concat_ws(" / ", "group", "own"), F.lit("")), F.lit("(sans libellé)"))
    year = F.try_element_at(F.regexp_extract_all("column", F.lit(r"\b((?:19|20)\d{2})\b"), 1), F.lit(-1)).cast("int")
    return out.select(*keys, label.alias("label"), F.coalesce("column", F.concat(F.lit("colonne "), (F.col("col") + 1).cast("string"))).alias("column"), year.alias("year"), "text")


