"""Lines of pages by their place: running headers, page numbers, zones, numberings, captions and prose of charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chiffra.functions import text as T
from chiffra.operators.ingestion import masked_line

#: Fixed value: a line that is a page's number.
PAGE_NUMBER = r"(?i)^(\d{1,5}|[ivxlc]{1,5})$"


def in_margin(y: Column, height: Column, share: float = 0.12) -> Column:
    """Whether a line lies in the top or bottom margin of its page."""
    return (y < share * height) | (y > (1 - share) * height)


def running_lines(lines: DataFrame, least: int = 3, share: float = 0.3, margin: float = 0.12) -> DataFrame:
    """(doc_id, norm, n_pages): short margin lines, digits masked, that stand on at least ``least`` pages of their document and
    on ``share`` of them. ``lines`` are (doc_id, page, y, height, line)."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    norm = lines.where(in_margin(F.col("y"), F.col("height"), margin)).select("doc_id", "page", masked_line(F.col("line")).alias("norm")).where("norm is not null")
    seen = norm.groupBy("doc_id", "norm").agg(F.count_distinct("page").alias("n_pages")).join(pages, "doc_id")
    return seen.where(F.col("n_pages") >= F.greatest(F.lit(least), F.floor(share * F.col("pages")))).select("doc_id", "norm", "n_pages")


def without_running_lines(lines: DataFrame, running: DataFrame, margin: float = 0.12) -> DataFrame:
    """Lines that are neither running headers and footers nor page numbers; both are dropped in the margins only."""
    m = lines.withColumn("norm", F.when(in_margin(F.col("y"), F.col("height"), margin), masked_line(F.col("line"))))
    kept = m.join(running.select("doc_id", "norm"), ["doc_id", "norm"], "left_anti")
    return kept.where(~(in_margin(F.col("y"), F.col("height"), margin) & is_page_number(F.col("line")))).select(*lines.columns)


def is_page_number(line: Column) -> Column:
    return F.trim(line).rlike(PAGE_NUMBER)


def outside_zones(lines: DataFrame, zones: DataFrame, slack: float = 2.0) -> DataFrame:
    """Lines (doc_id, page, x0, x1, y0, y1, …) whose centre lies in no zone (doc_id, page, zx0, zy0, zx1, zy1). Pages meet by
    equality, so a line meets the few zones of its page."""
    x, y = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    inside = x.between(F.col("z.zx0") - slack, F.col("z.zx1") + slack) & y.between(F.col("z.zy0") - slack, F.col("z.zy1") + slack)
    return lines.alias("l").join(zones.alias("z"), (F.col("l.doc_id") == F.col("z.doc_id")) & (F.col("l.page") == F.col("z.page")) & inside, "left_anti")


def merged_numberings(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A line that is nothing but a numbering (``2.1``) joins the line after it: lines between two ends of such runs are one."""
    w = Window.partitionBy(*keys).orderBy(order)
    alone = F.trim("line").rlike(r"^\d+(\.\d+)*[.)]?$")
    m = lines.withColumn("__a", alone).withColumn("__new", F.when(F.lag("__a", 1, False).over(w), 0).otherwise(1)).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim("line").alias("t")))), lambda s: s["t"]), " ")
    return m.groupBy(*keys, "__g").agg(F.min(order).alias(order), text.alias("line")).drop("__g")


def attached_intros(lines: DataFrame, keys: list[str], order: str, is_chart: Column) -> DataFrame:
    """(…, chart): prose right before a chart's caption belongs to that chart, other prose to the last caption above it."""
    w = Window.partitionBy(*keys).orderBy(order)
    caption = F.when(is_chart, F.col(order))
    above = F.last(caption, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("chart", F.when(~is_chart & F.coalesce(F.lead(is_chart).over(w), F.lit(False)), F.lead(caption).over(w)).otherwise(above))


def continued_captions(tables: DataFrame, top: float = 0.3) -> DataFrame:
    """A table (doc_id, page, y, height, title) without a title that opens a page (in its first ``top``) goes on with the title
    of the last titled table, if that stands on the page before."""
    w = Window.partitionBy("doc_id").orderBy("page", "y").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("title").isNotNull(), F.struct("title", "page")), ignorenulls=True).over(w)
    t = tables.withColumn("__l", last)
    goes_on = (F.col("y") <= top * F.col("height")) & (F.col("__l.page") == F.col("page") - 1)
    return t.withColumn("title", F.coalesce("title", F.when(goes_on, F.col("__l.title")))).drop("__l")


def prose_of_charts(lines: DataFrame, keys: list[str], order: str, most: int = 800) -> DataFrame:
    """(keys, part, n_lines, n_tokens, text): the prose of each chart as one passage, cut by running token counts only where it
    has more than ``most`` tokens."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    c = lines.withColumn("__t", T.token_count(F.col("line"))).withColumn("part", F.floor((F.sum("__t").over(w) - F.col("__t")) / most))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line").alias("t")))), lambda s: s["t"]), " ")
    return c.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("__t").alias("n_tokens"), text.alias("text"))
