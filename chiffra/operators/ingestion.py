"""Lines, windows and tables out of raw documents."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chiffra.functions import text as T


def masked_line(c: Column, longest: int = 90) -> Column:
    """A short line with its digits masked; null for blank and long lines."""
    t = F.trim(c)
    return F.when(F.length(t).between(1, longest), F.regexp_replace(t, "[0-9]+", "#"))


def recurring_lines(lines: DataFrame, by: str, least: int) -> DataFrame:
    """(norm, n_docs): masked lines that at least ``least`` different ``by`` hold."""
    n = lines.select(by, masked_line(F.col("line")).alias("norm")).where("norm is not null").distinct()
    return n.groupBy("norm").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least)


def html_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, line): visible text by block element; scripts, styles and tags are gone."""
    t = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)</(p|div|li|h[1-6]|tr|title)>|<br[^>]*>", "\n"), "<[^>]*>", "")
    return pages.select("page_id", F.posexplode(F.split(t, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("length(line) > 0")


def _packed_lines(n: list[int], least: int, most: int, overlap: float) -> list[tuple[int, int, int]]:
    """(first line, end line, tokens) of the windows over lines of ``n`` tokens each."""
    out, at = [], 0
    while at < len(n):
        end, total = at, 0
        while end < len(n) and (end == at or total + n[end] <= most):
            total += n[end]
            end += 1
        if out and end == len(n) and total < least:
            first, last, tokens = out[-1]
            if tokens + sum(n[last:end]) <= most:
                out[-1] = (first, end, tokens + sum(n[last:end]))
                break
        out.append((at, end, total))
        if end == len(n):
            break
        back, held = end, 0
        while back > at + 1 and held + n[back - 1] <= overlap * total:
            back -= 1
            held += n[back]
        at = back
    return out


def windows_of_counts(docs: DataFrame, by: str, least: int = 400, most: int = 800, overlap: float = 0.15) -> DataFrame:
    """(by, window_no, first_line, end_line, n_tokens) of documents (by, counts: the tokens of each line, in order).

    Lines are packed greedily into windows of at most ``most`` tokens. A window closes when the next line would overflow it;
    the next one starts again with the last lines that make up ``overlap`` of it. A tail shorter than ``least`` joins the
    window before if both fit. A line longer than ``most`` is a window of its own. The scan is sequential within a document;
    documents stay where they are, and batches of their counts pass through one kernel."""

    def pack(batches):
        for batch in batches:
            keys, rows = batch.column(0), [(k, i, w) for k, c in enumerate(batch.column(1).to_pylist()) for i, w in enumerate(_packed_lines(c or [], least, most, overlap))]
            take = keys.take(pa.array([r[0] for r in rows], pa.int64()))
            ints = [pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[2][k] for r in rows], pa.int32()) for k in (0, 1)), pa.array([r[2][2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([take, *ints], [by, "window_no", "first_line", "end_line", "n_tokens"])

    kind = docs.schema[by].dataType.simpleString()
    return docs.select(by, "counts").mapInArrow(pack, f"{by} {kind}, window_no int, first_line int, end_line int, n_tokens long")


def token_windows(lines: DataFrame, by: str, least: int = 400, most: int = 800, overlap: float = 0.15) -> DataFrame:
    """``windows_of_counts`` for lines (by, line_no, line); line numbers of the result are places in the order of line_no."""
    counts = lines.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", T.token_count(F.col("line")).cast("int").alias("n")))), lambda x: x["n"]).alias("counts"))
    return windows_of_counts(counts, by, least, most, overlap)


def gap_clusters(df: DataFrame, keys: list[str], x: str, tie: str, gap: float) -> DataFrame:
    """Number runs of neighbouring values; a step of more than ``gap`` opens a new one."""
    w = Window.partitionBy(*keys).orderBy(x, tie)
    b = F.when(F.col(x) - F.lag(x).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("__b", b).withColumn("cluster", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


#: The lines that caption a table or a chart.
CAPTION = r"(?i)^\s*(tableau|graphique)\s+(\d+)\s*[:.]\s*(.*)$"


def captions(lines: DataFrame) -> DataFrame:
    """(…, kind, number, title) of caption lines; a caption without a title takes the next line's text."""
    w = Window.partitionBy("doc_id").orderBy("page", "y")
    c = lines.withColumn("next", F.lead("line").over(w)).where(F.col("line").rlike(CAPTION))
    title = F.trim(F.regexp_extract("line", CAPTION, 3))
    return c.select("doc_id", "page", "y", F.lower(F.regexp_extract("line", CAPTION, 1)).alias("kind"), F.regexp_extract("line", CAPTION, 2).cast("int").alias("number"), F.when(title == "", F.trim(F.coalesce("next", F.lit("")))).otherwise(title).alias("title"))


def nearest_caption(tables: DataFrame, caps: DataFrame, slack: float = 5.0) -> DataFrame:
    """Each table (doc_id, page, y) with the nearest caption above it on its page: an as-of match by one window."""
    a = tables.select("doc_id", "page", (F.col("y") + slack).alias("y"), F.lit(1).alias("is_table"), F.struct("*").alias("t"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("title"))
    b = caps.where("kind = 'tableau'").select("doc_id", "page", "y", F.lit(0).alias("is_table"), F.lit(None).cast(a.schema["t"].dataType).alias("t"), "number", "title")
    w = Window.partitionBy("doc_id", "page").orderBy("y", "is_table").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("c", F.last(F.when(F.col("is_table") == 0, F.struct("number", "title")), ignorenulls=True).over(w))
    return both.where("is_table = 1").select("t.*", "c.number", "c.title")


def reading_order(lines: DataFrame, width: float) -> DataFrame:
    """Lines (doc_id, page, x0, x1, y0) of two-column pages in reading order: full-width lines cut bands, within a band the
    left column comes first."""
    full = (F.col("x1") - F.col("x0")) > 0.6 * width
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("band", 2 * F.sum(F.when(full, 1).otherwise(0)).over(w) - F.when(full, 1).otherwise(0)).withColumn("col", F.when(full, 0).when((F.col("x0") + F.col("x1")) / 2 < width / 2, 0).otherwise(1))
    order = Window.partitionBy("doc_id", "page").orderBy("band", "col", "y0", "x0")
    return marked.withColumn("position", F.row_number().over(order)).drop("band", "col")


def filled_grid(cells: DataFrame) -> DataFrame:
    """Cells (table_id, row, col, text) with merged headers spread: an empty header cell takes the one on its left."""
    w = Window.partitionBy("table_id", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("text", F.coalesce(F.last(F.nullif(F.trim("text"), F.lit("")), ignorenulls=True).over(w), F.lit("")))


def linear_cells(cells: DataFrame, header_rows: int = 1, label_cols: int = 1) -> DataFrame:
    """(table_id, label, column, year, text, sentence) of a grid's value cells, labels and headers joined by " / ".

    Headers and labels are aggregated per table, so each side is one small group; values meet them by equi-joins."""
    head = filled_grid(cells.where(F.col("row") < header_rows)).where(F.col("text") != "")
    head = head.groupBy("table_id", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda s: s["text"]), " / ").alias("column"))
    down = Window.partitionBy("table_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    label = cells.where((F.col("col") < label_cols) & (F.col("row") >= header_rows)).withColumn("text", F.last(F.nullif(F.trim("text"), F.lit("")), ignorenulls=True).over(down))
    label = label.where("text is not null").groupBy("table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda s: s["text"]), " / ").alias("label"))
    body = cells.where((F.col("row") >= header_rows) & (F.col("col") >= label_cols) & (F.trim("text") != ""))
    out = body.join(head, ["table_id", "col"]).join(label, ["table_id", "row"])
    year = F.nullif(F.regexp_extract("column", r"\b((19|20)\d{2})\b", 1), F.lit("")).cast("int")
    return out.select("table_id", "label", "column", year.alias("year"), F.trim("text").alias("text"), F.concat("label", F.lit(" | "), "column", F.lit(" = "), F.trim("text")).alias("sentence"))




def similar_titles(titles: DataFrame, least: float) -> DataFrame:
    """(a, b, sim) of titles (title, s: token set) by an inverted index: a pair shares one of the first tokens, in order of
    rarity, that any pair as similar as ``least`` must share (prefix filtering)."""
    words = titles.select("title", "s", F.explode("s").alias("w"))
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    nth = F.row_number().over(Window.partitionBy("title").orderBy("df", "w"))
    prefix = words.join(df, "w").withColumn("nth", nth).where(F.col("nth") <= F.size("s") - F.ceil(least * F.size("s") - 1e-9) + 1)
    a, b = prefix.select("w", F.col("title").alias("a"), F.col("s").alias("sa")), prefix.select("w", F.col("title").alias("b"), F.col("s").alias("sb"))
    return a.join(b, "w").where("a < b").drop("w").distinct().withColumn("sim", T.jaccard_of(F.col("sa"), F.col("sb"))).where(F.col("sim") >= least)
