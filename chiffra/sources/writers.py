"""Writers: semicolon CSV, JSON reports, Markdown, tables in place of write-back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BOM = "\ufeff"


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Semicolon CSV with a header and a byte-order mark, nulls empty; one file per partition, each opening with the mark."""
    first = df.columns[0]
    df.withColumnRenamed(first, BOM + first).write.mode(mode).option("sep", ";").option("header", True).option("nullValue", "").option("encoding", "UTF-8").csv(path)


def html(sections: DataFrame) -> DataFrame:
    """(note_id, html) from (note_id, position, title, text): headings and paragraphs in order, marks escaped."""
    def safe(c):
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(mark), F.lit(name))
        return c

    part = F.concat(F.lit("<h2>"), safe(F.col("title")), F.lit("</h2><p>"), safe(F.col("text")), F.lit("</p>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", part.alias("p")))), lambda s: s["p"]), "")
    return sections.groupBy("note_id").agg(F.concat(F.lit('<!doctype html><meta charset="utf-8">'), body).alias("html"))


def union_of_columns(*dfs: DataFrame) -> DataFrame:
    """Rows of all, with the columns of any."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def rebuild(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def thresholds(old: DataFrame, encoder: str, signal: str, value: DataFrame) -> DataFrame:
    """The thresholds table (encoder, signal, threshold) with one entry set; ``value`` has a column threshold."""
    new = value.select(F.lit(encoder).alias("encoder"), F.lit(signal).alias("signal"), "threshold")
    return old.join(new.select("encoder", "signal"), ["encoder", "signal"], "left_anti").unionByName(new)


def markdown(sections: DataFrame) -> DataFrame:
    """(note_id, markdown) from (note_id, position, title, text): headings and paragraphs in order."""
    part = F.concat(F.lit("## "), "title", F.lit("\n\n"), "text")
    return sections.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", part.alias("p")))), lambda s: s["p"]), "\n\n").alias("markdown"))


def highlighted(c, words: list[str], mark: str = "**"):
    """The words of a query marked in a text, whatever their case."""
    import re

    if not words:
        return c
    pattern = "(?iU)\\b(" + "|".join(re.escape(w) for w in words) + ")\\b"
    return F.regexp_replace(c, pattern, f"{mark}$1{mark}")
