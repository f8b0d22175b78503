"""Driver tables read as the domain's tables; registration of a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text) of every document."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def authorised(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of documents that are not internal (labelled toxic stands for internal)."""
    internal = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return passages(spark, sf).select("id").join(internal, "id", "left_anti")


def r6(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)
