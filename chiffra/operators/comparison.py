"""Comparison of encoders that can be resumed: each ranking is a cell under a signature of what it is made from.

A cell is a table. It is written under a name of its own and counts once the manifest has its row, so a run that is broken off leaves
nothing that a later one could take for a result, and a later run makes the missing cells only. A signature covers the
encoder's name and settings and the content of both tables: one of them changes, and the cell is another.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.operators import evaluation as E
from chiffra.operators import retrieval as R


def content(rows: DataFrame) -> str:
    """A digest of the rows of a table, whatever their order."""
    one = rows.select(F.xxhash64(*rows.columns).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").cast("string").alias("s")).first()
    return f"{one['n']}:{one['s']}"


def signature(**parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


@dataclass
class Cells:
    """The finished tables of a folder; ``made`` lists those that this run had to make."""

    spark: SparkSession
    path: str
    made: list[str] = field(default_factory=list)

    def finished(self) -> dict[str, str]:
        try:
            rows = self.spark.read.schema("signature string, folder string").parquet(f"{self.path}/manifest").collect()  # a row a cell
        except AnalysisException:
            return {}
        return {r["signature"]: r["folder"] for r in sorted(rows)}

    def cell(self, sign: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a signature, made and committed if it isn't there."""
        folder = self.finished().get(sign)
        if folder is None:
            folder = f"{self.path}/cells/{sign}-{uuid.uuid4().hex}"
            make().write.parquet(folder)
            self.spark.createDataFrame([(sign, folder)], "signature string, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
            self.made.append(sign)
        return self.spark.read.parquet(folder)


def rankings(cells: Cells, encoders: Mapping[str, tuple[dict, Callable[[DataFrame], DataFrame]]], docs: DataFrame, queries: DataFrame, lexical: DataFrame | None = None, k: int = 50, rrf_k: int = 60) -> DataFrame:
    """(config, qid, id, rank) of each encoder alone and, beside a ``lexical`` ranking (qid, id, rank), fused with it. An encoder is its
    settings and a function from (id, ...) to (id, v), which ``docs`` and ``queries`` go through alike."""
    held = {"docs": content(docs), "queries": content(queries)}
    out = None
    for name, (settings, encode) in encoders.items():

        def make(encode=encode) -> DataFrame:
            asked = encode(queries).select(F.col("id").alias("qid"), "v")
            return R.dense_top_k(encode(docs), asked, k).select("qid", "id", "rank")

        dense = cells.cell(signature(encoder=name, settings=settings, k=k, **held), make)
        both = [(name, dense)] + ([] if lexical is None else [(f"hybrid {name}", R.rrf([lexical, dense], rrf_k, k).select("qid", "id", "rank"))])
        for config, hits in both:
            one = hits.select(F.lit(config).alias("config"), "qid", "id", "rank")
            out = one if out is None else out.unionByName(one)
    return out


def compared(judged: DataFrame, reference: str, at: int = 5) -> DataFrame:
    """(config, n, precision, mrr, win, loss, tie, w, p) of hits (config, qid, rank, rel): means over questions, and each
    configuration's precision against that of ``reference`` by the signed-rank test; null for the reference itself."""
    per = judged.groupBy("config", "qid").agg(F.avg(F.when(F.col("rank") <= at, F.col("rel").cast("double"))).alias("x"), F.coalesce(F.max(F.when(F.col("rel"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    means = per.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("precision"), F.avg("rr").alias("mrr"))
    base = per.where(F.col("config") == reference).select("qid", F.col("x").alias("b"))
    pairs = per.where(F.col("config") != reference).select("config", "qid", F.col("x").alias("a")).join(base, "qid")
    return means.join(E.wilcoxon(pairs, ["config"]).drop("z"), "config", "left")
