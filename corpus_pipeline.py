"""From raw documents to shards: quality rules, near duplicates, decontamination, mixing, sharding.

Every stage reads all that the one before it kept, from Parquet. The first four return the columns of ``documents``;
the last returns a manifest: doc_id, source, lang, n_chars, size, text_crc32, shard, slot. The mixture's order is that of
the files and rows of its Parquet, which the last stage reads back.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns of any
name; extra columns come back from all stages but the last. What a stage does with them is in its docstring.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm import decontam, mixing, neardup, quality, sharding
from chiffra.llm._common import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep. Null, empty and short texts (fewer than ten words) go,
    with any doc_id, null too; repeated rows are judged alike and all stay or all go. Counts are of whole texts, however long.
    Columns come back whatever their names; an empty table gives an empty one, and without labels only the base rule acts."""
    return quality.good_rows(docs, documents(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, once even where its row is repeated. Of rows
    that share that doc_id the one of the smallest hash stays. Wordless texts and rows without a doc_id have no group and stay.
    Texts are compared whole, however long; columns come back whatever their names; an empty table gives an empty one."""
    return neardup.kept_rows(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised. Null and empty texts hold none; an empty benchmark
    leaves all; repeated rows fare alike. Texts are searched whole, however long; of items that tie any one is enough for a
    document to go. Columns come back whatever their names; an empty table gives an empty one."""
    return decontam.clean_rows(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, source blocks interleaved to target weights. A null source is a source; rows
    that are repeated have a place each; sources due at once go by name. Texts, null, empty or very long, are only carried along,
    as are columns of any names; an empty table gives an empty one."""
    return mixing.in_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document; the slots of a shard follow the order in which the mixture was written. Equal texts
    share a shard, and each null text is a group of its own size, 1. Reads ``docs`` from Parquet files. A very long text is a
    group of its size; of groups and shards that weigh the same, digest and lowest shard decide. Other columns may have any
    names, they don't come back; an empty table gives an empty manifest."""
    out = sharding.shard_documents(docs, written=True)
    return out.select(*[F.col("row")[c].alias(c) for c in ("doc_id", "source", "lang", "n_chars")], "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("sharding", shard)]

#: No SQL: signatures, schedules and heaps have none. tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
