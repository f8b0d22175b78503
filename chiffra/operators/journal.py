"""The production journal: append-only rows with JSON payloads; validation is an event, the latest wins."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOADS = ("entry", "output", "sources", "discarded", "abstentions")


def config_hash(config: dict) -> str:
    """Twelve hexadecimal digits of a configuration's sorted JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``, dictionaries merged at every depth."""
    return {**base, **{k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def encoded(rows: DataFrame, config: dict) -> DataFrame:
    """Structured payload columns as JSON text, stamped with the configuration."""
    out = rows
    for c in PAYLOADS:
        if c in rows.columns and dict(rows.dtypes)[c].startswith(("struct", "array", "map")):
            out = out.withColumn(c, F.to_json(c))
    return out.withColumn("config_hash", F.lit(config_hash(config))).withColumn("status", F.coalesce(F.col("status") if "status" in rows.columns else F.lit(None), F.lit("to read")))


def append(rows: DataFrame, path: str, config: dict, began: float | None = None) -> None:
    """Append rows to the journal. Rows without a ``prod_id`` get one that no other row has, all get the time of writing and,
    where it is known when their making ``began`` (seconds of the epoch), how long it took."""
    out = encoded(rows, config)
    if "prod_id" not in out.columns:
        out = out.withColumn("prod_id", F.xxhash64(F.uuid()))
    took = F.lit(None).cast("double") if began is None else F.round(F.unix_millis(F.current_timestamp()) / 1000 - F.lit(began), 3)
    out.withColumn("written_at", F.current_timestamp()).withColumn("duration_s", took).write.mode("append").parquet(path)


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def with_validation(productions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Productions with the status of their last decision (prod_id, status, at)."""
    last = latest(decisions, ["prod_id"], ["at"]).select("prod_id", F.col("status").alias("__status"))
    return productions.join(last, "prod_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def read_payload(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Tolerant JSON: a fenced or embedded object is found in the text; what can't be read is null."""
    inner = F.regexp_extract(F.col(column), r"(?s)(\{.*\}|\[.*\])", 1)
    return df.withColumn(column, F.from_json(F.nullif(inner, F.lit("")), schema))
