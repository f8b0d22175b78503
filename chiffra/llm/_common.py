"""Shared plumbing: tables in the cluster's shared folder, ranks and joins that no hot key can overload."""

import atexit
import math
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
#: Files of a table of known size: so many, and one more for every so many narrow rows.
FILES, ROWS_PER_FILE = 24, 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where none is named, a temporary one on a single machine; a
    cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="chiffra-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there. A table of at most ``rows`` narrow rows
    goes into as many files as these need, not into one for each shuffle partition."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chiffra-{name}-{uuid.uuid4().hex}"
    out = df if rows is None else df.coalesce(FILES + rows // ROWS_PER_FILE)
    out.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    for t in tables:
        path = t.__dict__.get("_stored_at")
        for x in [x for x in _written if x[1] == path]:
            delete(*x)
            _written.remove(x)


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone by now
            return


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def place_of(docs: DataFrame) -> Column | None:
    """File and row index of each row, which tell equal rows apart for good; None where ``docs`` isn't read from files."""
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    try:
        docs.select(place).schema  # noqa: B018 - resolves the columns
    except AnalysisException:
        return None
    return place


def buckets(n_rows: int, per_bucket: int = 100_000, least: int = 64) -> int:
    return max(least, math.ceil(n_rows / per_bucket))


def ranked(df: DataFrame, keys: list[str], order: list[Column], n_rows: int, name: str = "rank", part: Column | None = None) -> DataFrame:
    """Add a gapless rank from 0 within ``keys``. Rows are ranked in hash buckets, then shifted by what the buckets
    before hold, so that a key with a third of all rows is spread over many tasks. ``order`` decides the bucket and
    the order within it; buckets that ascend with ``order`` (``part``) make the rank follow it throughout."""
    n = buckets(n_rows)
    b, off = f"__{name}_bucket", f"__{name}_off"
    rows = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(n)).cast("int") if part is None else part)
    # Keys without nulls: on null-safe keys the join could not use the window's partitioning and would shuffle again.
    safe = []
    for i, k in enumerate(keys):
        rows = rows.withColumn(f"__{name}_k{i}", F.coalesce(F.col(k).cast("string"), F.lit(""))).withColumn(f"__{name}_n{i}", F.col(k).isNull())
        safe += [f"__{name}_k{i}", f"__{name}_n{i}"]
    counts = rows.groupBy(*safe, b).agg(F.count(F.lit(1)).alias(off))
    before = Window.partitionBy(*safe).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*safe, b, F.coalesce(F.sum(off).over(before), F.lit(0)).alias(off))
    within = Window.partitionBy(*safe, b).orderBy(*order)
    both = rows.withColumn(name, F.row_number().over(within) - 1).join(offsets, [*safe, b])
    return both.withColumn(name, F.col(name) + F.col(off)).select(*df.columns, name)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to the one row of their group. Groups with over a 2000th of all rows, so fewer than 2000, are
    broadcast; the others are shuffled, and none of those is large."""
    limit = max(200, total // 2000)
    hot = F.broadcast(groups.where(F.col(count) > limit).withColumn("__hot", F.lit(True)))
    cold = groups.where(F.col(count) <= limit)
    values = [c for c in groups.columns if c not in keys]
    marked = rows.join(hot, keys, "left")
    out = [*rows.columns, *values]
    return marked.where("__hot").select(*out).unionByName(marked.where("__hot is null").select(*rows.columns).join(cold, keys, how).select(*out))


#: Rows of one key that share a copy of its group in ``copied_join``.
PER_COPY = 500


def copied_join(rows: DataFrame, groups: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """Join rows to the one wide row of their group. A group of many of the ``total`` rows is copied, ``PER_COPY`` rows or a
    2000th of all rows to a copy, and its rows are dealt to the copies by the hash of ``spread``, so no task meets them
    all. What is broadcast is the number of copies of fewer than 2,000 keys."""
    each = max(PER_COPY, total // 2000)
    hot = F.broadcast(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > each).select(key, F.ceil(F.col("__n") / each).cast("int").alias("__copies")))
    dealt = rows.join(hot, key, "left").select(*rows.columns, F.coalesce(F.pmod(F.xxhash64(spread), "__copies"), F.lit(0)).cast("int").alias("__copy"))
    copies = groups.join(hot, key, "left").select(*groups.columns, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__copies") - 1, F.lit(0)))).alias("__copy"))
    return dealt.join(copies, [key, "__copy"]).drop("__copy")


#: Words of 64 bits in a bitmap of ids: 8 MB, whatever the input.
FILTER_WORDS = 1 << 20


def id_bits(ids: DataFrame, column: str, words: int = FILTER_WORDS) -> DataFrame:
    """(w, b): the set words of a bitmap of fixed size over the hashes of a column."""
    h = F.xxhash64(column)
    word = F.shiftright(h.bitwiseAND(64 * words - 1), 6).alias("w")
    return ids.select(word, F.expr(f"shiftleft(1L, cast(xxhash64(`{column}`) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))


def marked_ids(rows: DataFrame, ids: DataFrame, column: str, words: int = FILTER_WORDS) -> tuple[DataFrame, Column]:
    """``rows`` beside the word of the bitmap of ``ids`` that they fall on, and whether their bit is set."""
    bits = F.broadcast(id_bits(ids, column, words).select(F.col("w").alias("__w"), F.col("b").alias("__b")))
    word = F.shiftright(F.xxhash64(column).bitwiseAND(64 * words - 1), 6)
    return rows.join(bits, word == F.col("__w"), "left"), F.coalesce(F.expr(f"(__b & shiftleft(1L, cast(xxhash64(`{column}`) & 63 as int))) <> 0"), F.lit(False))


def with_ids(rows: DataFrame, ids: DataFrame, column: str, words: int = FILTER_WORDS) -> DataFrame:
    """``rows`` whose ``column`` may be in ``ids``: all that are, and few others as long as the bitmap isn't full."""
    marked, hit = marked_ids(rows, ids, column, words)
    return marked.where(hit).select(*[F.col(f"`{c}`") for c in rows.columns])


def without_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` isn't in ``ids``; nulls stay. A broadcast bitmap of fixed size lets most rows pass where
    they are; only those whose bit is set are shuffled for the exact anti-join."""
    marked, hit = marked_ids(rows, ids, column)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return marked.where(~hit).select(*columns).unionByName(marked.where(hit).select(*columns).join(ids.select(column), column, "left_anti"))
