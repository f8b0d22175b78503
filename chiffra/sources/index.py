"""Stored indexes: postings in blocks with bounds, and vectors in cells, as tables that are built once and read by searches."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.functions import text as T

#: Passages of a stripe on average, and folders over which terms are dealt.
STRIPE, BUCKETS = 128, 64


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: ``spark.checkpoint.dir``, or on a single machine a temporary folder. A cluster has
    to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="chiffra-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def stripe_of(id_: Column, stripes: Column) -> Column:
    return F.pmod(F.xxhash64(id_), stripes)


@dataclass
class Bm25Index:
    """``blocks`` (bucket, term, stripe, front, ids, tfs, dls): the postings of a term in a stripe of some ``STRIPE`` passages, and
    the pairs (tf, dl) of which one has the block's highest score, whatever the average length. ``terms`` (term, df) and
    ``stats`` (n, avgdl, mean_idf, stripes: one row). Blocks lie in one folder a bucket of terms, sorted by term, so a search reads
    the folders of its terms."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(id, dl, term, tf), one row per term and passage."""
        return postings_of(self.blocks)


def postings_of(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("term", F.inline(F.arrays_zip("ids", "tfs", "dls")))
    return rows.select(F.col("ids").alias("id"), F.col("dls").alias("dl"), "term", F.col("tfs").alias("tf"))


def front_of(tfs: Column, dls: Column) -> Column:
    """array<struct<tf, dl>>: the shortest passage of each term frequency. A score rises with tf and falls with dl, so one of them
    has the highest score of all."""
    both = F.arrays_zip(tfs.alias("tf"), dls.alias("dl"))
    shortest = lambda t: F.array_min(F.transform(F.filter(both, lambda p: p["tf"] == t), lambda p: p["dl"]))
    return F.transform(F.array_distinct(tfs), lambda t: F.struct(t.alias("tf"), shortest(t).alias("dl")))


def save_bm25(passages: DataFrame, path: str, stripes: int | None = None) -> Bm25Index:
    """Index passages (id, text) into the folder ``path``. Texts move once, to the task of their stripe; there words are counted,
    lengths found and blocks made, and only the blocks move on, to the folder of their term."""
    spark = passages.sparkSession
    stripes = stripes or max(1, passages.count() // STRIPE)
    # Words are singled out row by row, not by functions over arrays: whole-stage code does that several times faster.
    placed = passages.select(stripe_of(F.col("id"), F.lit(stripes)).alias("stripe"), "id", "text").repartition("stripe")
    words = placed.select("stripe", "id", F.explode(F.regexp_extract_all(T.normalised(F.col("text")), F.lit("[a-z0-9]+"), 0)).alias("w"))
    terms = words.where(~F.col("w").isin(T.STOP_WORDS)).select("stripe", "id", T.singular(F.col("w")).alias("term"))
    tf = terms.groupBy("stripe", "id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    rows = tf.groupBy("stripe", "id").agg(F.sum("tf").cast("long").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("p"))
    rows = rows.select("stripe", "id", "dl", F.inline("p"))
    blocks = rows.groupBy("stripe", "term").agg(F.array_sort(F.collect_list(F.struct("id", "tf", "dl"))).alias("p"))
    # A bucket is dealt to several files by stripe, so that a frequent word is no single task.
    files = max(1, stripes // 4096)
    part = lambda c: F.transform("p", lambda x: x[c])
    dealt = blocks.repartition(BUCKETS * min(files, 64), bucket_of(F.col("term")), F.pmod("stripe", F.lit(files)))
    dealt = dealt.select(bucket_of(F.col("term")).alias("bucket"), "term", "stripe", front_of(part("tf"), part("dl")).alias("front"), part("id").alias("ids"), part("tf").alias("tfs"), part("dl").alias("dls"))
    dealt.sortWithinPartitions("bucket", "term", "stripe").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    stored = _blocks(spark, path)
    counted = stored.select("term", F.size("ids").alias("df"), F.aggregate("tfs", F.lit(0.0), lambda s, x: s + x).alias("words"))
    counted.groupBy("term").agg(F.sum("df").cast("double").alias("df"), F.sum("words").alias("words")).write.mode("overwrite").parquet(f"{path}/terms")
    df = spark.read.parquet(f"{path}/terms")
    size = passages.agg(F.count(F.lit(1)).cast("double").alias("n")).crossJoin(df.agg(F.sum("words").alias("words")))  # one row each
    size = size.select("n", (F.coalesce("words", F.lit(0.0)) / F.nullif("n", F.lit(0.0))).alias("avgdl"))
    mean = df.crossJoin(F.broadcast(size)).agg(F.avg(F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean_idf"))
    size.crossJoin(mean).withColumn("stripes", F.lit(stripes)).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return load_bm25(spark, path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    kinds = "term string, stripe long, front array<struct<tf: double, dl: long>>, ids array<long>, tfs array<double>, dls array<long>, bucket int"
    return spark.read.schema(kinds).parquet(f"{path}/blocks")


def load_bm25(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(_blocks(spark, path), spark.read.parquet(f"{path}/terms").select("term", "df"), spark.read.parquet(f"{path}/stats"))


def save_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Store unit vectors (id, v) of rows whose vector isn't zero."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.withColumn("n", norm).where("n > 0").select("id", F.transform("v", lambda x: x.cast("double") / F.col("n")).alias("v"))
    unit.write.mode("overwrite").parquet(path)
    return load_vectors(vectors.sparkSession, path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Vectors from which centroids are fitted, at most, and the most cells.
SAMPLE, MOST_CELLS = 20_000, 4096


@dataclass
class CellIndex:
    """``vectors`` (id, v, cell), and ``cells`` (cell, centre, radius, n): every vector of a cell lies within ``radius`` of its centre."""

    vectors: DataFrame
    cells: DataFrame


def save_cells(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
    """Deal vectors (id, v) to the nearest of some sqrt(n) centres, which are fitted on the ``sample`` rows of smallest hash; every
    vector is indexed, and radii are those of all of them. Null vectors, and those of another length than the first of
    the sample, are left out."""
    spark = vectors.sparkSession
    rows = vectors.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    # Of evenly spread hashes the lowest share holds the sample, so that no partition sends a sample of its own to the driver.
    n, h = rows.count(), F.xxhash64("id")
    low = rows.where(h <= -(1 << 63) + (1 << 63) // max(n, 1) * min(4 * sample, n))
    drawn = (low if low.count() >= min(sample, n) else rows).orderBy(h, "id").limit(sample).collect()
    dim = len(drawn[0]["v"]) if drawn else 0
    whole = [r["v"] for r in drawn if len(r["v"]) == dim]
    x = np.array(whole, np.float64).reshape(len(whole), dim)
    c = x[: min(len(x), cells or min(MOST_CELLS, max(1, round(n ** 0.5))))].copy()
    nearest = lambda x, c: ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
    for _ in range(8 if len(x) else 0):
        of = nearest(x, c)
        for j in np.unique(of):
            c[j] = x[of == j].mean(axis=0)

    def place(batches):
        for b in batches:
            y = np.asarray(b.column(1).flatten()).reshape(b.num_rows, dim)
            of = nearest(y, c) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(of.astype(np.int32)), pa.array(np.sqrt(((y - c[of]) ** 2).sum(axis=1)) if dim else np.zeros(b.num_rows))], ["id", "v", "cell", "far"])

    placed = rows.where(F.size("v") == dim).mapInArrow(place, "id long, v array<double>, cell int, far double")
    placed.write.mode("overwrite").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    centres = spark.createDataFrame([(j, v) for j, v in enumerate(c.tolist())], "cell int, centre array<double>")
    stored.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).join(centres, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return load_cells(spark, path)


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    return CellIndex(spark.read.parquet(f"{path}/vectors").select("id", "v", "cell"), spark.read.parquet(f"{path}/cells"))


def files_of(rows: DataFrame) -> str:
    """A digest of the files that ``rows`` reads: names, lengths and times; empty where it reads none."""
    try:
        files = rows.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h"))
    except AnalysisException:
        return ""
    one = files.distinct().agg(F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum"), F.count(F.lit(1)).alias("n")).first()
    return f"{one['n']}:{one['sum']}"


_built: dict[tuple, object] = {}


def session_index(passages: DataFrame, name: str, build=None, kind: str = "bm25"):
    """The index of ``name`` (a stable name of what ``passages`` holds), built at its first use in a Spark application, and anew
    when the files that it was made from have changed."""
    spark = passages.sparkSession
    key = (spark.sparkContext.applicationId, kind, name)
    files = files_of(passages)
    if key not in _built or _built[key][0] != files:
        _built[key] = files, (build or save_bm25)(passages, f"{shared_folder(spark)}/chiffra-{kind}-{uuid.uuid4().hex}")
    return _built[key][1]


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, for what several branches of a plan read."""
    path = f"{shared_folder(df.sparkSession)}/chiffra-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
