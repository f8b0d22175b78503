"""The offline encoder: TF-IDF over word and character n-grams, reduced by a truncated singular value decomposition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chiffra.functions import text as T
from chiffra.operators.evaluation import ngrams


def word_grams(c: Column) -> Column:
    """Word 1- and 2-grams."""
    words = T.tokens(c)
    return F.concat(words, ngrams(words, 2))


def char_grams(c: Column) -> Column:
    """3- to 5-grams of the characters of each blank-framed word."""
    grams = lambda w, n: F.when(F.length(w) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substr(w, i, F.lit(n))))
    framed = F.transform(T.tokens(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(framed, lambda w: F.concat(*[grams(w, n) for n in (3, 4, 5)])))


#: Families of features: name, grams, most features, fewest documents.
FAMILIES = (("word", word_grams, 60_000, 1), ("char", char_grams, 80_000, 2))


def counted(docs: DataFrame) -> DataFrame:
    """(id, family, gram, n) of documents (id, text)."""
    parts = [docs.select("id", F.lit(name).alias("family"), F.explode(grams(F.col("text"))).alias("gram")) for name, grams, _, _ in FAMILIES]
    return parts[0].unionByName(parts[1]).groupBy("id", "family", "gram").agg(F.count(F.lit(1)).alias("n"))


class Encoder:
    """``fit`` learns vocabularies, idf and axes from all rows of (id, text); ``encode`` gives unit vectors. Each family has a
    vocabulary of its own: its most frequent features, ties by name. Their number is bounded by ``FAMILIES``, so the
    vocabulary and the axes (a row of ``dims`` numbers for each feature) may be broadcast."""

    def __init__(self, dims: int = 256):
        self.dims = dims

    def _weighted(self, docs: DataFrame) -> DataFrame:
        """(id, at, x): sublinear tf times idf, each family normalised to length 1 and both together again."""
        w = counted(docs).join(F.broadcast(self.vocabulary), ["family", "gram"]).select("id", "family", "at", ((1 + F.log("n")) * F.col("idf")).alias("x"))
        norm = w.groupBy("id", "family").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        return w.join(norm, ["id", "family"]).select("id", "at", (F.col("x") / F.col("norm")).alias("x"))

    def fit(self, docs: DataFrame) -> "Encoder":
        spark = docs.sparkSession
        n = docs.count()
        df = counted(docs).groupBy("family", "gram").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("times")).cache()
        kept = None
        for name, _, most, least in FAMILIES:
            one = df.where((F.col("family") == name) & (F.col("df") >= least)).orderBy(F.col("times").desc(), "gram").limit(most)
            kept = one if kept is None else kept.unionByName(one)
        rows = sorted((r["family"], r["gram"], r["df"]) for r in kept.collect())  # bounded by FAMILIES
        df.unpersist()
        self.vocabulary = spark.createDataFrame([(f, g, k, float(np.log((1 + n) / (1 + d)) + 1)) for k, (f, g, d) in enumerate(rows)], "family string, gram string, at int, idf double")
        self.size = len(rows)
        vectors = self._weighted(docs).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select(F.col("v.at").alias("at"), F.col("v.x").alias("x"))
        matrix = vectors.rdd.map(lambda r: OldVectors.sparse(len(rows), r["at"], r["x"]))  # the decomposition takes an RDD of vectors
        matrix.cache()
        k = max(1, min(self.dims, n - 1, len(rows) - 1))
        self.axes = np.array(RowMatrix(matrix, n, len(rows)).computeSVD(k).V.toArray())
        matrix.unpersist()
        return self

    def encode(self, docs: DataFrame) -> DataFrame:
        """(id, v): unit vectors; a text without known features has a zero vector."""
        features = docs.select("id").distinct().join(self._weighted(docs).groupBy("id").agg(F.collect_list("at").alias("at"), F.collect_list("x").alias("x")), "id", "left")
        sent = docs.sparkSession.sparkContext.broadcast(self.axes)

        def project(batches):
            axes = sent.value
            for batch in batches:
                at, x = (batch.column(c) for c in (1, 2))
                size = np.nan_to_num(at.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                row, out = np.repeat(np.arange(len(size)), size), np.zeros((len(size), axes.shape[1]))
                np.add.at(out, row, axes[at.flatten().to_numpy(zero_copy_only=False)] * x.flatten().to_numpy(zero_copy_only=False)[:, None])
                norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
                out = np.divide(out, norm, out=out, where=norm > 0)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * axes.shape[1], pa.int32()), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), v], ["id", "v"])

        kind = docs.schema["id"].dataType.simpleString()
        return features.select("id", "at", "x").mapInArrow(project, f"id {kind}, v array<double>")


def chosen(preferred: list[str], factories: dict) -> tuple[str, object]:
    """(name, encoder) of the first preferred encoder that can be made here, else the offline one. A factory raises
    ImportError or OSError where its library or its files are missing."""
    for name in preferred:
        try:
            return name, factories[name]()
        except (KeyError, ImportError, OSError):
            continue
    return "tfidf", Encoder()
