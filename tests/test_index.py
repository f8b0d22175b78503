"""Searches that skip blocks and cells, against those that read all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chiffra.operators import retrieval as R
from chiffra.sources import index as IX


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = [f"mot{i}a" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.randint(1, 60)))) for i in range(900)]
    return spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, rows[5][1]), (1003, rows[5][1])], "id long, text string")


def test_best_passages_from_few_blocks(spark, texts, tmp_path):
    ix = IX.save_bm25(texts, str(tmp_path / "ix"), 40)
    asked = spark.createDataFrame([(1, "mot250a mot7a"), (2, "mot1a mot2a mot3a"), (3, "mot299a"), (4, "inconnu"), (5, "mot120a mot121a mot122a mot0a")], "item_id long, text string")
    t = R.question_terms(asked)
    every = R.bm25(ix, t)
    for k, allowed in ((3, None), (10, texts.where("id % 3 <> 0").select("id")), (2000, None)):
        want = R.top_k(every if allowed is None else every.join(allowed, "id"), k, "qid", "id")
        got = R.bm25_top_k(ix, t, k, allowed, first=2)
        assert sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in got.collect()) == sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in want.collect())
    bounds, *_ = R.stripe_bounds(ix, t)
    of = every.withColumn("stripe", F.pmod(F.xxhash64("id"), F.lit(40))).groupBy("qid", "stripe").agg(F.max("score").alias("best"))
    assert bounds.join(of, ["qid", "stripe"]).where("best > bound + 1e-9").count() == 0
    third = R.top_k(every, 3, "qid", "id").where("rank = 3").select("qid", F.col("score").alias("floor"))
    n, open_ = bounds.count(), bounds.join(third, "qid").where("bound >= floor").count()
    assert open_ < 0.6 * n
    assert ix.postings.groupBy("id").agg(F.sum("tf").alias("n"), F.first("dl").alias("dl")).where("n <> dl").count() == 0


def test_a_search_reads_the_folders_of_its_terms(spark, texts, tmp_path):
    ix = IX.save_bm25(texts, str(tmp_path / "ix"))
    few = R.bm25(ix, R.question_terms(spark.createDataFrame([(1, "mot250a")], "item_id long, text string")))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_an_index_follows_its_files(spark, texts, tmp_path):
    path = str(tmp_path / "t")
    texts.write.parquet(path)
    one = IX.session_index(spark.read.parquet(path), "t")
    assert IX.session_index(spark.read.parquet(path), "t") is one
    texts.where("id < 10").write.mode("overwrite").parquet(path)
    spark.catalog.clearCache()
    assert IX.session_index(spark.read.parquet(path), "t").stats.first()["n"] == 10


@pytest.mark.parametrize("k", [1, 5, 5000])
def test_best_vectors_from_few_cells(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(R, "PIECE", 100)
    monkeypatch.setattr(R, "ASKED", 20)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 3
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)) * 0.2
    x[100:400] = x[100]  # ties, and a cell that is larger than the others
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(9000, None), (9001, [1.0])]
    ix = IX.save_cells(spark.createDataFrame(rows, "id long, v array<double>"), str(tmp_path / "c"), 12)
    queries = spark.createDataFrame([(q, (centres[q % 12] + 0.1 * q).tolist()) for q in range(50)] + [(99, [0.0] * 8), (98, [1.0])], "qid long, v array<double>")
    got = sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in R.cells_top_k(ix, queries, k).collect())
    s = np.round(np.array([r["v"] for r in queries.where("qid <> 98").orderBy("qid").collect()]) @ x.T, 9)
    want = []
    for q, row in zip([*range(50), 99], s, strict=True):
        for rank, i in enumerate(np.lexsort((np.arange(len(row)), -row))[:k]):
            want.append((q, rank + 1, int(i), row[i]))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    if k == 5:
        floor = spark.createDataFrame([(w[0], float(w[3])) for w in want if w[1] == 5], "qid long, floor double")
        bounds = R.cell_bounds(ix, queries)
        assert R.open_cells(bounds, floor).where("qid < 50").count() < bounds.where("qid < 50").count() / 2


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert R.cells_top_k(IX.save_cells(none, str(tmp_path / "c")), none.withColumnRenamed("id", "qid"), 3).count() == 0


def test_a_search_moves_no_posting_once_a_question(spark, texts, tmp_path, monkeypatch):
    """As many questions as one likes: blocks move once. Beyond what is sent out, the pruned search finds the same."""
    ix = IX.save_bm25(texts, str(tmp_path / "ix"), 40)
    asked = spark.createDataFrame([(q, "mot1a mot2a mot3a mot7a") for q in range(300)], "item_id long, text string")
    t = R.question_terms(asked)
    want = sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in R.top_k(R.bm25(ix, t), 4, "qid", "id").collect())
    got = R.bm25_top_k(ix, t, 4)
    assert sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in got.collect()) == want
    assert got._jdf.queryExecution().executedPlan().toString().count("front") == 0  # bounds of questions by stripes aren't formed
    monkeypatch.setattr(R, "MOST_SENT", 10)
    assert sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in R.bm25_top_k(ix, t, 4, first=2).collect()) == want
    assert R.bm25_top_k(ix, t.where("false"), 4).count() == 0


def test_an_index_knows_the_stripe_of_a_passage(spark, texts, tmp_path):
    ix = IX.save_bm25(texts, str(tmp_path / "ix"), 40)
    assert ix.stats.first()["stripes"] == 40
    of = ix.blocks.select("stripe", F.explode("ids").alias("id"))
    assert of.where(F.col("stripe") != IX.stripe_of(F.col("id"), F.lit(40))).count() == 0
