"""A comparison that is taken up again makes only what is missing."""

import pytest
from pyspark.sql import functions as F

from chiffra.operators import comparison as C


def test_second_run_encodes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "id long, v array<double>")
    queries = docs.where("id < 8")
    calls = []

    def encoder(name, n):
        def encode(rows):
            calls.append(name)
            return rows.select("id", F.slice("v", 1, n).alias("v"))

        return {"dims": n}, encode

    both = {"two": encoder("two", 2), "three": encoder("three", 3)}
    first = C.Cells(spark, str(tmp_path))
    one = sorted(map(tuple, C.rankings(first, both, docs, queries, k=5).collect()))
    assert len(first.made) == 2 and calls == ["two", "two", "three", "three"] and len(one) == 2 * 8 * 5
    again = C.Cells(spark, str(tmp_path))
    lexical = spark.createDataFrame([(0, 59, 1)], "qid long, id long, rank int")
    two = sorted(map(tuple, C.rankings(again, both, docs, queries, lexical, k=5).where("config not like 'hybrid%'").collect()))
    assert again.made == [] and len(calls) == 4 and two == one
    more = {**both, "one": encoder("one", 1)}
    C.rankings(again, more, docs, queries, k=5)
    assert len(again.made) == 1 and calls[4:] == ["one", "one"]
    C.rankings(again, both, docs.where("id < 59"), queries, k=5)
    assert len(again.made) == 3


def test_broken_run_commits_nothing(spark, tmp_path):
    cells = C.Cells(spark, str(tmp_path))
    fails = F.udf(lambda x: 1 // 0, "long")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        cells.cell("s", lambda: spark.range(3).select(fails("id").alias("x")))
    assert cells.finished() == {} and cells.cell("s", lambda: spark.range(3)).count() == 3
