import hashlib
import math

import duckdb
import numpy as np
import pytest

from chiffra.llm import yinyang


def plain(x, c, rounds):
    """Lloyd rounds in exact integers."""
    x = [list(map(int, v)) for v in x]
    c = [list(map(int, v)) for v in c]
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c] for v in x]
        of = [row.index(min(row)) for row in d]
        if r < rounds:
            for j in range(len(c)):
                mine = [v for v, o in zip(x, of, strict=True) if o == j]
                if mine:
                    c[j] = [math.floor(sum(col) / len(mine)) if abs(sum(col)) < 1 << 50 else sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return of, [row[o] for row, o in zip(d, of, strict=True)], c


@pytest.mark.parametrize("seed", range(6))
def test_bounds_leave_the_clusters_as_they_are(seed):
    """Small integers, so that ties abound; every round against all distances, and bounds that hold."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (3000, 6)) + rng.integers(0, 6, (3000, 1)) * 7 * (seed % 3)
    c = x[:16].astype(np.int64)
    group = yinyang.grouped(c)
    t = group.max() + 1
    now, up, low, drift = np.full(len(x), -1), np.zeros(len(x)), np.zeros((len(x), t)), np.zeros(16)
    saved = 0
    for _ in range(8):
        now, up, low, measured = yinyang.measure(x, c, group, now, up, low, drift)
        d = ((x[:, None, :] - c) ** 2).sum(axis=2)
        assert (now == d.argmin(axis=1)).all()
        root = np.sqrt(d)
        assert (up >= root[np.arange(len(x)), now] - 1e-6).all()
        root[np.arange(len(x)), now] = np.inf
        for g in range(t):
            assert (low[:, g] <= root[:, group == g].min(axis=1) + 1e-6).all()
        saved += (16 * len(x)) - measured.sum()
        new = np.array([x[now == j].sum(axis=0) // max(1, (now == j).sum()) if (now == j).any() else c[j] for j in range(16)])
        drift, c = np.sqrt(((new - c) ** 2).sum(axis=1)), new
    assert saved > 0


def test_most_distances_are_left_out_where_clusters_are_apart():
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (5000, 8)) + 50 * rng.integers(0, 16, (5000, 1))
    c = np.array([[50 * j] * 8 for j in range(16)])
    group = yinyang.grouped(c)
    now, up, low, _ = yinyang.measure(x, c, group, np.full(len(x), -1), np.zeros(len(x)), np.zeros((len(x), group.max() + 1)), np.zeros(16))
    assert yinyang.measure(x, c + 1, group, now, up, low, np.full(16, math.sqrt(8)))[3].sum() == 0


ROWS = [(i, [((i * 37 + k * k) % 23 - 11) / 64 for k in range(8)]) for i in range(300)] + [(1000 + i, [0.5] * 8) for i in range(200)]
ODD = [(1, None), (2, []), (3, [1.0] * 7), (4, [1.0] * 7 + [None]), (5, [1.0] * 7 + [float("nan")]), (6, [1.0] * 7 + [float("inf")]), (7, [float("-inf")] + [0.0] * 7)]
KEPT = [(None, [0.1] * 8), (0, [0.0] * 8), (0, [0.0] * 8), (5000, [-0.0001] * 8), (5001, [3e38] * 8), (5002, [-3e38] * 8)]


def test_rows_against_plain_rounds(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS + ODD + KEPT], "vec_id long, embedding array<double>, cluster int, sums string").repartition(4)
    got, c = yinyang.cluster(df, k=5, rounds=3, dim=8)
    big = yinyang.LARGEST
    kept = [(i, [max(-big, min(big, math.floor(64 * x))) for x in v]) for i, v in ROWS + KEPT]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:5]
    of, d, centroids = plain([v for _, v in kept], [v for _, v in first], 3)
    assert c.tolist() == centroids
    assert sorted(map(str, ((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()))) == sorted(str((i, o, x)) for (i, _), o, x in zip(kept, of, d, strict=True))


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame(ROWS[:3], "vec_id long, embedding array<double>")
    got, c = yinyang.cluster(df, k=16, dim=8)
    assert len(c) == 3 and sorted(r["distance"] for r in got.collect()) == [0, 0, 0]
    assert yinyang.cluster(df, dim=9)[0].count() == 0 == yinyang.cluster(df.limit(0), dim=8)[0].count()


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    cur = con.execute(yinyang.SQL["op13_centroid_clusters"])
    got = yinyang.op13_centroid_clusters(spark, path)
    assert got.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
