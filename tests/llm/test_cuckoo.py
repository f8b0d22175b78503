import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from chiffra.llm import cuckoo
from chiffra.llm.cuckoo import Cuckoo


def keep(ids, at=None):
    ids = np.asarray(ids)
    return np.stack([np.ones_like(ids), ids, ids if at is None else np.asarray(at), np.ones_like(ids)], axis=1)


def test_inserts_lookups_deletions_against_a_dict():
    """Batches of few distinct digests, a third of them deleted in between; fingerprints collide, tables overflow."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, (30_000, 4)).astype(np.uint64)
    c, live = Cuckoo(2), {}
    for turn in range(30):
        pick = rng.integers(0, len(pool), 2_000)
        ids = rng.permutation(2_000) + turn
        c.insert(pool[pick], keep(ids))
        for p, i in zip(pick, ids, strict=True):
            was = live.get(p, (-1, 0))
            live[p] = (max(was[0], i), was[1] + 1)
        gone = rng.integers(0, len(pool), 700)
        assert c.delete(pool[gone]) == len(set(gone) & set(live))
        for p in gone:
            live.pop(p, None)
        assert ((c.find(pool) >= 0) == np.isin(np.arange(len(pool)), list(live))).all()
        assert (c.fp > 0).sum() == len(live)
    key = c.find(pool[list(live)])
    assert [tuple(x) for x in c.keep[key][:, [1, 3]]] == list(live.values())
    assert c.resizes > 8 and c.false_hits > 0


def test_keys_that_fit_nowhere_double_the_buckets():
    c = Cuckoo(1)
    d = np.arange(400, dtype=np.uint64).reshape(100, 4)
    c.insert(d, keep(np.arange(100)))
    assert (c.find(d) >= 0).all() and c.bits >= 5


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(lower)].append(i)
    out = []
    for t, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, last, len(ids), i == last and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != last
    return sorted(out, key=str)


ROWS = [(i, f"Text É {i % 37}" if i % 2 else f"tEXT É {i % 37}") for i in range(200)] + [(300 + i, "hot") for i in range(150)]
ROWS += [(None, "x"), (None, "X"), (None, None), (1, ""), (7, None), (500, "É"), (501, "é"), (502, "a" * 300_000), (503, "A" * 300_000), (504, "a" * 299_999 + "b"), (600, "r"), (600, "R"), (600, "r"), (-5, "neg"), (-6, "NEG")]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_groups_against_brute_force(spark, digest_bytes):
    """With digests of one byte different texts share a digest; the comparison of the texts parts them."""
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in ROWS], "doc_id long, text string, keep_id int, digest string, at int").repartition(5)
    got = cuckoo.exact_dedup(docs, digest_bytes).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["sha256"].hex()) for r in got), key=str) == brute(ROWS)


def test_empty_table(spark):
    assert cuckoo.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_an_index_is_kept_up(spark, monkeypatch):
    """Three rounds over one index in four shards: rows enter, texts leave, rows enter again."""
    monkeypatch.setattr(cuckoo, "PER_TASK", 10)
    frame = lambda rows: cuckoo.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    live, index = {}, cuckoo.empty(spark)
    for turn in range(3):
        rows = [(turn * 1000 + i, f"t{i * (turn + 1) % 90}") for i in range(120)]
        gone = [f"t{i}" for i in range(turn * 20, turn * 20 + 30)] + ["never there"]
        index = cuckoo.stored(cuckoo.updated(index, frame(rows), frame([(0, t) for t in gone]).select("digest"), 4), "test-index")
        for t in gone:
            live.pop(t, None)
        for i, t in rows:
            was = live.get(t, (-1, 0))
            live[t] = (max(was[0], i), was[1] + 1)
        got = {bytes(r["digest"]): (r["keep_id"], r["copies"]) for r in index.collect()}
        assert got == {hashlib.sha256(t.encode()).digest(): v for t, v in live.items()}
        assert index.select("shard", "bucket", "slot").distinct().count() == len(live)


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    cur = con.execute(cuckoo.SQL["op12_exact_dedup"])
    got = cuckoo.op12_exact_dedup(spark, path)
    assert got.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
