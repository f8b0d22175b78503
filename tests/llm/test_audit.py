import itertools
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from chiffra.llm import audit

SCHEMA = "doc_id long, text string, source string, n int, mask string, class int"


def brute(rows, labels):
    """Every order applied to the documents one filter after another."""
    texts = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            texts[r[1] or ""].append(r[0])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for r in rows:
        t = r[1] or ""
        w = [x for x in t.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = r[0] is not None and min(texts[t]) < r[0]
        docs.append((r[2] or "", r[0], {k for k, v in fails.items() if v}))
    out, shap = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        alive = docs
        for i, f in enumerate(order):
            gone = [d for d in alive if f in d[2]]
            left = [d for d in alive if f not in d[2]]
            for part in {d[0] for d in docs}:
                of = lambda ds: [d for d in ds if d[0] == part]  # noqa: B023, E731
                fail = [d for d in of(docs) if f in d[2]]
                out[part, "".join(order), i + 1] = [len(of(left)), len(of(gone)), len(fail) - len(of(gone)), sum(d[2] == {f} for d in fail), sum(d[1] in good for d in of(gone)), sum(d[1] in toxic for d in of(gone))]
                shap[part, f] += len(of(gone))
            alive = left
    return {k: (*v, shap[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of():
    say = lambda i, n: " ".join(f"w{(i * 7 + k) % 90}é" for k in range(n))
    rows = [(i, say(i % 13, 20 + i % 60), f"s{i % 3}" if i % 5 else None) for i in range(120)]
    rows += [(200 + i, "X" * (i % 4) + say(1, 70) + "#" * (i % 2), "") for i in range(12)]
    long = say(3, 6000)
    rows += [(300, long, "s0"), (301, long[:-1] + "z", "s0"), (302, long, "s1"), (303, "A" + long[1:], "s1"), (299, long, None)]
    rows += [(None, long, "s0"), (None, None, "s0"), (5, None, "s0"), (5, "", None), (5, "", None), (7, "", "s2"), (300, long, "s0"), (400, " \t\n", "s2")]
    return rows


@pytest.mark.parametrize("bits", [64, 3])
def test_every_order_against_brute_force(spark, bits):
    """With hashes of three bits classes hold different texts, which their texts tell apart."""
    rows = rows_of()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 320, 3)] + [(300, None, 1), (300, 1, None), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "m", 2) for r in rows], SCHEMA)
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), hash_bits=bits).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 4 * 600
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got} == want


def test_own_filters_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, "", "x"), (4, "c", "x")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = audit.audit(docs, labels, {"s": F.size("words") < 1}, "x").collect()
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in out} == {("sx", 1): (3, 1, 2), ("sx", 2): (2, 1, 2), ("xs", 1): (3, 1, 2), ("xs", 2): (2, 1, 2)}
    assert audit.audit(docs.limit(0), labels).count() == 0


def test_blocks_cover_a_text_without_gaps():
    assert [audit._block(k) for k in range(3)] == [(0, 256), (256, 256 * 64), (256 * 65, 256 * 64 * 64)]


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(audit.SQL["op11_filter_audit"])
    names = [d[0] for d in cur.description]
    got = audit.op11_filter_audit(spark, sf)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cur.fetchall())
    assert [t for _, t in got.select(names).dtypes] == ["string", "string", "int"] + ["bigint"] * 7
