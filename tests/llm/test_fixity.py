import hashlib

import duckdb

from chiffra.llm import fixity

FIELDS = "page_id long, url string, html string, offset int"


def test_places_and_digests(spark):
    rows = [(i, f"http://h/{i}", "é" * (i % 7), 1) for i in range(300)] + [(None, None, None, 2), (5, "http://h/5", "é" * 5, 1), (5, "http://h/5", "other", 1)]
    df = spark.createDataFrame(rows, FIELDS)
    ref, found = fixity.audited(df, df, fanout=4)
    assert found.count() == 0
    got = sorted(ref.collect(), key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in got] == list(range(len(rows)))
    end = 0
    for r in got:
        assert r["offset"] == end
        end += r["length"]
    body = b"\xc3\xa9" * 3
    raw = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: http://h/3\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:" + hashlib.sha256(body).hexdigest().encode() + b"\r\nContent-Length: 6\r\n\r\n" + body + b"\r\n\r\n"
    assert next(r["digest"] for r in got if r["page_id"] == 3) == hashlib.sha256(raw).hexdigest()


def test_root_is_that_of_a_plain_tree(spark):
    df = spark.createDataFrame([(i, "u", str(i)) for i in range(150)], "page_id long, url string, html string")
    ref, _ = fixity.audited(df, df, fanout=8)
    level = [r["digest"] for r in sorted(ref.collect(), key=lambda r: r["ordinal"])]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 8]).encode()).hexdigest() for i in range(0, len(level), 8)]
    assert fixity.tree(ref, 8)[-1].first()["hash"] == level[0]


def test_finds_all_faults(spark):
    rows = [(i, f"u{i}", f"body {i}") for i in range(500)]
    spoiled = [(i, u, "BODY" if i in (0, 77, 499) else b) for i, u, b in rows if i not in (3, 250)] + [(900, "new", "b"), (77, "second", "b")]
    kind = "page_id long, url string, html string"
    _, found = fixity.audited(spark.createDataFrame(rows, kind), spark.createDataFrame(spoiled, kind), fanout=5)
    got = {(r["page_id"], r["copy"], r["state"]) for r in found.collect()}
    assert {g for g in got if g[0] != 77} == {(0, 1, "damaged"), (499, 1, "damaged"), (3, 1, "missing"), (250, 1, "missing"), (900, 1, "added")}
    assert {g[1:] for g in got if g[0] == 77} == {(1, "damaged"), (1, "added")}
    empty = spark.createDataFrame([], kind)
    assert fixity.audited(empty, empty)[1].count() == 0
    assert fixity.audited(spark.createDataFrame(rows[:3], kind), empty)[1].count() == 3


def test_one_spoiled_copy_is_one_report(spark):
    kind = "page_id long, url string, html string, digest string, copy int"
    rows = [(5, "u", f"body {i}", "x", i) for i in range(8)] + [(None, "u", f"none {i % 3}", "x", 0) for i in range(90)]
    other = [(p, u, "spoiled" if (p, b) == (5, "body 3") else b, d, c) for p, u, b, d, c in rows][:-1]
    _, found = fixity.audited(spark.createDataFrame(rows, kind), spark.createDataFrame(other, kind), fanout=2)
    assert sorted((str(r["page_id"]), r["state"]) for r in found.collect()) == [("5", "damaged"), ("None", "missing")]


def test_small_fanout_reaches_the_root(spark):
    df = spark.createDataFrame([(i, "u", str(i)) for i in range(9000)], "page_id long, url string, html string")
    ref, _ = fixity.audited(df.limit(0), df.limit(0))
    assert ref.count() == 0
    ref = fixity.stored(fixity.placed(fixity.records(df)), "ref")
    levels = fixity.tree(ref, 2)
    assert len(levels) == 15 and levels[-1].count() == 1 and levels[-1].first()["records"] == 9000


def test_query_reports_exactly_the_spoiled_records(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    other = fixity.replica_of(pages)
    bad = {r[0] for r in pages.alias("a").join(other.alias("b"), "page_id").where("a.html <> b.html").select("page_id").collect()}
    got = {r["page_id"] for r in fixity.op4_fixity_audit(spark, sf).where("state = 'damaged'").collect()}
    assert got == bad and bad


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    cur = con.execute(fixity.SQL["op4_fixity_audit"])
    df = fixity.op4_fixity_audit(spark, sf).select(*[d[0] for d in cur.description])
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
