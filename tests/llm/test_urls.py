import math

import duckdb
import pytest
from pyspark.sql import functions as F

from chiffra.llm import urls

URLS = [None, "", "noscheme/x", "http://A.B.example.ORG/es/1?x", "https://example.org/en/12#f", "http://x.com/de/1", "http://x.com/fr/1", "http://org/", "http://aorg/", "ftp://x.org", "http://q.net:8080?z=/a", "http://h.net#a://b/c"]
HOSTS = ["", "", "", "a.b.example.org", "example.org", "x.com", "x.com", "org", "aorg", "x.org", "q.net:8080", "h.net"]
RULE = [None, None, None, "example.org/es/", "example.org/en/1", "com/de/", "com/fr/", "org/", None, None, None, None]


def test_hosts_rules_and_nulls(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, None)], "page_id long, url string")
    lab = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urls.judge_urls(df, lab).collect()}
    assert len(got) == len(URLS) + 1
    for i, (h, rule) in enumerate(zip(HOSTS, RULE, strict=True)):
        assert (got[i]["host"], got[i]["rule"]) == (h, rule), i
        assert got[i]["verdict"] == (dict(urls.RULES)[rule] if rule else "allow")
    assert urls.judge_urls(df.limit(0), lab).count() == 0


def test_bad_hosts_are_blocked_and_shrunk(spark):
    pages = [(i, f"http://bad.one.net/{i}") for i in range(40)] + [(100 + i, f"http://ok{i % 5}.two.net/{i}") for i in range(60)] + [(200, "http://new.one.net/")]
    labels = [(i, 0, 1) for i in range(40)] + [(100 + i, 1, 0) for i in range(60)]
    out = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {out[i]["verdict"] for i in range(40)} == {"block"} and {out[100 + i]["verdict"] for i in range(60)} == {"allow"}
    assert out[0]["risk_low"] > out[200]["risk_low"] > out[100]["risk_low"]


@pytest.mark.parametrize("a, b", [(2, 3), (1, 9), (40, 10), (3, 400), (700, 2100)])
def test_quantile_is_that_of_the_beta_distribution(spark, a, b):
    low = spark.range(1).select(urls.lower_quantile(F.lit(float(a)), F.lit(float(b)), 0.05)).first()[0]
    n = a + b - 1  # for whole a and b the distribution function is a binomial tail
    below = math.fsum(math.comb(n, j) * low**j * (1 - low) ** (n - j) if n < 900 else math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(low) + (n - j) * math.log(1 - low)) for j in range(a, n + 1))
    assert abs(below - 0.05) < 2e-3


def test_domains(spark):
    cases = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "www.x.com": ("x.com", "com"), "x.com:81": ("x.com", "com"), "loja.com.br": ("loja.com.br", "com.br"), "a.b.io": ("b.io", "io"), "10.1.2.3:80": ("10.1.2.3", ""), "": ("", ""), "localhost": ("localhost", "localhost"), "co.info": ("co.info", "info")}
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    assert {r[0]: (r[1], r[2]) for r in df.select("host", *urls.domain_of(F.col("host"))).collect()} == cases


def test_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "http://a.co.uk/", "x", 2)] * 3 + [(2, "http://b.co.uk/" + "y" * 100_000, "x", 2)], "page_id long, url string, host string, risk int")
    lab = spark.createDataFrame([(1, 0, 1, "x")] * 2 + [(2, 1, 0, "x")], "doc_id long, quality int, toxic int, url string")
    out = urls.judge_urls(df, lab).collect()
    assert sorted(r["host"] for r in out) == ["a.co.uk"] * 3 + ["b.co.uk"] and {r["verdict"] for r in out} == {"allow"}


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(urls.SQL["op9_url_filter"]).fetchall()
    low = dict(con.execute(urls.SQL["op9_url_filter"].rpartition("select page_id, host")[0].rstrip() + " select host, low from r").fetchall())
    mine = {r["host"]: r["risk_low"] for r in urls.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(low) == set(mine) and max(abs(low[h] - mine[h]) for h in low) < 1e-9
    got = [tuple(r) for r in urls.op9_url_filter(spark, sf).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
