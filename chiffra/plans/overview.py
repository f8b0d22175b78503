"""Overviews: passages to quote, material of a perspective note, codes across editions, agreement of two readers, dashboard."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chiffra.functions import text as T
from chiffra.operators import assembly as A
from chiffra.operators import evaluation as E
from chiffra.plans import notes as PN
from chiffra.plans.base import query, r6, table

_PROSE = f"""not regexp_matches({T.normalised_sql('text')}, '{'|'.join(T.NO_PROSE)}') and not regexp_matches(text, '\\.{{{{6,}}}}') and len(regexp_extract_all(text, '\\p{{{{Lu}}}}')) <= 0.4 * len(regexp_extract_all(text, '\\p{{{{L}}}}')) and len(regexp_extract_all(text, '[^ \\t\\n\\r\\v\\f]+')) >= 20""".replace("{{", "{").replace("}}", "}")


@query("substantial_passages", f"select lang, count(*) filter (coalesce({_PROSE}, false)) n_substantial, count(*) n from documents group by 1")
def substantial_passages(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count_if(T.substantial(F.col("text"))).alias("n_substantial"), F.count(F.lit(1)).alias("n"))


@query("perspective_material", f"""with o as (select o_orderstatus lang_, o_orderpriority theme, o_orderkey, o_orderpriority || ' = ' || floor(o_totalprice / 50000)::bigint t, row_number() over (partition by o_orderstatus, o_orderpriority order by o_orderkey) r from orders),
f as (select lang_, t, min((theme, r)) at_ from o where r <= 8 group by 1, 2), g as (select lang_, row_number() over (partition by lang_ order by at_) p, t from f),
d as (select case lang when 'en' then 'F' when 'fr' then 'O' else 'P' end lang_, doc_id, text from documents where {_PROSE}), h as (select lang_, row_number() over (partition by lang_ order by doc_id) p, text from d qualify p <= 5)
select lang_ note, 'figure' kind, p::int as "position", md5(t) digest from g union all select lang_, 'tendency', p::int, md5(text) from h""")
def perspective_material(spark, sf):
    """For three notes: eight figures of each theme, each once, and the first five substantial passages."""
    w = Window.partitionBy("o_orderstatus", "o_orderpriority").orderBy("o_orderkey")
    o = table(spark, sf, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 8")
    figures = o.select(F.col("o_orderstatus").alias("note"), F.col("o_orderpriority").alias("theme"), "rank", F.concat("o_orderpriority", F.lit(" = "), F.floor(F.col("o_totalprice") / 50000).cast("string")).alias("text"))
    note = F.when(F.col("lang") == "en", "F").when(F.col("lang") == "fr", "O").otherwise("P")
    d = table(spark, sf, "documents").select(note.alias("note"), F.col("doc_id").alias("id"), "text")
    return A.perspective(figures, d, "note").select("note", "kind", "position", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("coherence_report", "with p as (select c_mktsegment || ' ' || o_orderpriority code, count(distinct year(o_orderdate)) n from orders join customer on c_custkey = o_custkey group by 1) select count(*) n_codes, count(*) filter (n >= 2) n_multi, count(*) filter (n = 1) n_single from p")
def coherence_report(spark, sf):
    """Codes of segment and priority that two years or more have."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return A.coherence_report(o.select(F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("code"), F.year("o_orderdate").alias("edition")))


@query("keyed_agreement", """with a as (select p_partkey k, p_size // 10 c from part where p_size > 5), b as (select p_partkey k, (p_size + p_partkey % 4) // 10 c from part where p_size < 45), j as (select a.c x, b.c y from a join b using (k)), n as (select count(*)::double n from j),
e as (select sum(l.m * r.m) e from (select x k, count(*) m from j group by 1) l join (select y k, count(*) m from j group by 1) r using (k)), s as (select count(*) filter (x = y) o from j)
select n::bigint n, round(o / n, 6) observed, round((o / n - e / (n * n)) / nullif(1 - e / (n * n), 0), 6) kappa from n, e, s""")
def keyed_agreement(spark, sf):
    """Two readers' choices, met by their keys: agreement and Cohen's kappa over what both have."""
    p = table(spark, sf, "part")
    a = p.where("p_size > 5").select("p_partkey", F.floor(F.col("p_size") / 10).alias("a"))
    b = p.where("p_size < 45").select("p_partkey", F.floor((F.col("p_size") + F.col("p_partkey") % 4) / 10).alias("b"))
    return E.kappa(a.join(b, "p_partkey").select("a", "b")).select("n", r6("observed", "observed"), r6("kappa", "kappa"))


@query("dashboard", f"with {PN._CELLS}, l as (select ind, max(y) y, count(*) n from t group by 1) select ind indicator, l.y as year, v as value, rel as change, n n_years, 'Commandes ' || l.y as source from l join t using (ind, y)")
def dashboard(spark, sf):
    """The latest level of each segment, its change, the length of its series and the source's label."""
    levels, _ = PN.evolutions(spark, sf)
    return A.dashboard(levels.withColumn("source", F.concat(F.lit("Commandes "), F.col("year").cast("string"))).withColumnRenamed("name", "indicator"), "indicator")
