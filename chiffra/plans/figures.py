"""Series, pairing, guard, journal and evaluation queries over the fact tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chiffra.functions import numbers as N
from chiffra.functions import text as T
from chiffra.operators import evaluation as E
from chiffra.operators import guard as G
from chiffra.operators import journal as J
from chiffra.operators import pairing as P
from chiffra.operators import series as S
from chiffra.plans.base import query, r6, table
from chiffra.streaming import journal as SJ
from chiffra.streaming import limits as L

# Cells: order totals by priority and year, rounded to whole units, with a total row; ids in a fixed order.
_CELLS = """base as (select o_orderpriority row_label, year(o_orderdate)::int as year_, round(sum(o_totalprice), 0) v from orders group by all union all select 'Total', year(o_orderdate)::int, round(sum(o_totalprice), 0) from orders group by all),
cells as (select row_label, year_, v, row_number() over (order by row_label, year_)::bigint id from base)"""


def cells(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("row_label"), F.year("o_orderdate").alias("year"), "o_totalprice")
    base = o.unionByName(o.withColumn("row_label", F.lit("Total"))).groupBy("row_label", "year").agg(F.round(F.sum("o_totalprice"), 0).alias("value"))
    return base.withColumn("value_id", F.row_number().over(Window.orderBy("row_label", "year")).cast("long"))  # a table of a few dozen cells


@query("yoy_variations", f"with {_CELLS} select a.row_label, a.year_ as \"year\", a.id value_id, b.year_ ref_year, b.id ref_id, round(a.v - b.v, 0) var_abs, round(100 * (a.v - b.v) / nullif(b.v, 0), 1) var_rel from cells a join cells b on a.row_label = b.row_label and b.year_ < a.year_")
def yoy_variations(spark, sf):
    return S.variations(cells(spark, sf), ["row_label"]).select("row_label", "year", "value_id", "ref_year", "ref_id", "var_abs", "var_rel")


@query("lag_changes", f"with {_CELLS} select row_label, year_ as \"year\", round(100 * (v - lag(v) over w) / nullif(lag(v) over w, 0), 4) change from cells window w as (partition by row_label order by year_)")
def lag_changes(spark, sf):
    return S.successive(cells(spark, sf), ["row_label"]).select("row_label", "year", F.round("change", 4).alias("change"))


@query("cross_edition_variations", """with b as (select c_mktsegment seg, 1995 + (o_orderkey % 4)::int edition, round(sum(o_totalprice), 0) v from orders join customer on c_custkey = o_custkey group by all)
select x.seg, x.edition, y.edition ref_edition, x.v - y.v var_abs, round(100 * (x.v - y.v) / nullif(y.v, 0), 1) var_rel from b x join b y on x.seg = y.seg and y.edition < x.edition""")
def cross_edition_variations(spark, sf):
    b = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("seg"), (1995 + F.col("o_orderkey") % 4).cast("int").alias("edition")).agg(F.round(F.sum("o_totalprice"), 0).alias("value"))
    b = b.withColumn("value_id", F.col("edition").cast("long"))
    return S.cross_edition(b, b, ["seg"]).select("seg", "edition", "ref_edition", "var_abs", "var_rel")


@query("series_extension", f"""with {_CELLS}, c2 as (select row_label, 'Nombre' sub, year_, v, id from cells where year_ >= 1999 union all select row_label, '' sub, year_, v, id from cells where year_ < 2000)
select row_label, sub, year_ as "year", id value_id from c2 union all select l.row_label, 'Nombre', p.year_, p.id from (select distinct row_label from c2 where sub = 'Nombre') l join c2 p on p.row_label = l.row_label and p.sub = '' where not exists (select 1 from c2 z where z.row_label = l.row_label and z.sub = 'Nombre' and z.year_ = p.year_)""")
def series_extension(spark, sf):
    c = cells(spark, sf)
    both = c.where("year >= 1999").withColumn("sub", F.lit("Nombre")).unionByName(c.where("year < 2000").withColumn("sub", F.lit("")))
    return S.extended(both, ["row_label", "sub"]).select("row_label", "sub", "year", "value_id")


_MONTHS = """m as (select o_orderpriority p, date_trunc('month', o_orderdate) mo, round(sum(o_totalprice), 0) v from orders group by all), ch0 as (select p, mo, 100 * (v - lag(v) over w) / nullif(lag(v) over w, 0) change from m window w as (partition by p order by mo)), ch as (select * from ch0 where change is not null)"""


def month_changes(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 0).alias("value"))
    return S.successive(m, ["p"], "month")


@query("trend_qualification", f"with {_MONTHS} select p, strftime(mo, '%Y-%m') as \"month\", case when count(change) over w < 3 then 'short' when min(change) over w > 0 then 'rising' when max(change) over w < 0 then 'falling' else 'one-off' end trend from ch window w as (partition by p order by mo rows between 2 preceding and current row)")
def trend_qualification(spark, sf):
    return S.trend(month_changes(spark, sf), ["p"], "month").select("p", "month", "trend")


_SAL = f"{_MONTHS}, sal as (select p, mo, change, count(change) over w n_history, stddev_pop(change) over w sd from ch window w as (partition by p order by mo rows between unbounded preceding and 1 preceding)), sc as (select p, mo, change, n_history, case when n_history >= 3 and sd > 0 then abs(change) / sd else abs(change) end score, case when n_history >= 3 and sd > 0 then 'sd' else 'change' end base from sal)"


@query("saliency_score", f"with {_SAL} select p, strftime(mo, '%Y-%m') as \"month\", n_history, base, round(score, 4) score from sc")
def saliency_score(spark, sf):
    return S.saliency(month_changes(spark, sf), ["p"], "month").select("p", "month", "n_history", "base", F.round("score", 4).alias("score"))


@query("top_evolutions", f"with {_SAL} select p, strftime(mo, '%Y-%m') as \"month\", round(score, 4) score from sc qualify row_number() over (partition by p order by round(score, 6) desc, mo) <= 7")
def top_evolutions(spark, sf):
    """The seven most salient changes of each series."""
    s = S.saliency(month_changes(spark, sf), ["p"], "month")
    return s.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy(F.round("score", 6).desc(), "month"))).where("n <= 7").select("p", "month", F.round("score", 4).alias("score"))


@query("report_evolutions", f"""with recursive {_SAL}, rk as (select p, strftime(mo, '%Y-%m') mon, round(change, 0)::int rounded, score, row_number() over (partition by p order by round(score, 6) desc, mo) rank from sc),
w as (select p, 0::bigint rank, []::varchar[] a, []::int[] b, false took from (select distinct p from rk) union all
select p, rank, case when ok then list_append(a, mon) else a end, case when ok then list_append(b, rounded) else b end, ok from (select w.p, rk.rank, a, b, mon, rounded, not list_contains(a, mon) and not list_contains(b, rounded) and len(a) < 7 ok from w join rk on rk.p = w.p and rk.rank = w.rank + 1))
select p report, rank::int rank, mon as "month", rounded, round(score, 4) score from w join rk using (p, rank) where took""")
def report_evolutions(spark, sf):
    """Each region's list of evolutions: by score, no two of the same month or the same rounded change. What is taken depends
    on what was taken; lists are those of single reports, and any number of reports is processed at once."""
    s = S.saliency(month_changes(spark, sf), ["p"], "month").select(F.col("p").alias("report"), "month", F.round("change", 0).cast("int").alias("rounded"), "score")
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("report").orderBy(F.round("score", 6).desc(), "month")))
    return S.ordered_dedup(s, "report", "month", "rounded", 7).withColumn("score", F.round("score", 4))


@query("total_reconciliation", """with l as (select l_orderkey k, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 0) v from lineitem group by 1), t as (select year(o_orderdate)::int as year_, round(o_totalprice / 1000, 0) total, round(coalesce(v, 0) / 1000, 0) ref from orders left join l on k = o_orderkey)
select year_ as "year", total, count(*) n_refs from (select distinct year_, total, ref from t) group by 1, 2 having count(*) > 1""")
def total_reconciliation(spark, sf):
    """Totals of a year that stand beside more than one reference value."""
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 0).alias("v"))
    t = table(spark, sf, "orders").join(line, "o_orderkey", "left").select(F.year("o_orderdate").alias("name"), F.round(F.col("o_totalprice") / 1000, 0).alias("total"), F.round(F.coalesce("v", F.lit(0.0)) / 1000, 0).alias("ref"))
    return S.incoherent_totals(t).select(F.col("name").alias("year"), "total", "n_refs")


@query("pairing_top2", f"""with f as (select p_size ed, p_brand b, p_type t, p_name nm, round(avg(p_retailprice), 1) v from part group by all),
charts as (select ed, row_number() over (partition by ed order by b)::int chart, {T.token_set_sql("'Prix ' || min(nm)")} ws, list_distinct(list(v)) vals from f group by ed, b), tabs as (select ed, row_number() over (partition by ed order by split_part(t, ' ', 1))::int tab, {T.token_set_sql("'Prix ' || min(nm)")} ws, list_distinct(list(v)) vals from f group by ed, split_part(t, ' ', 1)),
s0 as (select c.ed, chart, tab, {T.jaccard_sql('c.ws', 't.ws')} si, len(list_filter(c.vals, lambda v: list_contains(t.vals, v) or list_contains(list_transform(t.vals, lambda x: round_even(x, 0)), v))) / len(c.vals)::double sv from charts c join tabs t on c.ed = t.ed),
s as (select *, round(0.5 * si + 0.5 * sv, 9) score from s0), r as (select *, row_number() over (partition by ed, chart order by score desc, si desc, sv desc, tab desc) n from s)
select ed edition, chart, max(tab) filter (n = 1) as "table", max(tab) filter (n = 2) table_2, round(max(score) filter (n = 1), 6) score, case when max(score) filter (n = 1) >= 0.35 then 'candidate' else 'to check' end status from r where n <= 2 group by 1, 2""")
def pairing_top2(spark, sf):
    """Charts are prices by brand, tables prices by kind, within a size; each is titled by the first name that it holds."""
    f = table(spark, sf, "part").groupBy(F.col("p_size").alias("edition"), "p_brand", "p_type", "p_name").agg(N.scaled_round(F.avg("p_retailprice"), 1).alias("v"))
    ed = Window.partitionBy("edition")
    title = F.concat(F.lit("Prix "), F.min("p_name")).alias("title")
    charts = f.groupBy("edition", "p_brand").agg(F.array_distinct(F.collect_list("v")).alias("values"), title).withColumn("chart", F.row_number().over(ed.orderBy("p_brand")))
    tabs = f.groupBy("edition", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind")).agg(F.array_distinct(F.collect_list("v")).alias("values"), title).withColumn("table", F.row_number().over(ed.orderBy("kind")))
    exact = P.propose(charts, tabs)
    return exact.select("edition", "chart", "table", "table_2", r6("score", "score"), "status")


@query("double_reading_consolidation", """with p as (select doc_id chart, quality tab from labels), two as (select doc_id chart, case when quality = 1 then 'valid' else 'rejected' end a, case when n_chars >= 600 then 'valid' else 'rejected' end b from labels join documents using (doc_id) where doc_id % 3 <> 0)
select p.chart, case when a is null then 'candidate' when a = b then a else 'to check' end status from p left join two using (chart)""")
def double_reading_consolidation(spark, sf):
    """Two readers: the quality label, and a rule on length; a third of the pairings has been read once only."""
    lab = table(spark, sf, "labels")
    d = lab.join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    one = lab.select(F.col("doc_id").alias("chart"), F.lit("Label ").alias("reader"), F.when(F.col("quality") == 1, "valid").otherwise("rejected").alias("decision"), F.lit(1).alias("at"))
    two = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("chart"), F.lit("rule").alias("reader"), F.when(F.col("n_chars") >= 600, "valid").otherwise("rejected").alias("decision"), F.lit(2).alias("at"))
    readings = one.unionByName(two).withColumn("new_table", F.lit(None).cast("int"))
    pairings = lab.select(F.col("doc_id").alias("chart"), F.lit("candidate").alias("status"), F.col("quality").alias("table"))
    return P.consolidated(pairings, readings).select("chart", "status")


@query("cohen_kappa", """with p as (select (quality = 1) a, (n_chars >= 600) b from labels join documents using (doc_id)), c as (select count(*)::double t, sum(case when a = b then 1 else 0 end) / count(*)::double po, (sum(case when a then 1 else 0 end)::double * sum(case when b then 1 else 0 end) + sum(case when a then 0 else 1 end)::double * sum(case when b then 0 else 1 end)) / (count(*)::double * count(*)) pe from p)
select t::bigint n, round(po, 6) observed, round((po - pe) / nullif(1 - pe, 0), 6) kappa from c""")
def cohen_kappa(spark, sf):
    p = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("a"), (F.col("n_chars") >= 600).alias("b"))
    return E.kappa(p).select("n", r6("observed", "observed"), r6("kappa", "kappa"))


@query("kendall_tau", """with x as (select n_nationkey id, count(*)::double x, avg(c_acctbal) y from customer join nation on c_nationkey = n_nationkey group by 1), p as (select sign(a.x - b.x) sx, sign(a.y - b.y) sy from x a join x b on a.id < b.id)
select sum(case when sx * sy > 0 then 1 else 0 end)::bigint concordant, sum(case when sx * sy < 0 then 1 else 0 end)::bigint discordant, round(sum(sx * sy)::double / nullif(sqrt(sum(abs(sx))::double * sum(abs(sy))::double), 0), 6) tau from p""")
def kendall_tau(spark, sf):
    x = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.avg("c_acctbal").alias("y"))
    return E.kendall(x).select("concordant", "discordant", r6("tau", "tau"))


@query("percentile_latency", "select event_type, count(*) n, round(quantile_cont(value, 0.5), 4) median, round(quantile_cont(value, 0.9), 4) p90, round(max(value), 4) top from events group by 1")
def percentile_latency(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", 0.5), 4).alias("median"), F.round(F.percentile("value", 0.9), 4).alias("p90"), F.round(F.max("value"), 4).alias("top"))


@query("verdicts", "select event_type, case when count(*) filter (not ok) > 0 then 'not validated' when count(*) filter (ok is null) > 0 then 'inconclusive' else 'validated' end verdict from (select event_type, case when event_id % 7 = 0 then null else value > -1 end ok from events) group by 1")
def verdicts(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 7 != 0, F.col("value") > -1).alias("ok"))
    return e.groupBy("event_type").agg(E.verdict("ok").alias("verdict"))


@query("latest_validated", "select user_id, event_id, round(value, 6) as \"value\" from events where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_validated(spark, sf):
    return J.latest(table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", r6("value", "value"))


@query("journal_json", "select event_type, sum(cast(json_extract(props, '$.k') as bigint))::bigint k, count(*) n from events group by 1")
def journal_json(spark, sf):
    e = J.read_payload(table(spark, sf, "events"), "props", "k long")
    return e.groupBy("event_type").agg(F.sum("props.k").alias("k"), F.count(F.lit(1)).alias("n"))


@query("missing_quarters", "with q as (select y, t from (select unnest(range(1995, 2003)) y), (select unnest(range(1, 5)) t)) select y::int as \"year\", 'T' || t as \"quarter\" from q where not exists (select 1 from orders where year(o_orderdate) = y and quarter(o_orderdate) = t)")
def missing_quarters(spark, sf):
    years = spark.range(1995, 2003).select(F.col("id").cast("int").alias("year"))
    quarters = spark.range(1, 5).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("quarter"))
    have = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.concat(F.lit("T"), F.quarter("o_orderdate").cast("string")).alias("quarter")).distinct()
    return years.crossJoin(quarters).join(have, ["year", "quarter"], "left_anti")


@query("registry_diff", "select o_orderkey, array_to_string(list_filter([case when year(o_orderdate) is distinct from year(l) then 'year' end, case when quarter(o_orderdate) is distinct from quarter(l) then 'quarter' end], lambda x: x is not null), ',') diff from orders join (select l_orderkey, min(l_shipdate) l from lineitem group by 1) on l_orderkey = o_orderkey")
def registry_diff(spark, sf):
    """Declared against detected metadata: which fields differ, nulls counting as values."""
    seen = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("l"))
    d = table(spark, sf, "orders").join(seen, "o_orderkey")
    off = lambda f, name: F.when(~f("o_orderdate").eqNullSafe(f("l")), name)
    return d.select("o_orderkey", F.array_join(F.array_compact(F.array(off(F.year, "year"), off(F.quarter, "quarter"))), ",").alias("diff"))


@query("code_propagation", "with f as (select l_orderkey k, l_partkey code from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) = 1) select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then 7::bigint end, code) code from orders left join f on k = o_orderkey")
def code_propagation(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(7).cast("long")).alias("code"))
    codes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("code"), F.col("l_linenumber").alias("rank"))
    return P.propagated(rows, codes, ["k"]).select(F.col("k").alias("o_orderkey"), "code")


@query("baseline_previous_year", f"with {_CELLS} select a.row_label, a.year_ as \"year\", b.v as previous from cells a left join cells b on a.row_label = b.row_label and b.year_ = a.year_ - 1")
def baseline_previous_year(spark, sf):
    c = cells(spark, sf)
    prev = c.select("row_label", (F.col("year") + 1).alias("year"), F.col("value").alias("previous"))
    return c.select("row_label", "year").join(prev, ["row_label", "year"], "left")


@query("explorer_counts", "select n_name, (select count(*) from customer where c_nationkey = n_nationkey) n_customers, (select count(*) from supplier where s_nationkey = n_nationkey) n_suppliers from nation")
def explorer_counts(spark, sf):
    """Per-row counts as left joins on pre-aggregated sides."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    n = table(spark, sf, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return n.select("n_name", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


@query("multi_edition_codes", "select o_orderpriority code, count(distinct year(o_orderdate)) n_editions, min(o_orderkey) first_key from orders group by 1 having count(distinct year(o_orderdate)) >= 2")
def multi_edition_codes(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("code")).agg(F.countDistinct(F.year("o_orderdate")).alias("n_editions"), F.min("o_orderkey").alias("first_key")).where("n_editions >= 2")


# Statements about parts: the retail price of each, and the unit price at which its first line was sold, in the same
# sentence. Prices of the catalogue are authorised within a brand; a line's price mostly isn't one of them.
_PRICES = """line as (select l_partkey pk, round(arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)), 0) sold from lineitem group by 1),
base as (select p_partkey pk, p_name nm, p_brand brand, round(p_retailprice, 0) price, sold, sold between 2010 and 2035 yr, sold between 2010 and 2035 or exists (select 1 from part x where round(x.p_retailprice, 0) = sold) known from part join line on pk = p_partkey)"""
_FR0 = lambda x: f"replace(format('{{:,.0f}}', {x}), ',', ' ')"


def statements(spark, sf):
    """(statements, authorised values)"""
    first = F.min_by(F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber"))
    line = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(first, 0).alias("sold"))
    parts = table(spark, sf, "part")
    price = N.formatted(F.round("p_retailprice", 0), 0)
    text = F.concat(F.lit("Le prix de « "), "p_name", F.lit(" » est de "), price, F.lit(" en 2020, contre "), N.formatted(F.col("sold"), 0), F.lit(" à la vente ; le tableau 3 le rappelle."))
    return parts.join(line, "p_partkey").select(F.col("p_partkey").alias("statement_id"), text.alias("text")), parts.select(price.alias("writing"), F.col("p_name").alias("source"), F.col("p_partkey").alias("priority"))


@query("literal_guard", f"""with {_PRICES}
select pk statement_id, case when known then 'kept' else 'reformulated' end as action, case when yr then 1 else 2 end::bigint n_numbers, case when known and not yr then 2 else 1 end::bigint n_kept,
'Le prix de « ' || nm || ' » est de ' || {_FR0('price')} || ' en 2020, ' || case when known then 'contre ' || {_FR0('sold')} || ' à la vente ; ' else '' end || 'le tableau 3 le rappelle.' as text from base""")
def literal_guard(spark, sf):
    """Statements whose second price stands in no catalogue lose the clause that holds it, and keep the rest. A price from
    2 010 to 2 035 reads as a year and is no value."""
    s, auth = statements(spark, sf)
    return G.guarded(s, auth).select("statement_id", "action", "n_numbers", "n_kept", "text")


@query("literal_guard_sources", f"""with {_PRICES}
select pk statement_id, base.nm as source, case when known then 0 else 1 end n_bad from base""")
def literal_guard_sources(spark, sf):
    """The source of the first price is the part that the statement has just quoted, whichever else has that price."""
    s, auth = statements(spark, sf)
    n = G.sourced(G.found_numbers(s), G.index_of(auth))
    return n.groupBy("statement_id").agg(F.min_by("source", "start").alias("source"), F.count_if(F.col("source").isNull()).cast("int").alias("n_bad"))


@query("guard_audit", f"""with {_PRICES}, b as (select brand, known, case when yr then 1 else 2 end cited_, case when known and not yr then 2 else 1 end kept_ from base)
select brand, count(*) n, count(*) filter (known) kept, count(*) filter (not known) reformulated, 0::bigint deleted, sum(cited_)::bigint cited, sum(kept_)::bigint retained,
round(sum(kept_) / sum(cited_)::double, 4) coverage, 1.0::double statement_rate from b group by 1""")
def guard_audit(spark, sf):
    """Statements by action, values cited and kept, and the rates, by brand."""
    s, auth = statements(spark, sf)
    g = G.guarded(s, auth).join(table(spark, sf, "part").select(F.col("p_partkey").alias("statement_id"), F.col("p_brand").alias("brand")), "statement_id")
    return G.audited(g, ["brand"])


@query("deviation_typology", """with g as (select distinct o_orderpriority k, round(o_totalprice / 5000, 0) v from orders where o_orderkey % 10 = 1), a as (select distinct o_orderpriority k, round(o_totalprice / 5000, 1) v from orders where o_orderkey % 1000 = 3),
e as (select distinct o_orderpriority k, round(o_totalprice / 5000, 0) v from orders where o_orderkey % 100 = 2),
r as (select *, row_number() over (partition by k order by v) n from a), few as (select k, v from r where n <= 6),
pairs as (select x.k, unnest([y.v - x.v, x.v + y.v, 100 * (y.v - x.v) / nullif(x.v, 0), 100 * (y.v - x.v) / nullif(y.v, 0), 100 * x.v / nullif(y.v, 0), 100 * y.v / nullif(x.v, 0)]) z from few x join few y on x.k = y.k and x.v < y.v)
select k, v, case when exists (select 1 from a where a.k = g.k and a.v <> g.v and abs(a.v - g.v) <= 0.5 + 1e-9) then 'rounding' when exists (select 1 from e where e.k = g.k and e.v = g.v) then 'other year'
when exists (select 1 from pairs p where p.k = g.k and abs(p.z - g.v) <= 0.5 + 1e-9) then 'computed' else 'invention' end kind from g""")
def deviation_typology(spark, sf):
    """Values that nothing supports, by the likeliest origin; computed ones over the six smallest authorised values."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), "o_orderkey", (F.col("o_totalprice") / 5000).alias("v"))
    of = lambda where, dec: o.where(where).select("k", F.round("v", dec).alias("v")).distinct().withColumn("writing", N.formatted(F.col("v"), dec))
    gaps = of("o_orderkey % 10 = 1", 0)
    kinds = G.deviation_kinds(gaps, of("o_orderkey % 1000 = 3", 1), of("o_orderkey % 100 = 2", 0), "k", 6)
    return gaps.join(kinds, ["k", "writing"]).select("k", "v", "kind")


@query("false_rejects", "with t as (select p_partkey k, round(p_retailprice, 0)::bigint v from part), s as (select k, v, case when k % 3 = 0 then v else v + 1 end w from t) select k, v = w and (k % 9 <> 0 or v >= 1000) false_reject from s")
def false_rejects(spark, sf):
    """A rejected price is looked for on its page in other spellings: grouped, decimal, or broken over two lines."""
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.round("p_retailprice", 0).cast("long").alias("v"))
    on_page = F.when(F.col("k") % 3 == 0, F.col("v")).otherwise(F.col("v") + 1)
    spelt = F.when(F.col("k") % 2 == 0, N.formatted(on_page.cast("double"), 0)).otherwise(F.concat(on_page.cast("string"), F.lit(",0")))
    broken = F.concat(F.left(on_page.cast("string"), F.lit(2)), F.lit("\n"), F.substr(on_page.cast("string"), F.lit(3)))
    page = t.select("k", F.concat(F.lit("Prix : "), F.when(F.col("k") % 9 == 0, broken).otherwise(spelt), F.lit(" francs")).alias("text"))
    return G.false_rejects(t.select("k", F.col("v").cast("string").alias("writing")), page, "k").select("k", "false_reject")


@query("tumbling_counts", "select date_trunc('hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def tumbling_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return SJ.counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sliding_counts", "select start, event_type, count(*) n from (select event_type, unnest([time_bucket(interval '15 minutes', ts) - interval '45 minutes', time_bucket(interval '15 minutes', ts) - interval '30 minutes', time_bucket(interval '15 minutes', ts) - interval '15 minutes', time_bucket(interval '15 minutes', ts)]) as start from events) group by all")
def sliding_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return SJ.counts(e, "1 hour", "15 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("session_counts", "with b as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval '30 minutes' then 0 else 1 end b from events), s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) s from b) select user_id, min(ts) as start, count(*) n from s group by user_id, s")
def session_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return SJ.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("rate_limited", """with e as (select event_id, user_id, epoch_us(ts) t from events), n as (select *, row_number() over (partition by user_id order by t, event_id) i from e),
f as (select *, max(t - (i - 1) * 1800000000) over (partition by user_id order by t, event_id rows between unbounded preceding and 1 preceding) + (i - 1) * 1800000000 full_ from n)
select event_id, user_id, (greatest(t, coalesce(full_ - 3600000000, t)) - t)::bigint wait_us from f""")
def rate_limited(spark, sf):
    """What each event waits if its user may send three at once and one each half hour."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return L.granted(e, "user_id", 1_800_000_000, 3).select("event_id", "user_id", (F.col("granted_at") - F.col("at")).alias("wait_us"))


@query("cache_hits", """with recursive e as (select event_id, user_id, epoch_us(ts) t from events), l as (select user_id, min(t) t from e group by 1 union all select user_id, n from (select l.user_id, (select min(e.t) from e where e.user_id = l.user_id and e.t >= l.t + 3600000000) n from l) where n is not null),
first_ as (select user_id, t, min(event_id) event_id from e join l using (user_id, t) group by 1, 2) select event_id, user_id, event_id not in (select event_id from first_) hit from e""")
def cache_hits(spark, sf):
    """Which events find what an earlier one of their user has loaded within the last hour."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return L.looked_up(e, "user_id", 3_600_000_000).select("event_id", "user_id", "hit")
