"""Queries over pairings, contexts, notes and their evaluation, on the fact tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chiffra.functions import numbers as N
from chiffra.functions import text as T
from chiffra.operators import answers as AN
from chiffra.operators import assembly as A
from chiffra.operators import notes as NO
from chiffra.operators import series as S
from chiffra.plans import notes as PN
from chiffra.plans.base import passages, query, r6, table

# Pairings: an order pairs an indicator (its customer's segment) with a table (its number by 50) in an edition (its year).
_PAIRS = """pairs as (select c_mktsegment code, year(o_orderdate)::int ed, (o_orderkey % 50)::int tab, case when o_orderstatus = 'F' and year(o_orderdate) < 1996 then 'valid' when o_orderkey % 5 = 0 then 'rejected' else 'candidate' end status, round(o_totalprice / 1000, 1) score, o_orderkey k from orders join customer on c_custkey = o_custkey)"""


def pairings(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    status = F.when((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") < 1996), "valid").when(F.col("o_orderkey") % 5 == 0, "rejected").otherwise("candidate")
    return o.select(F.col("c_mktsegment").alias("code"), F.year("o_orderdate").alias("edition"), (F.col("o_orderkey") % 50).cast("int").alias("table"), status.alias("status"), F.round(F.col("o_totalprice") / 1000, 1).alias("score"), F.col("o_orderkey").alias("k"))


@query("usable_pairings", f"with {_PAIRS}, v as (select ed, bool_or(status = 'valid') v from pairs group by 1) select ed edition, status, not v provisional, count(*) n from pairs join v using (ed) where status = case when v then 'valid' else 'candidate' end group by 1, 2, 3")
def usable_pairings(spark, sf):
    """Editions with validated pairings use those, others their candidates, provisionally."""
    return A.usable_pairings(pairings(spark, sf)).groupBy("edition", "status", "provisional").agg(F.count(F.lit(1)).alias("n"))


@query("code_of_table", f"with {_PAIRS}, t as (select distinct ed, tab + 25 tab from pairs), b as (select ed, tab, code from pairs where status in ('valid', 'candidate') qualify row_number() over (partition by ed, tab order by (status = 'valid') desc, score desc, code desc) = 1) select ed edition, tab as \"table\", coalesce(code, 'tableau-' || tab) code from t left join b using (ed, tab)")
def code_of_table(spark, sf):
    p = pairings(spark, sf)
    return A.code_of_table(p, p.select("edition", (F.col("table") + 25).alias("table")).distinct()).select("edition", "table", "code")


@query("pairing_comments", f"with {_PAIRS} select k, status, n_chars from pairs left join documents on doc_id = k")
def pairing_comments(spark, sf):
    """Pairings with the published comment, where there is one."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("passage_id"), F.col("n_chars").alias("text"))
    return A.with_comments(pairings(spark, sf).withColumn("comment_id", F.col("k")), d).select("k", "status", F.col("comment").alias("n_chars"))


@query("earlier_values", """with p as (select distinct c_mktsegment code, year(o_orderdate)::int ed, (o_orderkey % 7)::int doc, (o_orderkey % 4)::int tab from orders join customer on c_custkey = o_custkey where o_orderkey % 50 = 1), v as (select l_orderkey * 10 + l_linenumber id, (l_partkey % 7)::int doc, (l_suppkey % 4)::int tab from lineitem where l_orderkey % 100 = 1)
select e.code, e.ed edition, count(*) n, min(p.ed) first_edition, max(id) last_id from (select distinct code, ed from p) e join p on p.code = e.code and p.ed < e.ed join v using (doc, tab) group by 1, 2""")
def earlier_values(spark, sf):
    """Values of an indicator's tables in editions before each."""
    o = table(spark, sf, "orders").where("o_orderkey % 50 = 1").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    p = o.select(F.col("c_mktsegment").alias("code"), F.year("o_orderdate").alias("edition"), (F.col("o_orderkey") % 7).cast("int").alias("doc_id"), (F.col("o_orderkey") % 4).cast("int").alias("table")).distinct()
    v = table(spark, sf, "lineitem").where("l_orderkey % 100 = 1").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("value_id"), (F.col("l_partkey") % 7).cast("int").alias("doc_id"), (F.col("l_suppkey") % 4).cast("int").alias("table"))
    return A.earlier_values(p, v).groupBy("code", "edition").agg(F.count(F.lit(1)).alias("n"), F.min("value_edition").alias("first_edition"), F.max("value_id").alias("last_id"))


@query("prioritised_values", f"with {PN._CELLS}, id as (select *, row_number() over (order by ind, r, y)::bigint id from c), v as (select i.ind, e.ed, i.r, case when i.y = 1993 then null else i.y end y, i.id from id i, (select unnest([1996, 1997]) ed) e) select ind indicator, ed edition, id value_id, row_number() over (partition by ind, ed order by case when ed - y = 0 then 0 when ed - y = 1 then 1 when y is null then 2 else 3 end, case when lower(r) like 'total%' then 0 else 1 end, id)::int priority from v")
def prioritised_values(spark, sf):
    """Values of a context in order: this edition's, the last one's, undated ones, others; totals first."""
    e = spark.createDataFrame([(1996,), (1997,)], "edition int")
    v = PN.cells(spark, sf).crossJoin(F.broadcast(e)).withColumn("year", F.when(F.col("year") != 1993, F.col("year")))
    return A.prioritised(v, ["indicator", "edition"]).select("indicator", "edition", "value_id", "priority")


@query("indicator_context", f"""with {PN._CELLS}, id as (select *, row_number() over (order by ind, r, y)::bigint id from c),
v as (select ind, r, y, id, {PN._FR('v', 0)} w, row_number() over (partition by ind order by case when y = 1996 then 0 when y = 1995 then 1 else 3 end, case when r = 'Total' then 0 else 1 end, id) k from id where y <= 1996),
va as (select ind, string_agg('- ' || r || ' | ' || y || ' = ' || w, chr(10) order by k) t from v where k <= 8 group by 1),
d as (select a.ind, a.r, b.y ry, round(100 * (a.v - b.v) / nullif(b.v, 0), 1) rel, row_number() over (partition by a.ind order by b.y desc, case when a.r = 'Total' then 0 else 1 end, a.r) k from c a join c b on a.ind = b.ind and a.r = b.r and b.y < a.y where a.y = 1996),
da as (select ind, string_agg('- ' || r || ' depuis ' || ry || ' : ' || case when rel < 0 and round(rel, 1) <> 0 then '-' else '' end || {PN._FR('rel', 1)}, chr(10) order by k) t from d where k <= 8 group by 1)
select ind indicator, 'Valeurs' || chr(10) || va.t || chr(10) || chr(10) || 'Variations' || chr(10) || da.t || chr(10) || chr(10) || 'Modèles' || chr(10) || '- Commentaire de ' || ind as text from va join da using (ind)""")
def indicator_context(spark, sf):
    """The context of each indicator in 1996 as it would be put before a writer: values, variations, an earlier comment."""
    c = PN.cells(spark, sf)
    v = c.where("year <= 1996").withColumn("edition", F.lit(1996)).withColumn("writing", N.formatted(F.col("value"), 0))
    d = NO.changes_of(c, ["indicator"]).where("year = 1996").select("indicator", F.lit(1996).alias("edition"), "row", "ref_year", N.formatted(F.col("var_rel"), 1).alias("change"))
    m = c.select("indicator").distinct().select("indicator", F.lit(1996).alias("edition"), F.lit(1995).alias("from_edition"), F.concat(F.lit("Commentaire de "), "indicator").alias("text"))
    return A.context(v, d, m, ["indicator", "edition"], 8).select("indicator", "text")


@query("magnitude_evolutions", """with s as (select n_regionkey rep, p_brand nm, s_name code, round(avg(abs(l_discount - 0.05) * l_quantity), 4) score from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by all),
ref as (select rep, nm, min(code) code from s group by 1, 2 having count(*) % 2 = 0), one as (select s.* from s left join ref using (rep, nm) qualify row_number() over (partition by s.rep, s.nm order by (s.code = ref.code) desc nulls last, round(s.score, 6) desc, s.code) = 1)
select rep, nm as name, code, row_number() over (partition by rep order by round(score, 6) desc, code)::int rank from one qualify rank <= 7""")
def magnitude_evolutions(spark, sf):
    """One evolution a magnitude: its reference indicator's, else the most salient; seven a report."""
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    s = x.groupBy(F.col("n_regionkey").alias("rep"), F.col("p_brand").alias("name"), F.col("s_name").alias("code")).agg(F.round(F.avg(F.abs(F.col("l_discount") - 0.05) * F.col("l_quantity")), 4).alias("score"))
    ref = s.groupBy("rep", "name").agg(F.min("code").alias("code"), F.count(F.lit(1)).alias("n")).where("n % 2 = 0").drop("n")
    return A.best_of_magnitude(s, ref, ["rep"]).select("rep", "name", "code", "rank")


@query("note_checks", f"""with {PN._CELLS}, said as ({PN._SAID}), st as (select *, indicator || "year" note, case "position" when 0 then 'findings' when 5 then 'leads' else 'messages' end section from said),
src as (select ind || y note, {PN._FR('v', 0)} w from c union select a.ind || a.y, {PN._FR('round(100 * (a.v - b.v) / nullif(b.v, 0), 1)', 1)} from c a join c b on a.ind = b.ind and a.r = b.r and b.y = a.y - 1),
nums as (select note, unnest({PN._NUMBERS}) w from st where section <> 'leads'), bad as (select note, count(*) filter (not exists (select 1 from src where src.note = nums.note and src.w = nums.w)) untraced from nums group by 1)
select note, coalesce(untraced, 0) untraced, coalesce(untraced, 0) = 0 all_traced, count(*) filter (section = 'messages') = 3 three_messages, sum(len(regexp_extract_all(text, '\\S+'))) <= 70 length_ok, sum(len(regexp_extract_all(text, '\\S+')))::bigint n_words from st left join bad using (note) group by note, untraced""")
def note_checks(spark, sf):
    """What can be verified of a note by itself; its sources are the year's cells and changes from the year before."""
    c = PN.cells(spark, sf)
    note = F.concat("indicator", F.col("year").cast("string"))
    said = NO.commentary(c, ["indicator"]).withColumn("note", note).withColumn("statement_id", F.xxhash64("indicator", "year", "position"))
    said = said.withColumn("section", F.when(F.col("position") == 0, "findings").when(F.col("position") == 5, "leads").otherwise("messages"))
    v = NO.changes_of(c, ["indicator"]).where("ref_year = year - 1").select(note.alias("note"), N.formatted(F.abs("var_rel"), 1).alias("writing"))
    src = c.select(note.alias("note"), N.formatted(F.col("value"), 0).alias("writing")).unionByName(v)
    return A.note_checks(said, src, "note", most_words=70, years=(1990, 1999))


# A note for each year: a chapter of the segments whose name begins in A to F, one of the others; a section a segment.
_NOTE = f"{PN._CELLS}, said as ({PN._SAID}), com as (select \"year\" y, indicator ind, string_agg(text, ' ' order by \"position\") t from said group by 1, 2), pl as (select y, ind, case when ind < 'G' then 'CHAPITRE I : A À F' else 'CHAPITRE II : LES AUTRES' end ch, row_number() over (partition by y order by ind) p from (select distinct y, ind from c))"


def outlined(spark, sf):
    c = PN.cells(spark, sf)
    com = NO.commentary(c, ["indicator"]).groupBy("indicator", "year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), " ").alias("text"))
    pos = F.row_number().over(Window.partitionBy("note_id").orderBy("indicator"))
    s = com.withColumn("note_id", F.col("year")).withColumn("position", pos).withColumn("chapter", F.when(F.col("indicator") < "G", "CHAPITRE I : A À F").otherwise("CHAPITRE II : LES AUTRES"))
    return A.outline(s.withColumn("section", F.concat(F.col("position").cast("string"), F.lit(". "), "indicator")).withColumn("table", F.col("position")))


@query("report_outline", f"with {_NOTE} select y note_id, p::int as \"position\", case when ind < 'G' then 1 else (select count(distinct ch) from pl x where x.y = pl.y and x.p <= pl.p) end::bigint chapter_no, p::bigint section_no, ind title, case when ind < 'G' then 'Chapitre I — A à f' else 'Chapitre II — Les autres' end chapter from pl")
def report_outline(spark, sf):
    """Chapters, sections and their titles in the order of the note."""
    o = outlined(spark, sf)
    return o.select("note_id", "position", "chapter_no", "section_no", A.section_title(F.col("section")).alias("title"), A.chapter_title(F.col("chapter")).alias("chapter"))


@query("key_findings", rf"""with {_NOTE}, xx as (select y, p, ind, regexp_extract(t, 's''établit à ([0-9][0-9 ,]*)', 1) lv, regexp_extract(t, '(progresse|recule) de ([0-9 ,]+) %', 1) vb, regexp_extract(t, '(progresse|recule) de ([0-9 ,]+) %', 2) b from pl join com using (y, ind))
select y note_id, p::bigint section_no, ind || ' : ' || lv || ', ' || case vb when 'progresse' then 'en hausse de ' else 'en baisse de ' end || b || ' % (tableau ' || p || ').' finding from xx where lv <> '' and vb <> ''""")
def key_findings(spark, sf):
    """Level and change of each section's first table that states both."""
    o = outlined(spark, sf).withColumn("section", A.section_title(F.col("section")))
    return A.key_findings(o)


@query("key_figures", f"with {PN._CELLS} select ind indicator, y as \"year\", upper(left('le ' || lower(ind), 1)) || substr('le ' || lower(ind), 2) || ' : ' || {PN._FR('v', 0)} || case when rel is null then '' else ' (' || case when rel > 0 then '+' when rel < 0 then '−' else '' end || {PN._FR('rel', 1)} || ' %)' end as text from t")
def key_figures(spark, sf):
    """The box of figures: each total, and its change from the year before."""
    c = S.successive(PN.cells(spark, sf).where("row = 'Total'"), ["indicator"])
    w = Window.partitionBy("indicator").orderBy("year")
    c = c.withColumn("change", F.when(F.lag("year").over(w) == F.col("year") - 1, F.round("change", 1))).withColumn("name", F.concat(F.lit("le "), F.lower("indicator")))
    return A.key_figures(c).select("indicator", "year", "text")


@query("note_plan", f"with {_NOTE}, q as (select *, (p * 3 + y) % 4 tab from pl) select y note_id, tab as \"table\", a.p::int first_position, coalesce(md5(t), '-') digest, case when t is null then 'no usable value' end reason from (select y, tab, min(p) p from q group by 1, 2) a left join (select y, tab, string_agg(t, ' ' order by p) t from q join com using (y, ind) where p <> 2 group by 1, 2) b using (y, tab)")
def note_plan(spark, sf):
    """A table once, at its first place in the plan, with its commentary or the reason it has none."""
    o = outlined(spark, sf).withColumn("key", F.col("note_id") * 10 + (F.col("position") * 3 + F.col("note_id")) % 4)
    out = A.note_plan(o.where("position <> 2").select(F.col("key").alias("table"), "position", "text"), o.select(F.col("key").alias("table"), "position", "note_id"))
    return out.select("note_id", (F.col("table") % 10).cast("long").alias("table"), F.col("position").alias("first_position"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-")).alias("digest"), "reason")


@query("arm_medians", "with t as (select case when event_id % 2 = 0 then 'with' else 'without' end arm, value v from events where event_type <> 'click') select count(*) filter (arm = 'with') n_with, count(*) filter (arm = 'without') n_without, round(quantile_cont(v, 0.5) filter (arm = 'with'), 2) median_with, round(quantile_cont(v, 0.5) filter (arm = 'without'), 2) median_without, round(1 - quantile_cont(v, 0.5) filter (arm = 'with') / nullif(quantile_cont(v, 0.5) filter (arm = 'without'), 0), 4) reduction from t")
def arm_medians(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'click'")
    return A.arm_medians(e.select(F.when(F.col("event_id") % 2 == 0, "with").otherwise("without").alias("arm"), F.col("value").alias("minutes")))


@query("criteria_met", "with g as (select l_orderkey k, l_linenumber c, l_quantity a, case when l_suppkey % 9 > 0 then l_quantity / 2 + l_linenumber end b from lineitem) select k note_id, count(*) filter ((a + b) / 2 >= 20) met, count(*) filter ((a + b) / 2 >= 20) >= 2 compliant from g where a is not null and b is not null group by 1")
def criteria_met(spark, sf):
    """Criteria that two readers find met, and compliant notes: two criteria at least."""
    g = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("criterion"), F.col("l_quantity").alias("a"), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_quantity") / 2 + F.col("l_linenumber")).alias("b"))
    return A.criteria_met(g, 20, 2)


@query("distinct_tables", "select l_orderkey doc, count(distinct coalesce(nullif(l_linenumber % 3, 0)::varchar, 'p' || l_linenumber)) n_tables from lineitem group by 1")
def distinct_tables(spark, sf):
    """Distinct tables of a document; an unnumbered table counts by its page."""
    number = F.nullif(F.col("l_linenumber") % 3, F.lit(0)).cast("string")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.count_distinct(F.coalesce(number, F.concat(F.lit("p"), F.col("l_linenumber").cast("string")))).alias("n_tables"))


@query("model_comparison", "select event_type model, round(quantile_cont(value, 0.5), 4) median_s, round(count(*) filter (json_valid(props) and json_extract(props, '$.k') is not null) / count(*)::double, 4) valid_json, round(count(*) filter (value > 100) / nullif(count(*) filter (value > 50), 0)::double, 4) discarded, count(*) filter (value is null) failures from events group by 1")
def model_comparison(spark, sf):
    """Per model: median time, share of valid answers, discarded values of those cited, failures."""
    ok = F.get_json_object("props", "$.k").isNotNull()
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.round(F.percentile("value", 0.5), 4).alias("median_s"), F.round(F.count_if(ok) / F.count(F.lit(1)), 4).alias("valid_json"),
        F.round(F.count_if(F.col("value") > 100) / F.nullif(F.count_if(F.col("value") > 50).cast("double"), F.lit(0.0)), 4).alias("discarded"), F.count_if(F.col("value").isNull()).alias("failures"),
    )


@query("twice_read", "select conv_id, count(distinct lower(trim(role))) readers from conversations group by 1 having count(distinct lower(trim(role))) >= 2")
def twice_read(spark, sf):
    """Charts that two different readers at least have read."""
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_distinct(F.lower(F.trim("role"))).alias("readers")).where("readers >= 2")


@query("typology_counts", "select o_orderstatus action, count(*) filter (o_orderpriority = '1-URGENT') urgent, count(*) filter (o_orderpriority = '5-LOW') low, count(*) filter (o_orderpriority not in ('1-URGENT', '5-LOW')) other from orders group by 1")
def typology_counts(spark, sf):
    """Counts of kinds side by side."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("other")
    return table(spark, sf, "orders").withColumn("kind", kind).groupBy(F.col("o_orderstatus").alias("action")).pivot("kind", ["urgent", "low", "other"]).agg(F.count(F.lit(1))).na.fill(0)


@query("chapters", "with p as (select doc_id, source, lang, n_chars from documents) select source, 'CHAPITRE ' || lang chapter, min(n_chars) first_page from p where 'CHAPITRE ' || lang ilike 'chapitre%' and regexp_matches('CHAPITRE ' || lang, '(?i) (fr|de)$') group by 1, 2")
def chapters(spark, sf):
    """Chapters by the page on which they begin, those whose name fits a pattern."""
    p = table(spark, sf, "documents").withColumn("chapter", F.concat(F.lit("CHAPITRE "), "lang"))
    return p.where(F.col("chapter").ilike("chapitre%") & F.col("chapter").rlike("(?i) (fr|de)$")).groupBy("source", "chapter").agg(F.min("n_chars").alias("first_page"))


@query("variation_texts", f"""with {PN._CELLS}, w0 as (select ind, r, y, v / case when y % 2 = 0 then 10 else 100 end v, case when y % 2 = 0 then 1 else 2 end d from c), w1 as (select *, round(v, d) x from w0)
select a.ind indicator, a.r as "row", a.y as "year", b.y ref_year, round(a.x - b.x, greatest(a.d, b.d)) var_abs, case when round(a.x - b.x, 2) < 0 then '-' else '' end || case when greatest(a.d, b.d) = 1 then {PN._FR('a.x - b.x', 1)} else {PN._FR('a.x - b.x', 2)} end abs_text, round(100 * (a.x - b.x) / nullif(b.x, 0), 1) var_rel from w1 a join w1 b on a.ind = b.ind and a.r = b.r and b.y < a.y""")
def variation_texts(spark, sf):
    """Changes with as many decimals as the writings of the two cells have, and their own writing."""
    c = PN.cells(spark, sf)
    d = F.when(F.col("year") % 2 == 0, 1).otherwise(2)
    c = c.withColumn("writing", F.when(F.col("year") % 2 == 0, N.formatted(F.col("value") / 10, 1)).otherwise(N.formatted(F.col("value") / 100, 2)))
    c = c.withColumn("value", F.when(d == 1, F.round(F.col("value") / 10, 1)).otherwise(F.round(F.col("value") / 100, 2)))
    return S.variations_of_writings(c, ["indicator", "row"]).select("indicator", "row", "year", "ref_year", "var_abs", "abs_text", "var_rel")


@query("objective_saliency", """with m as (select o_orderpriority p, date_trunc('month', o_orderdate) mo, round(sum(o_totalprice), 0) v from orders group by all), ch as (select * from (select p, mo, 100 * (v - lag(v) over w) / nullif(lag(v) over w, 0) change from m window w as (partition by p order by mo)) where change is not null),
h as (select p, mo, change, count(change) over w n, stddev_pop(change) over w sd from ch window w as (partition by p order by mo rows between unbounded preceding and 1 preceding))
select p, strftime(mo, '%Y-%m') as "month", round(case when n >= 3 and sd > 0 then abs(change) / sd else abs(change) end + case when p = '1-URGENT' then 1 else 0 end, 4) score from h""")
def objective_saliency(spark, sf):
    """Saliency with a point more for what a documented objective names."""
    from chiffra.plans.figures import month_changes

    s = S.saliency(month_changes(spark, sf), ["p"], "month", bonus=F.when(F.col("p") == "1-URGENT", 1.0).otherwise(0.0))
    return s.select("p", "month", F.round("score", 4).alias("score"))


@query("dominant_year", """with y as (select l_orderkey k, year(l_shipdate)::int y, 1 n from lineitem union all select o_orderkey, (year(o_orderdate) + o_orderkey % 2)::int, 6 from orders where o_orderkey % 3 = 0)
select k doc, y as "year", sum(n)::bigint weight from y group by 1, 2 qualify row_number() over (partition by k order by sum(n) desc, y desc) = 1""")
def dominant_year(spark, sf):
    """The year a text is about: mentions, five more for each "exercice" before a year, the latest on ties."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_join(F.collect_list(F.year("l_shipdate").cast("string")), ", ").alias("t"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Exercice "), (F.year("o_orderdate") + F.col("o_orderkey") % 2).cast("int").cast("string"), F.lit(". "))).alias("head"))
    d = o.join(lines, "doc", "full_outer").select("doc", F.concat_ws("", "head", "t").alias("text"))
    return T.dominant_year(d, "doc", "text").select("doc", "year", "weight")


@query("informativeness", f"""with w as (select doc_id, regexp_extract_all({T.normalised_sql('text')}, '[a-z0-9]+') w from documents), r as (select doc_id, len(w) n, len(list_filter(w, lambda x: x in ({", ".join(f"'{x}'" for x in T.STOP_WORDS)}))) / nullif(len(w), 0)::double f, len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]{{3,}}$'))) / nullif(len(w), 0)::double d from w)
select doc_id, round(case when n = 0 then 0.15 else greatest(0.15, least(1, greatest(0, (f - 0.20) / 0.22)), least(1, greatest(0, (d - 0.05) / 0.13))) end, 6)::double score from r""")
def informativeness(spark, sf):
    """Prose by its share of function words, tables by their share of real numbers, neither: the least."""
    return table(spark, sf, "documents").select("doc_id", r6(T.informativeness(F.col("text")), "score"))


@query("themed_sheet", r"""with s as (select conv_id theme, role q, turn rk, text || case when turn % 2 = 0 then ' : ' || length(text) || ' cas' else '' end sentence from conversations), o as (select *, row_number() over (partition by theme, lower(left(sentence, 80)) order by q, rk) n from s where rk % 2 = 0 or regexp_matches(sentence, '[0-9]'))
select theme, q as query, row_number() over (partition by theme, q order by rk)::int rank, md5(sentence) digest from o where n = 1 qualify rank <= 2""")
def themed_sheet(spark, sf):
    """Sentences with figures by theme, none twice, two a query."""
    c = table(spark, sf, "conversations")
    s = c.select(F.col("conv_id").alias("theme"), F.col("role").alias("query"), F.col("turn").alias("rank"), F.concat("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" : "), F.length("text").cast("string"), F.lit(" cas"))).otherwise("")).alias("sentence"))
    return A.themed_sheet(s, 2).select("theme", "query", "rank", F.md5(F.col("sentence").cast("binary")).alias("digest"))


@query("title_pairing", f"""with c as (select p_partkey k, p_size ed, {T.token_set_sql("p_name || ' ' || p_type")} s from part where p_partkey % 20 = 1), t as (select p_partkey k, p_size ed, {T.token_set_sql("p_name || ' ' || p_type")} s from part where p_partkey % 20 > 1)
select c.k chart, t.k as "table", round({T.jaccard_sql('c.s', 't.s')}, 6) score from c join t using (ed) where {T.jaccard_sql('c.s', 't.s')} >= 0.25 qualify row_number() over (partition by c.k order by round({T.jaccard_sql('c.s', 't.s')}, 9) desc, t.k desc) = 1""")
def title_pairing(spark, sf):
    """Charts with the table of their edition whose title is most alike. A title is the set of its words, each behind its edition,
    so titles of different editions have nothing in common; equal titles are one, of tables that with the last number."""
    word = F.transform(T.token_set(F.concat_ws(" ", "p_name", "p_type")), lambda w: F.concat(F.col("p_size").cast("string"), F.lit(" "), w))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.array_sort(word).alias("s"))
    c, t = p.where("k % 20 = 1"), p.where("k % 20 > 1").groupBy("s").agg(F.max("k").alias("b"))
    both = AN.similar_sets(c.groupBy("s").agg(F.min("k").alias("a")), t, 0.25)
    best = both.groupBy("a").agg(F.max_by(F.struct(F.col("b").alias("table"), F.col("sim").alias("score")), F.struct(F.round("sim", 9), "b")).alias("b"))
    first = c.groupBy("s").agg(F.min("k").alias("a"))
    return c.join(first, "s").join(best, "a").select(F.col("k").alias("chart"), "b.table", r6("b.score", "score"))


@query("overfetched_search", "select qid, id, rank from (select qid, id, row_number() over (partition by qid order by rank)::int rank from (select a.vec_id qid, b.vec_id id, b.label, row_number() over (partition by a.vec_id order by round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) rank from embeddings a, embeddings b where a.vec_id % 20 = 0) where rank <= 20 and label <> 3) where rank <= 5")
def overfetched_search(spark, sf):
    """Filtering after ranking, four times as many hits fetched: what an index without a filter would give."""
    from chiffra.operators import retrieval as R
    from chiffra.plans.retrieval import vector_queries, vectors

    v = vectors(spark, sf)
    hits = R.dense_top_k(v, vector_queries(spark, sf), 20).join(v.select("id", "label"), "id").where("label <> 3")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("rank <= 5").select("qid", "id", "rank")


@query("section_search", f"with t as (select doc_id id, {T.tokens_sql('source || chr(10) || text')} t from documents) select id, len(t) n_tokens, md5(array_to_string(t, ' ')) digest from t")
def section_search(spark, sf):
    """The text that is indexed: a passage's section and the passage."""
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.concat_ws("\n", "source", "text")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("set_operations", "with a as (select l_suppkey % 50 x, l_linenumber y from lineitem where l_orderkey % 2 = 0), b as (select l_suppkey % 50 x, l_linenumber y from lineitem where l_orderkey % 3 = 0) select 'except' op, count(*) n from (select * from a except all select * from b) union all select 'intersect', count(*) from (select * from a intersect all select * from b) union all select 'union', count(*) from (select * from a union all select * from b) union all select 'missing', count(*) from (select distinct x from a where not exists (select 1 from b where b.x = a.x and b.y = 7))")
def set_operations(spark, sf):
    """Bags compared: what one has more of, what both have, both together, and the elements that lack a partner."""
    l = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("x"), F.col("l_linenumber").alias("y"), "l_orderkey")  # noqa: E741
    a, b = l.where("l_orderkey % 2 = 0").select("x", "y"), l.where("l_orderkey % 3 = 0").select("x", "y")
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return count(a.exceptAll(b), "except").unionByName(count(a.intersectAll(b), "intersect")).unionByName(count(a.unionByName(b), "union")).unionByName(count(a.select("x").distinct().join(b.where("y = 7"), "x", "left_anti"), "missing"))
