"""Structure out of text: a state machine over lines, tables with merged cells, damaged JSON, phrases in a full-text store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chiffra.functions import json as J
from chiffra.functions import text as T
from chiffra.operators import grids as G
from chiffra.operators import segments as S
from chiffra.plans.base import passages, query, table
from chiffra.sources import index as IX
from chiffra.sources.fulltext import TextStore

# A line of one or two words titles a chapter, one of three a section; a longer one that opens with a word of at most two
# letters captions a chart, and one with an address names a source.
_KIND = "case when length(trim(line)) = 0 then 'blank' when k <= 2 then 'chapter' when k = 3 then 'section' when contains(line, '@') then 'source' when length(w) <= 2 then 'chart' else 'text' end"


@query("line_states", f"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 n from documents),
k as (select *, len(regexp_extract_all(line, '[^ ]+')) k, regexp_extract(line, '[^ ]+') w from l), s as (select doc_id, n, {_KIND} symbol from k),
c as (select *, max(case when symbol = 'chapter' then n end) over w chapter from s window w as (partition by doc_id order by n)),
x as (select *, max(case when symbol = 'section' and chapter is not null then n end) over w sec, max(case when symbol = 'chart' and chapter is not null then n end) over w cht, max(case when symbol in ('chapter', 'section', 'source', 'blank') then n end) over w cut from c window w as (partition by doc_id order by n))
select doc_id, n::bigint n, case when chapter is null then 'front' when cht > coalesce(cut, -1) then 'chart' else 'chapter' end state, chapter::bigint chapter,
case when sec > chapter then sec end::bigint as section, case when cht > coalesce(cut, -1) then cht end::bigint chart from x""")
def line_states(spark, sf):
    """State, chapter, section and owning chart of every line; documents are cut to blocks of lines of their own tasks."""
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.withColumn("k", F.regexp_count("line", F.lit("[^ ]+"))).withColumn("w", F.regexp_extract("line", "[^ ]+", 0))
    return S.scan(lines.select("doc_id", "n", F.expr(_KIND).alias("symbol")), "doc_id", S.DOCUMENT)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("html_table_values", """with c as (select r_regionkey page_id, n_name, c_mktsegment seg, count(*) n, sum(round(c_acctbal * 100)::bigint) cents from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3)
select page_id, n_name || ' / ' || measure as label, 'Segments de clientèle · ' || seg as "column", (case measure when 'effectif' then n else cents end)::varchar as text from c, (select unnest(['effectif', 'centimes']) measure)""")
def html_table_values(spark, sf):
    """A page a region with a table of two header rows and two label columns, whose cells span rows and columns, read back."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    per = c.groupBy("n_regionkey", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    per = per.groupBy("n_regionkey", "n_name").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", F.struct("n", "cents")))).alias("m"))
    td = lambda name: F.concat(*[F.concat(F.lit("<td>"), F.coalesce(F.try_element_at("m", F.lit(s))[name].cast("string"), F.lit("")), F.lit("</td>")) for s in _SEGMENTS])
    row = F.concat(F.lit("<tr><td rowspan=2>"), "n_name", F.lit("</td><td>effectif</td>"), td("n"), F.lit("</tr>\n<tr><td>centimes</td>"), td("cents"), F.lit("</tr>"))
    head = "<p>Clients</p><table class=t><tr><th colspan='2' rowspan=\"2\">Pays</th><th colspan=5><b>Segments de client&egrave;le</b></th></tr><tr>".replace("&egrave;", "è") + "".join(f"<th>{s}</th>" for s in _SEGMENTS) + "</tr>"
    pages = per.groupBy(F.col("n_regionkey").alias("page_id")).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(row)), "\n"), F.lit("</table>")).alias("html"))
    return G.values(G.html_tables(pages), ["page_id", "table_no"]).select("page_id", "label", "column", "text")


@query("damaged_json", """with e as (select event_id, event_type t, json_extract(props, '$.k')::bigint k from events)
select event_id, case when t = 'purchase' then null else k end k, case t when 'error' then 2 when 'signup' then 1 end::int n_items from e""")
def damaged_json(spark, sf):
    """Properties behind a fence, in noise with brackets of its own, as a list, as an object's list, and cut off: what is read."""
    p, t = F.col("props"), F.col("event_type")
    raw = (
        F.when(t == "click", F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(t == "view", F.concat(F.lit("Voici { : "), p, F.lit(" fin } ]")))
        .when(t == "error", F.concat(F.lit("["), p, F.lit(", "), p, F.lit("]")))
        .when(t == "signup", F.concat(F.lit('Réponse : {"items": ['), p, F.lit('], "note": "}{"} merci.')))
        .when(t == "purchase", F.concat(F.lit("{"), p).substr(F.lit(1), F.length(p)))
        .otherwise(p)
    )
    e = table(spark, sf, "events").select("event_id", J.lenient(raw).alias("v")).withColumn("items", J.listed(F.col("v"), "items", "k long"))
    one = F.when(~J.is_list(F.col("v")), F.try_variant_get("v", "$.k", "long"))
    return e.select("event_id", F.coalesce(one, F.get("items", F.lit(0))["k"]).alias("k"), F.when(F.col("items").isNotNull(), F.size("items")).alias("n_items"))


def store(spark, sf) -> TextStore:
    """The documents in a full-text store, built at its first use."""

    def build(rows, path):
        out = TextStore(spark, path)
        out.add(rows)
        return out

    return IX.session_index(passages(spark, sf), f"{sf}/documents", build, "fulltext")


def _phrases(spark, sf, at: int, n: int):
    """``n`` words of each item from its ``at``-th on."""
    w = F.regexp_extract_all(T.normalised(F.col("text")), F.lit("[a-z0-9]+"), 0)
    return table(spark, sf, "benchmark").withColumn("w", w).where(F.size("w") >= at + n - 1).select(F.col("item_id").alias("qid"), F.array_join(F.slice("w", at, n), " ").alias("text"))


_W = f"regexp_extract_all({T.normalised_sql('text')}, '[a-z0-9]+')"
_ASK = lambda at, n: f"a as (select item_id qid, {_W}[{at}:{at + n - 1}] p from benchmark where len({_W}) >= {at + n - 1})"


@query("phrase_search", f"""with {_ASK(3, 2)}, d as (select doc_id id, {_W} w from documents),
i as (select qid, id, len(list_filter(range(1, len(w)), lambda i: w[i] = p[1] and w[i + 1] = p[2])) n from a, d where list_contains(w, p[1])) select qid, id, n::int n from i where n > 0""")
def phrase_search(spark, sf):
    """Documents in which the third and fourth word of an item stand one after the other, and how often."""
    return store(spark, sf).phrases(_phrases(spark, sf, 3, 2))


@query("proximity_search", f"""with {_ASK(2, 2)}, d as (select doc_id id, {_W} w from documents), o as (select id, unnest(w) w, generate_subscripts(w, 1) pos from d),
x as (select qid, l.id, min(abs(l.pos - r.pos)) + 1 span from a join o l on l.w = p[1] join o r on r.w = p[2] and r.id = l.id group by 1, 2) select qid, id, span::int span from x where span <= 8""")
def proximity_search(spark, sf):
    """Documents in which the second and third word of an item stand within eight words of one another, in any order."""
    return store(spark, sf).near(_phrases(spark, sf, 2, 2), 8)


@query("store_updates", f"""with {_ASK(3, 2)}, d as (select doc_id id, case when source = 'src1' then 'revu et ' || coalesce(text, '') else text end as text from documents where doc_id not in (select doc_id from labels where toxic = 1)), w as (select id, {_W} w from d),
i as (select qid, id, len(list_filter(range(1, len(w)), lambda i: w[i] = p[1] and w[i + 1] = p[2])) n from a, w where list_contains(w, p[1])), q as (select id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'revu' and w[i + 1] = 'et')) n from w)
select qid, id, n::int n from i where n > 0 union all select -1, id, n::int from q where n > 0""")
def store_updates(spark, sf):
    """The same search after one source has been revised and the internal documents deleted: half of the hits from three
    segments, and again from the merged one."""
    s = TextStore(spark, f"{IX.shared_folder(spark)}/chiffra-fulltext-{uuid.uuid4().hex}")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    s.add(d.select("id", "text"))
    s.add(d.where("source = 'src1'").select("id", F.concat(F.lit("revu et "), F.coalesce("text", F.lit(""))).alias("text")))
    s.delete(table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))
    three = IX.kept(s.phrases(_phrases(spark, sf, 3, 2)), "store-hits")
    s.merge()
    return three.unionByName(s.phrases(spark.createDataFrame([(-1, "revu et")], "qid long, text string")))
