"""Commentary, its guard, consultation and explorer queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chiffra.functions import text as T
from chiffra.operators import assembly as A
from chiffra.operators import guard as G
from chiffra.operators import notes as O
from chiffra.operators import retrieval as R
from chiffra.operators import series as S
from chiffra.plans import retrieval as PR
from chiffra.plans.base import passages, query, table
from chiffra.sources import index as IX


def cells(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    o = o.select(F.col("c_mktsegment").alias("indicator"), F.substr("o_orderpriority", F.lit(3)).alias("row"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") / 1000).alias("v"))
    g = o.unionByName(o.withColumn("row", F.lit("Total"))).groupBy("indicator", "row", "year").agg(F.round(F.sum("v"), 0).alias("value"))
    g = g.withColumn("title", F.concat(F.lit("Commandes du segment "), "indicator", F.lit(" par priorité (en milliers)")))
    return g.withColumn("value_id", F.row_number().over(Window.orderBy("indicator", "row", "year")).cast("long"))  # a table of a few hundred cells


_FR = lambda x, d: f"translate(format('{{:,.{d}f}}', abs({x})), ',.', ' ,')"
_CELLS = """b as (select c_mktsegment ind, substr(o_orderpriority, 3) r, year(o_orderdate)::int y, o_totalprice / 1000 v from orders join customer on c_custkey = o_custkey),
c as (select ind, r, y, round(sum(v), 0) v from (select * from b union all select ind, 'Total', y, v from b) group by all),
w as (select *, lag(y) over k py, lag(v) over k pv, first_value(y) over k fy, first_value(v) over k fv from c window k as (partition by ind, r order by y)),
x as (select *, case when py = y - 1 then round(100 * (v - pv) / nullif(pv, 0), 1) end rel, case when fy < y - 1 then round(100 * (v - fv) / nullif(fv, 0), 1) end far from w),
t as (select * from x where r = 'Total'), n as (select x.*, t.v tv from x join t using (ind, y) where x.r <> 'Total'),
o as (select *, row_number() over (partition by ind, y order by v desc, r desc) k from n),
m as (select * from n where rel is not null and abs(pv) >= greatest(50, tv * 0.01)),
mm as (select ind, y, count(*) k, max(rel) - min(rel) spread, arg_max(struct_pack(r := r, rel := rel), abs(rel) * 1e6 + length(r) * 1e-9) top from m group by 1, 2)"""


_SAID = f"""select ind indicator, y as "year", 0 as "position", 'En ' || y || ', pour « Commandes du segment ' || ind || ' par priorité (en milliers) », le total s''établit à ' || {_FR('v', 0)} || '.' as text from t
union all select ind, y, 1, 'Par rapport à ' || (y - 1) || ', ce total ' || case when rel > 0 then 'progresse' when rel < 0 then 'recule' else 'reste stable' end || ' de ' || {_FR('rel', 1)} || ' %.' from t where rel is not null
union all select ind, y, 2, 'Depuis ' || fy || ', la ' || case when far > 0 then 'hausse' when far < 0 then 'baisse' else 'variation' end || ' cumulée atteint ' || {_FR('far', 1)} || ' %.' from t where far is not null
union all select a.ind, a.y, 3, 'Les valeurs les plus élevées en ' || a.y || ' reviennent à « ' || a.r || ' » (' || {_FR('a.v', 0)} || ') et à « ' || b.r || ' » (' || {_FR('b.v', 0)} || ').' from o a join o b on a.ind = b.ind and a.y = b.y and a.k = 1 and b.k = 2
union all select mm.ind, mm.y, 4, 'Par rapport à ' || (mm.y - 1) || ', dans la répartition par priorité, ' || case when (mm.k >= 3 and spread < 0.2) or coalesce(abs(top.rel - t.rel) < 0.15, false) then 'aucune catégorie ne s''écarte de l''évolution d''ensemble.' else 'l''évolution la plus marquée concerne « ' || top.r || ' » (' || case when top.rel > 0 then 'hausse' when top.rel < 0 then 'baisse' else 'reste stable' end || ' de ' || {_FR('top.rel', 1)} || ' %).' end from mm join t using (ind, y)
union all select ind, y, 5, case when rel is null then 'Une seule année est connue : la suite de la série dira dans quel sens elle évolue.' when rel < 0 then 'Il reste à comprendre d''où vient ce repli pour y répondre.' when far < 0 then 'La remontée ne compense pas encore le terrain perdu ; l''année suivante dira si elle dure.' else 'L''année suivante dira si le mouvement se prolonge.' end from t"""


@query("template_commentary", f"with {_CELLS} {_SAID}")
def template_commentary(spark, sf):
    return O.commentary(cells(spark, sf), ["indicator"]).select("indicator", "year", "position", "text")


# A number of a text: blanks between thousands, decimal comma. Years 1990 to 1999 are none, as the tables are of those.
_NUMBERS = r"list_filter(regexp_extract_all(text, '[0-9]{1,3}( [0-9]{3})+(,[0-9]+)?|[0-9]+(,[0-9]+)?'), lambda w: not regexp_matches(w, '^199[0-9]$'))"


@query("commentary_guard", f"""with {_CELLS}, said as ({_SAID}),
auth as (select v x from c union select abs(a.v - b.v) from c a join c b on a.ind = b.ind and a.r = b.r and b.y < a.y union select abs(round(100 * (a.v - b.v) / nullif(b.v, 0), 1)) from c a join c b on a.ind = b.ind and a.r = b.r and b.y < a.y),
nn as (select indicator, "year", "position", unnest({_NUMBERS}) w from said),
j as (select indicator, "year", "position", count(*) n, count(*) filter (replace(replace(w, ' ', ''), ',', '.')::double in (select x from auth)) ok from nn group by all)
select indicator, "year", "position", case when coalesce(n, 0) = coalesce(ok, 0) then 'kept' else 'not kept' end as action, coalesce(n, 0) n_numbers from said left join j using (indicator, "year", "position")""")
def commentary_guard(spark, sf):
    """What the templates write, in front of the guard: numbers cited, and whether all are cells or variations."""
    c = cells(spark, sf)
    said = O.commentary(c, ["indicator"]).withColumn("statement_id", F.xxhash64("indicator", "year", "position"))
    auth = O.authorised_numbers(c.select("row", "value"), O.changes_of(c, ["indicator"]))
    out = G.guarded(said.select("statement_id", "text"), auth, years=(1990, 1999)).join(said.select("statement_id", "indicator", "year", "position"), "statement_id")
    return out.select("indicator", "year", "position", F.when(F.col("action") == "kept", "kept").otherwise("not kept").alias("action"), "n_numbers")


@query("traceability", f"""with {_CELLS}, id as (select *, row_number() over (order by ind, r, y)::bigint id from c), v as (select a.ind, a.r, a.y, b.y ry, a.id, b.id rid from id a join id b on a.ind = b.ind and a.r = b.r and b.y < a.y)
select ind indicator, r as "row", y as "year", ry ref_year, 'current' as "end", id cell_id, 'Annuaire 2024, tableau 1, p. ' || (id % 50) place from v union all select ind, r, y, ry, 'reference', rid, 'Annuaire 2024, tableau 1, p. ' || (rid % 50) from v""")
def traceability(spark, sf):
    c = cells(spark, sf)
    places = c.select("value_id", F.lit("annuaire_2024").alias("doc_id"), F.lit(1).alias("table_n"), (F.col("value_id") % 50).alias("page"))
    return O.traced(O.changes_of(c, ["indicator"]), places).select("indicator", "row", "year", "ref_year", "end", "cell_id", "place")


@query("main_rows", f"""with {_CELLS}, want as (select ind, max(v) v from n where y = 1995 group by ind), kk as (select c.*, case when r = 'Total' then 'Effectif' when c.v % 3 = 0 then 'Part' else '' end sub, abs(c.v - want.v) < 1e-6 same, ind || y <> 'BUILDING1996' or r <> 'Total' has from c join want using (ind))
select ind indicator, y as "year", r as "row" from kk where has qualify row_number() over (partition by ind, y order by same desc, (r = 'Total') desc, (sub in ('', 'Effectif', 'Effectifs')) desc, r) = 1""")
def main_rows(spark, sf):
    """The row that has a wanted value, else the total, else the first of a level sub-column; one table lacks its total."""
    c = cells(spark, sf)
    want = c.where("row <> 'Total' and year = 1995").groupBy("indicator").agg(F.max("value").alias("want"))
    sub = F.when(F.col("row") == "Total", "Effectif").when(F.col("value") % 3 == 0, "Part").otherwise("")
    c = c.where("concat(indicator, year) <> 'BUILDING1996' or row <> 'Total'").withColumn("sub", sub).join(want, "indicator")
    return O.main_row(c, ["indicator", "year"], "want").select("indicator", "year", "row")


#: Refusal thresholds by encoder: what the lexical signal was calibrated to, and the default.
THRESHOLDS, DEFAULT_THRESHOLD = {"lexical": 30.0}, 25.0
_SIG = f"{PR.hybrid_ctes()}, pbest as (select qid, max(score) s from (select qid, id, sum(weight * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score from tf join idf using (term) join q using (term) group by 1, 2) where score > 0 group by qid), sig as (select item_id qid, round(coalesce(s, 0), 6) signal, coalesce(round(s, 6), 0) < 30 refused from benchmark left join pbest on qid = item_id)"
_SENT = r"string_split(regexp_replace(regexp_replace(d.text, '([.;!?])\s+', '\1' || chr(1), 'g'), '\n', chr(1), 'g'), chr(1))"


def decided(spark, sf):
    """(qid, signal, refused): the best lexical score of the question itself, without expansion, against the threshold."""
    best = PR.lexical(spark, sf, 1, True).select("qid", F.round("score", 6).alias("signal"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid")).join(best, "qid", "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    return IX.kept(R.refusal(q, R.thresholds_for("lexical", THRESHOLDS, DEFAULT_THRESHOLD)), "decided")


def shown(spark, sf, d=None):
    """(qid, id, rank) of the hybrid search for the questions that are not refused (by ``d``, what was decided, if it is at hand)."""
    d = decided(spark, sf) if d is None else d
    return PR.hybrid_topk(spark, sf).select("qid", "id", "rank").join(d.where("not refused").select("qid"), "qid", "left_semi")


@query("consultation", rf"""with {_SIG}, hit as (select h.qid, h.id, h.rank, {_SENT} s from hybrid h join sig using (qid) join documents d on d.doc_id = h.id where rank <= 5 and not refused),
qs as (select item_id qid, {T.token_set_sql('text')} words from benchmark),
o as (select hit.*, list_transform(s, lambda x: len(list_intersect(words, {T.token_set_sql('x')}))) n from hit join qs using (qid)),
e as (select qid, id, rank, trim(array_to_string(list_slice(s, greatest(1, list_position(n, list_max(n)) - 1), greatest(1, list_position(n, list_max(n)) - 1) + 3), ' ')) t from o)
select qid, id, rank::int rank, case when length(t) > 420 then left(t, 420) || '…' else t end excerpt from e union all select qid, null, null, null from sig where refused""")
def consultation(spark, sf):
    """The service: authorised passages, signal, refusal under the encoder's threshold, else five hybrid hits, each with an
    excerpt around the sentence that shares most words with the question."""
    words = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), T.token_set(F.col("text")).alias("words"))
    d = decided(spark, sf)
    hits = R.excerpts(shown(spark, sf, d), passages(spark, sf), words)
    refused = d.where("refused").select("qid", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("excerpt"))
    return hits.unionByName(refused)


@query("consultation_suggestions", rf"""with {_SIG}, w as (select item_id tid, text title, unnest({T.token_set_sql('text')}) w from benchmark),
near as (select a.tid qid, b.tid, any_value(b.title) title, count(*) common from w a join w b using (w) join sig on sig.qid = a.tid and refused where a.tid <> b.tid group by 1, 2),
best as (select *, row_number() over (partition by qid order by common desc, tid) n from near),
ok as (select best.qid, best.n, trim(regexp_replace(title, '\s*\(en ?%\)\s*', ' ', 'g')) title from best join sig s on s.qid = best.tid where n <= 15 and s.signal >= 30),
one as (select qid, title, min(n) n from ok group by 1, 2)
select qid, row_number() over (partition by qid order by n)::int as "position", md5(title) digest from one qualify "position" <= 3""")
def consultation_suggestions(spark, sf):
    """For refused questions, other questions near to them that would be answered."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("title_id"), F.col("text").alias("title"), T.token_set(F.col("text")).alias("words"), F.regexp_extract_all("text", F.lit(r"\b20\d\d\b"), 0).alias("years"))
    d = decided(spark, sf)
    refused = d.where("refused").join(b.select(F.col("title_id").alias("qid"), "words", "years"), "qid")
    out = R.suggestions(refused, b, d.select(F.col("qid").alias("title_id"), "signal"), THRESHOLDS["lexical"])
    return out.select("qid", "position", F.md5(F.col("title").cast("binary")).alias("digest"))


@query("consultation_journal", rf"""with {_SIG}, h as (select qid, '[' || string_agg('{{"passage_id":' || id || ',"rank":' || rank || '}}', ',' order by rank) || ']' sources from hybrid where rank <= 5 and qid in (select qid from sig where not refused) group by 1)
select qid, '{{"question":' || qid || ',"mode":"hybrid"}}' as entry, coalesce(sources, '[]') sources, case when refused then 'no passage is near enough' end abstention from sig left join h using (qid)""")
def consultation_journal(spark, sf):
    """The journal's rows of all questions: entry and sources as JSON, and why nothing was answered."""
    d = decided(spark, sf)
    src = shown(spark, sf, d).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("h"))
    src = src.select("qid", F.to_json(F.transform("h", lambda x: F.struct(x["id"].alias("passage_id"), x["rank"].alias("rank")))).alias("sources"))
    j = d.join(src, "qid", "left")
    entry = F.to_json(F.struct(F.col("qid").alias("question"), F.lit("hybrid").alias("mode")))
    return j.select("qid", entry.alias("entry"), F.coalesce("sources", F.lit("[]")).alias("sources"), F.when(F.col("refused"), "no passage is near enough").alias("abstention"))


@query("extractive_answers")
def extractive_answers(spark, sf):
    """Two sentences of the three best passages as an answer, in front of the guard with the numbers of all five as authorised
    values: what the guard does with each. Its SQL twin would be that of the guard; unit tests hold it."""
    hits, q = shown(spark, sf), table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), T.token_set(F.col("text")).alias("words"))
    texts = IX.kept(hits.join(passages(spark, sf), "id"), "shown-texts")
    s = texts.where("rank <= 3").select("qid", "rank", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).join(q, "qid")
    s = s.withColumn("n", F.size(F.array_intersect("words", T.token_set(F.col("sentence"))))).where("n > 0")
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("n").desc(), "rank", "pos"))).where("k <= 2").withColumn("statement_id", F.col("qid") * 2 + F.col("k") - 1)
    numbers = G.found_numbers(texts.select("qid", "text"), "qid").select("writing", F.col("qid").cast("string").alias("source"), F.lit(1).alias("priority"))
    out = G.guarded(s.select("statement_id", F.col("sentence").alias("text")), numbers)
    return out.select(F.floor(F.col("statement_id") / 2).alias("qid"), (F.col("statement_id") % 2).cast("int").alias("position"), "action", "n_numbers", "n_kept")


@query("passage_search", "select doc_id, source, lang from documents where text ilike '%tion the%' order by doc_id limit 300")
def passage_search(spark, sf):
    """The explorer: substring search, at most 300 rows."""
    return table(spark, sf, "documents").where(F.col("text").ilike("%tion the%")).orderBy("doc_id").limit(300).select("doc_id", "source", "lang")


@query("multi_criteria_filter", "select doc_id from documents left join (select distinct doc_id, toxic from labels) l using (doc_id) where coalesce(toxic, 0) = 0 and lang in ('fr', 'de') and 2021 + doc_id % 4 < 2024 and n_chars > 500")
def multi_criteria_filter(spark, sf):
    d = table(spark, sf, "documents").where("lang in ('fr', 'de') and 2021 + doc_id % 4 < 2024 and n_chars > 500")
    return d.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("prior_comments", "select doc_id, p.doc_id prior_id from documents d join documents p on p.n_chars % 10 = d.n_chars % 10 and 2021 + p.doc_id % 4 < 2021 + d.doc_id % 4 and p.lang = d.lang qualify row_number() over (partition by d.doc_id order by p.doc_id % 4 desc, p.doc_id) <= 3".replace("select doc_id,", "select d.doc_id,"))
def prior_comments(spark, sf):
    """The last three passages of earlier editions in the same section: first the three of each section and edition, then
    those of the editions before; no row meets all of its section."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 10).alias("source"), "lang", (2021 + F.col("doc_id") % 4).alias("edition"))
    key = ["source", "lang", "edition"]
    first = d.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))).where("n <= 3").select("source", "lang", F.col("edition").alias("before"), F.col("doc_id").alias("prior_id"))
    cells_ = d.select(*key).distinct().join(first, ["source", "lang"]).where("before < edition")
    best = cells_.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("before").desc(), "prior_id"))).where("n <= 3")
    return d.join(best, key).select("doc_id", "prior_id")


@query("title_words", f"select n_name, array_to_string(list_sort({T.token_set_sql('n_name')}), ' ') words from nation")
def title_words(spark, sf):
    return table(spark, sf, "nation").select("n_name", F.array_join(F.array_sort(T.token_set(F.col("n_name"))), " ").alias("words"))


_MOVES = f"with {_CELLS}, f as (select ind, y, r, rel from m where rel <> 0)"


@query("key_messages", f"""{_MOVES}, main as (select y, 1 as "position", 'main' as role, ind as name, null::varchar as label, v as "value", rel as change from t where rel is not null qualify row_number() over (partition by y order by v desc, ind desc) = 1),
up as (select *, row_number() over (partition by y order by round(rel, 6) desc, ind desc, r desc) a, row_number() over (partition by y order by round(rel, 6), ind, r) b, count(*) over (partition by y) n from f where rel > 0),
down as (select *, row_number() over (partition by y order by round(-rel, 6) desc, ind desc, r desc) a from f where rel < 0)
select y note_id, "position", role, name, label, "value", round(change, 6) change from (select * from main union all select y, 2, 'rise', ind, r, null, rel from up where a = 1 union all select y, 3, 'warning', ind, r, null, rel from down where a = 1 union all select y, 3, 'no fall', ind, r, null, rel from up where b = 1 and n > 1 and y not in (select y from down))""")
def key_messages(spark, sf):
    """Three messages a year: the largest segment, the strongest rise and the strongest fall of a priority."""
    levels, moves = evolutions(spark, sf)
    out = A.key_messages(levels.withColumnRenamed("year", "note_id"), moves.withColumnRenamed("year", "note_id"), "note_id")
    return out.withColumn("change", F.round("change", 6))


@query("typed_leads", f"""{_MOVES}, h as (select t.*, lag(rel, 1) over k r1, lag(rel, 2) over k r2 from t window k as (partition by ind order by y)),
top as (select ind, y, r, rel from f qualify row_number() over (partition by ind, y order by round(abs(rel), 6) desc, r desc) = 1),
e as (select h.y, 'le segment ' || h.ind as name, h.rel as change, top.r as label, top.rel as lrel, h.rel > 0 and r1 > 0 and r2 > 0 as rising, h.ind = 'BUILDING' as obj from h left join top on top.ind = h.ind and top.y = h.y where h.rel is not null),
k as (select *, case when change < 0 then 'correct' when obj then 'consolidate' when rising then 'understand' else 'follow' end kind from e)
select y note_id, kind, name, case when kind = 'correct' and lrel < 0 then label else '' end as labels from k""")
def typed_leads(spark, sf):
    """What to do about each segment's evolution, by direction, documented objective (one segment has one), and lasting trend."""
    levels, moves = evolutions(spark, sf)
    top = F.max_by(F.struct("label", F.col("change").alias("label_change")), F.struct(F.round(F.abs("change"), 6), "label")).alias("top")
    tops = moves.where("change <> 0").groupBy("name", "year").agg(top).select("name", "year", "top.*")
    trends = S.trend(levels, ["name"]).select("name", "year", "trend")
    e = levels.join(tops, ["name", "year"], "left").join(trends, ["name", "year"], "left").withColumn("has_objective", F.col("name") == "BUILDING").withColumn("place", F.coalesce(O.is_place(F.col("label")), F.lit(False)))
    out = A.leads(e.withColumn("name", F.concat(F.lit("le segment "), "name")).withColumnRenamed("year", "note_id"), "note_id")
    return out.select("note_id", "kind", "name", F.array_join("labels", ", ").alias("labels"))


def evolutions(spark, sf):
    """(name, year, value, change) of totals, and (name, year, label, change) of the rows above the floor of commentary."""
    w = Window.partitionBy("indicator", "row").orderBy("year")
    c = cells(spark, sf).withColumn("pv", F.lag("value").over(w)).withColumn("py", F.lag("year").over(w))
    c = c.withColumn("change", F.when(F.col("py") == F.col("year") - 1, F.round(100 * (F.col("value") - F.col("pv")) / F.nullif("pv", F.lit(0.0)), 1)))
    levels = c.where("row = 'Total'").select(F.col("indicator").alias("name"), "year", "value", "change")
    rows = c.where("row <> 'Total'").select(F.col("indicator").alias("name"), "year", F.col("row").alias("label"), "change", "pv")
    return levels, rows.join(levels.select("name", "year", F.col("value").alias("total")), ["name", "year"]).where("change is not null and abs(pv) >= greatest(50.0, total * 0.01)").select("name", "year", "label", "change")
