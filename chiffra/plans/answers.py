"""Answers and their sources: sentences of questions in documents, summaries of the best passages, audited numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chiffra.functions import text as T
from chiffra.operators import answers as A
from chiffra.operators import comparison as CP
from chiffra.plans.base import passages, query, r6, table
from chiffra.plans.retrieval import _P, bm25_ctes, lexical
from chiffra.sources import index as IX

_SENTENCES = lambda t, i: f"select {i}, unnest({T.sentences_sql('text')}) sent, generate_subscripts({T.sentences_sql('text')}, 1)::int pos from {t}"


def sentence_sets(df, key):
    """(key, pos from 1, s) of every sentence."""
    return df.select(key, F.posexplode(T.sentences(F.col("text"))).alias("p", "sent")).select(key, (F.col("p") + 1).alias("pos"), T.token_set(F.col("sent")).alias("s"))


@query("sentence_sources", f"""with q as (select item_id, pos, {T.token_set_sql('sent')} a from ({_SENTENCES('benchmark', 'item_id')})), d as (select doc_id, pos dpos, {T.token_set_sql('sent')} b from ({_SENTENCES('documents', 'doc_id')})),
dd as (select list_sort(b) b, min((doc_id, dpos)) m from d group by 1), p as (select item_id, pos, m, {T.jaccard_sql('a', 'b')} sim from q, dd where len(a) > 0 and len(b) > 0 and len(a) * 2 >= len(b) and len(b) * 2 >= len(a))
select item_id, pos, m[1] doc_id, m[2] doc_pos, round(sim, 6) sim from p where sim >= 0.5 qualify row_number() over (partition by item_id, pos order by round(sim, 9) desc, m) = 1""")
def sentence_sources(spark, sf):
    """Each sentence of an item with the sentence of the documents that is most like it, from a similarity of 0.5 on."""
    q = sentence_sets(table(spark, sf, "benchmark"), "item_id").select(F.struct("item_id", "pos").alias("a"), "s")
    d = sentence_sets(table(spark, sf, "documents"), "doc_id").select(F.struct("doc_id", "pos").alias("b"), "s")
    # The first of equal sentences stands for all: the best source is the first of the best.
    pairs = A.similar_sets(q, d, 0.5, first=True).select("a.item_id", "a.pos", "b", "sim")
    w = Window.partitionBy("item_id", "pos").orderBy(F.round("sim", 9).desc(), "b")
    return pairs.withColumn("n", F.row_number().over(w)).where("n = 1").select("item_id", "pos", "b.doc_id", F.col("b.pos").alias("doc_pos"), r6("sim", "sim"))


_TOP = f"{bm25_ctes()}, top as (select qid, id, rank from ranked where rank <= 5), qs as (select item_id qid, {T.token_set_sql('text')} qset from benchmark), s as (select qid, rank, unnest({T.sentences_sql('d.text')}) sent, generate_subscripts({T.sentences_sql('d.text')}, 1)::int pos from top join documents d on d.doc_id = top.id)"


def _top_texts(spark, sf):
    return IX.kept(lexical(spark, sf, 5).select("qid", "id", "rank").join(passages(spark, sf), "id"), "top-texts")


def _candidates(spark, sf, top=None):
    top = _top_texts(spark, sf) if top is None else top
    qs = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), T.token_set(F.col("text")).alias("qset"))
    s = top.select("qid", "rank", F.posexplode(T.sentences(F.col("text"))).alias("p", "sent")).join(qs, "qid")
    return s.select("qid", "rank", (F.col("p") + 1).alias("pos"), "sent", F.array_intersect("qset", T.token_set(F.col("sent"))).alias("covers"))


@query("coverage_summary", f"""with recursive {_TOP}, c as (select qid, rank, pos, list_sort(list_intersect(qset, {T.token_set_sql('sent')})) covers from s join qs using (qid)), c1 as (select qid, covers, min(struct_pack(r := rank, p := pos)) spot from c where len(covers) > 0 group by 1, 2),
g as (select qid, 0 step, []::varchar[] covered, null::struct(r bigint, p int) spot, 0::bigint gain from (select distinct qid from c1) union all
select qid, step + 1, list_distinct(list_concat(covered, covers)), spot, gain from (select g.qid, g.step, g.covered, c1.covers, c1.spot, len(list_filter(c1.covers, lambda x: not list_contains(g.covered, x))) gain from g join c1 using (qid) where step < 3) where gain > 0 qualify row_number() over (partition by qid, step order by gain desc, spot) = 1)
select qid, step::int step, spot.r::int rank, spot.p pos, gain::int gain from g where step > 0""")
def coverage_summary(spark, sf):
    """Up to three sentences of the five best passages that together hold most words of the question."""
    return A.summary(_candidates(spark, sf).select("qid", "rank", "pos", "covers"), "qid")


@query("attached_sources", f"""with {_TOP}, o as (select qid, rank, pos, sent, len(list_intersect(qset, {T.token_set_sql('sent')})) n from s join qs using (qid)), a as (select qid, row_number() over (partition by qid order by n desc, rank, pos)::int as "position", {T.token_set_sql('sent')} words from o where n > 0 qualify row_number() over (partition by qid order by n desc, rank, pos) <= 2),
b as (select qid, rank as "block", {T.token_set_sql('d.text')} words from top join documents d on d.doc_id = top.id), p as (select a.qid, a."position", b."block", coalesce(len(list_intersect(a.words, b.words)) / nullif(len(a.words), 0)::double, 0) overlap from a join b using (qid))
select qid, "position", "block"::int as "block", round(overlap, 6) overlap from p qualify row_number() over (partition by qid, "position" order by round(overlap, 12) desc, "block") = 1""")
def attached_sources(spark, sf):
    """The two sentences that share most words with the question, each with the passage it comes from as far as its words say."""
    w = Window.partitionBy("qid").orderBy(F.col("n").desc(), "rank", "pos")
    top = _top_texts(spark, sf)
    c = _candidates(spark, sf, top).withColumn("n", F.size("covers")).where("n > 0").withColumn("position", F.row_number().over(w)).where("position <= 2")
    blocks = top.select("qid", F.col("rank").alias("block"), T.token_set(F.col("text")).alias("words"))
    return A.attached(c.select("qid", "position", T.token_set(F.col("sent")).alias("words")), blocks, ["qid"]).select("qid", "position", "block", r6("overlap", "overlap"))


@query("number_audit", r"""with c as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn, text) prev from conversations), n as (select conv_id, turn, list_transform(regexp_extract_all(text, '[0-9]+(?:[.,  ][0-9]+)*'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) a, list_transform(regexp_extract_all(prev, '[0-9]+(?:[.,  ][0-9]+)*'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) b from c where prev is not null)
select conv_id, turn, len(a)::bigint total, len(list_filter(a, lambda x: list_contains(b, x)))::bigint supported, round(coalesce(len(list_filter(a, lambda x: list_contains(b, x))) / nullif(len(a), 0)::double, 1), 6) accuracy from n""")
def number_audit(spark, sf):
    """The numbers of each turn in the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    c = table(spark, sf, "conversations").withColumn("prev", F.lag("text").over(w)).where("prev is not null").withColumn("k", F.struct("conv_id", "turn"))
    out = A.number_audit(c.select("k", "text"), c.select("k", F.col("prev").alias("text")), "k")
    return out.select("k.conv_id", "k.turn", "total", "supported", r6("accuracy", "accuracy"))


_ENCODERS = {"full": "embedding::double[]", "head": "embedding[1:16]::double[]", "sign": "list_transform(embedding, lambda x: sign(x)::double)"}


def _encoder_sql():
    one = lambda n, v: f"select '{n}' config, a.vec_id qid, b.vec_id id, a.label = b.label rel, row_number() over (partition by a.vec_id order by round(list_inner_product(a.v, b.v), 9) desc, b.vec_id) rank from (select *, {v} v from embeddings) a, (select *, {v} v from embeddings) b where a.vec_id % 20 = 0"
    return f"""with recursive h as ({' union all '.join(one(n, v) for n, v in _ENCODERS.items())}), per as (select config, qid, avg(rel::int::double) filter (rank <= 5) x, coalesce(max(case when rel then 1.0::double / rank end), 0) rr from h where rank <= 10 group by 1, 2),
m as (select config, count(*) n, avg(x) as precision_5, avg(rr) mrr from per group by 1), d as (select p.config, round(p.x - b.x, 12) d from per p join per b on b.qid = p.qid and b.config = 'full' where p.config <> 'full'),
nz as (select config, d, rank() over (partition by config order by abs(d)) + (count(*) over (partition by config, abs(d)) - 1) / 2.0 r, count(*) over (partition by config, abs(d)) t from d where d <> 0),
s as (select config, sum(case when d > 0 then r else 0 end)::double wp, sum(case when d < 0 then r else 0 end)::double wm, count(*)::double n, sum(t * t - 1)::double tt from nz group by 1),
c as (select config, count(*) filter (d > 1e-12) win, count(*) filter (d < -1e-12) loss, count(*) filter (abs(d) <= 1e-12) tie from d group by 1), t as (select c.*, wp, wm, n, tt from c left join s using (config)), {_P}
select m.config, m.n, round(precision_5, 6) as precision_5, round(mrr, 6) mrr, win, loss, tie, least(wp, wm) w, round(p, 6) p from m left join valued using (config)"""


@query("encoder_comparison", _encoder_sql())
def encoder_comparison(spark, sf):
    """Whole vectors, their first sixteen components and their signs as three encoders: precision at 5, reciprocal rank, and the
    test against the whole ones. Rankings are cells that a second run finds."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    sign = lambda x: F.signum(x.cast("double"))
    vectors = {"full": F.col("embedding"), "head": F.slice("embedding", 1, 16), "sign": F.transform("embedding", sign)}
    encoders = {n: ({"of": n}, lambda rows, v=v: rows.select("id", v.alias("v"))) for n, v in vectors.items()}
    cells = CP.Cells(spark, f"{IX.shared_folder(spark)}/chiffra-comparison")
    hits = CP.rankings(cells, encoders, e, e.where("id % 20 = 0"), k=10)
    lab = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    j = hits.join(lab, "id").join(lab.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid").withColumn("rel", F.col("label") == F.col("ql"))
    out = CP.compared(j, "full")
    return out.select("config", "n", r6("precision", "precision_5"), r6("mrr", "mrr"), "win", "loss", "tie", "w", r6("p", "p"))
