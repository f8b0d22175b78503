"""Retrieval queries over documents, benchmark questions, labels and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chiffra.functions import text as T
from chiffra.operators import evaluation as E
from chiffra.operators import retrieval as R
from chiffra.sources import index as IX
from chiffra.plans.base import authorised, passages, query, r6, table

ALLOWED = "allowed as (select doc_id id from documents where doc_id not in (select doc_id from labels where toxic = 1))"


def bm25_ctes(scope: str = "", terms: str | None = None) -> str:
    return f"""tok as (select doc_id id, {T.tokens_sql('text')} toks from documents),
tok2 as (select id, toks, len(toks) dl from tok),
stats as (select count(*)::double n, avg(dl) avgdl from tok2),
post as (select id, dl, unnest(toks) term from tok2),
df as (select term, count(distinct id)::double df from post group by term),
raw as (select term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) raw from df, stats),
idf as (select term, avgdl, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end idf from raw),
q0 as (select item_id qid, unnest({T.tokens_sql('text')}) term from benchmark),
q as (select qid, term, count(*)::double weight from q0 group by 1, 2){terms or ", terms as (select * from q)"},
tf as (select id, dl, term, count(*)::double tf from post {scope} group by 1, 2, 3),
scores as (select qid, id, sum(weight * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score from tf join idf using (term) join terms using (term) group by 1, 2),
ranked as (select qid, id, score, row_number() over (partition by qid order by round(score, 9) desc, id) rank from scores where score > 0)"""


def index(spark, sf):
    """The stored index of the documents, built at its first use."""
    return IX.session_index(passages(spark, sf), f"{sf}/documents")


def lexical(spark, sf, k, allowed=False, terms=None):
    """(qid, id, score, rank) of the best ``k`` passages of each question, kept as a small table: what joins it reads it again, and
    knows its size before."""
    return IX.kept(R.bm25_top_k(index(spark, sf), terms or R.question_terms(table(spark, sf, "benchmark")), k, authorised(spark, sf) if allowed else None), "lexical")


OUT = "select qid, id, rank::int rank, round(score, 6) score from ranked where rank <= "


@query("bm25_topk", f"with {bm25_ctes()} {OUT} 5")
def bm25_topk(spark, sf):
    return lexical(spark, sf, 5).select("qid", "id", "rank", r6("score", "score"))


@query("bm25_authorised_topk", f"with {ALLOWED}, {bm25_ctes('where id in (select id from allowed)')} {OUT} 5")
def bm25_authorised_topk(spark, sf):
    return lexical(spark, sf, 5, True).select("qid", "id", "rank", r6("score", "score"))


#: A lexicon for the driver tables: each family a list of synonyms, the last of them a phrase of several words.
LEXICON = [["the", "that", "with"], ["onen", "eren", "thin"], ["enen", "erea", "anti", "hein", "tion", "bleed"], ["quelle", "leaux", "ment"], ["shin on", "in the", "thand onen"]]


def families(spark):
    rows = [(f, p, w) for f, ws in enumerate(LEXICON) for p, w in enumerate(ws)]
    return spark.createDataFrame(rows, "family int, pos int, term string")


_FAM = ", fam(family, pos, term) as (values " + ", ".join(f"({f}, {p}, '{w}')" for f, ws in enumerate(LEXICON) for p, w in enumerate(ws)) + ")"
_EXPAND = _FAM + f""", ftok as (select family, pos, contains(term, ' ') several, unnest({T.tokens_sql('term')}) token, generate_subscripts({T.tokens_sql('term')}, 1) att from fam),
said as (select item_id qid, family from benchmark, fam where contains(term, ' ') and contains(' ' || array_to_string(regexp_extract_all({T.normalised_sql('text')}, '\\S+'), ' ') || ' ', ' ' || term || ' ')),
touched as (select qid, family from q join ftok on token = term and not several union select qid, family from said),
extra0 as (select t.qid, f.family, f.pos, f.att, f.token term from touched t join ftok f using (family) where not exists (select 1 from q where q.qid = t.qid and q.term = f.token)),
extra1 as (select * from extra0 qualify row_number() over (partition by qid, term order by family, pos, att) = 1),
extra as (select * from extra1 qualify row_number() over (partition by qid, family order by pos, att) <= 4),
terms as (select qid, term, weight from q union all select qid, term, 0.3 from extra)"""


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def expanded_terms(spark, sf):
    return R.expanded(R.question_terms(table(spark, sf, "benchmark")), families(spark), questions=questions(spark, sf))


@query("bm25_weighted_expansion", f"with {bm25_ctes(terms=_EXPAND)} {OUT} 5")
def bm25_weighted_expansion(spark, sf):
    return lexical(spark, sf, 5, terms=expanded_terms(spark, sf)).select("qid", "id", "rank", r6("score", "score"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def vector_queries(spark, sf):
    """The stated query set: ids divisible by 20, against all rows."""
    return vectors(spark, sf).where("id % 20 = 0").select(F.col("id").alias("qid"), "v")


def cells(spark, sf):
    """The vectors in cells, built at their first use."""
    return IX.session_index(vectors(spark, sf).select("id", "v"), f"{sf}/embeddings", IX.save_cells, "cells")


def dense(spark, sf, k, filtered=False):
    allowed = vectors(spark, sf).where("label <> 3").select("id") if filtered else None
    return R.cells_top_k(cells(spark, sf), vector_queries(spark, sf), k, allowed)


def dense_ctes(where: str = "true") -> str:
    return f"""pairs as (select a.vec_id qid, b.vec_id id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9) score from embeddings a, embeddings b where a.vec_id % 20 = 0 and {where}),
dranked as (select *, row_number() over (partition by qid order by score desc, id) rank from pairs)"""


@query("dense_topk", f"with {dense_ctes()} select qid, id, rank::int rank, round(score, 6) score from dranked where rank <= 5")
def dense_topk(spark, sf):
    return dense(spark, sf, 5).select("qid", "id", "rank", r6("score", "score"))


@query("dense_filtered_topk", f"with {dense_ctes('b.label <> 3')} select qid, id, rank::int rank, round(score, 6) score from dranked where rank <= 5")
def dense_filtered_topk(spark, sf):
    """The filter comes before ranking, so five hits remain."""
    return dense(spark, sf, 5, True).select("qid", "id", "rank", r6("score", "score"))


# Two channels over vectors: the dense one and one by the first 16 dimensions only.
_SECOND = """pairs2 as (select a.vec_id qid, b.vec_id id, round(list_inner_product(a.embedding[1:16]::double[], b.embedding[1:16]::double[]), 9) score from embeddings a, embeddings b where a.vec_id % 20 = 0),
branked as (select *, row_number() over (partition by qid order by score desc, id) rank from pairs2)"""


def channels(spark, sf, k=50):
    v = vectors(spark, sf)
    head = v.withColumn("v", F.slice("v", 1, 16))
    return R.dense_top_k(v, vector_queries(spark, sf), k), R.dense_top_k(head, vector_queries(spark, sf).withColumn("v", F.slice("v", 1, 16)), k)


def fused_ctes(k: str = "60", extra: str = "", keys: str = "qid") -> str:
    return f"""{dense_ctes()}, {_SECOND},
both_ as (select qid, id, rank from dranked where rank <= 50 union all select qid, id, rank from branked where rank <= 50),
fused as (select {extra}qid, id, sum(1.0::double / ({k} + rank)) score from both_{', ks' if extra else ''} group by all),
franked as (select *, row_number() over (partition by {keys} order by round(score, 9) desc, id) rank from fused)"""


@query("rrf_fusion", f"with {fused_ctes()} select qid, id, rank::int rank, round(score, 6) score from franked where rank <= 5")
def rrf_fusion(spark, sf):
    return R.rrf(list(channels(spark, sf)), 60, 5).select("qid", "id", "rank", r6("score", "score"))


@query("rrf_k_ablation", f"with ks(k) as (values (1), (10), (20), (60), (100)), {fused_ctes('k', 'k, ', 'k, qid')}, lab as (select vec_id id, label from embeddings) select k, avg(case when a.label = b.label then 1.0 else 0.0 end)::double as precision_5 from franked f join lab a on f.qid = a.id join lab b on f.id = b.id where rank <= 5 group by k")
def rrf_k_ablation(spark, sf):
    """Precision at 5 for each smoothing constant; the two channels are ranked once."""
    a, b = channels(spark, sf)
    both = a.select("qid", "id", "rank").unionByName(b.select("qid", "id", "rank"))
    ks = spark.createDataFrame([(1,), (10,), (20,), (60,), (100,)], "k int")
    fused = both.join(F.broadcast(ks)).groupBy("k", "qid", "id").agg(F.sum(1.0 / (F.col("k") + F.col("rank"))).alias("score"))
    from pyspark.sql import Window

    top = fused.withColumn("rank", F.row_number().over(Window.partitionBy("k", "qid").orderBy(F.round("score", 9).desc(), "id"))).where("rank <= 5")
    lab = vectors(spark, sf).select("id", "label")
    top = top.join(lab, "id").join(lab.select(F.col("id").alias("qid"), F.col("label").alias("qlabel")), "qid")
    return top.groupBy("k").agg(F.avg(F.when(F.col("label") == F.col("qlabel"), 1.0).otherwise(0.0)).alias("precision_5"))


# Signals: the best lexical score; a question is outside the corpus if no document holds its text.
_GOLD = "gold as (select item_id qid, doc_id id from benchmark b join documents d on b.text <> '' and contains(d.text, b.text))"
_SIGNALS = f"{_GOLD}, {bm25_ctes()}, signals as (select item_id qid, coalesce(round(s, 6), 0) signal, item_id not in (select qid from gold) outside from benchmark left join (select qid, max(score) s from scores where score > 0 group by qid) on qid = item_id)"


def gold(spark, sf):
    """(qid, id): documents that hold the question's whole text. A document that does has the rarest of the question's inner
    words, so the postings of that word alone are compared; a question without inner words meets all documents."""
    ix, q = index(spark, sf), questions(spark, sf).where("text <> ''")
    words = F.regexp_extract_all(T.normalised(F.col("text")), F.lit("[a-z0-9]+"), 0)
    inner = q.select("qid", F.explode_outer(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))).alias("w"))
    inner = inner.withColumn("term", F.when(~F.col("w").isin(T.STOP_WORDS), T.singular(F.col("w")))).join(ix.terms, "term", "left")
    rare = IX.kept(inner.groupBy("qid").agg(F.min_by("term", F.when(F.col("term").isNotNull(), F.struct(F.coalesce("df", F.lit(0.0)), "term"))).alias("term")), "gold-terms")
    folders = rare.where("term is not null").groupBy(IX.bucket_of(F.col("term")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most BUCKETS rows
    asked = rare.where("term is not null")
    asked = F.broadcast(asked) if sum(r["n"] for r in folders) <= R.MOST_SENT else asked
    maybe = ix.blocks.where(F.col("bucket").isin([r["b"] for r in folders])).select("term", "ids").join(asked, "term").select("qid", F.explode("ids").alias("id"))
    held = maybe.join(q, "qid").join(passages(spark, sf).withColumnRenamed("text", "passage"), "id").where(F.contains("passage", F.col("text"))).select("qid", "id")
    short = rare.where("term is null").join(q, "qid").select("qid", "text")
    return IX.kept(held.unionByName(passages(spark, sf).withColumnRenamed("text", "passage").join(short, F.contains("passage", F.col("text"))).select("qid", "id")), "gold")


def signals(spark, sf):
    best = lexical(spark, sf, 1).select("qid", F.col("score").alias("s"))
    inside = gold(spark, sf).select("qid").distinct().withColumn("inside", F.lit(True))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    return IX.kept(q.join(best, "qid", "left").join(inside, "qid", "left").select("qid", F.coalesce(F.round("s", 6), F.lit(0.0)).alias("signal"), F.col("inside").isNull().alias("outside")), "signals")


@query("confidence_signal", f"with {_SIGNALS} select qid, signal, outside from signals")
def confidence_signal(spark, sf):
    return signals(spark, sf)


_GRID = """lev as (select signal, count(*) filter (outside) o, count(*) filter (not outside) i from signals group by signal),
grid as (select (signal + lead(signal) over (order by signal)) / 2 threshold, sum(o) over (order by signal) / (select nullif(sum(o), 0) from lev)::double tpr, 1 - sum(i) over (order by signal) / (select nullif(sum(i), 0) from lev)::double tnr from lev),
best as (select threshold, round((coalesce(tpr, 0) + coalesce(tnr, 0)) / 2, 12) score from grid where threshold is not null order by score desc, threshold limit 1)"""


@query("refusal_threshold", f"with {_SIGNALS}, {_GRID} select round(threshold, 6) threshold, round(score, 6) score from best")
def refusal_threshold(spark, sf):
    return R.balanced_threshold(signals(spark, sf)).select(r6("threshold", "threshold"), r6("score", "score"))


@query("refusal_threshold_capped", f"with {_SIGNALS}, ins as (select signal, row_number() over (order by signal) r, count(*) over () n from signals where not outside), hi as (select signal high from ins where r = floor(n * 0.05)::int + 1) select round((high + coalesce(greatest((select max(signal) from signals where signal < high), 0), 0)) / 2, 6) threshold from hi")
def refusal_threshold_capped(spark, sf):
    return R.capped_threshold(signals(spark, sf)).select(r6("threshold", "threshold"))


@query("refusal_decision", f"with {_SIGNALS}, {_GRID} select outside, signal < threshold refused, count(*) n from signals, best group by 1, 2")
def refusal_decision(spark, sf):
    s = signals(spark, sf)
    t = R.balanced_threshold(s)
    return s.join(F.broadcast(t)).groupBy("outside", (F.col("signal") < F.col("threshold")).alias("refused")).agg(F.count(F.lit(1)).alias("n"))


@query("refusal_calibration_grid", f"""with {_SIGNALS}, g as (select unnest(range(41)) g), t as (select g, (select max(signal) from signals) * g / 40.0::double threshold from g)
select g::int step, round(threshold, 6) threshold, count(*) filter (outside and signal < threshold) true_refusals, count(*) filter (not outside and signal < threshold) false_refusals from t, signals group by 1, 2""")
def refusal_calibration_grid(spark, sf):
    """Sensitivity and specificity counts on 41 thresholds."""
    s = signals(spark, sf)
    top = s.agg(F.max("signal").alias("top"))
    t = spark.range(41).join(F.broadcast(top)).select(F.col("id").cast("int").alias("step"), (F.col("top") * F.col("id") / 40.0).alias("t"))
    low = F.col("signal") < F.col("t")
    return s.join(F.broadcast(t)).groupBy("step", r6("t", "threshold")).agg(F.count_if(F.col("outside") & low).alias("true_refusals"), F.count_if(~F.col("outside") & low).alias("false_refusals"))


_CV = """folded as (select *, ((row_number() over (partition by outside order by qid) - 1) % 5)::int fold from signals),
train as (select f.fold, s.signal, s.outside from (select distinct fold from folded) f join folded s on s.fold <> f.fold),
lev as (select fold, signal, count(*) filter (outside) o, count(*) filter (not outside) i from train group by 1, 2),
grid as (select fold, (signal + lead(signal) over w) / 2 threshold, sum(o) over w / (nullif(sum(o) over (partition by fold), 0))::double tpr, 1 - sum(i) over w / (nullif(sum(i) over (partition by fold), 0))::double tnr from lev window w as (partition by fold order by signal)),
best as (select fold, threshold from grid where threshold is not null qualify row_number() over (partition by fold order by round((coalesce(tpr, 0) + coalesce(tnr, 0)) / 2, 12) desc, threshold) = 1)"""


@query("refusal_cv", f"with {_SIGNALS}, {_CV} select qid, fold, outside, round(threshold, 6) threshold, signal < threshold refused from folded join best using (fold)")
def refusal_cv(spark, sf):
    """Out-of-sample decisions: folds by rank within each class, the threshold learned on the other folds."""
    from pyspark.sql import Window

    s = signals(spark, sf).withColumn("fold", ((F.row_number().over(Window.partitionBy("outside").orderBy("qid")) - 1) % 5).cast("int"))
    folds = spark.range(5).select(F.col("id").cast("int").alias("f"))
    train = s.join(F.broadcast(folds), F.col("fold") != F.col("f")).select(F.col("f").alias("fold"), "signal", "outside")
    best = R.balanced_threshold(train, ["fold"])
    return s.join(F.broadcast(best.select("fold", "threshold")), "fold").select("qid", "fold", "outside", r6("threshold", "threshold"), (F.col("signal") < F.col("threshold")).alias("refused"))


_REL = f"{_GOLD}, {bm25_ctes()}, judged as (select r.qid, r.id, r.rank, g.id is not null rel from ranked r left join gold g on g.qid = r.qid and g.id = r.id where rank <= 10), ng as (select qid, count(*) n from gold group by qid)"


def judged(spark, sf):
    """The gold rows, and the hits with whether they are gold."""
    g = gold(spark, sf)
    return g, lexical(spark, sf, 10).join(g.withColumn("g", F.lit(True)), ["qid", "id"], "left").withColumn("rel", F.col("g").isNotNull())


@query("retrieval_metrics", f"""with {_REL} select qid, max(case when rank <= 1 and rel then 1.0 else 0.0 end)::double success_1, max(case when rank <= 5 and rel then 1.0 else 0.0 end)::double success_k,
coalesce(max(case when rel then 1.0::double / rank end), 0) rr, round(sum(case when rel and rank <= 5 then 1 / log2(rank + 1) else 0 end), 6) dcg from judged join ng using (qid) group by qid""")
def retrieval_metrics(spark, sf):
    g, j = judged(spark, sf)
    j = j.join(g.select("qid").distinct(), "qid", "left_semi")
    return j.groupBy("qid").agg(*R.ranking_metrics(j)).withColumn("dcg", F.round("dcg", 6))


@query("ndcg_ref", f"""with {_REL}, d as (select qid, sum(case when rel and rank <= 5 then 1 / log2(rank + 1) else 0 end) dcg from judged group by qid)
select qid, n n_relevant, round(dcg / (select sum(1 / log2(i + 1)) from (select unnest(range(1, 6)) i) where i <= n), 6) ndcg from d join ng using (qid)""")
def ndcg_ref(spark, sf):
    g, j = judged(spark, sf)
    n = g.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    d = j.groupBy("qid").agg(F.sum(F.when(F.col("rel") & (F.col("rank") <= 5), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(5)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return d.join(n, "qid").select("qid", "n_relevant", r6(F.col("dcg") / ideal, "ndcg"))


# Precision at 5 of the two vector channels, paired by question.
_CONF = f"""{dense_ctes()}, {_SECOND}, lab as (select vec_id, label from embeddings),
conf as (select 'dense' config, qid, avg(case when x.label = y.label then 1.0 else 0.0 end)::double p5, coalesce(max(case when x.label = y.label and qid <> id then 1.0::double / rank end), 0) rr from dranked join lab x on x.vec_id = qid join lab y on y.vec_id = id where rank <= 5 group by 1, 2
union all select 'head' config, qid, avg(case when x.label = y.label then 1.0 else 0.0 end)::double p5, coalesce(max(case when x.label = y.label and qid <> id then 1.0::double / rank end), 0) rr from branked join lab x on x.vec_id = qid join lab y on y.vec_id = id where rank <= 5 group by 1, 2)"""


def configurations(spark, sf):
    a, b = channels(spark, sf, 5)
    both = a.select(F.lit("dense").alias("config"), "qid", "id", "rank").unionByName(b.select(F.lit("head").alias("config"), "qid", "id", "rank"))
    lab = vectors(spark, sf).select("id", "label")
    both = both.join(lab, "id").join(lab.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid")
    same = F.col("label") == F.col("ql")
    return both.groupBy("config", "qid").agg(F.avg(F.when(same, 1.0).otherwise(0.0)).alias("p5"), F.coalesce(F.max(F.when(same & (F.col("qid") != F.col("id")), 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))


@query("config_means", f"with {_CONF} select config, count(*) n, round(avg(p5), 6) p5, round(avg(rr), 6) mrr from conf group by config")
def config_means(spark, sf):
    return configurations(spark, sf).groupBy("config").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p5"), "p5"), r6(F.avg("rr"), "mrr"))


@query("wilcoxon_pairs", f"""with {_CONF}, p as (select a.qid, round(a.rr - b.rr, 12) d from conf a join conf b on a.qid = b.qid where a.config = 'dense' and b.config = 'head'),
nz as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 r, count(*) over (partition by abs(d)) t from p where d <> 0),
a as (select sum(case when d > 0 then r else 0 end)::double wp, sum(case when d < 0 then r else 0 end)::double wm, count(*)::double n, sum(t * t - 1)::double tt from nz)
select (select count(*) from p where d > 1e-12) win, (select count(*) from p where d < -1e-12) loss, (select count(*) from p where abs(d) <= 1e-12) tie, least(wp, wm) w,
round((least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tt / 48), 6) z from a""")
def wilcoxon_pairs(spark, sf):
    c = configurations(spark, sf)
    p = c.where("config = 'dense'").select("qid", F.col("rr").alias("a")).join(c.where("config = 'head'").select("qid", F.col("rr").alias("b")), "qid").withColumn("g", F.lit(1))
    return E.wilcoxon(p, ["g"]).select("win", "loss", "tie", "w", r6("z", "z"))


@query("leak_rate", f"with {bm25_ctes()} select count(*) n_hits, count(*) filter (id in (select doc_id from labels where toxic = 1)) n_internal from ranked where rank <= 5")
def leak_rate(spark, sf):
    """Hits of internal documents when the filter is left off."""
    internal = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).distinct().withColumn("x", F.lit(1))
    return lexical(spark, sf, 5).join(internal, "id", "left").agg(F.count(F.lit(1)).alias("n_hits"), F.count("x").alias("n_internal"))


@query("minmax_blend", f"""with {bm25_ctes()}, t as (select qid, id, score, min(score) over w lo, max(score) over w hi from ranked where rank <= 20 window w as (partition by qid)),
m as (select t.*, coalesce((score - lo) / nullif(hi - lo, 0), 1) s, (select len(list_distinct(toks)) / nullif(len(toks), 0)::double from tok2 where tok2.id = t.id) info from t)
select qid, id, round(s * (0.55 + 0.45 * coalesce(info, 0)), 6) score from m""")
def minmax_blend(spark, sf):
    """First-stage scores scaled to [0, 1] per question and weighted by how varied the passage's words are."""
    from pyspark.sql import Window

    w = Window.partitionBy("qid")
    t = lexical(spark, sf, 20).withColumn("lo", F.min("score").over(w)).withColumn("hi", F.max("score").over(w))
    info = passages(spark, sf).select("id", T.tokens(F.col("text")).alias("t")).select("id", (F.size(F.array_distinct("t")) / F.nullif(F.size("t"), F.lit(0))).alias("info"))
    s = F.coalesce((F.col("score") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1.0))
    return t.join(info, "id").select("qid", "id", r6(s * (0.55 + 0.45 * F.coalesce("info", F.lit(0.0))), "score"))


@query("context_packing", f"with {bm25_ctes()}, run as (select qid, id, rank, n_chars, sum(n_chars) over (partition by qid order by rank) total from ranked join documents on doc_id = id where rank <= 10) select qid, id, rank::int rank, total::bigint total from run where rank = 1 or total <= 6000")
def context_packing(spark, sf):
    """Hits in order until 6,000 characters; the first always stays."""
    from pyspark.sql import Window

    t = lexical(spark, sf, 10).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id")
    return t.withColumn("total", F.sum("n_chars").over(Window.partitionBy("qid").orderBy("rank"))).where("rank = 1 or total <= 6000").select("qid", "id", "rank", "total")


@query("best_sentences", rf"""with {bm25_ctes()}, top as (select qid, id from ranked where rank <= 3), s as (select qid, id, unnest({T.sentences_sql('d.text')}) sent, generate_subscripts({T.sentences_sql('d.text')}, 1) pos from top join documents d on d.doc_id = id),
qs as (select item_id qid, {T.token_set_sql('text')} qset from benchmark),
o as (select qid, id, pos, len(list_intersect(qset, {T.token_set_sql('sent')})) overlap from s join qs using (qid))
select qid, id, pos::int pos, overlap::int overlap from o where overlap > 0 qualify row_number() over (partition by qid order by overlap desc, id, pos) <= 2""")
def best_sentences(spark, sf):
    """Extractive answers: the two sentences of the three best passages that share most words with the question."""
    from pyspark.sql import Window

    top = lexical(spark, sf, 3).join(passages(spark, sf), "id")
    qs = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), T.token_set(F.col("text")).alias("qset"))
    s = top.select("qid", "id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sent")).join(qs, "qid")
    s = s.withColumn("overlap", F.size(F.array_intersect("qset", T.token_set(F.col("sent"))))).where("overlap > 0").withColumn("pos", F.col("pos") + 1)
    return s.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("overlap").desc(), "id", "pos"))).where("n <= 2").select("qid", "id", "pos", "overlap")


# Hybrid search: BM25 with expansion over documents, and vectors of the same ids; a question's vector is that of its number.
_QVEC = "qv as (select b.item_id qid, e.embedding v from benchmark b join embeddings e on e.vec_id = b.item_id)"
_DENSE_Q = """dpairs as (select qid, e.vec_id id, round(list_inner_product(v::double[], e.embedding::double[]), 9) score from qv, embeddings e where e.vec_id in (select id from allowed)),
drank as (select *, row_number() over (partition by qid order by score desc, id) rank from dpairs)"""


def question_vectors(spark, sf):
    v = vectors(spark, sf).select(F.col("id").alias("qid"), "v")
    return questions(spark, sf).select("qid").join(v, "qid")


def hybrid_ctes(terms=_EXPAND, k="60"):
    return f"""{ALLOWED}, {bm25_ctes('where id in (select id from allowed)', terms)}, {_QVEC}, {_DENSE_Q},
fused as (select qid, id, sum(1.0::double / ({k} + rank)) score, max(lr) rank_lexical, max(dr) rank_dense from (select qid, id, rank, rank lr, null dr from ranked where rank <= 50 union all select qid, id, rank, null, rank from drank where rank <= 50) group by 1, 2),
hybrid as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) rank from fused)"""


@query("hybrid_topk", f"with {hybrid_ctes()} select qid, id, rank::int rank, round(score, 6) score, rank_lexical::int rank_lexical, rank_dense::int rank_dense from hybrid where rank <= 5")
def hybrid_topk(spark, sf):
    """The search itself: authorised passages, the 50 best by BM25 with expansion and by vectors, fused by reciprocal ranks."""
    out = R.search(index(spark, sf), vectors(spark, sf).select("id", "v"), expanded_terms(spark, sf), question_vectors(spark, sf), "hybrid", authorised(spark, sf))
    return IX.kept(out.select("qid", "id", "rank", r6("score", "score"), "rank_lexical", "rank_dense"), "hybrid")


#: Configurations of the evaluation: name, mode, constant of the fusion, expansion.
CONFIGURATIONS = [("lexical", "lexical", 60, True), ("dense", "dense", 60, True), *((f"hybrid_k{k}", "hybrid", k, True) for k in (10, 20, 60)), ("hybrid_plain", "hybrid", 60, False), ("lexical_plain", "lexical", 60, False)]


def configuration_hits(spark, sf):
    """(config, qid, id, rank) of the ten best in each configuration. Each channel is ranked once, and its ranking kept as a table."""
    allowed, ix, v = authorised(spark, sf), index(spark, sf), vectors(spark, sf).select("id", "v")
    plain, more = R.question_terms(table(spark, sf, "benchmark")), expanded_terms(spark, sf)
    lex = {x: IX.kept(R.bm25_top_k(ix, more if x else plain, 50, allowed).select("qid", "id", "rank"), f"lexical-{x}") for x in (True, False)}
    dense_ = IX.kept(R.dense_top_k(v.join(allowed, "id", "left_semi"), question_vectors(spark, sf), 50).select("qid", "id", "rank"), "dense")
    out = None
    for name, mode, k, more_ in CONFIGURATIONS:
        hits = lex[more_] if mode == "lexical" else dense_ if mode == "dense" else R.rrf([lex[more_], dense_], k, 10)
        hits = hits.where("rank <= 10").select(F.lit(name).alias("config"), "qid", "id", "rank")
        out = hits if out is None else out.unionByName(hits)
    return out


def _configuration_sql():
    lex = "select '{}' config, qid, id, rank from {} where rank <= 10"
    hyb = "select '{}' config, qid, id, row_number() over (partition by qid order by round(score, 9) desc, id) rank from (select qid, id, sum(1.0::double / ({} + rank)) score from (select qid, id, rank from {} where rank <= 50 union all select qid, id, rank from drank where rank <= 50) group by 1, 2) qualify rank <= 10"
    plain = """pscores as (select qid, id, sum(weight * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score from tf join idf using (term) join q using (term) group by 1, 2),
pranked as (select qid, id, score, row_number() over (partition by qid order by round(score, 9) desc, id) rank from pscores where score > 0)"""
    parts = [lex.format(n, "ranked" if x else "pranked") if m == "lexical" else lex.format(n, "drank") if m == "dense" else hyb.format(n, k, "ranked" if x else "pranked") for n, m, k, x in CONFIGURATIONS]
    return f"{_GOLD}, {ALLOWED}, {bm25_ctes('where id in (select id from allowed)', _EXPAND)}, {plain}, {_QVEC}, {_DENSE_Q}, hits as ({' union all '.join(parts)})"


# A question's relevant pages are those of documents that hold it; documents of one source follow one another, ten to a file,
# as its pages. A passage covers its page and the next; it is relevant if it covers a relevant page of the same file.
_PAGES = "pages_ as (select doc_id id, doc_id // 10 as file_, (doc_id % 10)::int pg from documents), want as (select distinct qid, file_, pg wanted from gold join pages_ using (id)), np as (select qid, count(*) n from want group by 1)"


def relevant_pages(spark, sf):
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 10).alias("file"), (F.col("doc_id") % 10).cast("int").alias("page"))
    return p, gold(spark, sf).join(p, "id").groupBy("qid", "file").agg(F.collect_set("page").alias("pages"))


@query("evaluation_configurations", f"""with {_configuration_sql()}, {_PAGES},
j as (select config, h.qid, rank, exists (select 1 from want w where w.qid = h.qid and w.file_ = p.file_ and w.wanted between p.pg and p.pg + 1) rel from hits h join pages_ p using (id) where h.qid in (select qid from np)),
m as (select config, qid, max(case when rel and rank <= 1 then 1.0 else 0.0 end) s1, max(case when rel and rank <= 5 then 1.0 else 0.0 end) s5, coalesce(max(case when rel then 1.0::double / rank end), 0) rr, sum(case when rel and rank <= 5 then 1 / log2(rank + 1) else 0 end) / (select sum(1 / log2(i + 1)) from (select unnest(range(1, 6)) i) where i <= greatest(1, np.n)) ndcg from j join np using (qid) group by config, qid, np.n)
select config, count(*) n, round(avg(s1), 4)::double success_1, round(avg(s5), 4)::double success_5, round(avg(rr), 4) mrr, round(avg(ndcg), 4) ndcg_5 from m group by 1""")
def evaluation_configurations(spark, sf):
    """Seven configurations by page-interval relevance: means of success at 1 and 5, reciprocal rank and nDCG."""
    pages, want = relevant_pages(spark, sf)
    j = E.relevant(configuration_hits(spark, sf).join(pages, "id").withColumn("page_end", F.col("page") + 1), want)
    return E.configuration_means(j, want)


#: Two-sided p of a signed-rank statistic, exact up to 50 differences without ties and zeros, else by the normal distribution.
_P = """dist as (select 0 k, [1.0::double] ways union all select k + 1, list_transform(range(len(ways) + k + 1), lambda i: coalesce(ways[i + 1], 0) + case when i - k >= 1 then ways[i - k] else 0 end) from dist where k < 50),
tested as (select t.*, (least(wp, wm) - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - tt / 48), 0) z from t),
series as (select *, abs(z) / sqrt(2) x from tested),
normal as (select *, case when x = 0 then 1.0 when x > 6 then 0.0 else 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 200), lambda i: exp(i * ln(2.0) + (2 * i + 1) * ln(x) - (lgamma(2 * i + 2.0) - i * ln(2.0) - lgamma(i + 1.0))))) end pn from series),
valued as (select *, case when tie = 0 and tt = 0 and n <= 50 then least(1.0, 2 * (select list_sum(ways[1:floor(least(wp, wm))::int + 1]) from dist where k = normal.n) / pow(2, n)) else pn end p from normal)"""


@query("evaluation_tests", f"""with recursive {_configuration_sql()}, {_PAGES},
j as (select config, h.qid, rank, exists (select 1 from want w where w.qid = h.qid and w.file_ = p.file_ and w.wanted between p.pg and p.pg + 1) rel from hits h join pages_ p using (id) where h.qid in (select qid from np)),
m as (select config, qid, max(case when rel and rank <= 5 then 1.0 else 0.0 end)::double s5, coalesce(max(case when rel then 1.0::double / rank end), 0) rr from j group by 1, 2),
p as (select b.config other, metric, round(case metric when 's5' then a.s5 - b.s5 else a.rr - b.rr end, 12) d from m a join m b on a.qid = b.qid and a.config = 'hybrid_k60' and b.config in ('lexical', 'dense'), (select unnest(['s5', 'rr']) metric)),
nz as (select other, metric, d, rank() over (partition by other, metric order by abs(d)) + (count(*) over (partition by other, metric, abs(d)) - 1) / 2.0 r, count(*) over (partition by other, metric, abs(d)) t from p where d <> 0),
s as (select other, metric, sum(case when d > 0 then r else 0 end)::double wp, sum(case when d < 0 then r else 0 end)::double wm, count(*)::double n, sum(t * t - 1)::double tt from nz group by 1, 2),
c as (select other, metric, count(*) filter (d > 1e-12) win, count(*) filter (d < -1e-12) loss, count(*) filter (abs(d) <= 1e-12) tie from p group by 1, 2),
t as (select c.*, wp, wm, n, tt from c left join s using (other, metric)), {_P}
select other, metric, win, loss, tie, least(wp, wm) w, round(p, 6) p from valued""")
def evaluation_tests(spark, sf):
    """The hybrid search against each channel alone, on two measures: wins, losses and ties of the paired questions, the
    statistic of the signed-rank test and its p."""
    pages, want = relevant_pages(spark, sf)
    j = E.relevant(configuration_hits(spark, sf).where("config in ('hybrid_k60', 'lexical', 'dense')").join(pages, "id").withColumn("page_end", F.col("page") + 1), want)
    m = j.groupBy("config", "qid").agg(F.max(F.when(F.col("rel") & (F.col("rank") <= 5), 1.0).otherwise(0.0)).alias("s5"), F.coalesce(F.max(F.when(F.col("rel"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    long = m.select("config", "qid", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("x")) for n in ("s5", "rr")])))
    a = long.where("config = 'hybrid_k60'").select("qid", "metric", F.col("x").alias("a"))
    pairs = a.join(long.where("config <> 'hybrid_k60'").select(F.col("config").alias("other"), "qid", "metric", F.col("x").alias("b")), ["qid", "metric"])
    return E.wilcoxon(pairs, ["other", "metric"]).select("other", "metric", "win", "loss", "tie", "w", r6("p", "p"))
