"""Reranking, reading worklists, confidence, faithfulness and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chiffra.functions import text as T
from chiffra.operators import encoder as EN
from chiffra.operators import pairing as PG
from chiffra.operators import retrieval as R
from chiffra.operators import tables as TB
from chiffra.plans import retrieval as PR
from chiffra.plans.base import passages, query, r6, table


@query("feature_rerank", f"""with {PR.bm25_ctes()}, df2 as (select term, ln((1 + n) / (1 + df)) + 1 w from df, stats), top as (select qid, id from ranked where rank <= 20),
qt as (select qid, term, coalesce(w, 1) w from q left join df2 using (term)), dt as (select id, unnest(list_distinct(toks)) term from tok2 where id in (select id from top)),
cov as (select top.qid, top.id, sum(case when dt.term is not null then w else 0 end) / sum(w) coverage from top join qt using (qid) left join dt on dt.id = top.id and dt.term = qt.term group by 1, 2),
qtoks as (select item_id qid, {T.tokens_sql('text')} t, {T.normalised_sql('text')} qn, list_distinct(regexp_extract_all(text, '[0-9]+')) nums from benchmark), bg as (select qid, t[i] || ' ' || t[i + 1] b from (select qid, t, unnest(range(1, len(t))) i from qtoks)),
ph as (select top.qid, top.id, count(*) n from top join bg using (qid) join documents d on d.doc_id = top.id where contains({T.normalised_sql('d.text')}, b) group by 1, 2),
ex as (select top.qid, top.id, len(nums) k, len(list_filter(nums, lambda x: contains({T.normalised_sql('d.text')}, x))) m, contains(qn, substr({T.normalised_sql('d.text')}, 1, 12)) sec, regexp_matches(d.text, '[0-9]{{3}}') tab from top join qtoks using (qid) join documents d on d.doc_id = top.id),
s as (select qid, id, coverage + 0.15 * coalesce(n, 0) + coalesce(0.3 * m / nullif(k, 0)::double, 0) + case when sec then 0.1 else 0 end + case when k > 0 and tab then 0.05 else 0 end score from cov left join ph using (qid, id) join ex using (qid, id))
select qid, id, round(score, 6) score, row_number() over (partition by qid order by round(score, 9) desc, id)::int rank from s qualify row_number() over (partition by qid order by round(score, 9) desc, id) <= 5""")
def feature_rerank(spark, sf):
    """The twenty best of the first stage by idf-weighted coverage of the question's words, 0.15 for each of its word pairs
    that stands in the passage, 0.3 for the share of its numbers that do, 0.1 if it names the passage's section (here the
    passage's first twelve characters), and 0.05 for a passage with figures if it asks for some."""
    p, ix = passages(spark, sf), PR.index(spark, sf)
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), T.tokens(F.col("text")).alias("qt"), T.normalised(F.col("text")).alias("qn"), F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("nums"))
    top = PR.lexical(spark, sf, 20).select("qid", "id")
    idf = ix.terms.crossJoin(F.broadcast(ix.stats)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("w"))  # one row of statistics
    w = q.select("qid", F.explode(F.array_distinct("qt")).alias("term")).join(idf, "term", "left").groupBy("qid").agg(F.collect_list(F.struct("term", F.coalesce("w", F.lit(1.0)).alias("w"))).alias("ws"))
    pairs = F.when(F.size("qt") > 1, F.transform(F.sequence(F.lit(1), F.size("qt") - 1), lambda i: F.concat(F.get("qt", i - 1), F.lit(" "), F.get("qt", i)))).otherwise(F.array().cast("array<string>"))
    x = top.join(p.select("id", "text", T.normalised(F.col("text")).alias("norm"), F.array_distinct(T.tokens(F.col("text"))).alias("t")), "id").join(q, "qid").join(w, "qid")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y["w"])
    coverage = total(F.filter("ws", lambda y: F.array_contains("t", y["term"]))) / total(F.col("ws"))
    held = lambda a: F.size(F.filter(a, lambda b: F.contains(F.col("norm"), b)))
    numbers = F.coalesce(0.3 * held(F.col("nums")) / F.nullif(F.size("nums"), F.lit(0)), F.lit(0.0))
    section = F.when(F.contains("qn", F.substr("norm", F.lit(1), F.lit(12))), 0.1).otherwise(0.0)
    figures = F.when((F.size("nums") > 0) & F.col("text").rlike("[0-9]{3}"), 0.05).otherwise(0.0)
    s = x.withColumn("score", coverage + 0.15 * held(pairs) + numbers + section + figures)
    return R.top_k(s, 5, "qid", "id").select("qid", "id", r6("score", "score"), "rank")


@query("reviewer_worklist", """with p as (select doc_id chart, source g, case when doc_id % 7 = 0 then 'valid' when doc_id % 11 = 0 then 'rejected' else 'candidate' end status from documents), r as (select distinct doc_id chart from labels where quality = 1)
select g as "group", chart, row_number() over (partition by g order by chart)::int as "position" from p where status = 'candidate' and chart not in (select chart from r)""")
def reviewer_worklist(spark, sf):
    """What one reader has not read yet of what is still open, in order; another reader's readings do not count."""
    d = table(spark, sf, "documents")
    status = F.when(F.col("doc_id") % 7 == 0, "valid").when(F.col("doc_id") % 11 == 0, "rejected").otherwise("candidate")
    p = d.select(F.col("source").alias("group"), F.col("doc_id").alias("chart"), status.alias("status"))
    r = table(spark, sf, "labels").select(F.col("doc_id").alias("chart"), F.when(F.col("quality") == 1, " Anne ").otherwise("Paul").alias("reader"))
    return PG.worklist(p, r, "ANNE")


@query("encoder_neighbours")
def encoder_neighbours(spark, sf):
    """The most similar other title of each title by the offline encoder, learned from these titles. The axes of a
    decomposition have no SQL; unit tests hold what the vectors must satisfy."""
    t = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("text")).distinct().select(F.xxhash64("text").alias("id"), "text")
    v = EN.Encoder(dims=8).fit(t).encode(t)
    near = R.dense_top_k(v, v.select(F.col("id").alias("qid"), "v"), 2).where("qid <> id")
    return near.groupBy("qid").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b")).select("qid", "b.id", r6("b.score", "score"))


@query("human_override", "select d.doc_id, coalesce(nullif(case when l.quality = 0 then 'rejected' else '' end, ''), case when n_chars >= 600 then 'candidate' else 'to check' end) status from documents d left join labels l using (doc_id)")
def human_override(spark, sf):
    """Non-empty human decisions over proposals."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    human = F.nullif(F.when(F.col("quality") == 0, "rejected").otherwise(""), F.lit(""))
    return d.select("doc_id", F.coalesce(human, F.when(F.col("n_chars") >= 600, "candidate").otherwise("to check")).alias("status"))


@query("upper_median", "select user_id, value as \"median\" from (select user_id, value, row_number() over (partition by user_id order by value) r, count(*) over (partition by user_id) n from events) where r = n // 2 + 1")
def upper_median(spark, sf):
    return TB.upper_median(table(spark, sf, "events"), ["user_id"], "value")


@query("context_confidence", r"select conv_id, round(least(1.0, 0.5 * least(count(*), 2) / 2 + 0.5 * least(sum(len(regexp_extract_all(text, '[^ \t\n\r]+'))), 60) / 60), 4)::double confidence from conversations where role = 'assistant' group by conv_id")
def context_confidence(spark, sf):
    """Support by the number of earlier texts and their length, saturating."""
    c = table(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.regexp_count("text", F.lit(r"[^ \t\n\r]+"))).alias("w"))
    return c.select("conv_id", F.round(F.least(F.lit(1.0), 0.5 * F.least("n", F.lit(2)) / 2 + 0.5 * F.least("w", F.lit(60)) / 60), 4).alias("confidence"))


_SET = lambda x: T.token_set_sql(x)


@query("faithfulness", f"with c as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn, text) prev from conversations), s as (select conv_id, turn, {_SET('text')} a, {_SET('prev')} b from c where prev is not null) select conv_id, turn, len(list_intersect(a, b)) * 2 >= len(a) and len(a) > 0 supported from s")
def faithfulness(spark, sf):
    """Whether at least half of a turn's words stand in the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    c = table(spark, sf, "conversations").withColumn("prev", F.lag("text").over(w)).where("prev is not null").select("conv_id", "turn", T.token_set(F.col("text")).alias("a"), T.token_set(F.col("prev")).alias("b"))
    return c.select("conv_id", "turn", ((F.size(F.array_intersect("a", "b")) * 2 >= F.size("a")) & (F.size("a") > 0)).alias("supported"))


@query("standard_error", "select event_type, count(*) n, round(avg(value), 6) mean, round(stddev_samp(value) / sqrt(count(*)), 6) se from events group by 1")
def standard_error(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"), r6(F.stddev_samp("value") / F.sqrt(F.count(F.lit(1))), "se"))


@query("style_model", f"with t as (select conv_id, turn, role, text, {_SET('text')} s from conversations), p as (select a.conv_id, a.turn, b.turn model, {T.jaccard_sql('a.s', 'b.s')} sim from t a join t b on a.conv_id = b.conv_id and b.turn < a.turn) select conv_id, turn, model, round(sim, 6) sim from p where sim > 0.05 qualify row_number() over (partition by conv_id, turn order by round(sim, 9) desc, model) = 1")
def style_model(spark, sf):
    """The most similar earlier turn of a conversation, if any is similar at all."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", T.token_set(F.col("text")).alias("s"))
    a, b = t.alias("a"), t.alias("b")
    p = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") < F.col("a.turn"))).select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.col("b.turn").alias("model"), T.jaccard_of(F.col("a.s"), F.col("b.s")).alias("sim")).where("sim > 0.05")
    best = F.max_by(F.struct("model", "sim"), F.struct(F.round("sim", 9), -F.col("model"))).alias("m")
    return p.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", "m.model", r6("m.sim", "sim"))


@query("unit_of_title", "select p_partkey, case p_partkey % 4 when 0 then '%' when 1 then 'tonnes' when 2 then '%' end unit from part")
def unit_of_title(spark, sf):
    p = table(spark, sf, "part")
    mark = F.when(F.col("p_partkey") % 4 == 0, " (en %)").when(F.col("p_partkey") % 4 == 1, " (en tonnes)").when(F.col("p_partkey") % 4 == 2, " ( % )").otherwise("")
    return p.select("p_partkey", TB.unit_of(F.concat("p_name", mark)).alias("unit"))


@query("label_blocks", r"with l as (select page_id, unnest(string_split(html, '<p>')) line from pages), x as (select page_id, len(regexp_extract_all(line, '[^ \t\n\r\v\f]+')) w, line from l) select page_id, count(*) n_lines, sum(w) < 8 or avg(case when w <= 3 or regexp_matches(line, '^[0-9 \t\n.,%()-]+$') then 1.0 else 0.0 end) >= 0.6 is_labels from x group by page_id")
def label_blocks(spark, sf):
    lines = table(spark, sf, "pages").select("page_id", F.explode(F.split("html", "<p>")).alias("line"))
    return TB.label_blocks(lines, ["page_id"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.bool_or("is_labels").alias("is_labels"))


@query("experiment_plan", "select user_id, event_id, case when (row_number() over (partition by user_id order by event_id) + user_id) % 2 = 0 then 'with' else 'without' end arm from events")
def experiment_plan(spark, sf):
    """Alternating arms per participant, opposite starts for neighbours."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", F.when((n + F.col("user_id")) % 2 == 0, "with").otherwise("without").alias("arm"))


@query("corpus_cube", "select lang, source, count(*) n, sum(n_chars)::bigint n_chars from documents group by cube (lang, source)")
def corpus_cube(spark, sf):
    """Counts by language and source with all subtotals (an addition)."""
    return table(spark, sf, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query("reject_reasons", "select coalesce(motif, 'kept') motif, count(*) n from (select case when text is null or trim(text) = '' then 'empty' when lang not in ('fr', 'en') then 'language' when len(regexp_extract_all(text, '[^ \t\n\r]+')) < 20 then 'short' end motif from documents) group by 1".replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r"))
def reject_reasons(spark, sf):
    """Validation of passages: the first broken rule names the reject."""
    from chiffra.sources.readers import valid

    good, bad = valid(table(spark, sf, "documents"), {"empty": F.trim("text") != "", "language": F.col("lang").isin("fr", "en"), "short": F.regexp_count("text", F.lit(r"[^ \t\n\r]+")) >= 20})
    return good.withColumn("motif", F.lit("kept")).unionByName(bad).groupBy("motif").agg(F.count(F.lit(1)).alias("n"))
