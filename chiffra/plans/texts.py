"""Text, number and ingestion queries over documents, pages, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chiffra.functions import numbers as N
from chiffra.functions import text as T
from chiffra.operators import evaluation as E
from chiffra.operators import ingestion as I
from chiffra.plans.base import query, r6, table


@query("tokenize", f"select doc_id, len(t) n_tokens, len(list_distinct(t)) n_distinct, array_to_string(t[1:5], ' ') head from (select doc_id, {T.tokens_sql('text')} t from documents)")
def tokenize(spark, sf):
    t = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query("normalize_accents", f"select doc_id, md5({T.normalised_sql('text')}) digest from documents")
def normalize_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalised(F.col("text")).cast("binary")).alias("digest"))


@query("token_count", r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]')) n_tokens from documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query("sentence_split", f"select doc_id, len(s) n_sentences, list_max(list_transform(s, lambda x: len(x))) longest from (select doc_id, {T.sentences_sql('text')} s from documents)")
def sentence_split(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


# French writings of order totals, in four spellings, and back.
_WRITING = """replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', case o_orderkey % 3 when 0 then ' ' when 1 then chr(160) else chr(8239) end) || case when o_orderkey % 5 = 0 then ' %' else '' end"""


def writings(spark, sf):
    o = table(spark, sf, "orders")
    gap = F.when(F.col("o_orderkey") % 3 == 0, " ").when(F.col("o_orderkey") % 3 == 1, " ").otherwise(" ")
    w = F.replace(F.replace(F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit("#")), F.lit("."), F.lit(",")), F.lit("#"), gap)
    return o.select("o_orderkey", "o_totalprice", F.concat(w, F.when(F.col("o_orderkey") % 5 == 0, " %").otherwise("")).alias("writing"))


@query("parse_french_number", "select o_orderkey, round(o_totalprice, 2) as \"value\", 0.0::double as gap from orders")
def parse_french_number(spark, sf):
    """A round trip: the writing parses back to the number."""
    w = writings(spark, sf).withColumn("value", N.parsed(F.col("writing")))
    return w.select("o_orderkey", F.round("value", 2).alias("value"), F.round(F.abs(F.col("value") - F.round("o_totalprice", 2)), 6).alias("gap"))


@query("format_french_number", "select o_orderkey, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', ' ') writing from orders")
def format_french_number(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.formatted(F.col("o_totalprice"), 2).alias("writing"))


_ODD = "case o_orderkey % 4 when 0 then (o_orderkey % 900 + 1) || '.500' when 1 then (o_orderkey % 900 + 1) || ',5' when 2 then '1.' || lpad((o_orderkey % 1000)::varchar, 3, '0') || '.250' else (o_orderkey % 900 + 1) || ' 250,75' end"


@query("number_forms", f"""with w as (select o_orderkey k, o_orderkey % 4 m, {_ODD} w from orders)
select k o_orderkey, w writing, case m when 0 then 2 else 1 end n_forms,
round(case m when 0 then replace(w, '.500', '.5')::double when 1 then replace(w, ',', '.')::double when 2 then replace(w, '.', '')::double else replace(replace(w, ' ', ''), ',', '.')::double end, 6) low from w""")
def number_forms(spark, sf):
    k = F.col("o_orderkey")
    n = (k % 900 + 1).cast("string")
    w = F.when(k % 4 == 0, F.concat(n, F.lit(".500"))).when(k % 4 == 1, F.concat(n, F.lit(",5"))).when(k % 4 == 2, F.concat(F.lit("1."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".250"))).otherwise(F.concat(n, F.lit(" 250,75")))
    f = table(spark, sf, "orders").select("o_orderkey", w.alias("writing")).withColumn("f", N.forms(F.col("writing")))
    return f.select("o_orderkey", "writing", F.size("f").alias("n_forms"), F.round(F.array_min("f").cast("double"), 6).alias("low"))


@query("boilerplate_lines", """with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents), n as (select doc_id, regexp_replace(trim(line), '[0-9]+', '#', 'g') norm from l where len(trim(line)) between 1 and 90)
select norm, count(distinct doc_id) n_docs from n group by norm having count(distinct doc_id) >= 3""")
def boilerplate_lines(spark, sf):
    """Short lines, digits masked, that recur over at least three documents."""
    return I.recurring_lines(table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")), "doc_id", 3)


@query("boilerplate_removed", """with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents), n as (select doc_id, line, case when len(trim(line)) between 1 and 90 then regexp_replace(trim(line), '[0-9]+', '#', 'g') end norm from l),
b as (select norm from n where norm is not null group by norm having count(distinct doc_id) >= 3) select doc_id, count(*) n_lines, count(*) filter (norm is null or norm not in (select norm from b)) n_left from n group by doc_id""")
def boilerplate_removed(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    known = I.recurring_lines(lines, "doc_id", 3).select("norm", F.lit(1).alias("b"))
    marked = lines.withColumn("norm", I.masked_line(F.col("line"))).join(known, "norm", "left")
    return marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("b").isNull()).alias("n_left"))


@query("toc_flag", r"select doc_id, len(regexp_extract_all(text, '[.|]\s*\n|\.{4,}')) leaders, len(string_split(text, chr(10))) n_lines, len(regexp_extract_all(text, '[.|]\s*\n|\.{4,}')) >= 5 or 4 * len(regexp_extract_all(text, '[.|]\s*\n|\.{4,}')) > len(string_split(text, chr(10))) is_toc from documents")
def toc_flag(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[.|]\s*\n|\.{4,}")).cast("long").alias("leaders"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    return d.withColumn("is_toc", (F.col("leaders") >= 5) | (4 * F.col("leaders") > F.col("n_lines")))


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)</(p|div|li|h[1-6]|tr|title)>|<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"""


@query("html_lines", f"select page_id, count(*) n_lines, sum(len(trim(line)))::bigint n_chars from (select page_id, unnest(string_split({_HTML}, chr(10))) line from pages) where len(trim(line)) > 0 group by page_id")
def html_lines(spark, sf):
    lines = I.html_lines(table(spark, sf, "pages"))
    return lines.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("token_windows")
def token_windows(spark, sf):
    """Greedy windows of 400 to 800 tokens with 15 % overlap, by document."""
    d = table(spark, sf, "documents")
    return I.windows_of_counts(d.select("doc_id", F.transform(F.split("text", "\n"), lambda x: T.token_count(x).cast("int")).alias("counts")), "doc_id", 400, 800, 0.15)


@query("fixed_windows", """with w as (select doc_id, regexp_extract_all(text, '[^ \t\n\r\v\f]+') w from documents), i as (select doc_id, w, unnest(range(greatest(1, ((len(w) - 40 + 139) // 140))::bigint)) n from w where len(w) > 0)
select doc_id, n window_no, len(w[n * 140 + 1: n * 140 + 180]) n_words, md5(array_to_string(w[n * 140 + 1: n * 140 + 180], ' ')) digest from i""")
def fixed_windows(spark, sf):
    """Windows of 180 words every 140."""
    w = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\x0B\f]+"), 0).alias("w")).where("size(w) > 0")
    n = F.greatest(F.lit(1), F.floor((F.size("w") - 40 + 139) / 140)).cast("int")
    w = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("n")).withColumn("s", F.expr("slice(w, n * 140 + 1, 180)"))
    return w.select("doc_id", F.col("n").cast("long").alias("window_no"), F.size("s").cast("long").alias("n_words"), F.md5(F.array_join("s", " ").cast("binary")).alias("digest"))


# A heading is a line of at most three words.
_LINES = r"lines as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 n from documents), h as (select doc_id, n, line, len(regexp_extract_all(line, '[^ ]+')) <= 3 and len(trim(line)) > 0 head from lines)"


def _headed(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.withColumn("head", (F.regexp_count("line", F.lit("[^ ]+")) <= 3) & (F.length(F.trim("line")) > 0))


@query("chapter_carry_forward", f"with {_LINES} select doc_id, chapter, count(*) n_lines from (select doc_id, coalesce(last_value(case when head then line end ignore nulls) over (partition by doc_id order by n rows between unbounded preceding and current row), '') chapter from h) group by 1, 2")
def chapter_carry_forward(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    h = _headed(spark, sf).withColumn("chapter", F.coalesce(F.last(F.when(F.col("head"), F.col("line")), ignorenulls=True).over(w), F.lit("")))
    return h.groupBy("doc_id", "chapter").agg(F.count(F.lit(1)).alias("n_lines"))


@query("gaps_islands", "with c as (select conv_id, turn, role, case when role = lag(role) over (partition by conv_id order by turn, text) then 0 else 1 end b, text from conversations), i as (select *, sum(b) over (partition by conv_id order by turn, text rows unbounded preceding) island from c) select conv_id, island::bigint island, role, count(*) n_turns from i group by all")
def gaps_islands(spark, sf):
    """Runs of turns of one role."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    c = table(spark, sf, "conversations").withColumn("b", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1))
    i = c.withColumn("island", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("conv_id", "island", "role").agg(F.count(F.lit(1)).alias("n_turns"))


@query("gap_clusters", "with v as (select user_id, value, event_id, case when value - lag(value) over w <= 5 then 0 else 1 end b from events window w as (partition by user_id order by value, event_id)), c as (select user_id, value, sum(b) over (partition by user_id order by value, event_id rows unbounded preceding) cluster from v) select user_id, cluster::bigint cluster, count(*) n, round(min(value), 6) low, round(max(value), 6) high from c group by 1, 2")
def gap_clusters(spark, sf):
    """One-dimensional clusters cut where neighbours are more than 5 apart."""
    c = I.gap_clusters(table(spark, sf, "events"), ["user_id"], "value", "event_id", 5.0)
    return c.groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"), r6(F.min("value"), "low"), r6(F.max("value"), "high"))


@query("asof_caption", "with cap as (select user_id, ts, event_id from events where event_type = 'signup' qualify row_number() over (partition by user_id, ts order by event_id desc) = 1), v as (select event_id, user_id, ts from events where event_type = 'purchase') select v.event_id, cap.event_id caption_id from v asof left join cap on v.user_id = cap.user_id and v.ts >= cap.ts")
def asof_caption(spark, sf):
    """Each purchase with the user's last signup at or before it: one window over both, no range join."""
    e = table(spark, sf, "events").where("event_type in ('signup', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "purchase").cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("caption_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'purchase'").select("event_id", "caption_id")


@query("title_jaccard", f"""with p as (select title, {T.token_set_sql("title")} s from (select distinct p_name || ' ' || p_type title from part)) select a.title a, b.title b, round({T.jaccard_sql('a.s', 'b.s')}, 6) sim from p a join p b on a.title < b.title where {T.jaccard_sql('a.s', 'b.s')} >= 0.5""")
def title_jaccard(spark, sf):
    """Pairs of different titles with a similarity of 0.5 or more; only titles that share a word meet."""
    p = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("title")).distinct().withColumn("s", T.token_set(F.col("title")))
    return I.similar_titles(p, 0.5).select("a", "b", r6("sim", "sim"))


@query("rouge_l")
def rouge_l(spark, sf):
    """ROUGE-L of each turn against the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    c = table(spark, sf, "conversations").withColumn("prev", F.lag("text").over(w)).where("prev is not null")
    return c.select("conv_id", "turn", F.round(E.rouge_l(E.words(F.col("text")), E.words(F.col("prev"))), 6).alias("rouge_l"))


_WORDS = lambda x: f"regexp_extract_all({T.normalised_sql(x)}, '[a-z0-9]+')"


@query("rouge_1_recall", f"with c as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn, text) prev from conversations) select conv_id, turn, round(coalesce(len(list_intersect(list_distinct({_WORDS('prev')}), {_WORDS('text')})) / nullif(len(list_distinct({_WORDS('prev')})), 0)::double, 0), 6) recall from c where prev is not null")
def rouge_1_recall(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    c = table(spark, sf, "conversations").withColumn("prev", F.lag("text").over(w)).where("prev is not null")
    return c.select("conv_id", "turn", r6(E.rouge_n_recall(E.words(F.col("text")), E.words(F.col("prev")), 1), "recall"))
