"""Queries over lines by their place on a page. A file is ten documents, each of them a page; lines are set evenly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chiffra.operators import layout as L
from chiffra.plans.base import query, table

_LINES = """lines as (select doc_id // 10 f, (doc_id % 10)::int pg, n, line, (n + 0.5) * 100 / total y, 100.0 h, (length(line) * 7 % 300)::double x0, (length(line) * 7 % 300 + 50)::double x1
from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 n, len(string_split(text, chr(10))) total from documents))"""
_NORM = "case when length(trim(line)) between 1 and 90 then regexp_replace(trim(line), '[0-9]+', '#', 'g') end"
_EDGE = "(y < 12 or y > 88)"
_PN = "regexp_matches(trim(line), '(?i)^(\\d{1,5}|[ivxlc]{1,5})$')"


def lines(spark, sf):
    d = table(spark, sf, "documents").withColumn("l", F.split("text", "\n"))
    x = d.select(F.floor(F.col("doc_id") / 10).alias("doc_id"), (F.col("doc_id") % 10).cast("int").alias("page"), F.posexplode("l").alias("n", "line"), F.size("l").alias("total"))
    x0 = (F.length("line") * 7 % 300).cast("double")
    return x.withColumn("y", (F.col("n") + 0.5) * 100 / F.col("total")).withColumn("height", F.lit(100.0)).withColumn("x0", x0).withColumn("x1", x0 + 50).drop("total")


_RUNNING = f"pgs as (select f, count(distinct pg) pages from lines group by 1), seen as (select f, norm, count(distinct pg) n_pages from (select *, {_NORM} norm from lines where {_EDGE}) where norm is not null group by 1, 2), running as (select f, norm, n_pages from seen join pgs using (f) where n_pages >= greatest(2, floor(0.2 * pages)))"


@query("running_headers", f"with {_LINES}, {_RUNNING} select f doc_id, norm, n_pages from running")
def running_headers(spark, sf):
    """Margin lines, digits masked, on two pages of a file and a fifth of them at least."""
    return L.running_lines(lines(spark, sf), 2, 0.2)


@query("page_furniture_removed", f"with {_LINES}, {_RUNNING}, m as (select *, case when {_EDGE} then {_NORM} end norm from lines) select f doc_id, pg page, count(*) n_lines, sum(length(line))::bigint n_chars from m where not exists (select 1 from running r where r.f = m.f and r.norm = m.norm) and not ({_EDGE} and {_PN}) group by 1, 2")
def page_furniture_removed(spark, sf):
    """What is left of each page without running lines and page numbers in its margins."""
    x = lines(spark, sf)
    return L.without_running_lines(x, L.running_lines(x, 2, 0.2)).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("outside_zones", f"with {_LINES}, z as (select distinct f, pg, 20.0 + f % 50 a, 30.0 b, 180.0 c, 40.0 + pg * 5 d from lines where pg % 3 = 0 union all select distinct f, pg, 200.0, 60.0, 320.0, 70.0 from lines where pg % 2 = 0) select f doc_id, pg page, count(*) n_lines from lines l where not exists (select 1 from z where z.f = l.f and z.pg = l.pg and (x0 + x1) / 2 between a - 2 and c + 2 and y between b - 2 and d + 2) group by 1, 2")
def outside_zones(spark, sf):
    """Lines whose centre lies in none of the table zones of their page."""
    x = lines(spark, sf).withColumn("y0", F.col("y")).withColumn("y1", F.col("y"))
    p = x.select("doc_id", "page").distinct()
    z1 = p.where("page % 3 = 0").select("doc_id", "page", (20.0 + F.col("doc_id") % 50).alias("zx0"), F.lit(30.0).alias("zy0"), F.lit(180.0).alias("zx1"), (40.0 + F.col("page") * 5).alias("zy1"))
    z2 = p.where("page % 2 = 0").select("doc_id", "page", F.lit(200.0).alias("zx0"), F.lit(60.0).alias("zy0"), F.lit(320.0).alias("zx1"), F.lit(70.0).alias("zy1"))
    return L.outside_zones(x, z1.unionByName(z2)).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_lines"))


@query("merged_numberings", """with p as (select conv_id, turn, case when turn % 3 = 1 then turn || '.' || length(text) % 4 || '.' else text end line, row_number() over (partition by conv_id order by turn, text) o from conversations), a as (select *, regexp_matches(trim(line), '^\\d+(\\.\\d+)*[.)]?$') alone from p),
g as (select *, sum(case when coalesce(pa, false) then 0 else 1 end) over (partition by conv_id order by o) g from (select *, lag(alone) over (partition by conv_id order by o) pa from a)) select conv_id, min(o)::int o, md5(string_agg(trim(line), ' ' order by o)) digest from g group by conv_id, g""")
def merged_numberings(spark, sf):
    """Numberings that stand alone, here every third turn, open the line after them."""
    c = table(spark, sf, "conversations")
    line = F.when(F.col("turn") % 3 == 1, F.concat(F.col("turn").cast("string"), F.lit("."), (F.length("text") % 4).cast("string"), F.lit("."))).otherwise(F.col("text"))
    p = c.withColumn("o", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))).withColumn("line", line)
    return L.merged_numberings(p.select("conv_id", "o", "line"), ["conv_id"], "o").select("conv_id", "o", F.md5(F.col("line").cast("binary")).alias("digest"))


_CHART = "len(regexp_extract_all(line, '[^ ]+')) between 1 and 3"


@query("attached_intros", f"with {_LINES}, c as (select f, pg, n, {_CHART} head, lead({_CHART}) over w nh, lead(n) over w nn, last_value(case when {_CHART} then n end ignore nulls) over (w rows between unbounded preceding and current row) above from lines window w as (partition by f, pg order by n)) select f doc_id, pg page, case when not head and coalesce(nh, false) then nn else above end::int chart, count(*) n_lines from c group by 1, 2, 3")
def attached_intros(spark, sf):
    """A heading of up to three words stands for a chart's caption: lines by the chart they belong to."""
    head = F.regexp_count("line", F.lit("[^ ]+")).between(1, 3)
    out = L.attached_intros(lines(spark, sf), ["doc_id", "page"], "n", head)
    return out.groupBy("doc_id", "page", "chart").agg(F.count(F.lit(1)).alias("n_lines"))


@query("continued_captions", """with t as (select user_id, event_id, date_diff('day', date '2020-01-01', ts::date) pg, (extract(hour from ts) * 60 + extract(minute from ts))::double + event_id * 1e-9 y, case when event_type = 'signup' then 'T' || event_id end title from events),
l as (select *, last_value(case when title is not null then struct_pack(t := title, p := pg) end ignore nulls) over (partition by user_id order by pg, y, event_id rows between unbounded preceding and 1 preceding) z from t)
select event_id, coalesce(title, case when y <= 432 and z.p = pg - 1 then z.t end) title from l""")
def continued_captions(spark, sf):
    """Signups carry a title, later events of the next day's first 30 % go on with it; a day is a page."""
    e = table(spark, sf, "events")
    page = F.datediff(F.col("ts").cast("date"), F.lit("2020-01-01").cast("date"))
    y = (F.hour("ts") * 60 + F.minute("ts")).cast("double") + F.col("event_id") * 1e-9
    t = e.select(F.col("user_id").alias("doc_id"), "event_id", page.alias("page"), y.alias("y"), F.lit(1440.0).alias("height"), F.when(F.col("event_type") == "signup", F.concat(F.lit("T"), F.col("event_id").cast("string"))).alias("title"))
    return L.continued_captions(t).select("event_id", "title")


_TOKEN = r"[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]"


@query("prose_of_charts", f"with {_LINES}, c as (select f, pg, n, line, len(regexp_extract_all(line, '{_TOKEN}')) t, coalesce(last_value(case when {_CHART} then n end ignore nulls) over (partition by f, pg order by n rows between unbounded preceding and current row), -1) chart from lines), r as (select *, floor((sum(t) over (partition by f, pg, chart order by n) - t) / 200)::bigint part from c) select f doc_id, pg page, chart::int chart, part, count(*) n_lines, sum(t)::bigint n_tokens, md5(string_agg(line, ' ' order by n)) digest from r group by 1, 2, 3, 4")
def prose_of_charts(spark, sf):
    """The prose of each chart, cut at 200 tokens."""
    x = lines(spark, sf)
    head = F.regexp_count("line", F.lit("[^ ]+")).between(1, 3)
    w = Window.partitionBy("doc_id", "page").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("chart", F.coalesce(F.last(F.when(head, F.col("n")), ignorenulls=True).over(w), F.lit(-1)))
    out = L.prose_of_charts(x, ["doc_id", "page", "chart"], "n", 200)
    return out.select("doc_id", "page", "chart", "part", "n_lines", "n_tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("line_classes", f"with {_LINES} select case when {_PN} then 'page number' when {_CHART} then 'heading' when length(trim(line)) = 0 then 'blank' else 'prose' end kind, {_EDGE} edge, count(*) n from lines group by 1, 2")
def line_classes(spark, sf):
    """Lines by what they look like, in the margins and elsewhere."""
    head = F.regexp_count("line", F.lit("[^ ]+")).between(1, 3)
    kind = F.when(L.is_page_number(F.col("line")), "page number").when(head, "heading").when(F.length(F.trim("line")) == 0, "blank").otherwise("prose")
    return lines(spark, sf).groupBy(kind.alias("kind"), L.in_margin(F.col("y"), F.col("height")).alias("edge")).agg(F.count(F.lit(1)).alias("n"))
