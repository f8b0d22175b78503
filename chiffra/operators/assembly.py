"""Context of an indicator, key figures and messages, checks and structure of notes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chiffra.functions import numbers as N
from chiffra.functions import text as T
from chiffra.operators import guard as G
from chiffra.operators import notes as NO


def usable_pairings(pairings: DataFrame, key: str = "edition") -> DataFrame:
    """Validated pairings of an edition; where it has none, its candidates, flagged as provisional."""
    w = Window.partitionBy(key)
    p = pairings.withColumn("__v", F.max(F.when(F.col("status") == "valid", 1).otherwise(0)).over(w))
    return p.where(F.col("status") == F.when(F.col("__v") == 1, "valid").otherwise("candidate")).withColumn("provisional", F.col("__v") == 0).drop("__v")


def with_comments(pairings: DataFrame, passages: DataFrame) -> DataFrame:
    """Pairings and the text of the published comment, null where none is known."""
    return pairings.join(passages.select(F.col("passage_id").alias("comment_id"), F.col("text").alias("comment")), "comment_id", "left")


def earlier_values(pairings: DataFrame, values: DataFrame) -> DataFrame:
    """(code, edition, value_edition, value_id): values of an indicator's tables in editions before a given one."""
    of = values.join(pairings.select(F.col("code"), F.col("edition").alias("value_edition"), "doc_id", "table"), ["doc_id", "table"])
    editions = pairings.select("code", "edition").distinct()
    return editions.join(of, "code").where(F.col("value_edition") < F.col("edition")).select("code", "edition", "value_edition", "value_id")


def code_of_table(pairings: DataFrame, tables: DataFrame) -> DataFrame:
    """(edition, table, code): the code paired with a table, a validated one first, then by score; else ``tableau-N``."""
    order = F.struct((F.col("status") == "valid").alias("valid"), F.col("score"), F.col("code"))
    best = pairings.where(F.col("status").isin("valid", "candidate")).groupBy("edition", "table").agg(F.max_by("code", order).alias("code"))
    out = tables.join(best, ["edition", "table"], "left")
    return out.withColumn("code", F.coalesce("code", F.concat(F.lit("tableau-"), F.col("table").cast("string"))))


def prioritised(values: DataFrame, keys: list[str], year: str = "edition") -> DataFrame:
    """``priority`` of a context's values: this year's, last year's, undated ones, others; totals first, then by id."""
    gap = F.col(year) - F.col("year")
    order = F.when(gap == 0, 0).when(gap == 1, 1).when(F.col("year").isNull(), 2).otherwise(3)
    total = F.when(F.lower(F.col("row")).startswith("total"), 0).otherwise(1)
    return values.withColumn("priority", F.row_number().over(Window.partitionBy(*keys).orderBy(order, total, "value_id")))


def context(values: DataFrame, variations: DataFrame, comments: DataFrame, keys: list[str], most: int = 40) -> DataFrame:
    """(keys, values, variations, models, text): the context of each indicator and edition, each list in order of priority and
    of at most ``most`` entries, and its rendering. ``values`` (row, column, year, writing, value_id), ``variations`` (row,
    ref_year, change), ``comments`` (edition of the comment, text)."""
    v = prioritised(values, keys, keys[-1]).where(F.col("priority") <= most)
    v = v.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("priority", F.concat_ws(" | ", "row", F.coalesce(F.col("year").cast("string"), F.lit("sans année"))).alias("name"), "writing"))).alias("values"))
    near = Window.partitionBy(*keys).orderBy(F.when(F.col("ref_year") == F.col(keys[-1]) - 1, 0).otherwise(1), F.col("ref_year").desc(), F.when(F.lower(F.col("row")).startswith("total"), 0).otherwise(1), "row")
    d = variations.withColumn("n", F.row_number().over(near)).where(F.col("n") <= most)
    d = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "row", "ref_year", "change"))).alias("variations"))
    m = comments.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("from_edition").desc(), "text"))).where("n <= 3")
    m = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("models"))
    out = v.join(d, keys, "full_outer").join(m, keys, "full_outer")
    part = lambda title, c, f: F.when(F.size(c) > 0, F.concat(F.lit(title + "\n"), F.array_join(F.transform(c, f), "\n")))
    text = F.concat_ws(
        "\n\n", part("Valeurs", F.col("values"), lambda x: F.concat(F.lit("- "), x["name"], F.lit(" = "), x["writing"])),
        part("Variations", F.col("variations"), lambda x: F.concat(F.lit("- "), x["row"], F.lit(" depuis "), x["ref_year"].cast("string"), F.lit(" : "), x["change"])),
        part("Modèles", F.col("models"), lambda x: F.concat(F.lit("- "), x["text"])),
    )
    return out.withColumn("text", text)


def best_of_magnitude(candidates: DataFrame, reference: DataFrame, keys: list[str], most: int = 7) -> DataFrame:
    """(keys, rank, …): evolutions by score, of each magnitude only that of its reference indicator, or else the first; at
    most ``most`` a report. ``candidates`` (keys, name, code, score), ``reference`` (keys, name, code)."""
    r = candidates.join(reference.select(*keys, "name", F.col("code").alias("__ref")), [*keys, "name"], "left")
    own = Window.partitionBy(*keys, "name").orderBy((F.col("code") == F.col("__ref")).desc_nulls_last(), F.round("score", 6).desc(), "code")
    one = r.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n", "__ref")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("score", 6).desc(), "code"))).where(F.col("rank") <= most)


def note_checks(statements: DataFrame, sources: DataFrame, key: str, messages: int = 3, most_words: int = 1000, years: tuple[int, int] = G.YEARS) -> DataFrame:
    """(key, untraced, all_traced, three_messages, length_ok, n_words): what can be verified of a note by itself. Every value of
    its findings has to be among its sources (key, writing); it has ``messages`` key messages and at most so many words.
    ``statements`` are (key, section, statement_id, text)."""
    n = G.found_numbers(statements.where("section <> 'leads'"), "statement_id", years=years).select("statement_id", "writing")
    n = n.join(statements.select("statement_id", key), "statement_id").join(sources.select(key, "writing").distinct().withColumn("ok", F.lit(1)), [key, "writing"], "left")
    bad = n.groupBy(key).agg(F.count_if(F.col("ok").isNull()).alias("untraced"))
    size = statements.groupBy(key).agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n_words"), F.count_if(F.col("section") == "messages").alias("m"))
    out = size.join(bad, key, "left").withColumn("untraced", F.coalesce("untraced", F.lit(0)))
    return out.select(key, "untraced", (F.col("untraced") == 0).alias("all_traced"), (F.col("m") == messages).alias("three_messages"), (F.col("n_words") <= most_words).alias("length_ok"), "n_words")


def note_plan(commentaries: DataFrame, plan: DataFrame) -> DataFrame:
    """(position, chapter, section, table, text, reason): one commentary a table in the plan's order, and for a table without
    one the reason it is left to a person."""
    first = commentaries.groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), " ").alias("text"))
    p = plan.withColumn("n", F.row_number().over(Window.partitionBy("table").orderBy("position"))).where("n = 1").drop("n")
    return p.join(first, "table", "left").withColumn("reason", F.when(F.col("text").isNull(), "no usable value"))


def outline(sections: DataFrame) -> DataFrame:
    """Number chapters and sections of a note (note_id, position, chapter, section): a new one opens where the name changes."""
    w = Window.partitionBy("note_id").orderBy("position")
    new_chapter = F.when(F.col("chapter").eqNullSafe(F.lag("chapter").over(w)), 0).otherwise(1)
    new_section = F.when(F.col("section").eqNullSafe(F.lag("section").over(w)) & (F.col("__c") == 0), 0).otherwise(1)
    s = sections.withColumn("__c", new_chapter).withColumn("__s", new_section)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("chapter_no", F.sum("__c").over(run)).withColumn("section_no", F.sum("__s").over(run)).drop("__c", "__s")


def key_findings(outlined: DataFrame) -> DataFrame:
    """(note_id, section_no, finding): for each section, level and change of its first table that states both."""
    level = F.regexp_extract("text", r"s'établit à ([0-9][0-9 ,]*)", 1)
    verb, by = F.regexp_extract("text", r"(progresse|recule) de ([0-9 ,]+) %", 1), F.regexp_extract("text", r"(progresse|recule) de ([0-9 ,]+) %", 2)
    said = outlined.withColumn("level", F.trim(F.regexp_replace(level, r",$", ""))).withColumn("verb", verb).withColumn("by", by).where("level <> '' and verb <> ''")
    first = said.groupBy("note_id", "section_no").agg(F.min_by(F.struct("section", "level", "verb", "by", "table"), "position").alias("f"))
    way = F.when(F.col("f.verb") == "progresse", "en hausse de ").otherwise("en baisse de ")
    text = F.concat(F.col("f.section"), F.lit(" : "), F.col("f.level"), F.lit(", "), way, F.col("f.by"), F.lit(" % (tableau "), F.col("f.table").cast("string"), F.lit(")."))
    return first.select("note_id", "section_no", text.alias("finding"))


def contracted(name: Column) -> Column:
    """``de`` and a name, contracted: du stock, des UPA, de la valeur."""
    return F.when(name.startswith("le "), F.concat(F.lit("du "), F.substr(name, F.lit(4)))).when(name.startswith("les "), F.concat(F.lit("des "), F.substr(name, F.lit(5)))).otherwise(F.concat(F.lit("de "), name))


def section_title(c: Column) -> Column:
    """A heading without its number: ``2.1. Stock`` reads ``Stock``."""
    return F.trim(F.regexp_replace(c, r"^\s*\d+(\.\d+)*[.)]?\s*", ""))


def chapter_title(c: Column) -> Column:
    """``CHAPITRE II : LE STOCK`` reads ``Chapitre II — Le stock``."""
    number, name = F.regexp_extract(c, r"(?i)^\s*chapitre\s+([ivxlc]+)\s*[:.–—-]*\s*(.*)$", 1), F.lower(F.regexp_extract(c, r"(?i)^\s*chapitre\s+([ivxlc]+)\s*[:.–—-]*\s*(.*)$", 2))
    return F.when(number == "", F.trim(c)).otherwise(F.concat(F.lit("Chapitre "), F.upper(number), F.lit(" — "), F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2))))


def key_figures(levels: DataFrame) -> DataFrame:
    """(…, text): the figures of a box: magnitude, level and, where it is known, the change since the year before."""
    level = N.formatted(F.col("value"), 0)
    way = F.when(F.col("change") > 0, "+").when(F.col("change") < 0, "−").otherwise("")
    text = F.concat(F.upper(F.left("name", F.lit(1))), F.substr("name", F.lit(2)), F.lit(" : "), level, F.when(F.col("change").isNotNull(), F.concat(F.lit(" ("), way, N.formatted(F.abs("change"), 1), F.lit(" %)"))).otherwise(""))
    return levels.withColumn("text", text)


def arm_medians(times: DataFrame) -> DataFrame:
    """(n_with, n_without, median_with, median_without, reduction) of durations (arm, minutes); no reduction without a base."""
    med = lambda a: F.expr(f"percentile(case when arm = '{a}' then minutes end, 0.5)")
    t = times.agg(F.count_if(F.col("arm") == "with").alias("n_with"), F.count_if(F.col("arm") == "without").alias("n_without"), med("with").alias("a"), med("without").alias("b"))
    return t.select("n_with", "n_without", F.round("a", 2).alias("median_with"), F.round("b", 2).alias("median_without"), F.round(1 - F.col("a") / F.nullif("b", F.lit(0.0)), 4).alias("reduction"))


def criteria_met(grades: DataFrame, least: float, criteria: int) -> DataFrame:
    """(note_id, met, compliant): criteria whose mean over two readers is at least ``least``; rows that lack a reader are left
    out. ``grades`` are (note_id, criterion, a, b)."""
    g = grades.where("a is not null and b is not null").groupBy("note_id").agg(F.count_if((F.col("a") + F.col("b")) / 2 >= least).alias("met"))
    return g.withColumn("compliant", F.col("met") >= criteria)


def themed_sheet(findings: DataFrame, most: int = 3) -> DataFrame:
    """(theme, query, rank, sentence): a sheet of sentences with figures by theme; a sentence counts once a theme (by its first 80
    characters, whatever their case), and a query gives ``most``. ``findings`` are (theme, query, rank, sentence)."""
    some = findings.where(F.size(N.occurrences(F.col("sentence"), G.YEARS)) > 0).withColumn("head", F.lower(F.left("sentence", F.lit(80))))
    once = some.withColumn("n", F.row_number().over(Window.partitionBy("theme", "head").orderBy("query", "rank"))).where("n = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("theme", "query").orderBy("rank"))).where(F.col("n") <= most).select("theme", "query", F.col("n").alias("rank"), "sentence")


def key_messages(levels: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """(key, position, role, name, label, value, change): up to three messages a report. First the largest magnitude with a change
    (``levels``: key, name, value, change), then the strongest rise of a row (``moves``: key, name, label, change), then the
    strongest fall; where none falls, the smallest of two rises or more. Rows of one label come before crossed ones."""
    crossed = F.contains("label", F.lit("/")).cast("int")
    main = levels.where("change is not null").groupBy(key).agg(F.max_by(F.struct("name", "value", "change"), F.struct("value", "name")).alias("m"))
    main = main.select(key, F.lit(1).alias("position"), F.lit("main").alias("role"), "m.name", F.lit(None).cast("string").alias("label"), "m.value", "m.change")
    size = F.struct((-crossed).alias("plain"), F.round(F.abs("change"), 6).alias("size"), "name", "label")
    row = F.struct("name", "label", "change")
    per = moves.where("change <> 0").groupBy(key).agg(
        F.max_by(row, F.when(F.col("change") > 0, size)).alias("rise"), F.max_by(row, F.when(F.col("change") < 0, size)).alias("fall"),
        F.min_by(row, F.when(F.col("change") > 0, size)).alias("least"), F.count_if(F.col("change") > 0).alias("rises"),
    )
    warning = F.when(F.col("fall").isNotNull(), F.struct(F.lit("warning").alias("role"), "fall.*")).when(F.col("rises") > 1, F.struct(F.lit("no fall").alias("role"), "least.*"))
    both = F.array(F.struct(F.lit(2).alias("position"), F.when(F.col("rise").isNotNull(), F.struct(F.lit("rise").alias("role"), "rise.*")).alias("x")), F.struct(F.lit(3).alias("position"), warning.alias("x")))
    rows = per.select(key, F.inline(both)).where("x is not null").select(key, "position", "x.role", "x.name", "x.label", F.lit(None).cast("double").alias("value"), "x.change")
    return main.unionByName(rows)


def leads(evolutions: DataFrame, key: str) -> DataFrame:
    """(key, name, kind, labels, text): what to do about each evolution (key, name, change, label, label_change, trend,
    has_objective, place), without figures. A fall is to be corrected, with the rows that fall most; a rise is to be
    consolidated where an objective is documented, looked at on the spot where its row is a place, understood where it
    lasts, else followed. Falls of one magnitude are one lead."""
    falls = F.col("change") < 0
    kind = F.when(falls, "correct").when(F.col("has_objective"), "consolidate").when(F.col("place") & F.col("label").isNotNull(), "target").when(F.col("trend") == "rising", "understand").otherwise("follow")
    named = F.when((F.col("kind") == "correct") & (F.col("label_change") < 0) | (F.col("kind") == "target"), F.col("label"))
    per = evolutions.where("change is not null").withColumn("kind", kind).groupBy(key, "name", "kind").agg(F.array_sort(F.collect_set(named)).alias("labels"))
    whom = F.array_join(F.transform("labels", lambda x: F.concat(F.lit("« "), x, F.lit(" »"))), " et ")
    of, some = contracted(F.col("name")), F.size("labels") > 0
    text = (
        F.when(F.col("kind") == "correct", F.concat(F.lit("Chercher les causes du repli "), of, F.when(some, F.concat(F.lit(", surtout pour "), whom)).otherwise("")))
        .when(F.col("kind") == "consolidate", F.concat(F.lit("Poursuivre ce qui porte la hausse "), of, F.lit(", conforme à l'objectif documenté")))
        .when(F.col("kind") == "target", F.concat(F.lit("Étudier sur place la situation de "), whom, F.lit(" : évolution "), of))
        .when(F.col("kind") == "understand", F.concat(F.lit("Comprendre ce qui rend durable la hausse "), of))
        .otherwise(F.concat(F.lit("Fixer un objectif pour suivre l'évolution "), of))
    )
    return per.select(key, "name", "kind", "labels", F.concat(text, F.lit(".")).alias("text"))


def perspective(figures: DataFrame, passages: DataFrame, key: str, tendencies: int = 5) -> DataFrame:
    """(key, kind, position, text): what a perspective note starts from. The figures of each theme (``figures``: key, theme, rank,
    text), each once, the first ``rank`` of a theme first; then the first substantial passages (``passages``: key, id, text)."""
    once = figures.groupBy(key, "text").agg(F.min(F.struct("theme", "rank")).alias("at"))
    f = once.select(key, F.lit("figure").alias("kind"), F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("position"), "text")
    p = passages.where(T.substantial(F.col("text"))).withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where(F.col("position") <= tendencies)
    return f.unionByName(p.select(key, F.lit("tendency").alias("kind"), "position", "text"))


def coherence_report(pairs: DataFrame) -> DataFrame:
    """(n_codes, n_multi, n_single): codes (code, edition) that two editions or more have, and those of one."""
    per = pairs.groupBy("code").agg(F.count_distinct("edition").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_codes"), F.count_if(F.col("n") >= 2).alias("n_multi"), F.count_if(F.col("n") == 1).alias("n_single"))


def dashboard(levels: DataFrame, key: str) -> DataFrame:
    """(key, year, value, change, n_years, source): the latest level of each magnitude (key, year, value, change, source), with the
    length of its series."""
    last = F.max_by(F.struct("year", "value", "change", "source"), "year").alias("l")
    return levels.groupBy(key).agg(last, F.count_distinct("year").alias("n_years")).select(key, "l.year", "l.value", "l.change", "n_years", "l.source")
