"""Readers of the domain's inputs: publications, registries, lexicons, CSV with a byte-order mark, gold questions, caches."""

from __future__ import annotations

import pandas as pd
import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from chiffra.functions import text as T

TYPES = ("annuaire", "rapport_analyse", "note_conjoncture", "contexte")
STATUSES = ("publie", "interne")

DOCUMENTS = "doc_id string, titre string, type string, exercice int, trimestre string, statut_diffusion string, fichier string, nb_pages int, sha256 string, test_synthetique boolean"
PASSAGES = "passage_id long, doc_id string, page int, page_fin int, chapitre string, section string, nature string, code_indicateur string, numero int, texte string, nb_tokens int"
VALUES = "valeur_id long, doc_id string, page int, tableau_n int, tableau_intitule string, ligne string, colonne string, annee_colonne int, sous_colonne string, valeur_texte string, valeur_num double, unite string, code_indicateur string"
PAIRINGS = "code_indicateur string, exercice int, graphique_n int, graphique_intitule string, tableau_n int, tableau_intitule string, doc_annuaire string, doc_rapport string, passage_commentaire_id long, score double, statut string, valide_par string, date_validation date"
VARIATIONS = "code_indicateur string, exercice int, exercice_ref int, ligne string, sous_colonne string, valeur double, valeur_ref double, var_abs double, var_abs_texte string, var_rel_pct double, var_rel_texte string, unite string, valeur_id long, valeur_ref_id long"
PRODUCTIONS = "prod_id long, type string, entree string, sortie string, sources_json string, valeurs_ecartees_json string, abstentions_json string, modele string, config_hash string, duree_s double, horodatage timestamp, statut_validation string, valide_par string"


#: The declared tables, by name.
TABLES = {"documents": DOCUMENTS, "passages": PASSAGES, "valeurs": VALUES, "appariement": PAIRINGS, "variations": VARIATIONS, "productions": PRODUCTIONS}


def declared_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A declared table from its Parquet: columns that the files lack are null, others are cast, more are left out."""
    have = spark.read.parquet(f"{folder}/{name}")
    want = T_.StructType.fromDDL(TABLES[name])
    return have.select(*[(F.col(f"`{f.name}`") if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])


def workbook(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sheet, row, col, text) of the cells of XLSX files: a workbook is a ZIP of XML parts, which one task reads per file.
    Rows and columns count from 1; numbers keep their writing, formulas give their stored value, empty cells are left out."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    def name(tag: str) -> str:
        return tag.rpartition("}")[2]

    def text_of(node) -> str:
        return "".join(t.text or "" for t in node.iter() if name(t.tag) == "t")

    def column(ref: str) -> int:
        n = 0
        for c in re.match("[A-Z]+", ref)[0]:
            n = 26 * n + ord(c) - 64
        return n

    def cells(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                z = zipfile.ZipFile(io.BytesIO(content))
                part = lambda p: ElementTree.fromstring(z.read(p))  # noqa: B023, E731
                shared = [text_of(si) for si in part("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
                targets = {r.get("Id"): r.get("Target") for r in part("xl/_rels/workbook.xml.rels")}
                for sheet in (x for x in part("xl/workbook.xml").iter() if name(x.tag) == "sheet"):
                    target = targets[next(v for k, v in sheet.attrib.items() if name(k) == "id" and k != "sheetId" and "}" in k)].lstrip("/")
                    for c in (x for x in part(target if target.startswith("xl/") else f"xl/{target}").iter() if name(x.tag) == "c"):
                        value = next((x.text or "" for x in c if name(x.tag) == "v"), None)
                        kind = c.get("t")
                        value = text_of(c) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value
                        if value:
                            rows.append((path, sheet.get("name"), int(re.search(r"\d+", c.get("r"))[0]), column(c.get("r")), value))
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "text"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(cells, "path string, sheet string, row int, col int, text string")


def sheet_rows(cells: DataFrame, sheet: str) -> DataFrame:
    """(path, row, cells: header -> text) of a sheet whose first row names its columns."""
    of = cells.where(F.col("sheet") == sheet)
    head = of.where("row = 1").select("path", "col", F.col("text").alias("head"))
    return of.where("row > 1").join(head, ["path", "col"]).groupBy("path", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("head", "text")))).alias("cells"))


def publications(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, file, length, sha256, content) of binary files; Spark lists and reads them on any store."""
    b = spark.read.format("binaryFile").load(pattern)
    return b.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"), "content")


def matched(files: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with their registry entry, files without one), by file name."""
    return files.join(registry, files["file"] == registry["fichier"]), files.join(registry, files["file"] == registry["fichier"], "left_anti")


def _text(spark: SparkSession, path: str) -> str:
    """A small configuration file, read by Spark so that any store will do."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()).lstrip("﻿")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Declared metadata of documents; an unknown type or status is an error."""
    entries = yaml.safe_load(_text(spark, path))
    entries = entries.get("documents", entries) if isinstance(entries, dict) else entries
    rows = []
    for e in entries:
        if e.get("type") not in TYPES or e.get("statut_diffusion") not in STATUSES:
            raise ValueError(f"unknown type or status in {e.get('doc_id')}")
        rows.append((e["doc_id"], e.get("fichier"), e.get("titre"), e["type"], e.get("exercice"), e.get("trimestre"), e["statut_diffusion"], bool(e.get("test_synthetique", False))))
    return spark.createDataFrame(rows, "doc_id string, fichier string, titre string, type string, exercice int, trimestre string, statut_diffusion string, test_synthetique boolean")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(family, pos, term): normalised terms, underscores as blanks."""
    families = yaml.safe_load(_text(spark, path))["familles"]
    rows = [(f, p, str(t).replace("_", " ")) for f, ts in enumerate(families) for p, t in enumerate(ts)]
    return spark.createDataFrame(rows, "family int, pos int, term string").withColumn("term", T.normalised(F.col("term")))


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Semicolon CSV with header and byte-order mark; empty fields are null."""
    r = spark.read.option("sep", ";").option("header", True).option("encoding", "UTF-8")
    df = r.schema(schema).csv(path) if schema else r.csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, doc_id, page, outside): one row per relevant page; outside questions have none."""
    kind = "id string, question string, pertinents array<struct<doc_id:string,pages:array<int>>>, hors_corpus boolean"
    q = spark.read.schema(kind).option("multiLine", True).json(path)
    p = q.withColumn("p", F.explode_outer("pertinents")).withColumn("page", F.explode_outer("p.pages"))
    return p.select("id", "question", F.col("p.doc_id").alias("doc_id"), "page", F.coalesce("hors_corpus", F.lit(False)).alias("outside"))


def valid(df: DataFrame, rules: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rejects with the first broken rule's name); rules map a name to a Column."""
    why = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    marked = df.withColumn("motif", why)
    return marked.where("motif is null").drop("motif"), marked.where("motif is not null")


def missing_from_cache(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts whose content hash is not in the cache (key, ...): what is still to be encoded."""
    keyed = texts.select(F.sha2(F.col(text), 256).alias("key"), F.col(text)).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def encoded_with_cache(texts: DataFrame, path: str, encode, text: str = "text") -> DataFrame:
    """``texts`` with their vectors ``v``: what the cache at ``path`` (key, v) lacks is encoded (``encode``: (id, text) to (id, v)),
    appended to it, and all vectors are read back from it."""
    spark = texts.sparkSession
    schema = "key string, v array<double>"
    try:
        cache = spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no cache yet
        cache = spark.createDataFrame([], schema)
    new = missing_from_cache(texts, cache, text)
    encode(new.select(F.col("key").alias("id"), F.col(text).alias("text"))).select(F.col("id").alias("key"), F.col("v").cast("array<double>").alias("v")).write.mode("append").parquet(path)
    stored = spark.read.schema(schema).parquet(path).groupBy("key").agg(F.any_value("v").alias("v"))
    return texts.withColumn("__key", F.sha2(F.col(text), 256)).join(stored.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


def answer_key(url, model, temperature, seed, system, prompt):
    """The key under which a model's answer is kept: the hash of all that decides it."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(x.cast("string"), F.lit("")) for x in (url, model, temperature, seed, system, prompt)])), 256)


def answered(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with a kept answer, requests without one); both have ``key``, the cache (key, answer)."""
    return requests.join(cache.groupBy("key").agg(F.any_value("answer").alias("answer")), "key"), requests.join(cache.select("key"), "key", "left_anti")


#: How a publication shows its type.
_KINDS = (("annuaire", r"(?i)annuaire statistique"), ("rapport_analyse", r"(?i)rapport d['’]analyse"), ("note_conjoncture", r"(?i)note de conjoncture|bulletin"))


def detected(docs: DataFrame) -> DataFrame:
    """(…, type, quarter, n_tables, n_charts) found in a document's text."""
    t = F.col("text")
    kind = F.lit("contexte")
    for name, pattern in reversed(_KINDS):
        kind = F.when(t.rlike(pattern), name).otherwise(kind)
    quarter = F.nullif(F.regexp_extract(t, r"(?i)\b(T[1-4])\b", 1), F.lit(""))
    number = lambda word: F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(rf"(?i){word}\s+(\d+)\s*[:.]"), 1)))
    return docs.withColumn("type", kind).withColumn("quarter", F.upper(quarter)).withColumn("n_tables", number("tableau")).withColumn("n_charts", number("graphique"))


def duration(c):
    """Seconds of a delay such as ``2m59.56s`` or ``1h3m``; null if unreadable."""
    part = lambda u: F.coalesce(F.regexp_extract(c, rf"(\d+(?:\.\d+)?){u}(?![a-z])", 1).try_cast("double"), F.lit(0.0))
    return F.when(F.lower(c).rlike(r"^(\d+(\.\d+)?(h|ms|m|s))+$"), 3600 * part("h") + 60 * part("m") + part("s") + part("ms") / 1000)


def clock_minutes(c):
    """Minutes of ``hh:mm:ss`` or ``hh:mm``."""
    p = F.split(c, ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p).between(2, 3), 60 * n(1) + n(2) + F.coalesce(n(3), F.lit(0.0)) / 60)


