import re
import time
import zipfile

import numpy as np
from pyspark.sql import functions as F

from chiffra import cli
from chiffra.operators import assembly as A
from chiffra.operators import encoder as EN
from chiffra.operators import evaluation as E
from chiffra.operators import ingestion as I
from chiffra.operators import journal as J
from chiffra.operators import notes as NO
from chiffra.operators import pairing as P
from chiffra.operators import retrieval as R
from chiffra.operators import series as S
from chiffra.sources import index as IX
from chiffra.sources import readers, writers
from chiffra.streaming import journal as SJ


def test_variations(spark):
    v = spark.createDataFrame([("Total", 2023, 19651.0, 1), ("Total", 2024, 21132.0, 2), ("Z", 2023, 0.0, 3), ("Z", 2024, 5.0, 4), ("Total", 2024, 9.0, 5)], "k string, year int, value double, value_id long")
    got = {(r["k"], r["year"], r["ref_year"]): (r["var_abs"], r["var_rel"], r["value_id"], r["ref_id"]) for r in S.variations(S.first_cells(v, ["k"]), ["k"], 2024).collect()}
    assert got == {("Total", 2024, 2023): (1481.0, 7.5, 2, 1), ("Z", 2024, 2023): (5.0, None, 4, 3)}


def test_trend_and_saliency(spark):
    c = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, 2.0, 3.0])] + [("b", i, x) for i, x in enumerate([1.0, -2.0, 3.0])] + [("c", 0, 1.0)], "k string, year int, change double")
    last = {r["k"]: r["trend"] for r in S.trend(c, ["k"]).orderBy("year").collect()}
    assert last == {"a": "rising", "b": "one-off", "c": "short"}
    s = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, 2.0, 3.0, 8.0])], "k string, year int, change double")
    r = S.saliency(s, ["k"]).where("year = 3").first()
    assert r["base"] == "sd" and abs(r["score"] - 8 / (2 / 3) ** 0.5) < 1e-9


def test_ordered_dedup(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "x"), (5, "d", "z"), (6, "e", "w")]
    both = [(n, *r) for n in ("one", "two") for r in rows[: 6 if n == "one" else 2]]
    got = S.ordered_dedup(spark.createDataFrame(both, "report string, rank int, k1 string, k2 string"), "report", "k1", "k2", 3).collect()
    assert sorted((r["report"], r["rank"]) for r in got) == [("one", 1), ("one", 3), ("one", 5), ("two", 1)]


def test_rrf(spark):
    lex = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "qid int, id int, rank int")
    den = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "qid int, id int, rank int")
    got = R.rrf([lex, den], 60, 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 1, 3] and abs(got[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12


def test_internal_documents_never_return(spark, tmp_path):
    p = spark.createDataFrame([(1, "zorglubium rare"), (2, "autre texte rare"), (3, "sans rapport"), (4, "encore un autre"), (5, "cinq"), (6, None), (7, "")], "id long, text string")
    ix = IX.save_bm25(p, str(tmp_path / "ix"), 3)
    t = R.question_terms(spark.createDataFrame([(7, "zorglubium rare")], "item_id long, text string"))
    assert {r["id"] for r in R.bm25(ix, t).collect()} == {1, 2}
    assert {r["id"] for r in R.bm25(ix, t, p.where("id <> 1").select("id")).collect()} == {2}
    again = IX.load_bm25(spark, str(tmp_path / "ix"))
    assert {(r["id"], r["score"]) for r in R.bm25(again, t).collect()} == {(r["id"], r["score"]) for r in R.bm25(ix, t).collect()}


def test_bounds_are_read_without_postings(spark):
    from chiffra.plans.retrieval import index
    from chiffra.plans.base import table

    sf = "/root/testdata/sf0.01"
    bounds, *_ = R.stripe_bounds(index(spark, sf), R.question_terms(table(spark, sf, "benchmark")))
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^\n]*front[^\n]*)>", plan)
    assert schemas and not any("ids" in x or "tfs" in x for x in schemas)


def test_modes_of_search(spark, tmp_path):
    p = spark.createDataFrame([(1, "stock rare"), (2, "stock commun"), (3, "autre"), (4, "encore autre")], "id long, text string")
    ix = IX.save_bm25(p, str(tmp_path / "ix"), 2)
    v = IX.save_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0])], "id long, v array<double>"), str(tmp_path / "v"))
    t, q = R.question_terms(spark.createDataFrame([(9, "rare")], "item_id long, text string")), spark.createDataFrame([(9, [0.0, 1.0])], "qid long, v array<double>")
    got = {m: [(r["id"], r["rank_lexical"], r["rank_dense"]) for r in R.search(ix, v, t, q, m).orderBy("rank").collect()] for m in ("lexical", "dense", "hybrid")}
    assert got["lexical"] == [(1, 1, None)] and got["dense"] == [(2, None, 1), (3, None, 2), (1, None, 3)]
    assert got["hybrid"][0] == (1, 1, 3) and {x[0] for x in got["hybrid"]} == {1, 2, 3}
    assert R.search(ix, v, t, q, "hybrid", spark.createDataFrame([(2,)], "id long")).select("id").collect()[0]["id"] == 2


def test_dense_search_in_blocks(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 4)), 1)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 20)], "qid long, v array<double>")
    got = {(r["qid"], r["rank"]): r["id"] for r in R.dense_top_k(v, q, 7, sent_bytes=150).collect()}
    scores = np.round(x @ x.T, 9)
    assert got == {(i, n + 1): j for i in range(0, 300, 20) for n, j in enumerate(sorted(range(300), key=lambda j: (-scores[i, j], j))[:7])}


def test_phrases_of_the_lexicon(spark):
    f = spark.createDataFrame([(0, 0, "valeur ajoutée"), (0, 1, "va"), (1, 0, "PME"), (1, 1, "petite_entreprise")], "family int, pos int, term string")
    q = spark.createDataFrame([(1, "La valeur  ajoutée des PME"), (2, "La valeur est ajoutée")], "qid long, text string")
    t = R.question_terms(q.withColumnRenamed("qid", "item_id"))
    got = {(r["qid"], r["term"]) for r in R.expanded(t, f, questions=q).where("weight < 1").collect()}
    assert got == {(1, "va"), (1, "petite"), (1, "entreprise")}


def test_excerpts_and_suggestions(spark):
    text = "Rien ici. Autre chose encore. Le stock des entreprises monte. Fin du texte. Suite du texte. Encore une."
    q = spark.createDataFrame([(1, ["stock", "entreprise"])], "qid long, words array<string>")
    hit = spark.createDataFrame([(1, 7, 1)], "qid long, id long, rank int")
    e = lambda most: R.excerpts(hit, spark.createDataFrame([(7, text)], "id long, text string"), q, most).first()["excerpt"]
    assert e(420) == "Autre chose encore. Le stock des entreprises monte. Fin du texte. Suite du texte." and e(10) == "Autre chos…"
    titles = spark.createDataFrame([(1, "Stock 2023 (en %)", ["stock"], ["2023"]), (2, "Stock 2024", ["stock"], ["2024"]), (3, "Stock faible", ["stock"], [])], "title_id long, title string, words array<string>, years array<string>")
    refused = spark.createDataFrame([(5, ["stock", "region"], ["2024"])], "qid long, words array<string>, years array<string>")
    signals = spark.createDataFrame([(1, 9.0), (2, 9.0), (3, 1.0)], "title_id long, signal double")
    assert [r["title"] for r in R.suggestions(refused, titles, signals, 5.0).orderBy("position").collect()] == ["Stock 2024", "Stock 2023"]
    assert R.thresholds_for("tfidf", {"tfidf": 0.4}, 0.5) == 0.4 and R.thresholds_for("x", {}, 0.5) == 0.5
    no = spark.createDataFrame([("Les extraits ne permettent pas de répondre",), ("Oui, 12.",)], "t string")
    assert [r[0] for r in no.select(F.col("t").rlike(R.NO_ANSWER)).collect()] == [True, False]


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "token_windows (no SQL)" in capsys.readouterr().out
    folder = "/root/testdata/sf0.001"
    question = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1"), "doc_id", "left_anti").where("length(text) > 200").orderBy("doc_id").first()
    said = lambda *args: (cli.main(list(args)), capsys.readouterr().out)[1]
    assert f"[{question['doc_id']}]" in said("consult", folder, question["text"][:200])
    assert "no passage is near enough" in said("consult", folder, "zzzz qqqq")
    assert "BUILDING" in said("comment", folder, "BUILDING", "1996") and "nothing is known" in said("comment", folder, "RIEN", "1996")
    assert "main : " in said("note", folder, "1996")
    cli.main(["run", "explorer_counts", "/root/testdata/sf0.001", "--out", str(tmp_path / "o"), "--csv"])
    assert readers.csv(spark, str(tmp_path / "o")).count() == 25


def test_encoder_fallback():
    def missing():
        raise ImportError("no such library")

    assert EN.chosen(["a", "b"], {"a": missing, "b": lambda: "B"}) == ("b", "B")
    assert EN.chosen(["a"], {"a": missing})[0] == "tfidf"


def test_kendall_by_inversions(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.integers(0, 9, 60), rng.integers(0, 7, 60)))]
    got = E.kendall(spark.createDataFrame(rows, "id int, x double, y double")).first()
    signs = [(np.sign(a[1] - b[1]), np.sign(a[2] - b[2])) for i, a in enumerate(rows) for b in rows[:i]]
    con, dis = sum(x * y > 0 for x, y in signs), sum(x * y < 0 for x, y in signs)
    assert (got["concordant"], got["discordant"]) == (con, dis)
    assert abs(got["tau"] - (con - dis) / (sum(x != 0 for x, _ in signs) * sum(y != 0 for _, y in signs)) ** 0.5) < 1e-9


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="urn:r"><sheets><sheet name="grille" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="urn:p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>note</t></si><si><r><t>lec</t></r><r><t>teur</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>12.5</v></c><c r="AB2" t="inlineStr"><is><t>Ab</t></is></c><c r="AC2"/></row></sheetData></worksheet>')
    cells = readers.workbook(spark, str(tmp_path / "w.xlsx"))
    assert {(r["row"], r["col"], r["text"]) for r in cells.collect()} == {(1, 1, "note"), (1, 28, "lecteur"), (2, 1, "12.5"), (2, 28, "Ab")}
    assert readers.sheet_rows(cells, "grille").first()["cells"] == {"note": "12.5", "lecteur": "Ab"}


def test_caches(spark, tmp_path):
    seen = []

    def encode(df):
        seen.append(df.count())
        return df.select("id", F.array(F.length("text").cast("double")).alias("v"))

    path = str(tmp_path / "cache")
    one, two = (spark.createDataFrame([(x,) for x in xs], "text string") for xs in (["a", "bb", "bb"], ["bb", "ccc"]))
    assert sorted(r["v"][0] for r in readers.encoded_with_cache(one, path, encode).collect()) == [1.0, 2.0, 2.0]
    assert sorted(r["v"][0] for r in readers.encoded_with_cache(two, path, encode).collect()) == [2.0, 3.0] and seen[0] == 2 and seen[-1] == 1
    r = spark.createDataFrame([("u", "m", 0.0, 1, "s", "p"), ("u", "m", 0.0, 2, "s", "p")], "url string, model string, temperature double, seed int, system string, prompt string")
    r = r.withColumn("key", readers.answer_key(*[F.col(c) for c in r.columns]))
    met, unmet = readers.answered(r, r.where("seed = 1").select("key", F.lit("yes").alias("answer")))
    assert met.first()["answer"] == "yes" and [x["seed"] for x in unmet.collect()] == [2]


def test_declared_tables(spark, tmp_path):
    spark.createDataFrame([("a", "2024", "x")], "doc_id string, exercice string, more string").write.parquet(str(tmp_path / "documents"))
    t = readers.declared_table(spark, str(tmp_path), "documents")
    assert t.first()["exercice"] == 2024 and t.first()["titre"] is None and "more" not in t.columns and t.columns[0] == "doc_id"


def test_context_and_checks(spark):
    v = spark.createDataFrame([("i", 2024, "Total", 2024, "12", 1), ("i", 2024, "A", None, "3", 2)], "code string, edition int, row string, year int, writing string, value_id int")
    d = spark.createDataFrame([("i", 2024, "Total", 2023, "7,5")], "code string, edition int, row string, ref_year int, change string")
    m = spark.createDataFrame([("j", 2024, 2023, "Un modèle")], "code string, edition int, from_edition int, text string")
    got = {r["code"]: r["text"] for r in A.context(v, d, m, ["code", "edition"]).collect()}
    assert got == {"i": "Valeurs\n- Total | 2024 = 12\n- A | sans année = 3\n\nVariations\n- Total depuis 2023 : 7,5", "j": "Modèles\n- Un modèle"}
    t = spark.createDataFrame([("le stock",), ("les UPA",), ("la VA",)], "t string")
    assert [r[0] for r in t.select(A.contracted(F.col("t"))).collect()] == ["du stock", "des UPA", "de la VA"]
    t = spark.createDataFrame([("CHAPITRE II : LE STOCK", "2.1. Stock"), ("Annexe", "Autre")], "c string, s string")
    assert [tuple(r) for r in t.select(A.chapter_title(F.col("c")), A.section_title(F.col("s"))).collect()] == [("Chapitre II — Le stock", "Stock"), ("Annexe", "Autre")]
    t = spark.createDataFrame([("Total",), ("Total général / Total",), ("Yaoundé / Total",), ("Totaux",)], "t string")
    assert [r[0] for r in t.select(NO.is_grand_total(F.col("t"))).collect()] == [True, True, False, False]
    t = spark.createDataFrame([("Yaoundé",), ("Nord-Ouest",), ("Commerce",)], "t string")
    assert [r[0] for r in t.select(NO.is_place(F.col("t"))).collect()] == [True, True, False]


def test_thresholds(spark):
    s = spark.createDataFrame([(float(x), o) for x, o in [(1, True), (2, True), (3, False), (4, True), (5, False), (6, False), (7, False)]], "signal double, outside boolean")
    assert R.balanced_threshold(s).first()["threshold"] == 4.5 or R.balanced_threshold(s).first()["threshold"] == 2.5
    assert R.capped_threshold(s).first()["threshold"] == 2.5


def test_pairing(spark):
    charts = spark.createDataFrame([(2024, 1, "Répartition des PME par région", [82.74, 17.31]), (2024, 2, "Sans rapport", [1.0])], "edition int, chart int, title string, values array<double>")
    tables = spark.createDataFrame([(2024, 5, "PME par région", [82.7, 17.3]), (2024, 6, "Exportations", [55.0])], "edition int, table int, title string, values array<double>")
    got = {r["chart"]: (r["table"], r["status"]) for r in P.propose(charts, tables).collect()}
    assert got == {1: (5, "candidate"), 2: (6, "to check")}


def test_double_reading(spark):
    p = spark.createDataFrame([(i, "candidate", 10 + i) for i in range(1, 7)], "chart int, status string, table int")
    rows = [(1, "A", "valid"), (1, "b", "valid"), (2, "A", "valid"), (2, "B", "rejected"), (3, "A", "rejected"), (3, "B", "rejected"), (4, "A", "valid"), (5, "A", "corrected"), (5, "B", "corrected"), (6, "A", "rejected"), (6, " a ", "valid"), (6, "B", "valid")]
    r = spark.createDataFrame([(c, w, d, 99 if d == "corrected" else None, i) for i, (c, w, d) in enumerate(rows)], "chart int, reader string, decision string, new_table int, at int")
    got = {x["chart"]: (x["status"], x["table"]) for x in P.consolidated(p, r).collect()}
    assert got == {1: ("valid", 11), 2: ("to check", 12), 3: ("rejected", 13), 4: ("candidate", 14), 5: ("valid", 99), 6: ("valid", 16)}


def test_codes(spark):
    c = spark.createDataFrame([("s", 2023, 1, "Stock de PME par région en 2023"), ("s", 2024, 1, "Stock de PME par région en 2024"), ("s", 2024, 2, "Stock de PME par région et sexe"), ("s", 2024, 3, "Exportations agricoles")], "series string, edition int, chart int, title string")
    got = {(r["edition"], r["chart"]): r["code"] for r in P.attribute_codes(c).collect()}
    assert got[2023, 1] == got[2024, 1] and len(set(got.values())) == 3 and got[2024, 3] == "exportations-agricoles"
    fixed = spark.createDataFrame([("s", 2023, 1, "Stock de PME par région", "own-code"), ("s", 2024, 1, "Stock de PME par région", None), ("s", 2024, 2, "Stock de PME par région", None), ("t", 2024, 9, "Stock de PME par région", None)], "series string, edition int, chart int, title string, code string")
    got = {(r["series"], r["edition"], r["chart"]): r["code"] for r in P.attribute_codes(fixed).collect()}
    assert got == {("s", 2023, 1): "own-code", ("s", 2024, 1): "own-code", ("s", 2024, 2): "stock-pme-region", ("t", 2024, 9): "stock-pme-region"}


def test_windows(spark):
    lines = spark.createDataFrame([(1, i, "mot " * 30) for i in range(100)] + [(2, 0, "court"), (3, 0, "x " * 2000)], "doc_id long, line_no int, line string")
    got = I.token_windows(lines, "doc_id").orderBy("doc_id", "window_no").collect()
    one = [r for r in got if r["doc_id"] == 1]
    assert all(r["n_tokens"] <= 800 for r in one) and one[0]["first_line"] == 0 and one[-1]["end_line"] == 100
    assert all(b["first_line"] < a["end_line"] for a, b in zip(one, one[1:]))
    assert [r["n_tokens"] for r in got if r["doc_id"] > 1] == [1, 2000]


def test_captions_and_grid(spark):
    lines = spark.createDataFrame([("d", 1, 10.0, "Tableau 1 : Stock"), ("d", 1, 90.0, "Tableau 2 :"), ("d", 1, 95.0, "Exportations")], "doc_id string, page int, y double, line string")
    caps = I.captions(lines)
    tabs = spark.createDataFrame([("d", 1, 20.0), ("d", 1, 99.0), ("d", 2, 50.0)], "doc_id string, page int, y double")
    got = {(r["page"], r["y"]): (r["number"], r["title"]) for r in I.nearest_caption(tabs, caps).collect()}
    assert got == {(1, 20.0): (1, "Stock"), (1, 99.0): (2, "Exportations"), (2, 50.0): (None, None)}
    grid = [["", "2023", ""], ["", "Nombre", "%"], ["PME", "10", "5"], ["", "11", ""]]
    cells = spark.createDataFrame([(1, r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row)], "table_id int, row int, col int, text string")
    got = {r["sentence"] for r in I.linear_cells(cells, header_rows=2).collect()}
    assert got == {"PME | 2023 / Nombre = 10", "PME | 2023 / % = 5", "PME | 2023 / Nombre = 11"}


def test_reading_order(spark):
    rows = [(1, 1, 0.0, 100.0, 0.0, "title"), (1, 1, 0.0, 45.0, 10.0, "l1"), (1, 1, 55.0, 100.0, 10.0, "r1"), (1, 1, 0.0, 45.0, 20.0, "l2"), (1, 1, 0.0, 100.0, 30.0, "wide"), (1, 1, 55.0, 100.0, 40.0, "r3")]
    df = spark.createDataFrame(rows, "doc_id int, page int, x0 double, x1 double, y0 double, text string")
    assert [r["text"] for r in I.reading_order(df, 100.0).orderBy("position").collect()] == ["title", "l1", "l2", "r1", "wide", "r3"]


def test_journal(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"q": "x"}, [1, 2])], "prod_id long, entry map<string,string>, sources array<int>")
    J.append(rows, str(tmp_path / "j"), {"a": 1})
    got = spark.read.parquet(str(tmp_path / "j")).first()
    assert got["entry"] == '{"q":"x"}' and got["sources"] == "[1,2]" and got["config_hash"] == J.config_hash({"a": 1}) and got["status"] == "to read"
    assert got["written_at"] is not None and got["duration_s"] is None
    J.append(spark.createDataFrame([("a",), ("b",)], "kind string"), str(tmp_path / "k"), {}, began=time.time() - 5)
    new = spark.read.parquet(str(tmp_path / "k")).collect()
    assert len({r["prod_id"] for r in new}) == 2 and all(4 < r["duration_s"] < 100 for r in new)
    d = spark.createDataFrame([(1, "valid", 2), (1, "rejected", 1)], "prod_id long, status string, at int")
    assert J.with_validation(spark.read.parquet(str(tmp_path / "j")), d).first()["status"] == "valid"
    assert J.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert {tuple(r) for r in J.upserted(old, new, ["k"]).collect()} == {(1, "a"), (2, "c")}
    t = spark.createDataFrame([('```json\n{"a": 3}\n```',), ("none",)], "x string")
    assert [r["x"] and r["x"]["a"] for r in J.read_payload(t, "x", "a int").collect()] == [3, None]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("documents:\n- {doc_id: a, fichier: a.pdf, titre: A, type: annuaire, exercice: 2024, statut_diffusion: publie}\n", encoding="utf-8")
    (tmp_path / "l.yaml").write_text("familles:\n- [PME, petite_entreprise]\n- [Région]\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("﻿id;v\n1;é\n2;\n", encoding="utf-8")
    (tmp_path / "g.json").write_text('[{"id": "q1", "question": "?", "pertinents": [{"doc_id": "a", "pages": [1, 2]}]}, {"id": "q2", "question": "?", "pertinents": [], "hors_corpus": true}]')
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"x")
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"y")
    reg = readers.registry(spark, str(tmp_path / "r.yaml"))
    met, unmet = readers.matched(readers.publications(spark, str(tmp_path / "pdf")), reg)
    assert [r["doc_id"] for r in met.collect()] == ["a"] and [r["file"] for r in unmet.collect()] == ["b.pdf"]
    assert [r["term"] for r in readers.lexicon(spark, str(tmp_path / "l.yaml")).orderBy("family", "pos").collect()] == ["pme", "petite entreprise", "region"]
    assert {tuple(r) for r in readers.csv(spark, str(tmp_path / "c.csv")).collect()} == {("1", "é"), ("2", None)}
    assert {(r["id"], r["page"], r["outside"]) for r in readers.gold(spark, str(tmp_path / "g.json")).collect()} == {("q1", 1, False), ("q1", 2, False), ("q2", None, True)}
    df = spark.createDataFrame([(1, None), (2, "x;y")], "a int, b string")
    writers.csv(df, str(tmp_path / "out"))
    assert {tuple(r) for r in readers.csv(spark, str(tmp_path / "out")).collect()} == {("1", None), ("2", "x;y")}
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in (tmp_path / "out").glob("*.csv"))
    page = writers.html(spark.createDataFrame([(1, 1, "A & B", "x < y")], "note_id int, position int, title string, text string")).first()
    assert page["html"].endswith("<h2>A &amp; B</h2><p>x &lt; y</p>")
    good, bad = readers.valid(df, {"b missing": F.col("b").isNotNull()})
    assert good.count() == 1 and bad.first()["motif"] == "b missing"
    d = spark.createDataFrame([("2m59.56s",), ("1h3m",), ("350ms",), ("x",)], "t string").select(readers.duration(F.col("t"))).collect()
    assert [r[0] and round(r[0], 2) for r in d] == [179.56, 3780.0, 0.35, None]
    md = writers.markdown(spark.createDataFrame([(1, 2, "B", "y"), (1, 1, "A", "x")], "note_id int, position int, title string, text string")).first()
    assert md["markdown"] == "## A\n\nx\n\n## B\n\ny"
    cache = spark.createDataFrame([("k", 1)], "key string, v int")
    assert readers.missing_from_cache(df.where("b is not null"), cache, "b").count() == 1


def test_streams_equal_batches(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    live = SJ.drained(SJ.counts(SJ.events(spark, sf)), str(tmp_path / "c1"), "complete", "s_counts")
    key = lambda r: (r["start"], r["event_type"], r["n"])
    assert sorted(map(key, live.collect())) == sorted(map(key, SJ.counts(batch).collect()))
    live = SJ.drained(SJ.sessions(SJ.events(spark, sf)), str(tmp_path / "c2"), "append", "s_sessions")
    want = {(r["start"], r["user_id"], r["n"]) for r in SJ.sessions(batch).collect()}
    got = {(r["start"], r["user_id"], r["n"]) for r in live.collect()}
    assert got <= want and len(got) > 0.95 * len(want)  # windows still open at the last watermark are withheld
    live = SJ.drained(SJ.once(SJ.events(spark, sf)), str(tmp_path / "c3"), "append", "s_once")
    assert live.count() == batch.select("event_id").distinct().count()
    live = SJ.drained(SJ.latest(SJ.events(spark, sf)), str(tmp_path / "c4"), "update", "s_latest")
    want = {r["user_id"]: r["event_id"] for r in J.latest(batch.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).collect()}
    assert {r["user_id"]: r["event_id"] for r in live.collect()} == want


def test_places_and_magnitudes_in_commentary(spark):
    """Rows that are towns divide by place without a word of the title; rows of two magnitudes are not ranked; leads by kind."""
    rows = [("Création d'entreprises", r, y, v) for r, a, b in (("Total", 300.0, 330.0), ("Douala", 200.0, 210.0), ("Yaoundé", 100.0, 120.0)) for y, v in ((2020, a), (2021, b))]
    rows += [("Bilan", r, 2021, v) for r, v in (("Chiffre d'affaires", 900.0), ("Emplois", 80.0))]
    said = NO.commentary(spark.createDataFrame([(t, t, *r) for t, *r in rows], "k string, title string, row string, year int, value double"), ["k"]).collect()
    text = {(r["k"], r["year"], r["position"]): r["text"] for r in said}
    assert "dans la répartition par localisation géographique, " in text["Création d'entreprises", 2021, 4]
    assert ("Création d'entreprises", 2021, 3) in text and ("Bilan", 2021, 3) not in text
    e = [(1, "le stock", -2.0, "Est", -5.0, "short", False, True), (1, "le stock", -1.0, "Nord", -3.0, "short", True, True), (1, "les UPA", 2.0, "Sud", 9.0, "short", False, True), (1, "la valeur", 2.0, None, None, "rising", False, False), (2, "les OES", 1.0, "a", 1.0, "short", True, True), (2, "les UPI", None, "a", 1.0, "short", True, True)]
    got = A.leads(spark.createDataFrame(e, "n int, name string, change double, label string, label_change double, trend string, has_objective boolean, place boolean"), "n").collect()
    assert {(r["n"], r["name"], r["kind"], tuple(r["labels"])) for r in got} == {(1, "le stock", "correct", ("Est", "Nord")), (1, "les UPA", "target", ("Sud",)), (1, "la valeur", "understand", ()), (2, "les OES", "consolidate", ())}
    assert [r["text"] for r in got if r["kind"] == "correct"] == ["Chercher les causes du repli du stock, surtout pour « Est » et « Nord »."]


def test_equal_changes_take_the_longest_label(spark):
    rows = [("Total", 2020, 300.0), ("Total", 2021, 309.0)] + [(r, y, 100.0 + 10 * (y - 2020)) for r in ("LONG LABEL", "SHORT") for y in (2020, 2021)]
    said = NO.commentary(spark.createDataFrame([("k", "Commandes", *r) for r in rows], "k string, title string, row string, year int, value double"), ["k"]).collect()
    assert [r["text"] for r in said if r["year"] == 2021 and r["position"] == 4] == ["Par rapport à 2020, l'évolution la plus marquée concerne « LONG LABEL » (hausse de 10,0 %)."]
