from pyspark.sql import functions as F

from chiffra.operators import encoder as EN
from chiffra.operators import evaluation as E
from chiffra.operators import notes as NO
from chiffra.operators import tables as TB

def words_of(table, rows, heads=(), height=10.0):
    """Words of a table: each row a label and its values, columns 100 apart from x = 300, lines 20 apart, heads above."""
    out = []

    def put(text, x, y):
        for word in text.split(" "):
            out.append((table, float(x), float(y), float(x + 5 * len(word)), float(y + height), word))
            x += 5 * len(word) + 4

    for k, name in enumerate(heads):
        put(name, 300 + 100 * k, 0)
    for i, (label, *values) in enumerate(rows):
        put(label, 20, 30 + 20 * i)
        for k, v in enumerate(values):
            put(v, 300 + 100 * k, 30 + 20 * i)
    return out


KIND = "table_id long, x0 double, y0 double, x1 double, y1 double, text string"


def test_table_from_words(spark):
    rows = [("Cafés de plus de 30 places", "1 204", "98"), ("Ensemble", "12 900", "7,5 %"), ("Autres", "41", "(3)")]
    w = spark.createDataFrame(words_of(1, rows, ["2021", "2022"]) + [(2, 0.0, 0.0, 9.0, 9.0, "texte"), (2, 0.0, 20.0, 9.0, 29.0, None)], KIND)
    got = {(r["label"], r["year"], r["column"], r["text"]) for r in TB.from_words(w).collect()}
    assert got == {(label, 2021 + k, str(2021 + k), v) for label, *values in rows for k, v in enumerate(values)}


def test_headers_without_years(spark):
    w = spark.createDataFrame(words_of(7, [("Nord", "3", "5 100"), ("Sud", "4", "6 200")], ["Nombre", "Part du tout"]), KIND)
    got = {(r["label"], r["column"], r["year"], r["text"]) for r in TB.from_words(w).collect()}
    assert got == {("Nord", "Nombre", None, "3"), ("Nord", "Part du tout", None, "5 100"), ("Sud", "Nombre", None, "4"), ("Sud", "Part du tout", None, "6 200")}
    bare = spark.createDataFrame(words_of(8, [("", "3", "5")]), KIND).where("text <> ''")
    assert {(r["label"], r["column"]) for r in TB.from_words(bare).collect()} == {("(sans libellé)", "colonne 1"), ("(sans libellé)", "colonne 2")}


def test_packed(spark):
    s = spark.createDataFrame([(1, i, "Titre", f"ligne {i} | colonne = {i}") for i in range(50)], "table_id int, position int, title string, sentence string")
    got = TB.packed(s, 60).collect()
    assert len(got) > 3 and all(len(r["text"].split()) <= 60 and r["text"].startswith("Titre\n") for r in got)
    assert sum(r["text"].count(" = ") for r in got) == 50
    t = spark.createDataFrame([(1, i, "T", "a " * n) for i, n in enumerate((5, 5, 30, 1, 9, 9))], "table_id int, position int, title string, sentence string")
    got = {r["part"]: r["text"].count("a") for r in TB.packed(t, 20).collect()}
    assert got == {0: 10, 1: 30, 2: 19}


def test_encoder(spark):
    texts = ["stock des entreprises par région", "stock des entreprises par région", "exportations agricoles du pays", "emplois des entreprises", "exportations de cacao du pays", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    v = {r["id"]: r["v"] for r in EN.Encoder(dims=3).fit(docs).encode(docs).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert abs(dot(0, 1) - 1) < 1e-6 and dot(2, 4) > dot(0, 4) and not any(v[5])
    c = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert abs(c.select(E.cosine(F.col("a"), F.col("b"))).first()[0] - 0.5**0.5) < 1e-9


def test_notes(spark):
    t = spark.createDataFrame([("PME par sexe (en %)",), ("Stock selon le secteur d'activité de 2020 à 2024",), ("Total général",), ("VA par les PME",), ("Stock par PMEregion",)], "t string")
    assert [r[0] for r in t.select(NO.dimension(F.col("t"))).collect()] == ["sexe", "secteur d'activité", None, None, "PMEregion"]
    assert [r[0] for r in t.select(NO.magnitude(F.col("t"))).collect()] == [None, "stock", None, "va", "stock"]
    d = spark.createDataFrame([("annuaire_2024",), ("rapport_analyse_2023",), ("note_conjoncture_T2_2024",), ("autre_doc",)], "d string")
    assert [r[0] for r in d.select(NO.document_name(F.col("d"))).collect()] == ["Annuaire 2024", "Rapport d'analyse 2023", "Note de conjoncture T2 2024", "Autre doc"]
    p = spark.createDataFrame([("a", 2024, 5, 2), ("b", 2024, 5, 1), ("c", 2024, None, 3), ("d", 2024, 6, None)], "code string, edition int, table int, chart int")
    assert {r["code"] for r in NO.plan(p).collect()} == {"b", "d"}
    usable = spark.createDataFrame([("a", 2024), ("b", 2024)], "code string, edition int")
    assert {(r["code"], r["reason"]) for r in NO.abstentions(p, usable).collect()} == {("c", "no table is paired"), ("d", "no usable value")}
    c = spark.createDataFrame([("t", "A", 1.0, 1, "Nombre"), ("t", "A", 2.0, 2, "Total")], "k string, row string, value double, value_id int, column string")
    assert [r["value"] for r in NO.one_column(c, ["k"]).collect()] == [2.0]
    s = spark.createDataFrame([("s", 1, 1, "443"), ("s", 2, 2, "443"), ("s", 3, 2, None)], "section string, position int, table int, level string")
    assert {r["position"] for r in NO.already_said(s, ["section"]).collect()} == {1, 3}
    ps = spark.createDataFrame([(1, "Ce document a un objectif. L'objectif est d'atteindre un stock de cent mille entreprises en région."), (2, "Rien.")], "passage_id int, text string")
    ti = spark.createDataFrame([(9, "Stock des entreprises par région")], "title_id int, title string")
    assert NO.objectives(ps, ti).first()["passage_id"] == 1


def test_title_pairing_meets_equal_titles_once(spark, tmp_path, monkeypatch):
    from chiffra.plans import assembly as PA

    rows = [(20 * i + j, f"{a} bolt", "LARGE", 1 + i % 2) for i in range(30) for j, a in enumerate(["red", "blue", "old", "hot"] * 5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    met = []
    monkeypatch.setattr(PA.AN, "similar_sets", lambda *a, f=PA.AN.similar_sets: met.append(f(*a)) or met[-1])
    got = {r["chart"]: (r["table"], r["score"]) for r in PA.title_pairing(spark, str(tmp_path)).collect()}
    last = {n: max(k for k, a, _, e in rows if e == n and k % 20 > 1 and a == "blue bolt") for n in (1, 2)}
    assert got == {k: (last[e], 1.0) for k, _, _, e in rows if k % 20 == 1}
    assert met[0].count() <= 2 * 4 * 4  # two editions of four titles
