import math
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from chiffra.functions import numbers as N
from chiffra.functions import text as T
from chiffra.operators import evaluation as E
from chiffra.operators import guard as G


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_numbers(spark):
    cases = {"12 500": 12500.0, "12 500": 12500.0, "7,8": 7.8, "79,6 %": 79.6, "(3,2)": -3.2, "2.500,5": 2500.5, "1,234.5": 1234.5, "1.234.567": 1234567.0, "abc": None, "": None, None: None}
    got = {r["x"]: r["v"] for r in spark.createDataFrame([(k,) for k in cases], "x string").select("x", N.parsed(F.col("x")).alias("v")).collect()}
    assert got == cases
    forms = {"2.500": [2.5, 2500.0], "7.8": [7.8], "12 500": [12500.0], "1,5": [1.5], "1.2.3": [123.0], "31,1%": [31.1], "x": [], "-4": [4.0]}
    got = {r["x"]: [float(v) for v in r["v"]] for r in spark.createDataFrame([(k,) for k in forms], "x string").select("x", N.forms(F.col("x")).alias("v")).collect()}
    assert got == forms


@pytest.mark.parametrize("a,b", [("12 500", "12500"), ("7,8", "7.8"), ("0,10", "0,1"), ("2.500", "2500"), ("12 500", "12 500")])
def test_equal_writings(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(F.arrays_overlap(N.forms(F.col("a")), N.forms(F.col("b")))).first()[0]


def test_rounding_and_format(spark):
    df = spark.createDataFrame([(0.25, -0.25, 1481.0, -2.4, -0.04)], "a double, b double, c double, d double, e double")
    r = df.select(N.half_up(F.col("a"), 1), N.half_up(F.col("b"), 1), N.formatted(F.col("c"), 0), N.formatted(F.col("d"), 1), N.formatted(F.col("e"), 1)).first()
    assert list(r) == [0.3, -0.3, "1 481", "-2,4", "0,0"]
    assert one(spark, "7,85 %", N.decimals) == 2 and one(spark, "12", N.decimals) == 0


def test_scanner(spark):
    w = lambda t: [x["writing"] for x in one(spark, t, lambda c: N.occurrences(c, (2010, 2035))) or []]
    assert w("En 2024, 12 500 PME (7,8 %) selon le tableau 3, au T2 et la 2e place, page 14.") == ["12 500", "7,8"]
    assert w("de 2022-2024 soit 2023 %") == ["2023"]
    assert w("SND30 et T3_2024") == [] and w(None) == [] and w("") == []
    assert w("443 524 contre 393 175") == ["443 524", "393 175"]
    t = "Le total de 12 500 recule de -7,8 % sur 3 ans"
    found = one(spark, t, lambda c: N.occurrences(c, (2010, 2035)))
    assert [(t[x["start"] : x["end"]], x["percent"]) for x in found] == [("12 500", False), ("-7,8 %", True), ("3", False)]


def test_text(spark):
    assert one(spark, "L’Été à Œuvré", T.normalised) == "l'ete a oeuvre"
    assert one(spark, "Les créations d'entreprises des régions, 12 choix", T.tokens) == ["creation", "entreprise", "region", "12", "choi"]
    assert one(spark, "Créations d'entreprises en 2024", T.token_set) == ["creation", "entreprise"]
    assert one(spark, "Un, deux. Trois; quatre", T.token_count) == 7
    assert one(spark, "A. B! C", T.sentences) == ["A.", "B!", "C"]
    assert one(spark, "PME crées entre 2019 et 2023 (en %)", T.bare_title) == "pme creees"
    assert one(spark, "Évolution des PME crées par région de 2020 à 2024", T.slug) == "pme-creees-region"
    assert one(spark, "déve-\nloppement .... fin", T.joined_hyphens) == "développement fin"


def test_evaluation(spark):
    df = spark.createDataFrame([("le chat dort bien", "le chat dort bien"), ("a b c d", "a c e"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(E.rouge_l(E.words(F.col("a")), E.words(F.col("b")))).collect()]
    assert got[0] == 1 and abs(got[1] - 2 * 2 / 7) < 1e-9 and got[2] == 0
    k = spark.createDataFrame([("v", "v")] * 4 + [("v", "r")] * 1 + [("r", "r")] * 5, "a string, b string")
    assert E.kappa(k).first()["kappa"] == pytest.approx((0.9 - 0.5) / 0.5)


def test_guard(spark):
    t = "Le total atteint 12 500, soit 99 de plus."
    cut = lambda t, *parts: one(spark, t, lambda c: G.without_clauses(c, F.array(*[F.lit(t.index(p)) for p in parts])))
    assert cut(t, "99") == "Le total atteint 12 500."
    assert cut("Le stock atteint 12 500 en tout (99 de plus)", "99") == "Le stock atteint 12 500 en tout."
    assert cut("il passe à 12 et il en reste 7, 5 de moins", "7", "5") == "Il passe à 12."
    assert cut("il passe à 12", "12") == ""
    s = spark.createDataFrame([(1, "Le stock atteint 12 500 PME en 2024."), (2, "Le stock de PME du pays atteint 12 500, contre 25 000 avant."), (3, "Il y en a 77 777."), (4, "Rien à signaler."), (5, None)], "statement_id long, text string")
    auth = spark.createDataFrame([("12 500", "Total", 1)], "writing string, source string, priority int")
    got = {r["statement_id"]: (r["action"], r["text"], r["n_kept"]) for r in G.guarded(s, auth).collect()}
    assert got[1][0] == "kept" and got[2] == ("reformulated", "Le stock de PME du pays atteint 12 500.", 1)
    assert got[3][0] == "deleted" and got[4] == ("kept", "Rien à signaler.", 0) and got[5][0] == "kept"


def test_sources_follow_the_sentence(spark):
    auth = spark.createDataFrame([("7,5", "Yaoundé", 1), ("7,5", "Douala", 2), ("7,5", "Total", 3)], "writing string, source string, priority int")
    s = spark.createDataFrame([(1, "À « Douala », la hausse est de 7,5 %."), (2, "Ce total progresse de 7,5 %."), (3, "« Yaoundé » gagne 7,5 %.")], "statement_id long, text string")
    got = {r["statement_id"]: r["source"] for r in G.sourced(G.found_numbers(s), G.index_of(auth)).collect()}
    assert got == {1: "Douala", 2: "Total", 3: "Yaoundé"}


def test_years_named_with_a_source(spark):
    auth = spark.createDataFrame([("7,5", "Total", 1, 2019), ("7,5", "Total", 2, 2021)], "writing string, source string, priority int, ref_year int")
    s = spark.createDataFrame([(1, "Depuis 2021, la hausse est de 7,5 %.")], "statement_id long, text string")
    index = G.index_of(auth).withColumn("source", F.concat("source", F.lit(" "), F.col("ref_year").cast("string")))
    assert G.sourced(G.found_numbers(s), index).first()["source"] == "Total 2021"


def test_deviation_kinds(spark):
    w = lambda *xs: spark.createDataFrame([(1, x) for x in xs], "statement_id long, writing string")
    kind = lambda x, known, past, most=250: G.deviation_kinds(w(x), w(*known), w(*past), most=most).first()["kind"]
    assert kind("7,5", ["7,46"], ["1"]) == "rounding"
    assert kind("393 175", ["12"], ["393 175"]) == "other year"
    assert kind("30", ["10", "20"], ["1"]) == "computed" and kind("50", ["10", "20"], ["1"]) == "computed"
    assert kind("31 337", ["10", "20"], ["1"]) == "invention" and kind("abc", ["1"], ["1"]) == "invention"
    known = [str(x) for x in range(1000, 1300)] + ["500 000"]
    assert kind("501 299", known, ["1"], most=250) == "invention" and kind("501 299", known, ["1"], most=None) == "computed"


def test_false_rejects(spark):
    gaps = spark.createDataFrame([(1, "1181"), (2, "2 500"), (3, "77"), (4, "4321")], "statement_id long, writing string")
    pages = spark.createDataFrame([(1, "soit 1 181 PME"), (2, "soit 2.500 PME"), (3, "soit 770 PME"), (4, "soit 43\n21 PME")], "statement_id long, text string")
    assert {r["statement_id"]: r["false_reject"] for r in G.false_rejects(gaps, pages).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_keys_and_lenient_numbers(spark):
    assert one(spark, " Créations\n d’Été ", N.key_of) == "creations d'ete"
    assert [one(spark, x, N.lenient) for x in ("env. 1 204 PME", "7,5 %", "n.d.")] == [1204.0, 7.5, None]


def test_signed_rank_p(spark):
    """Exact p by all sign patterns; a published value; the normal one with ties; nothing that differs."""
    for n in (1, 5, 9):
        sums = [sum(k for k in range(1, n + 1) if pattern >> (k - 1) & 1) for pattern in range(2**n)]
        top = n * (n + 1) // 2
        rows = spark.createDataFrame([(float(w), n, 0.0, True) for w in range(top + 1)], "w double, n int, z double, exact boolean")
        two = {r["w"]: r["p"] for r in rows.select("w", E.signed_rank_p(F.col("w"), F.col("n"), F.col("z"), F.col("exact")).alias("p")).collect()}
        more = {r["w"]: r["p"] for r in rows.select("w", E.signed_rank_p(F.col("w"), F.col("n"), F.col("z"), F.col("exact"), "greater").alias("p")).collect()}
        for w in range(top + 1):
            assert two[w] == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / 2**n), abs=1e-15)
            assert more[w] == pytest.approx(sum(s >= w for s in sums) / 2**n, abs=1e-15)
    ps = spark.range(0, 46).select(E.signed_rank_p(F.col("id").cast("double"), F.lit(13), F.lit(0.0), F.lit(True), "greater").alias("p"))
    assert ps.where("abs(p - 6329 / 8192) < 1e-12").count() == 1
    for z in (0.0, 0.3, 1.96, 4.5, 20.0):
        assert spark.range(1).select(E.erfc(F.lit(z) / math.sqrt(2))).first()[0] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-14)
    pairs = [("a", 1.0, float(k)) for k in range(2, 9)] + [("b", 1.0, 1.0)] * 3 + [("c", 2.0, 1.0), ("c", 2.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 1.0)]
    got = {r["g"]: r for r in E.wilcoxon(spark.createDataFrame(pairs, "g string, a double, b double"), ["g"]).collect()}
    assert (got["a"]["w"], got["a"]["loss"], got["a"]["p"]) == (0, 7, 2 / 128)
    assert (got["b"]["tie"], got["b"]["w"], got["b"]["p"]) == (3, None, None)
    z = (2 - 3) / math.sqrt(3 * 4 * 7 / 24 - 3 * 8 / 48)
    assert got["c"]["w"] == 2 and got["c"]["p"] == pytest.approx(math.erfc(-z / math.sqrt(2)))


def test_scaled_round(spark):
    # One step of a double under 900.35, whose tenfold is 9003.5: SQL's round gives 900.4, rounding by the writing 900.3.
    x = spark.createDataFrame([(900.3499999999999,), (900.34,), (-900.3499999999999,), (None,)], "x double")
    assert [r[0] for r in x.select(N.scaled_round(F.col("x"), 1)).collect()] == [900.4, 900.3, -900.4, None]
    assert duckdb.sql("select round(900.3499999999999::double, 1)").fetchall() == [(900.4,)]


def test_recall_of_long_texts(spark):
    """Words are singled out once a text, so the work is linear: 20,000 words took minutes when each place did it anew."""
    text = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(text, text + " more"), ("a b", "")], "a string, b string")
    start = time.time()
    got = [tuple(r) for r in df.select(*[E.rouge_n_recall(E.words(F.col("a")), E.words(F.col("b")), n) for n in (1, 2)]).collect()]
    assert got == [(20_000 / 20_001, 19_999 / 20_000), (0.0, 0.0)]
    assert time.time() - start < 60
