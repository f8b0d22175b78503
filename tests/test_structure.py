"""Lines by a state machine, merged cells, damaged JSON and the full-text store against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chiffra.functions import json as J
from chiffra.operators import grids as G
from chiffra.operators import segments as S
from chiffra.sources.fulltext import TextStore


def walk(symbols):
    """The machine, a line after the other."""
    m, state, held, out = S.DOCUMENT, "front", {}, []
    for n, x in enumerate(symbols):
        if (state, x) in m.moves:
            state, sets, clears = m.moves[state, x]
            held = {k: v for k, v in held.items() if k not in clears} | {r: n for r in sets}
        out.append((n, state, *[held.get(r) for r in m.registers]))
    return out


@pytest.mark.parametrize("block", [1, 3, 256])
def test_blocks_of_lines_give_what_one_pass_gives(spark, block):
    rng = random.Random(block)
    docs = {d: rng.choices(["text", "blank", "chapter", "section", "chart", "source"], [6, 1, 1, 2, 3, 1], k=rng.choice([1, 2, 40, 300])) for d in range(12)}
    rows = [(d, n, x) for d, s in docs.items() for n, x in enumerate(s)]
    rng.shuffle(rows)
    got = S.scan(spark.createDataFrame(rows, "doc_id long, n int, symbol string"), "doc_id", S.DOCUMENT, block).collect()
    for d, s in docs.items():
        assert sorted((r["n"], r["state"], r["chapter"], r["section"], r["chart"]) for r in got if r["doc_id"] == d) == walk(s)


TABLE = """<table><tr><th rowspan=2>Région<th colspan="2">2020</th><th colspan=2>2021</th></tr><tr><td>H</td><td>F</td><td>H<td>F</tr>
<tr><td colspan=5>Nord</td></tr><tr><td rowspan=2>A &amp; B</td><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><td>5</td><td>6</td><td>7</td><td></td></tr><tr><td>C</td><td>8,5</td></tr></table>"""


def test_merged_cells(spark):
    pages = spark.createDataFrame([(1, f"<p>x</p>{TABLE}<table></table>"), (2, None), (3, "<table><tr><td>a"), (4, "<table><tr><td>Total</td><td></td><td>12 %</td></tr></table>")], "page_id long, html string")
    cells = G.html_tables(pages)
    assert {(r["row"], r["col"], r["rows"], r["cols"]) for r in cells.where("page_id = 1 and row in (0, 1, 4)").collect()} == {(0, 0, 2, 1), (0, 1, 1, 2), (0, 3, 1, 2), (1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 1), (1, 4, 1, 1), (4, 1, 1, 1), (4, 2, 1, 1), (4, 3, 1, 1), (4, 4, 1, 1)}
    got = {(r["page_id"], r["label"], r["column"], r["year"], r["text"]) for r in G.values(cells, ["page_id", "table_no"]).collect()}
    one = {("2020 · H", 2020, "1"), ("2020 · F", 2020, "2"), ("2021 · H", 2021, "3"), ("2021 · F", 2021, "4"), ("2020 · H", 2020, "5"), ("2020 · F", 2020, "6"), ("2021 · H", 2021, "7")}
    assert got == {(1, "Nord / A & B", *x) for x in one} | {(1, "Nord / C", "2020 · H", 2020, "8,5"), (4, "Total", "colonne 3", None, "12 %")}


@pytest.mark.parametrize("raw,want", [
    ('{"k": 1}', {"k": 1}), ('```json\n{"k": 2}\n```', {"k": 2}), ('Voici { : {"k": 3, "s": "a}b\\"c"} fin }', {"k": 3, "s": 'a}b"c'}), ('[{"k": 4}]', [{"k": 4}]), ('{"k": 5', None),
    ('bruit [ {"k": 6} puis', {"k": 6}), ("rien", None), (None, None), ("", None), ('x "{" {"k":7} "', {"k": 7}), ('} ] {"k": [1, {"z": 2}]} [', {"k": [1, {"z": 2}]}), ('{"a": 1} et {"b": {"c": 2}}', {"b": {"c": 2}}),
])
def test_json_in_noise(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "t string").select(F.to_json(J.lenient(F.col("t")))).first()[0]
    assert (None if got is None else json.loads(got)) == want


def test_lists_are_checked(spark):
    rows = ['{"en": [{"k": 1}, {"k": 2, "x": 0}]}', '[{"k": 3}]', '{"en": []}', '{"en": {"k": 1}}', '{"en": [{"k": 1}, 5]}', '{"autre": 1}']
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", J.listed(J.lenient(F.col("t")), "en", "k int").alias("l")).orderBy("i").collect()
    assert [r["l"] and [x["k"] for x in r["l"]] for r in got] == [[1, 2], [3], None, None, None, None]


def plain_phrases(texts, phrase):
    p = phrase.split()
    n = {i: sum(t.split()[k : k + len(p)] == p for k in range(len(t.split()))) for i, t in texts.items()}
    return {i: x for i, x in n.items() if x}


def plain_spans(texts, words, within):
    out = {}
    for i, t in texts.items():
        w = t.split()
        spans = [b - a + 1 for a in range(len(w)) for b in range(a, len(w)) if set(words.split()) <= set(w[a : b + 1])]
        if spans and min(spans) <= within:
            out[i] = min(spans)
    return out


def test_store_through_updates_and_merges(spark, tmp_path):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choices("aa bb cc dd ee".split(), k=rng.randint(0, 12))) for i in range(60)}
    s = TextStore(spark, str(tmp_path / "store"))
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(1, "aa bb"), (2, "cc cc"), (3, "dd aa ee"), (4, "zz aa"), (5, "bb"), (6, "")], "qid long, text string")

    def agrees():
        got = {}
        for r in s.phrases(asked).collect():
            got.setdefault(r["qid"], {})[r["id"]] = r["n"]
        assert got == {q: x for q, p in ((1, "aa bb"), (2, "cc cc"), (3, "dd aa ee"), (5, "bb")) if (x := plain_phrases(texts, p))}
        near = {}
        for r in s.near(asked, 4).collect():
            near.setdefault(r["qid"], {})[r["id"]] = r["span"]
        assert near == {q: x for q, p in ((1, "aa bb"), (2, "cc"), (3, "dd aa ee"), (5, "bb")) if (x := plain_spans(texts, p, 4))}
        assert {r["id"]: r["length"] for r in s.passages().collect()} == {i: len(t.split()) for i, t in texts.items()}

    assert s.segments() == [] and s.phrases(asked).count() == 0
    s.add(frame([*texts.items()]))
    agrees()
    new = {3: "aa bb aa bb", 61: "dd aa ee", 7: ""}
    s.add(frame([*new.items()]))
    texts.update(new)
    s.delete(spark.createDataFrame([(3,), (10,), (999,)], "id long"))
    texts = {i: t for i, t in texts.items() if i not in (3, 10)}
    agrees()
    s.add(frame([(10, "bb bb cc cc")]))
    texts[10] = "bb bb cc cc"
    assert len(s.segments()) == 4
    s.merge()
    assert len(s.segments()) == 1
    agrees()
    assert s.vacuum() == [0, 1, 2, 3]
    agrees()


def test_searches_of_lots_and_of_many_queries_agree(spark, tmp_path, monkeypatch):
    """Few queries go out to lots of passages, and no posting moves once a query; more meet the postings in a shuffle."""
    from chiffra.sources import fulltext as FT

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices("a b c d e".split(), k=rng.randint(0, 30)))) for i in range(60)]
    s = TextStore(spark, str(tmp_path / "s"))
    s.add(spark.createDataFrame(rows, "id long, text string"))
    s.delete(spark.createDataFrame([(3,), (4,)], "id long"))
    q = spark.createDataFrame([(1, "a b"), (2, "a b a"), (3, "c"), (4, "e zz"), (5, "d e c")], "qid int, text string")
    monkeypatch.setattr(FT, "LOT", 7)
    run = lambda: [sorted(map(tuple, x.collect())) for x in (s.phrases(q), s.near(q, 4))]
    few = run()
    monkeypatch.setattr(FT, "MOST_SENT", 1)
    assert run() == few and all(few)
