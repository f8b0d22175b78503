import re
from collections import Counter

import numpy as np

from chiffra.llm import quality

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = SPACE.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    hit = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


TEXTS = ["", None, "a b c d e a b c d e", "x\nx\n y\nx", "é ü\u00a0z #a|b\n\n\n", "a\x0bb\x0cc\td", "one two three four five six\none two three four five six\n" * 3, "\n", " lead", "w " * 5000, "z" * 3_000_000]


def test_counts_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in quality.judge(df, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), (i, t and t[:30])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])


def test_good_rows_keeps_every_column_and_row_order_independent(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)), None, 7) for i in range(5)] + [(9, "short", "en", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, n_words string, h int")
    out = quality.good_rows(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 0, 1, 2, 3, 4]
    assert quality.good_rows(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_list_learns_planted_rules():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.9) | ((x["b"] < 0.1) & (x["c"] > 0.5))
    rules = quality.learn_list(x, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality._holds(x, r)
    assert 2 <= len(rules) <= 6 and (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.03 * hit.sum()
    assert quality.learn_list(x, np.zeros(3000, bool)) == []


def test_held_out_accuracy(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit = quality.judge(d, lab.where("doc_id % 2 = 0")).join(lab.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").toPandas()
    assert ((fit["quality"] == 1) == fit["kept"]).mean() > 0.97
    assert fit.loc[fit["quality"] == 1, "kept"].mean() > 0.98
