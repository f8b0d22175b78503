"""Token sets joined by similarity, against brute force; sets that can't match are left out where they are read."""

import random

import pytest

from chiffra.operators import answers as A
from chiffra.plans import answers as P


def brute(left, right, least, first):
    if first:
        right = [(min(b for b, t in right if set(t) == set(s)), s) for s in {tuple(sorted(s)) for _, s in right}]
    both = lambda s, t: len(set(s) & set(t)) / len(set(s) | set(t))
    return sorted((a, b, round(both(s, t), 9)) for a, s in left for b, t in right if s and t and both(s, t) >= least)


@pytest.mark.parametrize("least", [0.25, 0.5, 0.75, 1.0])
@pytest.mark.parametrize("first, most", [(False, 500_000), (True, 500_000), (True, 3)])
def test_similar_sets_against_brute_force(spark, monkeypatch, least, first, most):
    monkeypatch.setattr(A, "MOST_SENT", most)
    rng = random.Random(int(least * 100))
    # Few frequent words and many rare ones; copies in another order, empty sets, and words that only one side has.
    pick = lambda own: rng.sample([f"w{i}" for i in range(6)] * 3 + [f"r{i}" for i in range(20)] + [f"{own}{i}" for i in range(5)], rng.randint(0, 8))
    left, right = [(i, list(dict.fromkeys(pick("l")))) for i in range(60)], [(i, list(dict.fromkeys(pick("d")))) for i in range(300)]
    right += [(300 + i, s[::-1]) for i, s in right[:100]]
    df = A.similar_sets(spark.createDataFrame(left, "a int, s array<string>"), spark.createDataFrame(right, "b int, s array<string>"), least, first)
    got = sorted((r["a"], r["b"], round(r["sim"], 9)) for r in df.collect())
    assert got == brute(left, right, least, first)


def test_no_left_words(spark):
    left = spark.createDataFrame([(1, [])], "a int, s array<string>")
    right = spark.createDataFrame([(1, ["x"]), (2, None)], "b int, s array<string>")
    assert A.similar_sets(left, right, 0.5).collect() == []


def test_sentence_sources_leave_out_what_shares_too_little(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "Alpha beta gamma delta."), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    other = [(10 + i, " ".join(f"{w}{chr(97 + i)}" for w in ("kilo", "lima", "mike")) + ". Alpha " + " ".join(f"oscar{chr(97 + i)}{c}" for c in "abc") + ".") for i in range(26)]
    rows = [(3, "Nothing. Beta alpha gamma."), (2, "Gamma beta alpha! Alpha."), (1, None), *other]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    met = []
    monkeypatch.setattr(A, "kept", lambda df, name, f=A.kept: met.append(f(df, name)) or met[-1], raising=True)
    out = P.sentence_sources(spark, str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [(1, 1, 2, 1, 0.75)]
    # One of 55 sets shares half its words or more, besides "alpha" alone; the plan reads what was written, no document again.
    assert sorted(len(r["s"]) for r in met[1].collect()) == [1, 3]
    assert not [f for f in out.inputFiles() if "/documents.parquet/" in f]
