import re

import numpy as np
import pytest

from chiffra.llm import tokencount

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def greedy(word, opening, going_on):
    n, i = 0, 0
    while i < len(word):
        pieces = opening if i == 0 else going_on
        j = len(word)
        while j > i + 1 and word[i:j] not in pieces:
            j -= 1
        i, n = j, n + 1
    return n


def test_random_vocabularies():
    rng = np.random.default_rng(2)
    make = lambda k: {bytes(rng.choice([97, 98, 99], rng.integers(1, 7)).astype(np.uint8)) for _ in range(k)}
    for _ in range(30):
        a, b = make(12), make(12)
        m = tokencount.Automaton(a, b)
        words = [bytes(rng.choice([97, 98, 99, 100], rng.integers(1, 30)).astype(np.uint8)) for _ in range(200)]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        got = m.lengths(data, ends - [len(w) for w in words], ends)
        assert got.tolist() == [greedy(w, a, b) for w in words]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_table_and_edges(spark, sf):
    a, b = tokencount.read_pieces()
    longest = max(map(len, a | b))
    texts = [r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").limit(60).collect()]
    texts += [None, "", " \n\t", "x", "日本語 emoji 🙂  z", "ab" * 200_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "two words", 1)] * 2, "doc_id long, text string, n_words int")
    got = tokencount.count_tokens(df).collect()
    assert len(got) == len(texts) + 2
    memo = {}
    for r in got:
        words = SPACE.findall((r["row"]["text"] or "").encode())
        for w in set(words) - memo.keys():
            memo[w] = greedy(w, a, b) if len(w) < 5000 else None
        assert r["n_words"] == len(words)
        if None not in (known := [memo[w] for w in words]):
            assert r["n_tokens"] == sum(known)
        else:
            assert len(words[0]) / longest <= r["n_tokens"] <= len(words[0])
    assert tokencount.count_tokens(df.limit(0)).count() == 0
