import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from chiffra.llm import mixing


def brute(blocks, weights):
    """Slot by slot, in exact fractions: among the blocks that are released in the fluid mixture, the one due earliest."""
    w = [Fraction(x) / sum(map(Fraction, weights)) for x in weights]
    placed, now, out = [0] * len(blocks), Fraction(0), []
    for _ in range(sum(blocks)):
        _, j = min((Fraction(placed[j] + 1) / w[j], j) for j in range(len(blocks)) if placed[j] < blocks[j] and Fraction(placed[j]) / w[j] <= now)
        out.append((j, placed[j]))
        placed[j] += 1
        left = Fraction(1)
        while on := [j for j in range(len(blocks)) if blocks[j] / w[j] > now]:
            rate, step = sum(w[j] for j in on), min(blocks[j] / w[j] for j in on) - now
            if step * rate > left:
                now += left / rate
                break
            now, left = now + step, left - step * rate
        assert all(abs(placed[j] - min(Fraction(blocks[j]), now * w[j])) < 1 for j in range(len(blocks)))
    return out


@pytest.mark.parametrize("blocks,weights", [([5, 9, 40], [1, 1, 1]), ([300, 1, 20, 7], [5, 1, 2.5, 0.01]), ([7], [3]), ([2, 2], [0.999, 0.001]), ([0, 3, 5], [1, 2, 3]), ([4] * 30 + [90], [0.5] * 30 + [7])])
def test_slots_are_those_of_the_plain_scheduler(blocks, weights):
    got = {t: (j, k) for j, (slots, _) in enumerate(mixing.schedule(blocks, weights)) for k, t in enumerate(slots)}
    assert [got[t] for t in range(sum(blocks))] == brute(blocks, weights)


@pytest.mark.parametrize("blocks,weights", [([90_000, 20_000, 3_000], [0.7512345, 0.2, 0.0487655]), ([60_000, 300], [0.9999, 0.0001]), ([40_000] + [900] * 60, [math.sqrt(1_000_000)] + [math.sqrt(20_000)] * 60)])
def test_deviation_from_the_targets_themselves(blocks, weights):
    for j, (slots, phases) in enumerate(mixing.schedule(blocks, weights)):
        first = np.frombuffer(phases, np.int32) == 0
        s = np.frombuffer(slots, np.int64)[first].astype(float)
        w, k = weights[j] / sum(weights), np.arange(len(s))
        assert (np.abs(k - w * s) < 1 + 1e-6).all() and (np.abs(k + 1 - w * (s + 1)) < 1 + 1e-6).all()


def test_many_sources(spark):
    """Five thousand sources, most of a row or two; every row has a place."""
    rows = [(i, f"s{i % 5000}" if i < 8000 else "big") for i in range(12_000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string")).collect()
    assert sorted(r["row"]["doc_id"] for r in out) == list(range(12_000))
    assert sorted({r["slot"] for r in out}) == list(range(5000 + 500)) and len({(r["slot"], r["block_row"]) for r in out}) == 12_000


def test_blocks_keep_their_rows_at_any_size(spark, monkeypatch):
    """A plan that is written in several parts and joined by a shuffle is that of one part."""
    rows = [(i, "ab"[i % 5 == 0]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    one = sorted(map(tuple, mixing.mix_sources(df).collect()))
    for name, value in (("CHUNK", 100), ("PIECE", 16), ("MOST_SENT", 0)):
        monkeypatch.setattr(mixing, name, value)
    assert sorted(map(tuple, mixing.mix_sources(df).collect())) == one
    assert {r[5] for r in one} == set(range(500)) and len({(r[5], r[3]) for r in one}) == 4000


def test_rows(spark):
    rows = [(i, f"t{i}", s, i) for s, n in (("a", 900), ("b", 70), (None, 33)) for i in range(n)] + [(None, None, "b", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    out = mixing.mix_sources(df, {"a": 1, "b": 1, None: 2, "absent": 4}).collect()
    assert len(out) == len(rows)
    cells = defaultdict(set)
    for r in out:
        assert r["source"] == r["row"]["source"]
        cells[r["slot"]].add((r["source"], r["block"]))
    assert all(len(v) == 1 for v in cells.values()) and sorted(cells) == list(range(len(cells)))
    assert len({(r["slot"], r["block_row"]) for r in out}) == len(rows)
    assert len(cells) == sum(math.ceil(n / mixing.BLOCK_ROWS) for n in (900, 73, 33))
    got = mixing.in_order(df)
    assert got.columns == df.columns and got.count() == len(rows)
    want = [r['row'] for r in mixing.mix_sources(df).orderBy('slot', 'block_row').collect()]
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want]
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_query_matches_plain_scheduler(spark):
    sf = "/root/testdata/sf0.01"
    out = mixing.op8_mixing(spark, sf).toPandas()
    n = out.groupby("source").size()
    names = sorted(n.index)
    want = brute([math.ceil(n[s] / mixing.BLOCK_ROWS) for s in names], [math.sqrt(n[s]) for s in names])
    got = out.groupby("slot")[["source", "block"]].first()
    assert [(s, b) for s, b in got.itertuples(index=False)] == [(names[j], b) for j, b in want]
