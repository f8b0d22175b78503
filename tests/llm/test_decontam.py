import random
import re
from collections import Counter, defaultdict

import numpy as np

from chiffra.llm import decontam

ITEMS = [
    (1, "A farmer named Wilson has 12 kg of apples and sells 5 kg of them to Carla before noon. How many kg are left for Wilson"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank"),
    (3, "tiny item"),
    (4, None),
    (5, ""),
    (None, "no id at all here in this item"),
]
SAME = "A farmer named Olaf has 31 lb of apples and sells 8 lb of them to Dana before noon. How many lb are left for Olaf"
MIXED = "A farmer named Olaf has 31 lb of apples and sells 8 oz of them to Dana before noon. How many km are left for Piet"
DOCS = [
    (0, f"Some words first. {ITEMS[0][1]}? Then more words.", [1]),
    (1, f"Prose before. {SAME}?", [1]),
    (2, f"Prose before. {MIXED}?", []),
    (3, "X y z. THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG NEAR THE OLD RIVER BANK!", [2]),
    (4, "the quick brown fox jumps over something else entirely and runs far away", []),
    (5, "Tiny item.", [3]),
    (6, "a tiny item in prose of several words", []),
    (7, None, []),
    (8, "", []),
    (9, "...", []),
    (10, "word " * 100_000 + ITEMS[1][1], [2]),
]


def test_cases(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in DOCS] + [(None, DOCS[0][1], None)] * 2, "doc_id long, text string, hits string")
    out = decontam.mark(df, items).collect()
    assert len(out) == len(DOCS) + 2
    want = {i: x for i, _, x in DOCS} | {None: [1]}
    for r in out:
        assert [h["item_id"] for h in r["hits"]] == want[r["row"]["doc_id"]], r["row"]["doc_id"]
    hows = {(r["row"]["doc_id"], h["how"]) for r in out for h in r["hits"]}
    assert (0, "verbatim") in hows and (1, "template") in hows
    kept = decontam.clean_rows(df, items)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, x in DOCS if not x]
    assert decontam.mark(df, items.limit(0)).where("size(hits) > 0").count() == 0
    assert decontam.mark(df.limit(0), items).count() == 0


OUTER = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"
UNITS, NUMBERS = set(decontam.UNITS.split()), set(decontam.NUMBERS.split())
NUMBERS |= {f"{t}-{o}" for t in decontam.TENS.split() for o in decontam.ONES.split()}


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_view(text, view):
    """[(key, slot value or None)] of a text, token by token."""
    out, opening, number = [], True, False
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        token = word.strip(OUTER)
        if not token:
            continue
        w = low(token)
        is_number = token[0] in "0123456789" or w in NUMBERS or (any(c in "0123456789" for c in w) and set(w) <= set("0123456789.,:/-"))
        kind = None
        if is_number:
            kind = "number"
        elif number and w in UNITS:
            kind = "unit"
        elif token[0].isupper() and (view == 2 or not opening):
            kind = "name"
        number, opening = is_number, word[-1] in ".!?:;"
        if not view or kind is None:
            out.append((w, None))
        elif out and out[-1][1] is not None and out[-1][0] == f"<{kind}>":
            out[-1] = (out[-1][0], (*out[-1][1], w))
        else:
            out.append((f"<{kind}>", (w,)))
    return out


def plain_windows(tokens, view):
    n = decontam.WIDTH
    spans = [(i, tokens[i : i + n]) for i in range(len(tokens) - n + 1)] if len(tokens) >= n else [(0, tokens)] if tokens else []
    out = defaultdict(list)
    for i, span in spans:
        if not view or sum(v is None for _, v in span) >= decontam.LITERALS:
            out[len(span), tuple(k for k, _ in span)].append(i)
    return out


def plain_agrees(item, iw, doc, dw):
    first = {w: p[0] for w, p in iw.items()}
    places = [(a, p) for w, a in first.items() for p in dw.get(w, [])]
    votes = Counter(p - a for a, p in places)
    best = {}
    for a, p in places:
        if a not in best or (-votes[p - a], p) < (-votes[best[a] - a], best[a]):
            best[a] = p
    cells = {(a + i, p + i) for a, p in best.items() for i in range(decontam.WIDTH) if a + i < len(item) and p + i < len(doc)}
    pairs = Counter((item[a][1], doc[p][1]) for a, p in cells if item[a][1] is not None and doc[p][1] is not None)
    most = [defaultdict(int), defaultdict(int)]
    for (x, y), n in pairs.items():
        most[0][x], most[1][y] = max(most[0][x], n), max(most[1][y], n)
    return min(sum(m.values()) for m in most) >= decontam.AGREE * sum(pairs.values())


def brute(docs, items):
    cut = lambda t: [(v, plain_windows(v, k)) for k in range(3) for v in [plain_view(t, k)]]
    bench, out = [(i, cut(t)) for i, t in items if i is not None and t], {}
    for d, text in docs:
        mine, hits = cut(text), set()
        for i, theirs in bench:
            for k in range(3):
                need = theirs[k][1]
                if need and 100 * sum(w in mine[k][1] for w in need) >= decontam.SHARE * len(need) and (not k or plain_agrees(*theirs[k], *mine[k])):
                    hits.add(i)
        out[d] = hits
    return out


PROBLEM = "Tom has 3 apples. Ann gives him 2 more. How many apples does Tom have now?"
VARIANTS = [
    ("Bob has 5 apples. Eve gives him 4 more. How many apples does Bob have now?", True),
    ("Bob has 5 apples. Eve gives him 4 more. How many apples does Eve have now?", False),
    ("Words of prose. Mary Ann has 1 500 apples. Mister Lee gives him twenty-five more. How many apples does Mary Ann have now? Words", True),
    ("Борис has 7 apples. Ελένη gives him 9 more. How many apples does Борис have now?", True),
    ("Tom has 3 pears. Ann takes 2 from him. Who has most of them now?", False),
]


def test_parameters_of_other_lengths(spark):
    items = spark.createDataFrame([(1, PROBLEM), (2, "A train leaves New York at 5 and arrives in Chicago at 1 500 after the long night")], "item_id long, text string")
    docs = [*VARIANTS, ("Here: a train leaves Boston at twelve and arrives in San Francisco at 9 after the long night, they say.", True), ("x " * 50 + (VARIANTS[0][0] + " ") * 400, True)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: bool(r["hits"]) for r in decontam.mark(df, items).collect()}
    assert got == {i: x for i, (_, x) in enumerate(docs)}


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    names = ["Tom", "Ann", "New York", "Jean Paul Roux", "Борис", "Zed", "O'Neil"]
    amounts = ["3", "1 500", "twenty-five", "7.5", "two", "12"]
    units = ["kg", "km", "days", "euros"]
    frames = ["{a} buys {x} {u} of rice from {b} and sells {y} {u} to {c} before noon", "The road from {a} to {b} is {x} {u} long. {c} walks {y} {u} of it on foot", "Why did {a} pay {x} for the book that {b} had bought for {y}? Ask {c} or {a}", "{a}: {x} {u}"]

    def say():
        n, v, u = rng.choice(len(names), 3), rng.choice(len(amounts), 2), rng.choice(len(units))
        return frames[rng.integers(len(frames))].format(a=names[n[0]], b=names[n[1]], c=names[n[2]], x=amounts[v[0]], y=amounts[v[1]], u=units[u])

    items = [(i, say()) for i in range(40)] + [(90, None), (91, ""), (None, say())]
    docs = [(i, " ".join(say() if rng.random() < 0.5 else "some other words of no use" for _ in range(rng.integers(0, 5)))) for i in range(150)]
    want = brute(docs, items)
    found = decontam.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    same = {c["item_id"]: c for c in decontam.item_classes(spark.createDataFrame(items, "item_id long, text string")).collect()}
    for r in found:
        got, all_ = {h["item_id"] for h in r["hits"]}, want[r["row"]["doc_id"]]
        assert got <= all_ and got <= set(same) and bool(got) == bool(all_), r
    assert 10 < sum(bool(x) for x in want.values()) < 140


def test_tables_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = lambda t, i: [(r[i], r["text"]) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    want = brute(rows("documents", "doc_id"), rows("benchmark", "item_id"))
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontam.op10_decontamination(spark, sf).collect()}
    assert got == want


def test_a_large_benchmark_is_one_python_node(spark):
    """A hundred thousand items of one template: no pair of items is formed and the plan does not grow."""
    items = spark.range(100_000).selectExpr("id item_id", "concat('In ', id, ' minutes the pump of Lyon moves ', id + 7, ' litres of water out of the old tank') text")
    docs = spark.createDataFrame([(1, "In 3 minutes the pump of Nice moves 10 litres of water out of the old tank"), (2, "In 3 minutes the pump moves nothing out of the tank"), (3, None)], "doc_id long, text string")
    out = decontam.mark(docs, items)
    assert {r["row"]["doc_id"]: len(r["hits"]) for r in out.collect()} == {1: 1, 2: 0, 3: 0}
    assert out._jdf.queryExecution().toString().count("MapInArrow") <= 4


def test_verbatim_items_of_the_tables_are_found(spark):
    sf = "/root/testdata/sf0.01"
    d = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    b = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = {i for i, t in d.items() if any(x in t for x in b)}
    got = {r["doc_id"] for r in decontam.op10_decontamination(spark, sf).where("contaminated").collect()}
    assert plain <= got and len(got) < len(plain) + 20


TOM = "Tom has 3 apples. Ann gives him 2 more. How many apples does Tom have now?"
BOB = "Bob has 5 apples. Eve gives him 4 more. How many apples does Bob have now?"


def test_other_names_behind_other_texts(spark):
    """Words in front of the item don't become part of its first name, and names without capitals are names."""
    texts = [BOB, f"Question: {BOB}", f"Q: {BOB}", f"We flew to Paris. {BOB}", BOB.lower(), BOB.upper(), f"question: {BOB.lower()} answer: 9", f"{BOB} Answer: 9"]
    other = ["bob has 5 apples. eve gives him 4 more. how many apples does carl have now?", "Bob has 5 apples. Eve gives him 4 more. How many apples does Eve have now?", "bob has 5 pears. eve sells him 4 nuts. how many shells does bob want now?"]
    docs = spark.createDataFrame(list(enumerate(texts + other)), "doc_id long, text string")
    out = {r["row"]["doc_id"]: bool(r["hits"]) for r in decontam.mark(docs, spark.createDataFrame([(1, TOM)], "item_id long, text string")).collect()}
    assert out == {i: i < len(texts) for i in range(len(texts + other))}


def recall_cases(n=60, seed=3):
    """Items with names, numbers and units, and re-parameterised variants of each within other text."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ba ke mi lo du sa ti ro nu pe".split() for b in "ran tel sim pon dur lek fam nis".split()]
    names = ["Tom", "Ann", "Bob", "Eve", "Olaf", "Dana", "Wilson", "Carla", "Piet", "Yara"]
    units = ["kg", "lb", "km", "hours", "days", "litres"]
    items, docs = [], []
    for i in range(n):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(18, 40))]
        spots = sorted(rng.sample(range(2, len(body) - 2), 5))
        slots = ["name:0", "num:0", "name:1", "num:1", "name:0"]

        def text(people, numbers, unit, body=body, spots=spots, slots=slots):
            words = list(body)
            for s, k in zip(spots, slots, strict=True):
                kind, which = k.split(":")
                words[s] = people[int(which)] if kind == "name" else f"{numbers[int(which)]} {unit}"
            half = len(words) // 2
            first, second = " ".join(words[:half]), " ".join(words[half:])
            return f"{first[0].upper()}{first[1:]}. {second[0].upper()}{second[1:]}?"

        items.append((i, text(rng.sample(names, 2), rng.sample(range(2, 99), 2), rng.choice(units))))
        new = text(rng.sample(names, 2), rng.sample(range(100, 999), 2), rng.choice(units))
        docs += [(i, t) for t in (new, f"Question: {new}", f"Q: {new} A: 12.", f"We flew to Paris. {new} Then came Rome.", new.lower(), f"Exercise 7. {new.lower().capitalize()}")]
    return items, docs


def test_recall_of_variants(spark):
    items, docs = recall_cases()
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(docs)], "doc_id long, item long, text string")
    out = decontam.mark(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = [[h["item_id"] for h in r["hits"]] == [r["row"]["item"]] for r in out]
    by_kind = [sum(f for f, r in zip(found, out, strict=True) if r["row"]["doc_id"] % 6 == k) / 60 for k in range(6)]
    print(by_kind)
    assert min(by_kind[:5]) >= 0.9 and not any(set(h["item_id"] for h in r["hits"]) - {r["row"]["item"]} for r in out)
