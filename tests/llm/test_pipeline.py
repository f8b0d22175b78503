import math

import corpus_pipeline
from chiffra.llm import mixing, quality
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_mixing import brute as schedule_of
from tests.llm.test_neardup import brute as families


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "sharding":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    raw = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good, single, clean, mixed, shards = steps
    verdict = {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert set(good) == verdict
    assert set(single) == {i for i, (_, c) in families([(i, raw[i]) for i in good]).items() if i == c}
    assert set(clean) == {i for i, hits in contaminated([(i, raw[i]) for i in single], list(enumerate(items))).items() if not hits}
    assert set(mixed) == set(clean) and all(mixed[i] == good[i] for i in mixed)
    order = [r["source"] for r in spark.read.parquet(str(tmp_path / "mixing")).coalesce(1).collect()]
    assert len(order) == len(mixed)
    assert set(shards) == set(mixed)
    loads = [sum(r["size"] for r in shards.values() if r["shard"] == j) for j in range(16)]
    assert max(loads) - min(loads) <= max(r["size"] for r in shards.values())
    run = {r["doc_id"]: r["shard"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert run == {i: r["shard"] for i, r in shards.items()} and math.isfinite(sum(loads))


def test_slots_follow_the_mixture(spark, tmp_path):
    rows = [(i, f"text {i} " * (1 + i % 7), s, "en", 10) for i, s in enumerate(["a"] * 500 + ["b"] * 60 + ["c"] * 200)] + [(7, "text 7 ", "a", "en", 10)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int")
    corpus_pipeline.mix(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    shards = corpus_pipeline.shard(spark, mixed, "").collect()
    order = [r["row"]["doc_id"] for r in mixing.mix_sources(docs).orderBy("slot", "block_row").collect()]
    for j in range(16):
        mine = sorted((r["slot"], r["doc_id"]) for r in shards if r["shard"] == j)
        held = {i for _, i in mine}
        assert [s for s, _ in mine] == list(range(len(mine)))
        assert [i for _, i in mine] == [i for i in order if i in held]


KIND = "doc_id long, text string, lang string, source string, n_chars int, row string, slot int, hits int, shard string, copies int, bucket long, component_id long, kept boolean, h1 long, place int"
PROSE = "The committee met on Tuesday and agreed that the bridge over the river needs new paint before winter comes."


def odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, shared ids, and names that the operators use themselves."""
    more = ("r", 1, 2, "s", 3, 4, 5, True, 6, 7)
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, PROSE, "en", "a", 100, *more), (2, PROSE + " And more was said.", "en", None, None, *more), (3, None, None, None, None, *[None] * 10), (4, "", "en", "a", 0, *more), (5, long, "en", "b", 9, *more)]
    rows += [(6, PROSE.upper(), "en", "a", 1, *more)] * 3 + [(None, PROSE, "en", "a", 1, *more)] * 2 + [(7, f"Another text of its own that says {i} other things about the weather of the day.", "fr", "b", 1, *more) for i in range(2)]
    return spark.createDataFrame(rows, KIND)


def test_stages_with_odd_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / f"in-{name}"))
        read = spark.read.parquet(str(tmp_path / f"in-{name}"))
        out = stage(spark, read, sf)
        assert stage(spark, read.limit(0) if name != "sharding" else spark.read.schema(KIND).parquet(str(tmp_path / f"in-{name}")).where("1 = 0"), sf).count() == 0
        if name == "sharding":
            assert out.count() == read.count() and out.where("shard is null or slot is null").count() == 0
            assert len({(r["shard"], r["slot"]) for r in out.collect()}) == read.count()
            continue
        assert out.columns == read.columns and out.schema.simpleString() == read.schema.simpleString()
        got = [r["doc_id"] for r in out.collect()]
        if name == "quality_rules":  # fewer than ten words fail the base rule; the clean texts stay, repeated ones too
            assert 3 not in got and 4 not in got and got.count(6) == 3 and got.count(None) == 2
        elif name == "near_dedup":  # 1, 2 and 6 say the same; rows without an id stand alone
            assert got.count(1) == 1 and 2 not in got and 6 not in got and got.count(None) == 2
        else:
            assert len(got) == read.count()
        docs = out


def test_mixture_and_decontamination_take_effect(spark, tmp_path):
    """The written order is that of the schedule, row by row; exactly the documents that hold an item go."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    corpus_pipeline.mix(spark, docs, sf).write.parquet(str(tmp_path / "m"))
    files = spark.read.parquet(str(tmp_path / "m")).select("source", "_metadata.file_path", "_metadata.row_index").collect()
    order = [r["source"] for r in sorted(files, key=lambda r: (len(r["file_path"]), r["file_path"], r["row_index"]))]
    n = {s: order.count(s) for s in sorted(set(order))}
    want = schedule_of([math.ceil(n[s] / mixing.BLOCK_ROWS) for s in n], [math.sqrt(n[s]) for s in n])
    at = 0
    left = dict(n)
    for j, _ in want:
        name = list(n)[j]
        size = min(mixing.BLOCK_ROWS, left[name])
        left[name] -= size
        assert order[at : at + size] == [name] * size
        at += size
    assert at == len(order)
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, sf).select("doc_id").collect()}
    rows = lambda t, i: [(r[i], r["text"]) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    assert kept == {d for d, hits in contaminated(rows("documents", "doc_id"), rows("benchmark", "item_id")).items() if not hits}
