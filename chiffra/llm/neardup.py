"""Operator 7, MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star edges.

Words are lower-cased (A-Z), shingles take five of them. One hash per shingle is cut into 256 bins by its top bits; a
bin's minimum is its slot, an empty bin copies a non-empty one found by a probing sequence of its own (optimal
densification). Four slots make a band: at a similarity of 0.75 a pair misses all 64 bands once in 10^10.

Texts with the same set of shingles are one class first, so a bucket holds different sets only. Each bucket gives a
star: its members are compared with its centre and not with one another. The centre is the member that shares most
buckets (the original of a family of edited copies), so stars follow families; buckets of up to ``SMALL`` members are
compared in full at once. Every candidate is confirmed on the full sets (100 * intersection >= 75 * union). Components
come from alternating large and small stars, which need a logarithmic number of rounds and never gather a component.

A bucket whose members still lie in several components is open, and stars say nothing about its other pairs. Open
buckets are therefore compared exactly: components that share one form a group, a group's members are dealt into blocks
of at most some ``BLOCK`` shingles (large components apart, the others by classes of size), and each pair of blocks that
could hold a link counts all common shingles: as products of incidence matrices, whose equal columns are one weighted
column, and one by one for rare shingles. Pairs of blocks of one component, or of sizes too unequal, are left out. No
pair that shares a bucket goes unseen. This is quadratic in the blocks of a group, so in a corpus where a third of all
documents share buckets without being similar to one another it costs what an exact join of that third costs.

Null, empty and wordless texts have an empty set, and link with nothing. Rows with a null doc_id stand alone: their
component_id is null and they are kept. Repeated rows all come back, with the same answer; rows that share a doc_id but
not a text are answered text by text, and links of either count for the doc_id. Ties between centres go to the larger
doc_id and do not change the result. A very long text is one set like any other. Extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chiffra.llm._common import FILTER_WORDS, copied_join, documents, dropped, id_bits, join_groups, stored, with_ids, without_ids
from chiffra.llm._text import Words, lists, mix, strings, tidy, windows

WIDTH = 5
SLOTS, PER_BAND = 256, 4
BANDS = SLOTS // PER_BAND
SMALL = 4
#: Shingles of a block in the full comparison (a set counts as ``LEAST`` at least), and columns of an incidence matrix.
BLOCK, LEAST, COLUMNS = 400_000, 200, 2048
#: Words of 64 bits in the bitmap of shared buckets: 2 MB.
BUCKET_WORDS = 1 << 18
#: A shingle that so few pairs of a pair of blocks share is counted pair by pair.
RARE = 64


def shingle_sets(w: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h = w.hashes()
    win = windows(h, WIDTH)
    out = []
    for lo, hi in zip(w.first[:-1], w.first[1:], strict=True):
        if hi - lo >= WIDTH:
            s = np.sort(win[lo : hi - WIDTH + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif hi > lo:
            out.append(mix(windows(h[lo:hi], int(hi - lo)), 3))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``SLOTS`` slots per set; sets are not empty."""
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    n = len(sets)
    flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
    cell = np.repeat(np.arange(n), size) * SLOTS + (flat >> shift).astype(np.int64)
    head = np.concatenate([[True], cell[1:] != cell[:-1]])  # sets are sorted, so the first of a bin is its minimum
    sig, full = np.zeros(n * SLOTS, np.uint64), np.zeros(n * SLOTS, bool)
    sig[cell[head]] = flat[head]
    full[cell[head]] = True
    empty, attempt = np.flatnonzero(~full), 0
    slots = np.arange(SLOTS, dtype=np.uint64)
    while len(empty):
        attempt += 1
        probe = (mix(slots, 1000 + attempt) % np.uint64(SLOTS)).astype(np.int64)
        source = empty - empty % SLOTS + probe[empty % SLOTS]
        hit = full[source]
        sig[empty[hit]] = sig[source[hit]]
        empty = empty[~hit]
    return sig.reshape(n, SLOTS)


def bands(sig: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(PER_BAND):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + mix(sig[:, k::PER_BAND])
    return mix(acc + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), 5)


def _sign(batches):
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        for lo, hi, data, offs in strings(col):
            sets = shingle_sets(Words(data, offs, lower=True))
            size = np.array([len(s) for s in sets])
            d1 = np.array([np.bitwise_xor.reduce(mix(s, 21)) if len(s) else 0 for s in sets], np.uint64)
            d2 = np.array([mix(s, 22).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            some = np.flatnonzero(size)
            b = bands(signatures([sets[i] for i in some])) if len(some) else np.zeros((0, BANDS), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists(b.reshape(-1).view(np.int64), np.where(size > 0, BANDS, 0))],
                ["doc_id", "n_shingles", "d1", "d2", "bands"],
            )


def _sets(bits: np.ndarray):
    """The sorted sets of the rows (doc_id, its hash, text) whose hash is marked."""

    def make(batches):
        for batch in batches:
            h = batch.column(1).to_numpy().view(np.uint64) & np.uint64(64 * len(bits) - 1)
            marked = (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(marked.astype(bool)))
            for lo, hi, data, offs in strings(batch.column(2)):
                sets = shingle_sets(Words(data, offs, lower=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists(np.concatenate(sets).view(np.int64), [len(s) for s in sets])], ["rep", "shingles"])

    return make


def candidate_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, shingles) of at least the documents in ``ids`` (rep). A bitmap of fixed size (``FILTER_WORDS`` words) tells
    which texts to cut, so that no text is shuffled; where it is too full for that it only lets more texts through."""
    words = id_bits(ids, "rep").toPandas()
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def make(batches):
        yield from _sets(sent.value)(batches)

    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(tidy(make), "rep long, shingles array<long>")
    return rows.where(F.size("shingles") > 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component: its smallest node) of the nodes of ``edges`` (a, b), by alternating large and small stars. They are
    done when no node with a smaller neighbour has another one: what is left then are stars around the smallest nodes."""
    size = Observation()
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = stored(now.observe(size, F.count(F.lit(1)).alias("n")), "stars")
    rows = size.get["n"]
    while rows:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        open_ = Observation()
        low = low.observe(open_, F.count_if((F.col("n") > 1) & (F.col("m") < F.col("u"))).alias("n"))
        low = stored(low.select("u", F.least("u", "m").alias("m"), "n"), "stars", rows=rows)
        if not open_.get["n"]:
            dropped(low)
            break
        # The centre of a star has a row for each leaf: such nodes are joined where their rows are. Each edge is two rows.
        large = stored(join_groups(both.where("v > u"), low, ["u"], "n", 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars", rows=rows)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_groups(large, least, ["u"], "n", 2 * rows).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = stored(small.select("e.*").where("u <> v").distinct(), "stars", rows=rows)
        dropped(now, low, large)
        now = after
    nodes = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``pairs`` are (leaf, centre): a set is a leaf at most once in a
    bucket, but the centre of any number of pairs."""
    both = copied_join(pairs, sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("sc")), "centre", "leaf", total)
    both = both.join(sets.select(F.col("rep").alias("leaf"), F.col("shingles").alias("sl")), "leaf")
    common = F.size(F.array_intersect("sl", "sc"))
    return both.where(100 * common >= 75 * (F.size("sl") + F.size("sc") - common)).select(F.least("leaf", "centre").alias("a"), F.greatest("leaf", "centre").alias("b"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)


def common_counts(fx: np.ndarray, rx: np.ndarray, fy: np.ndarray, ry: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many values each row of one side shares with each row of the other; values are distinct within a row."""
    words, at = np.unique(np.concatenate([fx, fy]), return_inverse=True)
    ax, ay = at[: len(fx)], at[len(fx) :]
    times = np.bincount(ax, minlength=len(words)) * np.bincount(ay, minlength=len(words))
    # Values that stand in the same rows are one column, which weighs as much as they are many.
    mark = np.zeros(len(words), np.uint64)
    np.add.at(mark, ax, mix(rx.astype(np.uint64), 31))
    np.add.at(mark, ay, mix(ry.astype(np.uint64), 32))
    shared = np.flatnonzero(times)
    _, first, weight = np.unique(mark[shared], return_index=True, return_counts=True)
    column, weight_of = np.full(len(words), -1), np.zeros(len(words), np.float32)
    kept = shared[first]
    weight_of[kept] = weight
    out = np.zeros(shape, np.float32)
    many, few = kept[times[kept] > RARE], kept[times[kept] <= RARE]
    column[many] = np.arange(len(many))
    cx, cy = column[ax], column[ay]
    for lo in range(0, len(many), COLUMNS):
        width = min(COLUMNS, len(many) - lo)
        parts = []
        for c, r, n in ((cx, rx, shape[0]), (cy, ry, shape[1])):
            hit = (c >= lo) & (c < lo + width)
            m = np.zeros((n, width), np.float32)
            m[r[hit], c[hit] - lo] = 1
            parts.append(m)
        out += (parts[0] * weight_of[many[lo : lo + width]]) @ parts[1].T
    if len(few):
        column[:] = -1
        column[few] = np.arange(len(few))
        ix, iy = (np.flatnonzero(column[a] >= 0) for a in (ax, ay))
        ix, iy = ix[np.argsort(column[ax[ix]], kind="stable")], iy[np.argsort(column[ay[iy]], kind="stable")]
        ny = np.bincount(column[ay[iy]], minlength=len(few))
        from_y = np.cumsum(ny) - ny
        c = column[ax[ix]]
        n = ny[c]
        y = iy[np.repeat(from_y[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        np.add.at(out.reshape(-1), np.repeat(rx[ix], n) * shape[1] + ry[y], np.repeat(weight_of[few][c], n))
    return out


def _compare(table: pa.Table) -> pa.Table:
    """The similar pairs (a, b) of different components between two blocks, or within one."""
    block, first, second = (table.column(c).to_numpy() for c in ("block", "x", "y"))
    sides = [table.filter(pa.array(block == b)) for b in (first[0], second[0])]
    rep, comp, size = ([s.column(c).to_numpy() for s in sides] for c in ("rep", "component", "n_shingles"))
    common = common_counts(*_flat(sides[0].column("shingles")), *_flat(sides[1].column("shingles")), (len(rep[0]), len(rep[1])))
    i, j = np.nonzero((175 * common >= 75 * (size[0][:, None] + size[1][None, :])) & (comp[0][:, None] != comp[1][None, :]))
    a, b = rep[0][i], rep[1][j]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _open_links(members: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame | None:
    """All similar pairs (a, b) of different components within open buckets; None where no bucket is open. ``members`` are
    (bucket, members, rep, n_shingles), ``comp`` (node, component)."""
    named = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = stored(named, "members")
    still = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("bucket", "low", "n")
    still = stored(still, "open")
    total = still.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        dropped(named, still)
        return None
    inside = stored(join_groups(named.select("bucket", "rep", "n_shingles", "component"), still, ["bucket"], "n", total).select("rep", "n_shingles", "component", "low").distinct(), "open")
    group = components(inside.select(F.col("component").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("group"))
    weight = F.greatest("n_shingles", F.lit(LEAST))
    mine = inside.select("rep", "n_shingles", "component").distinct()
    comps = mine.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight")).join(group, "component")
    comps = stored(comps, "open-components", rows=total)
    groups = comps.groupBy("group").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col("weight") < BLOCK, F.col("weight")).otherwise(0)).alias("rest"))
    comps = join_groups(comps, groups, ["group"], "k", total).select("component", "n", "group", F.when(F.col("weight") >= BLOCK, F.col("component")).alias("apart"), F.greatest(F.lit(1), F.ceil(F.when(F.col("weight") >= BLOCK, F.col("weight")).otherwise(F.col("rest")) / BLOCK)).alias("parts"))
    rows = join_groups(mine, comps, ["component"], "n", total)
    # Sizes of similar sets differ by a factor of 4/3 at most, so by one class at most.
    rows = rows.withColumn("class", F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100 / 75)) + 1e-9)).withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    rows = stored(rows.withColumn("block", F.xxhash64("group", "apart", "class", "part")).select("rep", "n_shingles", "component", "group", "apart", "class", "block"), "blocks")
    blocks = rows.groupBy("group", "apart", "class", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    x, y = blocks.alias("p"), blocks.alias("q")
    near = F.abs(F.col("p.class") - F.col("q.class")) <= 1
    mixed = F.least("p.low", "q.low") < F.greatest("p.high", "q.high")
    both = x.join(y, (F.col("p.group") == F.col("q.group")) & (F.col("p.block") <= F.col("q.block")) & near & mixed).select(F.col("p.block").alias("x"), F.col("q.block").alias("y"))
    sent = both.withColumn("block", F.explode(F.array_distinct(F.array("x", "y")))).join(rows, "block").join(sets, "rep")
    found = sent.select("x", "y", "block", "rep", "component", "n_shingles", "shingles").groupBy("x", "y").applyInArrow(_compare, "a long, b long")
    found = stored(found.where("a < b").distinct(), "links")
    dropped(named, still, inside, comps, rows)
    return found


def _apt(x: Column, y: Column) -> Column:
    """Sets whose sizes differ by more than a quarter can't be similar enough: such pairs are not formed."""
    return 100 * F.least(x, y) >= 75 * F.greatest(x, y)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and the set's digest (d1, d2) of every row of ``docs``."""
    sig = stored(docs.select("doc_id", "text").mapInArrow(tidy(_sign), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")), "classes")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]

    rows = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    held = Observation()
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").observe(held, F.coalesce(F.sum("members"), F.lit(0)).alias("n"))
    shared = stored(shared, "shared")
    places = held.get["n"]  # of sets in buckets that others share
    # Buckets of one member, nearly all, stop at a bitmap of the others and are not shuffled again.
    members = join_groups(with_ids(rows, shared, "bucket", BUCKET_WORDS), shared, ["bucket"], "members", places)
    members = members.groupBy("rep").agg(F.any_value("n_shingles").alias("n_shingles"), F.sum("members").alias("weight"), F.collect_list(F.struct("bucket", "members")).alias("buckets"))
    members = stored(members, "members")  # a set has ``BANDS`` buckets at most
    sets = stored(candidate_sets(docs, members.select("rep")), "shingles")
    members = members.select("rep", "n_shingles", "weight", F.inline("buckets"))

    small = members.where(F.col("members") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("rep", "n_shingles"))).alias("r"))
    small = small.select("r", F.explode("r").alias("x")).select("x", F.explode("r").alias("y")).where((F.col("x.rep") < F.col("y.rep")) & _apt(F.col("x.n_shingles"), F.col("y.n_shingles"))).select(F.col("x.rep").alias("leaf"), F.col("y.rep").alias("centre"))
    large = members.where(F.col("members") > SMALL)
    centres = large.groupBy("bucket").agg(F.max("members").alias("members"), F.max_by(F.struct("rep", "n_shingles"), F.struct("weight", "rep")).alias("c"))
    star = join_groups(large.select("bucket", "rep", "n_shingles"), centres, ["bucket"], "members", places)
    star = star.where((F.col("rep") != F.col("c.rep")) & _apt(F.col("n_shingles"), F.col("c.n_shingles"))).select(F.col("rep").alias("leaf"), F.col("c.rep").alias("centre"))
    seen = Observation()
    tried = stored(small.unionByName(star).distinct().observe(seen, F.count(F.lit(1)).alias("n")), "pairs")
    links = stored(_confirmed(tried, sets, seen.get["n"]), "links")
    comp = stored(components(links), "components")
    found = _open_links(large.select("bucket", "rep", "n_shingles"), comp, sets)
    if found is not None and not found.isEmpty():
        # Links between components join these; nodes that no star linked are components of their own.
        named = comp.withColumnRenamed("component", "now")
        ends = [found.join(named.withColumnRenamed("node", c), c, "left").select("a", "b", F.coalesce("now", c).alias("c")) for c in ("a", "b")]
        new = ends[0].withColumnRenamed("c", "ca").join(ends[1].withColumnRenamed("c", "cb"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = stored(components(new).withColumnRenamed("node", "now").withColumnRenamed("component", "to"), "components")
        alone = joined.join(comp, F.col("now") == F.col("node"), "left_anti").select(F.col("now").alias("node"), F.col("to").alias("component"))
        before = comp
        comp = stored(named.join(joined, "now", "left").select("node", F.coalesce("to", "now").alias("component")).unionByName(alone), "components")
        dropped(before, joined)
    answer = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n_shingles", "copies", F.coalesce("component", "rep").alias("component_id"))
    answer = stored(answer, "named")
    dropped(classes, shared, members, sets, tried, links, comp, *([found] if found is not None else []))
    answers = join_groups(full.select("doc_id", "d1", "d2", "n_shingles"), answer, ["d1", "d2", "n_shingles"], "copies", total).drop("copies")
    alone = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "d1", "d2", "n_shingles", F.col("doc_id").alias("component_id"))
    return answers.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_rows(docs: DataFrame) -> DataFrame:
    """One row of each group: that of its smallest doc_id, once even where it is repeated. Wordless and null-id rows stay."""
    verdict = near_duplicates(docs)
    goes = verdict.where("not kept").select("doc_id").distinct()
    again = stored(verdict.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    left = without_ids(docs, stored(goes, "goes"), "doc_id")
    if again.isEmpty():
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = with_ids(left, again, "doc_id").join(again, "doc_id", "left_semi")
    one = one.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row")).select("__row.*")
    return without_ids(left, again, "doc_id").unionByName(one)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", "n_shingles", "component_id", "kept")
