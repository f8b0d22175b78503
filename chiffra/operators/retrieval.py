"""Retrieval: BM25, dense search, fusion, refusal; every question against every passage in one job."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chiffra.functions import text as T
from chiffra.sources.index import Bm25Index, CellIndex, bucket_of, kept, stripe_of

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms of questions that are broadcast, at some 50 bytes each.
MOST_SENT = 500_000
#: Stripes whose passages are scored in one task, for so many questions at a time.
LOT, SCORED = 16, 256


def top_k(scored: DataFrame, k: int, by: str, key: str, score: str = "score") -> DataFrame:
    """The best ``k`` per ``by``: by score to nine digits, then key. The limit is applied below the shuffle."""
    w = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def question_terms(questions: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(qid, term, weight): a repeated term counts as often as it stands."""
    return questions.select(F.col(key).alias("qid"), F.explode(T.tokens(F.col(text))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term of weight 1 adds to a passage's score. It rises with ``tf`` and falls with ``dl``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _wanted(index: Bm25Index, terms: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(qid, term, w, avgdl) of the terms that the index has, the blocks in the folders of those terms, and whether the terms are
    few: up to ``MOST_SENT`` they are broadcast, beyond that they meet the blocks in a shuffle."""
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    wanted = terms.join(index.terms, "term").crossJoin(F.broadcast(index.stats))  # one row of statistics
    wanted = wanted.select("qid", "term", "avgdl", (F.col("weight") * F.when(raw < 0, EPSILON * F.col("mean_idf")).otherwise(raw)).alias("w"))
    folders = terms.groupBy(bucket_of(F.col("term")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most BUCKETS rows
    few = sum(r["n"] for r in folders) <= MOST_SENT
    return F.broadcast(wanted) if few else wanted.hint("merge"), index.blocks.where(F.col("bucket").isin([r["b"] for r in folders])), few


def _scored(hits: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """(qid, id, score) from joined blocks (qid, w, avgdl, ids, tfs, dls)."""
    rows = hits.select("qid", "w", "avgdl", F.inline(F.arrays_zip("ids", "tfs", "dls")))
    rows = rows.select("qid", F.col("ids").alias("id"), (F.col("w") * impact(F.col("tfs"), F.col("dls"), F.col("avgdl"))).alias("part"))
    rows = rows if allowed is None else rows.join(allowed, "id", "left_semi")
    return rows.groupBy("qid", "id").agg(F.sum("part").alias("score")).where("score > 0")


def bm25(index: Bm25Index, terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score) of all passages with one of the weighted terms (qid, term, weight), from a stored index. Statistics come
    from all passages; ``allowed`` (id) restricts what is scored."""
    wanted, blocks, _ = _wanted(index, terms)
    return _scored(blocks.join(wanted, "term"), allowed)


def stripe_bounds(index: Bm25Index, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(qid, stripe, bound): no passage of the stripe scores higher. Beside it the wanted terms and the blocks of their folders."""
    wanted, blocks, _ = _wanted(index, terms)
    return _bounds(wanted, blocks), wanted, blocks


def _bounds(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    best = F.array_max(F.transform("front", lambda p: impact(p["tf"], p["dl"], F.col("avgdl"))))
    return blocks.select("term", "stripe", "front").join(wanted, "term").groupBy("qid", "stripe").agg(F.sum(F.greatest(F.lit(0.0), F.col("w") * best)).alias("bound"))


def bm25_top_k(index: Bm25Index, terms: DataFrame, k: int, allowed: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """(qid, id, score, rank): the best ``k`` of each question, exactly.

    Up to ``MOST_SENT`` terms go out to lots of stripes, each of which moves once, whatever the number of questions, and sends on
    its own best ``k`` a question. Of more terms, only few blocks meet the questions: see ``_pruned_top_k``."""
    wanted, blocks, few = _wanted(index, terms)
    return _lots_top_k(index, wanted, blocks, k, allowed) if few else _pruned_top_k(wanted, blocks, k, allowed, first)


def _lots_top_k(index: Bm25Index, wanted: DataFrame, blocks: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    rows = wanted.collect()  # at most MOST_SENT
    spark, stripes = blocks.sparkSession, index.stats.first()["stripes"]
    questions, avgdl = sorted({r["qid"] for r in rows}), rows[0]["avgdl"] if rows else None
    number, asked = {q: i for i, q in enumerate(questions)}, {}
    for r in sorted(rows, key=lambda r: r["term"]):
        asked.setdefault(r["term"], []).append((number[r["qid"]], r["w"]))
    sent = spark.sparkContext.broadcast((np.array(questions, np.int64), asked))

    def best(lot: pa.Table, may: pa.Table | None = None) -> pa.Table:
        (qids, asked), lot = sent.value, lot.combine_chunks()
        flat = lambda c: lot[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) if lot.num_rows else np.zeros(0)
        tf, dl, n = flat("tfs"), flat("dls"), np.diff(lot["ids"].combine_chunks().offsets.to_numpy()) if lot.num_rows else np.zeros(0, int)
        keys, at = np.unique(flat("ids"), return_inverse=True)
        part = impact(tf, dl, avgdl)
        open_ = np.ones(len(keys), bool) if may is None else np.isin(keys, may["id"].to_numpy())
        ends = np.cumsum(n)
        spans: dict[str, list[tuple[int, int]]] = {}
        for term, end, size in zip(lot["term"].to_pylist(), ends.tolist(), n.tolist(), strict=True):
            spans.setdefault(term, []).append((end - size, end))
        out = [pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        for lo in range(0, len(qids) if open_.any() else 0, SCORED):
            scores = np.zeros((min(SCORED, len(qids) - lo), len(keys)))
            for term in sorted(spans):
                here = [(q - lo, w) for q, w in asked[term] if lo <= q < lo + SCORED]
                if here:
                    x = np.concatenate([part[a:b] for a, b in spans[term]])
                    to = np.concatenate([at[a:b] for a, b in spans[term]])
                    for q, w in here:
                        scores[q, to] += w * x  # a passage has one posting of a term
            found = pa.Table.from_batches([_best(qids[lo : lo + SCORED], keys[open_], np.round(scores[:, open_], 9), k, scores[:, open_])])
            out.append(found.filter(pc.greater(found["score"], 0.0)))
        return pa.concat_tables(out)

    lot = lambda stripe: F.floor(stripe / LOT).alias("lot")
    met = blocks.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").select(lot(F.col("stripe")), "term", "ids", "tfs", "dls").groupBy("lot")
    kind = "qid long, id long, score double"
    if allowed is None:
        found = met.applyInArrow(lambda x: best(x), kind)  # noqa: PLW0108 (with two arguments the first would be the key)
    else:
        may = allowed.select(lot(stripe_of(F.col("id"), F.lit(stripes))), F.col("id").cast("long").alias("id"))
        found = met.cogroup(may.groupBy("lot")).applyInArrow(lambda x, y: best(x, y), kind)  # noqa: PLW0108
    return top_k(found, k, "qid", "id")


def _pruned_top_k(wanted: DataFrame, blocks: DataFrame, k: int, allowed: DataFrame | None, first: int | None) -> DataFrame:
    """The bounds of a stripe's blocks add up to a bound of its passages. The ``first`` stripes of highest bound are scored; the k-th
    score among them is a floor of the result, and of the other stripes only those whose bound reaches it are scored. The
    bounds are read without the postings, and the postings only of the stripes that are left."""
    first = first or max(2, -(-k // 4))
    # What later steps read more than once is kept as a small table; lazily each would run all steps before it again.
    bounds = kept(_bounds(wanted, blocks), "bounds")
    best = top_k(bounds.withColumnRenamed("bound", "score"), first, "qid", "stripe").select("qid", "stripe")
    score = lambda chosen: _scored(blocks.join(wanted, "term").join(chosen, ["qid", "stripe"], "left_semi"), allowed)
    head = kept(top_k(score(best), k, "qid", "id").select("qid", "id", "score", "rank"), "bm25-head")
    floor = head.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    rest = bounds.join(floor, "qid", "left").where(F.col("bound") >= F.coalesce(F.col("floor"), F.lit(0.0)) * (1 - 1e-9) - 1e-9).select("qid", "stripe").join(best, ["qid", "stripe"], "left_anti")
    return top_k(head.drop("rank").unionByName(score(rest)), k, "qid", "id")


def expanded(terms: DataFrame, families: DataFrame, weight: float = 0.3, most: int = 4, questions: DataFrame | None = None) -> DataFrame:
    """Add up to ``most`` new terms per synonym family (family, pos, term) that a question touches, at ``weight``.

    A one-word synonym touches a question that has its token. One of several words touches a question (qid, text) in which
    the words stand as a phrase; its tokens are added one by one. A token is added once, by the first family that has it."""
    f = families.withColumn("phrase", F.regexp_replace(F.replace(T.normalised(F.col("term")), F.lit("_"), F.lit(" ")), r"\s+", " "))
    tok = f.select("family", "pos", F.posexplode(T.tokens(F.col("phrase"))).alias("at", "token"), F.contains("phrase", F.lit(" ")).alias("several"))
    touched = terms.join(tok.where(~F.col("several")), F.col("term") == F.col("token")).select("qid", "family").distinct()
    if questions is not None:
        # A phrase is looked up by its first word, then compared as a whole.
        words = F.regexp_extract_all(T.normalised(F.col("text")), F.lit(r"[^\s]+"), 0)
        q = questions.select("qid", F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("q"), F.explode(F.array_distinct(words)).alias("head"))
        phrases = f.where(F.contains("phrase", F.lit(" "))).select("family", "phrase", F.substring_index("phrase", " ", 1).alias("head"))
        said = q.join(phrases, "head").where(F.contains("q", F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))).select("qid", "family")
        touched = touched.unionByName(said).distinct()
    extra = touched.join(tok, "family").join(terms.select("qid", F.col("term").alias("token")), ["qid", "token"], "left_anti")
    extra = extra.groupBy("qid", "token").agg(F.min(F.struct("family", "pos", "at")).alias("p")).select("qid", "token", "p.*")
    nth = Window.partitionBy("qid", "family").orderBy("pos", "at")
    extra = extra.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= most)
    return terms.unionByName(extra.select("qid", F.col("token").alias("term"), F.lit(weight).alias("weight")))


def search(index: Bm25Index, vectors: DataFrame | None, terms: DataFrame, queries: DataFrame | None, mode: str = "hybrid", allowed: DataFrame | None = None, channel: int = 50, k: int = 60, top_n: int = 5) -> DataFrame:
    """(qid, id, score, rank, rank_lexical, rank_dense): the ``top_n`` of one mode. ``lexical`` ranks by BM25, ``dense`` by inner
    product, ``hybrid`` fuses the best ``channel`` of each by reciprocal ranks; all are restricted before ranking."""
    none = F.lit(None).cast("int")
    lexical = None if mode == "dense" else bm25_top_k(index, terms, channel, allowed)
    dense = None if mode == "lexical" else dense_top_k(vectors if allowed is None else vectors.join(allowed, "id", "left_semi"), queries, channel)
    if mode == "lexical":
        return lexical.where(F.col("rank") <= top_n).select("qid", "id", "score", "rank", F.col("rank").alias("rank_lexical"), none.alias("rank_dense"))
    if mode == "dense":
        return dense.where(F.col("rank") <= top_n).select("qid", "id", "score", "rank", none.alias("rank_lexical"), F.col("rank").alias("rank_dense"))
    return rrf([lexical, dense], k, top_n).withColumnsRenamed({"rank_0": "rank_lexical", "rank_1": "rank_dense"})


def excerpts(hits: DataFrame, texts: DataFrame, questions: DataFrame, most: int = 420, sentences: int = 4) -> DataFrame:
    """``hits`` (qid, id, …) with ``excerpt``: up to four sentences from the one before that which shares most words with the
    question, cut at ``most`` characters. ``texts`` are (id, text), ``questions`` (qid, words: a token set)."""
    cut = F.split("text", r"(?<=[.;!?])\s+|\n")
    rows = hits.join(texts, "id").withColumn("s", cut).join(questions, "qid")
    rows = rows.withColumn("shared", F.transform("s", lambda x: F.size(F.array_intersect(T.token_set(x), F.col("words")))))
    best = F.array_position("shared", F.array_max("shared")).cast("int")  # the first of the best
    text = F.trim(F.array_join(F.slice("s", F.greatest(F.lit(1), best - 1), F.lit(sentences)), " "))
    return rows.select(*hits.columns, F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text).alias("excerpt"))


def thresholds_for(encoder: str, by_encoder: dict[str, float], default: float) -> float:
    """The calibrated threshold of an encoder, else the default: signals of different encoders do not compare."""
    return by_encoder.get(encoder, default)


def suggestions(refused: DataFrame, titles: DataFrame, signals: DataFrame, threshold: float, tried: int = 15, shown: int = 3) -> DataFrame:
    """(qid, position, title): for refused questions (qid, words, years) up to three titles that share most words with them,
    half a word more for a year in common, and whose own signal passes the threshold. ``titles`` are (title_id, title, words,
    years), ``signals`` (title_id, signal). Titles and questions meet on their words; the best ``tried`` are considered."""
    t = titles.select("title_id", "title", F.col("years").alias("ty"), F.explode("words").alias("w"))
    q = refused.select("qid", "years", F.explode("words").alias("w"))
    near = q.join(t, "w").groupBy("qid", "title_id").agg(F.count(F.lit(1)).alias("common"), F.first("title").alias("title"), F.first(F.arrays_overlap("years", "ty")).alias("same_year"))
    order = Window.partitionBy("qid").orderBy((F.col("common") + F.when(F.col("same_year"), 0.5).otherwise(0.0)).desc(), "title_id")
    best = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= tried).join(signals, "title_id").where(F.col("signal") >= threshold)
    clean = best.withColumn("title", F.trim(F.regexp_replace("title", r"\s*\(en ?%\)\s*", " "))).groupBy("qid", "title").agg(F.min("n").alias("n"))
    out = clean.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("n")))
    return out.where(F.col("position") <= shown).select("qid", "position", "title")


#: Fixed value: a model's answer that says it has none.
NO_ANSWER = r"(?i)ne (r[ée]pondent|permettent|contiennent|fournissent|mentionnent) pas|pas d'information|aucune information|ne sais pas|impossible de r[ée]pondre"


#: Bytes of query vectors that are sent out at once, and queries that meet a batch of vectors as one matrix product.
SENT_BYTES, PRODUCT = 64 << 20, 1024


def _best(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int, exact: np.ndarray | None = None) -> pa.RecordBatch:
    """The best ``k`` of each row of ``scores`` (queries by vectors), ties by key; with scores of ``exact`` if given."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        q, v = np.nonzero(scores >= least[:, None])
    else:
        q, v = (x.reshape(-1) for x in np.indices(scores.shape))
    order = np.lexsort((keys[v], -scores[q, v], q))
    q, v = q[order], v[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    q, v = q[nth < k], v[nth < k]
    return pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(keys[v], pa.int64()), pa.array((scores if exact is None else exact)[q, v], pa.float64())], ["qid", "id", "score"])


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(qid, id, score, rank): the best ``k`` inner products of each query (qid, v) over vectors (id, v).

    Queries go out in blocks of bounded size, and the vectors are read once a block. Each batch of vectors meets ``PRODUCT``
    queries at a time as one matrix product and sends on its own best ``k`` per query only, so the shuffle holds at most
    k rows per query and batch."""
    spark, out = vectors.sparkSession, None

    def blocks():
        now, size = [], 0
        for r in queries.toLocalIterator():
            now.append((r["qid"], r["v"]))
            size += 8 * len(r["v"])
            if size >= sent_bytes:
                yield now
                now, size = [], 0
        if now:
            yield now

    for part in blocks():
        sent = spark.sparkContext.broadcast((np.array([q for q, _ in part], np.int64), np.array([v for _, v in part], np.float64)))

        def search(batches, sent=sent):
            ids, q = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                for lo in range(0, len(ids), PRODUCT):
                    yield _best(ids[lo : lo + PRODUCT], keys, np.round(q[lo : lo + PRODUCT] @ x.T, 9), k)

        found = vectors.where("v is not null").select("id", "v").mapInArrow(search, "qid long, id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "qid long, id long, score double")
    return top_k(out, k, "qid", "id")


#: Vectors of a cell, and queries, that meet in one task.
PIECE, ASKED = 4096, 1024


def cell_bounds(index: CellIndex, queries: DataFrame) -> DataFrame:
    """(qid, cell, bound) of queries (qid, v): q·x = q·c + q·(x - c), so no product in a cell exceeds q·c + |q| r."""
    cells = index.cells.select("cell", "centre", "radius").collect()  # at most MOST_CELLS
    number, radius = np.array([r["cell"] for r in cells], np.int32), np.array([r["radius"] for r in cells])
    centre = np.array([r["centre"] for r in cells], np.float64).reshape(len(cells), len(cells[0]["centre"]) if cells else 0)

    def bound(batches):
        for b in batches:
            q = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            if q.size and len(number):
                most = q @ centre.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius
                ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), len(number))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.tile(number, b.num_rows)), pa.array(most.ravel())], ["qid", "cell", "bound"])

    whole = queries.where(F.size("v") == centre.shape[1] if len(cells) else F.lit(False))
    return whole.select(F.col("qid").cast("long").alias("qid"), F.col("v").cast("array<double>").alias("v")).mapInArrow(bound, "qid long, cell int, bound double")


def _in_cells(vectors: DataFrame, sizes: DataFrame, queries: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(qid, id, score): the best ``k`` of each query in each piece of its chosen cells (qid, cell). Cells are cut to pieces of
    some ``PIECE`` vectors and the queries of a cell to lots of some ``ASKED``, so no task depends on the size of either."""
    asked = chosen.join(queries.select("qid", "v"), "qid")
    lots = chosen.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("lots")).join(sizes, "cell").select("cell", "lots", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"))
    lots = F.broadcast(lots)  # a row a cell
    left = vectors.join(lots, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), "pieces").cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    right = asked.join(lots, "cell").select("qid", F.col("v").cast("array<double>").alias("v"), "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("qid"), "lots").cast("int").alias("lot"))

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        matrix = lambda t: np.asarray(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1)
        return pa.Table.from_batches([_best(q["qid"].to_numpy(), x["id"].to_numpy(), np.round(matrix(q) @ matrix(x).T, 9), k)])

    keys = ["cell", "piece", "lot"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "qid long, id long, score double")


def cells_top_k(index: CellIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None, first: int = 2) -> DataFrame:
    """(qid, id, score, rank): the best ``k`` inner products of each query (qid, v), exactly. The ``first`` cells of highest bound
    give a floor, and only cells whose bound reaches it are read further. ``allowed`` (id) restricts what is scored."""
    vectors = index.vectors if allowed is None else index.vectors.join(allowed, "id", "left_semi")
    sizes = index.cells.select("cell", "n")
    bounds = cell_bounds(index, queries)
    # What later steps read more than once is kept as a small table; lazily each would run all steps before it again.
    best = kept(top_k(bounds.withColumnRenamed("bound", "score"), first, "qid", "cell").select("qid", "cell"), "cells-first")
    head = kept(top_k(_in_cells(vectors, sizes, queries, best, k), k, "qid", "id"), "cells-head")
    floor = head.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    rest = kept(open_cells(bounds, floor).join(best, ["qid", "cell"], "left_anti"), "cells-rest")
    return top_k(head.drop("rank").unionByName(_in_cells(vectors, sizes, queries, rest, k)), k, "qid", "id")


def open_cells(bounds: DataFrame, floor: DataFrame) -> DataFrame:
    """(qid, cell) of the cells that may hold a product of the query's ``floor`` (qid, floor) or more; all without a floor."""
    reaches = F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-8 * (1 + F.abs("floor")))
    return bounds.join(floor, "qid", "left").where(reaches).select("qid", "cell")


def rrf(rankings: list[DataFrame], k: int = 60, top_n: int | None = 5) -> DataFrame:
    """Reciprocal rank fusion of rankings (qid, id, rank): sum of 1 / (k + rank)."""
    both = None
    for n, r in enumerate(rankings):
        r = r.select("qid", "id", "rank", F.lit(n).alias("list"))
        both = r if both is None else both.unionByName(r)
    fused = both.groupBy("qid", "id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        *[F.max(F.when(F.col("list") == n, F.col("rank"))).alias(f"rank_{n}") for n in range(len(rankings))],
    )
    return top_k(fused, top_n, "qid", "id") if top_n else fused


def refusal(signal: DataFrame, threshold: float) -> DataFrame:
    """Refuse where the signal (or none at all) lies under the threshold."""
    return signal.withColumn("refused", F.coalesce(F.col("signal"), F.lit(0.0)) < threshold)


def balanced_threshold(signals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The midpoint between neighbouring signals with the best (TPR + TNR) / 2, the lowest on ties; per ``by`` if given.
    Counts below each midpoint are running sums, so no pair of rows is formed."""
    by = by or []
    levels = signals.groupBy(*by, "signal").agg(F.count_if("outside").alias("out"), F.count_if(~F.col("outside")).alias("ins"))
    run = Window.partitionBy(*by).orderBy("signal")
    all_ = Window.partitionBy(*by)
    t = levels.withColumn("next", F.lead("signal").over(run)).withColumn("tpr", F.sum("out").over(run.rowsBetween(Window.unboundedPreceding, 0)) / F.nullif(F.sum("out").over(all_), F.lit(0)))
    t = t.withColumn("tnr", 1 - F.sum("ins").over(run.rowsBetween(Window.unboundedPreceding, 0)) / F.nullif(F.sum("ins").over(all_), F.lit(0)))
    t = t.where("next is not null").select(*by, ((F.col("signal") + F.col("next")) / 2).alias("threshold"), F.round((F.coalesce("tpr", F.lit(0.0)) + F.coalesce("tnr", F.lit(0.0))) / 2, 12).alias("score"))
    best = F.max_by(F.struct("threshold", "score"), F.struct("score", -F.col("threshold"))).alias("b")
    return (t.groupBy(*by).agg(best) if by else t.agg(best)).select(*by, "b.threshold", "b.score")


def capped_threshold(signals: DataFrame, most: float = 0.05) -> DataFrame:
    """The midpoint under the (k + 1)-th lowest signal of inside questions, k = int(most * n), and the next signal below."""
    ins = signals.where(~F.col("outside"))
    n = ins.agg(F.floor(F.count(F.lit(1)) * most).alias("k"))
    nth = ins.select("signal", F.row_number().over(Window.orderBy("signal")).alias("r")).crossJoin(F.broadcast(n)).where("r = k + 1").select(F.col("signal").alias("high"))
    low = signals.crossJoin(F.broadcast(nth)).where("signal < high").agg(F.max("signal").alias("low"))
    return nth.crossJoin(low).select(((F.col("high") + F.coalesce(F.greatest("low", F.lit(0.0)), F.lit(0.0))) / 2).alias("threshold"))


def ranking_metrics(ranked: DataFrame, k: int = 5) -> list[Column]:
    """Aggregates per question over rows (rank, rel): success at 1 and k, reciprocal rank."""
    return [
        F.max(F.when((F.col("rank") <= 1) & F.col("rel"), 1.0).otherwise(0.0)).alias("success_1"),
        F.max(F.when((F.col("rank") <= k) & F.col("rel"), 1.0).otherwise(0.0)).alias("success_k"),
        F.coalesce(F.max(F.when(F.col("rel"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("rel") & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    ]
