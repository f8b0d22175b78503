"""Operator 12, exact deduplication with a cuckoo-filter index of live digests.

The index is a set of shards. A shard is a table of buckets of four slots; a slot holds a fingerprint of 16 bits and the
number of a key, and a key is the SHA-256 of a normalised text with the row that stays for it. A digest has two buckets
that its fingerprint takes to one another. One that neither bucket knows is new, and enters: a free slot takes it, or it
pushes another key on to that key's other bucket. One that a bucket seems to know is compared with the digest that the
bucket's key holds. A deleted text clears its slot. Where keys are pushed on for too long, the shard gets twice the
buckets and is filled again from its stored keys. Shards are rows of a table between calls (bucket, slot, digest, row), so
``updated`` takes inserts and deletions into an index that an earlier job has left.

Each task first takes its rows into indexes of its own, so a text of any number of copies is one row a task when it meets
its shard. A shard has some ``PER_SHARD`` digests whatever the input. After the index has decided, the texts of all
groups are compared in full, one copy of a distinct text a task; should two of them share a digest, their rows are
grouped by text.

A null text counts as empty, and empty texts are equal. Of equal texts the row of the largest doc_id stays; null is smaller
than any, and of rows that share the largest doc_id one stays. Repeated rows count each. Texts are read whole, however
long. An empty table gives an empty result. Columns of any names may stand beside; only doc_id and text are read.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm._common import documents, dropped, join_groups, marked_ids, stored
from chiffra.llm._text import mix

SLOTS, MOST_KICKS, FULL = 4, 200, 0.94
#: Digests of a shard, and keys of an index within a task before it is handed on.
PER_SHARD, PER_TASK = 200_000, 200_000
KEYS = "digest binary, keep_id long, keep_at long, copies long"
INDEX = f"shard int, bits int, bucket long, slot int, {KEYS}"


class Cuckoo:
    """A shard: fingerprints ``fp`` and key numbers ``at`` in buckets; keys in columns."""

    def __init__(self, bits: int = 8):
        self.n = 0
        self.digest = np.zeros((1024, 4), np.uint64)
        self.keep = np.zeros((1024, 4), np.int64)  # whether there is a doc_id, the doc_id, the row, the copies
        self.false_hits = self.resizes = 0
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits = bits
        self.fp = np.zeros((1 << bits, SLOTS), np.uint16)
        self.at = np.full((1 << bits, SLOTS), -1, np.int64)

    def _homes(self, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(digest[:, 0])
        fp = (np.uint64(1) + (h >> np.uint64(32)) % np.uint64(65535)).astype(np.uint16)
        first = (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return fp, first, self._other(fp, first)

    def _other(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(fp.astype(np.uint64), 5) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, digest: np.ndarray) -> np.ndarray:
        """The key of each digest, -1 if it isn't live."""
        fp, one, two = self._homes(digest)
        out = np.full(len(digest), -1, np.int64)
        for home in (one, two):
            row, slot = np.nonzero(self.fp[home] == fp[:, None])
            key = self.at[home[row], slot]
            same = (self.digest[key] == digest[row]).all(axis=1)
            self.false_hits += int((~same).sum())
            out[row[same]] = key[same]
        return out

    def _place(self, keys: np.ndarray) -> None:
        """Slots for the fingerprints of stored keys; on overflow the shard grows and takes all live keys again."""
        fp, bucket, other = self._homes(self.digest[keys])
        for turn in range(MOST_KICKS):
            if not len(keys):
                return
            order = np.argsort(bucket, kind="stable")
            keys, fp, bucket, other = keys[order], fp[order], bucket[order], other[order]
            rank = np.arange(len(keys)) - np.searchsorted(bucket, bucket)
            free = np.cumsum(self.fp[bucket] == 0, axis=1)
            fits = rank < free[:, -1]
            slot = (free > rank[:, None]).argmax(axis=1)
            self.fp[bucket[fits], slot[fits]], self.at[bucket[fits], slot[fits]] = fp[fits], keys[fits]
            keys, fp, bucket, other = keys[~fits], fp[~fits], bucket[~fits], other[~fits]
            if turn == 0:  # the other bucket may have room
                bucket, other = other, bucket
                continue
            push = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
            b = bucket[push]
            s = (mix(keys[push].astype(np.uint64), turn) % np.uint64(SLOTS)).astype(np.int64)
            out_key, out_fp = self.at[b, s].copy(), self.fp[b, s].copy()
            self.at[b, s], self.fp[b, s] = keys[push], fp[push]
            keys[push], fp[push] = out_key, out_fp
            bucket[push], other[push] = self._other(out_fp, b), b
        self.resize()

    def resize(self) -> None:
        self.resizes += 1
        live = np.flatnonzero(self.keep[: self.n, 3] > 0)
        self._clear(self.bits + 1)
        self._place(live)

    def insert(self, digest: np.ndarray, keep: np.ndarray) -> None:
        """Rows of a digest and what would stay for it; equal digests of a batch are put together first."""
        order = np.lexsort((keep[:, 2], keep[:, 1], keep[:, 0], *digest.T[::-1]))
        digest, keep = digest[order], keep[order]
        begin = np.flatnonzero(np.r_[True, (digest[1:] != digest[:-1]).any(axis=1)]) if len(digest) else order
        last = np.r_[begin[1:], len(digest)] - 1
        copies = np.add.reduceat(keep[:, 3], begin) if len(begin) else keep[:, 3]
        digest, keep = digest[last], keep[last]
        keep[:, 3] = copies
        key = self.find(digest)
        old, new = key >= 0, key < 0
        held, come = self.keep[key[old]], keep[old]
        later = np.zeros(len(come), bool)
        for c in (2, 1, 0):
            later = np.where(come[:, c] != held[:, c], come[:, c] > held[:, c], later)
        total = held[:, 3] + come[:, 3]
        held = np.where(later[:, None], come, held)
        held[:, 3] = total
        self.keep[key[old]] = held
        n = int(new.sum())
        while self.n + n > len(self.digest):
            self.digest, self.keep = np.concatenate([self.digest, np.zeros_like(self.digest)]), np.concatenate([self.keep, np.zeros_like(self.keep)])
        keys = np.arange(self.n, self.n + n)
        self.digest[keys], self.keep[keys] = digest[new], keep[new]
        while self.n + n > FULL * (SLOTS << self.bits):
            self.resize()
        self.n += n
        self._place(keys)

    def delete(self, digest: np.ndarray) -> int:
        """Take live digests out; how many were live."""
        key = np.unique(self.find(digest))
        key = key[key >= 0]
        fp, one, two = self._homes(self.digest[key])
        for home in (one, two):
            row, slot = np.nonzero(self.at[home] == key[:, None])
            self.fp[home[row], slot], self.at[home[row], slot] = 0, -1
        self.keep[key] = 0
        return len(key)

    def restore(self, bits: int, bucket: np.ndarray, slot: np.ndarray, digest: np.ndarray, keep: np.ndarray) -> None:
        """The shard as it was written: each key in the slot that it had."""
        self.n = len(digest)
        self.digest, self.keep = digest.copy(), keep.copy()
        self._clear(bits)
        self.at[bucket, slot], self.fp[bucket, slot] = np.arange(self.n), self._homes(digest)[0]

    def columns(self) -> dict[str, pa.Array]:
        bucket, slot = np.nonzero(self.at >= 0)
        key = self.at[bucket, slot]
        keep = self.keep[key]
        raw = np.ascontiguousarray(self.digest[key]).tobytes()
        digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(key), [None, pa.py_buffer(raw)]).cast(pa.binary())
        return {"bits": pa.array(np.full(len(key), self.bits, np.int32)), "bucket": pa.array(bucket), "slot": pa.array(slot.astype(np.int32)), "digest": digest,
                "keep_id": pa.array(keep[:, 1], mask=keep[:, 0] == 0), "keep_at": pa.array(keep[:, 2]), "copies": pa.array(keep[:, 3])}


def _digests(column: pa.Array) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(data.to_pylist()), np.uint64).reshape(-1, 4)


def _keeps(ids: pa.Array, at: pa.Array, copies: pa.Array | None = None) -> np.ndarray:
    known = np.asarray(ids.is_valid(), bool)
    return np.stack([known.astype(np.int64), np.asarray(ids.fill_null(0), np.int64), np.asarray(at, np.int64), np.ones(len(ids), np.int64) if copies is None else np.asarray(copies, np.int64)], axis=1)


def digests(docs: DataFrame, digest_bytes: int = 32, texts: bool = False) -> DataFrame:
    """(doc_id, at, sha256, digest) of every row, or with ``texts`` (doc_id, digest, text) with the normalised text. ``digest``
    is the SHA-256 itself, or its first ``digest_bytes`` and zeros."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("at"))

    def normalise(batches):
        for b in batches:
            norm = [(t or b"").lower() for t in b.column(1).to_pylist()]  # of bytes: A-Z only
            sha = [hashlib.sha256(t).digest() for t in norm]
            short = pa.array([s[:digest_bytes].ljust(32, b"\0") for s in sha], pa.binary())
            cols = [b.column(0), short, pa.array(norm, pa.binary())] if texts else [b.column(0), b.column(2), pa.array(sha, pa.binary()), short]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "text"] if texts else ["doc_id", "at", "sha256", "digest"])

    return ids.mapInArrow(normalise, "doc_id long, digest binary, text binary" if texts else "doc_id long, at long, sha256 binary, digest binary")


def _put_together(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_at, copies) of the rows (doc_id, at, digest) of a task, from indexes of its own."""

    def together(batches):
        index = Cuckoo()
        of = lambda: pa.RecordBatch.from_pydict({k: v for k, v in index.columns().items() if k in ("digest", "keep_id", "keep_at", "copies")})
        for b in batches:
            index.insert(_digests(b.column(2)), _keeps(b.column(0), b.column(1)))
            if index.n > PER_TASK:
                yield of()
                index = Cuckoo()
        yield of()

    return rows.select("doc_id", "at", "digest").mapInArrow(together, KEYS)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def updated(index: DataFrame, added: DataFrame, removed: DataFrame | None = None, shards: int = 1) -> DataFrame:
    """The index after the texts of ``removed`` (digest) have left it and the rows of ``added`` (doc_id, at, digest) have
    entered. ``shards`` is a constant of an index."""
    come = _put_together(added).withColumn("gone", F.lit(False))
    if removed is not None:
        gone = removed.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("keep_at"), F.lit(0).cast("long").alias("copies"), F.lit(True).alias("gone"))
        come = come.unionByName(gone)
    changes = come.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))

    def shard(key: tuple, was: pa.Table, change: pa.Table) -> pa.Table:
        c = Cuckoo()
        if was.num_rows:
            c.restore(was["bits"][0].as_py(), np.asarray(was["bucket"]), np.asarray(was["slot"]), _digests(was["digest"]), _keeps(was["keep_id"].combine_chunks(), was["keep_at"].combine_chunks(), was["copies"].combine_chunks()))
        leaves = change.filter(change["gone"])
        c.delete(_digests(leaves["digest"])) if leaves.num_rows else None
        change = change.filter(pa.compute.invert(change["gone"]))
        for b in change.to_batches(max_chunksize=50_000):
            c.insert(_digests(b.column("digest")), _keeps(b.column("keep_id"), b.column("keep_at"), b.column("copies")))
        cols = c.columns()
        return pa.table({"shard": pa.array([key[0].as_py()] * len(cols["bits"]), pa.int32()), **cols})

    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(shard, INDEX)


def _mixed(docs: DataFrame, groups: DataFrame, digest_bytes: int) -> DataFrame:
    """Digests of groups that hold different texts."""
    texts = digests(docs, digest_bytes, texts=True)
    marked, hit = marked_ids(texts, groups.where("copies > 1").select("digest"), "digest")
    held = marked.where(hit).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha256), one row per row of ``docs``."""
    rows = stored(digests(docs, digest_bytes), "cuckoo-rows")
    total = rows.count()
    index = stored(updated(empty(docs.sparkSession), rows, shards=max(8, math.ceil(total / PER_SHARD))), "cuckoo-index")
    groups = index.select("digest", "keep_id", "keep_at", F.col("copies").alias("group_size"))
    placed = join_groups(rows, groups, ["digest"], "group_size", total)
    kept = F.col("at") == F.col("keep_at")
    columns = ["doc_id", "keep_id", "group_size", kept.alias("kept"), "sha256"]
    mixed = stored(_mixed(docs, index, digest_bytes), "cuckoo-mixed")
    if mixed.isEmpty():
        dropped(mixed)
        return placed.select(*columns)
    # Texts that share a digest: the groups are those of the texts.
    again = digests(docs, digest_bytes, texts=True).join(mixed, "digest").withColumns({"at": F.monotonically_increasing_id(), "sha256": F.unhex(F.sha2("text", 256))})
    again = stored(again, "cuckoo-texts")
    last = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "at")
    by_text = again.groupBy("digest", "text").agg(F.max(last).alias("last"), F.count(F.lit(1)).alias("group_size"))
    by_text = by_text.select("digest", "text", F.col("last.doc_id").alias("keep_id"), F.col("last.at").alias("keep_at"), "group_size")
    return placed.join(mixed, "digest", "left_anti").select(*columns).unionByName(again.join(by_text, ["digest", "text"]).select(*columns))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


SQL = {
    "op12_exact_dedup": """with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, sha256(t) text_sha256 from d window w as (partition by t)""",
}
