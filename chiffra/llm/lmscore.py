"""Operator 2, LM scoring: an n-gram model in an Elias-Fano trie, sharded by key ranges.

Model. P(w) = (c + 0.5) / (N + 0.5 (V + 1)), and for a word after a context of one word more, order by order,
P(w | context) = c(context, w) / (c(context) + mu) + mu / (c(context) + mu) * P(w | shorter context): Dirichlet
smoothing, a proper distribution over the known words and one unknown. A text is its words in lower case (A-Z) and one
end; before its first token stands a start, with which longer contexts begin too.

Trie. Level 1 lists the words of a shard by hash; a word's id is the number of training tokens whose words come before
it, so ids are monotone, their differences are the counts and one Elias-Fano sequence holds both. Level 2 lists the
contexts of a shard, monotone pointers to the ranges of their successors, and the successors' ids, each range raised by
the last value of the range before (one monotone sequence); beside them stand the shares c(b, w) / (c(b) + mu) in 16 bits
on a logarithmic scale, rounded down, so that quantised probabilities never sum to over one; a decade has
``STEPS_PER_DECADE`` steps, or as many fewer as the smallest share of the largest context needs, so none is lost and a
probability is at most a 3,500th too low. A shard is memory-mapped (from its bytes while scoring, from a file where a
stored level is opened with ``PairLevel.mapped``) and never unpacked: sequences are read through a directory of four
bytes per 64 bits. A query finds its context, then the successor of its id relative to the context's base: the high bits
of that sum name a run of elements, the low bits are compared within it. Words are looked up in level 1 the same way.

A node's id is the number of training occurrences of its level that come before it, as a word's is, so the next level
treats n-grams as contexts in the same way: each order is one more level of the same form.

Plan. Texts are cut into chunks of about 4 MB, kept once as local word numbers in a table bucketed by chunk. Distinct
words of a chunk go to the shard of their hash range and come back with ids and counts; then, level by level, distinct
n-grams go to the shard of their place in id order and come back with their codes (and with ids and counts, where a
longer order needs them); a chunk then sums its texts. Only distinct words and n-grams of chunks travel, as packed
binaries. Shards are ranges of id(context) + c(context) * id(w) / N, which splits the range of a frequent context by its
successors, so no shard grows with one word. The number of shards follows the tokens.

``order`` is 2 by default (the README has the figures of 3). A frequent word or n-gram comes once from every chunk, so its
shard holds a few bytes for each chunk. The driver holds a row a shard, one for every ``TOKENS_PER_SHARD`` tokens.

Null and empty texts have one token, the end. A null doc_id is a training row. Repeated rows count as often as they occur
and each is scored. A text longer than a chunk is a chunk of its own. An empty table gives an empty result. Extra columns
are ignored, whatever their names. Hashes have 64 bits; there are no ties.
"""

import mmap
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm import _common
from chiffra.llm._common import documents, stored
from chiffra.llm._text import Words, strings

CHUNK = 4 << 20
TOKENS_PER_SHARD = 2_000_000
ORDER = 2
#: Strength of the shorter context, by order from 2 on (the last one holds for all beyond).
MU = (500.0, 5.0)
STEPS_PER_DECADE = 8192
_END = np.uint64(0x5E5E5E5E5E5E5E5E)


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers in as few whole bytes each as the largest needs, byte plane by byte plane."""
    a = np.ascontiguousarray(a, np.uint64)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).reshape(-1)


def steps_for(count: int, mu: float) -> float:
    """Steps a decade for which one occurrence after a context of ``count`` still has a code."""
    return min(float(STEPS_PER_DECADE), 65533 / max(1.0, float(np.log10(count + mu))))


def quantise(share: np.ndarray, steps: float = STEPS_PER_DECADE) -> np.ndarray:
    """16-bit codes of shares in (0, 1], rounded down; 0 stands for nothing."""
    with np.errstate(divide="ignore"):
        code = 65535 + np.floor(np.log10(share) * steps + 1e-9)
    return np.where(share > 0, np.maximum(code, 0), 0).astype("<u2")


def shares(steps: float = STEPS_PER_DECADE) -> np.ndarray:
    """The share that each code stands for."""
    return np.concatenate([[0.0], 10.0 ** ((np.arange(1, 65536) - 65535) / steps)])


class EliasFano:
    """A monotone sequence: ``low`` bits packed, ``high`` parts in unary. ``from_bytes`` reads any buffer, mapped or not;
    beside it stands a directory of the ones before each 64-bit word of ``high``."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._words = np.ndarray((len(high) // 8,), "<u8", high)
        self._ones = np.zeros(len(self._words) + 1, np.uint32 if n < 1 << 32 else np.uint64)
        np.cumsum(np.bitwise_count(self._words), out=self._ones[1:])
        self._view = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,)) if n and bits else None

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        v = np.ascontiguousarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        bits = min(48, max(0, ((int(v[-1]) + 1) // n).bit_length() - 1))
        low = np.zeros(0, np.uint8)
        if bits:
            words = np.zeros(n * bits // 64 + 3, np.uint64)
            part, pos = v & np.uint64((1 << bits) - 1), np.arange(n, dtype=np.uint64) * np.uint64(bits)
            at, shift = (pos >> np.uint64(6)).astype(np.int64), pos & np.uint64(63)
            for where, what in ((at, part << shift), (at + 1, np.where(shift > 0, part >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0)))):
                first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                words[where[first]] |= np.bitwise_or.reduceat(what, first)
            low = words.view(np.uint8)
        marks = np.zeros((int(v[-1] >> np.uint64(bits)) + n + 64) // 64 * 64, bool)
        marks[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = True
        return cls(n, bits, low, np.packbits(marks, bitorder="little"))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.bits, len(self.low), len(self.high)], "<u8").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: np.ndarray) -> tuple["EliasFano", int]:
        n, bits, a, b = (int(x) for x in np.frombuffer(data[:32].tobytes(), "<u8"))
        return cls(n, bits, data[32 : 32 + a], data[32 + a : 32 + a + b]), 32 + a + b

    def _within(self, word: np.ndarray, rank: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the one (or, flipped, the zero) of each rank, from 0, in the words of the given numbers."""
        w = self._words[word] ^ np.uint64(0xFFFFFFFFFFFFFFFF if flip else 0)
        rank, place = rank.astype(np.int64), word.astype(np.int64) * 64
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(w & np.uint64((1 << width) - 1)).astype(np.int64)
            over = rank >= below
            rank -= np.where(over, below, 0)
            place += np.where(over, width, 0)
            w >>= np.where(over, np.uint64(width), np.uint64(0))
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        pos = i.astype(np.uint64) * np.uint64(self.bits)
        return (self._view[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7))) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements of the given numbers."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self._ones, i.astype(self._ones.dtype), "right") - 1
        high = self._within(word, i - self._ones[word].astype(np.int64), False) - i
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def _start(self, high: np.ndarray) -> np.ndarray:
        """The number of the first element whose high part is at least ``high``."""
        zeros = np.arange(len(self._ones), dtype=np.int64) * 64 - self._ones.astype(np.int64)
        want = high.astype(np.int64) - 1  # it follows this zero
        out = np.full(len(want), self.n, np.int64)
        inside = (want >= 0) & (want < zeros[-1])
        word = np.searchsorted(zeros, want[inside], "right") - 1
        out[inside] = self._within(word, want[inside] - zeros[word], True) + 1 - high[inside].astype(np.int64)
        out[want < 0] = 0
        return np.minimum(out, self.n)

    def successor(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first element that is at least ``v``, whether it equals it)"""
        v = np.asarray(v, np.uint64)
        high, part = v >> np.uint64(self.bits), v & np.uint64((1 << self.bits) - 1)
        lo, end = self._start(high), self._start(high + np.uint64(1))
        hi = end.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < part[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        inside = np.flatnonzero(lo < end)
        equal = np.zeros(len(v), bool)
        equal[inside] = self._low(lo[inside]) == part[inside]
        return lo, equal

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.n))


def mapped(blob: bytes) -> np.ndarray:
    """``blob`` in mapped memory without a file: executors keep nothing on their own disks."""
    room = mmap.mmap(-1, max(1, len(blob)))
    room.write(blob)
    return np.frombuffer(room, np.uint8)


def _sequences(data: np.ndarray, n: int) -> tuple[list[EliasFano], np.ndarray]:
    """The first ``n`` sequences in ``data``, and what follows them."""
    out = []
    for _ in range(n):
        s, size = EliasFano.from_bytes(data)
        out.append(s)
        data = data[size:]
    return out, data


class WordLevel:
    """Words of a hash range and, one more than words, their ids within it."""

    def __init__(self, data: np.ndarray):
        (self.words, self.ids), _ = _sequences(data, 2)

    @staticmethod
    def encode(words: np.ndarray, counts: np.ndarray) -> bytes:
        """From words in ascending order."""
        return EliasFano.of(words).to_bytes() + EliasFano.of(np.concatenate([[0], np.cumsum(counts)])).to_bytes()

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each word; of one that isn't known, the id at which it would stand, and 0."""
        at, known = self.words.successor(words) if self.words.n else (np.zeros(len(words), np.int64), np.zeros(len(words), bool))
        ids = self.ids.get(at)
        counts = np.zeros(len(words), np.uint64)
        counts[known] = self.ids.get(at[known] + 1) - ids[known]
        return ids, counts


class PairLevel:
    """Contexts, pointers, successors and codes of one shard."""

    def __init__(self, data: np.ndarray):
        (self.contexts, self.pointers, self.successors), codes = _sequences(data, 3)
        self.codes = np.ndarray((self.successors.n,), "<u2", codes)

    @staticmethod
    def encode(b: np.ndarray, w: np.ndarray, codes: np.ndarray) -> bytes:
        """From pairs in the order of (b, w)."""
        head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        last = np.append(head[1:], len(b)) - 1
        lift = np.concatenate([[np.uint64(0)], np.cumsum(w[last])[:-1].astype(np.uint64)]) if len(b) else w
        raised = w + np.repeat(lift, np.diff(np.append(head, len(b)))) if len(b) else w
        parts = [EliasFano.of(b[head]).to_bytes(), EliasFano.of(np.append(head, len(b))).to_bytes(), EliasFano.of(raised).to_bytes()]
        return b"".join(parts) + codes.astype("<u2").tobytes()

    @classmethod
    def mapped(cls, path: str) -> "PairLevel":
        return cls(np.memmap(path, np.uint8, "r"))

    def find(self, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, number) of pairs, which come in runs of one context; 0 and -1 for those not seen."""
        out, number = np.zeros(len(b), "<u2"), np.full(len(b), -1, np.int64)
        if not self.contexts.n or not len(b):
            return out, number
        head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        k, known = self.contexts.successor(b[head])
        head_of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(b))))
        lo, end, base = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64), np.zeros(len(head), np.uint64)
        lo[known], end[known] = self.pointers.get(k[known]), self.pointers.get(k[known] + 1)
        inner = lo > 0
        base[inner] = self.successors.get(lo[inner] - 1)
        ask = np.flatnonzero(known[head_of])
        of = head_of[ask]
        at, hit = self.successors.successor(w[ask] + base[of])
        # A value may close one range and open the next: the raised id 0 equals the last of the range before.
        late = np.flatnonzero(hit & (at < lo[of]))
        at[late] = lo[of[late]]
        hit[late] = self.successors.get(at[late]) == (w[ask] + base[of])[late]
        hit &= (at >= lo[of]) & (at < end[of])
        out[ask[hit]] = self.codes[at[hit]]
        number[ask[hit]] = at[hit]
        return out, number


def _binary(rows: list[list], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names)


_CHUNK_SCHEMA = "chunk long, doc_ids array<long>, held array<boolean>, lengths binary, words binary, tokens binary, n_tokens long, n_words long"


def _chunks(batches):
    """One row per chunk: its documents, distinct word hashes in order and tokens as numbers of those."""
    for batch in batches:
        for lo, hi, data, offs in strings(batch.column(2), CHUNK):
            w = Words(data, offs, lower=True)
            seq = np.insert(w.hashes(), w.first[1:], _END)
            words, tokens = np.unique(seq, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())), pa.array([batch.column(1).slice(lo, hi - lo).to_pylist()], pa.list_(pa.bool_())), pa.array([pack(w.count + 1)]), pa.array([pack(words)]), pa.array([pack(tokens)]), pa.array([len(seq)], pa.int64()), pa.array([len(words)], pa.int64())],
                ["chunk", "doc_ids", "held", "lengths", "words", "tokens", "n_tokens", "n_words"],
            )


def _training(row: dict) -> np.ndarray:
    """Which tokens of a chunk are for training."""
    return np.repeat(~np.array(row["held"], bool), unpack(row["lengths"]).astype(np.int64))


def _send_words(shards: int):
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = unpack(row["words"])
                count = np.bincount(unpack(row["tokens"]).astype(np.int64)[_training(row)], minlength=len(words))
                # Hash ranges: shard = hash * shards / 2^64, so the pieces of a chunk are slices of its sorted words.
                shard = ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                ends = np.append(cut[1:], len(words))
                rows = [[int(shard[a]), row["chunk"], pack(words[a:z]), pack(count[a:z])] for a, z in zip(cut, ends, strict=True)]
                yield _binary(rows, ["shard", "chunk", "words", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return send


_REPLY_SCHEMA = "kind string, shard long, chunk long, a binary, b binary, c binary, n long, m long"
_REPLY_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_REPLY_NAMES = ["kind", "shard", "chunk", "a", "b", "c", "n", "m"]
_BACK = ["kind", "shard", "chunk", "a", "b", "c"]


def _word_shard(table: pa.Table) -> pa.Table:
    """Counts of a hash range: the shard's level 1, and a reply of level 1 to each chunk (ids within the shard, counts)."""
    rows = table.to_pylist()
    parts = [unpack(r["words"]) for r in rows]
    words, back = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.bincount(back, weights=np.concatenate([unpack(r["counts"]) for r in rows]), minlength=len(words)).astype(np.int64)
    known = counts > 0
    blob = WordLevel.encode(words[known], counts[known])
    ids, counts = WordLevel(mapped(blob)).find(words)
    shard, at, out = rows[0]["shard"], 0, []
    for r, p in zip(rows, parts, strict=True):
        mine = back[at : at + len(p)]
        at += len(p)
        out.append(["1", shard, r["chunk"], None, pack(ids[mine]), pack(counts[mine]), 0, 0])
    out.append(["level1", shard, -1, blob, None, None, int(counts.sum()), int(known.sum())])
    return pa.Table.from_batches([_binary(out, _REPLY_NAMES, _REPLY_TYPES)])


class _Level:
    """The distinct n-grams of a chunk at one level: ``seen`` tokens end one whose context and word are known, ``of`` is its
    number; ``contexts`` and ``words`` are the local numbers of its parts, in the order of their ids."""

    def __init__(self, context: np.ndarray, context_ids: np.ndarray, context_counts: np.ndarray, tokens: np.ndarray, known: np.ndarray):
        self.context, self.context_ids, self.context_counts = context, context_ids, context_counts
        wide = np.int64(len(known) + 1)
        self.seen = (context >= 0) & known[tokens]
        self.seen[self.seen] = context_counts[context[self.seen]] > 0
        grams, self.of = np.unique(context[self.seen] * wide + tokens[self.seen], return_inverse=True)
        self.contexts, self.words = grams // wide, grams % wide

    def rest(self, mu: float) -> np.ndarray:
        """The weight of the shorter context for each token: 1 where this one isn't known."""
        out = np.ones(len(self.context))
        on = self.context >= 0
        out[on] = (mu / (self.context_counts.astype(np.float64) + mu))[self.context[on]]
        return out


class _Known:
    """What a chunk knows from the replies of the levels below ``level``: all n-grams up to that level, and where their levels
    have answered, ids, counts and codes."""

    def __init__(self, row: dict, replies: list[dict], model: dict, level: int):
        back: dict[str, list[dict]] = {}
        for r in sorted(replies, key=lambda r: r["shard"]):
            back.setdefault(r["kind"], []).append(r)
        nodes = lambda k: [np.concatenate([unpack(r[c]) + (model["starts"][k][r["shard"]] if c == "b" else np.uint64(0)) for r in back[str(k)]]) if back.get(str(k)) else np.zeros(0, np.uint64) for c in "bc"]
        self.ids, self.counts = nodes(1)
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        known = self.counts > 0
        context = np.concatenate([[0], self.tokens[:-1]])
        context[self.first] = len(self.ids)  # the start, after all words
        ids, counts = np.append(self.ids, np.uint64(model["n"])), np.append(self.counts, np.uint64(model["docs"]))
        self.levels, self.codes = {}, {}
        for k in range(2, level + 1):
            at = self.levels[k] = _Level(context, ids, counts, self.tokens, known)
            if str(k) in back or k < level:
                self.codes[k] = np.frombuffer(b"".join(r["a"] for r in back.get(str(k), [])), "<u2")
            if k < level:
                ids, counts = nodes(k)
                node = np.full(len(self.tokens), -1, np.int64)
                node[at.seen] = at.of
                context = np.concatenate([[-1], node[:-1]])
                context[self.first] = -1

    def shards(self, k: int, model: dict) -> np.ndarray:
        """The shard of each n-gram of a level, ascending."""
        at, n = self.levels[k], float(model["n"])
        place = at.context_ids[at.contexts].astype(np.float64) + at.context_counts[at.contexts].astype(np.float64) * (self.ids[at.words].astype(np.float64) / n)
        return np.minimum(place / float(model["occurrences"][k]) * model["shards"], model["shards"] - 1).astype(np.int64)


def _send_grams(k: int, model: dict):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = right.to_pylist()
        for row in left.to_pylist():
            known = _Known(row, replies, model, k)
            at = known.levels[k]
            if not len(at.words):
                continue
            times = np.bincount(at.of, weights=_training(row)[at.seen], minlength=len(at.words)).astype(np.uint64)
            shard = known.shards(k, model)
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            for a, z in zip(cut, np.append(cut[1:], len(shard)), strict=True):
                b = at.contexts[a:z]
                head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                out.append([int(shard[a]), row["chunk"], pack(at.context_ids[b[head]]), pack(at.context_counts[b[head]]), pack(np.diff(np.append(head, z - a))), pack(known.ids[at.words[a:z]]), pack(times[a:z])])
        return pa.Table.from_batches([_binary(out, ["shard", "chunk", "contexts", "totals", "runs", "words", "times"], [pa.int64(), pa.int64(), *[pa.binary()] * 5])])

    return send


_GRAM_SCHEMA = "shard long, chunk long, contexts binary, totals binary, runs binary, words binary, times binary"


def _gram_shard(k: int, mu: float, steps: float, last: bool = True):
    def serve(table: pa.Table) -> pa.Table:
        """A level of a range of n-grams, and a reply of codes to each chunk; of ids and counts too, unless it is the last."""
        rows = table.to_pylist()
        runs = [unpack(r["runs"]).astype(np.int64) for r in rows]
        b = np.concatenate([np.repeat(unpack(r["contexts"]), n) for r, n in zip(rows, runs, strict=True)])
        total = np.concatenate([np.repeat(unpack(r["totals"]), n) for r, n in zip(rows, runs, strict=True)])
        w = np.concatenate([unpack(r["words"]) for r in rows])
        times = np.concatenate([unpack(r["times"]) for r in rows])
        order = np.lexsort((w, b))
        sb, sw = b[order], w[order]
        head = np.flatnonzero(np.concatenate([[True], (sb[1:] != sb[:-1]) | (sw[1:] != sw[:-1])]))
        count = np.add.reduceat(times[order], head)
        b1, w1, t1 = sb[head], sw[head], total[order][head]
        kept = count > 0
        blob = PairLevel.encode(b1[kept], w1[kept], quantise(count[kept] / (t1[kept] + mu), steps))
        found, number = PairLevel(mapped(blob)).find(b1, w1)
        spread = lambda x: np.repeat(x, np.diff(np.append(head, len(b))))
        back = np.empty(len(b), "<u2")
        back[order] = spread(found)
        if not last:
            before = np.concatenate([[0], np.cumsum(count[kept])]).astype(np.uint64)
            ids, counts = np.empty(len(b), np.uint64), np.empty(len(b), np.uint64)
            ids[order], counts[order] = spread(before[np.maximum(number, 0)]), spread(np.where(number >= 0, count, 0).astype(np.uint64))
        shard, at, out = rows[0]["shard"], 0, []
        for r, n in zip(rows, runs, strict=True):
            z = at + int(n.sum())
            nodes = [None, None] if last else [pack(ids[at:z]), pack(counts[at:z])]
            out.append([str(k), shard, r["chunk"], back[at:z].tobytes(), *nodes, z - at, 0])
            at = z
        out.append([f"level{k}", shard, -1, blob, np.array([steps]).tobytes(), None, int(count.sum()), int(kept.sum())])
        return pa.Table.from_batches([_binary(out, _REPLY_NAMES, _REPLY_TYPES)])

    return serve


_SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(model: dict):
    n, v, top = model["n"], model["v"], model["order"]
    share_of = {k: shares(model["steps"][k]) for k in range(2, top + 1)}

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        replies, parts = right.to_pylist(), []
        for row in left.to_pylist():
            known = _Known(row, replies, model, top)
            single = (known.counts.astype(np.float64) + 0.5) / (n + 0.5 * (v + 1))
            p = single[known.tokens]
            for k, at in known.levels.items():
                share = np.zeros(len(p))
                if len(at.words):
                    share[at.seen] = share_of[k][known.codes[k]][at.of]
                p = share + at.rest(model["mu"][k]) * p
            total = lambda x: np.add.reduceat(x, known.first)  # noqa: B023, E731
            parts.append(pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(known.lengths), pa.array(total((known.counts > 0)[known.tokens].astype(np.int64))), pa.array(total(np.log10(single)[known.tokens])), pa.array(total(np.log10(p)))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            ))
        return pa.Table.from_batches(parts) if parts else pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    return score


def _bucketed(df: DataFrame, n: int) -> DataFrame:
    """Kept in the shared folder in ``n`` buckets by chunk, so that joins by chunk don't move it again."""
    spark, name = df.sparkSession, f"chiffra_chunks_{uuid.uuid4().hex}"
    path = f"{_common.shared_dir(spark)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "chunk").saveAsTable(name)
    _common._written.append((spark, path))
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # the catalogue's entry alone; the files stay, and ``out`` knows them and their buckets
    return out


def train_and_score(docs: DataFrame, held_out, mu: float | tuple = MU, tokens_per_shard: int = TOKENS_PER_SHARD, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(scores, levels): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``
    (doc_id, text), learning from the rows for which the Column ``held_out`` is false; and the model's trie levels
    (kind, shard, a, b: the encoded sequences; from level 2 on, b is the steps a decade of its codes)."""
    spark = docs.sparkSession
    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1)), F.count_if(~held_out)).first()
    if not size[1]:
        return spark.createDataFrame([], _SCORE_SCHEMA.replace("n_known long", "n_known long, train_tokens long")), spark.createDataFrame([], _REPLY_SCHEMA)
    mus = mu if isinstance(mu, tuple) else (mu,)
    n_buckets = max(12, -(-size[0] // (4 * CHUNK)))
    chunks = _bucketed(docs.select("doc_id", held_out.alias("held"), "text").mapInArrow(_chunks, _CHUNK_SCHEMA), n_buckets)
    told = chunks.agg(F.sum("n_tokens").alias("tokens")).first()
    shards = max(24, -(-told["tokens"] // tokens_per_shard))

    def starts(side: DataFrame, k: int) -> tuple[np.ndarray, list]:
        """The id at which each shard of a level begins, and the level's rows (shard, n: occurrences, m: nodes)."""
        level = side.where(F.col("kind") == f"level{k}").select("shard", "n", "m").orderBy("shard").collect()
        out, run = np.zeros(shards, np.uint64), 0
        for r in level:
            out[r["shard"]] = run
            run += r["n"]
        return out, level

    sent = chunks.select("chunk", "held", "lengths", "words", "tokens").mapInArrow(_send_words(shards), "shard long, chunk long, words binary, counts binary")
    side = stored(sent.groupBy("shard").applyInArrow(_word_shard, _REPLY_SCHEMA), "lm-words")
    at, level = starts(side, 1)
    n = sum(r["n"] for r in level)
    model = {"starts": {1: at}, "n": n, "v": sum(r["m"] for r in level), "docs": size[2], "shards": shards, "order": order, "occurrences": {2: n + size[2]}, "mu": {}, "steps": {}}
    # A context counts at most what its shard holds, and the start as many as there are texts.
    largest = max([size[2], *(r["n"] for r in level)])
    left = chunks.select("chunk", "doc_ids", "held", "lengths", "tokens").groupBy("chunk")
    sides, back = [side], side.where("kind = '1'").select(*_BACK)
    for k in range(2, order + 1):
        model["mu"][k] = float(mus[min(k - 2, len(mus) - 1)])
        model["steps"][k] = steps_for(largest, model["mu"][k])
        grams = left.cogroup(back.groupBy("chunk")).applyInArrow(_send_grams(k, dict(model)), _GRAM_SCHEMA)
        side = stored(grams.groupBy("shard").applyInArrow(_gram_shard(k, model["mu"][k], model["steps"][k], k == order), _REPLY_SCHEMA), f"lm-level{k}")
        if k < order:
            model["starts"][k], level = starts(side, k)
            model["occurrences"][k + 1] = max(1, sum(r["n"] for r in level))
            largest = max([1, *(r["n"] for r in level)])
        sides.append(side)
        back = back.unionByName(side.where(F.col("kind") == str(k)).select(*_BACK))
    scores = left.cogroup(back.groupBy("chunk")).applyInArrow(_score(model), _SCORE_SCHEMA)
    levels = sides[0]
    for x in sides[1:]:
        levels = levels.unionByName(x)
    return scores.withColumn("train_tokens", F.lit(n).cast("long")), levels.where("kind like 'level%'")


def is_held_out():
    """crc32 of the doc_id as text leaves 1 by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = train_and_score(documents(spark, sf_dir).select("doc_id", "text"), is_held_out())
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
