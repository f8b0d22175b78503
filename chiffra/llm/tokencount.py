"""Operator 5, token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie with two roots, for pieces that open a word and for pieces that continue one. Every
node has a failure link, to where the match stands once the pieces settled so far are popped, and the number of pieces
popped on the way, both made once in breadth-first order. A word's length in greedy longest-match pieces is then found
in one pass over its bytes, without building a piece. The pass runs over all distinct words of a slice at once, byte
position by byte position; a few words that are longer than the rest are finished one by one.

Words are runs of non-white bytes (20, 09-0D); the vocabulary is a byte-level file whose path is a parameter, read on
the driver and sent to the executors as a few arrays (its size is that of the vocabulary, whatever the input). Pieces
marked as following a blank open words, the others continue them, and every single byte may do either, so any word can
be cut. The vocabulary is a file on the driver's own disk. Null and empty texts have no words and no tokens; very long
texts and words are read whole. Every row comes back, repeated rows too; an empty table gives an empty result. Counts are
unique, so there are no ties. Columns may have any names: they travel in one struct.
"""

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm._common import documents
from chiffra.llm._text import Words, strings

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, GO_ON = 0, 1


def byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies name bytes: printable ones by themselves, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def read_pieces(path: str = VOCABULARY) -> tuple[set[bytes], set[bytes]]:
    """(pieces that open words, pieces that continue them)"""
    names = byte_names()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces = [bytes(names[c] for c in p) for p in vocab if all(c in names for c in p)]
    return {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1}, {p for p in pieces if p[:1] != b" "}


class Automaton:
    """Sorted (node, byte) keys with their targets, failure links, popped-piece counts and counts at a word's end."""

    def __init__(self, opening: set[bytes], going_on: set[bytes]):
        single = {bytes([b]) for b in range(256)}
        nexts: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((OPEN, opening | single), (GO_ON, going_on | single)):
            for piece in sorted(pieces):
                at = root
                for b in piece:
                    to = nexts[at].get(b)
                    if to is None:
                        to = len(nexts)
                        nexts[at][b] = to
                        nexts.append({})
                        final.append(False)
                    at = to
                final[at] = True
        fail, pops = [-1] * len(nexts), [0] * len(nexts)
        # Continuing nodes of one depth come first: the links of a node lead to shorter matches, mostly below GO_ON.
        queue = deque([(GO_ON, -1, 0), (OPEN, -1, 0)])
        while queue:
            v, parent, b = queue.popleft()
            if parent >= 0:
                if final[v]:
                    fail[v], pops[v] = GO_ON, 1
                else:
                    z, n = fail[parent], pops[parent]
                    while z >= 0 and b not in nexts[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = nexts[z][b], n
            queue.extend((to, v, c) for c, to in nexts[v].items())
        items = sorted((v * 256 + b, to) for v, d in enumerate(nexts) for b, to in d.items())
        self.keys = np.array([k for k, _ in items], np.int64)
        self.to = np.array([t for _, t in items], np.int32)
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        ends = []
        for v in range(len(nexts)):
            n, at = 0, v
            while at not in (OPEN, GO_ON):
                n += pops[at]
                at = fail[at]
            ends.append(n)
        self.ends = np.array(ends, np.int32)
        self._next: list[dict[int, int]] | None = None

    def _step(self, at: np.ndarray, byte: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int32)
        left = np.arange(len(at))
        while len(left):
            key = at[left].astype(np.int64) * 256 + byte[left]
            k = np.searchsorted(self.keys, key)
            k[k == len(self.keys)] = 0
            hit = self.keys[k] == key
            out[left[hit]] = self.to[k[hit]]
            left = left[~hit]
            n[left] += self.pops[at[left]]
            at[left] = self.fail[at[left]]
        return out

    def _alone(self, at: int, tail: bytes) -> int:
        """Pieces from node ``at`` over ``tail`` to the end."""
        if self._next is None:
            self._next = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True))
        n, step = 0, self._next
        for b in tail:
            to = step.get(at * 256 + b)
            while to is None:
                n += int(self.pops[at])
                at = int(self.fail[at])
                to = step.get(at * 256 + b)
            at = to
        return n + int(self.ends[at])

    def lengths(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of pieces of each word (a span of ``data``)."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        n, at = np.zeros(len(size), np.int64), np.full(len(size), OPEN, np.int32)
        j, live = 0, int((size > 0).sum())
        while live > 8:
            live_at, live_n = at[:live], n[:live]
            live_at[:] = self._step(live_at.copy(), data[start[:live] + j], live_n)
            j += 1
            done = int(np.searchsorted(-size, -j, "left"))  # longer than j
            n[done:live] += self.ends[at[done:live]]
            live = done
        for k in range(live):
            n[k] += self._alone(int(at[k]), data[start[k] + j : start[k] + size[k]].tobytes())
        out = np.empty(len(n), np.int64)
        out[order] = n
        return out


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), n_words, n_tokens."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(*read_pieces(vocabulary)))

    def count(batches):
        machine = sent.value
        for batch in batches:
            words, tokens = [], []
            for _, _, data, offs in strings(batch.column(0).field("text")):
                w = Words(data, offs)
                _, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
                each = machine.lengths(data, w.start[first], w.end[first])[back] if len(first) else np.zeros(0, np.int64)
                run = np.concatenate([[0], np.cumsum(each)])
                words.append(w.count)
                tokens.append(run[w.first[1:]] - run[w.first[:-1]])
            cols = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (words, tokens)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["row", "n_words", "n_tokens"])

    return rows.mapInArrow(count, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "n_words", "n_tokens")
