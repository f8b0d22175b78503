"""Operator 10, benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens without outer punctuation, in lower case (A-Z). In its template, numbers, the
units that follow them and names (capitalised words inside a sentence) give way to typed placeholders, and a run of one
type is one placeholder, up to the end of the sentence: "New York" counts as much as "Boston", "1 500" as "5". A capitalised
word that opens a sentence may be a name or not, so there are two template views, which take it for a word and for a name;
the third view is the literal one, which catches verbatim passages whatever their case. In a text in which no word is
capitalised, or every one, case says nothing: there any one or two words of a window may be the names that an item has in
their places (names of one word only). A document holds an item if, in one view, it has at
least 0.75 of the item's distinct windows of five tokens; in a template view windows with fewer than two literal tokens
say nothing and are left out, and the values that stand in the placeholders have to agree along the best alignment: a value of the
item goes with its most common partner in the document in ``AGREE`` of all slots, and the other way round. Items or
documents of fewer than five tokens (in a view) match as wholes only.

Plan: a hash join of windows. Items with the same windows and the same pattern of equal slot values are one class, named
by its smallest item_id. A document that holds a class has one of its rarest windows, of which so many are taken that
not all can be missing (the prefix principle), so those alone are joined, and a window that many items share gives no
pairs of its own. A pass over the texts keeps the windows that a bitmap of fixed size knows, of documents with a rare
one; equal texts become one row; candidates are then compared window set by window set. Memory depends on neither the
number of items nor that of documents, and texts move only where their bit in a bitmap of found texts is set.

Null, empty and wordless documents or items match nothing, nor do items without an item_id; no items or no documents
give empty results. Repeated rows get the same answer; a null doc_id is kept as it is. Extra columns are ignored or, for
``clean_rows``, come back unchanged, whatever their names. Very long texts are read whole. Ties between alignments go to
the earliest. Scripts without case have no names.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm._common import copied_join, documents, dropped, join_groups, marked_ids, stored
from chiffra.llm._text import SLICE, Words, lists, mix, span_hashes, strings, sums, tidy, windows

WIDTH = 5
SHARE = 75  # percent of an item's windows
AGREE = 0.9
LITERALS = 2
VIEWS = ("verbatim", "template", "template")
#: 64-bit words of the bitmaps of windows: 8 MB each.
WORDS = 1 << 20

#: Units that may follow a number, and number words.
UNITS = "% kg g mg t lb lbs oz km m cm mm mi mile miles metre metres meter meters foot feet ft inch inches l ml litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents pound pounds degrees mph km/h"
ONES = "one two three four five six seven eight nine"
TENS = "twenty thirty forty fifty sixty seventy eighty ninety"
NUMBERS = f"zero {ONES} ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen {TENS} hundred thousand million billion"

_OUTER = np.zeros(256, bool)
_OUTER[list(b"!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True  # all of ASCII but %
_NUMERIC = np.zeros(256, bool)
_NUMERIC[list(b"0123456789.,:/-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True
_CAPITAL = np.array([chr(c).isupper() for c in range(1 << 16)])


def _word_set(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.sort(Words(data, np.array([0, len(data)])).hashes())


_UNIT = _word_set(UNITS)
_NUMBER = _word_set(" ".join([NUMBERS, *(f"{t}-{o}" for t in TENS.split() for o in ONES.split())]))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h if len(known) else np.zeros(len(h), bool)


def _capitals(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the characters at ``start`` are capitals (of the basic plane, whose characters have up to three bytes)."""
    if not len(start):
        return np.zeros(0, bool)
    b = [data[np.minimum(start + k, len(data) - 1)].astype(np.int64) for k in range(3)]
    two = ((b[0] & 0x1F) << 6) | (b[1] & 0x3F)
    three = ((b[0] & 0x0F) << 12) | ((b[1] & 0x3F) << 6) | (b[2] & 0x3F)
    return _CAPITAL[np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, 0)))]


def placeholder(kind: np.ndarray) -> np.ndarray:
    return mix(kind.astype(np.uint64), 99)


class View:
    """The tokens of a slice as one view sees them: ``seq``, ``row``, ``first`` token of each row; ``value`` is 0 for literal tokens."""

    def __init__(self, number: int, rows: int, row: np.ndarray, literal: np.ndarray, kind: np.ndarray | None, opening: np.ndarray | None = None):
        self.number, self.row, self.seq = number, row, literal
        self.value = np.zeros(len(literal), np.uint64)
        if kind is not None and len(literal):
            head = np.ones(len(literal), bool)
            head[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1]) | opening[1:]  # a row's first token opens too
            at = np.flatnonzero(head)
            nth = np.arange(len(literal)) - np.repeat(at, np.diff(np.append(at, len(literal))))
            run = np.add.reduceat(mix(literal + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 7), at)
            kind, self.row = kind[at], row[at]
            self.seq = np.where(kind > 0, placeholder(kind), literal[at])
            self.value = np.where(kind > 0, run | np.uint64(1), np.uint64(0))
        self.first = np.searchsorted(self.row, np.arange(rows + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(window hash, its first token); a short row is one window of its own kind."""
        win = windows(self.seq, WIDTH)
        at = np.arange(len(win))
        size = np.diff(self.first)
        literal = np.zeros(len(self.seq) + 1, np.int64)
        np.cumsum(self.value == 0, out=literal[1:])
        whole = at + WIDTH <= self.first[1:][self.row[: len(win)]]
        short = np.flatnonzero((size > 0) & (size < WIDTH))
        if self.number:
            whole &= literal[WIDTH:][: len(win)] - literal[: len(win)] >= LITERALS
            short = short[literal[self.first[short + 1]] - literal[self.first[short]] >= LITERALS]
        extra = [mix(windows(self.seq[self.first[i] : self.first[i + 1]], int(size[i])), 4) for i in short]
        return np.concatenate([win[whole], *extra]) ^ mix(np.array([self.number], np.uint64), 5), np.concatenate([at[whole], self.first[short]])

    def with_names(self, rows: np.ndarray, places: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """``windows`` of ``rows`` (a mask) whose literal tokens at ``places`` are taken for names."""
        at = np.flatnonzero(rows[self.row])
        at = at[at + WIDTH <= self.first[1:][self.row[at]]]
        literal = sum((self.value[at + k] == 0).astype(np.int64) for k in range(WIDTH)) if len(at) else at
        named = np.all([self.value[at + k] == 0 for k in places], axis=0) if len(at) else at.astype(bool)
        at = at[named & (literal - len(places) >= LITERALS)]
        name = placeholder(np.array([2]))[0]
        cells = np.stack([np.full(len(at), name) if k in places else self.seq[at + k] for k in range(WIDTH)], axis=1).reshape(-1)
        return windows(cells, WIDTH)[::WIDTH] ^ mix(np.array([self.number], np.uint64), 5), at


#: The places of a window that one or two names may have in a text without case.
PLACES = [p for n in (1, 2) for p in itertools.combinations(range(WIDTH), n)]


def views(data: np.ndarray, offs: np.ndarray) -> list[View]:
    """The views of a slice of texts, in the order of ``VIEWS``."""
    return _views(data, offs)[0]


def _views(data: np.ndarray, offs: np.ndarray) -> tuple[list[View], View, np.ndarray]:
    """The views, and beside them the rows whose case says nothing and, if there are any, the view without names."""
    w = Words(data, offs, lower=True)
    inner = ~_OUTER[data]
    at = np.flatnonzero(inner)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inner, out=before[1:])
    lo, hi = before[w.start], before[w.end]
    some = hi > lo
    row, lo, hi, raw_end, n = w.rows()[some], lo[some], hi[some], w.end[some], len(offs) - 1
    if not len(row):
        none = [View(k, n, row, np.zeros(0, np.uint64), None) for k in range(len(VIEWS))]
        return none, none[-1], np.zeros(n, bool)
    start, end = at[lo], at[hi - 1] + 1
    literal = span_hashes(w.data, start, end)
    bounds = np.zeros(2 * len(start), np.int64)
    bounds[0::2], bounds[1::2] = start, end
    other, digits = (np.append(sums(x, bounds), 0)[0::2] for x in (~_NUMERIC[data], _DIGIT[data]))
    number = (digits > 0) & (other == 0) | _DIGIT[data[start]] | _among(literal, _NUMBER)
    opening = np.ones(len(start), bool)  # of a sentence
    opening[1:] = _STOP[data[raw_end[:-1] - 1]] | (row[1:] != row[:-1])
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & (row[1:] == row[:-1]) & _among(literal[1:], _UNIT)
    unit &= ~number
    capital = _capitals(data, start)
    lettered = ~number & ~_DIGIT[data[start]]
    n_capital, n_words = (np.bincount(row, weights=x, minlength=n) for x in (capital & lettered, lettered))
    caseless = (n_words > 0) & ((n_capital == 0) | (n_capital == n_words))
    name = capital & ~number & ~unit
    kind = lambda names: np.where(number, 1, np.where(unit, 3, np.where(names, 2, 0)))
    view = lambda number, names: View(number, n, row, literal, kind(names), opening)
    seen = [View(0, n, row, literal, None), view(1, name & ~opening), view(2, name)]
    return seen, view(2, np.zeros(len(name), bool)) if caseless.any() else seen[-1], caseless


_ITEM_SCHEMA = "item_id long, view int, hashes array<long>, at array<int>, pattern array<int>"


def _cut_items(batches):
    """A row per item and view: its distinct windows in hash order, the first place of each, and the slots, numbered by
    the first slot of equal value (0: literal)."""
    for batch in batches:
        for lo, hi, data, offs in strings(batch.column(1)):
            ids = batch.column(0).slice(lo, hi - lo).to_pylist()
            out = []
            for v in views(data, offs):
                h, at = v.windows()
                row = v.row[at] if len(at) else at
                order = np.lexsort((at, h, row))
                h, at, row = h[order], at[order], row[order]
                for i in range(hi - lo):
                    a, z = np.searchsorted(row, [i, i + 1])
                    if a == z:
                        continue
                    first, last = v.first[i], v.first[i + 1]
                    hashes, where = np.unique(h[a:z], return_index=True)
                    value = v.value[first:last]
                    known, earliest, number = np.unique(value, return_index=True, return_inverse=True)
                    pattern = np.where(value > 0, earliest[number] + 1, 0)
                    out.append((ids[i], v.number, hashes.view(np.int64).tolist(), (at[a:z][where] - first).tolist(), pattern.tolist()))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["item_id", "view", "hashes", "at", "pattern"])


def item_classes(items: DataFrame) -> DataFrame:
    """(class, view, hashes, at, pattern, item_id, members): items that no document can tell apart are one class."""
    cut = items.where("text is not null and item_id is not null").select("item_id", "text").mapInArrow(_cut_items, _ITEM_SCHEMA)
    same = cut.groupBy("view", "hashes", "at", "pattern").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("members"))
    return same.withColumn("class", F.xxhash64("view", "hashes", "at", "pattern"))


def _probes(classes: DataFrame) -> DataFrame:
    """(hash, class): of each class the rarest windows, of which one at least stands in any document that holds it."""
    each = classes.select("class", F.size("hashes").alias("need"), F.explode("hashes").alias("hash"))
    rare = each.join(each.groupBy("hash").agg(F.count(F.lit(1)).alias("classes")), "hash")
    least = F.col("need") - F.ceil(F.col("need") * SHARE / 100) + 1
    ordered = rare.groupBy("class", "need").agg(F.array_sort(F.collect_list(F.struct("classes", "hash"))).alias("w"))
    return ordered.select("class", F.explode(F.slice("w", F.lit(1), least.cast("int"))).alias("x")).select("x.hash", "class")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of a column ``hash``: ``WORDS`` words, whatever the number of rows."""
    word, bit = F.shiftrightunsigned("hash", 44).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(hash, 38) & 63 as int))")
    words = hashes.groupBy(word).agg(F.bit_or(bit).alias("b")).toPandas()
    bits = np.zeros(WORDS, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return bits


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[(h >> np.uint64(44)).astype(np.int64)] >> ((h >> np.uint64(38)) & np.uint64(63)) & np.uint64(1)).astype(bool)


_DOC_SCHEMA = "h1 long, h2 long, hashes array<long>, occ_hash array<long>, occ_at array<int>, occ_value array<long>"


def _cut_documents(known: np.ndarray, rare: np.ndarray, batch: pa.RecordBatch):
    """A row per document with a rare window: its distinct windows that items may have and, for the template views, each
    occurrence with its place and the values of its five tokens."""
    for lo, hi, data, offs in strings(batch.column(2), SLICE // 4):  # four views at once
        found, has = [], np.zeros(hi - lo, bool)
        seen, plain, caseless = _views(data, offs)
        cuts = [(v, (), v.windows()) for v in seen]
        cuts += [(plain, p, plain.with_names(caseless, p)) for p in PLACES] if caseless.any() else []
        for v, places, (h, at) in cuts:
            hit = _known(known, h)
            h, at = h[hit], at[hit]
            row = v.row[at] if len(at) else at
            has[row[_known(rare, h)]] = True
            found.append((v, h, at, row, places))
        if not has.any():
            continue
        h, row = (np.concatenate([f[k] for f in found]) for k in (1, 3))
        pair = np.unique(np.rec.fromarrays([row[has[row]], h[has[row]]], names="row,h"))
        occ = [[], [], [], []]
        for v, h, at, row, places in found[1:]:
            on = has[row]
            h, at, row = h[on], at[on], row[on]
            value = np.zeros((len(at), WIDTH), np.uint64)
            for k in range(WIDTH):
                inside = at + k < v.first[row + 1] if len(row) else np.zeros(0, bool)
                value[inside, k] = mix(v.seq[at[inside] + k], 7) | np.uint64(1) if k in places else v.value[at[inside] + k]
            for o, x in zip(occ, (row, h, at - v.first[row] if len(row) else at, value), strict=True):
                o.append(x)
        orow, oh, oat, ovalue = (np.concatenate(o) for o in occ)
        order = np.argsort(orow, kind="stable")
        which = np.flatnonzero(has)
        number = lambda r: np.bincount(r, minlength=hi - lo)[which]  # noqa: B023, E731
        pick = pa.array(which + lo)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pick), batch.column(1).take(pick), lists(pair["h"].view(np.int64), number(pair["row"])), lists(oh[order].view(np.int64), number(orow)), lists(oat[order].astype(np.int32), number(orow)), lists(ovalue[order].reshape(-1).view(np.int64), number(orow) * WIDTH)],
            ["h1", "h2", "hashes", "occ_hash", "occ_at", "occ_value"],
        )


def consistent(occ_hash: np.ndarray, occ_at: np.ndarray, occ_value: np.ndarray, hashes: np.ndarray, at: np.ndarray, pattern: np.ndarray) -> bool:
    """Slot consistency: each of the item's windows goes to the occurrence whose offset most windows share, and the values
    in the slots of both have to be one to one."""
    hashes, occ_hash = hashes.view(np.uint64), occ_hash.view(np.uint64)  # the order in which items were cut
    k = np.searchsorted(hashes, occ_hash)
    k[k == len(hashes)] = 0
    hit = np.flatnonzero(hashes[k] == occ_hash)
    a, p = at[k[hit]].astype(np.int64), occ_at[hit].astype(np.int64)
    _, offset, votes = np.unique(p - a, return_inverse=True, return_counts=True)
    order = np.lexsort((p, -votes[offset], a))
    best = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])] if len(order) else order
    cell = np.concatenate([np.stack([a[best] + i, p[best] + i, np.repeat(i, len(best)), best], axis=1) for i in range(WIDTH)])
    cell = cell[cell[:, 0] < len(pattern)]
    cell = cell[pattern[cell[:, 0]] > 0]
    if not len(cell):
        return True
    _, once = np.unique(cell[:, :2], axis=0, return_index=True)
    cell = cell[once]
    x, y = pattern[cell[:, 0]], occ_value[hit[cell[:, 3]], cell[:, 2]]
    pairs, times = np.unique(np.stack([x.astype(np.int64), y.astype(np.int64)], axis=1), axis=0, return_counts=True)
    fits = times.sum()
    for side in (0, 1):
        _, of = np.unique(pairs[:, side], return_inverse=True)
        most = np.zeros(of.max() + 1, np.int64)
        np.maximum.at(most, of, times)
        fits = min(fits, most.sum())
    return bool(fits >= AGREE * times.sum())


def _checked(batches):
    """The candidates whose slots agree; those of the literal view have none."""
    for batch in batches:
        keep = []
        for r in range(len(batch)):
            if not batch.column("view")[r].as_py():
                keep.append(r)
                continue
            get = lambda c: batch.column(c)[r].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            if consistent(get("occ_hash"), get("occ_at"), get("occ_value").reshape(-1, WIDTH), get("hashes"), get("at"), get("pattern")):
                keep.append(r)
        yield batch.select(["h1", "h2", "item_id", "view", "share"]).take(pa.array(keep, pa.int64()))


def found_texts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(h1, h2, copies, hits): the texts of ``docs``, by digest, that hold items, and the items: array of (item_id, share,
    how), a row per class of items, by its smallest item_id."""
    sc = docs.sparkSession.sparkContext
    classes = stored(item_classes(items), "items")
    probes = stored(_probes(classes), "probes")
    sent = sc.broadcast((_bitmap(classes.select(F.explode("hashes").alias("hash"))), _bitmap(probes)))

    def cut(batches):
        for batch in batches:
            yield from _cut_documents(*sent.value, batch)

    seen = docs.select(*_digest(F.col("text")), "text").mapInArrow(tidy(cut), _DOC_SCHEMA)
    seen = seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), *[F.any_value(c).alias(c) for c in ("hashes", "occ_hash", "occ_at", "occ_value")])
    seen = stored(seen, "windows")
    pairs = stored(seen.select("h1", "h2", F.explode("hashes").alias("hash")).join(probes, "hash").select("h1", "h2", "class").distinct(), "candidates")
    total = pairs.count()
    both = copied_join(pairs, classes, "class", "h1", total).join(seen.withColumnRenamed("hashes", "mine"), ["h1", "h2"])
    got, need = F.size(F.array_intersect("hashes", "mine")), F.size("hashes")
    both = both.where(100 * got >= SHARE * need).withColumn("share", got / need)
    fits = both.select("h1", "h2", "item_id", "view", "share", "occ_hash", "occ_at", "occ_value", "hashes", "at", "pattern").mapInArrow(_checked, "h1 long, h2 long, item_id long, view int, share double")
    # One hit an item: the verbatim one if there is one, else that of the larger share.
    best = fits.groupBy("h1", "h2", "item_id").agg(F.max(F.struct((F.col("view") == 0).alias("plain"), "share")).alias("b"))
    hits = best.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("item_id", F.col("b.share").alias("share"), F.when(F.col("b.plain"), VIEWS[0]).otherwise(VIEWS[1]).alias("how")))).alias("hits"))
    out = stored(hits.join(seen.select("h1", "h2", "copies"), ["h1", "h2"]), "hits")
    dropped(classes, probes, seen, pairs)
    return out


def _digest(text) -> list:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


_HITS = "array<struct<item_id:long,share:double,how:string>>"


def mark(docs: DataFrame, items: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of ``columns``, by default all of ``docs``) and its ``hits``: array of (item_id, share, how)."""
    found = found_texts(docs, items)
    total = found.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"), *_digest(F.col("text")))
    marked, hit = marked_ids(rows, found, "h1")
    clean = marked.where(~hit).select("row", F.array().cast(_HITS).alias("hits"))
    maybe = join_groups(marked.where(hit).select("row", "h1", "h2"), found, ["h1", "h2"], "copies", total, "left")
    return clean.unionByName(maybe.select("row", F.coalesce("hits", F.array().cast(_HITS)).alias("hits")))


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    return mark(docs, items).where(F.size("hits") == 0).select("row.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("row.doc_id", (F.size("hits") > 0).alias("contaminated"), F.transform("hits", lambda h: h["item_id"]).alias("item_ids"), F.round(F.array_max(F.transform("hits", lambda h: h["share"])), 6).alias("share"))
