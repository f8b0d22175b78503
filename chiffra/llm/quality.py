"""Operator 6, quality rules: a learned decision list over counts of each whole text, applied as Spark conditionals.

Sequential covering in the manner of RIPPER: a rule for rejection grows, one threshold condition at a time by FOIL
gain, on two thirds of the labelled rows, and is pruned on the other third; rows it covers leave; the next rule is
grown on the rest, until a rule is no longer precise enough. The list becomes one ``CASE WHEN`` over the counts, so
applying it is plain Spark SQL.

It is fitted on at most ``fit_rows`` labelled documents (those of smallest hash of their doc_id), a stated sample;
the counts and the verdicts cover every row and every text whole. Without usable labels, or without a rule that is
precise enough, the list is empty and keeps all. Null or empty texts have counts of 0 and fail the base rule (fewer
than ten words). Labels with a null quality are left out; a doc_id labelled twice counts once, as bad if either is, and on several rows once.
Columns of the input may have any names: they travel in one struct. Texts are read whole, however long. An empty table gives
an empty result. Of conditions with equal gain the first count and the lowest threshold win.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm._common import documents, stored
from chiffra.llm._text import Words, mix, span_hashes, strings, sums, tidy, windows

FIT_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_upper", "n_marks", "n_digits", "n_lines")
WINDOW = 5

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    return np.isin(keys, twice) if len(twice) else np.zeros(len(keys), bool)


def text_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a slice."""
    w = Words(data, offs)
    lead = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    solid = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    upper = _UPPER[data]
    out = {"n_words": w.count, "word_chars": sums(lead & solid, offs), "n_symbols": sums(_SYMBOL[data], offs), "n_chars_all": sums(lead, offs), "n_upper": sums(upper, offs), "n_marks": sums(_MARK[data], offs), "n_digits": sums(_DIGIT[data], offs)}

    breaks = np.flatnonzero(data == 10)
    begin = np.union1d(breaks + 1, offs[:-1])
    begin = begin[begin < len(data)]
    end = np.minimum(np.searchsorted(offs, begin, "right"), len(offs) - 1)
    end = offs[end]
    cut = np.searchsorted(breaks, begin)
    if len(breaks):
        end = np.minimum(end, np.where(cut < len(breaks), breaks[np.minimum(cut, len(breaks) - 1)], len(data)))
    held = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[held], end[held]
    row = np.searchsorted(offs, begin, "right") - 1
    key = span_hashes(data, begin, end) ^ mix(row.astype(np.uint64), 7)
    first = np.unique(key, return_index=True)[1]
    out["n_lines"] = np.bincount(row, minlength=len(w.count))
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[first], minlength=len(w.count))

    win = windows(w.hashes(), WINDOW)
    row = w.rows()[: len(win)]
    whole = np.arange(len(win)) + WINDOW <= w.first[1:][row]
    at = np.flatnonzero(whole)
    at = at[_repeats(win[at] ^ mix(row[at].astype(np.uint64), 11))]
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    out["n_repeat_words"] = sums(np.cumsum(cover[:-1]) > 0, w.first)
    return out


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (a struct of all columns of ``df``) and the counts of its text."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))

    def count(batches):
        for batch in batches:
            col = batch.column(0).field(text)
            parts = [text_counts(data, offs) for _, _, data, offs in strings(col)]
            cols = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["row", *COUNTS])

    schema = f"row {packed.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    return packed.mapInArrow(tidy(count), schema)


#: Features of the rules, as SQL over the counts; the same text is evaluated by Spark and, for fitting, by numpy.
FEATURES = {
    "symbols_per_char": ("n_symbols", "n_chars_all"),
    "upper_per_char": ("n_upper", "n_chars_all"),
    "marks_per_word": ("n_marks", "n_words"),
    "digits_per_char": ("n_digits", "n_chars_all"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
Rule = list[tuple[str, str, float]]


def _holds(x: dict[str, np.ndarray], rule: Rule) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, op, cut in rule:
        out &= x[name] >= cut if op == ">=" else x[name] <= cut
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: Rule = []
    held = np.ones(len(bad), bool)
    while len(rule) < most and bad[held].sum() and not bad[held].all():
        p0, n0 = bad[held].sum(), held.sum()
        best = (1e-9, None)
        for name, v in x.items():
            vals = np.unique(v[held])
            cuts = (vals[1:] + vals[:-1]) / 2  # halfway between neighbours
            if len(cuts) > 256:
                cuts = cuts[np.linspace(0, len(cuts) - 1, 256).astype(int)]
            if not len(cuts):
                continue
            order = np.sort(v[held & bad])
            every = np.sort(v[held])
            for op in (">=", "<="):
                side = "left" if op == ">=" else "right"
                p, n = np.searchsorted(order, cuts, side), np.searchsorted(every, cuts, side)
                p, n = (p0 - p, n0 - n) if op == ">=" else (p, n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, op, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        held &= _holds(x, [best[1]])
    return rule


def _prune(x: dict[str, np.ndarray], bad: np.ndarray, rule: Rule) -> Rule:
    def worth(r: Rule) -> float:
        h = _holds(x, r)
        p, n = (bad & h).sum(), (~bad & h).sum()
        return (p - n) / max(1, p + n)

    best = max(range(1, len(rule) + 1), key=lambda k: (worth(rule[:k]), -k)) if rule else 0
    return rule[:best]


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 5, most_rules: int = 12, most_conditions: int = 3) -> list[Rule]:
    """The ordered rules, each a conjunction under which a row is rejected. Rows are taken in the order given: every
    third is for pruning. A rule has to cover ``least`` rows with ``precision`` over all rows left."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules and bad[left].sum() >= least:
        grow, prune = left & ~third, left & third
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        rule = _prune({k: v[prune] for k, v in x.items()}, bad[prune], rule)
        if not rule:
            break
        held = left & _holds(x, rule)
        if held.sum() < least or bad[held].sum() < precision * held.sum():
            break
        rules.append(rule)
        left &= ~held
    return rules


def features() -> dict[str, Column]:
    return {k: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)) for k, (a, b) in FEATURES.items()}


def as_condition(rules: list[Rule]) -> Column:
    """The list as one ordered Spark conditional: true keeps."""
    f = features()
    out = F.when(F.lit(False), True)
    for rule in rules:
        c = F.lit(True)
        for name, op, cut in rule:
            c = c & (f[name] >= F.lit(cut) if op == ">=" else f[name] <= F.lit(cut))
        out = out.when(c, False)
    return out.otherwise(True)


def label_sample(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, quality, h) of at most ``fit_rows`` labelled doc_ids, those of smallest hash; small enough to broadcast."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return F.broadcast(marks.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(fit_rows))


def fit(counted: DataFrame, marks: DataFrame, **options) -> list[Rule]:
    """Learn the list from counted rows (with doc_id) that pass the base rule, and a sample of labels."""
    one = counted.where(~base_failed()).join(marks, "doc_id").groupBy("h", "doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("c"))
    x = one.select("h", "doc_id", "quality", "c.*").toPandas().sort_values(["h", "doc_id"])
    if x.empty:
        return []
    num = {k: np.nan_to_num(x[a].to_numpy(float) / np.where(x[b] == 0, np.nan, x[b].to_numpy(float))) for k, (a, b) in FEATURES.items()}
    return learn_list(num, (x["quality"] == 0).to_numpy(), **options)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    counted = stored(with_counts(docs.select("doc_id", "text")).select("row.doc_id", *COUNTS), "quality-counts")
    rules = fit(counted, label_sample(labels, fit_rows))
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & as_condition(rules))


def good_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass. For fitting, only the texts of the sample are counted."""
    marks = label_sample(labels, fit_rows)
    marked = docs.select("doc_id", "text").join(marks.select("doc_id"), "doc_id", "left_semi")
    rules = fit(with_counts(marked).select("row.doc_id", *COUNTS), marks)
    return with_counts(docs).where(~base_failed() & as_condition(rules)).select("row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
