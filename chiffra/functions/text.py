"""Text functions as Columns, each with the SQL it equals."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters U+00C0 to U+017F that decompose into a base letter and marks, by rule.
_PAIRS = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x180)]
_PAIRS = [(c, d[0]) for c, d in _PAIRS if len(d) > 1 and unicodedata.combining(d[1])]
ACCENTED, PLAIN = "".join(c for c, _ in _PAIRS), "".join(d for _, d in _PAIRS)

#: French function words left out of lexical matching.
STOP_WORDS = (
    "le la les un une des de du d l et en au aux a dans par pour sur se sa son ses ce cette ces "
    "que qui quoi est sont ont ou plus moins entre selon the of il elle on y ne pas avec leur leurs comme "
    "quel quelle quels quelles combien t s n c qu j m"
).split()


def normalised(c: Column) -> Column:
    """Lower case without accents; typographic apostrophes and ligatures spelled out."""
    t = F.lower(F.translate(c, ACCENTED, PLAIN))
    return F.replace(F.replace(F.replace(t, F.lit("’"), F.lit("'")), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def normalised_sql(x: str) -> str:
    return f"replace(replace(replace(lower(translate({x}, '{ACCENTED}', '{PLAIN}')), '’', ''''), 'œ', 'oe'), 'æ', 'ae')"


def singular(w: Column) -> Column:
    """A simple plural in the singular."""
    plural = (F.length(w) > 4) & w.rlike("[sx]$") & ~w.rlike("(ss|us|is)$")
    return F.when(plural, F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def tokens(c: Column, keep_numbers: bool = True) -> Column:
    """Tokens for matching: no function words, simple plurals in the singular."""
    words = F.filter(F.regexp_extract_all(normalised(c), F.lit("[a-z0-9]+"), 0), lambda w: ~w.isin(STOP_WORDS))
    if not keep_numbers:
        words = F.filter(words, lambda w: ~w.rlike("^[0-9]+$"))
    return F.transform(words, lambda w: singular(w))


def tokens_sql(x: str, keep_numbers: bool = True) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    digits = "" if keep_numbers else " and not regexp_matches(w, '^[0-9]+$')"
    return (
        f"list_transform(list_filter(regexp_extract_all({normalised_sql(x)}, '[a-z0-9]+'), lambda w: w not in ({stop}){digits}), "
        "lambda w: case when len(w) > 4 and regexp_matches(w, '[sx]$') and not regexp_matches(w, '(ss|us|is)$') then substr(w, 1, len(w) - 1) else w end)"
    )


def token_set(c: Column) -> Column:
    """Distinct tokens of more than two letters, no numbers."""
    return F.array_distinct(F.filter(tokens(c, keep_numbers=False), lambda w: F.length(w) > 2))


def token_set_sql(x: str) -> str:
    return f"list_distinct(list_filter({tokens_sql(x, False)}, lambda w: len(w) > 2))"


def jaccard_of(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0.0 else {both} / (len({a}) + len({b}) - {both})::double end)"


TOKEN = r"[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]"


def token_count(c: Column) -> Column:
    """Words and single marks, the unit of window sizes."""
    return F.regexp_count(c, F.lit(TOKEN))


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.;!?])\s+")


def sentences_sql(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.;!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def joined_hyphens(c: Column) -> Column:
    """Words broken at a line end put together, leaders and bullets dropped, blanks collapsed."""
    t = F.regexp_replace(c, r"([a-zà-ÿ])-\n([a-zà-ÿ])", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, r"\.{4,}", " "), r"(?m)^[ \t]*[•▪–-][ \t]+", "")
    return F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))


#: What lists of contents and covers say.
NO_PROSE = ["liste des graphiques", "liste des tableaux", "sommaire", "ministere des", "ministry of", "republique du cameroun", "table des matieres"]


def substantial(c: Column, words: int = 20, capitals: float = 0.4) -> Column:
    """Whether a passage is prose to quote from: ``words`` words or more, no leaders, no words of a cover or list of contents, and not
    mostly capitals."""
    letters, upper = F.regexp_count(c, F.lit(r"\p{L}")), F.regexp_count(c, F.lit(r"\p{Lu}"))
    plain = normalised(c)
    listed = F.lit(False)
    for x in NO_PROSE:
        listed = listed | F.contains(plain, F.lit(x))
    return F.coalesce(~listed & ~c.rlike(r"\.{6,}") & (upper <= capitals * letters) & (F.regexp_count(c, F.lit(r"[^ \t\n\r\x0B\f]+")) >= words), F.lit(False))


#: Units and periods that titles are compared without.
UNIT_PATTERN = r"(?i)\((en|in)\s[^)]*\)|\(\s*%\s*\)|\ben\s*%"
PERIOD_PATTERN = r"(?i)\b(de|entre|en|depuis)?\s*(19|20)\d{2}(\s*(a|à|et|-)\s*(19|20)?\d{0,2})?\b"


def bare_title(c: Column) -> Column:
    """A title without units, periods and years."""
    t = F.regexp_replace(F.regexp_replace(c, UNIT_PATTERN, " "), "(?U)" + PERIOD_PATTERN, " ")
    t = F.regexp_replace(F.replace(normalised(t), F.lit("crees"), F.lit("creees")), r"\s+", " ")
    return F.btrim(t, F.lit(" .,:"))


def slug(c: Column, n: int = 6) -> Column:
    """The first ``n`` distinct words of a bare title, joined by hyphens."""
    dull = ["des", "les", "par", "selon", "evolution", "repartition"]
    words = F.array_distinct(F.filter(F.regexp_extract_all(bare_title(c), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) > 2) & ~w.isin(dull)))
    return F.coalesce(F.nullif(F.array_join(F.slice(words, 1, n), "-"), F.lit("")), F.lit("indicateur"))


def dominant_year(docs: DataFrame, key: str, text: str, announced: int = 5) -> DataFrame:
    """(key, year, weight): the year that a text names most, a mention after "exercice" counting ``announced`` more; the latest
    on ties."""
    years = lambda pattern, group, weight: docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), group)).alias("year"), F.lit(weight).alias("w"))
    y = years(r"\b((19|20)\d{2})\b", 1, 1).unionByName(years(r"(?i)exercice\s+((19|20)\d{2})\b", 1, announced))
    y = y.groupBy(key, F.col("year").cast("int").alias("year")).agg(F.sum("w").alias("weight"))
    return y.groupBy(key).agg(F.max_by(F.struct("year", "weight"), F.struct("weight", "year")).alias("b")).select(key, "b.year", "b.weight")


def informativeness(c: Column, function_words: list[str] = STOP_WORDS) -> Column:
    """Between 0.15 and 1: how much a text is prose (by its share of function words, from 0.20 to 0.42) or data (by its share of
    numbers of three digits and more, from 0.05 to 0.18); forms and tables of contents are neither."""
    words = F.regexp_extract_all(normalised(c), F.lit("[a-z0-9]+"), 0)
    share = lambda f: F.size(F.filter(words, f)) / F.nullif(F.size(words), F.lit(0))
    ramp = lambda x, low, high: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    prose, data = ramp(share(lambda w: w.isin(function_words)), 0.20, 0.42), ramp(share(lambda w: w.rlike("^[0-9]{3,}$")), 0.05, 0.18)
    return F.when(F.size(words) == 0, 0.15).otherwise(F.greatest(F.lit(0.15), prose, data))
