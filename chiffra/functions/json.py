"""Tolerant JSON: the outermost readable object or array in a text, as a VARIANT, and its check against what is expected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string with its escapes, a bracket, or what lies between.
_PART = r'(?s)"(?:[^"\\]|\\.)*"|[{}\[\]]|[^"{}\[\]]+|"'


def spans(c: Column) -> Column:
    """array<struct<first, size>>: every span of a text from a bracket to the one that closes it, brackets in strings aside, the
    longest first. A bracket that is never closed, or closed by one of the other kind, opens nothing.

    The text is cut into strings, brackets and the rest, so the fold takes a step a piece, not a character; it holds the open
    brackets with their places."""
    parts = F.regexp_extract_all(c, F.lit(_PART), 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,at:int>>").alias("open"), F.array().cast("array<struct<size:int,first:int>>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        kin = F.when(part == "}", "{").when(part == "]", "[")
        # The nearest open bracket of its kind is closed; what was opened after that opens nothing.
        nearest = F.array_max(F.transform(s["open"], lambda o, i: F.when(o["kind"] == kin, i + 1)))
        first = F.try_element_at(s["open"], nearest)["at"]
        opened = F.concat(s["open"], F.array(F.struct(part.alias("kind"), s["at"].alias("at"))))
        still = F.when(part.isin("{", "["), opened).when(nearest.isNotNull(), F.slice(s["open"], F.lit(1), nearest - 1)).otherwise(s["open"])
        found = F.when(nearest.isNotNull(), F.concat(s["found"], F.array(F.struct((first - s["at"] - 1).alias("size"), first.alias("first"))))).otherwise(s["found"])
        return F.struct((s["at"] + F.length(part)).alias("at"), still.alias("open"), found.alias("found"))

    return F.transform(F.array_sort(F.aggregate(parts, start, step)["found"]), lambda x: F.struct(x["first"].alias("first"), (-x["size"]).alias("size")))


def lenient(c: Column) -> Column:
    """The longest readable object or array in a text, as a VARIANT, whatever stands around it, a fence too; the first of equally
    long ones, null if there is none."""
    read = lambda v, x: F.coalesce(v, F.try_parse_json(F.substr(c, x["first"] + 1, x["size"])))
    return F.aggregate(spans(c), F.try_parse_json(F.lit(None).cast("string")), read)


def is_list(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def listed(v: Column, name: str, item: str) -> Column:
    """The list ``name`` of an object, or the list that the text itself is, as array<struct of ``item``>; null unless it is a list of one
    item or more and each can be read as such a struct."""
    kind = f"array<struct<{item}>>"
    rows = F.when(is_list(v), F.try_variant_get(v, "$", kind)).otherwise(F.try_variant_get(v, f"$.{name}", kind))
    return F.when((F.size(rows) > 0) & ~F.exists(rows, lambda x: x.isNull()), rows)
