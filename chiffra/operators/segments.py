"""A state machine over the lines of documents as a parallel prefix: any document is as many tasks as it has blocks of lines.

A machine has a few states and a few registers that hold line numbers. What a run of lines does is a function of the state in
which it is entered: the state it leaves, and for each register the line it was set to last, or that it was cleared, or
neither. Such functions are put together like the lines themselves. So each block of lines is folded to its function,
the functions of a document's blocks are run through in order, which gives every block the state it is entered in, and each
block then numbers its own lines from there. No window or group holds more than one block's lines.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chiffra.functions.numbers import let

BLOCK = 256
_KEEP, _CLEAR = -1, -2


@dataclass(frozen=True)
class Machine:
    """``moves``: (state, symbol) to (next state, registers set to this line, registers cleared). Other pairs change nothing."""

    states: tuple[str, ...]
    registers: tuple[str, ...]
    moves: Mapping[tuple[str, str], tuple[str, tuple[str, ...], tuple[str, ...]]]

    def start(self, state: int) -> Column:
        return F.struct(F.lit(state).alias("state"), *[F.lit(_KEEP).cast("long").alias(r) for r in self.registers])

    def step(self, at: Column, line: Column) -> Column:
        """The state and registers after a line (n, symbol)."""
        state, registers = at["state"], {r: at[r] for r in self.registers}
        for (was, symbol), (then, sets, clears) in self.moves.items():
            here = (at["state"] == self.states.index(was)) & (line["symbol"] == symbol)
            state = F.when(here, self.states.index(then)).otherwise(state)
            for r in sets:
                registers[r] = F.when(here, line["n"]).otherwise(registers[r])
            for r in clears:
                registers[r] = F.when(here, F.lit(_CLEAR).cast("long")).otherwise(registers[r])
        return F.struct(state.alias("state"), *[c.alias(r) for r, c in registers.items()])

    def after(self, at: Column, function: Column) -> Column:
        """What ``at`` becomes when a block's function (one entry per state) follows."""
        end = F.get(function, at["state"])
        return F.struct(end["state"].alias("state"), *[F.when(end[r] == _KEEP, at[r]).otherwise(end[r]).alias(r) for r in self.registers])


def scan(lines: DataFrame, key: str, machine: Machine, block: int = BLOCK) -> DataFrame:
    """(key, n, state, a column per register): the state after each line (key, n, symbol) and the line that each register
    holds then, null if none. Every document starts in the machine's first state; lines are numbered from 0 without gaps."""
    numbered = lines.select(key, F.floor(F.col("n") / block).alias("block"), F.struct(F.col("n").cast("long").alias("n"), "symbol").alias("line"))
    blocks = numbered.groupBy(key, "block").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    folded = blocks.select(key, "block", F.array(*[F.aggregate("lines", machine.start(s), machine.step) for s in range(len(machine.states))]).alias("function"))
    run = folded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "function"))).alias("blocks"))
    begin = F.struct(machine.start(0).alias("at"), F.array().cast(f"array<struct<block:bigint,at:struct<state:int,{','.join(f'{r}:bigint' for r in machine.registers)}>>>").alias("entries"))
    through = lambda s, b: F.struct(machine.after(s["at"], b["function"]).alias("at"), F.concat(s["entries"], F.array(F.struct(b["block"].alias("block"), s["at"].alias("at")))).alias("entries"))
    entries = run.select(key, F.inline(F.aggregate("blocks", begin, through)["entries"]))
    rows = blocks.join(entries, [key, "block"])
    kind = f"array<struct<n:bigint,state:int,{','.join(f'{r}:bigint' for r in machine.registers)}>>"

    def inside(s: Column, line: Column) -> Column:
        return let(machine.step(s["at"], line), lambda at: F.struct(at.alias("at"), F.concat(s["out"], F.array(F.struct(line["n"].alias("n"), at["state"].alias("state"), *[at[r].alias(r) for r in machine.registers]))).alias("out")))

    out = F.aggregate("lines", F.struct(F.col("at"), F.array().cast(kind).alias("out")), inside)["out"]
    names = F.array(*[F.lit(s) for s in machine.states])
    held = lambda r: F.when(F.col(r) >= 0, F.col(r)).alias(r)
    return rows.select(key, F.inline(out)).select(key, "n", F.get(names, F.col("state")).alias("state"), *[held(r) for r in machine.registers])


#: Chapters and sections are carried forward; a chart owns the text up to the next title, source or blank line. Titles and
#: charts before the first chapter belong to nothing.
DOCUMENT = Machine(
    ("front", "chapter", "chart"),
    ("chapter", "section", "chart"),
    {
        ("front", "chapter"): ("chapter", ("chapter",), ()),
        ("chapter", "chapter"): ("chapter", ("chapter",), ("section",)),
        ("chart", "chapter"): ("chapter", ("chapter",), ("section", "chart")),
        ("chapter", "section"): ("chapter", ("section",), ()),
        ("chart", "section"): ("chapter", ("section",), ("chart",)),
        ("chapter", "chart"): ("chart", ("chart",), ()),
        ("chart", "chart"): ("chart", ("chart",), ()),
        ("chart", "source"): ("chapter", (), ("chart",)),
        ("chart", "blank"): ("chapter", (), ("chart",)),
    },
)
