"""Command line: ``python -m chiffra.cli list`` names the queries, ``run NAME FOLDER`` runs one over the tables of a folder and
shows its first rows, or writes it (``--out``, as Parquet, or as semicolon CSV with ``--csv``). ``consult FOLDER QUESTION`` answers
with excerpts of authorised passages or says that none is near enough; ``comment FOLDER INDICATOR YEAR`` writes the
commentary of an indicator, and ``note FOLDER YEAR`` a year's key messages and leads."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.functions import text as T
from chiffra.operators import retrieval as R
from chiffra.plans import notes as PN
from chiffra.plans import retrieval as PR
from chiffra.plans.base import authorised, passages
from chiffra.plans.catalogue import ORACLE_SQL, QUERIES
from chiffra.session import session
from chiffra.sources import writers


def consult(spark: SparkSession, folder: str, question: str, top: int = 5, threshold: float = PN.THRESHOLDS["lexical"]) -> DataFrame:
    """(rank, id, score, excerpt) of the passages that answer a question; no rows where the best scores below the threshold."""
    q = spark.createDataFrame([(0, question)], "item_id long, text string")
    hits = R.bm25_top_k(PR.index(spark, folder), R.question_terms(q), top, authorised(spark, folder))
    near = hits.groupBy("qid").agg(F.max("score").alias("signal")).where(F.col("signal") >= threshold).select("qid")
    words = q.select(F.col("item_id").alias("qid"), T.token_set(F.col("text")).alias("words"))
    shown = R.excerpts(hits.join(near, "qid", "left_semi").select("qid", "id", "rank", "score"), passages(spark, folder), words)
    return shown.orderBy("rank").select("rank", "id", F.round("score", 4).alias("score"), "excerpt")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chiffra", description=__doc__)
    todo = parser.add_subparsers(dest="todo", required=True)
    todo.add_parser("list")
    run = todo.add_parser("run")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("folder")
    run.add_argument("--out")
    run.add_argument("--csv", action="store_true")
    run.add_argument("--rows", type=int, default=20, help="rows that are shown where nothing is written")
    ask = todo.add_parser("consult")
    ask.add_argument("folder")
    ask.add_argument("question")
    ask.add_argument("--threshold", type=float, default=PN.THRESHOLDS["lexical"])
    comment = todo.add_parser("comment")
    comment.add_argument("folder")
    comment.add_argument("indicator")
    comment.add_argument("year", type=int)
    note = todo.add_parser("note")
    note.add_argument("folder")
    note.add_argument("year", type=int)
    given = parser.parse_args(args)
    if given.todo == "list":
        for name in sorted(QUERIES):
            print(f"{name}{'' if name in ORACLE_SQL else ' (no SQL)'}")
        return 0
    if given.todo == "consult":
        rows = consult(session(), given.folder, given.question, threshold=given.threshold).collect()  # five at most
        print("\n".join(f"{r['rank']}. [{r['id']}] {r['excerpt']}" for r in rows) or "no passage is near enough")
        return 0
    if given.todo == "comment":
        said = PN.template_commentary(session(), given.folder).where((F.col("indicator") == given.indicator) & (F.col("year") == given.year))
        print("\n".join(r["text"] for r in said.orderBy("position").collect()) or "nothing is known of it")
        return 0
    if given.todo == "note":
        of = lambda q: q(session(), given.folder).where(F.col("note_id") == given.year)
        for r in of(PN.key_messages).orderBy("position").collect():
            print(f"- {r['role']} : {r['name']}{'' if r['label'] is None else ' / ' + r['label']} ({r['change']:+.1f} %)")
        for r in of(PN.typed_leads).orderBy("name").collect():
            print(f"- {r['kind']} : {r['name']}{' (' + r['labels'] + ')' if r['labels'] else ''}")
        return 0
    out = QUERIES[given.name](session(), given.folder)
    if not given.out:
        out.show(given.rows, truncate=False)
    elif given.csv:
        writers.csv(out, given.out)
    else:
        out.write.mode("overwrite").parquet(given.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
