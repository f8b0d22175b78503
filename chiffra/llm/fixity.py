"""Operator 4, Merkle fixity audit of WARC replicas.

Each page is one WARC resource record; its record bytes (header, blank line, body, two line ends) give length and
SHA-256. Records in the order of (page_id, digest, copy) get gapless ordinals and byte offsets. A tree of fan-out
``FANOUT`` stands on them: a node's hash is the SHA-256 of its children's hashes in order, and its span is the offset
range of its records. An audit compares two replicas' roots and then, level by level, joins only the children of nodes
that differ; what is left at the lowest level are the damaged, missing and added records with their offset ranges.

Ordinals and offsets come from sums over ranges of the order, so no task sees all records. Trees of replicas that differ
in length are compared node by node as well: a replica's record takes the ordinal of its partner in the reference, so a
missing record leaves a hole and doesn't shift the rest. Partners are first the records of one page_id and one digest,
one to one, and then, within a page_id, the records left over on both sides (in the order of their hashes), so that one
spoiled copy of many is one report. Numbers within a page_id are taken in hash buckets, so a page_id with a third of all
rows, or null page_ids, are spread over many tasks.

Null ids sort first and are one page; null URLs and bodies count as empty; repeated rows are told apart by ``copy``, a
running number among records of one page_id and digest. Bodies are hashed whole, however long. Extra columns are ignored,
whatever their names. Empty tables have a root over nothing: against an empty replica every record is missing, and the
other way round every record is added.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chiffra.llm._common import documents, dropped, ranked, stored

FANOUT = 64


def record(url: Column, body: Column) -> Column:
    """The bytes of a WARC 1.1 resource record."""
    payload = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:"), F.sha2(payload, 256),
        F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), payload, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, copy, length, digest) of each row; ``copy`` numbers, from 1, the rows of one page_id and digest."""
    rows = pages.select("page_id", record(F.col("url"), F.col("html")).alias("bytes")).select("page_id", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"))
    # Equal records differ in nothing: a number that is written down once tells them apart from then on.
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "warc-records")
    return ranked(rows, ["page_id", "digest"], [F.col("place")], rows.count(), "copy").select("page_id", (F.col("copy") + 1).cast("long").alias("copy"), "length", "digest")


def placed(recs: DataFrame) -> DataFrame:
    """Add ``ordinal`` and ``offset`` in the order of (page_id, digest, copy)."""
    n = recs.sparkSession
    keys = [F.col("page_id").asc_nulls_first(), "digest", "copy"]
    parts = int(n.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(recs.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "warc-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"))  # a row per range
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    within = Window.partitionBy("part").orderBy(*keys)
    out = ranged.withColumn("nth", F.row_number().over(within) - 1).withColumn("run", F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return out.join(F.broadcast(sums), "part").select("page_id", "copy", "length", "digest", (F.col("n0") + F.col("nth")).alias("ordinal"), (F.col("b0") + F.col("run")).alias("offset"))


def tree(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (node, hash, records, first_byte, end_byte) from the leaves' parents up to the root; leaves have
    ordinal, offset, length, digest."""
    level = leaves.select(F.col("ordinal").alias("node"), F.col("digest").alias("hash"), F.lit(1).cast("long").alias("records"), F.col("offset").alias("first_byte"), (F.col("offset") + F.col("length")).alias("end_byte"))
    out = [level]
    while True:
        up = level.groupBy(F.expr(f"node div {fanout}").alias("up")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"),
            F.sum("records").alias("records"), F.min("first_byte").alias("first_byte"), F.max("end_byte").alias("end_byte"),
        )
        level = stored(up.withColumnRenamed("up", "node"), "merkle")
        out.append(level)
        if level.where("node > 0").isEmpty():
            break
    return out


def audit(reference: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(ordinal, page_id, copy, first_byte, end_byte, expected, actual, state) of the records at which the replica's tree leaves
    the reference's; both are (page_id, copy, length, digest, ordinal, offset), placed on the reference's ordinals."""
    a, b = tree(reference, fanout), tree(replica, fanout)
    while len(a) != len(b):  # a shorter tree goes on with its root
        short = min(a, b, key=len)
        short.append(short[-1].withColumn("hash", F.sha2("hash", 256)))
    bad = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if bad is not None:
            x = x.join(bad, F.expr(f"node div {fanout}") == bad["parent"], "left_semi")
            y = y.join(bad, F.expr(f"node div {fanout}") == bad["parent"], "left_semi")
        both = x.alias("x").join(y.alias("y"), F.col("x.node") == F.col("y.node"), "full_outer").where(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
        diff = both.select(F.coalesce("x.node", "y.node").alias("node"), F.col("x.hash").alias("expected"), F.col("y.hash").alias("actual"), F.coalesce("x.first_byte", "y.first_byte").alias("first_byte"), F.coalesce("x.end_byte", "y.end_byte").alias("end_byte"))
        diff = stored(diff, "merkle-diff")
        bad = diff.select(F.col("node").alias("parent"))
        if diff.isEmpty():
            break
    sides = [t.select("ordinal", F.struct(F.lit(k).alias("side"), "page_id", "copy").alias("name")) for k, t in enumerate((reference, replica))]
    names = sides[0].unionByName(sides[1]).join(bad, F.col("ordinal") == F.col("parent"), "left_semi").groupBy("ordinal").agg(F.min_by("name", "name.side").alias("name")).select("ordinal", "name.page_id", "name.copy")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "added").otherwise("damaged")
    return diff.withColumnRenamed("node", "ordinal").join(names, "ordinal").select("ordinal", "page_id", "copy", "first_byte", "end_byte", "expected", "actual", state.alias("state"))


def replica_of(pages: DataFrame, spoiled: int = 97) -> DataFrame:
    """A second copy of the archive with known faults, for drills: where the MD5 of page_id (its first 28 bits) leaves 0 by
    ``spoiled`` the first character of the body is replaced, where it leaves 1 the last one is cut off."""
    mark = F.coalesce(F.conv(F.substr(F.md5(F.col("page_id").cast("string").cast("binary")), F.lit(1), F.lit(7)), 16, 10).cast("long") % spoiled, F.lit(-1))
    body = F.coalesce(F.col("html"), F.lit(""))
    return pages.withColumn("html", F.when(mark == 0, F.concat(F.lit("~"), F.substr(body, F.lit(2)))).when((mark == 1) & (F.length(body) > 0), F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(F.col("html")))


def audited(pages: DataFrame, other: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(the reference's records with ordinals and offsets, the audit of ``other`` against it)."""
    ref = stored(placed(records(pages)), "warc")
    rep = stored(records(other), "warc-replica")
    place = ["ordinal", "offset"]
    key = lambda t, n: t["page_id"].eqNullSafe(F.col(f"{n}.p")) & (t["copy"] == F.col(f"{n}.c")) & (t["digest"] == F.col(f"{n}.d"))
    name = lambda t: t.select(F.col("page_id").alias("p"), F.col("copy").alias("c"), F.col("digest").alias("d"), *[c for c in place if c in t.columns])
    met = rep.join(name(ref).alias("k"), key(rep, "k"), "left").select(*[rep[c] for c in rep.columns], *place)
    # What has no equal on the other side, numbered within its page.
    loose = [stored(t, "warc-loose") for t in (met.where("ordinal is null").drop(*place), ref.join(name(rep).alias("k"), key(ref, "k"), "left_anti"))]
    mine, theirs = (ranked(t, ["page_id"], [F.col("digest"), F.col("copy")], t.count(), "nth") for t in loose)
    theirs = theirs.select(F.col("page_id").alias("p"), F.col("nth").alias("n"), *place)
    paired = stored(mine.join(theirs, mine["page_id"].eqNullSafe(theirs["p"]) & (mine["nth"] == theirs["n"]), "left").select(*rep.columns, *place), "warc-paired")
    size = ref.agg(F.coalesce(F.max("ordinal"), F.lit(-1)) + 1, F.coalesce(F.max(F.col("offset") + F.col("length")), F.lit(0))).first()
    added = placed(paired.where("ordinal is null").drop(*place)).withColumn("ordinal", F.col("ordinal") + size[0]).withColumn("offset", F.col("offset") + size[1])
    out = met.where("ordinal is not null").unionByName(paired.where("ordinal is not null")).unionByName(added.select(*rep.columns, *place))
    out = stored(out, "warc-placed")
    dropped(rep, *loose, paired)
    return ref, audit(ref, out, fanout)


def op4_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its place and digest, and what the audit of the drill replica says of it."""
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    ref, found = audited(pages, replica_of(pages))
    out = ref.join(found.select("ordinal", "actual", "state"), "ordinal", "left")
    return out.select("page_id", "ordinal", "offset", "length", "digest", F.coalesce("state", F.lit("intact")).alias("state"), F.coalesce("actual", "digest").alias("replica_digest"))


def _sql() -> str:
    nl = "chr(13) || chr(10)"
    rec = lambda body: f"'WARC/1.1' || {nl} || 'WARC-Type: resource' || {nl} || 'WARC-Target-URI: ' || coalesce(url, '') || {nl} || 'Content-Type: text/html' || {nl} || 'WARC-Block-Digest: sha256:' || sha256({body}) || {nl} || 'Content-Length: ' || strlen({body}) || {nl} || {nl} || {body} || {nl} || {nl}"
    return f"""
with p as (select page_id, url, coalesce(html, '') a, coalesce(('0x' || substr(md5(page_id::varchar), 1, 7))::bigint % 97, -1) mark from pages),
q as (select *, case when mark = 0 then '~' || substr(a, 2) when mark = 1 and length(a) > 0 then substr(a, 1, length(a) - 1) else a end b from p),
x as (select page_id, {rec('a')} ra, {rec('b')} rb from q),
l as (select page_id, strlen(ra)::bigint len, sha256(ra) digest, row_number() over (partition by page_id, sha256(ra)) copy from x),
r as (select page_id, sha256(rb) digest, row_number() over (partition by page_id, sha256(rb)) copy from x),
ll as (select page_id, digest, copy, row_number() over (partition by page_id order by digest, copy) k from l where not exists (select 1 from r where r.page_id is not distinct from l.page_id and r.digest = l.digest and r.copy = l.copy)),
rr as (select page_id, digest, row_number() over (partition by page_id order by digest, copy) k from r where not exists (select 1 from l where r.page_id is not distinct from l.page_id and r.digest = l.digest and r.copy = l.copy)),
b as (select ll.page_id, ll.digest, ll.copy, rr.digest actual from ll join rr on ll.page_id is not distinct from rr.page_id and ll.k = rr.k)
select l.page_id, row_number() over o - 1 as ordinal, (sum(len) over (o rows between unbounded preceding and current row) - len)::bigint as "offset", len as "length", l.digest, case when actual is null then 'intact' else 'damaged' end as state, coalesce(actual, l.digest) replica_digest
from l left join b on l.page_id is not distinct from b.page_id and l.digest = b.digest and l.copy = b.copy window o as (order by l.page_id nulls first, l.digest, l.copy)"""


SQL = {"op4_fixity_audit": _sql()}
