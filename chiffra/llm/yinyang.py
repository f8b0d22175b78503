"""Operator 13, centroid clustering by the Yinyang method: exact k-means whose bounds leave most distances out.

The centroids are put into groups once, by a few rounds of plain clustering among themselves. Each vector keeps an upper
bound of the distance to its centroid and one lower bound a group of the distance to the others in it. When centroids
have moved, the upper bound grows by the move of the vector's centroid and each lower bound shrinks by the longest move in
its group. A vector whose upper bound lies below all lower bounds stays where it is; else the bound is made exact, and
only the centroids of groups whose lower bound doesn't exceed it are measured. Comparisons leave a margin over rounding, and a
bound that is met by a tie counts as exceeded, so the clusters are those of plain Lloyd rounds to the last row.

Vectors are integers, and so are distances and sums: everything is exact. A round is one pass over the vectors, a table of
the shared folder, and adds up only the vectors that have changed their cluster: one row a task and cluster. The driver
holds the ``k`` centroids and their sums, nothing else; ``k`` and the dimension bound it.

Left out are vectors that are null, of another length, or hold a null or a value that isn't finite. Components beyond
2^27 in size count as that, so that a squared distance is a long; an inertia beyond a long is null. The first centroids
are the vectors of the smallest hashes of their ids; rows of equal hash go by the vector, and those without an id come
last. Fewer vectors than ``k`` make as many centroids. Equal vectors and repeated rows are rows of their own. Of equally
near centroids the smaller number wins; a centroid without vectors stays. An empty table gives an empty result. Only the
id and the vector are read; columns of any names may stand beside.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm._common import documents, dropped, stored

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Centroids of a group on average, and the largest component.
PER_GROUP, LARGEST = 4, 1 << 27
#: Relative and absolute margin of comparisons of bounds.
REL, ABS = 1e-9, 1e-6
STATE = "vec_id long, vec array<int>, cluster int, upper double, lower array<double>, measured int, sums array<long>, n long"


def integer_vectors(rows: DataFrame, vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): the vectors that are kept, as integers floor(scale * x)."""
    v = F.col(f"`{vector}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.least(F.lit(2.0**40), F.greatest(F.lit(-(2.0**40)), scale * x.cast("double")))))).cast("int")
    return rows.where((F.size(v) == dim) & F.forall(v, finite)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, whole).alias("vec"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact in 64 bits. Small components go through floating point, which is exact
    below 2^53."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 21 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)


def grouped(c: np.ndarray) -> np.ndarray:
    """The group of each centroid, from five rounds of plain clustering with evenly spaced seeds."""
    t = math.ceil(len(c) / PER_GROUP)
    seeds = c[np.linspace(0, len(c) - 1, t).astype(int)].astype(np.float64)
    for _ in range(5):
        group = ((c[:, None, :] - seeds) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(t):
            if (group == g).any():
                seeds[g] = c[group == g].mean(axis=0)
    return np.unique(group, return_inverse=True)[1]


def floor_means(sums: list[list[int]], counts: list[int], old: np.ndarray) -> np.ndarray:
    return np.array([[s // n for s in row] if n else list(was) for row, n, was in zip(sums, counts, old.tolist(), strict=True)], np.int64).reshape(old.shape)


def measure(x: np.ndarray, c: np.ndarray, group: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, measured) of vectors after the centroids have moved to ``c`` by ``drift``; ``measured`` counts
    distances. A cluster of -1 has no bounds yet."""
    t, cluster, measured = lower.shape[1], cluster.copy(), np.zeros(len(x), np.int64)
    known = cluster >= 0
    upper = np.where(known, upper + drift[cluster], np.inf)
    lower = np.where(known[:, None], lower - np.array([drift[group == g].max() for g in range(t)]), 0.0)
    beyond = lambda low, up: low * (1 - REL) - ABS > up * (1 + REL)  # noqa: E731 - surely farther than the centroid
    # Globally, then with an exact upper bound.
    open_ = np.flatnonzero(~(known & beyond(lower.min(axis=1), upper)))
    have = open_[known[open_]]
    if len(have):
        diff = x[have] - c[cluster[have]]
        upper[have] = np.sqrt((diff * diff).sum(axis=1).astype(np.float64))
        measured[have] += 1
    open_ = open_[~(known[open_] & beyond(lower[open_].min(axis=1), upper[open_]))]
    if not len(open_):
        return cluster, upper, lower, measured
    # By group: the centroids of those that are left are measured.
    scan = ~beyond(lower[open_], upper[open_, None]) | ~known[open_, None]
    d = np.full((len(open_), len(c)), np.iinfo(np.int64).max)
    for g in range(t):
        rows, of = np.flatnonzero(scan[:, g]), np.flatnonzero(group == g)
        d[np.ix_(rows, of)] = squared(x[open_[rows]], c[of])
        measured[open_[rows]] += len(of)
    was, here = cluster[open_], np.arange(len(open_))
    old = np.flatnonzero(was >= 0)
    diff = x[open_[old]] - c[was[old]]
    d[old, was[old]] = (diff * diff).sum(axis=1)
    best = d.argmin(axis=1)  # the smallest number of equal ones
    rest = d.astype(np.float64)
    rest[d == np.iinfo(np.int64).max] = np.inf
    rest[here, best] = np.inf
    for g in range(t):
        of = np.flatnonzero(group == g)
        near = np.sqrt(rest[:, of].min(axis=1))
        # In a group that wasn't scanned only the centroid that was left behind may be nearer than the bound.
        lower[open_, g] = np.where(scan[:, g], near, np.minimum(lower[open_, g], near))
    upper[open_] = np.sqrt(d[here, best].astype(np.float64))
    cluster[open_] = best
    return cluster, upper, lower, measured


def _pass(rows: DataFrame, c: np.ndarray, group: np.ndarray, drift: np.ndarray) -> DataFrame:
    """A round: the state of every vector, and at the end of a task the sums of those that came to or left each cluster."""
    t, (k, dim) = int(group.max()) + 1, c.shape

    def run(batches):
        sums, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            size = b.num_rows
            x = np.asarray(b.column("vec").flatten(), np.int64).reshape(size, dim)
            if "cluster" in b.schema.names:
                was, upper, lower = (np.asarray(b.column("cluster")), np.asarray(b.column("upper")), np.asarray(b.column("lower").flatten()).reshape(size, t))
            else:
                was, upper, lower = np.full(size, -1), np.zeros(size), np.zeros((size, t))
            now, upper, lower, measured = measure(x, c, group, was, upper, lower, drift)
            moved = np.flatnonzero(now != was)
            np.add.at(sums, now[moved], x[moved])
            np.add.at(n, now[moved], 1)
            left = moved[was[moved] >= 0]
            np.subtract.at(sums, was[left], x[left])
            np.subtract.at(n, was[left], 1)
            offs = pa.array(np.arange(size + 1, dtype=np.int32) * t)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("vec"), pa.array(now.astype(np.int32)), pa.array(upper), pa.ListArray.from_arrays(offs, pa.array(lower.ravel())), pa.array(measured.astype(np.int32)), pa.nulls(size, pa.list_(pa.int64())), pa.nulls(size, pa.int64())],
                NAMES,
            )
        met = np.flatnonzero(np.abs(sums).sum(axis=1) + np.abs(n))
        if len(met):
            null = lambda kind: pa.nulls(len(met), kind)
            yield pa.RecordBatch.from_arrays(
                [null(pa.int64()), null(pa.list_(pa.int32())), pa.array(met.astype(np.int32)), null(pa.float64()), null(pa.list_(pa.float64())), null(pa.int32()), pa.array(sums[met].tolist(), pa.list_(pa.int64())), pa.array(n[met])], NAMES,
            )

    return rows.mapInArrow(run, STATE)


NAMES = [c.split()[0] for c in STATE.split(", ")]


def _changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, list[int]]:
    """What came to each cluster in a round, as sums by component and counts."""
    parts = state.where("sums is not null").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    sums, n = np.zeros((k, dim), object), [0] * k
    for r in parts.groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        sums[r["cluster"], r["i"]], n[r["cluster"]] = r["s"], r["n"]
    return sums, n


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r["vec"] for r in vectors.orderBy(order.asc_nulls_last(), "vec").limit(k).collect()], np.int64)


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, measured) of every vector that is kept, and the centroids. ``measured`` counts the
    distances of its last round."""
    spark = rows.sparkSession
    state = stored(integer_vectors(rows, vector, dim, scale), "yinyang-vectors")
    c = first_centroids(state, k)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, measured int"), c.reshape(0, dim)
    group, drift = grouped(c), np.zeros(len(c))
    sums, counts = np.zeros(c.shape, object), [0] * len(c)
    for r in range(rounds + 1):
        before, state = state, stored(_pass(state if r == 0 else state.where("vec is not null"), c, group, drift), "yinyang-state")
        dropped(before)
        if r < rounds:
            came, n = _changes(state, *c.shape)
            sums, counts = sums + came, [a + b for a, b in zip(counts, n, strict=True)]
            new = floor_means(sums.tolist(), counts, c)
            drift = np.sqrt(((new - c) ** 2).sum(axis=1).astype(np.float64))
            c = new
    return state.where("vec is not null").select("vec_id", "cluster", _distance(F.col("vec"), F.col("cluster"), c).alias("distance"), "measured"), c


def _distance(vec: Column, number: Column, c: np.ndarray) -> Column:
    at = F.get(F.from_json(F.lit(str(c.tolist())), "array<array<long>>"), number)
    return F.aggregate(F.zip_with(vec, at, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, c = cluster(documents(spark, sf_dir, "embeddings"))
    placed = stored(placed.select("vec_id", "cluster", "distance"), "yinyang-placed")
    total = lambda of: F.try_sum(F.col(of).cast("decimal(38,0)")).try_cast("long")
    per = placed.groupBy("cluster").agg(total("distance").alias("cluster_inertia"))
    every = placed.agg(total("distance").alias("inertia")).first()["inertia"]
    hashes = [(j, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for j, row in enumerate(c.tolist())]
    named = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    about = per.join(F.broadcast(named), "cluster")  # k rows
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(every).cast("long").alias("inertia"), "centroid_sha256")


def _sql() -> str:
    """Plain Lloyd rounds, unrolled."""
    near = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    parts = [
        f"v as materialized (select vec_id, row_number() over () id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) e from embeddings where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM})",
        f"c0 as materialized (select row_number() over (order by sha256('1:' || vec_id), e) - 1 k, e from v qualify k < {K})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} as materialized (select id, min(struct_pack(d := {near}, k := c.k)) b from v, c{r} c group by id)")
        if r < ROUNDS:
            parts.append(f"s{r} as (select b.k k, i, sum(e[i]) s, count(*) n from v join a{r} using (id), range(1, {DIM + 1}) t(i) group by 1, 2)")
            parts.append(f"c{r + 1} as materialized (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) e from s{r} group by k union all select k, e from c{r} where k not in (select k from s{r}))")
    return f"""with {", ".join(parts)}
select vec_id, b.k::int "cluster", b.d distance, sum(b.d) over (partition by b.k)::bigint cluster_inertia, sum(b.d) over ()::bigint inertia, sha256(array_to_string(c.e, ',')) centroid_sha256
from v join a{ROUNDS} using (id) join c{ROUNDS} c on c.k = b.k"""


SQL = {"op13_centroid_clusters": _sql()}
