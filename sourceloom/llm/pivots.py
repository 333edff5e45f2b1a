"""Near copies among vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order.  Inverted
lists hold the vectors of each (label, pivot); two vectors are candidates if they share at
least SHARED of their NEAREST pivots, and candidates are verified by their cosine in
double precision.  Pivots are ordered from the least used on: two vectors that share
SHARED pivots must meet in one of the first NEAREST - SHARED + 1 of that order, so the rest
is not posted, and a pair is taken only in the first list where it meets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.llm.common import block_pairs, components, local_roots
from sourceloom.session import written

COSINE = 0.93
SAMPLE, MAX_PIVOTS = 4096, 4096  # vectors from which pivots are chosen; bound of what is broadcast
LEAST_PIVOTS, ALIKE = 256, 0.7  # no two pivots are more alike than that
NEAREST, SHARED = 10, 2
BLOCK = 1024


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to `n` unit vectors of the sample, in its order, none too like an earlier one."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen: list[np.ndarray] = []
    for v in unit:
        if not chosen or np.max(np.stack(chosen) @ v) <= ALIKE:
            chosen.append(v)
            if len(chosen) == n:
                break
    return np.stack(chosen)


def nearest(vectors: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the `k` nearest pivots of each unit vector, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :k]


def _valid(vector: str):
    # Of doubles: the square of a finite float or double may be infinite, so finite numbers are asked for one by one.
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: finite(x.cast("double"))) & F.exists(v, lambda x: x != 0)


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers would leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links_in(table: pa.Table, cosine: float) -> pa.Table:
    """Links of one list (or two blocks of it): per vector the number it is linked to, and the head of its local tree."""
    empty = pa.table({"uid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "head": pa.array([], pa.int64())})
    uid, start = np.unique(table.column("uid").to_numpy(), return_index=True)
    table = table.take(pa.array(start))
    m = len(uid)
    if m < 2:
        return empty
    copies = table.column("copies").to_numpy()
    block, (a, b) = table.column("mine").to_numpy(), (table.column("block_a")[0].as_py(), table.column("block_b")[0].as_py())
    near, rank = table.column("near").to_pylist(), table.column("pivot_rank")[0].as_py()
    prefix, units = table.column("posted").to_pylist(), _units(table.column("vector"))
    width = max(max(x) for x in near) + 1
    share, before = np.zeros((m, width), np.float32), np.zeros((m, max(rank, 1)), np.float32)
    for i, (ranks, posted) in enumerate(zip(near, prefix)):
        share[i, ranks] = 1
        before[i, [r for r in posted if r < rank]] = 1
    least = min(SHARED, min(len(x) for x in near))
    linked = np.zeros((m, m), bool)
    for k in range(0, m, 128):
        candidates = (share[k : k + 128] @ share.T >= least) & (before[k : k + 128] @ before.T == 0)
        if a != b:
            candidates &= block[k : k + 128, None] != block[None]
        if candidates.any():
            linked[k : k + 128] = candidates & (units[k : k + 128] @ units.T >= cosine)
    np.fill_diagonal(linked, False)
    linked |= linked.T
    found = linked.any(axis=1)
    root = local_roots(linked)
    return pa.table({"uid": uid[found], "links": (linked[found] @ copies).astype(np.int64), "head": uid[root[found]]})


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `df`.

    Vectors with equal labels are linked if their cosine is `cosine` or more.  n_links:
    other rows linked directly; component_id: the smallest id reachable, the own one included
    (null ids are passed over); kept: whether it is the own id.  Rows whose label is null or whose
    vector is null, empty, zero or has null or non-finite parts link with nothing, and vectors of
    different length never do.  Equal vectors of a label are one point with a number of copies:
    they count as links and share the component without being paired.
    """
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"), F.xxhash64(label, vector).alias("k1"), F.xxhash64(F.lit(1), F.col(label), F.col(vector)).alias("k2"))
    usable = F.col("label").isNotNull() & _valid("vector")
    points = rows.filter(usable).groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    points = written(points.withColumn("uid", F.monotonically_increasing_id()), "points")  # written, so numbers stay
    described = _describe(points)
    uses = {r["pivot"]: r["n"] for r in described.select(F.explode("near").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per pivot
    order = sorted(uses, key=lambda p: (uses[p], p))
    rank_of = {p: r for r, p in enumerate(order)}
    posted = _post(described, rank_of)
    dealt = block_pairs(posted, ["label", "dim", "pivot_rank"], "uid", BLOCK, keep_block="mine")
    found = dealt.groupBy("label", "dim", "pivot_rank", "block_a", "block_b").applyInArrow(lambda t: _links_in(t, cosine), "uid long, links long, head long")
    found = written(found, "vector-links")
    roots = components(found.filter("uid != head").select("uid", "head"), "uid", "head")
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    point = points.select("uid", "k1", "k2", "least", "copies").join(roots, points["uid"] == roots["node"], "left").join(counts, "uid", "left")
    point = point.select("k1", "k2", "least", F.coalesce("root", "uid").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = point.groupBy("root").agg(F.min("least").alias("component_id"))
    point = point.join(least, "root").select("k1", "k2", "n_links", "component_id")
    joined = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).drop("vector", "label").join(point, ["k1", "k2"], "left")
    alone = ~F.col("usable") | F.col("component_id").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(vec_id), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )


def _describe(points: DataFrame) -> DataFrame:
    """Points with `near`: the numbers of their nearest pivots; written.

    Pivots come from SAMPLE points (those with the smallest keys, so they don't depend on
    the order of rows); their number grows with the square root of the points, from
    LEAST_PIVOTS to MAX_PIVOTS, which keeps lists short.
    """
    spark = points.sparkSession
    count = points.count()
    n = min(MAX_PIVOTS, max(LEAST_PIVOTS, int(count**0.5)))
    # Keys are hashes, so about 2 * SAMPLE lie below this one; without it every task would send the driver SAMPLE points.
    below = min((1 << 63) - 1, (2 * SAMPLE << 64) // max(1, count) - (1 << 63))
    sample = points.filter(F.col("k1") <= below).orderBy("k1", "k2").limit(SAMPLE).select("vector").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["vector"]), []).append(r["vector"])
    pivots = spark.sparkContext.broadcast({d: choose_pivots(_units(pa.array(v)), n) for d, v in by_dim.items()})

    def run(batches):
        for batch in batches:
            vectors, near = batch.column("vector"), [None] * batch.num_rows
            dims = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                mine = np.nonzero(dims == d)[0]
                some = pivots.value.get(int(d))
                told = nearest(_units(vectors.take(pa.array(mine))), some, NEAREST).tolist() if some is not None else [[0]] * len(mine)
                for i, ranks in zip(mine, told):
                    near[i] = ranks
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("label"), vectors, batch.column("copies"), pa.array(near, pa.list_(pa.int32()))], names=["uid", "label", "vector", "copies", "near"])

    source = points.select("uid", "label", "vector", "copies")
    return written(source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])), "described")


def _post(described: DataFrame, rank_of: dict[int, int]) -> DataFrame:
    """One row for each list a vector is posted in; `near` as ranks, the least used pivot first."""
    ranks = F.array(*(F.lit(rank_of.get(p, 0)) for p in range(max(rank_of, default=0) + 1)))
    near = described.withColumn("near", F.array_sort(F.transform("near", lambda p: F.get(ranks, p))))
    near = near.withColumn("dim", F.size("vector")).withColumn("posted", F.slice("near", F.lit(1), F.greatest(F.size("near") - (SHARED - 1), F.lit(1))))
    return near.withColumn("pivot_rank", F.explode("posted"))
