"""Joins and group-wise limits that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEY_BUCKETS, HOT_KEYS_PER_BUCKET = 64, 4
MAX_HOT_KEYS = HOT_KEY_BUCKETS * HOT_KEYS_PER_BUCKET  # bound of any hot side broadcast
HOT_ROWS = 1_000_000  # a key below this many rows fits one task
NATIVE_GROUP_LIMIT = 1_000  # row_number() <= k up to here is cut before the shuffle by Spark itself
SPREAD = 64


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> list:
    """At most MAX_HOT_KEYS keys of `df` with at least `min_rows` rows.

    One pass with frequent-items sketches, one per bucket of keys so that their
    merging is spread as well; what leaves a task does not grow with its rows.
    A key missed or named in error costs time only, never a row.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(HOT_KEY_BUCKETS)).alias("bucket")
    top = df.groupBy(bucket).agg(F.expr(f"approx_top_k({key}, {HOT_KEYS_PER_BUCKET}, {HOT_KEYS_PER_BUCKET * 16})").alias("top"))
    return [r["item"] for r in top.select(F.inline("top")).filter((F.col("count") >= min_rows) & F.col("item").isNotNull()).collect()]


def _merged(left: DataFrame, right: DataFrame, key: str, on: list[str], how: str) -> DataFrame:
    """The join by shuffle and sort.  What it sorts by is a hash, as names and paths differ only after long common beginnings."""
    if {df.schema[key].dataType.simpleString() for df in (left, right)} != {"string"}:
        return left.join(right.hint("merge"), on, how)
    left, right = (df.withColumn("_key_hash", F.xxhash64(key)) for df in (left, right))
    return left.join(right.hint("merge"), ["_key_hash", *on], how).drop("_key_hash")


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None, where: Column | None = None, beside: tuple[str, ...] = ()
) -> DataFrame:
    """`left` joined to `right`, which has one row per `key`, or per `key` and the columns `beside` it, if `key` is a hash of those.

    Hot keys meet their right rows (at most one each, so at most
    MAX_HOT_KEYS rows) by broadcast where they lie; all others are shuffled.
    Both sides grow with the tree, and a written table takes a small part of the room its
    rows take in memory, so no side is left to be broadcast by the size of its files.
    `where`, if given, holds for all rows of `left` with a hot key; it spares the others what comes before the key.
    """
    on = [key, *beside]
    if not hot:
        return _merged(left, right, key, on, how)
    is_hot = F.col(key).isin(*hot)
    apart = left.filter(is_hot if where is None else where & is_hot).join(F.broadcast(right.filter(is_hot)), on, how)
    rest = _merged(left.filter(~is_hot | F.col(key).isNull()), right, key, on, how)
    return rest.unionByName(apart)


def in_pieces(df: DataFrame, group: list[str]) -> DataFrame:
    """`df` with a `_piece` that spreads every group over as many tasks as a shuffle has."""
    pieces = max(SPREAD, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rest = [c for c in df.columns if c not in group]
    return df.withColumn("_piece", F.pmod(F.xxhash64(*rest), F.lit(pieces)))


def first_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows of every group, numbered from 1 in `rank`.

    `k` bounds what one task sees of a group: up to NATIVE_GROUP_LIMIT Spark cuts
    each group before the shuffle; above it, groups are cut piece by piece first.
    """
    number = F.row_number()
    if k > NATIVE_GROUP_LIMIT:
        df = in_pieces(df, group)
        window = Window.partitionBy(*group, "_piece").orderBy(*order)
        df = df.withColumn(rank, number.over(window)).filter(F.col(rank) <= k).drop("_piece", rank)
    return df.withColumn(rank, number.over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)
