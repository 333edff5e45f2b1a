"""Choosing what fits a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.operators.skew import in_pieces

_NO_LIMIT = 1 << 40


def running_cost(df: DataFrame, group: list[str], order: list[Column], cost: str, budget: int,
                 max_count: int | None = None, least_cost: int = 0) -> DataFrame:
    """The rows of every group that can be kept, with `rank` and running `used` cost.

    Each hash piece of a group is first cut where its own running cost exceeds `budget` (or
    its own rank `max_count`): such a row is beyond it within its group as well, so what meets
    in one task depends on the budget and not on the group.  The first row of a group is never
    cut.  Costs must not be NULL or below `least_cost`; a row that has such a cost raises an error.
    """
    checked = F.when(F.col(cost) >= least_cost, F.col(cost)).otherwise(F.raise_error(F.lit(f"{cost} is NULL or below {least_cost}")).cast(df.schema[cost].dataType))
    pieces = in_pieces(df.withColumn(cost, checked), group)
    window = Window.partitionBy(*group, "_piece").orderBy(*order)
    used = F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, 0))
    cut = pieces.withColumn("rank", F.row_number().over(window)).withColumn("used", used)
    cut = cut.filter((F.col("used") <= budget) | (F.col("rank") == 1))
    cut = cut if max_count is None else cut.filter(F.col("rank") <= max_count)
    window = Window.partitionBy(*group).orderBy(*order)
    rows = cut.drop("_piece", "rank", "used").withColumn("rank", F.row_number().over(window))
    return rows.withColumn("used", F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def fit_to_budget(df: DataFrame, group: list[str], order: list[Column], cost: str, budget: int, force_first: bool = True) -> DataFrame:
    """Longest prefix of every group whose cost (0 or more) fits; the first row always, if forced."""
    costed = running_cost(df, group, order, cost, budget)
    fits = F.col("used") <= budget
    return costed.filter(fits | (F.col("rank") == 1) if force_first else fits)


def group_quotas(costed: DataFrame, group: str, labels: list, budget: int, max_count: int | None = None) -> DataFrame:
    """How many rows of each group to keep: (group, n_kept), one row per non-empty group.

    Groups share `budget` (and `max_count`) evenly; what one does not use is
    passed on to the next in the order of `labels`.  Each keeps at least one
    row.  `costed` comes from `running_cost`: per group an array of running
    costs of bounded length, folded over the groups in one row.
    """
    spark = costed.sparkSession
    order = spark.createDataFrame(list(enumerate(labels)), f"group_ord int, {group} string")
    runs = (
        costed.groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("used").cast("bigint").alias("used")))).alias("runs"))
        .join(F.broadcast(order), group)
    )
    every = runs.agg(F.array_sort(F.collect_list(F.struct("group_ord", F.col(group).alias("label"), "runs"))).alias("groups"))
    n = F.size("groups").cast("bigint")
    share = F.greatest(F.lit(budget).cast("bigint") - F.pmod(F.lit(budget).cast("bigint"), n), F.lit(0).cast("bigint"))
    share = F.greatest((share / n).cast("bigint"), F.lit(1).cast("bigint"))
    count = F.lit(_NO_LIMIT if max_count is None else max_count).cast("bigint")
    count_share = F.greatest(((count - F.pmod(count, n)) / n).cast("bigint"), F.lit(1).cast("bigint"))

    state = "struct<chars:bigint,count:bigint,kept:array<struct<label:string,n_kept:bigint>>>"
    zero = F.struct(
        F.lit(0).cast("bigint").alias("chars"), F.lit(0).cast("bigint").alias("count"),
        F.array().cast("array<struct<label:string,n_kept:bigint>>").alias("kept"),
    ).cast(state)

    def fold(left, g):
        chars, limit = share + left["chars"], count_share + left["count"]
        fitting = F.filter(
            g["runs"],
            lambda r: ((r["rank"] == 1) | (r["used"] <= chars)) & (r["rank"] <= limit),
        )
        n_kept = F.size(fitting).cast("bigint")
        used = F.coalesce(F.try_element_at(fitting, F.lit(-1))["used"], F.lit(0))
        none = F.lit(0).cast("bigint")
        return F.struct(
            F.greatest(chars - used, none).alias("chars"),
            F.greatest(limit - n_kept, none).alias("count"),
            F.array_append(left["kept"], F.struct(g["label"].alias("label"), n_kept.alias("n_kept"))).alias("kept"),
        ).cast(state)

    folded = every.filter(n > 0).select(F.aggregate("groups", zero, fold)["kept"].alias("kept"))
    return folded.select(F.inline("kept")).withColumnRenamed("label", group)


def select_with_coverage(df: DataFrame, group: str, labels: list, order: list[Column], cost: str, budget: int,
                         max_count: int | None = None) -> DataFrame:
    """Rows kept under a shared budget such that no group is left out, with their `rank` in the group.

    Costs are 1 or more, so at most as many rows of a group as the budget counts can be kept.
    """
    most = None if max_count is None else max(max_count, len(labels))
    costed = running_cost(df, [group], order, cost, max(budget, len(labels)), most, least_cost=1)
    quotas = group_quotas(costed, group, labels, budget, max_count)
    return costed.join(F.broadcast(quotas), group).filter(F.col("rank") <= F.col("n_kept")).drop("n_kept")
