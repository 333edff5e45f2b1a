"""Change sets and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGE_SCHEMA = "status string, path string, old_path string"


def changed_paths(changes: DataFrame) -> DataFrame:
    """Paths to parse again: added, modified, new names of renamed files."""
    return changes.filter("status in ('A', 'M', 'R')").select("path").distinct()


def removed_paths(changes: DataFrame) -> DataFrame:
    """Paths to drop: deleted, old names of renamed files."""
    gone = F.when(F.col("status") == "D", F.col("path")).when(F.col("status") == "R", F.col("old_path"))
    return changes.select(gone.alias("path")).filter("path is not null").distinct()


def compare_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) over two (path, content_hash) tables: one full outer join on the path."""
    o = old.select("path", F.col("content_hash").alias("old_hash"))
    n = new.select("path", F.col("content_hash").alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("modified")
    )
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def update_plan(cached: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, action, in_change_set): what an update does with every path.

    action: `parse` (new, or bytes differ from the cached), `reuse`, `remove`.
    in_change_set: the path is one that version control lists as changed, or is new.
    """
    listed = changed_paths(changes).withColumn("listed", F.lit(True))
    compared = compare_snapshots(cached, current).join(listed, "path", "left")
    action = (
        F.when(F.col("change") == "removed", "remove").when(F.col("change") == "unchanged", "reuse").otherwise("parse")
    )
    in_set = (F.coalesce("listed", F.lit(False)) | (F.col("change") == "added") | (F.col("change") == "modified")) & (
        F.col("change") != "removed"
    )
    return compared.select("path", action.alias("action"), in_set.alias("in_change_set"))


def merge_snapshot(cached: DataFrame, reparsed: DataFrame, plan: DataFrame) -> DataFrame:
    """Cached rows still valid, and the newly parsed."""
    kept = cached.join(plan.filter("action = 'reuse'").select("path"), "path", "left_semi")
    return kept.unionByName(reparsed)


def run_counters(plan: DataFrame) -> DataFrame:
    """One row: files scanned, parsed, removed and reused."""
    def count(condition):
        return F.count(F.when(condition, 1))

    present = F.col("action") != "remove"
    return plan.agg(
        count(present).alias("files_scanned"),
        count(F.col("in_change_set")).alias("files_parsed"),
        count(~present).alias("files_removed"),
        count(present & ~F.col("in_change_set")).alias("files_reused"),
    )
