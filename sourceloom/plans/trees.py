"""Snapshots as trees of folders: comparing two of them reads only what lies under folders that differ.

Every folder down to a depth has a digest of all files below it, a sum over them, so that
an edit is subtracted and added.  Digests are bucketed by their parent and files by their
folder: a level of the comparison reads the children of folders that differ at the
level above, and the files of a bucket without such a folder are never opened.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.operators.changes import compare_snapshots
from sourceloom.session import written
from sourceloom.sources.buckets import BucketTable, touched

DEPTH = 4  # folders below the root that have digests; files further down count to their ancestor there
SUMS = ["n_files", "h1", "h2", "h3", "h4"]
FOLDER = ["level", "parent", "folder"]


def _at(level: Column) -> Column:
    return F.array_join(F.slice(F.col("_parts"), F.lit(1), F.greatest(level, F.lit(0))), "/")


def _with_parts(files: DataFrame, depth: int) -> DataFrame:
    parts = files.filter("path is not null").withColumn("_parts", F.split("path", "/"))
    return parts.withColumn("_deepest", F.least(F.size("_parts") - 1, F.lit(depth)))


def placed(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """`files` with level and folder: the deepest folder with a digest that they lie in.  Rows without a path are left out."""
    rows = _with_parts(files, depth).withColumn("level", F.col("_deepest")).withColumn("folder", _at(F.col("_deepest")))
    return rows.drop("_parts", "_deepest")


def folder_digests(files: DataFrame, depth: int = DEPTH, sign: int = 1) -> DataFrame:
    """(level, parent, folder, n_files, h1 to h4) for all folders of (path, content_hash) rows down to `depth`.

    The root is level 0.  Each h is a sum of 32-bit pieces of two hashes, made before anything
    is shuffled; it has room for 2^31 files.
    """
    rows = _with_parts(files, depth)
    for k in (0, 1):
        one = F.xxhash64(F.lit(k), "path", "content_hash")
        rows = rows.withColumn(f"h{2 * k + 1}", one.bitwiseAND(F.lit(0xFFFFFFFF))).withColumn(f"h{2 * k + 2}", F.shiftrightunsigned(one, 32))
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_deepest"))))
    rows = rows.select("level", _at(F.col("level") - 1).alias("parent"), _at(F.col("level")).alias("folder"), F.lit(1).cast("long").alias("n_files"), *SUMS[1:])
    return rows.groupBy(*FOLDER).agg(*((F.sum(c) * sign).alias(c) for c in SUMS))


@dataclass(frozen=True)
class SnapshotTree:
    """A snapshot with its folders' digests.  Never changed: an edit gives another one, which shares the untouched buckets."""

    depth: int
    files: BucketTable  # path, content_hash, level, folder
    folders: BucketTable  # level, parent, folder, n_files, h1 to h4

    @classmethod
    def build(cls, snapshot: DataFrame, location: str, depth: int = DEPTH) -> SnapshotTree:
        """The tree of a snapshot (path, content_hash), one row for each path, with its tables in `location`.

        Rows without a path or a hash are no files.
        """
        rows = snapshot.select("path", "content_hash").filter("content_hash is not null")
        files = BucketTable.build(placed(rows, depth), location, "tree-files", "folder")
        return cls(depth, files, BucketTable.build(folder_digests(files.rows(), depth), location, "tree-folders", "parent"))

    def edited(self, removed: DataFrame, put: DataFrame) -> SnapshotTree:
        """The tree without the paths `removed` and with the rows `put` (path, content_hash), new or instead of earlier ones.

        Reads and writes the buckets that these paths lie in.  A removed path that isn't there changes nothing; one that is
        also put stays, as put.
        """
        put = written(placed(put.select("path", "content_hash").filter("content_hash is not null"), self.depth), "tree-put")
        paths = placed(removed.select("path"), self.depth).unionByName(put.drop("content_hash")).distinct()
        paths = written(paths, "tree-paths")
        buckets = touched(paths, "folder")
        before = self.files.rows(buckets)
        gone = before.join(paths.select("path"), "path", "left_semi")
        delta = folder_digests(gone, self.depth, -1).unionByName(folder_digests(put, self.depth))
        delta = written(delta.groupBy(*FOLDER).agg(*(F.sum(c).alias(c) for c in SUMS)), "tree-delta")
        above = touched(delta, "parent")
        summed = self.folders.rows(above).unionByName(delta).groupBy(*FOLDER).agg(*(F.sum(c).alias(c) for c in SUMS))
        kept = before.join(paths.select("path"), "path", "left_anti").unionByName(put)
        return replace(self, files=self.files.replaced(buckets, kept), folders=self.folders.replaced(above, summed.filter("n_files > 0")))


def changed_folders(old: SnapshotTree, new: SnapshotTree) -> DataFrame:
    """(level, folder, change, old_files, new_files) of folders below which a file differs; change: added, removed, modified.

    One small job a level, down to the last on which anything differs.  A folder is looked at only where its parent differs.
    """
    if old.depth != new.depth:
        raise ValueError(f"trees of depth {old.depth} and {new.depth} can't be compared")
    found, parents = None, None
    for level in range(old.depth + 1):
        if parents is None:
            parents = old.folders.spark.range(1).select(F.lit("").alias("parent"))
        o, n = (t.folders.of(parents).filter(F.col("level") == level) for t in (old, new))
        o, n = (t.select(*FOLDER, *(F.col(c).alias(f"{side}_{c}") for c in SUMS)) for side, t in (("old", o), ("new", n)))
        same = [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in SUMS]
        differ = o.join(n, FOLDER, "full_outer").filter(~(same[0] & same[1] & same[2] & same[3] & same[4]))
        change = F.when(F.col("old_n_files").isNull(), "added").when(F.col("new_n_files").isNull(), "removed").otherwise("modified")
        counts = [F.coalesce(f"{side}_n_files", F.lit(0)).alias(f"{side}_files") for side in ("old", "new")]
        here = written(differ.select("level", "folder", change.alias("change"), *counts), "tree-differs")
        found = here if found is None else found.unionByName(here)
        if here.isEmpty():
            break
        parents = here.select(F.col("folder").alias("parent")).distinct()
    return found


def changed_files(old: SnapshotTree, new: SnapshotTree) -> DataFrame:
    """(path, change) as `compare_snapshots` gives, but for unchanged files, most of which are never read."""
    folders = changed_folders(old, new).select("level", "folder")
    o, n = (t.files.of(folders).join(folders, ["level", "folder"], "left_semi") for t in (old, new))
    return compare_snapshots(o, n).filter("change <> 'unchanged'")
