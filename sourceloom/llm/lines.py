"""Line dedup by overlapping windows, and what it shares with span dedup.

Every run of three consecutive lines is a window.  A window that occurs more than once
is kept where it occurs first; the lines of all later occurrences are covered, covered
stretches that overlap are merged, and what they cover is taken out.  DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import fresh, row_key
from sourceloom.session import written

WINDOW = 3


def later_runs(runs: DataFrame) -> DataFrame:
    """For each (key1, key2) the merged stretches covered by runs that are not the first of their kind.

    `runs` has id, key1, key2, begin, end, h1, h2 (128 bits that stand for the run's content), and
    ends don't fall as begins rise.  First: by (id, key1, key2, begin), null ids last.  Result: `stretches`,
    disjoint (begin, end) in order, where the next begins behind the end of the one before.

    How often a content occurs is summed up before the shuffle.  Contents that occur once meet
    nothing in the join; of one that occurs in a third of all documents the join's partition is
    split by adaptive execution, since its other side has one row per content.
    """
    runs = written(runs, "runs")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key1", "key2", "begin")
    repeated = runs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").select("h1", "h2", "first")
    return stretches(runs.join(repeated, ["h1", "h2"]).filter(place != F.col("first")))


def stretches(later: DataFrame) -> DataFrame:
    """(key1, key2, stretches) of runs (key1, key2, begin, end) whose ends don't fall as begins rise."""
    later = later.select("key1", "key2", "begin", "end")
    by_doc = later.groupBy("key1", "key2").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("r"))
    return by_doc.select("key1", "key2", merged(F.col("r")).alias("stretches"))


def merged(runs: Column) -> Column:
    """Union of sorted runs whose ends don't fall: where a run begins behind the end of the one before, a stretch begins."""
    n = F.size(runs)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(runs, i)["begin"] > F.get(runs, i - 1)["end"]))
    last = F.concat(F.transform(F.slice(starts, F.lit(2), F.size(starts)), lambda i: i - 1), F.array(n - 1))
    return F.zip_with(starts, last, lambda a, b: F.struct(F.get(runs, a)["begin"].alias("begin"), F.get(runs, b)["end"].alias("end")))


def outside(items: Column, stretches: Column) -> Column:
    """The items of an array that lie in no stretch, in order."""
    n = F.size(stretches)
    gaps = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get(stretches, i - 1)["end"]).alias("a"),
            F.when(i == n, F.size(items)).otherwise(F.get(stretches, i)["begin"]).alias("b"),
        ),
    )
    return F.flatten(F.transform(gaps, lambda g: F.slice(items, g["a"] + 1, g["b"] - g["a"])))


def line_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every window of `window` consecutive lines, as the runs of `later_runs`; windows of blank lines only are left out."""
    k1, k2 = row_key(doc_id, text)
    lines = docs.select(F.col(doc_id).alias("id"), k1.alias("key1"), k2.alias("key2"), F.split(text, "\n").alias("lines"))
    hashed = lines.filter(F.size("lines") >= window).select(
        "id", "key1", "key2",
        F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.trim(x) != "").alias("full"))).alias("l"),
    )

    def of(i):
        some = [F.get(F.col("l"), i + k) for k in range(window)]
        full = some[0]["full"]
        for x in some[1:]:
            full = full | x["full"]
        return F.struct(i.alias("begin"), F.xxhash64(*(x["a"] for x in some)).alias("h1"), F.xxhash64(*(x["b"] for x in some)).alias("h2"), full.alias("full"))

    every = hashed.select("id", "key1", "key2", F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - window), of)).alias("w"))
    return every.filter("w.full").select("id", "key1", "key2", "w.begin", (F.col("w.begin") + window).alias("end"), "w.h1", "w.h2")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, removed: str = "n_removed") -> DataFrame:
    """`docs` with `text` less the lines of repeated windows, and `removed`: how many those are.

    Lines are the parts between newlines and compared exactly; texts of fewer lines than a
    window, null and empty ones stay as they are.  A text may become empty; its row stays.
    Rows that repeat both id and text are one document: all of them keep the same lines.
    Of equal windows the first by (id, place) stays, null ids last.  A column `removed` of `docs` is replaced.
    """
    docs = docs.drop(removed)
    a, b, cut = fresh("_k1", docs), fresh("_k2", docs), fresh("_stretches", docs)
    k1, k2 = row_key(doc_id, text)
    covered = later_runs(line_windows(docs, doc_id, text, window)).select(F.col("key1").alias(a), F.col("key2").alias(b), F.col("stretches").alias(cut))
    joined = docs.withColumn(a, k1).withColumn(b, k2).join(covered, [a, b], "left")
    rest = F.array_join(outside(F.split(text, "\n"), F.col(cut)), "\n")
    count = F.aggregate(F.coalesce(F.col(cut), F.array().cast("array<struct<begin:int,end:int>>")), F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    out = [F.when(F.col(cut).isNull(), F.col(c)).otherwise(rest).alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*out, count.alias(removed))
