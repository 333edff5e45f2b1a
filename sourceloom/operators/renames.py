"""Files that moved: removed and added files with the same or a similar text, matched one to one.

Similarity is the share of bytes in common lines, of the larger file.  Lines are ordered by how few
files have them; two files with at least half their bytes in common have a common line among
the rarest ones that make up half of each.  Only those lines are joined, so common lines
cost nothing and no pair is missed.

Files with the same text are compared once, by the first of them, and matched in runs: n copies on
either side take neither n * n comparisons nor n rounds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heapreplace
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.session import written

LEAST_PERCENT = 50
AT_ONCE = 500_000  # pairs that one task goes through in order; files of their texts, twice as many


def digests(files: DataFrame) -> DataFrame:
    """`files` with what matching needs of its column content (text), in its place: h, has_text and the lines, each as two hashes and its bytes.

    Nothing after this step moves a text.  A line counts its end, so an empty line has one byte.  Null contents count as empty.
    """
    content = F.coalesce("content", F.lit(""))
    lines = F.transform(
        F.split(content, "\n"), lambda t: F.struct(F.xxhash64(t).alias("line"), F.xxhash64(F.lit(1), t).alias("line2"), (F.octet_length(t) + 1).alias("bytes"))
    )
    kept = [c for c in files.columns if c != "content"]
    return files.select(*kept, F.sha2(content, 256).alias("h"), (content != "").alias("has_text"), lines.alias("lines"))


def _digested(files: DataFrame) -> DataFrame:
    return files if "lines" in files.columns else digests(files)


def line_bags(files: DataFrame) -> DataFrame:
    """(path, size, line, line2, bytes): each different line of a file, its bytes in all.

    `files` has path and lines (`digests`).
    """
    each = files.select("path", F.inline("lines")).groupBy("path", "line", "line2").agg(F.sum("bytes").cast("long").alias("bytes"))
    return each.withColumn("size", F.sum("bytes").over(Window.partitionBy("path")))


def _rarest(bags: DataFrame, frequency: DataFrame, percent: int) -> DataFrame:
    """The rarest lines of every file, as many as leave less than `percent` of its bytes to the others."""
    order = Window.partitionBy("path").orderBy("files", "line", "line2").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(order), F.lit(0))
    return bags.join(frequency, ["line", "line2"]).withColumn("before", before).filter((F.col("size") - F.col("before")) * 100 >= F.col("size") * percent)


def similar(removed: DataFrame, added: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """(old_path, path, common, larger) of all pairs with at least `percent` of the larger file's bytes in common lines; files as in `renames`."""
    old, new = written(line_bags(_digested(removed)), "lines-removed"), written(line_bags(_digested(added)), "lines-added")
    frequency = old.select("line", "line2").unionByName(new.select("line", "line2")).groupBy("line", "line2").agg(F.count(F.lit(1)).alias("files"))
    frequency = written(frequency, "line-frequency")
    of_old = _rarest(old, frequency, percent).select("line", "line2", F.col("path").alias("old_path"), F.col("size").alias("old_size"))
    of_new = _rarest(new, frequency, percent).select("line", "line2", "path", "size")
    near = (F.least("old_size", "size") * 100 >= F.greatest("old_size", "size") * percent)
    pairs = of_old.join(of_new, ["line", "line2"]).filter(near).select("old_path", "path", F.greatest("old_size", "size").alias("larger")).distinct()
    pairs = written(pairs, "rename-candidates")
    both = pairs.join(old.select(F.col("path").alias("old_path"), "line", "line2", F.col("bytes").alias("old_bytes")), "old_path")
    both = both.join(new.select("path", "line", "line2", "bytes"), ["path", "line", "line2"])
    scored = both.groupBy("old_path", "path", "larger").agg(F.sum(F.least("old_bytes", "bytes")).alias("common"))
    return scored.filter(F.col("common") * 100 >= F.col("larger") * percent).select("old_path", "path", "common", "larger")


def _each_alone(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(F.col(name).alias("text"), F.col(name).alias("file"), F.lit(1).alias("k")).distinct()


def _round(left: DataFrame, members: dict[str, DataFrame]) -> DataFrame:
    """(old, new, score, old_used, new_used, n): the pairs of texts that are the best one on both sides, and how many files of each go with them."""
    best = left
    for side, other in (("old", "new"), ("new", "old")):
        order = Window.partitionBy(side).orderBy(F.desc("score"), f"{other}_next")
        best = best.withColumn(f"{side}_rank", F.row_number().over(order))
        best = best.withColumn(f"{other}_end", F.when(F.lead("score").over(order) == F.col("score"), F.lead(f"{other}_next").over(order)))
    best = best.filter("old_rank = 1 and new_rank = 1").select("old", "new", "score", "old_used", "new_used", "old_end", "new_end")
    best = written(best, "rename-best")
    run = best
    for side, m in members.items():
        free = m.join(best.select(F.col(side).alias("text"), f"{side}_used", f"{side}_end").hint("merge"), "text")
        free = free.filter((F.col("k") > F.col(f"{side}_used")) & (F.col(f"{side}_end").isNull() | (F.col("file") < F.col(f"{side}_end"))))
        run = run.join(free.groupBy(F.col("text").alias(side)).agg(F.count(F.lit(1)).alias(f"{side}_free")).hint("merge"), side)
    run = run.select("old", "new", "score", "old_used", "new_used", F.least("old_free", "new_free").cast("int").alias("n"))
    return written(run, "renames")


def _walk(rows: Iterator[tuple], end: tuple | None) -> Iterator[tuple]:
    """(old, new, old_path, path, score, old_k, new_k) that going through pairs of files in order takes, up to the `end` (score, old_path).

    `rows` are ('pair', old, new, score) and the files of these texts that are still free, ('old' or 'new', text, file, k).
    """
    scores: dict = defaultdict(lambda: defaultdict(list))
    free: dict = {"old": defaultdict(list), "new": defaultdict(list)}
    for kind, text, other, n in rows:
        if kind == "pair":
            scores[n][text].append(other)
        else:
            free[kind][text].append((other, n))
    for files in (*free["old"].values(), *free["new"].values()):
        files.sort(reverse=True)  # the next one is the last
    old, new = free["old"], free["new"]
    for score in sorted(scores, reverse=True):
        queue = [(old[o][-1][0], o) for o in scores[score] if old[o]]
        nearest = {o: [(new[n][-1][0], n) for n in scores[score][o] if new[n]] for _, o in queue}
        for heap in (queue, *nearest.values()):
            heapify(heap)
        while queue:
            file, o = queue[0]
            if end is not None and (-score, file) >= (-end[0], end[1]):
                break
            heap = nearest[o]
            while heap and not (new[heap[0][1]] and new[heap[0][1]][-1][0] == heap[0][0]):
                # taken since: the next file of that text, if any
                n = heap[0][1]
                heapreplace(heap, (new[n][-1][0], n)) if new[n] else heappop(heap)
            if not heap:
                heappop(queue)
                continue
            n = heap[0][1]
            (old_file, old_k), (new_file, new_k) = old[o].pop(), new[n].pop()
            yield o, n, old_file, new_file, score, old_k, new_k
            heapreplace(queue, (old[o][-1][0], o)) if old[o] else heappop(queue)


def _in_order(left: DataFrame, members: dict[str, DataFrame], n: int) -> DataFrame | None:
    """(old, new, old_path, path, score, old_k, new_k): what the first AT_ONCE of `n` pairs of texts come to, gone through by one task.

    None if the first text alone has more pairs than that, or these texts more files.
    """
    end = None
    if n > AT_ONCE:
        first = written(left.orderBy(F.desc("score"), "old_next").limit(AT_ONCE), "rename-first")
        end = tuple(first.orderBy("score", F.desc("old_next")).select("score", "old_next").first())
        # pairs of the last text may have been left out
        left = first.filter((F.col("score") > end[0]) | (F.col("score") == end[0]) & (F.col("old_next") < F.lit(end[1])))
        if left.isEmpty():
            return None
        end = (end[0], end[1].encode())
    free = []
    for side, m in members.items():
        texts = left.select(F.col(side).alias("text"), F.col(f"{side}_used").alias("used")).distinct()
        free.append(m.join(texts.hint("merge"), "text").filter("k > used").select(F.lit(side).alias("kind"), "text", F.col("file").alias("other"), F.col("k").alias("n")))
    files = written(free[0].unionByName(free[1]), "rename-free")
    if files.count() > 2 * AT_ONCE:
        return None
    rows = left.select(F.lit("pair").alias("kind"), F.col("old").alias("text"), F.col("new").alias("other"), F.col("score").cast("int").alias("n")).unionByName(files)
    rows = rows.select("kind", F.col("text").cast("binary"), F.col("other").cast("binary"), "n")  # compared as Spark does, byte by byte
    names = ["old", "new", "old_path", "path"]

    def walk(batches):
        found = _walk((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), end)
        while some := list(islice(found, 10_000)):
            schema = pa.schema([*((x, pa.binary()) for x in names), *((x, pa.int32()) for x in ("score", "old_k", "new_k"))])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    taken = rows.repartition(1).mapInArrow(walk, ", ".join([f"{x} binary" for x in names] + ["score int", "old_k int", "new_k int"]))
    return written(taken.select(*[F.col(x).cast("string").alias(x) for x in names], "score", "old_k", "new_k"), "renames-in-order")


def one_to_one(pairs: DataFrame, old: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """(old_path, path, score) of `pairs` (the same columns): the best first, each path in one pair; ties by old_path, then path.

    A path in `pairs` stands for all files with its text: `old` and `new` have each of them (text: that path;
    file; k: its number among them by name, from 1), and are not needed if there is one only.

    Pairs that are the best one on both sides are taken in rounds, which gives what going through all of
    them in order would.  As many files of both texts follow at once as come before the first one of
    any other text that is as similar to either.  Rounds end where they no longer halve a large number of pairs,
    as in a group of files that are all alike, where a round takes few; from there on one task
    goes through AT_ONCE pairs in order at a time, so steps are bounded by the number of pairs.
    """
    members = {"old": old, "new": new}
    members = {side: written(_each_alone(pairs, n) if members[side] is None else members[side].select("text", "file", "k"), f"files-{side}") for side, n in (("old", "old_path"), ("new", "path"))}
    first = {side: m.filter("k = 1").select(F.col("text").alias(side), F.col("file").alias(f"{side}_next")) for side, m in members.items()}
    left = pairs.select(F.col("old_path").alias("old"), F.col("path").alias("new"), "score")
    for side, rows in first.items():
        left = left.join(rows.hint("merge"), side).withColumn(f"{side}_used", F.lit(0))
    left, runs, single, before = written(left, "rename-pairs"), [], [], None
    while n := left.count():
        halves = before is None or n > AT_ONCE and 2 * n <= before
        step, before = None if halves else _in_order(left, members, n), n
        if step is not None:
            single.append(step.select("old_path", "path", "score"))
            used = {side: step.groupBy(F.col(side).alias("text")).agg(F.max(f"{side}_k").alias("used")) for side in members}
        else:
            runs.append(run := _round(left, members))
            used = {side: run.select(F.col(side).alias("text"), (F.col(f"{side}_used") + F.col("n")).alias("used")) for side in members}
        for side, m in members.items():
            following = m.select("text", F.col("file").alias("next"), (F.col("k") - 1).alias("used"))
            after = used[side].join(following.hint("merge"), ["text", "used"], "left").select(F.col("text").alias(side), "used", "next", F.lit(True).alias("moved"))
            kept = F.col("moved").isNull()
            left = left.join(after.hint("merge"), side, "left").filter(kept | F.col("next").isNotNull())
            left = left.withColumn(f"{side}_used", F.coalesce("used", f"{side}_used")).withColumn(f"{side}_next", F.coalesce("next", f"{side}_next")).drop("used", "next", "moved")
        left = written(left, "rename-pairs")
    if not runs:
        return pairs.select("old_path", "path", "score")
    files = members["old"].select(F.col("text").alias("old"), F.col("file").alias("old_path"), "k")
    found = reduce(DataFrame.unionByName, runs).join(files.hint("merge"), "old").filter("k > old_used and k <= old_used + n").withColumn("k", F.col("k") - F.col("old_used") + F.col("new_used"))
    found = found.join(members["new"].select(F.col("text").alias("new"), F.col("file").alias("path"), "k").hint("merge"), ["new", "k"]).select("old_path", "path", "score")
    return reduce(DataFrame.unionByName, single, found)


def _copies(files: DataFrame) -> DataFrame:
    """(text, file, k): every file (path, h: digest) with the first path that has its text, and its number among those by path."""
    by_text = Window.partitionBy("h").orderBy("file")
    # a path that comes twice is one file of all its rows, as it is to `line_bags`
    rows = files.filter("path is not null").groupBy(F.col("path").alias("file")).agg(F.concat_ws("", F.array_sort(F.collect_list("h"))).alias("h"))
    return rows.select(F.first("file").over(by_text).alias("text"), "file", F.row_number().over(by_text).alias("k"))


def renames(removed: DataFrame, added: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """(status 'R', path, old_path, score) of files that moved, from (path, content) of removed and of added files, or their `digests` written before.

    Files with the same bytes are matched first, in the order of paths (score 100).  Of the others a pair is
    similar from `percent` on; score is the whole percentage.  Empty files only match empty ones.  Null contents count as empty.
    """

    def kept(files: DataFrame, name: str) -> DataFrame:
        return files if "lines" in files.columns else written(digests(files), name)

    def numbered(files: DataFrame, name: str) -> DataFrame:
        return files.select("h", F.col("path").alias(name), F.row_number().over(Window.partitionBy("h").orderBy("path")).alias("k"))

    of_old, of_new = kept(removed, "digests-removed"), kept(added, "digests-added")
    same = numbered(of_old, "old_path").join(numbered(of_new, "path"), ["h", "k"]).select("old_path", "path", F.lit(100).alias("score"))
    same = written(same, "renames-same")
    rest_old = of_old.filter("has_text").join(same.select(F.col("old_path").alias("path")), "path", "left_anti")
    rest_new = of_new.filter("has_text").join(same.select("path"), "path", "left_anti")
    old, new = written(_copies(rest_old), "copies-removed"), written(_copies(rest_new), "copies-added")
    # none of these is among the same
    one_old, one_new = (f.filter("has_text").join(c.filter("k = 1").select(F.col("file").alias("path")).hint("merge"), "path", "left_semi") for f, c in ((of_old, old), (of_new, new)))
    scored = similar(one_old, one_new, percent).select("old_path", "path", F.floor(F.col("common") * 100 / F.col("larger")).cast("int").alias("score"))
    return same.unionByName(one_to_one(scored, old, new)).select(F.lit("R").alias("status"), "path", "old_path", "score")


def with_renames(changes: DataFrame, found: DataFrame) -> DataFrame:
    """A change set (status, path, old_path) in which what `found` matched is renamed, not removed and added."""
    moved = found.select("status", "path", "old_path")
    rest = changes.filter("status <> 'D'").join(moved.select("path"), "path", "left_anti")
    gone = changes.filter("status = 'D'").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    return rest.unionByName(gone).select("status", "path", "old_path").unionByName(moved)
