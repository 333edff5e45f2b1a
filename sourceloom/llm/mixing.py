"""Mixing sources to target weights by Pareto order sampling.  DataFrame functions only.

Every source gets a target in words from its weight.  Inside a source a document is expected
in c * preference copies, at most `most`, where c makes the expected words the target.  The
whole part of that is certain.  For the rest, with inclusion probability p, a document draws a
uniform number u and ranks by u / (1 - u) divided by p / (1 - p); the smallest ranks are taken
until their words are what the target still lacks, so the sample has a fixed size in words.

No source is ever sorted as a whole: ranks fall into bins, words are summed up by bin, and
only the bin in which the target is reached is looked at document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import fresh
from sourceloom.session import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
MOST = 2  # copies of a document
BIN = 512  # documents to a bin, about
TOP_BITS = 12  # bins are summed up in two steps of at most 2 ** 12 each
DRAW_BITS = 52
SOURCE = ["none", "source"]  # names a source inside: whether it is null, and its name or ''; null comes last


def word_count(text: str = "text") -> Column:
    """Words between spaces, tabs and line ends; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def longer_first(size: str = "size") -> Column:
    """A preference that grows with length: the binary digits of the size."""
    return F.length(F.bin(size)).cast("long")


def draw(doc_id: str, source: str, size: str, seed: int = 0) -> Column:
    """52 pseudo-random bits that follow from the row's id, source and size."""
    text = F.concat_ws("/", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (doc_id, size, source)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")


def ranked(names: DataFrame) -> DataFrame:
    """`names` (SOURCE, distinct) with `place`, from 0 in the order of code points, null last.

    Ranges of names are numbered side by side; only the counts of ranges are summed up in one task.
    """
    parts = written(names.repartitionByRange(*SOURCE).withColumn("part", F.spark_partition_id()), "sources-by-name")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*SOURCE)) - 1
    return parts.withColumn("inside", inside).join(before, "part").select(*names.columns, (F.col("before") + F.col("inside")).cast("long").alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(none, source, source_size, target) from (none, source, source_size), one row each.

    `share` of all words goes to the sources by weight; where that is more than `most` times a
    source's size the target stops there and the excess goes to the others by weight, again until
    none is above.  Sums are of whole numbers, so reruns agree to the last bit.
    """
    named = ranked(sizes)
    weight = F.get(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("place") % len(weights)).cast("int"))
    named = written(named.select(*SOURCE, "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "source-weights")
    total, all_weights = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wanted = share * total
    level = wanted / all_weights if all_weights else 0.0
    while True:  # the level rises to where capped and level * weight make up all that is wanted
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, free = named.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if not free or (wanted - capped) / free <= level:
            break
        level = (wanted - capped) / free
    return named.select(*SOURCE, "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def expectations(classes: DataFrame, most: int = MOST) -> DataFrame:
    """`classes` (none, source, preference, words, target) with `copies`: what a document of the class is expected in.

    The larger preferences reach `most` first; c is found where the next one doesn't.
    """
    above = Window.partitionBy(*SOURCE).orderBy(F.col("preference").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(*SOURCE).orderBy(F.col("preference").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    each = classes.withColumn("full", F.coalesce(F.sum("words").over(above), F.lit(0)) * most).withColumn("rest", F.sum(F.col("words") * F.col("preference")).over(below))
    c = F.when(F.col("rest") > 0, (F.col("target") - F.col("full")) / F.col("rest")).otherwise(0.0)
    each = each.withColumn("c", c)
    right = F.max_by("c", F.when(F.col("c") * F.col("preference") <= most, F.col("preference"))).over(Window.partitionBy(*SOURCE))
    copies = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.coalesce(right, F.lit(float(most))) * F.col("preference")))
    return each.withColumn("copies", copies).drop("full", "rest", "c")


def _rank(number: Column, p: Column) -> Column:
    """From 0 to 1 and in the order of (u / (1 - u)) / (p / (1 - p)), where u is the drawn number."""
    u = (number + 0.5) / float(1 << DRAW_BITS)
    odd, even = u * (1 - p), (1 - u) * p
    return odd / (odd + even)


def _fine(z: Column, bits: Column) -> Column:
    return F.floor(z * F.pow(F.lit(2.0), bits)).cast("long")


def _first_fit(units: Column, room: Column) -> Column:
    """Of (z, draw, words) in order, the draws taken as long as their words fit into `room`."""
    start = F.struct(room.alias("room"), F.array().cast("array<bigint>").alias("taken"))

    def step(s, u):
        fits = u["words"] <= s["room"]
        return F.struct(F.when(fits, s["room"] - u["words"]).otherwise(s["room"]).alias("room"), F.when(fits, F.array_append(s["taken"], u["draw"])).otherwise(s["taken"]).alias("taken"))

    return F.aggregate(units, start, step)["taken"]


def _boundary(rows: DataFrame, by: str) -> DataFrame:
    """For each source the bin `by` in which `room` is used up, if there is one, and the room left at its beginning."""
    bins = rows.groupBy(*SOURCE, by).agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy(*SOURCE).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = bins.withColumn("before", before).filter("before <= room and room < before + words")
    return reached.select(*SOURCE, F.col(by).alias("bin"), (F.col("room") - F.col("before")).alias("left"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", prefer: Column | None = None,
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """`docs` with `source_size`, `target` and `copies`: how often the mix takes the row, from 0 to `most`.

    `size` holds the words of each row (a long, not negative; null counts as 0).  `weights` are whole numbers dealt
    in turns to the sources by name, null last.  `prefer`: positive whole numbers with few different values; a
    document's expected copies are in proportion to it; null counts as 1.  Nothing given: all alike.

    Rows without words have 0 copies.  Rows equal in id, source and size draw the same number and are taken
    alike.  An empty table gives none.  Columns of `docs` with the names of new ones are replaced.  Words taken
    from a source miss its target by less than the smallest document passed over in the last bin.
    """
    docs = docs.drop("source_size", "target", "copies")
    n, none, key, pref, number = (fresh(c, docs) for c in ("_size", "_none", "_source", "_prefer", "_draw"))
    rows = docs.withColumn(n, F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))).withColumn(none, F.col(source).isNull())
    rows = rows.withColumn(key, F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn(pref, F.lit(1).cast("long") if prefer is None else F.greatest(F.coalesce(prefer.cast("long"), F.lit(1)), F.lit(1)))
    rows = rows.withColumn(number, draw(doc_id, source, size, seed))
    plan = written(rows.select(F.col(n).alias("size"), F.col(none).alias("none"), F.col(key).alias("source"), F.col(pref).alias("preference"), F.col(number).alias("draw")), "mix-rows")

    classes = plan.groupBy(*SOURCE, "preference").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    classes = written(classes, "mix-classes")
    goal = written(targets(classes.groupBy(*SOURCE).agg(F.sum("words").alias("source_size")), weights, share, most), "mix-targets")
    expected = expectations(classes.join(goal, SOURCE), most).withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    of_source = Window.partitionBy(*SOURCE)
    room = F.floor(F.col("target") - F.sum(F.col("whole") * F.col("words")).over(of_source))
    many = F.sum(F.when(F.col("p") > 0, F.col("docs")).otherwise(0)).over(of_source)
    bits = F.least(F.lit(2 * TOP_BITS), F.length(F.bin(F.floor(many / BIN))) - 1)
    plans = expected.select(*SOURCE, "preference", "source_size", "target", "whole", "p", room.alias("room"), bits.cast("int").alias("bits"))
    plans = written(plans, "mix-plans")

    z = _rank(F.col("draw"), F.col("p"))
    fine = _fine(z, F.col("bits"))
    top = F.expr(f"shiftright(fine, greatest(bits - {TOP_BITS}, 0))")
    drawn = plan.filter("size > 0").join(plans, [*SOURCE, "preference"]).filter("p > 0").select(*SOURCE, "draw", "size", "room", z.alias("z"), fine.alias("fine"), F.col("bits"))
    drawn = written(drawn.withColumn("top", top), "mix-draws")
    coarse = written(_boundary(drawn, "top"), "mix-coarse")
    inside = drawn.drop("room").join(coarse.select(*SOURCE, F.col("bin").alias("top"), F.col("left").alias("room")), [*SOURCE, "top"])
    last = written(_boundary(inside, "fine"), "mix-fine")
    units = drawn.join(last.select(*SOURCE, F.col("bin").alias("fine"), "left"), [*SOURCE, "fine"])
    units = units.groupBy(*SOURCE, "draw").agg(F.sum("size").alias("words"), F.min("z").alias("z"), F.first("left").alias("left"))
    filled = units.groupBy(*SOURCE).agg(F.array_sort(F.collect_list(F.struct("z", "draw", "words"))).alias("units"), F.first("left").alias("left"))
    chosen = filled.select(*SOURCE, F.explode(_first_fit(F.col("units"), F.col("left"))).alias("draw"))
    # A class takes everything below the bin in which its source's room ends, and where there is room for all, all.
    end = fresh("_end", docs)
    ends = plans.join(last.select(*SOURCE, "bin"), SOURCE, "left")
    ends = ends.select(F.col("none").alias(none), F.col("source").alias(key), F.col("preference").alias(pref), F.struct("source_size", "target", "whole", "p", "bits", "room", "bin").alias(end))
    mark = fresh("_chosen", docs)
    chosen = chosen.select(F.col("none").alias(none), F.col("source").alias(key), F.col("draw").alias(number), F.lit(True).alias(mark))
    taken = rows.join(ends, [none, key, pref]).join(chosen, [none, key, number], "left")
    e = F.col(end)
    below = F.when(e["bin"].isNull(), e["room"] > 0).otherwise(_fine(_rank(F.col(number), e["p"]), e["bits"]) < e["bin"])
    more = F.when((e["p"] > 0) & (below | F.coalesce(mark, F.lit(False))), 1).otherwise(0)
    copies = F.when(F.col(n) > 0, e["whole"] + more).otherwise(0).cast("int")
    return taken.select(*(F.col(c) for c in docs.columns), e["source_size"].alias("source_size"), e["target"].alias("target"), copies.alias("copies"))
