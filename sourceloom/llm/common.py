"""What several operators share: row keys, text functions in tasks, pairs in blocks, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.session import written

SLICE_BYTES = 2 << 20  # text that a task holds as Python objects at a time (one longer text is taken whole)
BATCH_BYTES = 4 << 20  # of an Arrow batch on its way to Python, unless the session sets a limit; buffers double as they fill


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, with as many underscores before it as keep it apart from all columns of `frames`."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc32_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """128 bits that stand for (id, text).  Never null; rows that repeat both share it.

    The hash passes over nulls, so which of the two are null is hashed as well.
    """
    nulls = F.col(doc_id).isNull().cast("int") + F.col(text).isNull().cast("int") * 2
    return F.xxhash64(nulls, doc_id, text), F.xxhash64(nulls + 4, doc_id, text)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.coalesce(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _bound_batches(df: DataFrame) -> None:
    """Spark limits Arrow batches by rows alone; long texts need a limit in bytes as well.  One set by the user stays."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))


def with_columns_from(df: DataFrame, column: str, fields: list[T.StructField], maker: Callable) -> DataFrame:
    """`df` with new columns computed from the texts of `column` in Arrow batches.

    `maker()` is called once per task and gives a function from a list of texts
    (None where null) to one list or Arrow array per field.  A column of `df` that
    has the name of a new one is replaced.
    """
    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    text = fresh("_text", df)
    schema = T.StructType([f for f in df.schema.fields if f.name not in new] + fields)
    kinds = [_arrow(f.dataType) for f in fields]
    _bound_batches(df)

    def run(batches):
        apply = maker()
        for batch in batches:
            for part in _slices(batch, text):
                values = [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(apply(part.column(text).to_pylist()), kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *values], names=schema.names)

    return df.select(*keep, F.col(column).alias(text)).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# -- pairs inside large groups ---------------------------------------------------------------------------------


def block_pairs(rows: DataFrame, key: list[str], uid: str, size: int, keep_block: str = "_mine") -> DataFrame:
    """`rows` dealt so that any two rows of one `key` meet in a group (`key`, block_a, block_b) of bounded size.

    Groups of a key are counted first (with map-side sums); a key with more than
    `size` rows is split into blocks, and each row goes to all pairs of its block with
    another one.  What one task holds is about 2 * `size` rows however large a key is.
    The own block is in column `keep_block`.
    """
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(size)).cast("int")
    mine = F.pmod(F.xxhash64(F.col(uid), F.lit(7)), F.col("_blocks")).cast("int")
    dealt = rows.join(counts, key).withColumn("_blocks", blocks).withColumn(keep_block, mine)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("block_a", F.least(keep_block, "_other")).withColumn("block_b", F.greatest(keep_block, "_other"))
    return dealt.drop("_n", "_blocks", "_other")


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For a square matrix of links: the first member of each one's component.  Each row is read once."""
    root = np.full(len(linked), -1)
    for first in range(len(linked)):
        if root[first] >= 0:
            continue
        root[first] = first
        reached = np.array([first])
        while reached.size:
            found = linked[reached].any(axis=0) & (root < 0)
            root[found] = first
            reached = np.nonzero(found)[0]
    return root


# -- connected components ---------------------------------------------------------------------------------------


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of `links` but the roots; root is the smallest node that can be reached.

    Alternates two rules until nothing changes: all larger neighbours of a node are
    tied to the smallest node around it, then all smaller ones.  Links are only ever
    replaced by as many or fewer, in a number of rounds logarithmic in the size of a
    component.  Minima are summed up before shuffling; the joins are plain inner
    joins of which adaptive execution splits the partition of a much-linked node.
    Each round is written to the shared folder, so a lost executor repeats one round.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    edges = written(links.select(high.alias("u"), low.alias("v")).filter("u > v").distinct(), "links")
    seen = _state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(least, "v").select("u", F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "links")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of a set of links."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
