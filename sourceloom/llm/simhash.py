"""Near copies by SimHash, found by pigeonring filtering.

The 64 bits lie in a ring of five segments.  If two fingerprints differ in at most 4
bits, then from some segment on every chain of 1, 2, 3, 4, 5 consecutive segments
differs in at most 4/5 of a bit for each of its segments: 0, 1, 2, 3, 4 bits.  The first
two budgets (an equal segment, then one with at most one other bit) make an equality join:
every fingerprint is posted under its five segment pairs and asks for each pair and the
pairs one bit away in the second segment.  The other chains and the whole distance are
conditions of that join.  A pair's key has 25 or 26 bits, so partners per key stay few until
fingerprints run into hundreds of millions; then widen FIRST chains, not the budgets.

Four bits of 64 miss most texts of a shingle similarity of 0.8, which lie 5 to 13 bits apart,
and with budgets for 13 bits a segment selects nothing.  `near_duplicates(similarity=...)`
therefore also searches a ring whose places are not bits but whole numbers: 60 smallest
hashes of the distinct shingles, each of which two texts share with the probability of their
Jaccard similarity.  Of its 20 segments of three places one is equal wherever at most 19 places
differ, and then some start keeps all chains within 0, 1, 2, ... places.  Texts that share a
segment meet in memory, where the last chain, the whole ring, is counted at once; then the
shingles themselves decide.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.llm.common import block_pairs, components, fresh, local_roots, row_key, with_columns_from
from sourceloom.session import written

SHINGLE, SEED, DISTANCE = 4, 42, 4
WIDTHS = (13, 13, 13, 13, 12)
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
RING, SEGMENT = 20, 3  # segments and their places in the ring of smallest hashes; RING - 1 places may differ
SKETCH = 1024  # smallest shingle hashes kept of a text; the similarity of texts with no more distinct shingles is exact
SIMILAR_BLOCK = 512
HOT_KEY = 64  # fingerprints under one key; beyond that they are compared in blocks
BLOCK = 1024
STEP = 1 << 16  # shingles hashed at a time

_N = len(WIDTHS)
_FROM = [sum(WIDTHS[:i]) for i in range(_N)]
_BUDGET = [DISTANCE * n // _N for n in range(1, _N + 1)]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits, signed: each is set if it is in more than half of the hashes of all word shingles, repeats included.

    Fewer words than `size` are one shingle; no words give 0.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    total, ones = 0, np.zeros(64, np.int64)
    while len(part := np.fromiter(islice(hashes, STEP), np.uint64)):
        total += len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, column: str = "text", name: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """`df` with the fingerprint of `column` as a long."""
    return with_columns_from(df, column, [T.StructField(name, T.LongType())], lambda: lambda texts: [[fingerprint(t, size) for t in texts]])


def hex_digits(name: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(name))), 16, "0")


# -- links between fingerprints -----------------------------------------------------------------------------------


def _pair_mask(i: int, length: int) -> int:
    bits = sum(((1 << WIDTHS[j % _N]) - 1) << _FROM[j % _N] for j in range(i, i + length))
    return bits - (1 << 64) if bits >> 63 else bits


def _key(fp: Column, i: int) -> Column:
    """Number of the segment, then its bits and those of the next one, in place."""
    second = (i + 1) % _N
    part = lambda j: F.shiftrightunsigned(fp, _FROM[j]).bitwiseAND(F.lit((1 << WIDTHS[j]) - 1).cast("long"))
    return F.lit(i << 32).cast("long") + F.shiftleft(part(second), WIDTHS[i]) + part(i)


def _longs(values) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _around(key: Column) -> Column:
    """The key itself and those with one other bit in the second segment."""
    flips = F.array(*(_longs([0, *(1 << (WIDTHS[i] + b) for b in range(WIDTHS[(i + 1) % _N]))]) for i in range(_N)))
    return F.transform(F.get(flips, F.shiftrightunsigned(key, 32).cast("int")), lambda m: key.bitwiseXOR(m))


def _near(table: pa.Table) -> pa.Table:
    fps = np.unique(table.column("fp").to_numpy().view(np.uint64))
    linked = np.vstack([np.bitwise_count(fps[k : k + 256, None] ^ fps[None]) <= DISTANCE for k in range(0, len(fps), 256)])
    root = local_roots(linked)
    apart = root != np.arange(len(fps))
    signed = fps.view(np.int64)
    return pa.table({"a": signed[apart], "b": signed[root[apart]]})


def links(fps: DataFrame) -> DataFrame:
    """(a, b) that join fingerprints (column `fp`, distinct) at most DISTANCE bits apart into their components.

    Any two such fingerprints are connected by the result, and what it connects is connected
    by such pairs.  Under a key with many of them not every pair is listed: blocks of them are
    compared in memory and each gives a tree, every member tied to the first of its component.
    """
    base = fps.select(F.explode(F.array(*(_key(F.col("fp"), i) for i in range(_N)))).alias("key"), "fp")
    hot = base.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_KEY).select("key")
    asked = base.select(F.explode(_around(F.col("key"))).alias("key"), F.col("fp").alias("a"))
    posted = base.join(hot, "key", "left_anti").withColumnRenamed("fp", "b")
    start = F.shiftrightunsigned(F.col("key"), 32).cast("int")
    other = F.col("a").bitwiseXOR(F.col("b"))
    within = [F.bit_count(other.bitwiseAND(F.get(_longs(_pair_mask(i, n) for i in range(_N)), start))) <= _BUDGET[n - 1] for n in range(3, _N)]
    few = asked.join(posted, (asked["key"] == posted["key"]) & (F.col("a") < F.col("b")), "inner").drop(asked["key"]).filter(within[0] & within[1])
    few = few.filter(F.bit_count(other) <= DISTANCE).select("a", "b")
    members = hot.select(F.col("key").alias("bucket"), F.explode(_around(F.col("key"))).alias("key")).join(base, "key").select("bucket", "fp")
    many = block_pairs(members, ["bucket"], "fp", BLOCK).groupBy("bucket", "block_a", "block_b").applyInArrow(_near, "a long, b long")
    return few.unionByName(many)


# -- links between similar texts ------------------------------------------------------------------------------------

_mixers = np.random.default_rng(SEED).integers(0, 1 << 63, (2, RING * SEGMENT), np.uint64) * np.uint64(2) + np.uint64(1)


def ring(text: str | None, size: int = SIMILAR_SHINGLE) -> tuple[bytes, bytes, bytes, int]:
    """(digest of the set of shingles, places of the ring, sketch, number of distinct shingles) of a text; words as in `fingerprint`."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    hashes = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64))
    places = np.full(RING * SEGMENT, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        np.minimum(places, ((hashes[k : k + 4096, None] ^ _mixers[0]) * _mixers[1]).min(axis=0), out=places)
    high = lambda x: (x >> np.uint64(32)).astype(np.uint32)
    return xxhash.xxh3_128_digest(hashes.tobytes()), high(places).tobytes(), np.unique(high(hashes))[:SKETCH].tobytes(), len(hashes)


_RING_FIELDS = [T.StructField(n, t) for n, t in (("fp", T.LongType()), ("digest", T.BinaryType()), ("places", T.BinaryType()), ("sketch", T.BinaryType()), ("n", T.LongType()))]


def with_rings(df: DataFrame, column: str = "text", size: int = SHINGLE) -> DataFrame:
    """`df` with the fingerprint of `column` as `fp` and what `ring` says of it, in one Python worker for each task."""
    return with_columns_from(df, column, _RING_FIELDS, lambda: lambda texts: list(zip(*((fingerprint(t, size), *ring(t)) for t in texts))))


def _similarity(a: np.ndarray, b: np.ndarray, whole: bool) -> float:
    """Jaccard similarity of two sorted sketches: exact if both are `whole`, else that of the smallest hashes of the union."""
    union = np.union1d(a, b)
    if not whole:
        union = union[:SKETCH]
    return np.count_nonzero(np.intersect1d(a, b, assume_unique=True) <= union[-1]) / len(union)


def _similar(similarity: float):
    def near(table: pa.Table) -> pa.Table:
        """A tree for each component among texts that share a segment."""
        places = np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint32).reshape(-1, RING * SEGMENT)
        sketches = [np.frombuffer(x, np.uint32) for x in table.column("sketch").to_pylist()]
        whole = table.column("n").to_numpy() <= SKETCH
        root = np.full(len(places), -1)
        for first in range(len(places)):
            if root[first] >= 0:
                continue
            root[first], reached = first, [first]
            while reached:
                x = reached.pop()
                rest = np.nonzero(root < 0)[0]
                for y in rest[(places[rest] != places[x]).sum(axis=1) < RING]:
                    if _similarity(sketches[x], sketches[y], whole[x] and whole[y]) >= similarity:
                        root[y] = first
                        reached.append(y)
        fps = table.column("fp").to_numpy()
        apart = fps != fps[root]
        return pa.table({"a": fps[apart], "b": fps[root[apart]]})

    return near


def similar_links(rings: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) between fingerprints (`fp`) of rows (fp, digest, places, sketch, n) whose sets of shingles are at least so similar.

    Rows with the same set and fingerprint are one point.  Of pairs at exactly 0.8, 0.99 have few
    enough differing places to be found, of those at 0.9 all but one in 10^5; a lower
    `similarity` finds less.  Of texts with more than SKETCH distinct shingles the similarity is
    that of SKETCH of them, with a standard deviation of 0.0125 at 0.8.  Two copies share most
    segments; of segments that the same texts share one is looked at.  Many texts that share a
    segment are compared in blocks, and each gives a tree, every member tied to the first of its component.
    """
    uid = F.xxhash64("digest", "fp").alias("uid")
    width = SEGMENT * 4
    keys = F.array(*(F.xxhash64(F.substring("places", i * width + 1, width), F.lit(i)) for i in range(RING)))
    slim = rings.select(uid, "places").groupBy("uid").agg(F.first("places").alias("places")).select("uid", F.explode(keys).alias("key"))
    slim = written(slim, "ring-keys")
    members = slim.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("uid").alias("x"), F.min("uid").alias("low"), F.max("uid").alias("high"))
    chosen = members.filter("n > 1").groupBy("n", "x", "low", "high").agg(F.min("key").alias("key")).select("key")
    dealt = block_pairs(slim.join(chosen, "key"), ["key"], "uid", SIMILAR_BLOCK).drop("_mine")
    point = rings.select(uid, F.struct("fp", "places", "sketch", "n").alias("p")).groupBy("uid").agg(F.first("p").alias("p"))
    groups = dealt.join(point, "uid").select("key", "block_a", "block_b", "p.*").groupBy("key", "block_a", "block_b")
    return groups.applyInArrow(_similar(similarity), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(id, key1, key2, fingerprint, root, component_id) for every row of `docs`.

    root is the smallest fingerprint that chains of links reach, and names a component.
    component_id is the smallest id in it, the own one included; null ids are passed over for it, and it is null
    where all are.  Where ids repeat, several components may have the same component_id.  Texts
    without words (null, empty) have the fingerprint 0 and are linked like any other.
    Rows that repeat share fingerprint and component.  With `similarity`, texts whose shingles of
    SIMILAR_SHINGLE words are at least so similar are linked as well (see `similar_links`).
    """
    k1, k2 = row_key(doc_id, text)
    # Texts go in under the name of a new column, so that they don't come back out of Python.
    goes_in = "fp" if similarity is None else "sketch"
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias(goes_in), k1.alias("key1"), k2.alias("key2"))
    hashed = with_fingerprint(keyed, goes_in, "fp", size) if similarity is None else with_rings(keyed, goes_in, size)
    hashed = written(hashed, "fingerprints")
    each = written(hashed.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints-distinct")
    linked = links(each.select("fp"))
    if similarity is not None:
        linked = linked.unionByName(similar_links(hashed, similarity))
    roots = components(linked, "a", "b")
    rooted = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "root", "component_id")
    return hashed.join(of, "fp").select("id", "key1", "key2", F.col("fp").alias("fingerprint"), "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest id (then key); of rows that repeat it, one."""
    found = near_duplicates(docs, doc_id, text, size, similarity)
    order = F.struct(F.col("id").isNull(), "id", "key1", "key2")
    a, b = fresh("_k1", docs), fresh("_k2", docs)
    first = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.key1").alias(a), F.col("first.key2").alias(b))
    k1, k2 = row_key(doc_id, text)
    return docs.withColumn(a, k1).withColumn(b, k2).join(first, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)
