"""Digests of what each document shows; equal digests mean nothing visible moved.

A digest of a set of any size is the sum of its rows' SHA-256 in four lanes,
plus their number: it combines on the map side and needs no order, so no task
sees the whole set.  Short ordered lists are hashed as they are.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.operators.cards import field_texts, signatures

README, ARCHITECTURE, SEQUENCE = "README.md", "ARCHITECTURE.md", "SEQUENCE.md"


def row_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def _lane(i: int) -> Column:
    return F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")


def set_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row, one column: the digest of the bag of rows."""
    rows = df.select(row_hash(*map(F.col, columns)).alias("h"))
    lanes = [F.sum(_lane(i)) for i in range(4)]
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*"), *lanes), 256).alias("digest"))


# -- digests that an edit is added to and taken from -------------------------------------------------

Lanes = dict[str, list[int]]  # part -> number of rows and the sums of four lanes


def bag(df: DataFrame, part: str, sign: int, *columns: str) -> DataFrame:
    """Rows of a set (part, h, sign) that come in (1) or go (-1)."""
    return df.select(F.lit(part).alias("part"), row_hash(*map(F.col, columns)).alias("h"), F.lit(sign).alias("sign"))


def lanes_of(bags: list[DataFrame]) -> Lanes:
    """The signed sums of all parts: one job, one row for each part."""
    signed = [F.sum(F.when(F.col("sign") < 0, -_lane(i)).otherwise(_lane(i))) for i in range(4)]
    rows = reduce(DataFrame.unionByName, bags).groupBy("part").agg(F.sum("sign").alias("n"), F.array(*signed).alias("lanes"))
    return {r["part"]: [r["n"], *map(int, r["lanes"])] for r in rows.collect()}


def added(before: Lanes, change: Lanes) -> Lanes:
    """Digests after a change: sums of sums."""
    nothing = [0] * 5
    return {p: [a + b for a, b in zip(before.get(p, nothing), change.get(p, nothing))] for p in {*before, *change}}


def lanes_digest(lanes: list[int] | None) -> Column:
    """What `set_digest` gives for the same set."""
    told = "|".join(map(str, lanes)) if lanes and lanes[0] else "0"
    return F.lit(hashlib.sha256(told.encode()).hexdigest())


def list_digest(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row: the digest of a short list in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.agg(F.sha2(F.to_json(F.transform(ordered, lambda x: x[value].cast("string"))), 256).alias("digest"))


def shapes(rows: DataFrame) -> DataFrame:
    """What a card shows of a class, apart from its edges: one hash per class."""
    sort = F.array_sort
    return rows.select(
        "path", "class_ord",
        row_hash(
            F.col("fqn"), F.col("kind"), sort("modifiers"), sort("annotations"), sort("extends"), sort("implements"),
            sort(field_texts()), sort(signatures()),
        ).alias("shape"),
    )


def class_shapes(rows: DataFrame, syms: DataFrame) -> DataFrame:
    """Shapes of the declarations that count."""
    return shapes(rows).join(syms.select("path", "class_ord").hint("merge"), ["path", "class_ord"], "left_semi")


def fingerprints(rows, syms, packages, edges, package_graph, roots, systems, flows) -> DataFrame:
    """(doc, hash) of the three documents."""
    sets = {
        "packages": set_digest(packages, "package"), "names": set_digest(syms, "fqn"), "public": set_digest(syms.filter("is_public"), "fqn"),
        "layers": set_digest(syms, "fqn", "layer"), "shapes": set_digest(class_shapes(rows, syms), "shape"),
        "edges": set_digest(edges, "src", "dst"), "package pairs": set_digest(package_graph, "src_package", "dst_package"),
    }
    return document_hashes({p: d.scalar() for p, d in sets.items()}, roots, systems, flows)


def document_hashes(sets: dict[str, Column], roots, systems, flows) -> DataFrame:
    """(doc, hash) from the digests of the sets and from the short lists."""
    spark = flows.sparkSession
    ranked_roots = roots.select(F.struct(-F.col("n_imports"), "first").alias("place"), F.concat_ws("=", "root", "n_imports").alias("use"))
    parts = {
        README: [sets["packages"], sets["names"], sets["public"], list_digest(ranked_roots, "place", "use").scalar()],
        ARCHITECTURE: [
            sets["packages"], sets["package pairs"], sets["layers"], sets["shapes"], sets["edges"],
            set_digest(systems, "category", "prefixes").scalar(), list_digest(flows.filter("flow_ord = 1"), "flow_ord", "mermaid").scalar(),
        ],
        SEQUENCE: [list_digest(flows, "flow_ord", "mermaid").scalar()],
    }

    def document(doc: str) -> DataFrame:
        hashed = F.sha2(F.concat_ws("|", *parts[doc]), 256)
        return spark.range(1, numPartitions=1).select(F.lit(doc).alias("doc"), hashed.alias("hash"))

    return reduce(DataFrame.unionByName, map(document, parts))


def regeneration(current: DataFrame, previous: DataFrame | None, force: bool = False) -> DataFrame:
    """(doc, hash, write, reason): forced, initial, changed or unchanged."""
    if previous is None:
        previous = current.select("doc", F.lit(None).cast("string").alias("hash"))
    old = previous.select("doc", F.col("hash").alias("old"))
    same = F.col("hash") == F.col("old")
    reason = (
        F.when(F.lit(force), "forced").when(F.col("old").isNull(), "initial").when(same, "unchanged").otherwise("changed")
    )
    decided = current.join(F.broadcast(old), "doc", "left").withColumn("reason", reason)
    return decided.select("doc", "hash", (F.col("reason") != "unchanged").alias("write"), "reason")
