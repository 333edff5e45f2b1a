"""Class and package dependency edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.naming import type_names
from sourceloom.operators.skew import lookup_join

REFERENCE = ["path", "class_ord", "name", "kind"]
# one bit per kind, in alphabetical order so that a decoded mask is sorted
KINDS = ("creates", "extends", "field", "implements", "param", "return")


def references(rows: DataFrame) -> DataFrame:
    """Every type name a class mentions, once per class and kind: one pass, no shuffle."""
    methods = F.col("methods")
    texts = {
        "creates": F.flatten(methods["creates"]),
        "extends": F.col("extends"),
        "field": F.col("fields.type"),
        "implements": F.col("implements"),
        "param": F.flatten(methods["parameters"])["type"],
        "return": methods["return_type"],
    }

    def tagged(kind: str) -> Column:
        # distinct among strings is hashed, among structs it would compare every pair; the texts are taken apart as one
        names = F.array_distinct(type_names(F.array_join(texts[kind], " ")))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(1 << KINDS.index(kind)).alias("kind")))

    found = F.concat(*map(tagged, KINDS))
    return rows.select("path", "class_ord", F.col("fqn").alias("src"), "package", "import_paths", F.inline(found))


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst) once, with its kinds as a bit mask and the facts of dst."""
    return (
        resolved.filter(F.col("src") != F.col("target"))
        .groupBy("src", F.col("target").alias("dst"), F.col("target_package").alias("dst_package"), F.col("target_layer").alias("dst_layer"))
        .agg(F.bit_or("kind").alias("kind_mask"))
    )


def kind_names(mask: Column) -> Column:
    """Bit mask -> sorted array of kind names."""
    pairs = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])
    hit = F.filter(pairs, lambda p: mask.bitwiseAND(p["bit"]) != 0)
    return F.transform(hit, lambda p: p["kind"])


def with_source(edges: DataFrame, syms: DataFrame, hot: list | None = None) -> DataFrame:
    """Edges with the package and layer of src."""
    facts = syms.select(
        F.col("fqn").alias("src"), F.col("package").alias("src_package"), F.col("layer").alias("src_layer")
    )
    return lookup_join(edges, facts, "src", hot=hot)


def package_edges(edges_with_source: DataFrame) -> DataFrame:
    e = edges_with_source.filter(F.col("src_package") != F.col("dst_package"))
    return e.select("src_package", "dst_package").distinct()


def dependencies_of(edges: DataFrame, fqn: str) -> DataFrame:
    return edges.filter(F.col("src") == fqn)


def dependents_of(edges: DataFrame, fqn: str) -> DataFrame:
    return edges.filter(F.col("dst") == fqn)


def fan(edges: DataFrame) -> DataFrame:
    """fqn, fan_in, fan_out of every class that has an edge: one aggregation, no join."""
    ends = F.array(
        F.struct(F.col("dst").alias("fqn"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("src").alias("fqn"), F.lit(0).alias("i"), F.lit(1).alias("o")),
    )
    return edges.select(F.inline(ends)).groupBy("fqn").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
