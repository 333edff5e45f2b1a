"""Layers of the tree and the component graph between them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.layers import layer_label
from sourceloom.functions.rules import CLIENT, LAYER_LABELS, LAYERS, MAX_NAMES_LISTED
from sourceloom.functions.text import truncated_list
from sourceloom.operators.skew import first_per_group

ALL_LAYERS = (*LAYERS, "unclassified")


def layer_members(syms: DataFrame) -> DataFrame:
    """(layer, fqn) of every class, with the place that orders a layer's list."""
    return syms.select(F.coalesce("layer", F.lit("unclassified")).alias("layer"), "fqn", "first_path", "first_ord")


def layer_breakdown(syms: DataFrame, listed: int = MAX_NAMES_LISTED) -> DataFrame:
    """The five layers, each with its class count and its first names.

    A layer may hold any number of classes: they are counted, and only the first
    `listed` of each are brought together.
    """
    members = layer_members(syms)
    totals = members.groupBy("layer").agg(F.count("*").alias("n_classes"))
    first = first_per_group(members, ["layer"], [F.col("first_path"), F.col("first_ord")], listed)
    names = first.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("rank", "fqn"))).alias("r"))
    spark = syms.sparkSession
    every = spark.createDataFrame([(i, name) for i, name in enumerate(ALL_LAYERS)], "layer_ord int, layer string")
    joined = every.join(F.broadcast(totals), "layer", "left").join(F.broadcast(names), "layer", "left")
    shown = F.coalesce(F.transform("r", lambda x: x["fqn"]), F.array().cast("array<string>"))
    total = F.coalesce("n_classes", F.lit(0))
    return joined.select(
        "layer_ord", "layer", total.alias("n_classes"), shown.alias("names"), truncated_list(shown, listed, total).alias("listing")
    )


def component_edges(edges_with_source: DataFrame, syms: DataFrame, categories: DataFrame) -> DataFrame:
    """Distinct edges between layer components, to external systems, and from the client.

    Each part is reduced to its distinct labels (a dozen at most) before the union.
    """
    between = edges_with_source.select(
        layer_label(F.col("src_layer")).alias("src"), layer_label(F.col("dst_layer")).alias("dst")
    ).filter("src <> dst")
    outside = syms.select("path", layer_label(F.col("layer")).alias("src")).join(categories, "path").select(
        "src", F.explode("categories").alias("dst")
    )
    client = syms.filter("layer = 'api'").select(F.lit(CLIENT).alias("src"), F.lit(LAYER_LABELS["api"]).alias("dst"))
    return between.distinct().unionByName(outside.distinct()).unionByName(client.distinct())
