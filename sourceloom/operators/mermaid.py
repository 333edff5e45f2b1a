"""Mermaid text of edge lists."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.naming import identifier


def graph_lines(edges: DataFrame) -> DataFrame:
    """(src, dst) -> text lines with the key (src, dst, part) that orders them.

    A node is declared where it is first met: as a source before its edges, or
    as a target just before the edge to it.  Where that is, is a minimum per
    node, so no task needs the whole list.
    """
    met = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.struct("src", F.lit("").alias("dst")).alias("at")),
                F.struct(F.col("dst").alias("node"), F.struct("src", "dst").alias("at")),
            )
        )
    )
    nodes = met.groupBy("node").agg(F.min("at").alias("at"))
    declared = nodes.select(
        "at.src", "at.dst", F.lit(0).alias("part"),
        F.concat(F.lit("    "), identifier(F.col("node"), "root"), F.lit('["'), "node", F.lit('"]')).alias("line"),
    )
    arrows = edges.select(
        "src", "dst", F.lit(1).alias("part"),
        F.concat(F.lit("    "), identifier(F.col("src"), "root"), F.lit(" --> "), identifier(F.col("dst"), "root")).alias("line"),
    )
    return declared.unionByName(arrows)


def graph_text(lines: DataFrame, orientation: str = "TD") -> DataFrame:
    """The whole diagram as one string: for graphs of bounded size, such as the component graph."""
    ordered = F.array_sort(F.collect_list(F.struct("src", "dst", "part", "line")))
    body = F.transform(ordered, lambda x: x["line"])
    return lines.agg(F.array_join(F.concat(F.array(F.lit(f"graph {orientation}")), body), "\n").alias("mermaid"))
