"""Class cards: importance, capped detail lists, rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.rules import (
    FAN_IN_WEIGHT, FAN_OUT_WEIGHT, MAX_CARD_FIELDS, MAX_CARD_METHODS, ROUTE_BONUS,
)
from sourceloom.functions.text import capped, first_line, signature
from sourceloom.operators.dependencies import fan
from sourceloom.operators.skew import first_per_group
from sourceloom.operators.tables import zipped


def ranking(syms: DataFrame, edges: DataFrame) -> DataFrame:
    """Every class with fan_in, fan_out and importance.  Both sides have one row per name."""
    zero = F.lit(0).cast("bigint")
    ranked = syms.join(fan(edges).hint("merge"), "fqn", "left")
    fan_in, fan_out = F.coalesce("fan_in", zero), F.coalesce("fan_out", zero)
    bonus = F.when(F.col("is_route"), ROUTE_BONUS).otherwise(0)
    return ranked.select(
        *syms.columns, fan_in.alias("fan_in"), fan_out.alias("fan_out"),
        (fan_in * FAN_IN_WEIGHT + fan_out * FAN_OUT_WEIGHT + bonus).cast("bigint").alias("importance"),
    )


def field_texts() -> Column:
    return F.transform(zipped("fields", "name", "type"), lambda f: F.concat(f["type"], F.lit(" "), f["name"]))


def signatures() -> Column:
    return F.transform(zipped("methods", "name", "return_type", "parameters", "modifiers", "is_constructor"), signature)


def _neighbours(edges: DataFrame, of: str, other: str, name: str, limit: int) -> DataFrame:
    """First `limit` neighbours by name; a class may have any number, so the cut precedes the gathering."""
    first = first_per_group(edges.select(of, other), [of], [F.col(other)], limit)
    return first.groupBy(F.col(of).alias("fqn")).agg(F.array_sort(F.collect_list(other)).alias(name))


def class_cards(rows: DataFrame, ranked: DataFrame, edges: DataFrame, few: DataFrame | None = None) -> DataFrame:
    """One card per class of `ranked`; of those in `few` (fqn, a bounded number) only, if given."""
    texts = rows.select(
        "path", "class_ord", "extends", "implements", first_line(F.col("doc_comment")).alias("summary"),
        capped(field_texts(), MAX_CARD_FIELDS).alias("fields"), capped(signatures(), MAX_CARD_METHODS).alias("methods"),
    )
    heads = ranked.select(
        "fqn", "path", "class_ord", "kind", "modifiers", "package", "layer", "importance", "fan_in", "fan_out", "n_declared",
        "is_public",
    )
    out_edges = in_edges = edges
    if few is None:
        heads = heads.hint("merge")
    else:
        small = F.broadcast(few.select("fqn"))
        heads = F.broadcast(heads.join(small, "fqn", "left_semi"))
        out_edges = edges.join(small, edges["src"] == F.col("fqn"), "left_semi")
        in_edges = edges.join(small, edges["dst"] == F.col("fqn"), "left_semi")
    cards = (
        texts.join(heads, ["path", "class_ord"])
        .join(_neighbours(out_edges, "src", "dst", "depends_on", MAX_CARD_METHODS).hint("merge"), "fqn", "left")
        .join(_neighbours(in_edges, "dst", "src", "depended_on_by", MAX_CARD_METHODS).hint("merge"), "fqn", "left")
    )
    none = F.array().cast("array<string>")
    return cards.select(
        "fqn", "kind", "modifiers", "package", "summary", "extends", "implements", "fields", "methods",
        capped(F.coalesce("depends_on", none), MAX_CARD_METHODS, F.col("fan_out")).alias("depends_on"),
        capped(F.coalesce("depended_on_by", none), MAX_CARD_METHODS, F.col("fan_in")).alias("depended_on_by"),
        "layer", "importance", "n_declared", "is_public",
    )


def render_card(with_dependencies: bool = True) -> Column:
    """Text of a card row; empty parts leave no line."""

    def line(name, values, separator=", "):
        return F.when(F.size(values) > 0, F.concat(F.lit(f"- {name}: "), F.array_join(values, separator)))

    methods = F.when(F.size("methods") > 0, F.concat(F.lit("- methods:\n  - "), F.array_join("methods", "\n  - ")))
    parts = [
        F.concat(F.lit("### "), "kind", F.lit(" "), "fqn"),
        F.concat(F.lit("- layer: "), "layer"),
        line("modifiers", F.col("modifiers")),
        line("extends", F.col("extends")),
        line("implements", F.col("implements")),
        F.concat(F.lit("- summary: "), "summary"),
        line("fields", F.col("fields"), "; "),
        methods,
    ]
    if with_dependencies:
        parts += [line("depends on", F.col("depends_on")), line("used by", F.col("depended_on_by"))]
    return F.concat_ws("\n", *parts)
