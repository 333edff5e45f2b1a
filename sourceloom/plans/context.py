"""The bounded selection of class cards that documents are written from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.layers import layer_label
from sourceloom.functions.rules import DEFAULT_DETAIL_CHARS, LAYER_LABELS, MAX_CARDS
from sourceloom.operators.cards import render_card
from sourceloom.operators.select import select_with_coverage
from sourceloom.operators.skew import first_per_group
from sourceloom.plans.analysis import Analysis
from sourceloom.session import written

UNCLASSIFIED = "Unclassified"
GROUPS = [*LAYER_LABELS.values(), UNCLASSIFIED]


def best_first():
    return [F.desc("importance"), F.asc("fqn")]


def group_label():
    return F.when(F.col("layer").isNull(), UNCLASSIFIED).otherwise(layer_label(F.col("layer")))


def shortlist(ranked: DataFrame, limit: int = MAX_CARDS) -> DataFrame:
    """The classes that can be selected at all: the first `limit` of each layer.

    At most `limit` cards are shown in total, so no class behind them can be;
    details are put together for these few hundred classes only.
    """
    return first_per_group(ranked.withColumn("group", group_label()), ["group"], best_first(), limit).select("fqn", "group")


def select_cards(cards: DataFrame, budget: int, max_count: int | None = MAX_CARDS) -> DataFrame:
    """Cards kept under `budget` characters with every non-empty layer present."""
    costed = cards.withColumn("group", group_label()).withColumn("cost", F.length(render_card()) + 2)
    return select_with_coverage(costed, "group", GROUPS, best_first(), "cost", budget, max_count)


@dataclass
class ProjectContext:
    analysis: Analysis
    name: str
    languages: list[str]
    detail_chars: int = DEFAULT_DETAIL_CHARS

    @cached_property
    def selected(self) -> DataFrame:
        """The selected cards, at most MAX_CARDS rows."""
        few = written(shortlist(self.analysis.ranked), "shortlist")
        return written(select_cards(self.analysis.cards_of(few), self.detail_chars), "selected-cards")

    @cached_property
    def counts(self) -> DataFrame:
        """One row: n_files, n_classes, n_selected, truncated."""
        a = self.analysis
        files, kept = a.parsed.select(F.count("*")), self.selected.select(F.count("*"))
        row = a.symbols.agg(F.count("*").alias("n_classes"), files.scalar().alias("n_files"), kept.scalar().alias("n_selected"))
        return row.withColumn("truncated", F.col("n_classes") > F.col("n_selected"))

    @property
    def package_summaries(self) -> DataFrame:
        """package, class_count and the selected classes of every package."""
        shown = self.selected.groupBy("package").agg(F.array_sort(F.collect_list("fqn")).alias("shown"))
        named = F.when(F.col("package") == "", "(default package)").otherwise(F.col("package"))
        return self.analysis.packages.join(F.broadcast(shown), "package", "left").select(
            "package", named.alias("name"), "class_count", F.coalesce("shown", F.array().cast("array<string>")).alias("shown")
        )

    def cards(self, condition: str = "true", copies: int = MAX_CARDS) -> DataFrame:
        """Selected cards; a name declared n times is listed n times (no more than can be shown)."""
        listed = F.sequence(F.lit(1), F.least("n_declared", F.lit(copies)).cast("int"))
        return self.selected.filter(condition).withColumn("copy", F.explode(listed))
