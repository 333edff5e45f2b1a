"""Prompts as a DataFrame (doc, prompt): facts from the analysis, wording from `texts`.

Each section is an aggregate of one row, put into the prompt as a scalar
subquery.  All but the package list have a size set by limits; that list is
part of the README prompt whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.documents import texts
from sourceloom.functions.rules import (
    MAX_DOMAIN_FIELDS_SHOWN, MAX_DOMAIN_SHOWN, MAX_README_EXTERNALS, MAX_README_TYPES, MIN_CLASS_DETAIL_CHARS,
)
from sourceloom.operators.cards import render_card
from sourceloom.operators.fingerprints import ARCHITECTURE, README, SEQUENCE
from sourceloom.operators.select import fit_to_budget, select_with_coverage
from sourceloom.plans.analysis import Analysis
from sourceloom.plans.context import GROUPS, ProjectContext, best_first, group_label
from sourceloom.session import written

LEAST_CARD = len("### enum X") + 2  # no card costs less: each has a head; so no more than budget // LEAST_CARD fit


def joined(df: DataFrame, order: list[str], text: str, separator: str = "\n") -> DataFrame:
    """One row: the texts in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return df.agg(F.array_join(F.transform(rows, lambda r: r[text]), separator).alias("text"))


def fitted(df: DataFrame, order: list[str], text: str, budget: int, more: str) -> DataFrame:
    """One row: as many texts as fit, and how many did not."""
    costed = df.withColumn("cost", F.length(text) + 2).withColumn("all", F.lit(1))
    kept = fit_to_budget(costed, ["all"], [F.asc(c) for c in order], "cost", budget)
    left = df.select(F.count("*")).scalar() - kept.select(F.count("*")).scalar()
    note = F.when(left > 0, F.format_string(f"\n\n... and %d more {more}", left)).otherwise("")
    return joined(kept, ["rank"], text, "\n\n").select(F.concat("text", note).alias("text"))


def layer_section(ctx: ProjectContext) -> DataFrame:
    rows = ctx.analysis.layer_breakdown
    line = F.when(F.col("layer") == "unclassified", F.format_string(texts.LAYER_REST, "n_classes"))
    for name, lead in texts.LAYER_LINES.items():
        line = F.when(F.col("layer") == name, F.concat(F.lit(lead), "listing")).otherwise(line)
    classified = rows.agg(F.sum(F.when(F.col("layer") != "unclassified", F.col("n_classes")))).scalar()
    listed = joined(rows.filter("n_classes > 0").withColumn("line", line), ["layer_ord"], "line")
    return listed.select(
        F.when(classified > 0, F.concat_ws("\n", F.lit(texts.LAYERS), "text")).otherwise(texts.NO_LAYERS).alias("text")
    )


def systems_section(ctx: ProjectContext) -> DataFrame:
    line = F.concat(F.lit("- "), "category", F.lit(" (via "), F.array_join("prefixes", ", "), F.lit(")"))
    listed = joined(ctx.analysis.external_systems.withColumn("line", line), ["category"], "line")
    return listed.select(
        F.when(F.col("text") == "", texts.NO_SYSTEMS).otherwise(F.concat_ws("\n", F.lit(texts.SYSTEMS), "text")).alias("text")
    )


def domain_section(ctx: ProjectContext) -> DataFrame:
    """The most important domain types with their first fields."""
    cards = ctx.cards("layer = 'domain'", MAX_DOMAIN_SHOWN)
    total = ctx.selected.filter("layer = 'domain'").agg(F.coalesce(F.sum("n_declared"), F.lit(0))).scalar()
    n_shown = F.least(F.size("fields"), F.lit(MAX_DOMAIN_FIELDS_SHOWN))
    more = F.size("fields") - n_shown
    line = F.concat(
        F.lit("- **"), "fqn", F.lit("** ("), "kind", F.lit("): "),
        F.when(n_shown == 0, "no fields").otherwise(F.array_join(F.slice("fields", F.lit(1), n_shown), "; ")),
        F.when(more > 0, F.format_string("; and %d more fields", more)).otherwise(""),
        F.coalesce(F.concat(F.lit(" — "), "summary"), F.lit("")),
    )
    top = cards.orderBy(*best_first()).limit(MAX_DOMAIN_SHOWN)
    listed = joined(top.select((-F.col("importance")).alias("place"), "fqn", line.alias("line")), ["place", "fqn"], "line")
    rest = F.when(total > MAX_DOMAIN_SHOWN, F.format_string("- ...and %d more domain types not shown in detail", total - MAX_DOMAIN_SHOWN))
    found = F.concat_ws("\n", F.lit(texts.DOMAIN), "text", rest, F.lit(texts.DOMAIN_NOTE))
    return listed.select(F.when(F.col("text") == "", texts.NO_DOMAIN).otherwise(found).alias("text"))


def component_section(ctx: ProjectContext, budget: int) -> DataFrame:
    """Cards of all layers but the domain, under what the other sections left of the budget."""
    labels = [g for g in GROUPS if g != "Domain"]
    cards = ctx.cards("layer is null or layer <> 'domain'", budget // LEAST_CARD + 1)
    cards = cards.withColumn("group", group_label()).withColumn("text", render_card()).withColumn("cost", F.length("text") + 2)
    kept = select_with_coverage(cards, "group", labels, best_first(), "cost", budget)
    order = F.array_position(F.array(*map(F.lit, labels)), F.col("group"))
    texts_ = F.array_sort(F.collect_list(F.struct("rank", "text")))
    sections = kept.groupBy(order.alias("place"), "group").agg(F.array_join(F.transform(texts_, lambda r: r["text"]), "\n\n").alias("cards"))
    sections = sections.withColumn("section", F.concat(F.lit("#### "), "group", F.lit(" layer\n\n"), "cards"))
    total = ctx.selected.filter("layer is null or layer <> 'domain'").agg(F.coalesce(F.sum("n_declared"), F.lit(0))).scalar()
    left = total - kept.select(F.count("*")).scalar()
    note = F.when(left > 0, F.format_string("\n\n... and %d more classes not shown in detail due to prompt size limits", left))
    return joined(sections, ["place"], "section", "\n\n").select(F.concat("text", F.coalesce(note, F.lit(""))).alias("text"))


def flow_text() -> Column:
    """One flow as a numbered list and its diagram."""
    entry = F.concat("entry_class", F.lit("."), "entry_method", F.lit("()"))
    steps = F.transform(
        "steps",
        lambda s, i: F.concat(
            F.lit("  "), (i + 2).cast("string"), F.lit(". "), s["caller_class"], F.lit("."), s["caller_method"], F.lit("() calls "),
            s["callee_class"], F.lit("."), s["callee_method"], F.lit("()"),
        ),
    )
    return F.concat(
        F.lit("Flow from a client call of "), entry, F.lit(":\n  1. Client calls "), entry, F.lit("\n"), F.array_join(steps, "\n"),
        F.lit(f"\n{texts.FLOW_NOTE}\n```mermaid\n"), "mermaid", F.lit("\n```"),
    )


def flow_section(ctx: ProjectContext) -> DataFrame:
    flows = ctx.analysis.flows.select("flow_ord", flow_text().alias("text"))
    fit = fitted(flows, ["flow_ord"], "text", ctx.detail_chars, "flow(s) not shown due to prompt size limits")
    return fit.select(F.when(F.col("text") == "", texts.NO_FLOWS).otherwise(F.col("text")).alias("text"))


def primary_section(ctx: ProjectContext) -> DataFrame:
    first = ctx.analysis.flows.filter("flow_ord = 1").select("flow_ord", flow_text().alias("text"))
    found = joined(first, ["flow_ord"], "text")
    return found.select(F.when(F.col("text") == "", texts.NO_PRIMARY).otherwise(F.col("text")).alias("text"))


def readme_prompt(ctx: ProjectContext) -> DataFrame:
    a = ctx.analysis
    types = ctx.cards("is_public", MAX_README_TYPES).orderBy(*best_first()).limit(MAX_README_TYPES)
    types = types.select((-F.col("importance")).alias("place"), "fqn", render_card(with_dependencies=False).alias("text"))
    type_text = fitted(types, ["place", "fqn"], "text", ctx.detail_chars // 2, "not shown in detail")
    packages = ctx.package_summaries.select(
        "package", F.concat(F.lit("- `"), "name", F.lit("` ("), F.col("class_count").cast("string"), F.lit(" types)")).alias("line")
    )
    roots = a.external_roots.select((-F.col("n_imports")).alias("place"), "first", "root").orderBy("place", "first").limit(MAX_README_EXTERNALS)
    roots = F.coalesce(F.nullif(joined(roots, ["place", "first"], "root", ", ").scalar(), F.lit("")), F.lit("none detected"))
    note = F.when(F.col("truncated"), "\nNote: the code base is large; the types below are a part of it.\n").otherwise("\n")
    prompt = F.concat(
        F.lit(f'Write README.md for the repository "{ctx.name}".\n\nFacts:\n- Languages: {", ".join(ctx.languages)}\n- Files: '),
        F.col("n_files").cast("string"), F.lit("\n- Types: "), F.col("n_classes").cast("string"),
        F.lit("\n- Packages:\n"), joined(packages, ["package"], "line").scalar(),
        F.lit("\n- External dependencies, most imported first: "), roots, note,
        F.lit("\nPublic types:\n\n"), type_text.scalar(), F.lit("\n\n" + texts.README_TASK),
    )
    return ctx.counts.select(F.lit(README).alias("doc"), prompt.alias("prompt"))


def architecture_sections(ctx: ProjectContext) -> DataFrame:
    """One row: the sections that come before class detail."""
    parts = {
        "layers": layer_section(ctx), "systems": systems_section(ctx), "domain": domain_section(ctx),
        "primary": primary_section(ctx), "graph": ctx.analysis.component_mermaid,
    }
    one = ctx.analysis.parsed.sparkSession.range(1, numPartitions=1)
    return one.select(*[part.scalar().alias(name) for name, part in parts.items()])


def class_detail_budget(sections: DataFrame, detail_chars: int) -> int:
    used = sections.select(sum((F.length(c) for c in sections.columns), F.lit(0)).alias("n")).first()["n"]
    return max(detail_chars - used, MIN_CLASS_DETAIL_CHARS)


def architecture_prompt(ctx: ProjectContext) -> DataFrame:
    sections = written(architecture_sections(ctx), "architecture-sections")
    detail = component_section(ctx, class_detail_budget(sections, ctx.detail_chars))
    prompt = F.concat(
        F.lit(f'Write ARCHITECTURE.md for the repository "{ctx.name}".\n\n{texts.ARCHITECTURE_HEAD}\n\n'), "layers",
        F.lit("\n\n"), "systems", F.lit("\n\nDomain model:\n"), "domain",
        F.lit("\n\nPrimary request flow, traced through the call graph:\n"), "primary",
        F.lit("\n\nVERIFIED FACT: component graph (nodes are layers and external systems; an edge means `uses`):\n```mermaid\n"),
        "graph", F.lit("\n```\n\nClasses by verified layer, as evidence for your text:\n\n"), detail.scalar(),
        F.lit("\n\n---\n\n" + texts.ARCHITECTURE_TASK),
    )
    return sections.select(F.lit(ARCHITECTURE).alias("doc"), prompt.alias("prompt"))


def sequence_prompt(ctx: ProjectContext) -> DataFrame:
    prompt = F.concat(
        F.lit(f'Write SEQUENCE.md, the main call flows of the repository "{ctx.name}".\n\n{texts.SEQUENCE_HEAD}\n\n'), "text",
        F.lit("\n\n" + texts.SEQUENCE_TASK),
    )
    return flow_section(ctx).select(F.lit(SEQUENCE).alias("doc"), prompt.alias("prompt"))


PROMPTS = {README: readme_prompt, ARCHITECTURE: architecture_prompt, SEQUENCE: sequence_prompt}
_PRINTS: dict[str, Callable[[Analysis], DataFrame] | None] = {}


def register_document(doc: str, prompt: Callable[[ProjectContext], DataFrame], fingerprint: Callable[[Analysis], DataFrame] | None = None) -> None:
    """Add a document, or put another prompt in place of a known one.

    `prompt` gives one row (doc, prompt), `fingerprint` one row (hash) that moves with what the document
    shows.  Without it a new document is due whenever one of the three built-in ones is.
    """
    if doc not in PROMPTS or fingerprint is not None:
        _PRINTS[doc] = fingerprint
    PROMPTS[doc] = prompt


def document_fingerprints(analysis: Analysis) -> DataFrame:
    """(doc, hash) of all known documents."""
    own = written(analysis.fingerprints, "fingerprints")
    every = own.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "doc", "hash"))), "|"), 256).alias("hash"))
    rows = own.filter(~F.col("doc").isin(list(_PRINTS))) if _PRINTS else own
    for doc, fingerprint in _PRINTS.items():
        row = fingerprint(analysis) if fingerprint else every
        rows = rows.unionByName(row.select(F.lit(doc).alias("doc"), "hash"))
    return rows


def prompts(ctx: ProjectContext, docs: list[str] | None = None) -> DataFrame:
    """(doc, prompt) of the wanted documents; names of no known document are passed over."""
    wanted = [build(ctx) for doc, build in PROMPTS.items() if docs is None or doc in docs]
    out = wanted[0]
    for more in wanted[1:]:
        out = out.unionByName(more)
    return out
