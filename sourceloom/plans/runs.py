"""Whole runs over a working tree: full, incremental, and the structural report."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.config import Config
from sourceloom.documents.generate import DocResult, write_documents
from sourceloom.documents.prompts import document_fingerprints
from sourceloom.documents.provider import Provider
from sourceloom.operators.changes import merge_snapshot, run_counters, update_plan
from sourceloom.operators.fingerprints import regeneration
from sourceloom.operators.skew import lookup_join
from sourceloom.plans.analysis import Analysis
from sourceloom.plans.context import ProjectContext
from sourceloom.plans.incremental import Graph
from sourceloom.session import written
from sourceloom.sources import worktree
from sourceloom.sources.parse import file_hash, parse_files
from sourceloom.sources.state import State, StateStore

MAX_ERROR_FILES_LISTED = 10


@dataclass
class RunSummary:
    mode: str
    files_scanned: int = 0
    files_parsed: int = 0
    files_removed: int = 0
    files_reused: int = 0
    doc_results: list[DocResult] = field(default_factory=list)
    message: str | None = None


class Runner:
    """`keep_graph`: references, edges, calls and digests are kept as tables beside the snapshot, and an update
    changes them by what was edited.  It pays for large trees; small ones are analysed anew as quickly."""

    def __init__(self, spark: SparkSession, root: str | Path, config: Config, provider: Provider | None = None, keep_graph: bool = False):
        self.spark, self.root, self.config, self.provider, self.keep_graph = spark, Path(root).resolve(), config, provider, keep_graph
        elsewhere = re.match(r"[a-z][a-z0-9+.-]*:", config.state_dir)
        self.store = StateStore(spark, config.state_dir if elsewhere else self.root / config.state_dir)

    # -- reading ------------------------------------------------------------------
    def listed(self) -> DataFrame:
        return worktree.list_files(self.spark, self.root, self.config.exclude_patterns)

    def contents(self, paths: DataFrame) -> DataFrame:
        return worktree.read_contents(paths, self.root)

    def parse(self, paths: DataFrame) -> DataFrame:
        return parse_files(self.contents(paths), self.config.languages)

    # -- runs ---------------------------------------------------------------------
    def full(self, force: bool = False, mode: str = "full") -> RunSummary:
        sources = worktree.source_files(self.listed(), self.config.languages)
        snapshot = self.store.write_snapshot(self.parse(sources))
        state = State(worktree.current_commit(self.root), snapshot, complete=False)
        graph = Graph.build(self.store.parsed(state), self.store.folder) if self.keep_graph else None
        n = self.store.parsed(state).count()
        summary = RunSummary(mode, files_scanned=n, files_parsed=n)
        summary.doc_results = self._documents(state, None, force, graph)
        return summary

    def update(self, force: bool = False) -> RunSummary:
        before = self.store.load()
        if before is None:
            return self.full(force, "full (no prior state)")
        cached = self.store.parsed(before)
        paths = worktree.source_files(self.listed(), self.config.languages)
        current = self.contents(paths).select("path", file_hash(F.col("content")).alias("content_hash"))
        changes = worktree.changes_since(self.spark, self.root, before.last_commit)
        plan = written(update_plan(cached.select("path", "content_hash"), current, changes), "update-plan")
        summary = RunSummary("incremental", **run_counters(plan).first().asDict())
        moved = not plan.filter("action <> 'reuse'").isEmpty()
        if not moved and not force and before.complete:
            summary.message = "No file changed since the last run; nothing to do."
            return summary
        state, graph = before, None
        if self.keep_graph:
            graph = Graph.load(self.spark, before.graph) if before.graph else Graph.build(cached, self.store.folder)
        if moved:
            # only paths are shuffled: contents are read again, and only those to be parsed
            due = paths.join(plan.filter("action = 'parse'").select("path"), "path", "left_semi")
            edited = plan.filter("action <> 'reuse'").select("path")
            parsed = written(self.parse(due), "parsed-due") if graph else self.parse(due)
            state = self.store.replace(before, edited, lambda some: merge_snapshot(some, parsed, plan))
            if graph:
                graph, _ = graph.update(parsed, plan.filter("action = 'remove'").select("path"))
        state = replace(state, last_commit=worktree.current_commit(self.root), complete=False)
        summary.doc_results = self._documents(state, before.fingerprints, force, graph)
        return summary

    def _documents(self, state: State, previous: dict[str, str] | None, force: bool, graph: Graph | None) -> list[DocResult]:
        state.graph = graph.manifest() if graph else ""
        self.store.save(state)
        analysis = graph.analysis() if graph else Analysis(self.store.parsed(state), is_written=True)
        current = written(document_fingerprints(analysis), "document-fingerprints")
        old = self.spark.createDataFrame(list(previous.items()), "doc string, hash string") if previous else None
        budget = self.spark.range(1).select(detail_budget(self.config.model.num_ctx)).first()[0]
        ctx = ProjectContext(analysis, self.root.name, self.config.languages, budget)
        output = self.root / self.config.output_dir
        results = write_documents(ctx, regeneration(current, old, force), self.config.docs, self.provider, output)
        state.fingerprints = {r["doc"]: r["hash"] for r in current.collect()}
        state.complete = True
        self.store.save(state)
        return results

    # -- report ---------------------------------------------------------------------
    def report(self) -> Iterator[str]:
        """Lines of the structural report; neither a model nor a state is needed."""
        listed = self.listed()
        yield f"Files scanned:       {listed.count()}"
        yield from report_lines(Analysis(self.parse(worktree.source_files(listed, self.config.languages))))


def detail_budget(num_ctx: int):
    from sourceloom.functions.text import detail_chars

    return detail_chars(F.lit(num_ctx))


def package_report(a: Analysis) -> DataFrame:
    """package, class_count and, per declared class, its kind, name, methods and dependencies."""
    deps = a.ranked.select("fqn", "fan_out")
    rows = lookup_join(a.facts, deps, "fqn", hot=a.hot(a.facts, "fqn"))
    rows = lookup_join(rows, a.packages, "package", hot=a.hot(a.facts, "package"))
    return rows.select("package", "class_count", "path", "class_ord", "kind", "name", "n_methods", "fan_out")


def report_lines(a: Analysis) -> Iterator[str]:
    yield f"Source files parsed: {a.files.count()}"
    yield f"Packages:            {a.packages.count()}"
    yield f"Types discovered:    {a.symbols.count()}"
    failed = a.files.filter(F.size("parse_errors") > 0)
    n_failed = failed.count()
    if n_failed:
        yield f"Files with parse errors: {n_failed}"
        for r in failed.orderBy("path").limit(MAX_ERROR_FILES_LISTED).collect():
            yield f"  - {r['path']}: {r['parse_errors']}"
    yield ""
    package = None
    for r in package_report(a).orderBy("package", "path", "class_ord").toLocalIterator():
        if r["package"] != package:
            package = r["package"]
            yield f"{package or '(default package)'} ({r['class_count']} types)"
        yield f"  - {r['kind']} {r['name']} ({r['n_methods']} methods, {r['fan_out']} internal deps)"
