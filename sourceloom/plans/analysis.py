"""One parsed tree and everything computed from it, each table once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.operators import calls, cards, components, dependencies, external, flows, mermaid, resolve, symbols, tables
from sourceloom.operators import fingerprints as prints
from sourceloom.operators.skew import HOT_ROWS, hot_keys
from sourceloom.session import written


class Analysis:
    """Tables over a parsed tree.

    Those read by several others (`parsed`, `classes`, `symbols`, `names`, `edges`, `calls`,
    `redirects`, `ranked`, `flows`) are written to the shared folder at first use; the rest
    are plain lazy DataFrames.

    In joins on names a key with `hot_rows` rows or more is treated apart: adaptive execution goes by
    the compressed size of a partition, which for the rows of one name is a small part of what sorting them takes.
    """

    def __init__(self, parsed: DataFrame, hot_rows: int | None = HOT_ROWS, is_written: bool = False):
        self._parsed, self.hot_rows, self._is_written = parsed, hot_rows, is_written

    @cached_property
    def parsed(self) -> DataFrame:
        return self._parsed if self._is_written else written(self._parsed, "parsed")

    @cached_property
    def classes(self) -> DataFrame:
        """One row per class.  Its readers take few of its columns, which only a flat table lets them."""
        return written(tables.classes(self.parsed), "classes")

    # -- tables -------------------------------------------------------------------
    @property
    def files(self) -> DataFrame:
        return tables.files(self.parsed)

    @property
    def imports(self) -> DataFrame:
        return tables.imports(self.parsed)

    @property
    def facts(self) -> DataFrame:
        return tables.class_facts(self.classes)

    @property
    def methods(self) -> DataFrame:
        return tables.methods(self.classes)

    @property
    def call_sites(self) -> DataFrame:
        return tables.call_sites(self.classes)

    @cached_property
    def symbols(self) -> DataFrame:
        return written(symbols.symbols(self.facts), "symbols")

    @property
    def packages(self) -> DataFrame:
        return symbols.package_counts(self.parsed)

    @cached_property
    def names(self) -> DataFrame:
        """What a name can mean; joined by every resolution."""
        return written(resolve.dictionary(self.symbols, symbols.unique_names(self.symbols)), "names")

    def _may_be_hot(self, rows: DataFrame) -> bool:
        return bool(self.hot_rows) and rows.count() >= self.hot_rows

    def hot(self, rows: DataFrame, key: str) -> list | None:
        """Hot keys of `rows`; none are looked for among too few rows for one."""
        return hot_keys(rows, key, self.hot_rows) if self._may_be_hot(rows) else None

    @cached_property
    def _has_paths_once(self) -> bool:
        """Whether no two files have the same path; then a place in the tree has one row.  Equal hashes of paths count as equal paths."""
        files = self.classes.filter("class_ord = 0").groupBy(F.xxhash64("path").alias("path_hash")).count()
        return files.filter("count > 1").isEmpty()

    def _resolve(self, refs: DataFrame, by: list[str]) -> DataFrame:
        """The rows of `refs` the name of which is a project class; `by`, which begins with the path, tells rows of one file apart."""
        asked = written(resolve.asking(refs), "references")
        each = written(resolve.questions(asked), "questions")
        hot = resolve.hot_candidate_keys(each, self.hot_rows) if self._may_be_hot(each) else None
        answered = written(resolve.answers(each, self.names, hot), "answers")
        return resolve.told(asked, answered, by, self._has_paths_once, self.hot(asked, "question"))

    # -- edges ----------------------------------------------------------------------
    @cached_property
    def edges(self) -> DataFrame:
        """src, dst, kind_mask with package and layer of both ends."""
        found = dependencies.dependency_edges(self._resolve(dependencies.references(self.classes), dependencies.REFERENCE))
        found = written(found, "class-edges")
        return written(dependencies.with_source(found, self.symbols, self.hot(found, "src")), "edges")

    @property
    def dependency_edges(self) -> DataFrame:
        return self.edges.select("src", "dst", dependencies.kind_names(F.col("kind_mask")).alias("kinds"))

    @property
    def package_edges(self) -> DataFrame:
        return dependencies.package_edges(self.edges)

    @cached_property
    def calls(self) -> DataFrame:
        """Every resolved call, in tree order by its ordinals."""
        return written(calls.call_edges(self.call_sites, self._resolve(calls.receiver_references(self.call_sites), calls.CALL_ORDER)), "calls")

    @property
    def meaningful_calls(self) -> DataFrame:
        return self.calls.filter(calls.is_meaningful())

    @property
    def implementors(self) -> DataFrame:
        """Project types named in `implements`, as written, by classes."""
        refs = self.classes.filter("kind = 'class' and size(implements) > 0").select(
            "path", "class_ord", F.col("fqn").alias("src"), "package", "import_paths", F.posexplode("implements").alias("ord", "name")
        )
        return self._resolve(refs, ["path", "class_ord", "ord"])

    @cached_property
    def redirects(self) -> DataFrame:
        """Interfaces with one implementing class; read once per level of a trace."""
        return written(flows.sole_implementors(self.implementors), "redirects")

    # -- classification -----------------------------------------------------------------
    @property
    def categories(self) -> DataFrame:
        return external.file_categories(self.parsed)

    @property
    def external_systems(self) -> DataFrame:
        return external.external_systems(self.parsed)

    @property
    def external_roots(self) -> DataFrame:
        return external.external_roots(self.parsed)

    @property
    def layer_breakdown(self) -> DataFrame:
        return components.layer_breakdown(self.symbols)

    @cached_property
    def component_edges(self) -> DataFrame:
        return components.component_edges(self.edges, self.symbols, self.categories)

    @property
    def component_mermaid(self) -> DataFrame:
        return mermaid.graph_text(mermaid.graph_lines(self.component_edges))

    # -- flows, cards, fingerprints ---------------------------------------------------------
    @cached_property
    def flows(self) -> DataFrame:
        built = flows.build_flows(
            self.classes, self.symbols, self.meaningful_calls, self.methods, self.redirects, self.categories
        )
        return written(built, "flows")

    @cached_property
    def ranked(self) -> DataFrame:
        return written(cards.ranking(self.symbols, self.edges), "ranked")

    @property
    def cards(self) -> DataFrame:
        return cards.class_cards(self.classes, self.ranked, self.edges)

    def cards_of(self, few: DataFrame) -> DataFrame:
        return cards.class_cards(self.classes, self.ranked, self.edges, few)

    @property
    def fingerprints(self) -> DataFrame:
        return prints.fingerprints(
            self.classes, self.symbols, self.packages, self.edges, self.package_edges,
            self.external_roots, self.external_systems, self.flows,
        )
