"""Edges and calls kept up to date by what an edit changes.

Beside the parsed files lie tables that say what follows from them: the declarations by simple
name, an index from every key that some file's names could mean to that file, the resolved
references and calls of every file, and for every class edge how many references of each
kind stand behind it.

An edit of some files changes the meaning of few keys: those of names they declare, or declared.
Only files that were edited or that the index names for such a key are resolved
again; their former references count -1, their present ones +1, and an edge is gone when
nothing stands behind it any more.  All tables are in buckets, and a bucket that
nothing of this falls into is neither read nor written.

Digests of what the documents show are sums over rows, so rows that go are subtracted and rows
that come added; the sets themselves aren't read again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.functions.naming import last_segment
from sourceloom.operators import calls, dependencies, resolve, symbols, tables
from sourceloom.operators import fingerprints as prints
from sourceloom.plans.analysis import Analysis
from sourceloom.session import shared_folder, written
from sourceloom.sources.buckets import BucketTable, side_by_side, touched

_KEYS = {"parsed": "path", "declared": "name", "wanted": "key", "resolved": "path", "calls": "path", "edges": "src", "packages": "package", "pairs": "src_package"}
_EDGE = ["src", "dst", "dst_package", "dst_layer"]
_COUNTS = [f"n_{k}" for k in dependencies.KINDS]


def dictionary_of(declared: DataFrame) -> DataFrame:
    """What the names declared by these rows mean; exact where all declarations of each simple name are among them."""
    syms = symbols.symbols(declared)
    return resolve.dictionary(syms, symbols.unique_names(syms))


def changed_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys of two dictionaries that mean something else, or nothing any more, or something at last."""
    meaning = F.struct("target", "target_package", "target_kind", "target_layer")
    both = before.select("key", meaning.alias("a")).join(after.select("key", meaning.alias("b")), "key", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("key")


def edge_counts(resolved: DataFrame, sign: Column) -> DataFrame:
    """Signed numbers of references behind each edge, one column for each kind."""
    of_kind = [F.sum(F.when(F.col("kind") == 1 << i, sign).otherwise(0)).alias(c) for i, c in enumerate(_COUNTS)]
    ends = [F.col("target").alias("dst"), F.col("target_package").alias("dst_package"), F.col("target_layer").alias("dst_layer")]
    return resolved.filter(F.col("src") != F.col("target")).groupBy("src", *ends).agg(*of_kind)


def _present(counts: DataFrame) -> DataFrame:
    return counts.filter(" or ".join(f"{c} <> 0" for c in _COUNTS))


def _name_of(key: Column) -> Column:
    """Simple name that a key's meaning depends on."""
    return last_segment(F.substring(key, 3, 1 << 30))


@dataclass(frozen=True)
class Graph:
    """The tables; `edges` has one row per class edge and fact of its end."""

    parsed: BucketTable
    declared: BucketTable
    wanted: BucketTable
    resolved: BucketTable
    calls: BucketTable
    edges: BucketTable
    packages: BucketTable  # package, n: its declarations
    pairs: BucketTable  # src_package, dst_package, n: class edges between the two
    lanes: prints.Lanes

    # -- from scratch ---------------------------------------------------------------
    @classmethod
    def build(cls, parsed: DataFrame, folder: str | None = None) -> Graph:
        """All tables of a parsed tree, below `folder` (the shared one if not given)."""
        folder = folder or f"{shared_folder(parsed.sparkSession).rstrip('/')}/sourceloom-graph"

        def table(name: str, rows: DataFrame) -> BucketTable:
            return BucketTable.build(rows, folder, name, _KEYS[name])

        files = table("parsed", parsed)
        classes = written(tables.classes(files.rows()), "classes")
        found, sites = _references(classes)
        declared, wanted = side_by_side(lambda: table("declared", declarations(classes)), lambda: table("wanted", _pairs(found, sites)))
        names = written(dictionary_of(declared.rows()), "names")
        resolved, called, packages = side_by_side(
            lambda: table("resolved", resolve.resolve(found, names, dependencies.REFERENCE)),
            lambda: table("calls", calls.call_edges(tables.call_sites(classes), resolve.resolve(sites, names, calls.CALL_ORDER))),
            lambda: table("packages", declared.rows().groupBy("package").agg(F.count(F.lit(1)).alias("n"))),
        )
        edges = table("edges", edge_counts(resolved.rows(), F.lit(1).cast("long")))
        pairs = table("pairs", package_pairs(edges.rows(), declared.rows()))
        lanes = prints.lanes_of([*symbol_bags(declared.rows(), 1), prints.bag(edges.rows(), "edges", 1, "src", "dst"), *count_bags(packages.rows(), pairs.rows(), 1)])
        return cls(files, declared, wanted, resolved, called, edges, packages, pairs, lanes)

    # -- what they say ----------------------------------------------------------------
    @property
    def dependency_edges(self) -> DataFrame:
        """src, dst, kind_mask and facts of dst, as `dependencies.dependency_edges` gives them: no shuffle."""
        bits = [F.when(F.col(c) > 0, 1 << i).otherwise(0) for i, c in enumerate(_COUNTS)]
        mask = bits[0]
        for b in bits[1:]:
            mask = mask.bitwiseOR(b)
        return self.edges.rows().select(*_EDGE, mask.alias("kind_mask"))

    def analysis(self) -> Analysis:
        """The analysis of the tree with symbols, edges, calls and digests as they are here."""
        return _Kept(self)

    def fingerprints(self, roots: DataFrame, systems: DataFrame, flows: DataFrame) -> DataFrame:
        """(doc, hash) as `fingerprints.fingerprints` gives them; of sets only the stored sums are looked at."""
        sets = {p: prints.lanes_digest(self.lanes.get(p)) for p in ("packages", "names", "public", "layers", "shapes", "edges", "package pairs")}
        return prints.document_hashes(sets, roots, systems, flows)

    # -- after an edit ----------------------------------------------------------------
    def update(self, edited: DataFrame, removed: DataFrame | None = None) -> tuple[Graph, DataFrame]:
        """The graph after `edited` (parsed rows of new and changed files) and `removed` (path), and the paths resolved again.

        A path in both is taken as edited.  Removing what isn't there changes nothing.
        """
        edited = written(edited.select(*self.parsed.schema.names), "edited")
        paths = edited.select("path")
        paths = written((paths if removed is None else paths.union(removed.select("path"))).distinct(), "edited-paths")
        in_paths = touched(paths, "path")
        earlier = written(self.parsed.rows(in_paths).join(paths, "path", "left_semi"), "edited-before")
        parsed = self.parsed.replaced(in_paths, self.parsed.rows(in_paths).join(paths, "path", "left_anti").unionByName(edited))

        old_classes, new_classes = tables.classes(earlier), tables.classes(edited)
        old_facts, new_facts = declarations(old_classes), declarations(new_classes)
        lost, gained = written(old_facts.exceptAll(new_facts), "facts-lost"), written(new_facts.exceptAll(old_facts), "facts-gained")
        names = written(lost.select("name").union(gained.select("name")).distinct(), "names-changed")
        in_names = touched(names, "name")
        declared = self.declared.replaced(in_names, self.declared.rows(in_names).exceptAll(lost).unionByName(gained))
        before, after = (written(t.rows(in_names).join(names, "name", "left_semi").select(*t.schema.names), "declared-of-names") for t in (self.declared, declared))
        keys = written(changed_keys(dictionary_of(before), dictionary_of(after)), "keys-changed")
        again = written(self.wanted.of(keys).select("path").union(paths).distinct(), "paths-resolved")

        in_again = touched(again, "path")
        classes = written(tables.classes(parsed.rows(in_again).join(again, "path", "left_semi").select(*parsed.schema.names)), "classes-resolved")
        found, sites = _references(classes)
        meant = found.select(_name_of(F.col("key")).alias("name")).union(sites.select(_name_of(F.col("key")).alias("name")))
        meaning = written(dictionary_of(declared.of(written(meant.distinct(), "names-meant"))), "names")
        resolved_now = written(resolve.resolve(found, meaning, dependencies.REFERENCE), "resolved-now").select(*self.resolved.schema.names)
        calls_now = calls.call_edges(tables.call_sites(classes), resolve.resolve(sites, meaning, calls.CALL_ORDER))
        former = self.resolved.rows(in_again)
        signed = resolved_now.withColumn("sign", F.lit(1).cast("long")).unionByName(former.join(again, "path", "left_semi").withColumn("sign", F.lit(-1).cast("long")))
        moved = written(_present(edge_counts(signed, F.col("sign"))), "edges-moved")
        in_edges = touched(moved, "src")
        sums = self.edges.rows(in_edges).unionByName(moved).groupBy(*_EDGE).agg(*(F.sum(c).alias(c) for c in _COUNTS))

        edges = self.edges.replaced(in_edges, _present(sums))

        kept = lambda t: t.rows(in_again).join(again, "path", "left_anti").select(*t.schema.names)
        old_pairs, new_pairs = _pairs(*_references(old_classes)), _pairs(*_references(new_classes))
        less, more = written(old_pairs.exceptAll(new_pairs), "wanted-less"), written(new_pairs.exceptAll(old_pairs), "wanted-more")
        in_keys = touched(less.select("key").union(more.select("key")), "key")
        wanted = self.wanted.rows(in_keys).join(less, ["key", "path"], "left_anti").unionByName(more)

        # Classes whose edges moved, or whose own package may have: what their edges were, and what they are.
        sources = written(moved.select("src").union(before.select("fqn")).union(after.select("fqn")).distinct(), "sources-moved")
        edges_before, edges_after = (written(t.of(sources), "edges-of-sources") for t in (self.edges, edges))
        source_names = written(sources.select(last_segment(F.col("src")).alias("name")).distinct(), "source-names")
        gone, come = (package_pairs(e, t.of(source_names)) for e, t in ((edges_before, self.declared), (edges_after, declared)))
        pairs, pair_bags = _recounted(self.pairs, ["src_package", "dst_package"], gone, come, "package pairs")
        per_package = [rows.groupBy("package").agg(F.count(F.lit(1)).alias("n")) for rows in (lost, gained)]
        packages, package_bags = _recounted(self.packages, ["package"], *per_package, "packages")
        change = prints.lanes_of([
            *symbol_bags(before, -1), *symbol_bags(after, 1), *pair_bags, *package_bags,
            prints.bag(edges_before, "edges", -1, "src", "dst"), prints.bag(edges_after, "edges", 1, "src", "dst"),
        ])
        index, resolved, called = side_by_side(
            lambda: self.wanted.replaced(in_keys, wanted),
            lambda: self.resolved.replaced(in_again, kept(self.resolved).unionByName(resolved_now)),
            lambda: self.calls.replaced(in_again, kept(self.calls).unionByName(calls_now)),
        )
        graph = Graph(parsed, declared, index, resolved, called, edges, packages, pairs, prints.added(self.lanes, change))
        return graph, again

    # -- keeping it -------------------------------------------------------------------
    def manifest(self) -> str:
        """What `load` needs: where every bucket of every table lies, and the sums."""
        told = {n: {"folder": t.folder, "schema": t.schema.json(), "parts": t.manifest()} for n in _KEYS for t in [getattr(self, n)]}
        return json.dumps({"tables": told, "lanes": {p: list(map(str, v)) for p, v in self.lanes.items()}})

    @classmethod
    def load(cls, spark: SparkSession, manifest: str) -> Graph:
        said = json.loads(manifest)
        kept = {
            n: BucketTable(spark, t["folder"], n, _KEYS[n], T.StructType.fromJson(json.loads(t["schema"])), {int(b): p for b, p in t["parts"].items()})
            for n, t in said["tables"].items()
        }
        return cls(**kept, lanes={p: list(map(int, v)) for p, v in said["lanes"].items()})


class _Kept(Analysis):
    """An analysis that reads from a graph what it holds."""

    def __init__(self, graph: Graph):
        super().__init__(graph.parsed.rows(), is_written=True)
        self.graph = graph

    @cached_property
    def symbols(self) -> DataFrame:
        return written(symbols.symbols(self.graph.declared.rows()), "symbols")

    @cached_property
    def edges(self) -> DataFrame:
        return written(dependencies.with_source(self.graph.dependency_edges, self.symbols), "edges")

    @property
    def calls(self) -> DataFrame:
        return self.graph.calls.rows()

    @property
    def fingerprints(self) -> DataFrame:
        return self.graph.fingerprints(self.external_roots, self.external_systems, self.flows)


def declarations(classes: DataFrame) -> DataFrame:
    """Facts and shape of every class."""
    return tables.class_facts(classes).join(prints.shapes(classes).hint("merge"), ["path", "class_ord"])


def symbol_bags(declared: DataFrame, sign: int) -> list[DataFrame]:
    """The sets of names, public names, layers and shapes, of all declarations of some simple names."""
    syms = symbols.symbols(declared)
    shown = declared.join(syms.select("path", "class_ord").hint("merge"), ["path", "class_ord"], "left_semi")
    return [
        prints.bag(syms, "names", sign, "fqn"), prints.bag(syms.filter("is_public"), "public", sign, "fqn"),
        prints.bag(syms, "layers", sign, "fqn", "layer"), prints.bag(shown, "shapes", sign, "shape"),
    ]


def count_bags(packages: DataFrame, pairs: DataFrame, sign: int) -> list[DataFrame]:
    return [prints.bag(packages, "packages", sign, "package"), prints.bag(pairs, "package pairs", sign, "src_package", "dst_package")]


def package_pairs(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """(src_package, dst_package, n): class edges between different packages."""
    between = dependencies.with_source(edges.select("src", "dst_package"), symbols.symbols(declared)).filter(F.col("src_package") != F.col("dst_package"))
    return between.groupBy("src_package", "dst_package").agg(F.count(F.lit(1)).alias("n"))


def _recounted(table: BucketTable, by: list[str], gone: DataFrame, come: DataFrame, part: str) -> tuple[BucketTable, list[DataFrame]]:
    """`table` (by, n) after some counts went and some came, and which rows that took away or brought."""
    signed = gone.withColumn("n", -F.col("n")).unionByName(come).groupBy(*by).agg(F.sum("n").alias("n")).filter("n <> 0")
    signed = written(signed, f"{table.name}-moved")
    buckets = touched(signed, table.key)
    both = table.rows(buckets).select(*by, F.col("n").alias("n"), F.lit(1).alias("was")).unionByName(signed.select(*by, "n", F.lit(0).alias("was")))
    sums = written(both.groupBy(*by).agg(F.sum("n").alias("n"), F.max("was").alias("was")), f"{table.name}-sums")
    bags = [prints.bag(sums.filter("was = 1 and n = 0"), part, -1, *by), prints.bag(sums.filter("was = 0 and n > 0"), part, 1, *by)]
    return table.replaced(buckets, sums.filter("n > 0").select(*by, "n")), bags


def _references(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate keys of type names and of receivers."""
    return resolve.candidates(dependencies.references(classes)), resolve.candidates(calls.receiver_references(tables.call_sites(classes)))


def _pairs(found: DataFrame, sites: DataFrame) -> DataFrame:
    return found.select("key", "path").union(sites.select("key", "path")).distinct()
