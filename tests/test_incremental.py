"""Kept edges, calls and digests against analysing everything anew."""

from pyspark.sql import functions as F
from support import HARBOUR, git, values

from sourceloom.config import load_config
from sourceloom.operators import fingerprints as prints
from sourceloom.plans.analysis import Analysis
from sourceloom.plans.incremental import Graph
from sourceloom.plans.runs import Runner
from sourceloom.session import scratch
from sourceloom.sources import buckets
from sourceloom.sources.buckets import BucketTable, touched

EDGE = ["src", "dst", "kind_mask", "dst_package", "dst_layer"]
CALL = ["path", "class_ord", "method_ord", "call_ord", "caller_class", "caller_method", "callee_class", "callee_method", "callee_layer"]
SHIP, BERTHING = "quay/ship/Ship.java", "quay/berth/Berthing.java"


def same_as_anew(graph, parse, sources, digests=False):
    anew = Analysis(parse(sources))
    assert values(graph.dependency_edges, *EDGE) == values(anew.edges, *EDGE)
    assert values(graph.calls.rows(), *CALL) == values(anew.calls, *CALL)
    assert values(graph.pairs.rows(), "src_package", "dst_package") == values(anew.package_edges, "src_package", "dst_package")
    assert values(graph.packages.rows(), "package", "n") == values(anew.packages, "package", "class_count")
    if digests:
        assert values(graph.analysis().fingerprints, "doc", "hash") == values(anew.fingerprints, "doc", "hash")


def test_graph_follows_edits(spark, parse):
    sources = dict(HARBOUR)
    graph = Graph.build(parse(sources))

    # A second Flag: Ship, which names one, is resolved again though nobody touched it.  Crane has a method more.
    edit = {"quay/crane/Flag.java": "package org.quay.crane; public record Flag(int x) {}", "quay/crane/Slot.java": "package org.quay.crane; public record Slot(int row) { void lift() {} }"}
    sources |= edit
    graph, again = graph.update(parse(edit))
    assert {r["path"] for r in again.collect()} == {*edit, SHIP}
    same_as_anew(graph, parse, sources)

    # An interface goes, and so does one of the two Slots and one of the two Flags; a path that never was changes nothing.
    gone = [BERTHING, *edit, "no/such/File.java"]
    sources = {p: s for p, s in sources.items() if p not in gone}
    graph, again = graph.update(parse(HARBOUR).limit(0), spark.createDataFrame([(p,) for p in gone], "path string"))
    assert {r["path"] for r in again.collect()} == {*gone, SHIP, "quay/berth/DeepBerth.java", "quay/berth/TidalBerth.java", "quay/control/TowerController.java"}
    same_as_anew(graph, parse, sources)

    # By what was kept: an edit of a body alone concerns its own file only.
    edit = {SHIP: HARBOUR[SHIP].replace("flag.name() + draught", "flag.name()")}
    graph, again = Graph.load(spark, graph.manifest()).update(parse(edit))
    assert {r["path"] for r in again.collect()} == {SHIP}
    same_as_anew(graph, parse, sources | edit, digests=True)


def test_buckets_are_pruned_and_replaced(spark, tmp_path, monkeypatch):
    rows = spark.range(200).selectExpr("cast(id as string) as path", "id")
    table = BucketTable.build(rows, f"file://{tmp_path}", "t", "path")
    some = touched(rows.filter("id < 2"), "path")
    plan = table.rows(some)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    files = table.rows(some).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("bucket=")[1].split("/")[0] for r in files} == {str(b) for b in some}
    after = table.replaced(some, table.rows(some).filter("id >= 2"))
    assert sorted(r["id"] for r in after.rows().collect()) == list(range(2, 200))
    assert sorted(r["id"] for r in table.rows().collect()) == list(range(200))
    assert after.rows([]).collect() == [] and after.replaced([], rows) is after
    assert sorted(r["id"] for r in after.of(spark.createDataFrame([("7",), ("1",)], "path string")).collect()) == [7]
    monkeypatch.setattr(buckets, "MAX_TABLES", 3)
    for k in range(4):  # parts don't pile up
        after = after.replaced([k], after.rows([k]))
    assert len(set(after.parts.values())) <= 3 and after.rows().count() == 198


def test_digests_are_sums(spark):
    some = spark.createDataFrame([("a", 1), ("b", None)], "x string, y int")
    more = spark.createDataFrame([("c", 3)], "x string, y int")

    def whole(df):
        return prints.set_digest(df, "x", "y").first()[0]

    def told(lanes):
        return spark.range(1).select(prints.lanes_digest(lanes.get("p"))).first()[0]

    one, two = (prints.lanes_of([prints.bag(df, "p", 1, "x", "y")]) for df in (some, more))
    both = prints.added(one, two)
    assert told(both) == whole(some.union(more)) and told(one) == whole(some)
    assert told(prints.added(both, prints.lanes_of([prints.bag(some, "p", -1, "x", "y")]))) == whole(more)
    assert told(prints.added(two, prints.lanes_of([prints.bag(more, "p", -1, "x", "y")]))) == told({}) == whole(more.limit(0))


def test_runs_with_a_kept_graph(spark, worktree, echo, tmp_path):
    """Documents and digests as without one; tables that nothing refers to any more are deleted."""
    config = load_config(None, {"state_dir": f"file://{tmp_path}/state"})
    with scratch(spark):
        runner = Runner(spark, worktree, config, echo(), keep_graph=True)
        runner.full()
        (worktree / BERTHING).unlink()
        (worktree / SHIP).write_text(HARBOUR[SHIP].replace("String callSign", "Object callSign"))
        git(worktree, "add", "-A")
        summary = runner.update()
        assert (summary.files_parsed, summary.files_removed) == (1, 1)
        state = runner.store.load()
        plain = Runner(spark, worktree, load_config(None, {"state_dir": f"file://{tmp_path}/other"}), echo())
        plain.full()
        assert state.fingerprints == plain.store.load().fingerprints
    assert {p.name for p in (tmp_path / "state").iterdir() if p.is_dir()} == state.tables
