"""Plans are the ones meant: pruned scans, groups cut before the shuffle, no products of tables."""

import pytest
from pyspark.sql import functions as F

from rendered.star import port_corpus, star_corpus
from rendered.yard import yard_corpus
from sourceloom.operators import calls, cards, components, dependencies, mermaid, resolve
from sourceloom.operators.skew import HOT_ROWS, first_per_group, hot_keys, lookup_join
from sourceloom.plans.analysis import Analysis
from sourceloom.plans.context import shortlist
from sourceloom.sources.parse import parse_files
from support import values


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df):
    """Everything the scans of a plan read."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return " ".join(line for line in text.split("\n") if line.startswith("ReadSchema"))


@pytest.fixture
def wide(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_scans_read_what_they_need(harbour, wide):
    read = read_columns(dependencies.references(harbour.classes))
    assert "creates" in read and "return_type" in read
    for unread in ("doc_comment", "calls", "annotation", "start_line"):
        assert unread not in read, unread
    read = read_columns(calls.receiver_references(harbour.call_sites))
    assert "receiver" in read
    for unread in ("doc_comment", "creates", "annotation", "return_type", "start_line"):
        assert unread not in read, unread
    read = read_columns(harbour.packages)
    assert "methods" not in read and "fields" not in read


def test_groups_are_cut_before_the_shuffle(harbour):
    for df in (
        first_per_group(harbour.edges, ["dst"], [F.col("src")], 40),
        calls.calls_by_caller(harbour.calls, 12),
        shortlist(harbour.ranked),
        components.layer_breakdown(harbour.symbols),
    ):
        assert "WindowGroupLimit" in plan(df)


def test_no_products_of_tables(harbour):
    found = resolve.candidates(dependencies.references(harbour.classes))
    for df in (
        resolve.resolve(found, harbour.names, dependencies.REFERENCE),
        resolve.resolve(found, harbour.names, dependencies.REFERENCE, hot=["F:Ship"]),
        harbour.external_roots, harbour.external_systems, harbour.component_edges, harbour.cards, harbour.ranked,
        mermaid.graph_lines(harbour.edges.select("src", "dst")), harbour.fingerprints,
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_hot_rows_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = spark.range(100).withColumn("k", F.col("id").cast("string")), spark.range(9).select(F.col("id").cast("string").alias("k"))
        hot, cold = plan(lookup_join(left, right, "k", hot=["1"])), plan(lookup_join(left, right, "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in hot and "SortMergeJoin" in hot
    assert "BroadcastHashJoin" not in cold


def test_growing_sides_are_not_broadcast(spark, harbour):
    """Written tables of a tree are small as files long after their rows stop being so."""
    small = spark.range(9).select(F.col("id").cast("string").alias("k"))
    found = resolve.candidates(dependencies.references(harbour.classes))
    for df in (
        lookup_join(small, small.withColumn("v", F.lit(1)), "k"),
        resolve.resolve(found, harbour.names, dependencies.REFERENCE),
        dependencies.with_source(harbour.edges.select("src", "dst"), harbour.symbols),
        cards.ranking(harbour.symbols, harbour.edges),
        harbour.cards,
    ):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


def test_hot_names_are_looked_for_unless_rows_are_few(harbour):
    a = Analysis(harbour.parsed, is_written=True)
    rows = a.names.sparkSession.range(HOT_ROWS + 1).select(F.lit("F:Ship").alias("key"))
    assert a.hot(rows, "key") == ["F:Ship"] and a.hot(rows.limit(9), "key") is None


@pytest.mark.parametrize("corpus, kinds", [(star_corpus, 2), (port_corpus, 3), (yard_corpus, 1)])
def test_files_to_parse_are_dealt_to_all_tasks(spark, tmp_path, corpus, kinds):
    """A table in one row group is read by one task however many splits it has; its files are parsed by all."""
    n, key = 4_000, F.col("id")
    tables = {
        "region": spark.range(2).select(key.alias("r_regionkey")),
        "nation": spark.range(2).select(key.alias("n_nationkey"), key.alias("n_regionkey")),
        "supplier": spark.range(n).select(key.alias("s_suppkey"), (key % 2).alias("s_nationkey")),
        "customer": spark.range(n).select(key.alias("c_custkey"), (key % 2).alias("c_nationkey")),
        "part": spark.range(n).select(key.alias("p_partkey"), (key % 50).alias("p_size")),
        "orders": spark.range(n).select(key.alias("o_orderkey")),
        "lineitem": spark.range(n).select(key.alias("l_orderkey"), key.alias("l_suppkey")),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    settings = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        files = corpus(spark, str(tmp_path))
        per_task = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert max(per_task) < n / 2 and sum(per_task) >= kinds * n


@pytest.mark.parametrize("corpus", [star_corpus, yard_corpus])
def test_tasks_get_files_of_all_kinds(spark, tmp_path, corpus):
    """Suppliers are few beside customers and orders; on their own they would make tasks with next to nothing in them."""
    n, key = 4_000, F.col("id")
    tables = {
        "region": spark.range(1).select(key.alias("r_regionkey")),
        "nation": spark.range(1).select(key.alias("n_nationkey"), key.alias("n_regionkey")),
        "supplier": spark.range(n // 100).select(key.alias("s_suppkey"), F.lit(0).alias("s_nationkey")),
        "customer": spark.range(n).select(key.alias("c_custkey"), F.lit(0).alias("c_nationkey")),
        "orders": spark.range(n).select(key.alias("o_orderkey")),
        "lineitem": spark.range(n).select(key.alias("l_orderkey"), (key % (n // 100)).alias("l_suppkey")),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    files = corpus(spark, str(tmp_path))
    per_task = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(c < max(per_task) / 2 for c in per_task) <= 2  # files that are one of a kind


def test_candidates_are_made_for_hot_names_only(spark):
    row = "name string, package string, import_paths array<string>"
    rare = [(f"N{i}", "p", []) for i in range(400)]
    refs = spark.createDataFrame([("Ship", "p", ["a.Ship"]), ("a.Ship", "q", []), *rare] * 50, row)
    found = resolve.candidates(refs)
    assert sorted(resolve.hot_candidate_keys(refs, 60)) == sorted(hot_keys(found, "key", 60)) == ["F:a.Ship", "S:Ship"]
    assert resolve.hot_candidate_keys(refs, 200) == []
    names = spark.createDataFrame([("S:Ship", "a.Ship", "a", "class", None)], "key string, target string, target_package string, target_kind string, target_layer string")
    apart = plan(resolve.resolve(found, names, ["name"], ["S:Ship"])).split("Union")[1].split("Generate")
    assert sum("substring_index(name" in part and "Filter" in part for part in apart) >= 1


def test_names_shared_by_files_are_resolved_once(analyse, monkeypatch):
    """Files of a package that write the same name with the same import ask the same."""
    users = {f"u/U{i}.java": f"package u; import b.Ship; class U{i} {{ Ship s; Dock d; void go() {{ s.sail(); }} }}" for i in range(20)}
    a = analyse({"b/Ship.java": "package b; class Ship { void sail() {} }", "u/Dock.java": "package u; class Dock {}", **users})
    made, inner = [], resolve.candidates
    monkeypatch.setattr(resolve, "candidates", lambda refs, *rest: made.append(refs.count()) or inner(refs, *rest))
    assert a.edges.count() == 40 and a.calls.filter("callee_class = 'b.Ship'").count() == 20
    assert sum(made) == 3  # Ship and Dock in u for the edges, Ship in u for the calls


def test_rows_of_a_path_that_comes_twice_are_told_once(spark):
    """Two files under one path: a place in the tree is told once, as one of them has it."""
    text = "package p; class User { Ship s; Ship t; void go() { s.sail(); t.sail(); } }"
    sources = [("p/Ship.java", b"package p; class Ship { void sail() {} }"), ("p/User.java", text.encode()), ("p/User.java", text.encode())]
    twice = Analysis(parse_files(spark.createDataFrame(sources, "path string, content binary")))
    asked = resolve.asking(dependencies.references(twice.classes))
    old = resolve.resolve(resolve.candidates(dependencies.references(twice.classes)), twice.names, dependencies.REFERENCE)
    new = resolve.told(asked, resolve.answers(resolve.questions(asked), twice.names), dependencies.REFERENCE, is_unique=False)
    assert not twice._has_paths_once and values(new, *old.columns) == values(old, *old.columns) and old.count() == 1
    assert twice.calls.filter("callee_class = 'p.Ship'").count() == 2


def test_questions_tell_imports_and_packages_apart(spark):
    row = "path string, name string, package string, import_paths array<string>"
    refs = spark.createDataFrame(
        [("1", "Ship", "p", ["a.Ship"]), ("2", "Ship", "p", ["b.Ship"]), ("3", "Ship", "p", ["x.Y", "a.Ship"]), ("4", "Ship", "q", []),
         ("5", "Ship", None, []), ("6", "Ship", "", []), ("7", None, "p", []), ("8", "Ship", "p", None)], row)
    names = spark.createDataFrame(
        [(f"F:{c}", c, c[0], "class", None) for c in ("a.Ship", "b.Ship", "q.Ship")] + [("S:Ship", "z.Ship", "z", "class", None)],
        "key string, target string, target_package string, target_kind string, target_layer string",
    )
    asked = resolve.asking(refs)
    each, old = resolve.questions(asked), resolve.resolve(resolve.candidates(refs), names, ["path"])
    for hot in (None, [r["question"] for r in each.limit(2).collect()]):
        new = resolve.told(asked, resolve.answers(each, names), ["path"], is_unique=True, hot=hot)
        assert values(new, *old.columns) == values(old, *old.columns)
    assert dict(old.select("path", "target").collect()) == {"1": "a.Ship", "2": "b.Ship", "3": "a.Ship", "4": "q.Ship", "5": "z.Ship", "6": "z.Ship"}


def test_joins_on_names_sort_by_a_hash(spark):
    key = F.concat(F.lit("yard.orders.Order"), F.col("id").cast("string")).alias("k")
    text = plan(lookup_join(spark.range(9).select(key), spark.range(9).select(key, F.lit(1).alias("v")), "k"))
    assert "[_key_hash" in text and "SortMergeJoin" in text
