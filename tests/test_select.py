"""Budgets, cards, prompts: against plain loops and by hand."""

import random

import pytest
from support import values
from pyspark.sql import functions as F

from sourceloom.documents import prompts
from sourceloom.functions import text
from sourceloom.operators.cards import render_card
from sourceloom.operators.select import fit_to_budget, select_with_coverage
from sourceloom.operators.skew import first_per_group, hot_keys, lookup_join
from sourceloom.plans.context import ProjectContext


def greedy(groups, budget, max_count):
    """Shared-budget selection as a plain loop over {label: [cost, ...]}."""
    groups = {k: v for k, v in groups.items() if v}
    kept, chars, count = {}, 0, 0
    for label, costs in groups.items():
        chars += max(budget // len(groups), 1)
        count += 10**9 if max_count is None else max(max_count // len(groups), 1)
        n = used = 0
        while n < min(len(costs), count) and (n == 0 or used + costs[n] <= chars):
            used, n = used + costs[n], n + 1
        kept[label], chars, count = n, max(chars - used, 0), max(count - n, 0)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_coverage_equals_plain_loop(spark, seed):
    rng = random.Random(seed)
    labels = ["a", "b", "c", "d"]
    groups = {g: [rng.randint(1, 60) for _ in range(rng.choice([0, 1, 5, 30]))] for g in labels}
    groups["b"] = groups["b"] or [500]
    rows = [(g, i, c) for g, costs in groups.items() for i, c in enumerate(costs)]
    df = spark.createDataFrame(rows, "g string, i int, cost bigint")
    for budget, limit in [(200, None), (1, None), (2000, 9), (90, 3)]:
        got = select_with_coverage(df, "g", labels, [F.asc("i")], "cost", budget, limit)
        counts = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
        assert counts == greedy(groups, budget, limit), (budget, limit)


def test_coverage_of_nothing(spark):
    df = spark.createDataFrame([], "g string, i int, cost bigint")
    assert select_with_coverage(df, "g", ["a"], [F.asc("i")], "cost", 10).count() == 0


def test_fit_to_budget(spark):
    df = spark.createDataFrame([("a", 1, 50), ("a", 2, 1), ("b", 1, 4), ("b", 2, 6), ("b", 3, 1)], "g string, i int, cost bigint")
    kept = lambda **o: values(fit_to_budget(df, ["g"], [F.asc("i")], "cost", 10, **o), "g", "i")
    assert kept() == [("a", 1), ("b", 1), ("b", 2)]
    assert kept(force_first=False) == [("b", 1), ("b", 2)]


def test_costs_of_nothing_fit_without_limit(spark):
    df = spark.range(3000).select(F.lit("a").alias("g"), "id", F.when(F.col("id") == 2999, 5).otherwise(0).cast("bigint").alias("cost"))
    assert fit_to_budget(df, ["g"], [F.asc("id")], "cost", 4).count() == 2999
    two = spark.range(20_000).select(F.lit("a").alias("g"), "id", F.lit(2).cast("bigint").alias("cost"))
    assert fit_to_budget(two, ["g"], [F.asc("id")], "cost", 40_000).count() == 20_000


@pytest.mark.parametrize("cost", ["-1", "CAST(NULL AS BIGINT)"])
def test_costs_below_nothing_are_errors(spark, cost):
    df = spark.range(3).select(F.lit("a").alias("g"), "id", F.expr(cost).cast("bigint").alias("cost"))
    with pytest.raises(Exception, match="NULL or below"):
        fit_to_budget(df, ["g"], [F.asc("id")], "cost", 4).collect()


def test_first_per_group_above_the_native_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    got = first_per_group(df, ["g"], [F.desc("id")], 1500)
    assert got.count() == 3000 and got.agg(F.min("id")).first()[0] == 2000
    assert got.filter("rank = 1").select("id").distinct().count() == 2


def test_lookup_join_with_hot_keys(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    left = left.unionByName(spark.createDataFrame([(None, -1)], "k string, id bigint"))
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("5000", 3)], "k string, v int")
    hot = hot_keys(left, "k", 500)
    assert hot == ["hot"]
    for how in ("inner", "left"):
        columns = ["k", "id", "v"]
        assert values(lookup_join(left, right, "k", how, hot), *columns) == values(left.join(right, "k", how), *columns)


# -- text functions -------------------------------------------------------------------


@pytest.mark.parametrize(
    "doc, line",
    [
        (None, None), ("", None), ("/** One. */", "One."), ("/**\n * First line.\n * Second.\n */", "First line."), ("/** @see X */", None),
        ("/**\n *\n * @a\n *   Then this. \n */", "Then this."), ("/***/", None), ("/** *bold* */", "bold*"), ("/** a\r\n * b */", "a"),
        ("/**\n *@x y\n * * z  \n */", "* z"), ("/** \u00a0é\u2028b */", "é"), ("/**\n ** @y\n ***  w */", "w"), ("/** a @b */", "a @b"),
    ],
)
def test_first_line(spark, doc, line):
    df = spark.createDataFrame([(doc,)], "d string")
    assert df.select(text.first_line(F.col("d"))).first()[0] == line


def test_list_texts(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "x array<string>")
    rows = df.select(text.capped(F.col("x"), 2), text.truncated_list(F.col("x"), 2)).collect()
    assert [tuple(r) for r in rows] == [(["a", "b", "... (1 more not shown)"], "a, b, and 1 more"), (["a"], "a"), ([], "")]


def test_thinking_and_budget(spark):
    df = spark.createDataFrame([("<think>a\nb</think> x <think>c</think> ",)], "t string")
    assert df.select(text.strip_thinking(F.col("t"))).first()[0] == "x"
    sizes = spark.createDataFrame([(8192,), (10,), (4097,)], "n int").select(text.detail_chars(F.col("n"))).collect()
    assert [r[0] for r in sizes] == [12288, 1500, 6144]


# -- cards and prompts -----------------------------------------------------------------


@pytest.fixture(scope="module")
def domain_heavy(analyse):
    fields = "".join(f" private String field{i};" for i in range(32))
    files = {f"m/E{i:02}.java": f"package m; /** Entity {i}. */ @Entity public class E{i:02} {{{fields} }}" for i in range(80)}
    files["m/E00.java"] = "package m; @Entity public class E00 { }"
    files["w/C.java"] = "package w; import s.Svc; @RestController public class C { private Svc svc; @GetMapping(\"/x\") public m.E01 get() { return svc.find(); } }"
    files["s/Svc.java"] = "package s; import r.Repo; @Service public class Svc { private Repo repo; m.E01 find() { repo.load(); } }"
    files["r/Repo.java"] = "package r; import java.sql.Connection; @Repository public class Repo { void load() { } }"
    files["u/Util.java"] = "package u; class Util { " + "".join(f"static void m{i}() {{ }} " for i in range(45)) + "}"
    return analyse(files)


@pytest.fixture(scope="module")
def small_context(domain_heavy):
    return ProjectContext(domain_heavy, "heavy", ["java"], 5_000)


def test_cards(domain_heavy):
    cards = {r.fqn: r for r in domain_heavy.cards.withColumn("card", render_card()).filter("fqn in ('m.E01', 'u.Util', 'w.C')").collect()}
    assert cards["m.E01"].fields[-1] == "... (2 more not shown)" and len(cards["m.E01"].fields) == 31
    assert len(cards["u.Util"].methods) == 41 and cards["u.Util"].methods[-1] == "... (5 more not shown)"
    assert cards["w.C"].card == "\n".join(
        ["### class w.C", "- layer: api", "- modifiers: public", "- fields: Svc svc", "- methods:\n  - public m.E01 get()", "- depends on: m.E01, s.Svc"]
    )
    assert cards["w.C"].importance == 17
    assert cards["m.E01"].depended_on_by == ["s.Svc", "w.C"] and cards["m.E01"].summary == "Entity 1."


def test_every_layer_survives_a_small_budget(small_context):
    kept = small_context.selected.collect()
    assert {r.group for r in kept} == {"API", "Service", "Domain", "Data", "Unclassified"}
    assert sum(r.cost for r in kept) < 3 * 5_000
    counts = small_context.counts.first()
    assert (counts.n_classes, counts.n_files, counts.truncated) == (84, 84, True)
    assert {r.name: (r.class_count, r.shown) for r in small_context.package_summaries.collect()}["w"] == (1, ["w.C"])


def test_prompts(small_context):
    got = {r.doc: r.prompt for r in prompts.prompts(small_context).collect()}
    assert list(prompts.PROMPTS) == ["README.md", "ARCHITECTURE.md", "SEQUENCE.md"] == sorted(got, key=list(prompts.PROMPTS).index)
    readme, architecture, sequence = (got[d] for d in prompts.PROMPTS)
    assert "- `m` (80 types)" in readme and "java.sql.Connection" not in readme and "java.sql" in readme
    assert "### class w.C" in readme and "- depends on" not in readme
    assert "the code base is large" in readme
    assert "- Domain layer" in architecture and "m.E14, and 65 more" in architecture
    assert "- Relational Database (via java.sql)" in architecture and "Client --> API" in architecture
    assert "#### API layer\n\n### class w.C" in architecture and "### class m.E" not in architecture
    assert "more fields — Entity 1." in architecture
    assert "    Client->>w_C: GET /x" in architecture and "    Client->>w_C: GET /x" in sequence
    assert all(len(p) < 2 * 5_000 + 6_000 for p in got.values())


def test_prompts_of_almost_nothing(analyse):
    ctx = ProjectContext(analyse({"A.java": "class A { }"}), "bare", ["java"])
    got = {r.doc: r.prompt for r in prompts.prompts(ctx).collect()}
    assert "(default package)" in got["README.md"] and "none detected" in got["README.md"]
    assert "no annotation, name or class shape" in got["ARCHITECTURE.md"] and "No domain types" in got["ARCHITECTURE.md"]
    assert "graph TD" in got["ARCHITECTURE.md"] and "No primary request flow" in got["ARCHITECTURE.md"]
    assert "No call flow" in got["SEQUENCE.md"]
