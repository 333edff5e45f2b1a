"""Resolution, graphs, layers and flows on small trees with results derived by hand."""

import pytest
from support import values
from pyspark.sql import functions as F

from sourceloom.operators import dependencies, mermaid, tables
from sourceloom.operators.calls import calls_by_caller
from sourceloom.operators.external import external_roots
from sourceloom.operators.symbols import public_api, unique_names

T, S, F_ = "org.quay.control.TowerController", "org.quay.ship.Ship", "org.quay.ship.Ship.Flag"
B, D, I = "org.quay.berth.Berthing", "org.quay.berth.DeepBerth", "org.quay.berth.TidalBerth"  # noqa: E741


# -- the harbour ------------------------------------------------------------


def test_harbour_dependencies(harbour):
    """Flag is found by its unique name, Ship through a wildcard import; Slot means two types, so none."""
    assert values(harbour.dependency_edges, "src", "dst", "kinds") == [
        (B, S, ["param"]), (D, B, ["implements"]), (D, S, ["param"]), (I, B, ["implements"]), (I, S, ["param"]),
        (T, B, ["field"]), (T, S, ["param"]), (S, F_, ["field"]),
    ]
    assert values(dependencies.dependents_of(harbour.dependency_edges, B), "src") == [(D,), (I,), (T,)]
    assert values(dependencies.dependencies_of(harbour.dependency_edges, I), "dst") == [(B,), (S,)]


def test_harbour_packages_and_importance(harbour):
    assert values(harbour.package_edges, "src_package", "dst_package") == [
        ("org.quay.berth", "org.quay.ship"), ("org.quay.control", "org.quay.berth"), ("org.quay.control", "org.quay.ship"),
    ]
    ranks = {r.fqn: (r.fan_in, r.fan_out, r.importance) for r in harbour.ranked.collect()}
    assert ranks == {B: (3, 1, 10), D: (0, 2, 2), I: (0, 2, 2), T: (0, 2, 2), S: (4, 1, 13), F_: (1, 0, 3), f"{I}.Slot": (0, 0, 0), "org.quay.crane.Slot": (0, 0, 0)}
    assert values(harbour.packages, "package", "class_count") == [("org.quay.berth", 4), ("org.quay.control", 1), ("org.quay.crane", 1), ("org.quay.ship", 2)]


def test_harbour_layers_and_components(harbour):
    assert {fqn for fqn, layer in values(harbour.symbols, "fqn", "layer") if layer == "api"} == {T}
    assert {r.fqn for r in unique_names(harbour.symbols).collect()} == {B, D, I, T, S, F_}
    assert values(harbour.component_edges, "src", "dst") == [("API", "Other"), ("Client", "API"), ("Domain", "Other"), ("Other", "Domain")]
    assert values(harbour.external_roots, "root", "n_imports") == [("java.time", 1), ("java.util", 1)]
    assert harbour.external_systems.count() == 0


def test_harbour_calls_and_flow(harbour):
    """Berthing has two implementors, so the flow stays at the interface; the logger is no class of the tree."""
    assert values(harbour.calls, "caller_class", "caller_method", "callee_class", "callee_method") == [
        (T, "dock", B, "admit"), (T, "dock", T, "note"), (T, "note", S, "callSign"), (S, "callSign", F_, "name"),
    ]
    flow = harbour.flows.first()
    assert (flow.entry_class, flow.entry_method, flow.entry_return) == (T, "dock", "String")
    assert [tuple(s) for s in flow.steps] == [(T, "dock", B, "admit", "boolean"), (T, "dock", T, "note", "String"), (T, "note", S, "callSign", "String")]
    lines = flow.mermaid.split("\n")
    assert lines[0] == "sequenceDiagram" and [x.split(" as ")[1] for x in lines if " as " in x] == ["Client", "TowerController", "Berthing", "Ship"]
    assert "    org_quay_control_TowerController->>org_quay_berth_Berthing: admit()" in lines


def test_public_api(harbour):
    assert {r.fqn for r in public_api(harbour.symbols).collect()} == {B, I, T, S, "org.quay.crane.Slot"}


def test_all_calls_of_a_method_are_kept(analyse):
    a = analyse({"p/A.java": "package p; class A { B b; void f() { " + "".join(f"b.g{k}(); " for k in range(15)) + "} }", "p/B.java": "package p; class B { }"})
    assert calls_by_caller(a.calls).agg(F.max("call_rank")).first()[0] == 15
    assert calls_by_caller(a.calls, 12).count() == 12


# -- resolution -------------------------------------------------------------------

NAMES = {
    "a/One.java": "package a; import b.Target; public class One { Target t; }",  # import
    "a/Two.java": "package a; class Two { Near n; java.util.Near q; }",  # own package; last segment of a qualified name
    "a/Near.java": "package a; public class Near { }",
    "b/Target.java": "package b; public class Target { Lonely l; }",  # unique simple name
    "c/Target.java": "package c; public class Target { }",
    "c/Lonely.java": "package c; public class Lonely { Target own; }",
    "d/Amb.java": "package d; class Amb { Target t; }",  # two candidates: none
    "d/Full.java": "package d; class Full { c.Target t; b.Target u; }",  # qualified
    "d/Two.java": "package d; import b.Target; import c.Target; class Imports { Target t; }",  # first import
    "d/Wild.java": "package d; import b.*; import static c.Target.x; class Wild { Target t; }",  # neither counts
    "Plain.java": "public class Plain { }",
    "e/Plain.java": "package e; public class Plain { }",
    "e/Use.java": "package e; import e.Plain; class Use { Plain p; }",  # default package class comes first
    "f/Gen.java": "package f; import a.Near; class Gen { Map<String, List<Near[]>> m; void v(Near... n) {} Gen self() { return new Gen(); } }",
    "g/Outer.java": "package g; public class Outer { static class Inner { } Inner i; Outer.Inner j; }",
}


@pytest.fixture(scope="module")
def names(analyse):
    return analyse(NAMES)


def edges_of(a, src):
    return values(a.dependency_edges.filter(F.col("src") == src), "dst", "kinds")


@pytest.mark.parametrize(
    "src, expected",
    [
        ("a.One", [("b.Target", ["field"])]),
        ("a.Two", [("a.Near", ["field"])]),
        ("b.Target", [("c.Lonely", ["field"])]),
        ("c.Lonely", [("c.Target", ["field"])]),
        ("d.Amb", []),
        ("d.Full", [("b.Target", ["field"]), ("c.Target", ["field"])]),
        ("d.Imports", [("b.Target", ["field"])]),
        ("d.Wild", []),
        ("e.Use", [("Plain", ["field"])]),
        ("f.Gen", [("a.Near", ["field", "param"])]),
        ("g.Outer", [("g.Outer.Inner", ["field"])]),
    ],
)
def test_resolution(names, src, expected):
    assert edges_of(names, src) == expected


def test_hot_keys_change_nothing(names, parse):
    from sourceloom.plans.analysis import Analysis

    split = Analysis(names.parsed, hot_rows=1, is_written=True)
    assert values(split.edges, *sorted(split.edges.columns)) == values(names.edges, *sorted(names.edges.columns))
    assert values(split.calls, *split.calls.columns) == values(names.calls, *names.calls.columns)


def test_duplicate_names(analyse):
    a = analyse(
        {
            "1/X.java": "package p; public class X { A a; }",
            "2/X.java": "package p; class X { void run() {} B b; }",
            "3/A.java": "package p; class A {}",
            "4/B.java": "package p; class B {}",
            "5/U.java": "package q; class U { X x; }",
        }
    )
    sym = a.symbols.filter("fqn = 'p.X'").first()
    assert (sym.path, sym.first_path, sym.n_declared, sym.is_public) == ("2/X.java", "1/X.java", 2, False)
    assert edges_of(a, "p.X") == [("p.A", ["field"]), ("p.B", ["field"])]  # edges of both
    assert edges_of(a, "q.U") == []  # the simple name is not unique
    assert ("p", 4) in values(a.packages, "package", "class_count")
    assert "X" not in {r.name for r in unique_names(a.symbols).collect()}


# -- external roots and systems -------------------------------------------------------


def test_external_roots(analyse):
    a = analyse(
        {
            "1.java": "package org.apache.mine; import org.apache.kafka.X; import java.util.List; import static java.util.Map.of; import z.Late;",
            "2.java": "package single; import single.Other; import y.early.A; import java.io.File; import Bare;",
            "3.java": "package org.apachex; import org.apachex.deep.Q; import okhttp3.*;",
        }
    )
    rows = [(r.root, r.n_imports) for r in a.external_roots.orderBy(F.desc("n_imports"), "first").collect()]
    # own roots and what lies under them are hidden, single-segment packages are not known as own; ties by first met
    assert rows == [("java.util", 2), ("z.Late", 1), ("single.Other", 1), ("y.early", 1), ("java.io", 1), ("Bare", 1), ("okhttp3.*", 1)]
    assert external_roots(a.parsed, 1).count() == 1


def test_external_systems(analyse):
    a = analyse(
        {
            "1.java": "package p; import java.sql.Connection; import javax.sql.DataSource; import org.apache.httpX.Y; import org.springframework.jdbc.core.J; class A {}",
            "2.java": "package p; import com.azure.X; import static java.sql.Types.INTEGER; class B {}",
        }
    )
    assert values(a.external_systems, "category", "prefixes") == [
        ("Cloud Provider SDK", ["com.azure"]), ("HTTP / REST Client", ["org.apache.http"]),
        ("Relational Database", ["java.sql", "javax.sql", "org.springframework.jdbc"]),
    ]
    cats = dict(values(a.categories, "path", "categories"))
    assert cats["1.java"] == ["Relational Database", "HTTP / REST Client"] and cats["2.java"] == ["Cloud Provider SDK", "Relational Database"]


# -- layers -----------------------------------------------------------------------------

LAYERED = {
    "@RestController class A {}": "api",
    "class A { @GetMapping void m() {} }": "api",
    "class A { @Path void m() {} }": "api",
    "@Entity @Repository class A {}": "domain",
    "@Dao class A {}": "data",
    "@Service class A { private int x; }": "service",
    "class OrderController {}": "api",
    "class InterestRate { int x; }": "domain",  # rest is no word here
    "class RestClient {}": "api",
    "class UserDAOImpl {}": "data",
    "class UserMapper { int x; }": "data",
    "class TokenStore { String s; }": "domain",
    "class MyService {}": None,
    "enum Color { RED }": "domain",
    "record P(int x) {}": "domain",
    "class Consts { static final int X = 1; }": None,
    "class Deleg { Repo r; void m() { r.save(); } }": None,
    "class Holder { Repo r; void m() { this.x(); other.save(); } }": "domain",
    "interface Face { void m(); }": None,
}


def test_layers(analyse):
    a = analyse({f"{i:02}.java": s for i, s in enumerate(LAYERED)})
    got = [r.layer for r in a.facts.orderBy("path").collect()]
    assert dict(zip(LAYERED, got)) == LAYERED


def test_layer_breakdown_keeps_all_layers_and_order(analyse):
    a = analyse({f"{i:02}.java": f"package p; @Service class S{99 - i} {{}}" for i in range(17)})
    rows = {r.layer: r for r in a.layer_breakdown.collect()}
    assert set(rows) == {"api", "service", "domain", "data", "unclassified"}
    assert rows["service"].n_classes == 17 and rows["service"].names[:2] == ["p.S99", "p.S98"] and len(rows["service"].names) == 15
    assert rows["service"].listing.endswith("p.S85, and 2 more") and rows["api"].listing == ""


# -- calls ----------------------------------------------------------------------------------

CALLS = {
    "p/A.java": """package p; import q.Dep; public class A { Dep dep; Dep shadow; Box<Dep> raw;
        public void m(Other shadow, Dep twice) { dep.x(); dep.x(); shadow.y(); helper(); this.z(); local.q(); raw.r(); Dep.make(); twice.t(); super.s(); a.b().c(); }
        void helper() {} }""",
    "p/Other.java": "package p; public class Other { public void y() { } }",
    "q/Dep.java": "package q; public class Dep { private p.Other o; void x() { o.y(); } }",
}


def test_calls(analyse):
    a = analyse(CALLS)
    got = [(r.callee_class, r.callee_method) for r in a.calls.filter("caller_class = 'p.A'").orderBy("call_ord").collect()]
    assert got == [("q.Dep", "x"), ("p.Other", "y"), ("p.A", "helper"), ("p.A", "z"), ("q.Dep", "make"), ("q.Dep", "t")]
    first = calls_by_caller(a.calls, 2).filter("caller_class = 'p.A'").orderBy("call_rank").collect()
    assert [(r.call_rank, r.callee_method) for r in first] == [(1, "x"), (2, "y")]
    sites = tables.call_sites(a.classes).filter("fqn = 'p.A'")
    assert sites.filter("callee_method = 'x'").count() == 1  # each (receiver, method) once


# -- flows ------------------------------------------------------------------------------------


def flow_steps(a, n=1):
    flow = a.flows.filter(F.col("flow_ord") == n).first()
    return [(s.caller_method, s.callee_class.split(".")[-1], s.callee_method) for s in flow.steps]


def test_entry_order_overloads_and_tests(analyse):
    a = analyse(
        {
            "p/C.java": """package p; public class C { Svc s; @PostMapping public void route() { s.a(); } public void pure() { s.a(); }
              public void many() { s.a(); s.b(); s.c(); } public void many(int x) { s.d(); } @Test public void test() { s.a(); }
              void hidden() { s.a(); } public C() { s.a(); } public void none() { } }""",
            "p/Svc.java": "package p; @Service public class Svc { Z z; public void a() { z.q(); } }",
            "p/Z.java": "package p; @Service public class Z { }",
        }
    )
    got = [(r.entry_class, r.entry_method) for r in a.flows.orderBy("flow_ord").collect()]
    # a route; then what nothing calls, most calls first, overloads each; then what is called
    assert got == [("p.C", "route"), ("p.C", "many"), ("p.C", "many"), ("p.C", "pure"), ("p.Svc", "a")]


def test_domain_calls_are_dropped_but_own_calls_kept(analyse):
    a = analyse(
        {
            "p/C.java": "package p; public class C { Dto d; public int go() { d.get(); step(); return 1; } private void step() { } }",
            "p/Dto.java": "package p; public class Dto { int x; int get() { return x; } public int own() { return get(); } }",
        }
    )
    flows = {r.entry_method: [s.callee_method for s in r.steps] for r in a.flows.collect()}
    assert flows == {"go": ["step"], "own": ["get"]}


def test_redirect_only_with_one_implementor(analyse):
    a = analyse(
        {
            "p/C.java": "package p; public class C { One one; Two two; Gen gen; public void go() { one.a(); two.b(); gen.c(); } }",
            "p/One.java": "package p; interface One { int a(); }", "p/Two.java": "package p; interface Two { void b(); }",
            "p/Gen.java": "package p; interface Gen { void c(); }",
            "p/I1.java": "package p; class I1 implements One, Two { X x; public long a() { x.deep(); } }",
            "p/I2.java": "package p; class I2 implements Two, Gen<String> { }", "p/X.java": "package p; class X { void deep() {} }",
        }
    )
    assert flow_steps(a) == [("go", "I1", "a"), ("a", "X", "deep"), ("go", "Two", "b"), ("go", "Gen", "c")]
    assert a.flows.first().steps[0].return_type == "long"


def chain(n, extra=""):
    return {
        f"p/K{i}.java": f"package p; public class K{i} {{ K{i + 1} next; void go() {{ next.go(); }} }}" for i in range(1, n)
    } | {"p/K0.java": "package p; public class K0 { K1 next; public void go() { next.go(); } " + extra + "}", f"p/K{n}.java": f"package p; public class K{n} {{ void go() {{ }} }}"}


def test_depth_limit(analyse):
    assert flow_steps(analyse(chain(9))) == [("go", f"K{i}", "go") for i in range(1, 6)]


def test_step_limit_and_cycles(analyse):
    wide = "package p; public class A { B b; public void go() { " + "".join(f"b.m{i}(); " for i in range(20)) + "} }"
    a = analyse({"p/A.java": wide, "p/B.java": "package p; public class B { A a; void m0() { a.go(); again(); } void again() { m0(); } }"})
    steps = flow_steps(a)
    assert len(steps) == 12
    assert steps[:5] == [("go", "B", "m0"), ("m0", "A", "go"), ("m0", "B", "again"), ("again", "B", "m0"), ("go", "B", "m1")]


def test_late_shorter_path_is_still_expanded(analyse):
    # T is met first beyond the depth limit, so it is not marked and is expanded on the direct way
    files = chain(5)
    files["p/K0.java"] = "package p; public class K0 { K1 next; T t; public void go() { next.go(); t.go(); } }"
    files["p/K5.java"] = "package p; public class K5 { T t; void go() { t.go(); } }"
    files["p/K4.java"] = "package p; public class K4 { T t; void go() { t.go(); } }"
    files["p/T.java"] = "package p; public class T { L l; void go() { l.go(); } }"
    files["p/L.java"] = "package p; public class L { void go() { } }"
    assert flow_steps(analyse(files)) == [
        ("go", "K1", "go"), ("go", "K2", "go"), ("go", "K3", "go"), ("go", "K4", "go"), ("go", "T", "go"), ("go", "T", "go"), ("go", "L", "go"),
    ]


def test_labels_returns_and_external_end(analyse):
    a = analyse(
        {
            "p/C.java": """package p; @RestController @RequestMapping("/items/") public class C { Svc s;
               @GetMapping(path = "/{id}/") public List<Item> find() { return s.load(); } @RequestMapping public void any() { s.load(); } }""",
            "p/J.java": 'package p; @Path("/j") public class J { Svc s; @GET public void get() { s.load(); } }',
            "p/Svc.java": "package p; @Service public class Svc { Repo r; Item load() { r.read(); } }",
            "p/Repo.java": "package p; import org.jooq.DSL; import com.mongodb.X; @Repository class Repo { Item read() { } }",
        }
    )
    flows = {r.entry_class + r.entry_method: r for r in a.flows.collect()}
    assert {k: r.entry_label for k, r in flows.items()} == {"p.Cany": "/items", "p.Cfind": "GET /items/{id}", "p.Jget": "GET /"}
    assert flows["p.Cfind"].mermaid.split("\n")[1:] == [
        "    participant Client as Client", "    participant p_C as C", "    participant p_Svc as Svc", "    participant p_Repo as Repo",
        "    participant Relational_Database as Relational Database", "    Client->>p_C: GET /items/{id}", "    p_C->>p_Svc: load()",
        "    p_Svc->>p_Repo: read()", "    p_Repo->>Relational_Database: read()", "    Relational_Database-->>p_Repo: result",
        "    p_Repo-->>p_Svc: Item", "    p_Svc-->>p_C: Item", "    p_C-->>Client: List<Item>",
    ]


def test_no_flows(analyse):
    assert analyse({"A.java": "public class A { public void m() { } }"}).flows.count() == 0


# -- diagrams -----------------------------------------------------------------------------------


def test_graph_text(spark):
    edges = spark.createDataFrame([("b.x", "a"), ("a", "c"), ("a", ""), ("c", "d-e")], "src string, dst string")
    assert mermaid.graph_text(mermaid.graph_lines(edges), "LR").first().mermaid == "\n".join(
        ["graph LR", '    a["a"]', '    root[""]', "    a --> root", '    c["c"]', "    a --> c",
         '    b_x["b.x"]', "    b_x --> a", '    d_e["d-e"]', "    c --> d_e"]
    )
    assert mermaid.graph_text(mermaid.graph_lines(edges.limit(0))).first().mermaid == "graph TD"


def test_component_graph_has_client_and_systems(analyse):
    a = analyse(
        {
            "1.java": "package p; import okhttp3.Call; @RestController class C { S s; }",
            "2.java": "package p; @Service class S { U u; }", "3.java": "package p; class U { }",
        }
    )
    assert values(a.component_edges, "src", "dst") == [
        ("API", "HTTP / REST Client"), ("API", "Service"), ("Client", "API"), ("Service", "Other"),
    ]


def test_wide_and_deep_calls_are_traced_as_in_full(spark):
    """Against a plain walk of the whole graph; a method is followed for no more calls than the steps that are left."""
    import random

    from sourceloom.functions.rules import MAX_DEPTH, MAX_STEPS
    from sourceloom.operators.flows import reachable_calls, trace_flows

    rng = random.Random(5)
    calls = {m: [rng.randrange(300) for _ in range(rng.choice([0, 1, 2, 3, 30]))] for m in range(300)}
    rows = [("p", m, 0, i, f"C{m}", "f", f"C{t}", "f", None) for m, ts in calls.items() for i, t in enumerate(ts)]
    columns = "path string, class_ord int, method_ord int, call_ord int, caller_class string, caller_method string, callee_class string, callee_method string, callee_layer string"
    starts = [m for m in calls if calls[m]][:8]
    entries = spark.createDataFrame([(i + 1, f"C{m}", "f") for i, m in enumerate(starts)], "flow_ord int, entry_class string, entry_method string")
    none = spark.createDataFrame([], "interface string, implementor string")
    reached = reachable_calls(entries, spark.createDataFrame(rows, columns), none)

    def walk(m, level, steps, expanded):
        for t in calls[m]:
            if len(steps) == MAX_STEPS:
                return
            steps.append((f"C{m}", f"C{t}"))
            if level <= MAX_DEPTH and len(steps) < MAX_STEPS and t not in expanded:
                expanded.add(t)
                walk(t, level + 1, steps, expanded)

    expected = []
    for i, m in enumerate(starts):
        steps = []
        walk(m, 1, steps, {m})
        expected += [(i + 1, k + 1, *s) for k, s in enumerate(steps)]
    assert sorted(values(trace_flows(entries, reached), "flow_ord", "step_ord", "caller_class", "callee_class")) == sorted(expected)
    assert reached.groupBy("flow_ord").count().agg(F.max("count")).first()[0] <= 792
