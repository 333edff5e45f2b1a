"""The front-end, on its own."""

import pytest

from sourceloom.sources.java import SYNTAX_ERROR, scan_java
from sourceloom.sources.registry import available_languages, get_language, language_extensions, language_for_extension


def one(source):
    return scan_java(source)["classes"][0]


def method(body, params=""):
    return one(f"class A {{ void m({params}) {{ {body} }} }}")["methods"][0]


def calls(body):
    return [(c["receiver"], c["method"]) for c in method(body)["calls"]]


def test_package_and_imports():
    r = scan_java("package a.b;\nimport java.util.Objects;\nimport static x.Y.z;\nimport java.util.*;\n")
    assert r["package"] == "a.b" and not r["parse_errors"]
    assert [tuple(i.values()) for i in r["imports"]] == [
        ("java.util.Objects", False, False), ("x.Y.z", True, False), ("java.util.*", False, True),
    ]


def test_no_package_is_none():
    assert scan_java("class A {}")["package"] is None


@pytest.mark.parametrize(
    "source, kind",
    [("class A {}", "class"), ("interface A {}", "interface"), ("enum A { X }", "enum"), ("record A(int x) {}", "record"), ("@interface A {}", "annotation")],
)
def test_kinds(source, kind):
    assert one(source)["kind"] == kind and one(source)["name"] == "A"


def test_nested_names_and_order():
    r = scan_java("package p; class A { class B { enum C { X } } interface D {} } class E {}")
    assert [c["qualified_name"] for c in r["classes"]] == ["p.A", "p.A.B", "p.A.B.C", "p.A.D", "p.E"]
    assert [c["outer_ord"] for c in r["classes"]] == [None, 0, 1, 0, None]


def test_doc_comment_is_the_one_just_before():
    c = one("/** A. */ public class A { /** f */ int x; // no\n int y; /* plain */ int z; /** m */ @Deprecated void m() {} }")
    assert c["doc_comment"] == "/** A. */"
    assert [f["doc_comment"] for f in c["fields"]] == ["/** f */", None, None]
    assert c["methods"][0]["doc_comment"] == "/** m */"


def test_lines():
    c = one("\n/** d */\n@X\npublic class A {\n  void m() {\n  }\n}\n")
    assert (c["start_line"], c["end_line"]) == (3, 7)
    assert (c["methods"][0]["start_line"], c["methods"][0]["end_line"]) == (5, 6)


def test_supertypes_keep_their_text():
    c = one("class A<T extends C<T>, U> extends B<T> implements I<X, Y>, p.J permits K {}")
    assert (c["extends"], c["implements"], c["type_parameters"]) == (["B<T>"], ["I<X, Y>", "p.J"], ["T extends C<T>", "U"])
    assert one("interface A extends B, C<D> {}")["extends"] == ["B", "C<D>"]
    assert one("enum A implements B { X }")["implements"] == ["B"]


def test_fields_one_per_declarator():
    c = one('class A { private static final Map<String, List<W>> a = new HashMap<String, W>(), b; int[] c[] = {1, 2}, d; String s = ";,"; }')
    assert [(f["name"], f["type"]) for f in c["fields"]] == [
        ("a", "Map<String, List<W>>"), ("b", "Map<String, List<W>>"), ("c", "int[]"), ("d", "int[]"), ("s", "String"),
    ]
    assert c["fields"][1]["modifiers"] == ["private", "static", "final"]


def test_enum_constants_and_members():
    c = one("enum A { X, @D Y(1, f()) { void q() {} }, Z; private int v; A() {} void m() {} }")
    assert [(f["name"], f["type"], f["modifiers"]) for f in c["fields"]] == [
        ("X", "A", ["static", "final"]), ("Y", "A", ["static", "final"]), ("Z", "A", ["static", "final"]), ("v", "int", ["private"]),
    ]
    assert [(m["name"], m["is_constructor"]) for m in c["methods"]] == [("A", True), ("m", False)]


def test_record_components_and_compact_constructor():
    c = one("public record P(int x, List<String> y) implements S { P { check(); } int sum() { return x; } }")
    assert [(f["name"], f["type"], f["modifiers"]) for f in c["fields"]] == [("x", "int", ["final"]), ("y", "List<String>", ["final"])]
    assert [m["name"] for m in c["methods"]] == ["sum"]


def test_interface_constants_and_annotation_elements_are_no_members():
    assert one("interface A { int K = 1; void m(); }")["fields"] == []
    c = one('@interface A { String value() default "x"; int[] z() default {1, 2}; }')
    assert c["methods"] == [] and c["fields"] == []
    assert not scan_java('@interface A { int[] z() default {1, 2}; }')["parse_errors"]


def test_methods():
    c = one("abstract class A { public <T extends B> List<T> f(final String a, @X(\"q\") Map<K, V> b, int... c) throws E, F { } abstract void g(); A(int x) {} int[] h() [] { return null; } }")
    f, g, ctor, h = c["methods"]
    assert f["return_type"] == "List<T>" and f["parameters"] == [
        {"name": "a", "type": "String"}, {"name": "b", "type": "Map<K, V>"}, {"name": "c", "type": "int..."},
    ]
    assert (g["return_type"], g["modifiers"]) == ("void", ["abstract"])
    assert (ctor["is_constructor"], ctor["return_type"], ctor["name"]) == (True, "", "A")
    assert h["return_type"] == "int[]"


def test_modifiers_and_annotations():
    c = one('@a.b.Entity @Table(name = "t") public non-sealed strictfp class A {}')
    assert c["modifiers"] == ["public", "non-sealed", "strictfp"] and c["annotations"] == ["Entity", "Table"]


@pytest.mark.parametrize(
    "written, value",
    [
        ('@R("/x")', "/x"), ('@R(value = "/x", m = P)', "/x"), ('@R(m = P, path = "/y")', "/y"), ("@R", None), ("@R()", None),
        ('@R("")', None), ("@R(1)", None), ('@R(name = "n")', None), ('@R({"/a"})', None), ('@R("a" + "b")', None), ('@R("a\\\\b")', "ab"),
        ('@R(value = "", path = "/z")', "/z"),
    ],
)
def test_annotation_value(written, value):
    assert dict(one(f"{written} class A {{}}")["annotation_args"]).get("R") == value


def test_calls_in_order_with_receivers():
    assert calls("this.a(); b(); x.c(); p.q.d(); e().f(); new G(h()); super.i(); X.<T>j(); (y).k(); \"s\".l();") == [
        ("this", "a"), (None, "b"), ("x", "c"), (None, "e"), (None, "h"), ("super", "i"), ("X", "j"),
    ]


def test_calls_in_nested_code():
    body = "run(() -> inner(x)); new Z() { public void decl() { deep(); } void other() throws E { more(); } }; if (a > cmp(1)) { } switch (sel()) { case A -> arm(); default -> { } } return last();"
    assert [m for _, m in calls(body)] == ["run", "inner", "deep", "more", "cmp", "sel", "arm", "last"]


def test_not_calls():
    assert calls("if (a) { } while (b) { } @SuppressWarnings(\"x\") int v = 0; List<String> l = null; class L { L(int i) { } int f(int i) { return 1; } } synchronized (this) { } assert (true);") == []


def test_bodies_outside_methods_are_not_read():
    c = one("class A { int x = init(); static { boot(); } { inst(); } Runnable r = () -> { go(); }; void m() { call(); } }")
    assert [x["method"] for m in c["methods"] for x in m["calls"]] == ["call"]
    assert [f["name"] for f in c["fields"]] == ["x", "r"]


def test_created_types():
    m = method("new Foo(); new a.Bar<String>(1); new int[3]; new Baz[] {}; outer.new In(); new @X Q() { };")
    assert m["creates"] == ["Foo", "a.Bar", "In", "Q"]


def test_text_blocks_comments_and_literals_hide_their_text():
    assert calls('String s = """\n a(); "quoted" { \n"""; /* b(); */ // c();\n char q = \'"\'; char r = \'\\\'\'; d();') == [(None, "d")]


@pytest.mark.parametrize(
    "source",
    ["public class Broken { public void foo( {", "class A { int x }", "class { }", "class A { void m() { ( } }", "clas A {}", 'class A { String s = "x; }', "class A }"],
)
def test_broken_source_is_recorded(source):
    assert scan_java(source)["parse_errors"] == [SYNTAX_ERROR]


@pytest.mark.parametrize("source", ["", "// only\n", ";", "module a.b { requires c; }", "@X package a;", "import a.B;;\nclass C {};"])
def test_unusual_but_right_source(source):
    assert scan_java(source)["parse_errors"] == []


def test_partial_result_of_broken_source():
    r = scan_java("package p; class A { void ok() { x.y(); } void bad( { } ")
    assert r["classes"][0]["qualified_name"] == "p.A" and r["classes"][0]["methods"][0]["name"] == "ok"


def test_registry():
    assert available_languages() == ["java"] and language_extensions(["java"]) == {".java"}
    assert language_for_extension(".java", ["java"]).name == "java" and language_for_extension(".py", ["java"]) is None
    with pytest.raises(ValueError, match="cobol"):
        get_language("cobol")


def test_record_patterns_are_no_calls():
    source = """package a; class A { void f(Object o) {
        if (o instanceof Line(Point(int x, int y), Point q) && q.ok()) { run(x); }
        switch (o) { case Line(Point(var a, var b), var c) -> go(a); case Point p -> stop(); default -> { } } } }"""
    method = scan_java(source)["classes"][0]["methods"][0]
    assert [(c["receiver"], c["method"]) for c in method["calls"]] == [("q", "ok"), (None, "run"), (None, "go"), (None, "stop")]


def test_lines_and_texts_between_comments_and_odd_spaces():
    source = "package p; // one\n/** Two. */\nclass A {\n  class B {\n    int f() { return 1; } /* x */\n  }\n  java . util\n.List<é> g(Map<K,\n V> m) { }\n}\n \x1c\n"
    unit = scan_java(source)
    assert [(c["name"], c["start_line"], c["end_line"], c["doc_comment"]) for c in unit["classes"]] == [("A", 3, 10, "/** Two. */"), ("B", 4, 6, None)]
    outer, inner = (c["methods"][0] for c in unit["classes"])
    assert (outer["start_line"], outer["end_line"], outer["return_type"]) == (7, 9, "java . util\n.List<é>")
    assert (inner["start_line"], outer["parameters"]) == (5, [{"name": "m", "type": "Map<K,\n V>"}])
