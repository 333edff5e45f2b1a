"""Working tree, change sets, state, fingerprints, runs, command line and stream."""

import json
import os
from io import BytesIO
from urllib.error import URLError

import pytest
from support import HARBOUR, git, values
from pyspark.sql import functions as F

from sourceloom import cli
from sourceloom.config import load_config
from sourceloom.documents import prompts
from sourceloom.documents.provider import OllamaProvider, ProviderError, available_providers, get_provider, without_thinking
from sourceloom.operators import changes
from sourceloom.operators.fingerprints import regeneration
from sourceloom.plans.runs import Runner
from sourceloom.session import scratch, written
from sourceloom.sources import worktree as wt
from sourceloom.sources.state import State, StateStore, bucket_of
from sourceloom.streaming.updates import start_updates

TOWER = "quay/control/TowerController.java"


# -- working tree -----------------------------------------------------------------


def test_listing(spark, worktree):
    (worktree / ".gitignore").write_text("*.log\n")
    for name in ("x.log", "new.java", "build/Out.java", "src/test/T.java", "FooTest.java", "AUDIT.java", "NOTES.md", "ünï.java"):
        (worktree / name).parent.mkdir(parents=True, exist_ok=True)
        (worktree / name).write_text("class X {}")
    (worktree / TOWER).unlink()  # still tracked, but no file any more
    listed = wt.list_files(spark, worktree, load_config().exclude_patterns)
    paths = {r.path for r in listed.collect()}
    assert paths == set(HARBOUR) - {TOWER} | {".gitignore", "new.java", "NOTES.md", "ünï.java"}
    sources = wt.source_files(listed, ["java"])
    assert {r.path for r in sources.collect()} == paths - {".gitignore", "NOTES.md"}
    contents = dict(values(wt.read_contents(sources, worktree), "path", "content"))
    assert contents["new.java"] == b"class X {}"
    assert wt.has_uncommitted_changes(worktree)


def test_not_a_work_tree(spark, tmp_path):
    assert not wt.is_work_tree(tmp_path) and wt.current_commit(tmp_path) == ""
    with pytest.raises(wt.NotAWorkTreeError):
        wt.list_files(spark, tmp_path)


def test_read_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "A.java").write_text("class A {}")
    (tmp_path / "a" / "b.txt").write_text("no")
    assert values(wt.read_folder(spark, str(tmp_path)), "path", "content") == [("a/A.java", bytearray(b"class A {}"))]


@pytest.mark.parametrize(
    "path, pattern, hit",
    [
        ("build/x", "**/build/**", True), ("a/build/x", "**/build/**", True), ("rebuild/x", "**/build/**", False),
        ("AUDIT.java", "**/*IT.java", True), ("a/Testing/B.java", "**/Test*.java", True), ("a/b.min.js", "**/*.min.js", True),
        ("a.b", "a?b", True), ("a\n", "a", False), ("x[1]", "x[[]1]", True), ("ab", "[!a]b", False),
    ],
)
def test_exclude(spark, path, pattern, hit):
    row = spark.createDataFrame([(path,)], "p string").select(wt.is_excluded(F.col("p"), [pattern])).first()
    assert row[0] is hit


def test_extension(spark):
    df = spark.createDataFrame([("a/B.java",), (".java",), ("a/.java",), ("a.java/b",), ("A.JAVA",), ("x.y.java",)], "p string")
    assert values(df.filter(wt.has_extension(F.col("p"), {".java"})), "p") == [("a/B.java",), ("x.y.java",)]


def test_name_status():
    raw = "A\0n.java\0M\0m.java\0D\0d.java\0R087\0old.java\0new.java\0T\0t.java\0"
    assert wt.parse_name_status(raw) == [
        ("A", "n.java", None), ("M", "m.java", None), ("D", "d.java", None), ("R", "new.java", "old.java"), ("M", "t.java", None),
    ]
    assert wt.parse_name_status("") == []


def test_changes_since(spark, worktree):
    first = wt.current_commit(worktree)
    git(worktree, "mv", TOWER, "Moved.java")
    (worktree / "quay/ship/Ship.java").unlink()
    (worktree / "untracked.java").write_text("class U {}")
    rows = wt.changes_since(spark, worktree, first)
    assert values(rows, "status", "path", "old_path") == [
        ("D", "quay/ship/Ship.java", None), ("R", "Moved.java", TOWER),
    ]
    assert values(changes.changed_paths(rows), "path") == [("Moved.java",)]
    assert values(changes.removed_paths(rows), "path") == [(TOWER,), ("quay/ship/Ship.java",)]
    assert wt.changes_since(spark, worktree, "").count() == 0
    below = worktree / "quay"
    assert values(wt.changes_since(spark, below, first), "path") == [("control/TowerController.java",), ("ship/Ship.java",)]
    assert {r.path for r in wt.list_files(spark, below).collect()} == {"berth/Berthing.java", "berth/DeepBerth.java", "berth/TidalBerth.java", "crane/Slot.java"}


def test_update_plan(spark):
    old = spark.createDataFrame([("same", "1"), ("edit", "1"), ("gone", "1"), ("touched", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("same", "1"), ("edit", "2"), ("new", "1"), ("touched", "1")], "path string, content_hash string")
    listed = spark.createDataFrame([("M", "touched", None)], changes.CHANGE_SCHEMA)
    plan = changes.update_plan(old, new, listed)
    assert values(plan, "path", "action", "in_change_set") == [
        ("edit", "parse", True), ("gone", "remove", False), ("new", "parse", True), ("same", "reuse", False), ("touched", "reuse", True),
    ]
    assert tuple(changes.run_counters(plan).first()) == (4, 3, 1, 1)
    merged = changes.merge_snapshot(old, new.filter("path in ('edit', 'new')"), plan)
    assert values(merged, "path", "content_hash") == [("edit", "2"), ("new", "1"), ("same", "1"), ("touched", "1")]


# -- state, configuration, provider ----------------------------------------------------


def test_state_round_trip(spark, parse, tmp_path):
    store = StateStore(spark, tmp_path / "state")
    assert store.load() is None
    parsed = parse({"a.java": 'package p; import q.R; @A("x") class O { int f; class I { void m(int a) { b.c(); new D(); } } }', "bad.java": "class {"})
    name = store.write_snapshot(parsed)
    store.save(State("abc", name, {"README.md": "1"}))
    state = store.load()
    assert (state.last_commit, state.fingerprints, state.complete) == ("abc", {"README.md": "1"}, True)
    assert values(store.parsed(state), "*") == values(parsed, "*")
    store.save(State("def", store.write_snapshot(parsed)))
    assert not (tmp_path / "state" / name).exists() and store.load().last_commit == "def"
    for broken in ("{", "{}", "[]", '{"last_commit": "x"}'):
        (tmp_path / "state" / "state.json").write_text(broken)
        assert store.load() is None


def test_config(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text("languages: [x]\nmodel:\n  name: other\nexclude_patterns: ['a']\n")
    c = load_config(file, {"model": {"host": "h"}, "output_dir": "o"})
    assert (c.languages, c.exclude_patterns, c.output_dir) == (["x"], ["a"], "o")
    assert (c.model.name, c.model.host, c.model.num_ctx) == ("other", "h", 8192)
    assert load_config().languages == ["java"] and len(load_config().exclude_patterns) == 12
    file.write_text("")
    assert load_config(file) == load_config()


class Answer(BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def test_provider():
    asked = []

    def answer(body):
        def open_url(request, timeout):
            asked.append((request.full_url, request.data and json.loads(request.data), timeout))
            return Answer(json.dumps(body).encode())

        return open_url

    config = load_config().model
    assert OllamaProvider(config, answer({"models": [{"name": "qwen3:8b"}]})).is_available()
    assert not OllamaProvider(config, answer({"models": [{"model": "other"}]})).is_available()
    assert asked[0][0].endswith("/api/tags") and asked[0][2] == 5
    text = OllamaProvider(config, answer({"response": "<think>\nhm</think> Hello "})).generate("p", "s")
    assert text == "Hello"
    assert asked[-1][1] == {
        "model": "qwen3:8b", "prompt": "p", "system": "s", "stream": False, "think": False, "options": {"temperature": 0.2, "num_ctx": 8192},
    }

    def fail(request, timeout):
        raise URLError("down")

    assert not OllamaProvider(config, fail).is_available()
    with pytest.raises(ProviderError, match="down"):
        OllamaProvider(config, fail).generate("p")
    assert available_providers() == ["ollama"] and isinstance(get_provider(config), OllamaProvider)
    config.provider = "none"
    with pytest.raises(ValueError, match="none"):
        get_provider(config)
    assert without_thinking("a<think>b</think>c") == "ac"


# -- fingerprints -------------------------------------------------------------------------


def test_fingerprints_move_with_what_is_shown(analyse):
    base = {
        "p/C.java": "package p; import java.util.List; import java.sql.X; public class C { Svc s; /** d */ public void go() { s.a(); } }",
        "p/Svc.java": "package p; public class Svc { void a() { int x = 1; } }",
    }

    def prints(**edits):
        files = dict(base)
        for name, (old, new) in edits.items():
            path = f"p/{name}.java"
            assert old in files[path]
            files[path] = files[path].replace(old, new)
        return {r.doc.split(".")[0]: r.hash for r in analyse(files).fingerprints.collect()}

    first = prints()
    moved = lambda **e: {d for d, h in prints(**e).items() if h != first[d]}
    assert moved(C=("/** d */", "/** other */"), Svc=("int x = 1;", "int y = 2;")) == set()
    assert moved(Svc=("void a()", "int a()")) == {"ARCHITECTURE", "SEQUENCE"}
    assert moved(C=("s.a();", "")) == {"ARCHITECTURE", "SEQUENCE"}
    assert moved(C=("Svc s;", "Svc s; int n;")) == {"ARCHITECTURE"}
    assert moved(C=("java.util.List", "org.other.List")) == {"README"}


def test_regeneration(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "0")], "doc string, hash string")
    assert values(regeneration(now, old), "doc", "write", "reason") == [("a", False, "unchanged"), ("b", True, "changed"), ("c", True, "initial")]
    assert {r.reason for r in regeneration(now, None).collect()} == {"initial"}
    assert {r.reason for r in regeneration(now, old, force=True).collect()} == {"forced"}


# -- runs -------------------------------------------------------------------------------------


def test_runs_over_a_changing_tree(spark, worktree, echo):
    config = load_config()
    provider = echo()
    runner = Runner(spark, worktree, config, provider)
    first = runner.update()
    assert (first.mode, first.files_scanned, first.files_parsed) == ("full (no prior state)", 6, 6)
    assert [(r.filename, r.written, r.reason) for r in first.doc_results] == [(d, True, "initial") for d in config.docs]
    readme = worktree / "docs/generated/README.md"
    assert readme.read_text().startswith("text 1\n\n---\n") and len(provider.prompts) == 3

    again = runner.update()
    assert again.message and not again.doc_results and again.files_reused == 6

    body = worktree / "quay/ship/Ship.java"
    body.write_text(body.read_text().replace("+ draught;", "+ draught + 0;"))
    edited = runner.update()
    assert (edited.files_parsed, edited.files_reused) == (1, 5)
    assert {r.reason for r in edited.doc_results} == {"unchanged"} and len(provider.prompts) == 3

    # an untracked file, and then an edit of it, which the version history never lists
    extra = worktree / "Extra.java"
    extra.write_text("package x; public class Extra { }")
    assert {r.filename: r.reason for r in runner.update().doc_results} == {
        "README.md": "changed", "ARCHITECTURE.md": "changed", "SEQUENCE.md": "unchanged",
    }
    extra.write_text("package x; public class Extra { int n; }")
    assert runner.update().files_parsed == 2  # with Ship.java, which still differs from the commit

    (worktree / TOWER).unlink()
    gone = runner.update()
    assert (gone.files_removed, gone.files_scanned) == (1, 6)
    assert {r.filename: r.reason for r in gone.doc_results}["SEQUENCE.md"] == "changed"
    assert StateStore(spark, worktree / ".sourceloom").load().complete


def test_an_update_writes_the_buckets_it_touches(spark, parse, tmp_path):
    """On a folder given as URI: other buckets stay in the first table; a removed file and an emptied bucket are gone."""
    store = StateStore(spark, f"file://{tmp_path}/state dir")
    files = {f"p{i}/C{i}.java": f"class C{i} {{}}" for i in range(40)}
    store.save(State("abc", store.write_snapshot(parse(files)), {"d": "1"}))
    fresh = parse({"p3/C3.java": "class Other {}"})
    edited = spark.createDataFrame([("p3/C3.java",), ("p5/C5.java",)], "path string")
    store.save(store.replace(store.load(), edited, lambda some: some.join(edited, "path", "left_anti").unionByName(fresh)))
    state = store.load()
    buckets = {r.b for r in edited.select(bucket_of(F.col("path")).alias("b")).collect()}
    assert {int(b) for b in state.replaced} == buckets and len(state.tables) == 2 and state.fingerprints == {"d": "1"} and not state.complete
    later = set(state.replaced.values()).pop()
    assert {int(p.name.split("=")[1]) for p in (tmp_path / "state dir" / later).glob("bucket=*")} <= buckets
    want = {p: c.split()[1] for p, c in files.items() if p != "p5/C5.java"} | {"p3/C3.java": "Other"}
    assert {r.path: r.classes[0].name for r in store.parsed(state).collect()} == want
    every = edited.filter("false").unionByName(store.parsed(state).select("path"))
    store.save(store.replace(state, every, lambda some: some.filter("false")))
    state = store.load()
    assert store.parsed(state).count() == 0 and (tmp_path / "state dir" / later).exists() == (later in state.tables)


def test_registered_documents(spark, analyse):
    analysis = analyse({"p/C.java": "package p; public class C {}"})
    kept = dict(prompts.PROMPTS), dict(prompts._PRINTS)
    try:
        prompts.register_document("API.md", lambda ctx: ctx.counts.select(F.lit("API.md").alias("doc"), F.lit("x").alias("prompt")))
        prompts.register_document("README.md", prompts.readme_prompt, lambda a: spark.range(1).select(F.lit("h").alias("hash")))
        got = {r.doc: r.hash for r in prompts.document_fingerprints(analysis).collect()}
    finally:
        for now, before in zip((prompts.PROMPTS, prompts._PRINTS), kept):
            now.clear()
            now.update(before)
    assert set(got) == {"README.md", "ARCHITECTURE.md", "SEQUENCE.md", "API.md"} and got["README.md"] == "h" and len(got["API.md"]) == 64


def test_an_older_snapshot_lacks_columns(spark, tmp_path):
    """Its lists and maps read as empty ones, also inside classes."""
    store = StateStore(spark, tmp_path)
    spark.sql("SELECT 'A.java' AS path, 'h' AS content_hash, array(named_struct('name', 'A')) AS classes").write.parquet(str(tmp_path / "old"))
    row = store.parsed(State(snapshot="old")).first()
    assert row.path == "A.java" and row.imports == [] and row.parse_errors == []
    assert row.classes[0].name == "A" and row.classes[0].methods == [] and row.classes[0].fields == []


def test_failing_provider_keeps_parsed_files_and_is_made_up_for(spark, worktree, echo):
    config = load_config(overrides={"docs": ["SEQUENCE.md", "UNKNOWN.md"]})
    with pytest.raises(ProviderError):
        Runner(spark, worktree, config, echo(fail_on="SEQUENCE.md")).full()
    state = StateStore(spark, worktree / ".sourceloom").load()
    assert not state.complete and state.snapshot
    summary = Runner(spark, worktree, config, echo()).update()
    assert [(r.filename, r.reason) for r in summary.doc_results] == [("SEQUENCE.md", "initial")] and summary.files_reused == 6


def test_scratch_deletes_its_own_tables_only(spark):
    kept = written(spark.range(3), "kept")
    with scratch(spark):
        gone = written(spark.range(2), "gone")
        assert gone.count() == 2
        path = gone.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert kept.count() == 3 and not os.path.exists(path)


def test_command_line(spark, worktree, tmp_path, echo, capsys):
    (worktree / "Bad.java").write_text("class {")
    assert cli.run(["scan", str(worktree)], spark) == 0
    out = capsys.readouterr().out
    assert "Files scanned:       7" in out and "Types discovered:" in out and "  - Bad.java: ['syntax error" in out
    assert "org.quay.ship (2 types)\n  - class Ship (1 methods, 1 internal deps)" in out
    assert cli.run(["generate", str(tmp_path)], spark) == 1
    assert "not inside a Git working tree" in capsys.readouterr().err
    assert cli.run(["update", str(worktree)], spark, echo(available=False)) == 1
    assert "is not available" in capsys.readouterr().err
    config = tmp_path / "c.yaml"
    config.write_text("docs: [SEQUENCE.md]")
    assert cli.run(["generate", str(worktree), "--config", str(config), "--output-dir", "out", "--force", "--log-level", "ERROR"], spark, echo()) == 0
    assert "[written] SEQUENCE.md (forced)" in capsys.readouterr().out and (worktree / "out/SEQUENCE.md").exists()
    with pytest.raises(SystemExit):
        cli.run(["--version"])


# -- stream ---------------------------------------------------------------------------------------


def test_stream_of_files(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    store = StateStore(spark, tmp_path / "state")

    def drain():
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        stream = stream.option("pathGlobFilter", "*.java").load(str(inbox)).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
        start_updates(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
        return {r.path: r.classes[0].name for r in store.parsed(store.load()).collect()}

    (inbox / "A.java").write_text("class A {}")
    assert drain() == {"A.java": "A"}
    before = store.load().snapshot
    assert drain() == {"A.java": "A"} and store.load().snapshot == before
    (inbox / "B.java").write_text("class B {}")
    assert drain() == {"A.java": "A", "B.java": "B"}
