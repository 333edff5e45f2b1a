"""Moved files against comparing every pair."""

import random
import re
from collections import Counter

from sourceloom.operators import renames as module
from sourceloom.operators.changes import changed_paths, removed_paths
from sourceloom.operators.renames import one_to_one, renames, similar, with_renames

FILE = "path string, content string"


def bag(text):
    return Counter({line: (len(line.encode()) + 1) * k for line, k in Counter(text.split("\n")).items()})


def plain(old, new, percent=50):
    old, new = ({p: c or "" for p, c in files} for files in (old, new))
    out = []
    for text in {*old.values()} & {*new.values()}:
        out += [(a, b, 100) for a, b in zip(sorted(p for p in old if old[p] == text), sorted(p for p in new if new[p] == text))]
    pairs = []
    for p in (p for p in old if old[p] and p not in {a for a, _, _ in out}):
        for q in (q for q in new if new[q] and q not in {b for _, b, _ in out}):
            a, b = bag(old[p]), bag(new[q])
            common, larger = sum((a & b).values()), max(sum(a.values()), sum(b.values()))
            if common * 100 >= larger * percent:
                pairs.append((-(common * 100 // larger), p, q))
    used = set()
    for score, p, q in sorted(pairs):
        if p not in used and q not in used:
            used |= {p, q}
            out.append((p, q, -score))
    return sorted(out)


def test_renames_of_edited_files(spark):
    rng = random.Random(3)
    lines = [f"line {i} " + "x" * rng.randrange(30) for i in range(60)] + ["", "}", "import ä;"] * 3
    old, new = [], []
    for i in range(120):
        text = [rng.choice(lines) for _ in range(rng.randrange(1, 25))]
        old.append((f"old/{i}", "\n".join(text)))
        if i % 2:
            for _ in range(rng.randrange(12)):
                if text and rng.random() < 0.5:
                    text.pop(rng.randrange(len(text)))
                else:
                    text.insert(rng.randrange(len(text) + 1), rng.choice(lines))
            new.append((f"new/{rng.randrange(10**6)}", "\n".join(text)))
    old += [("old/e", ""), ("old/n", None), ("old/x", "a\nb"), ("old/y", "a\nb")]
    new += [("new/e", ""), ("new/x", "a\nb"), ("new/half", "a\nc")]
    got = renames(spark.createDataFrame(old, FILE), spark.createDataFrame(new, FILE)).collect()
    assert sorted((r["old_path"], r["path"], r["score"]) for r in got) == plain(old, new)
    assert {r["status"] for r in got} == {"R"}


def test_copies_of_edited_files(spark, monkeypatch):
    """Copies whose edited copies are as similar to those of other texts: what comparing every pair gives, in few rounds."""
    rng = random.Random(5)
    base = [f"line {i:02}" for i in range(40)]
    old, new, names = [], [], rng.sample(range(10**6), 400)
    for text in range(6):
        lines = [*base[: 30 + text % 3], f"own {text % 2} {text}"] if text < 4 else [f"apart {text} {i}" for i in range(20)]
        old += [(f"old/{names.pop()}", "\n".join(lines)) for _ in range(rng.randrange(1, 25))]
        new += [(f"new/{names.pop()}", "\n".join(lines[:-1] + [""] * (text == 2))) for _ in range(rng.randrange(1, 25))]
    got = renames(spark.createDataFrame(old, FILE), spark.createDataFrame(new, FILE)).collect()
    assert sorted((r["old_path"], r["path"], r["score"]) for r in got) == plain(old, new)

    one = "\n".join(base)
    rounds, keep = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: (rounds.append(name), keep(df, name))[1])
    found = renames(spark.createDataFrame([(f"o{i:03}", one) for i in range(150)], FILE), spark.createDataFrame([(f"n{i:03}", one + "x") for i in range(150)], FILE))
    assert sorted((r["old_path"], r["path"]) for r in found.collect()) == [(f"o{i:03}", f"n{i:03}") for i in range(150)]
    assert rounds.count("renames") == 1


def test_half_the_bytes_are_enough(spark):
    """At exactly the bound a pair counts, one byte below it doesn't."""
    old = spark.createDataFrame([("o", "abc\nxyz")], FILE)
    new = spark.createDataFrame([("half", "abc\nuvw"), ("less", "abc\nuvwx")], FILE)
    assert [tuple(r) for r in similar(old, new).collect()] == [("o", "half", 4, 8)]


def test_the_best_come_first(spark):
    """A chain: each would rather have the next one's partner."""
    pairs = [("a", "x", 60), ("b", "x", 70), ("b", "y", 80), ("c", "y", 90), ("c", "z", 95), ("d", "z", 95)]
    got = one_to_one(spark.createDataFrame(pairs, "old_path string, path string, score int")).collect()
    assert sorted(map(tuple, got)) == [("a", "x", 60), ("b", "y", 80), ("c", "z", 95)]
    assert one_to_one(spark.createDataFrame([], "old_path string, path string, score int")).collect() == []


def test_change_set_with_renames(spark):
    changes = spark.createDataFrame([("D", "o", None), ("A", "n", None), ("D", "gone", None), ("M", "m", None)], "status string, path string, old_path string")
    found = renames(spark.createDataFrame([("o", "a\nb\nc")], FILE), spark.createDataFrame([("n", "a\nb\nd")], FILE))
    told = with_renames(changes, found)
    assert sorted(map(repr, (tuple(r) for r in told.collect()))) == sorted(map(repr, [("R", "n", "o"), ("D", "gone", None), ("M", "m", None)]))
    assert {r["path"] for r in changed_paths(told).collect()} == {"n", "m"} and {r["path"] for r in removed_paths(told).collect()} == {"o", "gone"}


def test_files_all_alike_are_gone_through_in_order(spark, monkeypatch):
    """Texts that are all as similar to one another: a round takes few of their pairs, so few steps follow it, whole or in pieces."""
    rng = random.Random(7)
    base = [f"line {i:02}" for i in range(12)]
    names, old, new = rng.sample(range(10**6), 400), [], []
    for text in range(40):
        old += [(f"old/{names.pop()}", "\n".join([*base, f"own {text:02}"])) for _ in range(rng.choice((1, 1, 1, 3)))]
        new += [(f"new/{names.pop()}", "\n".join([*base[text % 3 :], f"new {text:02}"])) for _ in range(rng.choice((1, 1, 1, 4)))]
    old += [(f"é/{i}", "\n".join([*base, *f"{i}"])) for i in range(3)]
    steps, keep = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: (steps.append(name), keep(df, name))[1])
    for at_once, most in ((module.AT_ONCE, 1), (250, 12)):
        monkeypatch.setattr(module, "AT_ONCE", at_once)
        steps.clear()
        got = renames(spark.createDataFrame(old, FILE), spark.createDataFrame(new, FILE)).collect()
        assert sorted((r["old_path"], r["path"], r["score"]) for r in got) == plain(old, new)
        assert steps.count("renames") + steps.count("renames-in-order") <= 1 + most
    monkeypatch.setattr(module, "AT_ONCE", 4)  # too few for any text: rounds as before
    got = renames(spark.createDataFrame(old[:9], FILE), spark.createDataFrame(new[:9], FILE)).collect()
    assert sorted((r["old_path"], r["path"], r["score"]) for r in got) == plain(old[:9], new[:9])


def test_the_last_lines_of_moved_documents(spark, tmp_path):
    """`renamed_files` cuts the last line off, whatever the text ends in."""
    import __spark_entry__ as entry

    texts = ["a\nb\nc", "one line", "ends\n", "two\n\n", "ä ö\r\nü", "", None, "\n", "x\ny\n z"]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(8, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a\nb\nc")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    moved = [(f"moved/{i}", re.sub(r"\n[^\n]*\Z", "", t or "")) for i, t in enumerate(texts) if i != 8] + [("benchmark/1", texts[0])]
    got = entry.renamed_files(spark, str(tmp_path)).collect()
    assert sorted((r["old_path"], r["path"], r["score"]) for r in got) == plain([(f"s/{i}", t) for i, t in enumerate(texts)], moved)
