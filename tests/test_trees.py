"""Trees of folders against comparing every file."""

import random

import pytest

from sourceloom.operators.changes import compare_snapshots
from sourceloom.plans.trees import SnapshotTree, changed_files, changed_folders, folder_digests
from sourceloom.sources.buckets import bucket_of

FILE = "path string, content_hash string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def ancestors(path, depth):
    parts = path.split("/")
    return [(k, "/".join(parts[:k])) for k in range(min(len(parts) - 1, depth) + 1)]


def plain_folders(old, new, depth):
    out = {}
    for side, files in enumerate((old, new)):
        for item in files.items():
            for f in ancestors(item[0], depth):
                out.setdefault(f, (set(), set()))[side].add(item)
    kind = lambda a, b: "added" if not a else "removed" if not b else "modified"
    return sorted(((*f, kind(a, b), len(a), len(b)) for f, (a, b) in out.items() if a != b), key=repr)


@pytest.mark.parametrize("depth", [0, 2, 4])
def test_trees_against_plain_comparison(spark, tmp_path, depth):
    rng = random.Random(depth)
    old = {"/".join(["src", f"a{rng.randrange(3)}", "", f"b{rng.randrange(9)}"][: rng.randrange(5)] + [f"F{i}"]): f"h{i % 7}" for i in range(200)}
    old |= {"/F": "x", "//F": "x"}
    removed = [*rng.sample(sorted(old), 9), "never/there"]
    put = {p: "new" for p in [*rng.sample(sorted(old), 6), removed[0], "other/a/b/c/d/e", "src/a0/N"]} | {"plain": ""}
    nulls = [(None, "x"), ("no/hash", None)]
    new = {**{p: h for p, h in old.items() if p not in removed}, **put}
    before = SnapshotTree.build(spark.createDataFrame([*old.items(), *nulls], FILE), str(tmp_path), depth)
    after = before.edited(spark.createDataFrame([(p,) for p in removed], "path string"), spark.createDataFrame([*put.items(), *nulls], FILE))
    assert rows(after.files.rows().select("path", "content_hash")) == sorted(new.items(), key=repr)
    assert rows(after.folders.rows().select(*folder_digests(after.files.rows(), depth).columns)) == rows(folder_digests(after.files.rows(), depth))
    assert rows(changed_folders(before, after)) == plain_folders(old, new, depth)
    want = {p: "added" if p not in old else "removed" if p not in new else "modified" for p in {*old, *new} if (p in old, old.get(p)) != (p in new, new.get(p))}
    assert rows(changed_files(before, after)) == sorted(want.items(), key=repr)
    assert rows(changed_files(after, after)) == [] == rows(changed_folders(after, after))
    with pytest.raises(ValueError):
        changed_folders(before, SnapshotTree(depth + 1, after.files, after.folders))


def test_only_folders_that_differ_are_opened(spark, tmp_path):
    files = spark.createDataFrame([(f"top{i}/F{k}", "h") for i in range(40) for k in range(5)], FILE)
    old = SnapshotTree.build(files, str(tmp_path))
    new = old.edited(spark.createDataFrame([], "path string"), spark.createDataFrame([("top3/F1", "other")], FILE))
    bucket = lambda *names: {r[0] for r in spark.createDataFrame([(n,) for n in names], "folder string").select(bucket_of("folder")).collect()}
    assert {b for b in old.files.parts if old.files.parts[b] != new.files.parts[b]} == bucket("top3")
    may_open = bucket("top3", "")  # files right below the root are compared whenever anything differs
    shut = [f for f in tmp_path.glob("tree-files-*/bucket=*/*.parquet") if int(f.parent.name.split("=")[1]) not in may_open]
    for f in shut:
        f.write_bytes(b"not to be read")
    assert len(shut) > 10 and rows(changed_files(old, new)) == [("top3/F1", "modified")]


def test_empty_trees(spark, tmp_path):
    nothing = spark.createDataFrame([], FILE)
    empty = SnapshotTree.build(nothing, str(tmp_path))
    full = empty.edited(nothing.select("path"), spark.createDataFrame([("a/b", "h")], FILE))
    assert rows(changed_files(empty, empty)) == [] == rows(changed_folders(empty, empty))
    assert rows(changed_files(empty, full)) == [("a/b", "added")]
    assert rows(changed_folders(full, empty)) == [(0, "", "removed", 1, 0), (1, "a", "removed", 1, 0)]
    assert rows(full.edited(spark.createDataFrame([("a/b",)], "path string"), nothing).folders.rows()) == []
