"""Files of a Git working tree, and what changed in it.

Git itself runs on the driver; file contents are read by the tasks, so the
tree must lie on a file system that all executors see.
"""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.operators.changes import CHANGE_SCHEMA
from sourceloom.sources.registry import language_extensions


class NotAWorkTreeError(RuntimeError):
    """The folder is not inside a Git working tree."""


class GitError(RuntimeError):
    """A Git command failed."""


def git(root: str | Path, *arguments: str) -> str:
    done = subprocess.run(["git", "-C", str(root), *arguments], capture_output=True, text=True, check=False)
    if done.returncode:
        raise GitError(f"git {arguments[0]}: {done.stderr.strip()}")
    return done.stdout


def is_work_tree(root: str | Path) -> bool:
    try:
        return git(root, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except GitError:
        return False


def current_commit(root: str | Path) -> str:
    """Hash of HEAD; empty in a repository without commits."""
    try:
        return git(root, "rev-parse", "HEAD").strip()
    except GitError:
        return ""


def has_uncommitted_changes(root: str | Path) -> bool:
    return git(root, "status", "--porcelain").strip() != ""


def parse_name_status(raw: str) -> list[tuple[str, str, str | None]]:
    """NUL-separated `--name-status -z` output -> (status, path, old path).

    A, M and D have one path, R has the old and the new one; anything else
    counts as M with one path.
    """
    rows, tokens = [], iter([t for t in raw.split("\0") if t])
    for token in tokens:
        status = token[0] if token[0] in "AMDR" else "M"
        old = next(tokens) if status == "R" else None
        rows.append((status, next(tokens), old))
    return rows


def changes_since(spark: SparkSession, root: str | Path, commit: str) -> DataFrame:
    """Change set between a commit and the working tree, with paths below `root`; empty without a commit."""
    raw = git(root, "diff", "--relative", "--name-status", "-M", "-z", commit, "--") if commit else ""
    return spark.createDataFrame(parse_name_status(raw), CHANGE_SCHEMA)


def is_excluded(path: Column, patterns: list[str]) -> Column:
    """True where a glob matches the path; a leading `**/` may also stand for nothing.

    All globs become one regular expression.
    """
    globs = {g: None for p in patterns for g in ([p, p[3:]] if p.startswith("**/") else [p])}
    if not globs:
        return F.lit(False)
    # Python ends a translated glob with \Z, which in Java also matches before a final newline
    either = "|".join(re.sub(r"\\Z$", r"\\z", fnmatch.translate(g)) for g in globs)
    return path.rlike(rf"\A(?:{either})")


def has_extension(path: Column, extensions: set[str]) -> Column:
    return F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1).isin(*sorted(extensions))


def list_files(spark: SparkSession, root: str | Path, exclude_patterns: list[str] | None = None) -> DataFrame:
    """(path) of every regular file Git tracks or would track, but for the excluded."""
    root = Path(root).resolve()
    if not is_work_tree(root):
        raise NotAWorkTreeError(f"{root} is not inside a Git working tree")
    names = [n for n in git(root, "ls-files", "-c", "-o", "--exclude-standard", "-z").split("\0") if n]
    listed = spark.createDataFrame([(n,) for n in names if (root / n).is_file()], "path string")
    return listed.filter(~is_excluded(F.col("path"), exclude_patterns or []))


def source_files(listed: DataFrame, languages: list[str]) -> DataFrame:
    return listed.filter(has_extension(F.col("path"), language_extensions(languages)))


def read_contents(paths: DataFrame, root: str | Path) -> DataFrame:
    """(path, content): the bytes of every listed file, read where its row is."""
    base = str(Path(root).resolve())

    def read(batches):
        for batch in batches:
            names = batch.column("path").to_pylist()
            for at in range(0, len(names), 100):
                some = names[at : at + 100]
                contents = []
                for name in some:
                    with open(os.path.join(base, name), "rb") as file:
                        contents.append(file.read())
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(contents, pa.binary())], names=["path", "content"])

    return paths.select("path").mapInArrow(read, "path string, content binary")


def read_folder(spark: SparkSession, folder: str, name_glob: str = "*.java") -> DataFrame:
    """(path, content) of a folder on any file system Spark reads, Git or not."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name_glob).option("recursiveFileLookup", "true").load(folder)
    prefix = r"^([a-z0-9]+:)?/*" + re.escape(re.sub(r"^[a-z0-9]+:/*|/+$", "", folder).lstrip("/")) + "/"
    return files.select(F.regexp_replace("path", prefix, "").alias("path"), "content")
