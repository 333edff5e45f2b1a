"""(path, content) rows -> one nested declaration row per file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.functions.naming import PLAIN_RECEIVER
from sourceloom.sources.registry import get_language

FILES_PER_BATCH = 256  # rows held as Python objects at a time

_NAMED = "array<struct<name string, type string>>"
_METHOD = (
    f"struct<name string, return_type string, parameters {_NAMED}, modifiers array<string>, "
    "annotations array<string>, annotation_args map<string,string>, doc_comment string, is_constructor boolean, "
    "start_line int, end_line int, calls array<struct<receiver string, method string>>, creates array<string>>"
)
_CLASS = (
    "struct<name string, kind string, qualified_name string, outer_ord int, modifiers array<string>, "
    "annotations array<string>, annotation_args map<string,string>, extends array<string>, implements array<string>, "
    "type_parameters array<string>, "
    "fields array<struct<name string, type string, modifiers array<string>, doc_comment string>>, "
    f"methods array<{_METHOD}>, doc_comment string, start_line int, end_line int>"
)
FILE_SCHEMA = (
    "path string, language string, content_hash string, package string, "
    "imports array<struct<path string, is_static boolean, is_wildcard boolean>>, "
    f"classes array<{_CLASS}>, parse_errors array<string>"
)


def file_hash(content):
    """SHA-256 of the bytes, lower-case hex."""
    return F.sha2(content, 256)


def _language_of(path, languages: list[str]):
    extension = F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1)
    column = F.lit(None).cast("string")
    for name in reversed(languages):
        column = F.when(extension.isin(*get_language(name).extensions), name).otherwise(column)
    return column


def _tidy_method(m):
    """Calls the receiver of which can be read off the text, each once; created types, sorted."""
    calls = F.filter(
        m["calls"],
        lambda c: c["receiver"].isNull() | (c["receiver"] == "this") | c["receiver"].rlike(PLAIN_RECEIVER),
    )
    # as strings, among which distinct is hashed: neither part has a dot, and no receiver is empty
    told = F.array_distinct(F.transform(calls, lambda c: F.concat(F.coalesce(c["receiver"], F.lit("")), F.lit("."), c["method"])))
    receiver, method = (lambda s: F.nullif(F.substring_index(s, ".", 1), F.lit(""))), (lambda s: F.substring_index(s, ".", -1))
    m = m.withField("calls", F.transform(told, lambda s: F.struct(receiver(s).alias("receiver"), method(s).alias("method"))))
    return m.withField("creates", F.array_sort(F.array_distinct(m["creates"])))


def parse_files(contents: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Parse every file of a registered language.

    `contents` has `path` (relative, `/` separated) and `content` (binary).
    Rows stay in their partitions: there is no shuffle in this step.
    """
    languages = languages or ["java"]
    schema = T._parse_datatype_string(FILE_SCHEMA)
    scanners = {name: get_language(name).scan for name in languages}

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        pieces = (b.slice(at, FILES_PER_BATCH) for b in batches for at in range(0, b.num_rows, FILES_PER_BATCH))
        for piece in pieces:
            rows = []
            for row in piece.to_pylist():
                text = row.pop("content").decode("utf-8", errors="replace")
                rows.append({**row, **scanners[row["language"]](text)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    parsed = (
        contents.select("path", "content", _language_of(F.col("path"), languages).alias("language"))
        .filter("language is not null")
        .withColumn("content_hash", file_hash(F.col("content")))
        .mapInArrow(scan, schema)
    )
    return parsed.withColumn(
        "classes",
        F.transform(
            "classes", lambda c: c.withField("methods", F.transform(c["methods"], _tidy_method))
        ),
    )
