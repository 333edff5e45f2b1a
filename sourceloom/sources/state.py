"""What one run leaves for the next: parsed files, last commit, fingerprints."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.sources.parse import FILE_SCHEMA

MANIFEST = "state.json"
BUCKETS = 64  # parts of a snapshot, by path: what an update writes again is whole buckets
MAX_TABLES = 16  # a snapshot of more tables is written anew as one


@dataclass
class State:
    last_commit: str = ""
    snapshot: str = ""
    fingerprints: dict[str, str] = field(default_factory=dict)
    complete: bool = True  # all documents of this snapshot were written
    replaced: dict[str, str] = field(default_factory=dict)  # bucket -> later table that has it instead of `snapshot`

    graph: str = ""  # where the tables that follow from the snapshot lie, if they are kept

    @property
    def tables(self) -> set[str]:
        kept = json.loads(self.graph)["tables"].values() if self.graph else []
        return {self.snapshot, *self.replaced.values(), *(part for t in kept for part in t["parts"].values())}


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def filled(value: Column, kind: T.DataType) -> Column:
    """`value` with empty lists and maps for NULL ones, also inside lists of structs."""
    if isinstance(kind, T.MapType):
        return F.coalesce(value, F.create_map().cast(kind))
    if isinstance(kind, T.ArrayType):
        whole = F.coalesce(value, F.array().cast(kind))
        return F.transform(whole, lambda x: filled(x, kind.elementType)) if isinstance(kind.elementType, T.StructType) else whole
    if isinstance(kind, T.StructType):
        parts = F.struct(*(filled(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), parts)
    return value


class StateStore:
    """A folder, on any file system Spark writes to, with Parquet tables of parsed files and a manifest.

    A table is written first and under a new name; the manifest is replaced
    last and at once.  A run that dies leaves the state as it was.
    """

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark = spark
        self.folder = f"file://{folder.resolve()}" if isinstance(folder, Path) else folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def _files(self):
        return self._path(MANIFEST).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def load(self) -> State | None:
        """The last state; None if there is none or it cannot be read."""
        try:
            stream = self._files.open(self._path(MANIFEST))
            try:
                data = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            state = State(data["last_commit"], data["snapshot"], data["fingerprints"], data["complete"], data.get("replaced", {}), data.get("graph", ""))
            return state if all(self._files.exists(self._path(t)) for t in state.tables) else None
        except (Py4JJavaError, ValueError, KeyError, TypeError):
            return None

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{FILE_SCHEMA}, bucket int").parquet(f"{self.folder}/{name}")

    def parsed(self, state: State, buckets: list[int] | None = None) -> DataFrame:
        """The snapshot's file rows, or those of some buckets; lists and maps that an older one lacks are empty, at any depth."""
        elsewhere = [int(b) for b in state.replaced]
        rows = self._table(state.snapshot)
        if elsewhere:
            rows = rows.filter(F.col("bucket").isNull() | ~F.col("bucket").isin(elsewhere))
        for table in sorted(set(state.replaced.values())):
            its = [int(b) for b, t in state.replaced.items() if t == table]
            rows = rows.unionByName(self._table(table).filter(F.col("bucket").isin(its)))
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        schema = T._parse_datatype_string(FILE_SCHEMA)
        return rows.select(*(filled(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields))

    def write_snapshot(self, parsed: DataFrame) -> str:
        """Rows as one table, a folder for every bucket; adaptive execution evens out its files."""
        name = f"files-{uuid.uuid4().hex}"
        rows = parsed.withColumn("bucket", bucket_of(F.col("path"))).hint("rebalance", F.col("bucket"))
        rows.write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return name

    def replace(self, state: State, paths: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> State:
        """`state` after `paths` were added, changed or removed; `merge` turns cached rows into current ones.

        Only the buckets of these paths are read and written.  A snapshot without buckets (an
        older one), or of too many tables, is written as a whole.
        """
        touched = [r["b"] for r in paths.select(bucket_of(F.col("path")).alias("b")).distinct().collect()]
        has_buckets = self._table(state.snapshot).filter("bucket is null").isEmpty()
        if not has_buckets or len({state.snapshot, *state.replaced.values()}) >= MAX_TABLES:
            return State(state.last_commit, self.write_snapshot(merge(self.parsed(state))), state.fingerprints, complete=False)
        table = self.write_snapshot(merge(self.parsed(state, touched)))
        return State(state.last_commit, state.snapshot, state.fingerprints, False, {**state.replaced, **{str(b): table for b in touched}})

    def save(self, state: State) -> None:
        before = self.load()
        data = json.dumps({**asdict(state), "saved_at": datetime.now(timezone.utc).isoformat()}, indent=2, sort_keys=True)
        part, manifest = self._path(f"{MANIFEST}.part"), self._path(MANIFEST)
        out = self._files.create(part, True)
        out.write(bytearray(data, "utf-8"))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
        how[0] = getattr(jvm, "Options$Rename").OVERWRITE
        jvm.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self._files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(part, manifest, how)
        for table in (before.tables - state.tables) if before else ():
            self._files.delete(self._path(table), True)
