"""A table in buckets of one of its columns: what a change writes again is whole buckets."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
MAX_TABLES = 16  # parts beyond which the table is written anew as one


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def side_by_side(*jobs: Callable) -> list:
    """Results of jobs that don't wait for each other; each mostly waits for Spark."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def touched(rows: DataFrame, key: str) -> list[int]:
    """The buckets that the values of `key` lie in: BUCKETS numbers at most."""
    return sorted(r["b"] for r in rows.select(bucket_of(key).alias("b")).distinct().collect())


@dataclass(frozen=True)
class BucketTable:
    """Rows by bucket of `key`; `parts` says which folder has a bucket.  Never changed: a change gives another one."""

    spark: SparkSession
    folder: str
    name: str
    key: str
    schema: T.StructType
    parts: dict[int, str]

    @classmethod
    def build(cls, rows: DataFrame, folder: str, name: str, key: str) -> BucketTable:
        empty = cls(rows.sparkSession, folder, name, key, rows.schema, {})
        part = empty._write(rows)
        return empty._with(dict.fromkeys(range(BUCKETS), part))

    def _with(self, parts: dict[int, str]) -> BucketTable:
        return BucketTable(self.spark, self.folder, self.name, self.key, self.schema, parts)

    def _write(self, rows: DataFrame) -> str:
        part = f"{self.name}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", bucket_of(self.key)).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.folder}/{part}")
        return part

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; no file of another bucket is opened."""
        wanted = range(BUCKETS) if buckets is None else buckets
        columns = [f.name for f in self.schema]
        schema = T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())])
        out = None
        for part in sorted({self.parts[b] for b in wanted}):
            its = [b for b in wanted if self.parts[b] == part]
            some = self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")
            some = (some if len(its) == BUCKETS else some.filter(F.col("bucket").isin(its))).select(*columns)
            out = some if out is None else out.unionByName(some)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is among `keys` (a column of the same name, distinct)."""
        return self.rows(touched(keys, self.key)).join(keys.select(self.key), self.key, "left_semi").select(*(f.name for f in self.schema))

    def replaced(self, buckets: list[int], rows: DataFrame) -> BucketTable:
        """The table with `rows` as all there is in `buckets`."""
        if not buckets:
            return self
        part = self._write(rows.select(*(f.name for f in self.schema)))
        after = self._with({**self.parts, **dict.fromkeys(buckets, part)})
        return after if len(set(after.parts.values())) <= MAX_TABLES else BucketTable.build(after.rows(), self.folder, self.name, self.key)

    def manifest(self) -> dict[str, str]:
        return {str(b): p for b, p in self.parts.items()}
