"""The incremental update with files arriving as a stream.

Each micro-batch of (path, modificationTime, content), the columns of Spark's
`binaryFile` stream, is what an update is: rows whose bytes are known are passed
over, others are parsed and replace what the snapshot has for their path.  Replaying a batch changes nothing, so the state is exact after a
restart from the stream's checkpoint.  Only the buckets of the snapshot that hold the batch's paths are written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourceloom.session import scratch, written
from sourceloom.sources.parse import file_hash, parse_files
from sourceloom.sources.state import State, StateStore


def apply_batch(batch: DataFrame, store: StateStore, languages: list[str]) -> None:
    """Merge one batch into the snapshot; of several versions of a path the last modified counts."""
    last = batch.groupBy("path").agg(F.max_by("content", F.struct("modificationTime", "content")).alias("content"))
    latest = written(last.withColumn("content_hash", file_hash(F.col("content"))), "batch")
    before = store.load()
    if before is None:
        store.save(State(snapshot=store.write_snapshot(parse_files(latest, languages)), complete=False))
        return
    cached = store.parsed(before)
    known = cached.select("path", "content_hash")
    fresh = written(latest.join(known, ["path", "content_hash"], "left_anti"), "batch-fresh")
    if fresh.isEmpty():
        return

    def merge(some: DataFrame) -> DataFrame:
        return some.join(fresh.select("path"), "path", "left_anti").unionByName(parse_files(fresh, languages))

    store.save(store.replace(before, fresh.select("path"), merge))


def start_updates(contents: DataFrame, store: StateStore, checkpoint: str, languages: list[str] | None = None) -> StreamingQuery:
    """Merge what a stream of files has into the snapshot, and stop."""
    languages = languages or ["java"]

    def merge(batch: DataFrame, _: int) -> None:
        with scratch(batch.sparkSession):
            apply_batch(batch, store, languages)

    return (
        contents.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
