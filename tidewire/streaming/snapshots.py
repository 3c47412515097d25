"""Streaming forms: change detection over arriving snapshots, and deduplication with a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.operators.state import DISABLE_AT, KEEP_DAYS


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """The first event of each key; state of a key is dropped once the watermark has passed it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def per_window(stream: DataFrame, key: str, time: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts of a key in windows of event time."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def _watcher(days: int, disable_at: int) -> Callable:
    """The function of ``watched``. It is made here, so that it is sent whole to the workers that run it."""

    def of(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """What is kept of a task: the hash of its last good snapshot, and how many have failed since."""
        if state.hasTimedOut:
            state.remove()
            return
        part = pd.concat(list(parts), ignore_index=True).sort_values(["fetched_at", "id"], kind="stable")
        last, streak = state.get if state.exists else (None, 0)
        made = []
        for id_, at, digest, failed in zip(part["id"], part["fetched_at"], part["content_hash"], part["failed"]):
            streak = streak + 1 if failed else 0
            status = "error" if failed else "new" if last is None else "unchanged" if last == digest else "changed"
            last = last if failed else digest
            made.append((key[0], id_, at, status, streak, "disabled" if streak >= disable_at else "blocked" if streak else "open"))
        state.update((last, streak))
        state.setTimeoutTimestamp(int(part["fetched_at"].max().timestamp() * 1000) + days * 86_400_000)
        yield pd.DataFrame(made, columns=["task", "id", "fetched_at", "status", "streak", "state"]).astype({"streak": "int32"})

    return of


#: The columns of a stream that is watched.
WATCHED = "task string, id long, fetched_at timestamp, content_hash string, failed boolean"


def watched(stream: DataFrame, days: int = KEEP_DAYS, delay: str = "1 day") -> DataFrame:
    """(task, id, fetched_at, status, streak, state) of arriving snapshots (``WATCHED``), in the order in which each task's were fetched.

    status: new, changed or unchanged against the task's last good snapshot, or error; streak: failures in a row; state: what the
    circuit breaker makes of them at that moment. A task keeps two values, which go when the watermark (``delay`` behind the newest
    snapshot of all) is ``days`` past its last snapshot, so state grows with the tasks that are alive and not with their
    histories; it is there again after a restart. Snapshots of a task that arrive together are put in order; one that is later
    than others but not behind the watermark is compared as it comes, and one that is behind it is dropped.
    """
    schema = "task string, id long, fetched_at timestamp, status string, streak int, state string"
    return stream.withWatermark("fetched_at", delay).groupBy("task").applyInPandasWithState(_watcher(days, DISABLE_AT), schema, "content_hash string, streak int", "append", GroupStateTimeout.EventTimeTimeout)


def start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch function over what is there, batch after batch, then stop; progress is kept in ``checkpoint``."""
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
