"""Keyed state over event streams, with batch twins that give the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tamnan.operators.ranking import lagged_within

#: Seconds a chat is remembered, chats remembered, rows of the monitor.
TTL_S, CAPACITY, RING = 900, 500, 100


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stream of event files; the schema is that of the files, ``ts`` as event time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def remembered(events: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """Batch twin of :func:`remember`: each event with what its user did last, if within ``ttl_s``."""
    before = lagged_within(events.select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], {"event_type": "b", "ts": "bt"})
    fresh = F.expr(f"timestampdiff(MICROSECOND, bt, ts) <= {ttl_s}000000")
    return before.select("event_id", "user_id", F.when(fresh, F.col("b")).alias("previous"))


def remember(events: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """(event_id, user_id, previous) with the last event of each user kept as state until it is ``ttl_s`` old.

    State grows with the users seen within the TTL only: a timeout in event time removes the others.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kind, at = state.get if state.exists else (None, None)
        out = []
        for r in rows.itertuples():
            t = pd.Timestamp(r.ts)
            fresh = kind is not None and t - pd.Timestamp(at) <= timedelta(seconds=ttl_s)
            out.append((r.event_id, key[0], kind if fresh else None))
            kind, at = r.event_type, t.isoformat()
        state.update((kind, at))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(at).timestamp() * 1000) + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "previous"])

    timed = events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", f"{ttl_s} seconds")
    return timed.groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint, previous string", "kind string, at string", "append", GroupStateTimeout.EventTimeTimeout)


def newest(events: DataFrame, rows: int = RING) -> DataFrame:
    """The ring buffer as a query: the newest rows, ties to the larger id."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(rows)


def ring_sink(path: str, rows: int = RING):
    """A foreachBatch function that keeps the newest ``rows`` in a parquet table, rewritten by batch id.

    A batch adds to the folder of the largest smaller id, so a retried batch writes what it wrote before; older folders
    than that are removed once the new one is complete.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keep = batch
        folders = _folders(spark, path)
        before = [f for i, f in folders if i < batch_id]
        if before:
            keep = keep.unionByName(spark.read.parquet(before[-1]))
        newest(keep, rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")
        for f in before[:-1]:
            _delete(spark, f)

    return write


def ring_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete state of a ring sink; None if it has none."""
    folders = _folders(spark, path)
    return spark.read.parquet(folders[-1][1]) if folders else None


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(batch id, folder) of the complete batches, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        return []
    names = [s.getPath().toString() for s in fs.listStatus(hadoop(path))]
    return sorted((int(n.rsplit("batch=", 1)[1]), n) for n in names if "batch=" in n and fs.exists(hadoop(f"{n}/_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def answered(requests: DataFrame, replies: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Stream-stream join of requests (id, asked) and replies (id, replied), both watermarked."""
    a = requests.withWatermark("asked", within)
    b = replies.withWatermark("replied", within)
    return a.join(b.withColumnRenamed("id", "rid"), F.expr(f"id = rid AND replied >= asked AND replied <= asked + INTERVAL {within}")).select("id", "asked", "replied")
