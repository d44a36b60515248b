"""Streams of tables: windowed counts with late rows, first sightings, and per-host politeness with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from searchlake.session import scratch_path


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """The files of a table as a stream, with the schema of those that are there."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)  # a stream's source is a folder
    return reader.parquet(path)


def drain(stream: DataFrame, label: str = "stream", mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into the shared folder, and read what it wrote.

    Its checkpoint lies there too: a run that is stopped goes on where it was.
    """
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, label)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """(begin, end, key, n) of closed windows; rows later than `late` behind the newest are dropped."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide or window).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), key, "n")


def first_seen(stream: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Each key once: a frontier that takes a url only the first time within a span."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def polite_visits(stream: DataFrame, host: str, ts: str, gap_ms: int, late: str = "1 day", forget_ms: int = 86_400_000) -> DataFrame:
    """(host, ts_ms, ready_at_ms): each visit with the time when it may go, a host's visits being gap_ms apart.

    A host's visits of one micro-batch go in order of time, whatever Arrow batches they come in; of
    each only its time is held. The state of a host is when its last visit was let go; it is dropped
    when the newest visits are `forget_ms` past it. Visits later than `late`, and those of 1970's first instant, are dropped.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        asked = np.sort(np.concatenate([np.empty(0, np.int64), *[b["ts_ms"].to_numpy(np.int64) for b in batches]]))
        if not len(asked):
            return
        steps = gap_ms * np.arange(len(asked), dtype=np.int64)
        slack = asked - steps
        if state.exists:
            slack[0] = max(slack[0], state.get[0] + gap_ms)
        ready = np.maximum.accumulate(slack) + steps
        for k in range(0, len(asked), 100_000):
            yield pd.DataFrame({"host": str(key[0]), "ts_ms": asked[k : k + 100_000], "ready_at_ms": ready[k : k + 100_000]})
        state.update((int(ready[-1]),))
        state.setTimeoutTimestamp(max(int(ready[-1]), state.getCurrentWatermarkMs()) + forget_ms)

    rows = stream.where(F.col(host).isNotNull() & F.col(ts).isNotNull()).select(F.col(host).cast("string").alias("host"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    rows = rows.withColumn("ts_ms", F.unix_millis("at"))
    return rows.groupBy("host").applyInPandasWithState(decide, "host string, ts_ms long, ready_at_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
