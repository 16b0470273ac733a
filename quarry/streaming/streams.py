"""Continuous processes on Structured Streaming; their batch twins are the operators of the same name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from quarry.operators.chunking import chunk_documents
from quarry.operators.quantiles import SMALL, percentiles
from quarry.operators.store import last_wins, read_chunks, write_chunks


def stream_latency(metrics: DataFrame, minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """Per tumbling window and mode: count, mean and approximate p95 of ``value``; ``ts`` is a timestamp."""
    w = F.window("ts", f"{minutes} minutes")
    return metrics.withWatermark("ts", late).groupBy(w.alias("w"), "mode").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile_approx("value", 0.95).alias("p95")).select(F.col("w.start").alias("start"), "mode", "n", "mean", "p95")


def window_latency(metrics: DataFrame, minutes: int = 1, small: int = SMALL) -> DataFrame:
    """The batch twin with exact figures; a window and mode of more than ``small`` rows never lies in one task."""
    rows = metrics.select(F.window("ts", f"{minutes} minutes")["start"].alias("start"), "mode", "value")
    found = percentiles(rows, ["start", "mode"], ["value"], [0.95], [F.count("*").alias("n"), F.avg("value").alias("mean")], small)
    return found.select("start", "mode", "n", F.bround("mean", 6).alias("mean"), F.bround("value_p95", 6).alias("p95"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FailedLogins(StatefulProcessor):
    """Anchored windows of one key: times wait, counted per second, until the watermark says that no earlier one can come."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "second long", "times long")
        self.open = handle.getValueState("open", "first long, count long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for g in rows:
            for t, n in (g["ts"].astype("datetime64[us]").astype("int64") // 10**6).value_counts().items():
                counts[int(t)] = counts.get(int(t), 0) + int(n)
        for t, n in counts.items():
            had = self.waiting.getValue((t,)) if self.waiting.containsKey((t,)) else (0,)
            self.waiting.updateValue((t,), (had[0] + n,))
        if counts:
            self.handle.registerTimer((min(counts) + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, done = timerValues.getCurrentWatermarkInMs(), []
        held = {k[0]: v[0] for k, v in self.waiting.iterator()}
        window = self.open.get() if self.open.exists() else None
        for t in sorted(t for t in held if (t + 1) * 1000 <= now):
            if window is not None and t < window[0] + self.seconds:
                window = (window[0], window[1] + held[t], t)
            else:
                if window is not None:
                    done.append(window)
                window = (t, held[t] - 1, t)
            self.waiting.removeKey((t,))
            del held[t]
        if window is not None and (window[0] + self.seconds + 1) * 1000 <= now:
            done.append(window)
            window = None
        if window is None:
            self.open.clear()
        else:
            self.open.update(window)
            self.handle.registerTimer((window[0] + self.seconds + 1) * 1000)
        if held:
            self.handle.registerTimer((min(held) + 1) * 1000)
        if done:
            yield pd.DataFrame([(key[0], f, n, last) for f, n, last in done], columns=["key", "first", "count", "last"]).astype({"first": "int64", "count": "int32", "last": "int64"})

    def close(self) -> None:
        pass


def stream_failed_logins(events: DataFrame, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """key, first, count, last (seconds): a record per anchored window once event time has passed it.

    The rows are those of ``collapse_failed_logins`` over all input that is not later than ``late``,
    whatever its order; later rows are dropped by Spark. A window is also told where its key has no
    new rows, as soon as others move the watermark on. State is typed and lies in RocksDB, which this
    sets for the session's new streams.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = events.schema["key"].dataType.simpleString()
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(FailedLogins(seconds), f"key {kind}, first long, count int, last long", "Append", "EventTime")


def stream_ingest(arriving: DataFrame, table_path: str, checkpoint: str, size: int = 1000, overlap: int = 200, strategy: str = "overlap"):
    """Each micro-batch is chunked and becomes a version of the table in which its documents' families are replaced.

    ``arriving``: source_file, text, seq. All or nothing per document: one over its limits is left as
    it was, and is noted (source_file, kind) in the version's failures. A version is committed under
    the stream's checkpoint and its batch's number, so a batch that is repeated is not written twice, and
    a stream with a new checkpoint continues an existing table. Nothing but new chunks is written.
    """

    def one(batch: DataFrame, number: int) -> None:
        latest = last_wins(batch.withColumnRenamed("source_file", "name"), "name", "seq").where("replaced_by is null").withColumnRenamed("name", "source_file")
        fresh, failed = chunk_documents(latest, strategy, size, overlap)
        names = latest.select("source_file").join(failed.select("source_file"), "source_file", "left_anti")
        version = write_chunks(fresh.select("source_file", "chunk_index", "content"), table_path, names=names, batch=f"{checkpoint}#{number}")
        failed.write.mode("overwrite").parquet(f"{table_path}/failures/version={version}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def ingested(spark: SparkSession, table_path: str, version: int | None = None) -> DataFrame:
    """source_file, chunk_index, content of a table that ``stream_ingest`` writes."""
    return read_chunks(spark, table_path, StructType.fromDDL("source_file string, chunk_index int, content string"), version)
