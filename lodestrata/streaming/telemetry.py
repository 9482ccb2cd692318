"""Usage telemetry: event-time windows, sessions, breakers, over streams and over tables alike."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str, glob: str = "*.parquet", files: int = 1) -> DataFrame:
    """A file stream of events; the time column is cast, as watermarks take time stamps with a zone only."""
    found = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: str, slide: str | None = None, late: str = "10 minutes", by: str = "event_type", value: str = "value") -> DataFrame:
    """by, start, stop, n, total in tumbling or sliding windows; rows later than the watermark are dropped by a stream."""
    time = F.window("ts", window, slide) if slide else F.window("ts", window)
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(time.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """by, start, stop, n: runs of events with no longer pause than the gap."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, and gives the result table."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Appends a stream's results to a Parquet table: what a watermark has closed, each row once, however often the run is
    started again. checkpoint lies in the shared folder."""
    query = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.parquet(path)


def matched(asked: DataFrame, answered: DataFrame, by: str, within: str, late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """by, asked_at, answered_at: what happens to the same key within a time after it was asked, both ends included (asked and
    answered: by, ts). Of two streams each side is held only as long as the watermarks say that a partner may still come; with
    how = "left_outer" what was never answered comes once that time is over. Null keys match nothing."""
    late_by = lambda rows: rows.withWatermark("ts", late) if rows.isStreaming else rows
    one = late_by(asked.select(by, "ts")).alias("q")
    two = late_by(answered.select(by, "ts")).alias("a")
    near = F.expr(f"q.`{by}` = a.`{by}` AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL {within}")
    return one.join(two, near, how).select(F.col(f"q.{by}").alias(by), F.col("q.ts").alias("asked_at"), F.col("a.ts").alias("answered_at"))


def exactly_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a table that holds each batch's rows once. A batch is a folder of its number, which
    is written anew when the batch is run again: after a failure between the write and the commit nothing is there twice. Both
    folders are shared; a table belongs to one checkpoint. Gives the table, with the column batch."""
    schema = df.schema

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(schema.add("batch", "long")).parquet(path)


def breaker_states(events: DataFrame, by: str = "user_id", failed: str = "error", failures: int = 3, open_for: float = 60.0) -> DataFrame:
    """by, ts, opened: where a breaker opens, after so many failures in a row while it is closed. A stateful walk for each key;
    the state is two numbers, carried from batch to batch when `events` is a stream."""

    def walk(key, batches, state):
        row, until = state.get if state.exists else (0, 0.0)
        out = []
        for batch in batches:
            for ts, kind in zip(batch["ts"], batch["event_type"], strict=True):
                now = ts.timestamp()
                if now < until:
                    continue
                row = row + 1 if kind == failed else 0
                if row >= failures:
                    out.append((key[0], ts))
                    row, until = 0, now + open_for
        state.update((row, until))
        yield pd.DataFrame(out, columns=[by, "ts"])

    kind = events.schema[by].dataType.simpleString()
    if events.isStreaming:
        return events.groupBy(by).applyInPandasWithState(walk, f"{by} {kind}, ts timestamp", "row int, until double", "append", "NoTimeout")

    class Held:
        exists = False

        def update(self, value) -> None:
            self.get, self.exists = value, True

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return next(walk(key, [rows.sort_values("ts")], Held()))

    return events.groupBy(by).applyInPandas(whole, f"{by} {kind}, ts timestamp")
