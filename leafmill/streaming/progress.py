"""Streams of progress events, polls and queue events.

State is bounded by a watermark or forgotten some time after a run's last event; only `completed_counts`
keeps the locations of every run, as exact counts need them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "run string, seq long, recorded_at timestamp, phase string, type string, location string, value double, status string"
POLL = "run string, attempts int, verdict string"
OWNED = "run string, seq long, recorded_at timestamp, type string, location string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Events that arrive as JSON-lines files; malformed lines give null rows, which are left out."""
    s = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return s.where(F.col("run").isNotNull() & F.col("recorded_at").isNotNull())


def phase_counts(events: DataFrame, window: str = "1 minute", late: str | None = "10 minutes") -> DataFrame:
    """(start, phase, n, last_value): tumbling windows by event time; what comes later than `late` is left out.

    `late` is None for events that have a watermark already.
    """
    w = (events.withWatermark("recorded_at", late) if late else events).groupBy(F.window("recorded_at", window).alias("w"), "phase")
    return w.agg(F.count("*").alias("n"), F.max("value").alias("last_value")).select(F.col("w.start").alias("start"), "phase", "n", "last_value")


def unique_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events once each, also when files are delivered again."""
    return events.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["run", "seq"])


def poll_stream(events: DataFrame, timeout: str = "60 seconds", cap: str = "90 seconds", keep: str = "1 day") -> DataFrame:
    """(run, attempts, verdict): each run's first final status, or `timeout` if none comes by its deadline.

    The deadline counts from a run's first event, in processing time, and is the lesser of `timeout` and
    `cap`: observations that stay incomplete don't put it off. A run ends once: its end is remembered
    for `keep`, so what arrives late gives no second verdict, and is then forgotten. Statuses are
    classed as in the batch form, in order of time and number within a batch. Time-outs keep batches
    coming: a query that is to end with its input sets `spark.sql.streaming.noDataMicroBatches.enabled` to false.
    """
    from leafmill.operators.evidence import status_class

    kinds = events.select("run", "recorded_at", "seq", status_class(F.col("status"), transient=True).alias("kind"))
    limit, memory = (int(min(pd.Timedelta(timeout), pd.Timedelta(cap)).total_seconds() * 1000), int(pd.Timedelta(keep).total_seconds() * 1000))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        attempts, done, deadline = state.get if state.exists else (0, False, now + limit)
        if state.hasTimedOut and done:
            state.remove()
            return
        verdict = None
        if not done:
            seen = pd.concat(list(frames)).sort_values(["recorded_at", "seq"])["kind"] if not state.hasTimedOut else []
            # at least one observation is made, whatever the deadline
            for kind in seen:
                if verdict or (attempts and now > deadline):
                    break
                attempts += 1
                verdict = kind if kind != "incomplete" else None
            if not verdict and now >= deadline:
                verdict = "timeout"
            done = verdict is not None
        state.update((attempts, done, deadline))
        state.setTimeoutDuration(memory if done else max(1, deadline - now))
        if verdict:
            yield pd.DataFrame({"run": [key[0]], "attempts": [attempts], "verdict": [verdict]})

    return kinds.groupBy("run").applyInPandasWithState(step, POLL, "attempts int, done boolean, deadline long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def owned_stream(events: DataFrame, owned: DataFrame, keep: str = "1 day") -> DataFrame:
    """(run, seq, recorded_at, type, location): events of owned locations, and a run's `all_complete` once it had one.

    A stream-static join tells what is owned, separators made alike; whether a run had an owned event is
    its state, which is forgotten after `keep` without events.
    """
    alike = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    o = owned.select(alike(F.col("location")).alias("_l")).distinct().withColumn("_own", F.lit(True))
    e = events.withColumn("_l", alike(F.col("location"))).join(o, "_l", "left").select("run", "seq", "recorded_at", "type", "location", F.coalesce("_own", F.lit(False)).alias("own"))
    e = e.where(F.col("own") | (F.col("type") == "all_complete"))
    memory = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (seen,) = state.get if state.exists else (False,)
        rows = pd.concat(list(frames)).sort_values("seq")
        had = rows["own"].cummax() | seen
        state.update((bool(had.iloc[-1]),))
        state.setTimeoutDuration(memory)
        out = rows[rows["own"] | ((rows["type"] == "all_complete") & had)]
        if len(out):
            yield out[["run", "seq", "recorded_at", "type", "location"]]

    return e.groupBy("run").applyInPandasWithState(step, OWNED, "seen boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def routed_stream(spark: SparkSession, routes: list[str], **options) -> DataFrame:
    """The event stream of the first of several folders that is there; none is an error, an empty one isn't."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    for r in routes:
        p = jvm(r)
        if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
            return event_stream(spark, r, **options)
    raise FileNotFoundError(", ".join(routes))


def emitted(events: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts writing a stream to an append-only log of JSON lines, sampled `every` so often, or all there is at once."""
    w = events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def until_cancelled(query, marker: str, pause: float = 1.0) -> str:
    """`completed` when a streaming query ends by itself, `cancelled` when it is stopped because the marker file appears."""
    while True:
        if os.path.exists(marker):
            query.stop()
            return "cancelled"
        if query.awaitTermination(pause):
            return "completed"


def completed_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(run, completed): how many documents of a run are complete, exactly; it never falls.

    The state holds the locations of each run: a count without them can only be estimated.
    """
    done = events.where(F.col("type") == "doc_complete").withWatermark("recorded_at", late)
    return done.groupBy("run").agg(F.size(F.collect_set("location")).alias("completed"))
