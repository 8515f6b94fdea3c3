"""Timing analytics over progress events, traces and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The share of wall-clock time each phase counts for.
BUCKETS = {
    "metadata": "preparation", "extraction": "preparation", "candidate_evaluation": "preparation", "payloads": "preparation", "attachments": "preparation",
    "queue_receipt": "submission", "desktop_queue": "shared_ingestion", "identity_set": "shared_ingestion", "retrieval_sample": "validation", "validation": "validation", "reporting": "reporting",
}
CHECKPOINTS = (20, 40, 60, 80)


def bucket_of(phase: Column) -> Column:
    """The bucket of a known phase, null for an unknown one, `unattributed` for a blank one."""
    table = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])
    return F.when(F.coalesce(phase, F.lit("")) == "", "unattributed").otherwise(F.try_element_at(table, phase))


def wall_clock(events: DataFrame, run: str = "run") -> DataFrame:
    """(run, bucket, seconds): every second of a run counted once, for the bucket in force since the event before.

    `events` has run, at (seconds), phase, seq (breaks ties), started and finished. Times are clamped to
    [started, finished]; an unknown phase keeps the bucket before it; what no event covers is
    unattributed.
    """
    w = Window.partitionBy(run).orderBy("t", "seq")
    e = events.select(run, "seq", F.greatest("started", F.least("finished", "at")).alias("t"), "started", "finished", bucket_of(F.col("phase")).alias("own"))
    e = e.withColumn("bucket", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit("unattributed")))
    spans = e.select(run, "bucket", (F.lead("t").over(w.orderBy("t", "seq")) - F.col("t")).alias("s"), (F.col("finished") - F.col("t")).alias("rest"))
    inside = spans.select(run, "bucket", F.coalesce("s", "rest").alias("s"))
    lead_in = e.groupBy(run).agg((F.min("t") - F.min("started")).alias("s")).select(run, F.lit("unattributed").alias("bucket"), "s")
    return inside.unionByName(lead_in).groupBy(run, "bucket").agg(F.round(F.greatest(F.lit(0.0), F.sum("s")), 3).alias("seconds")).where(F.col("seconds") > 0)


def reprices(trace: DataFrame, run: str = "run") -> DataFrame:
    """(run, seq, elapsed, expected, reason): rows whose expected duration differs from the one before; unreadable ones are passed over."""
    w = Window.partitionBy(run).orderBy("elapsed", "seq")
    t = trace.where(F.col("expected").isNotNull()).withColumn("prior", F.lag("expected").over(w))
    return t.where(F.col("expected") != F.col("prior")).select(run, "seq", F.round("elapsed", 3).alias("elapsed"), "expected", F.coalesce(F.nullif("reason", F.lit("")), F.lit("production_eta_reprice")).alias("reason"))


def phase_timing(timings: DataFrame) -> DataFrame:
    """(stage, seconds, n_events): sums of positive elapsed times."""
    return timings.groupBy("stage").agg(F.round(F.sum(F.greatest(F.coalesce("elapsed", F.lit(0.0)), F.lit(0.0))), 2).alias("seconds"), F.count_if(F.col("elapsed") > 0).alias("n_events"))


def queue_totals(timings: DataFrame, group: list[str]) -> DataFrame:
    """Batches and their records: the first positive of records and requested."""
    records = F.greatest(F.coalesce(F.nullif("records", F.lit(0)), F.nullif("requested", F.lit(0)), F.lit(0)), F.lit(0))
    return timings.groupBy(*group).agg(F.count("*").alias("batches"), F.sum(records).alias("records"), F.round(F.sum(F.coalesce("elapsed", F.lit(0.0))), 2).alias("seconds"))


def evidence_spans(events: DataFrame, run: str = "run") -> DataFrame:
    """(run, span, first_at, last_at, seconds): the stretch each kind of evidence covers; they may overlap.

    Besides the phases, `events` may have `observer` (its state) and `observer_status` (its words). The
    span of a single event is 0, kinds without one have no row.
    """
    none = F.lit(None).cast("string")
    observer, words = (F.col(c) if c in events.columns else none for c in ("observer", "observer_status"))
    kinds = {
        "owned_queue": F.col("phase") == "desktop_queue", "confirmed_vectors": F.col("phase") == "identity_set", "validation": F.col("phase").isin("retrieval_sample", "validation"),
        "reconnecting": observer == "reconnecting", "quiet": F.contains(F.lower(words), F.lit("quiet")),
    }
    long = events.select(run, "at", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).alias("span"))
    return long.groupBy(run, "span").agg(F.round(F.min("at"), 3).alias("first_at"), F.round(F.max("at"), 3).alias("last_at"), F.round(F.max("at") - F.min("at"), 3).alias("seconds"))


def substantive(reason: Column, phase: Column, completed: Column, total: Column) -> Column:
    """A real observation of queue or vectors, not a mere change of the estimate."""
    return (F.btrim(F.coalesce(reason, F.lit(""))) == "") & F.coalesce(phase, F.lit("")).isin("desktop_queue", "identity_set") & completed.isNotNull() & total.isNotNull()


def derived_total(timings: DataFrame, prefix: str) -> DataFrame:
    """(seconds, n_events): positive elapsed times of the stages whose name begins with `prefix`; 0 without any."""
    t = timings.where(F.startswith("stage", F.lit(prefix)) & (F.col("elapsed") > 0))
    return t.agg(F.round(F.coalesce(F.sum("elapsed"), F.lit(0.0)), 2).alias("seconds"), F.count("*").alias("n_events"))


def trace_uncertain(trace: DataFrame, run: str = "run") -> DataFrame:
    """(run, uncertain): a trace row's words report an uncertain observer."""
    words = F.lower(F.concat_ws(" ", F.coalesce("phase", F.lit("")), F.coalesce("details", F.lit(""))))
    return trace.groupBy(run).agg(F.bool_or(words.rlike("sse observer (?:reconnecting|unavailable|unknown)")).alias("uncertain"))


def mean_positive_rate(events: DataFrame, group: list[str]) -> DataFrame:
    return events.groupBy(*group).agg(F.round(F.avg(F.when(F.col("rate") > 0, F.col("rate"))), 3).alias("rate"))


def checkpoints(trace: DataFrame, run: str = "run") -> DataFrame:
    """(run, checkpoint, status, elapsed, shown, actual, error, eta_error, allowed): each run at 20, 40, 60 and 80 percent.

    `trace` has run, seq, elapsed, percent, expected, reason, state, evidence (a real observation). The
    first row that reaches a checkpoint short of the end counts; `terminal_only` if just a final row
    does, `absent` if none. The tolerance is 10 points when an ETA change stands between the last real
    observation and the checkpoint, else 5. One window per run carries the as-of lookups along, so
    nothing is joined by range.
    """
    w = Window.partitionBy(run).orderBy("elapsed", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(run)
    repriced = F.coalesce(F.col("reason"), F.lit("")) != ""
    t = trace.withColumn("duration", F.max("elapsed").over(whole))
    # the last ETA change and the last observation at or before a row, rows of the same instant included
    tie = Window.partitionBy(run).orderBy("elapsed").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("reprice_at", F.max(F.when(repriced, F.col("elapsed"))).over(tie)).withColumn("seen_at", F.max(F.when(F.col("evidence") & ~repriced, F.col("elapsed"))).over(tie))
    open_ = ~F.lower(F.coalesce("state", F.lit(""))).isin("successful", "warning") & (F.col("percent") < 100)
    row = F.struct("elapsed", "seq", "percent", "expected", "reprice_at", "seen_at")
    aggs = []
    for c in CHECKPOINTS:
        aggs += [F.min(F.when(open_ & (F.col("percent") >= c), row)).alias(f"r{c}"), F.max(F.col("percent") >= c).alias(f"x{c}")]
    per_run = t.groupBy(run).agg(F.max("duration").alias("duration"), *aggs)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("checkpoint"), F.col(f"r{c}").alias("r"), F.col(f"x{c}").alias("x")) for c in CHECKPOINTS])).alias("c")
    p = per_run.select(run, "duration", each).select(run, "duration", "c.*")
    recorded = F.col("r").isNotNull() & (F.col("duration") > 0)
    actual = F.col("r.elapsed") / F.col("duration") * 100
    late = F.col("r.reprice_at").isNotNull() & (F.col("r.seen_at").isNull() | (F.col("r.seen_at") <= F.col("r.reprice_at")))
    only = lambda x: F.when(recorded, x)
    return p.select(
        run, "checkpoint", F.when(recorded, "recorded").when(F.col("x"), "terminal_only").otherwise("absent").alias("status"),
        only(F.round("r.elapsed", 3)).alias("elapsed"), only(F.round("r.percent", 3)).alias("shown"), only(F.round(actual, 3)).alias("actual"), only(F.round(F.col("r.percent") - actual, 3)).alias("error"),
        only(F.round(F.greatest(F.lit(0.0), F.col("r.expected").cast("double")) - F.col("duration"), 3)).alias("eta_error"), only(F.when(late, 10.0).otherwise(5.0)).alias("allowed"),
    )


def calibration_passes(points: DataFrame, run: str = "run") -> DataFrame:
    """(run, passed): every checkpoint recorded and within its tolerance."""
    ok = (F.col("status") == "recorded") & F.coalesce(F.abs("error") <= F.col("allowed"), F.lit(False))
    return points.groupBy(run).agg(F.every(ok).alias("passed"))


def observer_uncertain(events: DataFrame, run: str = "run") -> DataFrame:
    """(run, uncertain): a timing row reports an uncertain observer."""
    return events.groupBy(run).agg(F.bool_or(F.lower("observer").isin("reconnecting", "unknown", "unavailable", "disconnected", "error")).alias("uncertain"))
