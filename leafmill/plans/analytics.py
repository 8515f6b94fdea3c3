"""Queries of timing analytics, trial statistics and reconciliation.

The tables carry the shapes the operators need: `events` are the progress events, timings, traces and
polls of a run (`user_id`), `orders` with their `lineitem` sums are measured trials (`o_orderkey`) of
a document (`o_custkey`).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators import evidence, match, report, timing
from leafmill.session import read

# What stands for what in the carrier table.
PHASES = {"view": "metadata", "click": "queue_receipt", "signup": "desktop_queue", "purchase": "validation", "error": "unknown_phase"}
STATUS = {"view": "incomplete", "click": "incomplete", "signup": "complete", "purchase": "review", "error": "error"}
OUTCOMES = {"success": "complete", "degraded": "concurrent_write_ambiguous", "failed": "workspace_missing", "skipped": "not_run"}
#: Microseconds keep times exact; a run starts 60 s before its first event and ends 60 s after the last.
MARGIN = 60.0


def _mapped(table: dict[str, str], c: str):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c))


@F.arrow_udf(returnType=T.StringType())
def _printed(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else f"{v:.6e}" for v in x.to_pylist()], pa.string())


def _exactly(c: str):
    """A statistic to seven significant digits, so that large ones are compared as closely as small ones.

    Null stays null, and digits are rounded from the exact binary value, halves to even, as C does;
    `format_string` writes "null" and rounds the shortest decimal half up.
    """
    return _printed(F.col(c)).alias(c)


def progress_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.round(at, 3).alias("at"), _mapped(PHASES, "event_type").alias("phase"), "event_type", "value", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


def wall_clock_attribution(spark: SparkSession, d: str) -> DataFrame:
    e = progress_events(spark, d)
    span = e.groupBy("run").agg((F.min("at") - MARGIN).alias("started"), (F.max("at") + MARGIN).alias("finished"))
    return timing.wall_clock(e.join(span, "run")).select("run", "bucket", F.round("seconds", 1).alias("seconds"))


def _trace(spark: SparkSession, d: str) -> DataFrame:
    """elapsed since the run's first event, percent by rank, an expected duration that changes with the type."""
    from pyspark.sql import Window

    e = progress_events(spark, d)
    w = Window.partitionBy("run").orderBy("at", "seq")
    whole = Window.partitionBy("run")
    return e.select(
        "run", "seq", F.round(F.col("at") - F.min("at").over(whole), 3).alias("elapsed"),
        # some runs end early, and one in seven shows its second half as final
        (F.row_number().over(w) * 100.0 / F.count("*").over(whole) * (F.col("run") % 5 + 1) / 5).alias("percent"),
        (F.floor(F.col("value") / 50) * 60).cast("int").alias("expected"), F.when(F.col("event_type") == "error", "eta").otherwise("").alias("reason"),
        F.when((F.col("event_type") == "purchase") | ((F.col("run") % 7 == 0) & (F.row_number().over(w) * 2 > F.count("*").over(whole))), "warning").otherwise("running").alias("state"), (F.col("event_type") == "signup").alias("evidence"),
    )


def eta_reprices(spark: SparkSession, d: str) -> DataFrame:
    return timing.reprices(_trace(spark, d))


def _timings(spark: SparkSession, d: str) -> DataFrame:
    return progress_events(spark, d).select(F.col("event_type").alias("stage"), F.col("value").alias("elapsed"), F.col("k").alias("records"), F.lit(1).alias("requested"))


def phase_timing(spark: SparkSession, d: str) -> DataFrame:
    return timing.phase_timing(_timings(spark, d))


def queue_totals(spark: SparkSession, d: str) -> DataFrame:
    return timing.queue_totals(_timings(spark, d), ["stage"])


def evidence_spans(spark: SparkSession, d: str) -> DataFrame:
    e = progress_events(spark, d)
    e = e.withColumn("observer", F.when(F.col("k") % 9 == 0, "reconnecting")).withColumn("observer_status", F.when(F.col("k") % 11 == 0, "Queue is Quiet"))
    return timing.evidence_spans(e).select("run", "span", F.round("seconds", 2).alias("seconds"))


def queue_rate(spark: SparkSession, d: str) -> DataFrame:
    return timing.mean_positive_rate(progress_events(spark, d).select("run", (F.col("value") - 5).alias("rate")), ["run"])


def checkpoint_calibration(spark: SparkSession, d: str) -> DataFrame:
    return timing.checkpoints(_trace(spark, d)).select("run", "checkpoint", "status", "elapsed", "error", "eta_error", "allowed")


def calibration_passes(spark: SparkSession, d: str) -> DataFrame:
    return timing.calibration_passes(timing.checkpoints(_trace(spark, d)))


def checkpoint_accuracy(spark: SparkSession, d: str) -> DataFrame:
    a = report.checkpoint_accuracy(timing.checkpoints(_trace(spark, d)), 9)
    return a.select("checkpoint", "recorded", "with_eta", *[F.round(c, 3).alias(c) for c in ("mean_error", "max_error")], _exactly("mean_eta_error"))


def observer_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    e = progress_events(spark, d)
    return timing.observer_uncertain(e.select("run", F.when((F.col("event_type") == "error") & (F.col("value") > 200), "Reconnecting").otherwise("ok").alias("observer")))


def _trials(spark: SparkSession, d: str) -> DataFrame:
    """One row per trial with page count and the seconds of six stages."""
    li = read(spark, d, "lineitem")
    stages = [F.sum(F.when((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s), F.col("l_quantity"))).alias(f"s_{f}{s}".lower()) for f in "ANR" for s in "FO"]
    per = li.groupBy(F.col("l_orderkey").alias("trial")).agg(F.count("*").alias("page_count"), *stages)
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_custkey").alias("document"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.join(per, "trial", "left")


STAGES = [f"s_{f}{s}" for f in "anr" for s in "fo"]


def duration_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.summary(_trials(spark, d), "total", ["status"], 5).withColumn("variance", _exactly("variance"))


def quartiles(spark: SparkSession, d: str) -> DataFrame:
    return report.quartiles(_trials(spark, d), "total", ["status"], 5)


def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "event_type", (F.col("value") - 1).alias("value"))
    return report.outliers(e, "value", ["event_type"]).select("event_id", "event_type", "outlier")


def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.stage_summary(_trials(spark, d), STAGES, ["status"], 5)


def trial_variance(spark: SparkSession, d: str) -> DataFrame:
    # a trial without document or priority counts to the null document
    t = _trials(spark, d).withColumn("document", F.concat("document", F.lit("-"), "priority"))
    return report.trial_variance(t, "document", "total", 5).withColumn("variance", _exactly("variance"))


def page_groups(spark: SparkSession, d: str) -> DataFrame:
    return report.size_groups(_trials(spark, d).where(F.col("page_count").isNotNull()), "page_count", "total", 5)


def cohort_quality(spark: SparkSession, d: str) -> DataFrame:
    c = {"operational": F.col("status").isin("F", "O"), "calibration": (F.col("status") == "F") & (F.col("page_count") >= 3), "excluded": ~F.col("status").isin("F", "O")}
    return report.cohorts(_trials(spark, d), c, "total", 5)


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return report.status_rollup(_trials(spark, d), ["priority"], "status", "total", ["F", "O", "P"])


def missing_expected(spark: SparkSession, d: str) -> DataFrame:
    """Documents and trial classes that were expected and never ran: every document is to run in each class that any ran in."""
    o = read(spark, d, "orders")
    classes = o.agg(F.collect_set("o_orderpriority").alias("c"))  # the classes of a benchmark are a handful
    want = evidence.expected_grid(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), classes, "c", "o_orderpriority")
    return evidence.missing(want, o, ["o_custkey", "o_orderpriority"])


def trace_union(spark: SparkSession, d: str) -> DataFrame:
    e = progress_events(spark, d)
    a = e.where(F.col("event_type") != "view").select("run", "at", "seq", F.lit("callback").alias("source"))
    b = e.where(F.col("event_type") == "view").select("run", "at", "seq", F.col("value").alias("visible"), F.lit("ui_timer").alias("source"))
    return report.merged_trace(report.union_all([a, b]), "run").select("run", "seq", "source", F.round("at", 2).alias("tick"), "visible", "place")


def evidence_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Prepared documents, stored documents and confirmed vectors, by id."""
    prepared = read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    stored = read(spark, d, "pdf_pages").select(F.col("document_id").alias("id"))
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return evidence.reconcile({"prepared": prepared, "stored": stored, "confirmed": vectors}, "id")


def status_classes(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "run_results")
    s = r.select("run_id", F.explode("stages").alias("stage", "b")).select("run_id", "stage", _mapped(OUTCOMES, "b.status").alias("status")).distinct()
    return s.select("run_id", "stage", "status", evidence.status_class(F.coalesce("status", F.lit(""))).alias("class"), evidence.status_class(F.coalesce("status", F.lit("")), transient=True).alias("transient"))


def poll_verdict(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = progress_events(spark, d)
    o = e.select("run", F.row_number().over(Window.partitionBy("run").orderBy("at", "seq")).alias("attempt"), _mapped(STATUS, "event_type").alias("status"))
    return evidence.first_verdict(o, "run", timeout=25, interval=10, cap=12)


def owned_queue_events(spark: SparkSession, d: str) -> DataFrame:
    """Requests' runs own their documents; events of a run name documents by their number."""
    e = progress_events(spark, d).select("run", "seq", F.when(F.col("event_type") == "error", "all_complete").otherwise("doc_complete").alias("type"), F.concat(F.lit("docs\\"), (F.col("k") % 50).cast("string")).alias("location"))
    owned = read(spark, d, "run_requests").select(F.concat(F.lit("docs/"), (F.col("document_id") % 7).cast("string")).alias("location"))
    return evidence.owned_events(e, owned, "run").select("run", "seq", "type")


def queue_guard(spark: SparkSession, d: str) -> DataFrame:
    e = progress_events(spark, d)
    return evidence.queue_guard(e.select("run", ((F.col("event_type") == "signup") & (F.col("value") > 250)).alias("foreign"), (~((F.col("event_type") == "error") & (F.col("value") > 150))).alias("connected")), ["run"])


def dedupe_order(spark: SparkSession, d: str) -> DataFrame:
    """Event types of a run in order of first appearance."""
    o = evidence.ordered_distinct(progress_events(spark, d), "run", "event_type", "seq")
    return o.select("run", F.array_join("items", ",").alias("items"))


def privacy_findings(spark: SparkSession, d: str) -> DataFrame:
    """What must not be published: over all documents."""
    p = evidence.privacy_findings(read(spark, d, "documents"), "doc_id", F.coalesce("text", F.lit("")))
    return p.select("doc_id", F.array_join("findings", ",").alias("findings"))


def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    """A words catalog: the words of titles, overridden by the checked lexicon where it has them."""
    titles = read(spark, d, "source_files").select(F.explode(F.split(F.lower("title"), " ")).alias("word")).where(F.col("word").rlike("^[a-z]+$"))
    titles = titles.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", F.lit("title").alias("lang"))
    lex = read(spark, d, "lexicon").groupBy("word").agg(F.max("n_seen").alias("n"), F.min("lang").alias("lang"))
    return match.layered([titles, lex], "word")


def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lexicon").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_seen").alias("n_seen"))


def family_hints(spark: SparkSession, d: str) -> DataFrame:
    """The first hint, in list order, that each part's name holds."""
    hints = spark.createDataFrame([(h, i) for i, h in enumerate(("blue", "re", "green", "a", "e"))], "hint string, ordinal int")
    names = read(spark, d, "part").select(F.col("p_name").alias("name"))
    return match.first_hint(names, hints)


def queries() -> dict:
    plain = [
        wall_clock_attribution, eta_reprices, phase_timing, queue_totals, evidence_spans, queue_rate, checkpoint_calibration, calibration_passes, checkpoint_accuracy, observer_uncertainty, duration_summary, quartiles,
        iqr_outliers, stage_summary, trial_variance, page_groups, cohort_quality, status_rollup, missing_expected, trace_union, evidence_reconciliation, status_classes, poll_verdict, owned_queue_events, queue_guard,
        dedupe_order, privacy_findings, catalog_merge, catalog_counts, family_hints,
    ]
    return {q.__name__: q for q in plain}


def _case(table: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_E = f"""WITH e AS (SELECT user_id AS run, event_id AS seq, round(epoch_us(ts) / 1e6, 3) AS tick, {_case(PHASES)} AS phase, event_type, value, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
_T = (
    _E
    + """, t AS (SELECT run, seq, round(tick - min(tick) OVER (PARTITION BY run), 3) AS elapsed, row_number() OVER (PARTITION BY run ORDER BY tick, seq) * CAST(100 AS DOUBLE) / count(*) OVER (PARTITION BY run) * (run % 5 + 1) / 5 AS percent,
  CAST(floor(value / 50) * 60 AS INTEGER) AS expected, CASE WHEN event_type = 'error' THEN 'eta' ELSE '' END AS reason, CASE WHEN event_type = 'purchase' OR (run % 7 = 0 AND row_number() OVER (PARTITION BY run ORDER BY tick, seq) * 2 > count(*) OVER (PARTITION BY run)) THEN 'warning' ELSE 'running' END AS state, event_type = 'signup' AS evidence FROM e)"""
)
_P = (
    _T
    + """, d AS (SELECT run, max(elapsed) AS duration FROM t GROUP BY run), cp AS (SELECT unnest([20, 40, 60, 80]) AS checkpoint),
hit AS (SELECT t.run, checkpoint, elapsed, seq, percent, expected, row_number() OVER (PARTITION BY t.run, checkpoint ORDER BY elapsed, seq) AS k FROM t JOIN cp ON percent >= checkpoint WHERE percent < 100 AND state NOT IN ('successful', 'warning')),
r AS (SELECT h.*, duration, (SELECT max(x.elapsed) FROM t x WHERE x.run = h.run AND x.reason <> '' AND x.elapsed <= h.elapsed) AS reprice_at, (SELECT max(x.elapsed) FROM t x WHERE x.run = h.run AND x.evidence AND x.reason = '' AND x.elapsed <= h.elapsed) AS seen_at FROM hit h JOIN d USING (run) WHERE k = 1 AND duration > 0),
points AS (SELECT d.run, cp.checkpoint, CASE WHEN r.run IS NOT NULL THEN 'recorded' WHEN EXISTS (SELECT 1 FROM t x WHERE x.run = d.run AND x.percent >= cp.checkpoint) THEN 'terminal_only' ELSE 'absent' END AS status,
  r.elapsed AS elapsed, round(r.percent - r.elapsed / r.duration * 100, 3) AS error, round(greatest(0.0, r.expected) - r.duration, 3) AS eta_error,
  CASE WHEN r.run IS NULL THEN NULL WHEN reprice_at IS NOT NULL AND (seen_at IS NULL OR seen_at <= reprice_at) THEN 10.0 ELSE 5.0 END AS allowed
  FROM d CROSS JOIN cp LEFT JOIN r ON r.run = d.run AND r.checkpoint = cp.checkpoint)"""
)
_TR = """WITH li AS (SELECT l_orderkey AS trial, count(*) AS page_count, """ + ", ".join(
    f"sum(CASE WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN l_quantity END) AS s_{f}{s}".lower().replace(f"'{f.lower()}'", f"'{f}'").replace(f"'{s.lower()}'", f"'{s}'") for f in "ANR" for s in "FO"
) + """ FROM lineitem GROUP BY l_orderkey), tr AS (SELECT o_orderkey AS trial, o_custkey AS document, o_totalprice AS total, o_orderstatus AS status, o_orderpriority AS priority, li.* EXCLUDE (trial) FROM orders LEFT JOIN li ON li.trial = o_orderkey)"""


def oracle_sql() -> dict[str, str]:
    buckets = "CASE phase WHEN 'metadata' THEN 'preparation' WHEN 'queue_receipt' THEN 'submission' WHEN 'desktop_queue' THEN 'shared_ingestion' WHEN 'validation' THEN 'validation' END"
    space = r"\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    return {
        "wall_clock_attribution": _E
        + f""", s AS (SELECT run, min(tick) - 60 AS started, max(tick) + 60 AS finished FROM e GROUP BY run),
b AS (SELECT run, tick, seq, coalesce(last_value({buckets} IGNORE NULLS) OVER (PARTITION BY run ORDER BY tick, seq ROWS UNBOUNDED PRECEDING), 'unattributed') AS bucket, lead(tick) OVER (PARTITION BY run ORDER BY tick, seq) AS next FROM e),
x AS (SELECT b.run, bucket, coalesce(next, finished) - tick AS sec FROM b JOIN s USING (run) UNION ALL SELECT e.run, 'unattributed', min(tick) - min(started) FROM e JOIN s USING (run) GROUP BY e.run)
SELECT run, bucket, round(sum(sec), 1) AS seconds FROM x GROUP BY run, bucket HAVING sum(sec) > 0""",
        "eta_reprices": _T + ", p AS (SELECT *, lag(expected) OVER (PARTITION BY run ORDER BY elapsed, seq) AS prior FROM t WHERE expected IS NOT NULL) SELECT run, seq, elapsed, expected, CASE WHEN reason = '' THEN 'production_eta_reprice' ELSE reason END AS reason FROM p WHERE expected <> prior",
        "phase_timing": _E + " SELECT event_type AS stage, round(sum(greatest(coalesce(value, 0), 0)), 2) AS seconds, count(*) FILTER (WHERE value > 0) AS n_events FROM e GROUP BY 1",
        "queue_totals": _E + " SELECT event_type AS stage, count(*) AS batches, CAST(sum(greatest(coalesce(nullif(k, 0), 1), 0)) AS BIGINT) AS records, round(sum(coalesce(value, 0)), 2) AS seconds FROM e GROUP BY 1",
        "evidence_spans": _E + """, l AS (SELECT run, tick, CASE phase WHEN 'desktop_queue' THEN 'owned_queue' WHEN 'identity_set' THEN 'confirmed_vectors' WHEN 'validation' THEN 'validation' END AS span FROM e UNION ALL SELECT run, tick, 'reconnecting' FROM e WHERE k % 9 = 0 UNION ALL SELECT run, tick, 'quiet' FROM e WHERE k % 11 = 0)
SELECT run, span, round(max(tick) - min(tick), 2) AS seconds FROM l WHERE span IS NOT NULL GROUP BY run, span""",
        "queue_rate": "SELECT user_id AS run, round(avg(CASE WHEN value - 5 > 0 THEN value - 5 END), 3) AS rate FROM events GROUP BY 1",
        "checkpoint_calibration": _P + " SELECT run, checkpoint, status, elapsed, error, eta_error, allowed FROM points",
        "calibration_passes": _P + " SELECT run, bool_and(status = 'recorded' AND coalesce(abs(error) <= allowed, FALSE)) AS passed FROM points GROUP BY run",
        "checkpoint_accuracy": _P + """ SELECT checkpoint, count(*) FILTER (WHERE status = 'recorded') AS recorded, round(avg(abs(error)), 3) AS mean_error, round(max(abs(error)), 3) AS max_error, count(eta_error) AS with_eta, printf('%.6e', round(avg(eta_error), 9)) AS mean_eta_error
FROM points GROUP BY checkpoint""",
        "observer_uncertainty": "SELECT user_id AS run, bool_or(event_type = 'error' AND value > 200) AS uncertain FROM events GROUP BY 1",
        "duration_summary": _TR + " SELECT status, count(*) AS n, round(avg(total), 5) AS mean, round(median(total), 5) AS median, round(min(total), 5) AS min, round(max(total), 5) AS max, printf('%.6e', round(var_samp(total), 5)) AS variance FROM tr GROUP BY status",
        "quartiles": _TR + " SELECT status, round(quantile_cont(total, 0.25), 5) AS q1, round(quantile_cont(total, 0.75), 5) AS q3 FROM tr GROUP BY status",
        "iqr_outliers": """WITH v AS (SELECT event_id, event_type, value - 1 AS value FROM events), b AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS z FROM v WHERE value > 0 GROUP BY event_type)
SELECT event_id, v.event_type, value < a - 1.5 * (z - a) OR value > z + 1.5 * (z - a) AS outlier FROM v JOIN b ON b.event_type = v.event_type""",
        "stage_summary": _TR + f""", l AS (SELECT status, stage, coalesce(sec, 0) AS s FROM (SELECT status, unnest({STAGES!r}) AS stage, unnest([{", ".join(STAGES)}]) AS sec FROM tr))
SELECT status, stage, round(avg(s), 5) AS mean, round(median(s), 5) AS median, round(min(s), 5) AS min, round(max(s), 5) AS max FROM l GROUP BY status, stage""",
        "trial_variance": _TR + " SELECT document || '-' || priority AS document, count(total) AS trials, printf('%.6e', round(var_samp(total), 5)) AS variance, round(avg(total), 5) AS mean, round(min(total), 5) AS min, round(max(total), 5) AS max, CASE WHEN count(total) = 2 THEN round(max(total) - min(total), 5) END AS difference FROM tr GROUP BY 1",
        "page_groups": _TR + """, q AS (SELECT quantile_cont(page_count, 0.25) AS a, quantile_cont(page_count, 0.75) AS z FROM tr WHERE page_count IS NOT NULL), x AS (
SELECT 'lower' AS size_group, total FROM tr, q WHERE page_count <= a UNION ALL SELECT 'middle', total FROM tr, q WHERE page_count > a AND page_count < z UNION ALL SELECT 'upper', total FROM tr, q WHERE page_count >= z)
SELECT size_group, count(*) AS n, round(avg(total), 5) AS mean FROM x GROUP BY size_group""",
        "cohort_quality": _TR + """, x AS (SELECT 'operational' AS cohort, total FROM tr WHERE status IN ('F', 'O') UNION ALL SELECT 'calibration', total FROM tr WHERE status = 'F' AND page_count >= 3 UNION ALL SELECT 'excluded', total FROM tr WHERE status NOT IN ('F', 'O'))
SELECT cohort, count(*) AS n, round(avg(total), 5) AS mean, round(median(total), 5) AS median FROM x GROUP BY cohort""",
        "status_rollup": _TR + " SELECT priority, count(*) AS n, count(*) FILTER (WHERE status = 'F') AS n_f, count(*) FILTER (WHERE status = 'O') AS n_o, count(*) FILTER (WHERE status = 'P') AS n_p, round(sum(total), 2) AS total FROM tr GROUP BY priority",
        "missing_expected": "SELECT c_custkey AS o_custkey, p.o_orderpriority FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p EXCEPT SELECT o_custkey, o_orderpriority FROM orders",
        "trace_union": _E + """ SELECT run, seq, CASE WHEN event_type = 'view' THEN 'ui_timer' ELSE 'callback' END AS source, round(tick, 2) AS tick, CASE WHEN event_type = 'view' THEN value END AS visible,
  row_number() OVER (PARTITION BY run ORDER BY tick, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, seq) AS place FROM e""",
        "evidence_reconciliation": """WITH k AS (SELECT doc_id AS id FROM documents UNION SELECT document_id FROM pdf_pages UNION SELECT vec_id FROM embeddings),
f AS (SELECT id, id IN (SELECT doc_id FROM documents) AS prepared, id IN (SELECT document_id FROM pdf_pages) AS stored, id IN (SELECT vec_id FROM embeddings) AS confirmed FROM k)
SELECT *, CASE WHEN (stored AND NOT prepared) OR (confirmed AND NOT stored) THEN 'out_of_order' WHEN confirmed THEN 'confirmed' WHEN stored THEN 'stored' ELSE 'prepared' END AS stage FROM f""",
        "status_classes": """WITH s AS (SELECT DISTINCT run_id, e.key AS stage, CASE e.value.status WHEN 'success' THEN 'complete' WHEN 'degraded' THEN 'concurrent_write_ambiguous' WHEN 'failed' THEN 'workspace_missing' WHEN 'skipped' THEN 'not_run' END AS status
  FROM (SELECT run_id, unnest(map_entries(stages)) AS e FROM run_results))
SELECT run_id, stage, status, CASE status WHEN 'complete' THEN 'pass' WHEN 'concurrent_write_ambiguous' THEN 'review' WHEN 'workspace_missing' THEN 'error' ELSE 'incomplete' END AS class,
  CASE status WHEN 'complete' THEN 'pass' WHEN 'workspace_missing' THEN 'error' ELSE 'incomplete' END AS transient FROM s""",
        "poll_verdict": _E + f""", o AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY tick, seq) AS attempt, {_case(STATUS)} AS status FROM e),
x AS (SELECT run, attempt, least(12, (attempt - 1) * 10) AS waited, CASE status WHEN 'complete' THEN 'pass' WHEN 'review' THEN 'review' WHEN 'error' THEN 'error' END AS kind FROM o WHERE attempt = 1 OR (attempt - 2) * 10 < 12),
f AS (SELECT run, min(attempt) FILTER (WHERE kind IS NOT NULL) AS a, max(attempt) AS z FROM x GROUP BY run)
SELECT x.run, x.attempt AS attempts, CAST(waited AS DOUBLE) AS waited, coalesce(kind, 'timeout') AS verdict FROM x JOIN f ON f.run = x.run AND x.attempt = coalesce(a, z)""",
        "owned_queue_events": _E + """, o AS (SELECT DISTINCT document_id % 7 AS n FROM run_requests), x AS (SELECT run, seq, CASE WHEN event_type = 'error' THEN 'all_complete' ELSE 'doc_complete' END AS type, coalesce(k % 50 IN (SELECT n FROM o), FALSE) AS own FROM e),
y AS (SELECT *, max(own) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seen FROM x) SELECT run, seq, type FROM y WHERE own OR (type = 'all_complete' AND seen)""",
        "queue_guard": "SELECT user_id AS run, CASE WHEN bool_or(event_type = 'signup' AND value > 250) THEN 'active' WHEN bool_or(event_type = 'error' AND value > 150) THEN 'uncertain' ELSE 'idle' END AS guard FROM events GROUP BY 1",
        "dedupe_order": "WITH f AS (SELECT user_id AS run, event_type, min(event_id) AS o FROM events GROUP BY ALL) SELECT run, string_agg(event_type, ',' ORDER BY o) AS items FROM f GROUP BY run",
        "privacy_findings": f"""WITH f AS (SELECT doc_id, list_filter([
  CASE WHEN regexp_matches(text, '(?i)(?:^|[^a-z0-9_])(?:sk|api)[_-][a-z0-9_-]{{8,}}') THEN 'api_key' END, CASE WHEN regexp_matches(text, '(?i)"(?:[a-z_]*_path|workspace[a-z_]*|source_name|token|secret|password)"[{space}]*:') THEN 'forbidden_key' END,
  CASE WHEN regexp_matches(text, '(?:^|[^a-zA-Z0-9_])[a-fA-F0-9]{{64}}(?:$|[^a-zA-Z0-9_])') THEN 'sha256' END, CASE WHEN regexp_matches(text, '(?:[A-Za-z]:\\\\|\\\\\\\\)[^\\r\\n"]+') THEN 'windows_path' END], lambda x: x IS NOT NULL) AS l FROM documents)
SELECT doc_id, array_to_string(l, ',') AS findings FROM f WHERE len(l) > 0""",
        "catalog_merge": """WITH l AS (SELECT word, max(n_seen) AS n, min(lang) AS lang FROM lexicon GROUP BY word), t AS (SELECT word, count(*) AS n, 'title' AS lang FROM (SELECT unnest(string_split(lower(title), ' ')) AS word FROM source_files) WHERE regexp_full_match(word, '[a-z]+') GROUP BY word)
SELECT coalesce(l.word, t.word) AS word, CASE WHEN l.word IS NULL THEN t.n ELSE l.n END AS n, coalesce(l.lang, t.lang) AS lang FROM t FULL JOIN l ON l.word = t.word""",
        "catalog_counts": "SELECT lang, count(*) AS n, CAST(sum(n_seen) AS BIGINT) AS n_seen FROM lexicon GROUP BY lang",
        "family_hints": """WITH h AS (SELECT unnest(['blue', 're', 'green', 'a', 'e']) AS hint, unnest([0, 1, 2, 3, 4]) AS ordinal), n AS (SELECT DISTINCT p_name AS name FROM part),
x AS (SELECT name, hint, ordinal, row_number() OVER (PARTITION BY name ORDER BY ordinal) AS k FROM n LEFT JOIN h ON contains(lower(name), hint)) SELECT name, hint, ordinal FROM x WHERE k = 1""",
    }
