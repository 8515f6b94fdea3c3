"""Queries that resolve models, settings and outcomes; small catalogs are inline, volume comes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import evidence, report, resolve, timing
from leafmill.plans.analytics import progress_events
from leafmill.plans.prepare import pages
from leafmill.session import read

# A small catalog, its aliases and family hints, as the tables that a caller brings.
CATALOG = [("jinaai", "jina-embeddings-v3", 8192, True), ("openai", "text-embedding-3-large", 8191, True), ("openai", "text-embedding-ada-002", 8191, True), ("cohere", "embed-v4.0", 128000, False), ("part", "sea", 700, True)]
ALIASES = [("jina v3", "jina-embeddings-v3", 0), ("ada", "text-embedding-3-large", 0), ("ada", "text-embedding-ada-002", 1), ("part 1", "sea", 0)]
HINTS = [("nomic", 0, 8192, 4096, 768), ("blue", 1, 512, 512, 1024), ("e", 2, 2048, 0, None), ("a", 3, 100, 90, 64)]
ASKED = [("OpenAI ", "ADA"), ("openai", "text-embedding-3-large"), ("jinaai", " Jina   V3 "), ("cohere", "embed-v4.0"), ("cohere", "EMBED-V4.0"), ("other", "xyz"), ("ollama", "nomic-embed-text"), (None, None)]


def model_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Inline questions, and every part's name as a model of the provider `part`."""
    asked = spark.createDataFrame(ASKED, "provider string, model string").unionByName(read(spark, d, "part").select(F.lit("part").alias("provider"), F.col("p_name").alias("model")))
    catalog = spark.createDataFrame(CATALOG, "provider string, model string, limit int, verified boolean")
    hints = spark.createDataFrame(HINTS, "hint string, ordinal int, limit int, recommended int, embedding_length int")
    return resolve.resolve_models(asked, catalog, spark.createDataFrame(ALIASES, "alias string, model string, priority int"), hints)


def local_models(spark: SparkSession, d: str) -> DataFrame:
    """Parts as local models, those of odd size with metadata of their own."""
    part = read(spark, d, "part")
    seen = part.groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").alias("s")).where(F.col("s") % 2 == 1).select("name", (F.col("s") * 100).cast("int").alias("context_length"), F.when(F.col("s") % 3 == 0, F.col("s")).cast("int").alias("embedding_length"))
    hints = spark.createDataFrame(HINTS, "hint string, ordinal int, limit int, recommended int, embedding_length int")
    return resolve.local_capability(part.select(F.col("p_name").alias("name")), seen, hints)


def runtime_limits(spark: SparkSession, d: str) -> DataFrame:
    e = progress_events(spark, d)
    return e.select("run", "seq", resolve.runtime_limit(F.col("k") % 50, F.col("seq").cast("int") % 40).alias("limit"))


def secret_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Stages' messages as settings, every third under a secret's name."""
    r = read(spark, d, "run_results").select("run_id", F.explode("stages").alias("stage", "b")).select("run_id", F.when(F.length("stage") % 3 == 0, F.concat("stage", F.lit("_api_key"))).otherwise(F.col("stage")).alias("key"), F.col("b.operator_message").alias("v")).distinct()
    return r.select("run_id", "key", *[c.alias(n) for n, c in resolve.secret_safe(F.col("key"), F.col("v")).items()])


def queue_messages(spark: SparkSession, d: str) -> DataFrame:
    e = progress_events(spark, d)
    kind = F.when(F.col("event_type") == "click", "doc_starting").when(F.col("event_type") == "view", "chunk_progress").otherwise("doc_complete")
    return e.select("run", "seq", resolve.queue_message(kind, F.col("k") % 6, F.lit(6), F.col("k") % 4, F.lit(4), F.col("k") % 2 == 0).alias("message"))


def evidence_layers(spark: SparkSession, d: str) -> DataFrame:
    """Three stages of each run as its layers of evidence."""
    r = read(spark, d, "run_results")
    names = {"upload": ("post_upload_verification", {"success": "complete", "degraded": "complete_with_key_cleanup_warning"}), "stored": ("segmentation", {"success": "pass", "skipped": "pass_with_missing_workspace_document_records"}), "answered": ("preflight", {"success": "pass", "degraded": "pass"})}
    s = r.select("run_id", "persisted_at", F.explode("stages").alias("stage", "b")).where(F.col("b").isNotNull())
    last = s.groupBy("run_id").agg(*[F.max_by(F.when(F.col("stage") == st, F.col("b.status")), F.when(F.col("stage") == st, F.struct("persisted_at", "b.status"))).alias(n) for n, (st, _) in names.items()])
    mapped = {n: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(n)) for n, (_, m) in names.items()}
    ok = resolve.layers_succeeded(mapped["upload"], mapped["stored"], mapped["answered"])
    return last.select("run_id", ok.alias("succeeded"), resolve.stage_outcome(F.lit("success"), F.length("run_id") > 0, ok).alias("outcome"))


def count_contract(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source: announced pages, stored pages, those stored before."""
    f = read(spark, d, "source_files").distinct().groupBy("document_id").agg(F.max("page_count").alias("prepared"))
    p = pages(spark, d).groupBy("document_id").agg(F.count("*").alias("stored"), F.count_if(F.length("text") > 0).alias("filled"))
    x = f.join(p, "document_id").withColumn("after", F.when(F.col("document_id") % 3 == 0, 0).otherwise(F.col("filled")))
    return x.select("document_id", F.coalesce(evidence.count_check(F.col("prepared"), F.col("stored"), F.col("after"), F.col("stored")), F.lit(False)).alias("agree"))


def calibration_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Runs judged again: those with an uncertain observer or an end that is no success are excluded, each reason once."""
    e = progress_events(spark, d)
    unsure = timing.trace_uncertain(e.select("run", "phase", F.when((F.col("event_type") == "error") & (F.col("value") > 200), "SSE observer reconnecting").alias("details")))
    old = e.groupBy("run").agg(F.when(F.max("run") % 3 == 0, F.array(F.lit("observer_uncertainty"))).alias("reasons"), F.when(F.max("run") % 4 == 0, F.array(F.lit("manual"), F.lit("terminal_not_successful"))).alias("exclusions"), F.when(F.max("run") % 5 < 3, "Successful").otherwise("warning").alias("status"))
    new = resolve.refreshed_exclusions(F.col("status"), F.col("uncertain"), F.col("reasons"), F.col("exclusions"))
    x = old.join(unsure, "run")
    return x.select("run", F.array_join(new["reasons"], ",").alias("reasons"), F.array_join(new["exclusions"], ",").alias("exclusions"), new["changed"].alias("changed"))


def benchmark_states(spark: SparkSession, d: str) -> DataFrame:
    """Per document: expected trials that are missing or stale, failed calibrations, and the state that follows."""
    o = read(spark, d, "orders")
    ok = resolve.calibration_eligible(F.when(F.col("o_orderstatus") == "F", "successful").otherwise("x"), F.col("o_totalprice") > 50000, F.col("o_orderpriority") == "1-URGENT", F.lit(11), (F.col("o_orderkey") % 5).cast("int"), (11, 3))
    x = o.groupBy(F.col("o_custkey").alias("document")).agg((5 - F.count_distinct("o_orderpriority")).alias("missing"), F.count_if(ok & (F.col("o_orderkey") % 2 == 0)).alias("failures"), F.count_if(ok).alias("eligible"))
    return x.withColumn("state", resolve.benchmark_state(F.col("missing"), F.col("failures")))


def enriched_runs(spark: SparkSession, d: str) -> DataFrame:
    """Trials with what the private rows add; some private rows come twice, some are missing."""
    public = read(spark, d, "orders").select(F.col("o_orderkey").alias("document"), F.col("o_custkey").alias("trial"), F.col("o_totalprice").alias("total"))
    li = read(spark, d, "lineitem").where(F.col("l_linenumber") == 2).select(F.col("l_orderkey").alias("document"), F.col("l_quantity").alias("quantity"))
    private = li.join(public.select("document", "trial"), "document").where(F.col("document") % 2 == 0)
    return resolve.enriched(public, private.unionByName(private), ["document", "trial"])


def execution_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first OCR method that a document's pages tell, else that none was recorded."""
    p = read(spark, d, "pdf_pages").select("document_id", "page", F.nullif("ocr_method", F.lit("")).alias("mode"))
    return resolve.evidence_pick(p, "mode", F.lit("not_recorded"))


def unmet_capabilities(spark: SparkSession, d: str) -> DataFrame:
    """Modes that requests ask for against the policies that keep to a page."""
    asked = read(spark, d, "run_requests").select(F.lower(F.btrim("segment_mode")).alias("name")).where(F.col("name").isNotNull()).unionByName(spark.createDataFrame([("stream",)], "name string"))
    known = read(spark, d, "segmentation_policy").select(F.col("mode").alias("name"), F.when(F.col("page_local"), "supported").otherwise("blocked").alias("status"))
    return resolve.unmet_capabilities(asked, known)


def probe_pages(spark: SparkSession, d: str) -> DataFrame:
    """At most two pages of each document, by page."""
    return resolve.first_of_each(pages(spark, d).select("document_id", "page", "page_id"), ["document_id"], ["page"], 2)


def extraction_total(spark: SparkSession, d: str) -> DataFrame:
    e = progress_events(spark, d)
    t = e.select(F.concat(F.when(F.col("k") % 3 == 0, "extraction_backend:").otherwise("other:"), F.col("event_type")).alias("stage"), (F.col("value") - 10).alias("elapsed"))
    return timing.derived_total(t, "extraction_backend:")


def payload_violations(spark: SparkSession, d: str) -> DataFrame:
    """What the evidence of runs would make public."""
    r = read(spark, d, "run_results").select("run_id", F.explode("stages").alias("stage", "b")).select("run_id", "stage", F.col("b.evidence").alias("evidence")).distinct()
    v = evidence.payload_violations(r, ["run_id", "stage"], "evidence", ("storage/", "default"))
    return v.select("run_id", "stage", F.array_join("violations", "; ").alias("violations"))


def runover_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every third page's first half is nominated as a strip that ran over, and so is a copy of its neighbour's text."""
    rows = read(spark, d, "pdf_pages").select("page_id", "document_id", "page", "text")
    # shuffled as the pages are joined afterwards, so that texts travel once
    once = lambda df: df.repartition("document_id", "page").dropDuplicates(["document_id", "page", "page_id"]).drop("page_id")
    even = F.col("document_id") % 2 == 0
    near = once(rows.where(even).select("page_id", "document_id", (F.col("page") - 1).alias("page"), F.substring("text", 1, 400).alias("near")))
    narrow = F.when(even, F.col("near")).otherwise(F.substring("text", 1, 300))
    x = once(rows).join(near, ["document_id", "page"], "left")
    r = resolve.judge_runovers(x.select("document_id", "page", "text", narrow.alias("narrow"), F.substring("text", 300, 100000).alias("dominant"), (F.col("page") % 3 > 0).alias("nominated")))
    return r.select("document_id", "page", F.md5("text").alias("text_md5"), "decision", "matched", "fragments", "ratio")


def display_order(spark: SparkSession, d: str) -> DataFrame:
    """Titles by display name: the place of each, letter case folded."""
    titles = read(spark, d, "source_files").select("document_id", F.coalesce("title", F.lit("")).alias("display_name")).distinct()
    return report.placed(titles.withColumn("folded", F.lower("display_name")), ["folded", "display_name", "document_id"]).select("document_id", "place")


def queries() -> dict:
    plain = [
        model_resolution, local_models, runtime_limits, secret_evidence, queue_messages, evidence_layers, count_contract, calibration_refresh, benchmark_states, enriched_runs, execution_evidence, unmet_capabilities,
        probe_pages, extraction_total, payload_violations, runover_pages, display_order,
    ]
    return {q.__name__: q for q in plain}


def _values(rows: list[tuple]) -> str:
    put = lambda x: "NULL" if x is None else repr(x) if isinstance(x, str) else str(x).upper()
    return ", ".join(f"({', '.join(map(put, r))})" for r in rows)


_KEY = "lower(regexp_replace(trim(coalesce({x}, '')), '\\s+', ' ', 'g'))"
_EVENTS = "e AS (SELECT user_id AS run, event_id AS seq, event_type, value, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
_CATALOGS = f"""asked(provider, model) AS (SELECT * FROM (VALUES {_values(ASKED)}) UNION ALL SELECT 'part', p_name FROM part), catalog(provider, model, lim, verified) AS (VALUES {_values(CATALOG)}),
hints(hint, ordinal, lim, recommended, len) AS (VALUES {_values(HINTS)})"""
_RUNS = "r AS (SELECT run_id, persisted_at, e.key AS stage, e.value AS b FROM (SELECT run_id, persisted_at, unnest(map_entries(stages)) AS e FROM run_results))"


def oracle_sql() -> dict[str, str]:
    return {
        "model_resolution": f"""WITH {_CATALOGS}, given(alias, model) AS (VALUES ('jina v3', 'jina-embeddings-v3'), ('ada', 'text-embedding-ada-002'), ('part 1', 'sea')),
named AS (SELECT * FROM given UNION ALL SELECT lower(model), model FROM catalog),
a AS (SELECT DISTINCT lower(trim(coalesce(provider, ''))) AS provider, coalesce(model, '') AS model, {_KEY.format(x='model')} AS k FROM asked),
x AS (SELECT a.*, coalesce(n.model, k) AS canonical, (SELECT arg_min(h.lim, h.ordinal) FROM hints h WHERE contains(k, h.hint)) AS hl FROM a LEFT JOIN named n ON n.alias = k)
SELECT x.provider, x.model, canonical, coalesce(c.lim, hl, 4096) AS "limit", CASE WHEN c.verified THEN 'verified' WHEN c.lim IS NOT NULL OR hl IS NOT NULL THEN 'conservative' ELSE 'unknown_capability' END AS status,
  CASE WHEN c.lim IS NOT NULL THEN 'catalog' WHEN hl IS NOT NULL THEN 'family_fallback' ELSE 'unknown' END AS basis FROM x LEFT JOIN catalog c ON c.provider = x.provider AND c.model = canonical""",
        "local_models": f"""WITH {_CATALOGS}, p AS (SELECT p_name AS name, max(p_size) AS s FROM part GROUP BY 1), h AS (SELECT p.*, (SELECT min(ordinal) FROM hints WHERE contains(lower(name), hint)) AS o FROM p)
SELECT name, CAST(CASE WHEN s % 2 = 1 THEN s * 100 ELSE coalesce(lim, 4096) END AS INTEGER) AS "limit", CAST(coalesce(nullif(recommended, 0), CASE WHEN s % 2 = 1 THEN s * 100 END, 4096) AS INTEGER) AS recommended,
  CAST(coalesce(CASE WHEN s % 2 = 1 AND s % 3 = 0 THEN s END, len) AS INTEGER) AS embedding_length,
  CASE WHEN s % 2 = 1 AND o IS NOT NULL THEN 'runtime_metadata_plus_family_policy' WHEN s % 2 = 1 THEN 'runtime_metadata' WHEN o IS NOT NULL THEN 'family_fallback' ELSE 'unknown' END AS basis FROM h LEFT JOIN hints ON ordinal = o""",
        "runtime_limits": f"""WITH {_EVENTS} SELECT run, seq, CAST(CASE WHEN k % 50 > 0 AND seq % 40 > 0 THEN least(k % 50, seq % 40) WHEN k % 50 > 0 THEN k % 50 WHEN seq % 40 > 0 THEN seq % 40 ELSE 4096 END AS INTEGER) AS "limit" FROM e""",
        "secret_evidence": f"""WITH {_RUNS}, s AS (SELECT DISTINCT run_id, CASE WHEN length(stage) % 3 = 0 THEN stage || '_api_key' ELSE stage END AS key, b.operator_message AS v FROM r)
SELECT run_id, key, CASE WHEN regexp_matches(upper(key), 'KEY|SECRET|TOKEN|PASSWORD') THEN '' ELSE coalesce(v, '') END AS value, coalesce(v, '') <> '' AS present, CASE WHEN coalesce(v, '') <> '' THEN sha256(v) ELSE '' END AS value_hash FROM s""",
        "queue_messages": f"""WITH {_EVENTS}, m AS (SELECT *, 'record ' || (k % 6 + 1) || '/6' AS r FROM e)
SELECT run, seq, 'Desktop queue: ' || CASE WHEN event_type = 'click' AND k % 2 = 0 THEN 'reusing cached embeddings for ' || r || '; writing its page-parent record to this workspace' WHEN event_type = 'view' THEN r || ', chunks ' || (k % 4) || '/4' ELSE r END AS message FROM m""",
        "evidence_layers": f"""WITH {_RUNS}, l AS (SELECT run_id, stage, arg_max(b.status, (persisted_at, b.status)) AS st FROM r WHERE b IS NOT NULL GROUP BY run_id, stage),
x AS (SELECT run_id, coalesce(bool_or(stage = 'post_upload_verification' AND st IN ('success', 'degraded')), FALSE) AND coalesce(bool_or(stage = 'segmentation' AND st IN ('success', 'skipped')), FALSE) AND coalesce(bool_or(stage = 'preflight' AND st IN ('success', 'degraded')), FALSE) AS succeeded FROM l GROUP BY run_id)
SELECT run_id, succeeded, CASE WHEN succeeded THEN 'success' ELSE 'degraded' END AS outcome FROM x""",
        "count_contract": """WITH f AS (SELECT document_id, max(page_count) AS prepared FROM source_files GROUP BY 1), p AS (SELECT document_id, count(*) AS stored, count(*) FILTER (WHERE length(text) > 0) AS filled FROM (SELECT DISTINCT page_id, document_id, text FROM pdf_pages) GROUP BY 1)
SELECT f.document_id, coalesce(prepared > 0 AND stored = prepared AND (CASE WHEN f.document_id % 3 <> 0 AND filled > 0 THEN filled ELSE stored END) >= prepared, FALSE) AS agree FROM f JOIN p USING (document_id)""",
        "calibration_refresh": f"""WITH {_EVENTS}, x AS (SELECT run, bool_or(event_type = 'error' AND value > 200) AS u, run % 3 = 0 AS had, run % 4 = 0 AS man, run % 5 >= 3 AS bad FROM e GROUP BY run)
SELECT run, CASE WHEN had OR u THEN 'observer_uncertainty' ELSE '' END AS reasons,
  array_to_string(list_filter([CASE WHEN man THEN 'manual' END, CASE WHEN man THEN 'terminal_not_successful' END, CASE WHEN u THEN 'observer_uncertainty' END, CASE WHEN bad AND NOT man THEN 'terminal_not_successful' END], lambda y: y IS NOT NULL), ',') AS exclusions,
  (u AND NOT had) OR u OR (bad AND NOT man) AS changed FROM x""",
        "benchmark_states": """WITH x AS (SELECT o_custkey AS document, 5 - count(DISTINCT o_orderpriority) AS missing, count(*) FILTER (WHERE ok AND o_orderkey % 2 = 0) AS failures, count(*) FILTER (WHERE ok) AS eligible
  FROM (SELECT *, o_orderstatus = 'F' AND o_totalprice > 50000 AND o_orderpriority <> '1-URGENT' AND o_orderkey % 5 = 3 AS ok FROM orders) GROUP BY 1)
SELECT *, CASE WHEN missing > 0 THEN 'awaiting-rerun' WHEN failures > 0 THEN 'calibration-failed' ELSE 'completed' END AS state FROM x""",
        "enriched_runs": """SELECT o_orderkey AS document, o_custkey AS trial, o_totalprice AS total, q AS quantity FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem WHERE l_linenumber = 2 AND l_orderkey % 2 = 0 GROUP BY 1) l ON l_orderkey = o_orderkey""",
        "execution_evidence": "SELECT document_id, coalesce(arg_min(ocr_method, page) FILTER (WHERE ocr_method <> ''), 'not_recorded') AS mode FROM pdf_pages GROUP BY 1",
        "unmet_capabilities": """WITH a AS (SELECT DISTINCT lower(trim(segment_mode)) AS name FROM run_requests WHERE segment_mode IS NOT NULL UNION SELECT 'stream')
SELECT name, CASE WHEN mode IS NULL THEN 'missing' ELSE 'blocked' END AS status FROM a LEFT JOIN segmentation_policy ON mode = name WHERE page_local IS NULL OR NOT page_local""",
        "probe_pages": "SELECT document_id, page, page_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page) AS k FROM (SELECT DISTINCT document_id, page, page_id FROM pdf_pages)) WHERE k <= 2",
        "extraction_total": f"WITH {_EVENTS} SELECT round(coalesce(sum(value - 10), 0), 2) AS seconds, count(*) AS n_events FROM e WHERE k % 3 = 0 AND value > 10",
        "payload_violations": f"""WITH RECURSIVE {_RUNS}, w AS (SELECT DISTINCT run_id, stage, '' AS label, FALSE AS keyed, CAST(b.evidence AS JSON) AS v FROM r WHERE json_valid(b.evidence)
  UNION ALL SELECT run_id, stage, c.key, json_type(v) = 'OBJECT', c.value FROM w, json_each(v) AS c WHERE json_type(v) IN ('ARRAY', 'OBJECT')),
f AS (SELECT run_id, stage, 'forbidden key: ' || label AS x FROM w WHERE keyed AND (lower(label) IN ('path', 'filename', 'file_name', 'fingerprint', 'sha256', 'workspace', 'api_key', 'secret', 'text') OR ends_with(lower(label), '_path') OR starts_with(lower(label), 'workspace'))
  UNION SELECT run_id, stage, unnest([CASE WHEN regexp_matches(s, '(?:[A-Za-z]:\\\\|\\\\\\\\)[^\\r\\n"]+') THEN 'absolute path' END, CASE WHEN regexp_matches(s, '(?:^|[^\\p{{L}}\\p{{N}}_])[a-fA-F0-9]{{64}}(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 'sha256-like value' END,
    CASE WHEN regexp_matches(s, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:sk|api)[_-][a-z0-9_-]{{8,}}(?:$|[^\\p{{L}}\\p{{N}}_-])') THEN 'API-key-like value' END, CASE WHEN contains(s, 'storage/') OR contains(s, 'default') THEN 'private source value' END]) FROM (SELECT run_id, stage, v->>'$' AS s FROM w WHERE json_type(v) = 'VARCHAR'))
SELECT run_id, stage, string_agg(x, '; ' ORDER BY x) AS violations FROM f WHERE x IS NOT NULL GROUP BY run_id, stage""",
        "display_order": "SELECT document_id, row_number() OVER (ORDER BY lower(display_name), display_name, document_id) AS place FROM (SELECT DISTINCT document_id, coalesce(title, '') AS display_name FROM source_files)",
    }
