"""Queries over nested run records (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.shred import entity_rows, entity_table, fields_json, shred
from leafmill.session import read

KEYS = ["run_id", "stage"]
#: The root of what a stage itself holds.
STAGE = "(stage)"


def run_nodes(runs: DataFrame, kinds=None) -> DataFrame:
    """Adjacency rows of every stage's evidence and of the cleanup obligations (stage '')."""
    stages = runs.select("run_id", F.explode("stages").alias("stage", "body")).select("run_id", "stage", F.col("body.evidence").alias("doc"), F.lit("").alias("at"))
    # the entries stay in the array as they are: a null element keeps its position and gives no object
    duties = runs.where(F.size("cleanup_obligations") > 0).select(
        "run_id", F.lit("").alias("stage"), F.to_json("cleanup_obligations", {"ignoreNullFields": "false"}).alias("doc"), F.lit("cleanup_obligations").alias("at")
    )
    extra = {"kinds": kinds} if kinds else {}
    return shred(stages.unionByName(duties), KEYS, "doc", F.col("at"), **extra)


def stage_nodes(runs: DataFrame) -> DataFrame:
    """Adjacency rows of the lists inside each stage besides its evidence; their paths start with `STAGE`, which no evidence's do.

    Plain texts become objects with one `value`, so that each is a row that knows its stage. Null
    elements keep their position and give no object.
    """
    value = lambda c: F.transform(f"body.{c}", lambda x: F.when(x.isNotNull(), F.struct(x.alias("value")))).alias(c)
    lists = F.struct(F.col("body.mutations").alias("mutations"), *[value(c) for c in ("artifacts", "warnings", "errors")])
    stages = runs.select("run_id", F.explode("stages").alias("stage", "body")).where(F.col("body").isNotNull())
    return shred(stages.select("run_id", "stage", F.to_json(lists, {"ignoreNullFields": "false"}).alias("doc")), KEYS, "doc", F.lit(STAGE))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The entity rows that are objects in arrays."""
    rows = entity_rows(run_nodes(read(spark, d, "run_results")), KEYS)
    return rows.where((F.col("kind") == "object") & (F.col("entity") != "")).select(*KEYS, "path", "parent_path")


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entity rows of all record types: link columns, and the fields as a JSON object."""
    runs = read(spark, d, "run_results")
    rows = entity_rows(run_nodes(runs).unionByName(stage_nodes(runs)), KEYS)
    return rows.select(*KEYS, "entity", "path", "parent_path", "place", "ordinal", "kind", fields_json().alias("fields"))


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Entity rows of the evidence alone, roots and lists of plain values included."""
    rows = entity_rows(run_nodes(read(spark, d, "run_results")), KEYS).where(F.col("stage") != "")
    return rows.select(*KEYS, "entity", "path", "parent_path", "ordinal", "kind", fields_json().alias("fields"))


def _table(nodes: DataFrame, entity: str, labels: tuple[str, ...]) -> DataFrame:
    """The pivoted table of one entity, each row once."""
    return entity_table(nodes, KEYS, entity, labels).distinct()


def p3_mutations(spark: SparkSession, d: str) -> DataFrame:
    """What each stage changed: one row a mutation, under its run and stage."""
    return _table(stage_nodes(read(spark, d, "run_results")), f"{STAGE}.mutations[]", ("kind", "target", "before", "after"))


def p3_messages(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts, warnings and errors of each stage: one row each, `entity` tells which."""
    nodes = stage_nodes(read(spark, d, "run_results"))
    tables = [_table(nodes, f"{STAGE}.{x}[]", ("value",)).withColumn("entity", F.lit(x)) for x in ("artifacts", "warnings", "errors")]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def p3_obligations(spark: SparkSession, d: str) -> DataFrame:
    """Cleanup obligations: one row each."""
    return _table(run_nodes(read(spark, d, "run_results")), "cleanup_obligations[]", ("kind", "resource_id", "status", "message"))


def p3_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings in evidence: one row each."""
    return _table(run_nodes(read(spark, d, "run_results")), "findings[]", ("severity", "code", "message"))


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    """The third level: columns of tables of anomalies, each under its table."""
    return _table(run_nodes(read(spark, d, "run_results")), "anomalies[].tables[].columns[]", ("name", "type"))


def p3_stages(spark: SparkSession, d: str) -> DataFrame:
    """The first level: one row per run and stage, the latest of the persisted copies."""
    runs = read(spark, d, "run_results")
    s = runs.select("run_id", "persisted_at", F.explode("stages").alias("stage", "body")).where(F.col("body").isNotNull())
    flat = s.select("run_id", "stage", "persisted_at", "body.status", "body.elapsed_seconds", "body.safe_retry", "body.started_at", "body.ended_at", "body.operator_message", F.size("body.artifacts").alias("n_artifacts"), F.size("body.mutations").alias("n_mutations"))
    # a content hash makes the choice total when two copies share the time
    best = F.max_by(F.struct("status", "elapsed_seconds", "safe_retry", "started_at", "ended_at", "operator_message", "n_artifacts", "n_mutations"), F.struct("persisted_at", "elapsed_seconds", "status"))
    return flat.groupBy("run_id", "stage").agg(best.alias("b")).select("run_id", "stage", "b.*")


def queries() -> dict:
    return {q.__name__: q for q in (p3_found, p3_entities, p3_evidence, p3_mutations, p3_messages, p3_obligations, p3_findings, p3_columns, p3_stages)}


_WALK = """WITH RECURSIVE docs AS (
  SELECT DISTINCT run_id, e.key AS stage, '' AS base, e.value.evidence AS doc
  FROM (SELECT run_id, unnest(map_entries(stages)) AS e FROM run_results) WHERE json_valid(e.value.evidence)
  UNION ALL
  SELECT DISTINCT run_id, '' AS stage, 'cleanup_obligations' AS base, CAST(to_json(cleanup_obligations) AS VARCHAR) AS doc
  FROM run_results WHERE len(cleanup_obligations) > 0
  UNION ALL
  SELECT DISTINCT run_id, e.key AS stage, '(stage)' AS base, CAST(to_json(struct_pack(mutations := e.value.mutations, artifacts := list_transform(e.value.artifacts, lambda x: CASE WHEN x IS NOT NULL THEN struct_pack(value := x) END),
    warnings := list_transform(e.value.warnings, lambda x: CASE WHEN x IS NOT NULL THEN struct_pack(value := x) END), errors := list_transform(e.value.errors, lambda x: CASE WHEN x IS NOT NULL THEN struct_pack(value := x) END))) AS VARCHAR) AS doc
  FROM (SELECT run_id, unnest(map_entries(stages)) AS e FROM run_results) WHERE e.value IS NOT NULL
), walk AS (
  SELECT run_id, stage, base AS path, '' AS above, FALSE AS element, CAST(doc AS JSON) AS v, '' AS field, base AS whole, -1 AS ordinal, 0 AS depth FROM docs
  UNION ALL
  SELECT run_id, stage,
    CASE WHEN json_type(v) = 'ARRAY' THEN walk.path || '[' || c.key || ']' WHEN walk.path = '' THEN c.key ELSE walk.path || '.' || c.key END,
    CASE WHEN element AND json_type(v) = 'OBJECT' THEN walk.path ELSE above END,
    json_type(v) = 'ARRAY', c.value,
    CASE WHEN json_type(v) = 'ARRAY' THEN field || '[' || c.key || ']' WHEN depth = 0 OR element THEN replace(replace(replace(c.key, '\\', '\\\\'), '.', '\\.'), '[', '\\[')
      ELSE field || '.' || replace(replace(replace(c.key, '\\', '\\\\'), '.', '\\.'), '[', '\\[') END,
    whole, CAST(CASE WHEN json_type(v) = 'ARRAY' THEN c.key END AS INTEGER), depth + 1
  FROM walk, json_each(v) AS c WHERE json_type(v) IN ('ARRAY', 'OBJECT')
)"""


_ENTITIES = """, n AS (SELECT DISTINCT run_id, stage, path, above, element, field, whole, ordinal, depth, json_type(v) AS t, v, CAST(v AS VARCHAR) IN ('{}', '[]') OR json_type(v) NOT IN ('ARRAY', 'OBJECT') AS leaf FROM walk),
things AS (SELECT DISTINCT run_id, stage, whole, CASE WHEN element THEN regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') ELSE '' END AS entity, path, above AS parent_path, field AS place, CASE WHEN element THEN ordinal END AS ordinal,
  CASE t WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM n WHERE (element OR depth = 0) AND (t = 'OBJECT' OR leaf)),
f AS (SELECT DISTINCT run_id, stage, whole, CASE WHEN element OR depth = 0 THEN path WHEN above <> '' THEN above ELSE whole END AS path, CASE WHEN element OR depth = 0 THEN 'value' ELSE field END AS label,
  CASE WHEN t = 'VARCHAR' THEN CAST(to_json(v->>'$') AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS literal FROM n WHERE leaf AND (t <> 'OBJECT' OR (NOT element AND depth > 0))),
j AS (SELECT run_id, stage, whole, path, '{' || string_agg(CAST(to_json(label) AS VARCHAR) || ':' || literal, ',' ORDER BY label) || '}' AS fields FROM f GROUP BY ALL)"""
_JOINED = " FROM things t LEFT JOIN j ON j.run_id IS NOT DISTINCT FROM t.run_id AND j.stage = t.stage AND j.whole = t.whole AND j.path = t.path"


def _sql_table(source: str, columns: tuple[str, ...], path: str, entity: str = "") -> str:
    fields = ", ".join(f'e."{c}" AS "{c}"' for c in columns)
    return f"""SELECT DISTINCT run_id, stage, {path} || '[' || (k - 1) || ']' AS path, '' AS parent_path, CAST(k - 1 AS INTEGER) AS ordinal, {fields}{entity} FROM ({source}) WHERE e IS NOT NULL"""


def _sql_list(column: str) -> str:
    """Each stage's list, an element a row."""
    return f"SELECT run_id, s.key AS stage, unnest(s.value.{column}) AS e, generate_subscripts(s.value.{column}, 1) AS k FROM (SELECT run_id, unnest(map_entries(stages)) AS s FROM run_results) WHERE s.value IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _WALK + " SELECT DISTINCT run_id, stage, path, above AS parent_path FROM walk WHERE element AND json_type(v) = 'OBJECT' AND whole <> '(stage)'",
        "p3_entities": _WALK + _ENTITIES + " SELECT t.run_id, t.stage, entity, t.path, parent_path, place, ordinal, kind, coalesce(fields, '{}') AS fields" + _JOINED,
        "p3_evidence": _WALK + _ENTITIES + " SELECT t.run_id, t.stage, entity, t.path, parent_path, ordinal, kind, coalesce(fields, '{}') AS fields" + _JOINED + " WHERE t.whole = ''",
        "p3_mutations": _sql_table(_sql_list("mutations"), ("kind", "target", "before", "after"), "'(stage).mutations'"),
        "p3_messages": " UNION ALL ".join(
            f"SELECT DISTINCT run_id, stage, '(stage).{c}[' || (k - 1) || ']' AS path, '' AS parent_path, CAST(k - 1 AS INTEGER) AS ordinal, e AS value, '{c}' AS entity FROM ({_sql_list(c)}) WHERE e IS NOT NULL" for c in ("artifacts", "warnings", "errors")
        ),
        "p3_obligations": _sql_table("SELECT run_id, '' AS stage, unnest(cleanup_obligations) AS e, generate_subscripts(cleanup_obligations, 1) AS k FROM run_results", ("kind", "resource_id", "status", "message"), "'cleanup_obligations'"),
        "p3_findings": _WALK + " SELECT DISTINCT run_id, stage, path, above AS parent_path, ordinal, v->>'severity' AS severity, v->>'code' AS code, v->>'message' AS message FROM walk WHERE whole = '' AND stage <> '' AND element AND json_type(v) = 'OBJECT' AND regexp_matches(path, '^findings\\[[0-9]+\\]$')",
        "p3_columns": _WALK + " SELECT DISTINCT run_id, stage, path, above AS parent_path, ordinal, v->>'name' AS name, v->>'type' AS type FROM walk WHERE whole = '' AND stage <> '' AND element AND json_type(v) = 'OBJECT' AND regexp_matches(path, '^anomalies\\[[0-9]+\\]\\.tables\\[[0-9]+\\]\\.columns\\[[0-9]+\\]$')",
        "p3_stages": """
WITH s AS (
  SELECT run_id, e.key AS stage, persisted_at, e.value AS b FROM (SELECT run_id, persisted_at, unnest(map_entries(stages)) AS e FROM run_results) WHERE e.value IS NOT NULL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY persisted_at DESC, b.elapsed_seconds DESC NULLS LAST, b.status DESC NULLS LAST) AS k FROM s
)
SELECT run_id, stage, b.status AS status, b.elapsed_seconds AS elapsed_seconds, b.safe_retry AS safe_retry, b.started_at AS started_at, b.ended_at AS ended_at, b.operator_message AS operator_message,
  CAST(len(b.artifacts) AS INTEGER) AS n_artifacts, CAST(len(b.mutations) AS INTEGER) AS n_mutations
FROM r WHERE k = 1""",
    }
