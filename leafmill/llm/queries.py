"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import canonical, leaks, lines, pieces, scans, spam, tokens
from leafmill.session import read, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(read(spark, d, "pdf_pages"))


def p1_tests(spark: SparkSession, d: str) -> DataFrame:
    """How many (source, line) pairs were tested, and what rejected how many."""
    return lines.test_counts(read(spark, d, "pdf_pages"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.strip_repeated_lines(read(spark, d, "pdf_pages"))


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read(spark, d, "pdf_pages"), read(spark, d, "source_files"), read(spark, d, "lexicon")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.findings(*_scans(spark, d)).select("page_id", "line_no", "kind").distinct()


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(*_scans(spark, d))


def _pieces(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    return pieces.request_pieces(read(spark, d, "pdf_pages"), read(spark, d, "run_requests"), read(spark, d, "segmentation_policy"), with_text)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).where(F.col("piece") == 1).select("request_id", "page_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True)


def p4_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of the pieces of each request and page: where they begin and end, the longest, and whether each overlaps the one before as asked.

    What the SQL tells from the requests and pages alone must come out of the pieces themselves.
    """
    asked = pieces.limits(read(spark, d, "run_requests"), read(spark, d, "segmentation_policy"))
    x = _pieces(spark, d, True).join(asked.select("request_id", "limit", "overlap").distinct(), "request_id")
    w = Window.partitionBy("request_id", "page_id").orderBy("piece")
    x = x.withColumn("before", F.lag("stop").over(w))
    kept = F.least("overlap", F.col("limit") - 1)
    good = (F.length("text") == F.col("stop") - F.col("start")) & (F.col("stop") > F.coalesce("before", F.lit(0))) & F.coalesce(F.col("start") == F.col("before") - kept, F.col("start") == 0)
    return x.groupBy("request_id", "page_id").agg(F.max("stop").alias("chars"), (F.max(F.length("text")) <= F.max("limit")).alias("within"), F.every(good).alias("joined"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.same_look_pairs(written(canonical.look_keys(read(spark, d, "pdf_pages")), "looks"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_classes(written(canonical.look_keys(read(spark, d, "pdf_pages")), "looks"))


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_text(read(spark, d, "pdf_pages")).distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_spans(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.merged_spans(_leaks(spark, d)).select("doc_id", F.posexplode("spans").alias("n", "span")).select("doc_id", "n", "span.start", "span.stop")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(read(spark, d, "documents")).select("doc_id")


def queries() -> dict:
    plain = [p1_found, p1_clean, p1_tests, p2_found, p2_text, p4_found, p4_pieces, p4_cover, p5_found, p5_classes, p5_text, p6_ids, p7_found, p7_spans, p8_found]
    return {q.__name__: q for q in plain}


_P4 = """FROM run_requests r JOIN segmentation_policy s ON lower(trim(r.segment_mode)) = lower(trim(s.mode)) JOIN pdf_pages p ON p.document_id = r.document_id
WHERE s.mode <> 'none' AND length(p.text) > r.target_passage_length * (1 + s.target_drift_fraction)"""
# every twelve words in a row of a document that stand in an item as well
_P7 = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS l FROM documents WHERE length(text) > 0),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS l FROM eval_items WHERE length(text) > 0),
iw AS (SELECT DISTINCT item_id, array_to_string(l[k:k + 11], ' ') AS g FROM (SELECT item_id, l, unnest(range(1, len(l) - 10)) AS k FROM i WHERE len(l) >= 12)),
dw AS (SELECT doc_id, array_to_string(l[k:k + 11], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 10)) AS k FROM w WHERE len(l) >= 12))
"""
_P1 = rf"""
WITH pages AS (SELECT DISTINCT page_id, document_id, source, text FROM pdf_pages),
split AS (
  SELECT page_id, document_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM pages WHERE text IS NOT NULL
), keyed AS (
  SELECT page_id, document_id, source, line_no, regexp_replace(lower(line), '[\p{{Nd}}{lines.BLANK}]+', '', 'g') AS k FROM split
), long AS (SELECT * FROM keyed WHERE length(regexp_replace(k, '[^\p{{L}}]+', '', 'g')) >= {lines.MIN_LETTERS}),
sizes AS (SELECT source, count(DISTINCT document_id) AS n FROM pages GROUP BY source),
hot AS (
  SELECT l.source, l.k FROM long l JOIN sizes s USING (source) GROUP BY l.source, l.k, s.n
  HAVING count(DISTINCT l.document_id) >= {lines.MIN_DOCUMENTS} AND count(DISTINCT l.document_id) >= {lines.MIN_SHARE} * s.n
), found AS (SELECT DISTINCT page_id, CAST(line_no AS INTEGER) AS line_no FROM long JOIN hot USING (source, k))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": "SELECT DISTINCT r.request_id, p.page_id " + _P4,
        "p4_cover": "SELECT DISTINCT r.request_id, p.page_id, CAST(length(p.text) AS INTEGER) AS chars, TRUE AS within, TRUE AS joined " + _P4,
        "p7_found": _P7 + "SELECT DISTINCT doc_id, item_id FROM dw JOIN iw ON dw.g = iw.g",
        "p1_found": _P1 + "SELECT page_id, line_no FROM found",
        "p1_clean": _P1
        + """, kept AS (SELECT s.page_id, string_agg(line, chr(10) ORDER BY s.line_no) AS t FROM split s LEFT JOIN found f ON f.page_id = s.page_id AND f.line_no = s.line_no WHERE f.page_id IS NULL GROUP BY s.page_id)
SELECT p.page_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.t, '') END AS text FROM pages p LEFT JOIN kept k ON k.page_id = p.page_id""",
    }
