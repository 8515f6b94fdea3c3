"""Queries of the text pipeline: pages to normalised, numbered segments, and what is checked on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import match, segment
from leafmill.session import read
from leafmill.sources.elements import elements_to_pages, line_elements

TARGET, HARD = 400, 900
#: Above any page: whole pages are kept in every mode that doesn't cut towards its target.
CEILING = 100_000_000
#: Headings that pages of these tables do open with, asked for as stop and end headings.
HEADINGS = ("Report", "Order", "The", "Last", "Documento")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Each page once; repeated rows differ in their times only."""
    return read(spark, d, "pdf_pages").select("page_id", "document_id", "page", "kind", "text").dropDuplicates(["page_id"])


def normalize_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", X.normalize(F.col("text")).alias("clean"))


def page_report(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).withColumn("clean", X.normalize(F.col("text")))
    return p.select(
        "page_id", "document_id", "page", "kind", F.length(F.coalesce("text", F.lit(""))).alias("raw_chars"), F.length("clean").alias("normalized_chars"),
        X.word_count(F.col("clean")).alias("words_approx"), F.left("clean", F.lit(300)).alias("preview"),
    )


def safe_stems(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "source_files").select("document_id", X.safe_stem(F.coalesce("title", F.lit(""))).alias("stem"), X.clean_label(F.coalesce("title", F.lit(""))).alias("label")).distinct()


def greedy_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment.greedy_segments(pages(spark, d), ["page_id"], F.col("text"))


def segment_page_status(spark: SparkSession, d: str) -> DataFrame:
    return segment.page_status(pages(spark, d), start_page=2, stop_after=2, headings=HEADINGS).select("page_id", "document_id", "page", F.length("clean").alias("chars"), "status")


def stop_truncation(spark: SparkSession, d: str) -> DataFrame:
    return segment.truncated(segment_page_status(spark, d))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pdf_pages").select("page_id", "document_id", "page", "kind", "backend", X.clean_label(F.coalesce("source", F.lit(""))).alias("label"), "text")
    return p.dropDuplicates(["page_id"])


def segmented_document(spark: SparkSession, d: str) -> DataFrame:
    """Kept pages split and numbered through each document, each piece with its header line; nothing after a stop heading."""
    return segment.document_segments(_labelled(spark, d), stop_after=1, headings=HEADINGS)[0]


def segment_report(spark: SparkSession, d: str) -> DataFrame:
    """What became of each page, up to the stop page."""
    return segment.document_segments(_labelled(spark, d), stop_after=1, headings=HEADINGS)[1]


def requested_pages(spark: SparkSession, d: str) -> DataFrame:
    return segment.requested_pages(pages(spark, d), read(spark, d, "run_requests"))


def span_identity(spark: SparkSession, d: str) -> DataFrame:
    s = greedy_segments(spark, d)
    return s.select("page_id", "piece", X.span_identity(F.col("page_id"), F.col("piece"), F.sha2("segment", 256), F.lit("boundary-v1")).alias("span_id"))


def end_sections(spark: SparkSession, d: str) -> DataFrame:
    return segment.end_sections(pages(spark, d), (*X.END_HEADINGS, *HEADINGS))


def page_transitions(spark: SparkSession, d: str) -> DataFrame:
    return segment.transitions(pages(spark, d))


def custom_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    g = segment.page_groups(pages(spark, d), [2, 3, 2])
    return g.select("document_id", "group_no", "first_page", "last_page", "n_pages", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


def whole_document_records(spark: SparkSession, d: str) -> DataFrame:
    return segment.joined_pages(pages(spark, d), ["document_id"]).select("document_id", "first_page", "last_page", "n_pages", F.md5("text").alias("text_md5"))


def phrase_validation(spark: SparkSession, d: str) -> DataFrame:
    """The requests' own phrases, and for every document one that its last page holds, in small letters, and an empty one."""
    p = pages(spark, d)
    asked = read(spark, d, "run_requests").select("request_id", "document_id", F.explode("validation_phrases").alias("phrase"))
    held = p.where(F.length("text") >= 60).groupBy("document_id").agg(F.max_by(F.lower(F.substring("text", 20, 25)), "page").alias("phrase"))
    marked = p.withColumn("text", F.concat(F.lit("[PDF_PAGE "), F.col("page").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit(""))))
    none = read(spark, d, "run_requests").select("request_id", "document_id", F.lit("").alias("phrase"))
    every = asked.unionByName(held.select((-F.col("document_id")).alias("request_id"), "document_id", "phrase")).unionByName(none)
    return match.phrase_validation(every, segment.joined_pages(marked, ["document_id"]))


def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.redact(F.col("text")).alias("text"))


def cleaned_photo_text(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pdf_pages").where(F.col("ocr_method") != "").select("page_id", "text").dropDuplicates(["page_id"])
    return p.select("page_id", X.clean_photo_text(F.col("text")).alias("text"))


def fragment_match(spark: SparkSession, d: str) -> DataFrame:
    return match.fragment_match(pages(spark, d))


def line_element_rows(spark: SparkSession, d: str) -> DataFrame:
    return line_elements(pages(spark, d))


def elements_pages(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: page lines as layout elements, and back to pages."""
    return elements_to_pages(line_elements(pages(spark, d))).select("document_id", "page", F.md5("text").alias("text_md5"))


def page_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a document's file announces and the extractor didn't deliver."""
    f = read(spark, d, "source_files").groupBy("document_id").agg(F.max("page_count").alias("n")).where(F.col("n") > 0)
    want = f.select("document_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    return want.join(pages(spark, d).select("document_id", "page"), ["document_id", "page"], "left_anti")


def cached_reuse(spark: SparkSession, d: str) -> DataFrame:
    """New documents (odd numbers) and the stored one (even numbers) whose text and length are the same."""
    docs = read(spark, d, "documents").where(F.col("text").isNotNull())
    fields = ["text", "n_chars"]
    return match.cached_reuse(docs.where(F.col("doc_id") % 2 == 1).select("doc_id", *fields), docs.where(F.col("doc_id") % 2 == 0), fields, "doc_id").select("doc_id", "reused")


def vector_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("chunk_source").isNotNull()).select("doc_id", X.url_uuid5(F.col("chunk_source")).alias("cache_key"))


def _semantic(mode: str, target: int = TARGET, hard: int = HARD):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return segment.semantic_segments(pages(spark, d), ["page_id"], F.col("text"), target, hard, mode)

    return query


def queries() -> dict:
    plain = [
        normalize_pages, page_report, safe_stems, greedy_segments, segment_page_status, stop_truncation, segmented_document, segment_report, requested_pages, span_identity, end_sections, page_transitions,
        custom_page_ranges, whole_document_records, phrase_validation, redacted_text, cleaned_photo_text, fragment_match, line_element_rows, elements_pages, page_coverage, cached_reuse, vector_cache_key,
    ]
    semantic = {f"semantic_segments_{m}": _semantic(m) for m in segment.POLICIES}
    ceiling = {f"ceiling_segments_{m}": _semantic(m, hard=CEILING) for m in segment.POLICIES if m not in ("none", "page_passages")}
    return {q.__name__: q for q in plain} | semantic | ceiling


# Fixed values of the SQL, written from the rules and not from the operators: white space, word characters, ligatures, headings.
_S = "\\t\\n\\v\\f\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_W = "\\p{L}\\p{N}_"
_LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ft", "\ufb06": "st"}
_ENDS = ["Notes", "Bibliography", "Index", "References", "Works Cited", "Endnotes"]
_NAMES = r"(?:api_key|api-key|apikey|token|secret|password)"


def _lig(x: str, st: str = "ft") -> str:
    for a, b in _LIGATURES.items():
        x = f"replace({x}, '{a}', '{st if a == chr(0xFB05) else b}')"
    return x


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def sql_normalize(x: str) -> str:
    t = _lig(f"coalesce({x}, '')")
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = f"regexp_replace({t}, '([{_W}])-[{_S}]*\\n[{_S}]*([{_W}])', '\\1-\\2', 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g'), '[{_S}]+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _sql_heading(names: list[str]) -> str:
    return f"(?i)^[{_S}]*(?:\\[[^\\]\\n]+\\][{_S}]*)?(?:#{{1,6}}[{_S}]*)?[*_~`{_S}]*(?:{'|'.join(names)})(?:$|[^\\p{{L}}\\p{{N}}])"


_PAGES = "pages AS (SELECT DISTINCT page_id, document_id, page, kind, text FROM pdf_pages)"
_CLEAN = f"WITH RECURSIVE {_PAGES}, clean AS (SELECT page_id, document_id, page, kind, text, {sql_normalize('text')} AS clean FROM pages)"
_HEAD = _sql_heading(list(HEADINGS))
_STATUS = f"""SELECT page_id, document_id, page, kind, length(clean) AS chars, clean,
  CASE WHEN page < @start THEN 'skipped_before_start_page' WHEN @stop > 0 AND page > @stop AND regexp_matches(clean, '{_HEAD}') THEN 'stop_heading_detected' WHEN length(clean) < 40 THEN 'skipped_too_short' ELSE 'included' END AS status FROM clean"""


def _status(start: int, stop: int) -> str:
    return _STATUS.replace("@start", str(start)).replace("@stop", str(stop))


# the last place of a mark that ends within the first 650 characters, counted from 0; -1 without one
_LAST = "(CASE WHEN strpos(reverse(left(rest, 650)), '{r}') = 0 THEN -1 ELSE 650 - strpos(reverse(left(rest, 650)), '{r}') - {n} END)"
_CUT = "CASE " + " ".join(f"WHEN {_LAST.format(r=r, n=n)} >= 250 THEN {_LAST.format(r=r, n=n)} + {n}" for r, n in ((" .", 1), (" ;", 1), (" ,", 1), (" ", 0))) + " ELSE 650 END"
_GREEDY = f"""walk AS (
  SELECT page_id, document_id, page, 0 AS piece, CAST(NULL AS VARCHAR) AS segment, clean AS rest FROM {{src}} WHERE clean <> ''
  UNION ALL
  SELECT page_id, document_id, page, piece + 1, CASE WHEN length(rest) > 650 THEN trim(left(rest, CAST({_CUT} AS BIGINT))) ELSE rest END,
    CASE WHEN length(rest) > 650 THEN trim(substr(rest, CAST({_CUT} AS BIGINT) + 1)) ELSE '' END
  FROM walk WHERE rest <> ''
), segments AS (SELECT page_id, document_id, page, piece, segment FROM walk WHERE piece > 0)"""
_DOCS = "docs AS (SELECT document_id, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page) AS text FROM pages GROUP BY document_id)"


def _sql_fold(x: str) -> str:
    for a, b in {"ß": "ss", "ŉ": "ʼn", "ǰ": "ǰ", "ς": "σ", "ſ": "s", "İ": "i̇"}.items():
        x = f"replace(lower({x}), '{a}', '{b}')" if a == "ß" else f"replace({x}, '{a}', '{b}')"
    return _lig(x, "st")


def oracle_sql() -> dict[str, str]:
    secret = "text"
    for p in (rf"(?i)((?:^|[^{_W}]){_NAMES}[{_S}]*[=:][{_S}]*)([^{_S},;]+)", rf"(?i)((?:^|[^{_W}])Bearer[{_S}]+)([^{_S},;]+)", rf"(?i)([?&]{_NAMES}=)([^&#{_S}]+)"):
        secret = f"regexp_replace({secret}, '{_q(p)}', '\\1[REDACTED]', 'g')"
    for p in (rf"""(?i)(^|[^{_W}])[A-Z]:\\[^{_S}"']*""", rf"""(^|[^{_W}:])/[^{_S}"']+"""):
        secret = f"regexp_replace({secret}, '{_q(p)}', '\\1[LOCAL_PATH]', 'g')"
    label = f"regexp_replace(regexp_replace({sql_strip('@')}, '[\\r\\n\\[\\]]+', ' ', 'g'), '[{_S}]+', ' ', 'g')"
    stem = f"trim(regexp_replace({sql_strip('t')}, '[^{_W}.-]+', '-', 'g'), '.-_')"
    heads = [*_ENDS, *HEADINGS]
    whole = f"{sql_strip('text')} AS segment"
    stop = f"CAST(length(regexp_replace(text, '[{_S}]+$', '')) AS INTEGER)"
    lead = f"CAST(length(text) - length(regexp_replace(text, '^[{_S}]+', '')) AS INTEGER)"
    return {
        "normalize_pages": f"{_CLEAN} SELECT page_id, clean FROM clean",
        "page_report": f"""{_CLEAN} SELECT page_id, document_id, page, kind, CAST(length(coalesce(text, '')) AS INTEGER) AS raw_chars, CAST(length(clean) AS INTEGER) AS normalized_chars,
  CAST(CASE WHEN clean = '' THEN 0 ELSE len(string_split(clean, ' ')) END AS INTEGER) AS words_approx, left(clean, 300) AS preview FROM clean""",
        "safe_stems": f"SELECT DISTINCT document_id, CASE WHEN {stem} = '' THEN 'rag-source' ELSE {stem} END AS stem, CASE WHEN {label.replace('@', 't')} = '' THEN 'Source' ELSE {label.replace('@', 't')} END AS label FROM (SELECT document_id, coalesce(title, '') AS t FROM source_files)",
        "greedy_segments": f"{_CLEAN}, {_GREEDY.format(src='clean')} SELECT page_id, CAST(piece AS INTEGER) AS piece, segment FROM segments",
        "segment_page_status": f"{_CLEAN} SELECT page_id, document_id, page, CAST(chars AS INTEGER) AS chars, status FROM ({_status(2, 2)})",
        "stop_truncation": f"""{_CLEAN}, s AS ({_status(2, 2)}), f AS (SELECT document_id, min(page) AS stop_page FROM s WHERE status = 'stop_heading_detected' GROUP BY document_id)
SELECT page_id, s.document_id, page, CAST(chars AS INTEGER) AS chars, status FROM s LEFT JOIN f ON f.document_id = s.document_id WHERE stop_page IS NULL OR page <= stop_page""",
        "segmented_document": f"""{_CLEAN}, st AS ({_status(1, 1)}), f AS (SELECT document_id, min(page) AS stop_page FROM st WHERE status = 'stop_heading_detected' GROUP BY document_id),
kept AS (SELECT st.* FROM st LEFT JOIN f USING (document_id) WHERE status = 'included' AND (stop_page IS NULL OR page < stop_page)), {_GREEDY.format(src='kept')},
lab AS (SELECT DISTINCT document_id, page, backend, {label.replace('@', "coalesce(source, '')")} AS label FROM pdf_pages)
SELECT s.document_id, s.page, row_number() OVER w AS segment_id, '[' || CASE WHEN label = '' THEN 'Source' ELSE label END || ' | BACKEND ' || coalesce(backend, '') || ' | PDF_PAGE ' || s.page || ' | SEGMENT ' || lpad(CAST(row_number() OVER w AS VARCHAR), 5, '0') || ']' || chr(10) || segment AS record
FROM segments s JOIN lab ON lab.document_id = s.document_id AND lab.page = s.page WINDOW w AS (PARTITION BY s.document_id ORDER BY s.page, piece)""",
        "segment_report": f"""{_CLEAN}, st AS ({_status(1, 1)}), f AS (SELECT document_id, min(page) AS stop_page FROM st WHERE status = 'stop_heading_detected' GROUP BY document_id),
kept AS (SELECT * FROM st WHERE status = 'included'), {_GREEDY.format(src='kept')}, c AS (SELECT page_id, count(*) AS n FROM segments GROUP BY page_id)
SELECT st.document_id, page AS pdf_page, coalesce(kind, '') AS kind, status, CAST(chars AS INTEGER) AS chars, CAST(coalesce(n, 0) AS INTEGER) AS segments, left(clean, 250) AS preview
FROM st LEFT JOIN f USING (document_id) LEFT JOIN c USING (page_id) WHERE stop_page IS NULL OR page <= stop_page""",
        "requested_pages": f"""WITH {_PAGES}, r AS (SELECT DISTINCT request_id, document_id, first_page_override FROM run_requests)
SELECT request_id, p.document_id, page_id, page FROM r JOIN pages p ON p.document_id = r.document_id WHERE page >= coalesce(first_page_override, 1)""",
        "span_identity": f"{_CLEAN}, {_GREEDY.format(src='clean')} SELECT page_id, CAST(piece AS INTEGER) AS piece, 'seg-' || left(sha256(page_id || '|' || piece || '|' || sha256(segment) || '|boundary-v1'), 24) AS span_id FROM segments",
        "end_sections": f"""{_CLEAN}, last AS (SELECT document_id, greatest(1, floor(max(page) * 0.55)) AS least FROM pages GROUP BY document_id),
rk AS (SELECT c.document_id, c.page, CASE {" ".join(f"WHEN regexp_matches(clean, '{_sql_heading([h])}') THEN {i}" for i, h in enumerate(heads))} END AS rank FROM clean c JOIN last l ON l.document_id = c.document_id AND c.page >= l.least),
hit AS (SELECT document_id, page, rank, {heads!r}[rank + 1] AS heading FROM rk WHERE rank IS NOT NULL)
SELECT document_id, page, heading FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, rank) AS k FROM hit) WHERE k = 1""",
        "page_transitions": rf"""WITH {_PAGES}, p AS (SELECT document_id, page, {sql_strip("coalesce(text, '')")} AS t FROM pages),
f AS (SELECT *, regexp_extract(t, '^(?s:.*[.!?][{_S}]+)?((?s:.*))$', 1) AS lf, CASE WHEN regexp_matches(t, '[.!?][{_S}]+') THEN regexp_extract(t, '^((?s:.*?)[.!?])[{_S}]+', 1) ELSE t END AS rf FROM p),
x AS (SELECT a.document_id, a.page, length(a.t) AS n, a.lf, b.rf, regexp_matches(a.lf, '[A-Za-z]-$') AND regexp_matches(b.rf, '^[a-z]') AS divided FROM f a JOIN f b ON b.document_id = a.document_id AND b.page = a.page + 1),
y AS (SELECT *, CASE WHEN lf <> '' AND NOT regexp_matches(lf, '[.!?]["''”’)]?$') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(rf, '^[\p{{Ll}}’”''"]') THEN 2 ELSE 0 END + CASE WHEN divided THEN 3 ELSE 0 END
  - CASE WHEN regexp_matches(rf, '(?i)^(?:chapter|part|notes|references|bibliography|index)(?:$|[^\p{{L}}\p{{N}}_])') THEN 4 ELSE 0 END AS confidence,
  CASE WHEN divided THEN left(lf, length(lf) - 1) || rf ELSE {sql_strip("lf || ' ' || rf")} END AS joined FROM x)
SELECT document_id, page AS left_page, page + 1 AS right_page, document_id || '-b' || lpad(CAST(page AS VARCHAR), CAST(greatest(3, length(CAST(page AS VARCHAR))) AS INTEGER), '0') || '-' || lpad(CAST(page + 1 AS VARCHAR), CAST(greatest(3, length(CAST(page + 1 AS VARCHAR))) AS INTEGER), '0') || '-tr01' AS boundary_id,
  CAST(greatest(0, n - length(lf)) AS INTEGER) AS left_start, CAST(n AS INTEGER) AS left_stop, CAST(length(rf) AS INTEGER) AS right_stop, confidence, confidence >= 3 AS continues,
  CASE WHEN confidence >= 3 THEN joined ELSE '' END AS sentence, CASE WHEN confidence >= 3 THEN sha256(joined) ELSE '' END AS sentence_hash FROM y""",
        "vector_cache_key": f"""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_source)) AS h FROM documents WHERE chunk_source IS NOT NULL)
SELECT doc_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS cache_key FROM h""",
        "custom_page_ranges": f"""WITH {_PAGES}, g AS (SELECT *, CAST(floor((page - 1) / 7) AS BIGINT) * 3 + CASE WHEN (page - 1) % 7 < 2 THEN 1 WHEN (page - 1) % 7 < 5 THEN 2 ELSE 3 END AS group_no FROM pages),
t AS (SELECT document_id, group_no, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page) AS text FROM g GROUP BY ALL)
SELECT document_id, group_no, first_page, last_page, n_pages, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS chars FROM t""",
        "whole_document_records": f"WITH {_PAGES}, {_DOCS} SELECT document_id, first_page, last_page, n_pages, md5(text) AS text_md5 FROM docs",
        "phrase_validation": f"""WITH {_PAGES}, docs AS (SELECT document_id, string_agg('[PDF_PAGE ' || page || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY page) AS text FROM pages GROUP BY document_id),
p AS (SELECT DISTINCT request_id, document_id, unnest(validation_phrases) AS phrase FROM run_requests UNION SELECT -document_id, document_id, arg_max(lower(substr(text, 20, 25)), page) FROM pages WHERE length(text) >= 60 GROUP BY document_id
  UNION SELECT request_id, document_id, '' FROM run_requests),
x AS (SELECT request_id, p.document_id, phrase, coalesce(text, '') AS t FROM p LEFT JOIN docs d ON d.document_id = p.document_id WHERE phrase IS NOT NULL),
y AS (SELECT *, CASE WHEN phrase = '' THEN 0 ELSE strpos({_sql_fold('t')}, {_sql_fold('phrase')}) - 1 END AS pos FROM x)
SELECT request_id, document_id, phrase, CASE WHEN pos >= 0 THEN 'found' ELSE 'missing' END AS status, CAST(pos AS INTEGER) AS position,
  CASE WHEN pos >= 0 THEN coalesce(regexp_extract_all(left(t, pos), '\\[[^\\]\\n]*PDF_PAGE[^\\]\\n]*\\]')[-1], '') ELSE '' END AS marker,
  CASE WHEN pos >= 0 THEN left(replace(substr(t, CAST(greatest(0, pos - 180) AS BIGINT) + 1, CAST(pos + 520 - greatest(0, pos - 180) AS BIGINT)), chr(10), ' '), 1000) ELSE '' END AS preview FROM y""",
        "redacted_text": f"SELECT doc_id, {secret} AS text FROM documents",
        "line_element_rows": f"""WITH {_PAGES}, l AS (SELECT document_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS element_index FROM pages WHERE text IS NOT NULL)
SELECT document_id, page, CAST(element_index AS INTEGER) AS element_index, CASE WHEN regexp_matches({sql_strip('line')}, '^#') THEN 'Title' WHEN regexp_matches({sql_strip('line')}, '^(?:[-*•]|[0-9]+[.)])[{_S}]') THEN 'ListItem' ELSE 'NarrativeText' END AS category, {sql_strip('line')} AS text,
  CAST(length({sql_strip('line')}) AS INTEGER) AS chars, left({sql_normalize(sql_strip('line'))}, 250) AS preview FROM l""",
        "elements_pages": f"""WITH {_PAGES}, l AS (SELECT document_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM pages WHERE text IS NOT NULL),
e AS (SELECT document_id, page, k, CASE WHEN regexp_matches({sql_strip('line')}, '^#') THEN 'Title' WHEN regexp_matches({sql_strip('line')}, '^(?:[-*•]|[0-9]+[.)])[{_S}]') THEN 'ListItem' ELSE 'NarrativeText' END AS category, {sql_strip('line')} AS s FROM l)
SELECT document_id, page, md5(string_agg('[' || category || '] ' || s, chr(10) || chr(10) ORDER BY k)) AS text_md5 FROM e WHERE s <> '' GROUP BY document_id, page""",
        "page_coverage": f"""WITH {_PAGES}, f AS (SELECT document_id, max(page_count) AS n FROM source_files GROUP BY document_id HAVING max(page_count) > 0), w AS (SELECT document_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS page FROM f)
SELECT w.document_id, w.page FROM w LEFT JOIN pages p ON p.document_id = w.document_id AND p.page = w.page WHERE p.page_id IS NULL""",
        "cached_reuse": """SELECT a.doc_id, coalesce(CAST(min(b.doc_id) AS VARCHAR), '') AS reused FROM documents a
LEFT JOIN documents b ON b.doc_id % 2 = 0 AND b.text = a.text AND b.n_chars IS NOT DISTINCT FROM a.n_chars WHERE a.doc_id % 2 = 1 AND a.text IS NOT NULL GROUP BY a.doc_id""",
        **{
            f"ceiling_segments_{m}": f"""WITH {_PAGES} SELECT page_id, 1 AS piece, {whole}, {lead if m in ("passages", "custom_page_ranges") else "CAST(0 AS INTEGER)"} AS start, {stop} AS stop, '{"page_end" if m in ("passages", "custom_page_ranges") else ""}' AS kind,
  '{"selected page_end boundary" if m in ("passages", "custom_page_ranges") else "whole_page_within_safety_ceiling"}' AS reason FROM pages WHERE length({sql_strip('text') if m in ("passages", "custom_page_ranges") else 'text'}) > 0"""
            for m in ("page", "page_limit", "passages", "custom_page_ranges")
        },
        "semantic_segments_none": f"WITH {_PAGES} SELECT page_id, 1 AS piece, {whole}, {lead} AS start, {stop} AS stop, '' AS kind, 'no_local_segmentation' AS reason FROM pages WHERE length(text) > 0",
    }
