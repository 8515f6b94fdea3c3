"""Readers of files: documents, JSON lines, results, settings, model descriptions and the page cache."""

from __future__ import annotations

import importlib
import multiprocessing
import sqlite3
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import is_embedding_name
from leafmill.session import written

PAGE = "document_path string, page int, kind string, text string"
#: Decoders by name: bytes of a document -> text of its pages.
DECODERS: dict[str, Callable[[bytes], list[str]]] = {}


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf", most_bytes: int | None = None) -> DataFrame:
    """(path, length, content) of documents under a folder whose content begins like a PDF."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    if most_bytes is not None:
        f = f.where(F.col("length") <= most_bytes)  # pushed down to the listing
    return f.select("path", "length", "content").where(F.substring("content", 1, 4) == F.lit(b"%PDF"))


def hashed(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of each file."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def _pymupdf(data: bytes) -> list[str]:
    fitz = importlib.import_module("fitz")
    with fitz.open(stream=data, filetype="pdf") as doc:
        return [p.get_text("text") for p in doc]


def _plain(data: bytes) -> list[str]:
    return data.decode("utf-8", "replace").split("\f")


DECODERS |= {"pymupdf": _pymupdf, "plain": _plain}


def decode_pages(files: DataFrame, decoder: str, kind: str = "page") -> DataFrame:
    """(document_path, page, kind, text): one row per page, from 1, by a registered decoder.

    One document at a time is held in a worker. An unknown decoder, or one whose library is missing,
    raises before anything runs.
    """
    if decoder not in DECODERS:
        raise ValueError(f"unknown decoder {decoder!r}")
    if decoder == "pymupdf" and importlib.util.find_spec("fitz") is None:
        raise ModuleNotFoundError("fitz is needed to decode PDF files")
    decode = DECODERS[decoder]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                texts = decode(content)
                yield pd.DataFrame({"document_path": path, "page": range(1, len(texts) + 1), "kind": kind, "text": texts})

    return files.select("path", "content").mapInPandas(run, PAGE)


#: Decoders of single pages by name: bytes of a page -> its text. A caller registers what reads its images.
PAGE_DECODERS: dict[str, Callable[[bytes], str]] = {"plain": lambda data: data.decode("utf-8")}


def within(seconds: float, call: Callable[[bytes], str], data: bytes) -> str:
    """`call(data)` in a process of its own, which is ended when the time is over; errors come back as they are told there.

    A process can be ended even where native code hangs, which a thread can't.
    """
    here, there = multiprocessing.Pipe(duplex=False)

    def work() -> None:
        try:
            there.send((True, call(data)))
        except BaseException as problem:  # noqa: BLE001 - whatever it is, it belongs to this page
            there.send((False, f"{type(problem).__name__}: {problem}"))

    child = multiprocessing.get_context("fork").Process(target=work, daemon=True)
    child.start()
    there.close()
    try:
        if not here.poll(seconds):
            raise TimeoutError(f"timed out after {seconds:g} s")
        good, value = here.recv()
    except EOFError:
        raise RuntimeError("the decoder's process ended without a result") from None
    finally:
        child.kill()
        child.join()
    if not good:
        raise RuntimeError(value)
    return value


def decode_single_pages(pages: DataFrame, decoder: str, seconds: float = 240.0, kind: str = "markdown_page") -> DataFrame:
    """(document_path, page, kind, text, problem): pages that arrive one a row (document_path, page, content), each decoded under a deadline.

    Pages are spread over all tasks, whatever document they belong to. A page that fails or isn't done
    in `seconds` has a null text and a `problem`.
    """
    if decoder not in PAGE_DECODERS:
        raise ValueError(f"unknown page decoder {decoder!r}")
    decode = PAGE_DECODERS[decoder]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, page, content in zip(b["document_path"], b["page"], b["content"]):
                text, problem = None, None
                try:
                    text = within(seconds, decode, bytes(content))
                except (TimeoutError, RuntimeError) as e:
                    problem = f"page {page}: {e}"
                rows.append((path, page, kind, text, problem))
            yield pd.DataFrame(rows, columns=["document_path", "page", "kind", "text", "problem"])

    return pages.select("document_path", F.col("page").cast("int").alias("page"), "content").mapInPandas(run, f"{PAGE}, problem string")


def decode_documents(files: DataFrame, pages: DataFrame, decoder: str, fallback: str | None = None, seconds: float = 240.0) -> DataFrame:
    """(document_path, page, kind, text, mode, reason): whole documents only, by single pages or else as a whole.

    A document of which a page fails, or whose pages aren't exactly 1..n, is decoded anew as a whole by
    the `fallback` decoder from `files` (path, content): nothing partly observed is kept. Without a
    fallback it has one row with null page and text. `mode` tells what really ran and `reason` why.
    """
    tried = written(decode_single_pages(pages, decoder, seconds), "decoded-pages")
    failed = tried.groupBy("document_path").agg(F.min("problem").alias("reason")).where(F.col("reason").isNotNull())
    uncovered = assert_coverage(tried).select("document_path", F.concat(F.lit("pages observed: "), F.col("n_pages").cast("string"), F.lit(", last "), F.col("last_page").cast("string")).alias("uncovered"))
    bad = written(failed.join(uncovered, "document_path", "full").select("document_path", F.coalesce("reason", "uncovered").alias("reason")), "undecoded-documents")
    whole = tried.join(bad, "document_path", "left_anti").select("document_path", "page", "kind", "text", F.lit("isolated_parallel_pages").alias("mode"), F.lit("").alias("reason"))
    if fallback is None:
        nothing = F.lit(None)
        return whole.unionByName(bad.select("document_path", nothing.cast("int").alias("page"), nothing.cast("string").alias("kind"), nothing.cast("string").alias("text"), F.lit("failed").alias("mode"), "reason"))
    again = decode_pages(files.join(bad.select(F.col("document_path").alias("path")), "path", "left_semi"), fallback)
    return whole.unionByName(again.join(bad, "document_path").select("document_path", "page", "kind", "text", F.lit("sequential_after_parallel_fallback").alias("mode"), "reason"))


def assert_coverage(pages: DataFrame, key: str = "document_path") -> DataFrame:
    """Documents whose pages aren't exactly 1..n: (key, n_pages, last_page)."""
    g = pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.max("page").alias("last_page"), F.min("page").alias("first"), F.count_if(F.col("page").isNull()).alias("nulls"))
    distinct = pages.groupBy(key, "page").agg(F.count("*").alias("c")).groupBy(key).agg(F.max("c").alias("most"))
    bad = (F.col("n_pages") != F.col("last_page")) | (F.col("first") != 1) | (F.col("most") > 1) | (F.col("nulls") > 0)
    return g.join(distinct, key).where(bad).select(key, "n_pages", "last_page")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, v): the JSON objects among the lines of files; malformed lines and other values are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    return lines.where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", kind)


def progress_events(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, phase, value, type, v): progress events with a positive monotonic time."""
    e = jsonl(spark, path).select("path", _field("recorded_monotonic", "double").alias("at"), _field("phase", "string").alias("phase"), _field("value", "double").alias("value"), _field("type", "string").alias("type"), "v")
    return e.where(F.col("at") > 0)


def progress_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace rows; a missing elapsed time is 0, negative and unreadable ones are left out."""
    t = jsonl(spark, path).select(
        "path", F.when(F.try_variant_get("v", "$.elapsed_seconds", "string").isNull(), 0.0).otherwise(_field("elapsed_seconds", "double")).alias("elapsed"), _field("visible_progress_percent", "double").alias("percent"),
        _field("expected_seconds", "int").alias("expected"), _field("eta_reprice_reason", "string").alias("reason"), _field("progress_phase", "string").alias("phase"), _field("state", "string").alias("state"),
    )
    return t.where(F.col("elapsed") >= 0)


def timeline(events: DataFrame, started: Column) -> DataFrame:
    """Adds `offset`: seconds from the start of an ISO time, not below 0; an unreadable time is the start."""
    at = F.unix_micros(F.try_to_timestamp("recorded_at")) / 1e6
    return events.withColumn("offset", F.greatest(F.lit(0.0), F.coalesce(at - started, F.lit(0.0))))


def results(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Result files, one JSON object each; unreadable ones are left out."""
    r = spark.read.schema(schema.add("_corrupt", "string")).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(pattern)
    return r.withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1)).where(F.col("_corrupt").isNull()).drop("_corrupt")


def manifest_problems(manifest: DataFrame, expected: int = 8) -> DataFrame:
    """(problem): what is wrong with a list of documents; empty if nothing is."""
    g = manifest.agg(
        F.count("*").alias("n"), F.count_distinct("document_id").alias("ids"), F.count_if(~F.coalesce(F.col("document_id").rlike("^B[0-9]{2}$"), F.lit(False))).alias("names"),
        F.count_if(~F.coalesce(F.col("page_count") > 0, F.lit(False))).alias("pages"),
    )
    found = F.array_compact(F.array(F.when(F.col("n") != expected, "count"), F.when(F.col("ids") != F.col("n"), "duplicate_id"), F.when(F.col("names") > 0, "id_format"), F.when(F.col("pages") > 0, "page_count")))
    return g.select(F.explode(found).alias("problem"))


def env_values(lines: DataFrame, first: bool = False) -> DataFrame:
    """(file, key, value) of KEY=value lines: the last assignment of a key counts, or the first.

    `lines` has file, line_no, value. Comments and lines without `=` are passed over; values lose
    single quotes or are read as a JSON string.
    """
    t = F.btrim("value", F.lit(" \t\r\n"))
    rows = lines.select("file", "line_no", t.alias("t")).where(F.contains("t", F.lit("=")) & ~F.startswith("t", F.lit("#")))
    key, raw = F.btrim(F.substring_index("t", "=", 1)), F.btrim(F.expr("substring(t, instr(t, '=') + 1)"))
    rows = rows.select("file", "line_no", key.alias("key"), raw.alias("raw"))
    value = F.when(F.col("raw").rlike("^'.*'$"), F.regexp_replace("raw", "^'|'$", "")).when(
        F.col("raw").rlike('^".*"$'), F.coalesce(F.try_variant_get(F.try_parse_json("raw"), "$", "string"), F.regexp_replace("raw", '^"|"$', ""))
    )
    rows = rows.withColumn("value", F.coalesce(value, "raw"))
    pick = F.min_by if first else F.max_by
    return rows.groupBy("file", "key").agg(pick("value", "line_no").alias("value"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): whole files split by lines, so that numbers count from 1 in every file."""
    f = spark.read.text(path, wholetext=True)
    lines = f.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r\n|\n", -1)).alias("n", "value"))
    return lines.select("file", (F.col("n") + 1).alias("line_no"), "value")


def env_lines(spark: SparkSession, *paths: str, most_bytes: int = 1 << 20) -> DataFrame:
    """(file, line_no, value) of small settings files on the driver; Spark's own readers pass over names like `.env`."""
    rows = []
    for p in paths:
        with open(p, encoding="utf-8") as f:
            text = f.read(most_bytes + 1)
        if len(text) > most_bytes:
            raise ValueError(f"{p} is too large for a settings file")
        rows += [(p, n, line) for n, line in enumerate(text.splitlines(), 1)]
    return spark.createDataFrame(rows, "file string, line_no int, value string")


def parse_model_show(text: Column) -> dict[str, Column]:
    """Typed facts out of a model's printed description."""
    number = lambda label: F.nullif(F.regexp_extract(text, rf"(?im)^[ \t]*{label}[ \t]+([0-9]+)", 1), F.lit("")).try_cast("int")
    block = F.regexp_extract(text, r"(?im)^[ \t]*Capabilities[ \t]*\n((?:[ \t]+[^\n]+\n?)+)", 1)
    return {
        "architecture": F.nullif(F.regexp_extract(text, r"(?im)^[ \t]*architecture[ \t]+([^ \t\r\n]+)", 1), F.lit("")),
        "context_length": number("context length"),
        "embedding_length": number("embedding length"),
        "capabilities": F.filter(F.transform(F.split(block, "\n"), lambda x: F.btrim(x)), lambda x: x != ""),
    }


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, column_name) of the session's catalog; as many rows as there are columns."""
    rows = [(t.name, c.name) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(f"{database}.{t.name}" if database and not t.isTemporary else t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def missing_columns(found: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(table_name, column_name) that are required and not there."""
    want = found.sparkSession.createDataFrame([(t, c) for t, cs in required.items() for c in cs], "table_name string, column_name string")
    return want.join(found, ["table_name", "column_name"], "left_anti")


def cache_identity(parts: dict[str, Column]) -> Column:
    """SHA-256 over canonical JSON: keys sorted, no blanks; the same facts have the same identity."""
    fields = F.struct(*[c.alias(k) for k, c in sorted(parts.items())])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def cached_pages(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): cached page rows whose identity matches and whose pages are exactly 1..n, and identities without."""
    whole = cache.groupBy("identity").agg(F.count("*").alias("n"), F.count_distinct("page").alias("k"), F.max("page").alias("z"), F.min("page").alias("a"))
    good = whole.where((F.col("n") == F.col("k")) & (F.col("n") == F.col("z")) & (F.col("a") == 1)).select("identity")
    w = wanted.select("identity").distinct()
    return cache.join(good, "identity", "left_semi").join(w, "identity", "left_semi"), w.join(good, "identity", "left_anti")


def sqlite_settings(spark: SparkSession, path: str, table: str = "system_settings", most: int = 1_000_000) -> DataFrame:
    """(label, value) of a small local settings database, opened read-only on the driver; a missing table gives no row.

    Settings are a handful; a table of more than `most` rows isn't one and is refused (read it by JDBC).
    """
    if not table.isidentifier():
        raise ValueError(f"{table!r} is no table name")
    rows: list[tuple] = []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        if db.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", (table,)).fetchone():
            rows = db.execute(f"SELECT CAST(label AS TEXT), CAST(value AS TEXT) FROM {table} LIMIT ?", (most + 1,)).fetchall()
    if len(rows) > most:
        raise ValueError(f"{table} of {path} is too large for settings")
    return spark.createDataFrame(rows, "label string, value string")


def sqlite_columns(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, column_name) of a local database, for `missing_columns`."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute("SELECT m.name, c.name FROM sqlite_master m, pragma_table_info(m.name) c WHERE m.type = 'table'").fetchall()
    return spark.createDataFrame(rows, "table_name string, column_name string")


def fetched_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, context_length, provider_context_length, embedding_length) of catalog files fetched before; what can't be read gives no row.

    Each file holds a JSON list of models, or an object with such a list as `data`.
    """
    model = "struct<id:string,canonical_slug:string,name:string,context_length:bigint,top_provider:struct<context_length:bigint>,architecture:struct<embedding_length:bigint>>"
    try:
        f = spark.read.text(path, wholetext=True)
    except AnalysisException:
        f = spark.createDataFrame([], "value string")
    listed = F.when(F.btrim("value").startswith("["), F.from_json("value", f"array<{model}>")).otherwise(F.from_json("value", f"struct<data:array<{model}>>")["data"])
    m = f.select(F.explode(listed).alias("m")).select(F.coalesce(F.nullif(F.btrim("m.id"), F.lit("")), F.nullif(F.btrim("m.canonical_slug"), F.lit(""))).alias("id"), "m.name", "m.context_length", F.col("m.top_provider.context_length").alias("provider_context_length"), "m.architecture.embedding_length")
    return m.where(F.col("id").isNotNull())


def embedding_models(models: DataFrame, name: str = "name") -> DataFrame:
    """The models of a list whose names are those of embedding models."""
    return models.where(is_embedding_name(F.col(name)))
