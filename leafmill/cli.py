"""`python -m leafmill.cli extract|segment PAGES OUT`: page rows to extracts or numbered segments, with their reports.

PAGES is a Parquet table of page rows (document_id, page, kind, text), or with `--decoder` a folder of
documents, whose paths become the document ids.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import match, segment
from leafmill.session import session, tidy
from leafmill.sources import files, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill")
    p.add_argument("command", choices=["extract", "segment"])
    p.add_argument("pages")
    p.add_argument("out")
    p.add_argument("--decoder", choices=sorted(files.DECODERS))
    p.add_argument("--pattern", default="*.pdf")
    p.add_argument("--label")
    p.add_argument("--start-page", type=int, default=1)
    p.add_argument("--stop-after-page", type=int, default=0)
    p.add_argument("--stop-heading", action="append", default=[])
    p.add_argument("--auto-detect-end-sections", action="store_true")
    p.add_argument("--segment-chars", type=int, default=650)
    p.add_argument("--min-boundary-chars", type=int, default=250)
    p.add_argument("--min-page-chars", type=int, default=40)
    p.add_argument("--validation-phrase", action="append", default=[])
    return p


def _pages(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if not a.decoder:
        p = spark.read.parquet(a.pages)
    else:
        found = files.discover(spark, a.pages, a.pattern) if a.decoder != "plain" else spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", a.pattern).load(a.pages)
        p = files.decode_pages(found, a.decoder).withColumnRenamed("document_path", "document_id").withColumn("backend", F.lit(a.decoder))
    return p.withColumn("label", X.clean_label(F.lit(a.label))) if a.label else p


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    p = _pages(spark, a)
    with tidy(spark):
        if a.command == "extract":
            sinks.extract_text(p, f"{a.out}/extract")
            sinks.page_report_csv(p, f"{a.out}/report")
            return
        headings = tuple(a.stop_heading) or X.END_HEADINGS
        stop_after = a.stop_after_page if a.stop_heading else 0
        if a.auto_detect_end_sections:
            # the first end section of each document stops it: pages from there on are left out, its own is reported
            ends = segment.end_sections(p, headings).select("document_id", F.col("page").alias("end_page"))
            p = p.join(ends, "document_id", "left").where(F.col("end_page").isNull() | (F.col("page") < F.col("end_page"))).drop("end_page")
        records, report = segment.document_segments(p, a.start_page, stop_after, a.min_page_chars, headings, a.segment_chars, a.min_boundary_chars)
        sinks.segmented_text(records, f"{a.out}/segments")
        sinks.segment_report_csv(report, f"{a.out}/report")
        if a.validation_phrase:
            phrases = records.select("document_id").distinct().select(F.lit(0).alias("request_id"), "document_id", F.explode(F.array(*[F.lit(x) for x in a.validation_phrase])).alias("phrase"))
            whole = records.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("segment_id", "record")))["record"], "\n\n").alias("text"))
            sinks.rows_csv(match.phrase_validation(phrases, whole).drop("request_id"), f"{a.out}/validation")


def main() -> None:
    import sys

    run(session("leafmill"), sys.argv[1:])


if __name__ == "__main__":
    main()
