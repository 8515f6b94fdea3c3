"""Table functions for SQL: `SELECT p.id, s.* FROM pages p, LATERAL split_page(p.text, 400, 900, 'page_limit') s`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="piece int, segment string, start int, stop int, kind string, reason string")
class SplitPage:
    """Scored page-local segments of one text."""

    def eval(self, text: str, target: int, hard: int, mode: str):
        from leafmill.operators.segment import semantic

        for n, s in enumerate(semantic(text or "", target, hard, mode.strip().casefold()), 1):
            yield n, s.text, s.start, s.stop, s.kind, s.reason


@udtf(returnType="piece int, segment string")
class SplitText:
    """Greedy pieces of one normalised text."""

    def eval(self, text: str, most: int, least: int):
        from leafmill.operators.segment import greedy

        yield from enumerate(greedy(text or "", most, least), 1)


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_page", SplitPage)
    spark.udtf.register("split_text", SplitText)
