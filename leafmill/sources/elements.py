"""Layout elements and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X


def line_elements(pages: DataFrame) -> DataFrame:
    """(document_id, page, element_index, category, text, chars, preview): each line of a page as an element."""
    lines = pages.select("document_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("text", X.strip(F.col("line")))
    category = F.when(F.col("text").rlike("^#"), "Title").when(F.col("text").rlike(rf"^(?:[-*•]|[0-9]+[.)])[{X.SPACE}]"), "ListItem").otherwise("NarrativeText")
    return lines.select("document_id", "page", (F.col("i") + 1).alias("element_index"), category.alias("category"), "text", F.length("text").alias("chars"), F.left(X.normalize(F.col("text")), F.lit(250)).alias("preview"))


def elements_to_pages(elements: DataFrame) -> DataFrame:
    """(document_id, page, text): `[Category] text` of a page's elements in order, parted by blank lines; blank ones add nothing."""
    e = elements.where(F.length(X.strip(F.col("text"))) > 0)
    item = F.struct("element_index", F.concat(F.lit("["), "category", F.lit("] "), X.strip(F.col("text"))).alias("t"))
    return e.groupBy("document_id", "page").agg(F.array_join(F.array_sort(F.collect_list(item))["t"], "\n\n").alias("text"))
