"""Titles, links and hosts of pages by JVM expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TITLE = r"<title>([^<]*)</title>"
LINK = r'<a href="([^"]*)"'


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.trim(F.regexp_extract("html", TITLE, 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"<p>"), F.lit(0))).cast("long").alias("n_paragraphs"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, position, href: each page's links, the first of those that are equal."""
    each = pages.select("page_id", F.posexplode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("position", "href"))
    return each.select("page_id", (F.col("position") + 1).cast("long").alias("position"), "href")
