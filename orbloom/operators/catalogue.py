"""Catalogues from HTML listings and JSON metadata, and lists of months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = r'href="([^"]*)"'


def links(pages: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """One row per distinct link of a page."""
    return pages.select(*keys, F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("link")).distinct()


def subdirectories(pages: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """Names of links that end in a slash."""
    return links(pages, html, keys).where(F.col("link").rlike("^[^/?#]+/$")).select(*keys, F.regexp_replace("link", "/$", "").alias("name"))


def months(first: str, last: str) -> Column:
    """All months from 'yyyy-mm' to 'yyyy-mm', as 'yyyy-mm'."""
    return F.transform(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def month_list(df: DataFrame, column: str) -> DataFrame:
    """'yyyy-mm' as it is and 'yyyy' as its twelve months; anything else goes; distinct and sorted by the caller."""
    year = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.concat(F.col(column), F.lit("-"), F.lpad(k.cast("string"), 2, "0")))
    m = F.when(F.col(column).rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.array(F.col(column))).when(F.col(column).rlike(r"^\d{4}$"), year).otherwise(F.array().cast("array<string>"))
    return df.select(F.explode(m).alias("month")).distinct()


def json_field(column: str, path: str, kind: str = "string") -> Column:
    return F.get_json_object(F.col(column), f"$.{path}").cast(kind)
