"""Tables and prose in HTML: rows, cells, carry-down of group headings, standards named in sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_text


def table_rows(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, pos, cells): the rows of all tables in page order, cells as plain text."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    r = pages.select(page_id, F.posexplode(rows).alias("pos", "row"))
    cells = F.regexp_extract_all(F.col("row"), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1))
    return r.select(page_id, "pos", F.transform(cells, plain_text).alias("cells"))


def carry_down(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Nulls filled with the last value above, in each group."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def prose_standards(text: Column, keyword: str) -> Column:
    """Distinct designations in the sentences that hold a keyword, in order."""
    sentences = F.filter(F.split(text, r"(?<=[.;])\s+"), lambda s: s.rlike(f"(?i){keyword}"))
    found = F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(r"(?<![A-Za-z])(IS\s*:?\s*\d{2,})"), F.lit(1))))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^IS\s*:?\s*", "IS ")))
