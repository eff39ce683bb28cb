"""Filters, search, facets, pages and plain counts over a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.designation import citation_digits
from ..functions.text import non_blank, shown

MOST = 500
#: Characters of a request's text and bytes of an uploaded file at most.
CHARACTERS, UPLOAD = 400_000, 25 << 20


def equal_filters(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows that equal all given values; an empty or absent value is no filter."""
    live = [F.col(c) == v for c, v in filters.items() if v not in (None, "")]
    return df.where(reduce(lambda a, b: a & b, live)) if live else df


def search(df: DataFrame, q: str, columns: list[str], digits: str | None = None) -> DataFrame:
    """Rows with q in one of the columns, case-insensitively, or whose number is the number that q cites. % and _ in q are plain."""
    if not q:
        return df
    hits = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.lower())) for c in map(F.col, columns)]
    if digits:
        number = citation_digits(F.lit(q))
        hits.append((number != "") & (F.col(digits) == number))
    return df.where(reduce(lambda a, b: a | b, hits))


def page(df: DataFrame, order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page, with limits checked; order must be total."""
    if not 1 <= limit <= MOST or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST} and offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def checked_request(text: str = "", content: bytes = b"") -> None:
    """Refuse a request whose text or file is too large; nothing is cut."""
    if len(text) > CHARACTERS:
        raise ValueError(f"a text may have {CHARACTERS} characters at most")
    if len(content) > UPLOAD:
        raise ValueError(f"a file may have {UPLOAD} bytes at most")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): the distinct non-blank values of each column, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("f")).select("f.facet", "f.value").where(non_blank(F.col("value"))).distinct()


def count_by(df: DataFrame, column: str) -> DataFrame:
    """(value, n), null as N/A."""
    return df.groupBy(shown(F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def decades(df: DataFrame, year: str) -> DataFrame:
    """(decade, n); a year that is no number falls under Unknown."""
    y = F.try_to_number(F.substring_index(F.col(year).cast("string"), ".", 1), F.lit("9999")).cast("int")
    d = F.coalesce((F.floor(y / 10) * 10).cast("string"), F.lit("Unknown"))
    return df.groupBy(d.alias("decade")).agg(F.count(F.lit(1)).alias("n"))
