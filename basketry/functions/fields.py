"""Column expressions that turn one product-dump record (a string) into typed fields.

Every function returns a ``Column`` built from Spark built-ins (``regexp_extract``, ``split``, ``transform``,
``try_cast``), so extraction stays inside whole-stage codegen and needs no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line labels and layouts of the product dump format. They must match the input text
# exactly, including the dump's own spelling "cutomer" on review lines. Multi-line mode anchors each label
# at the start of its line, so a label word inside a title or category path never starts a field.
ID_PATTERN = r"^Id:\s*(\d+)"
ASIN_PATTERN = r"(?m)^[ \t]*ASIN:[ \t]*(\w+)"
TITLE_PATTERN = r"(?m)^[ \t]*title:[ \t]*(.*)"
GROUP_PATTERN = r"(?m)^[ \t]*group:[ \t]*(.*)"
SALESRANK_PATTERN = r"(?m)^[ \t]*salesrank:[ \t]*(\d+)"
SIMILAR_PATTERN = r"(?m)^[ \t]*similar:[ \t]*\d+((?:[ \t]+\w+)*)"
CATEGORIES_PATTERN = r"(?m)^[ \t]*categories:[ \t]*\d+[ \t]*\r?$((?:\r?\n[ \t]*\|[^\r\n]*)*)"
TOTAL_REVIEWS_PATTERN = r"(?m)^[ \t]*reviews:[ \t]*total:[ \t]*(\d+)"
AVG_RATING_PATTERN = r"(?m)^[ \t]*reviews:.*avg rating:[ \t]*(\d+(?:\.\d+)?)"
REVIEW_PATTERN = (
    r"(?m)^[ \t]*(\d{4}-\d{1,2}-\d{1,2})[ \t]+cutomer:[ \t]*(\S+)[ \t]+rating:[ \t]*(\d+)"
    r"[ \t]+votes:[ \t]*(\d+)[ \t]+helpful:[ \t]*(\d+)"
)
N_CATEGORY_COLUMNS = 6


def strip(c: Column) -> Column:
    """Trim all surrounding whitespace, ``\r`` and tabs included (``trim`` removes only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extract(value: Column, pattern: str) -> Column:
    """First group of ``pattern``, trimmed; null when the field is absent (``regexp_extract`` gives '')."""
    return F.nullif(strip(F.regexp_extract(value, pattern, 1)), F.lit(""))


def non_empty(arr: Column) -> Column:
    return F.filter(arr, lambda x: x != F.lit(""))


def similars(value: Column) -> Column:
    """The similar-product ids as an array; no similars gives an empty array, never ``['']``."""
    return non_empty(F.split(strip(F.regexp_extract(value, SIMILAR_PATTERN, 1)), r"\s+"))


def categories(value: Column) -> Column:
    """Category paths, one per line of the categories block, trimmed; empty block gives an empty array."""
    block = F.regexp_extract(value, CATEGORIES_PATTERN, 1)
    return non_empty(F.transform(F.split(block, r"\n"), strip))


def category_columns(arr: Column, n: int = N_CATEGORY_COLUMNS) -> list[Column]:
    """``category_1 .. category_n``: null past the end of the array (``get`` never raises under ANSI)."""
    return [F.get(arr, i).alias(f"category_{i + 1}") for i in range(n)]


def review_lines(value: Column) -> Column:
    """Every review line of a record, found in one pass over the record."""
    return F.regexp_extract_all(value, F.lit(REVIEW_PATTERN), 0)


def review_fields(line: Column) -> list[Column]:
    """``date, customer, rating, votes, helpful`` of one review line.

    The line has already matched ``REVIEW_PATTERN``, so after its leading blanks it is exactly
    ``date cutomer: C rating: R votes: V helpful: H`` separated by blanks: one split reads every field.
    """
    parts = F.split(F.btrim(line, F.lit(" \t")), r"[ \t]+")
    return [
        F.try_to_date(F.get(parts, 0)).alias("date"),
        F.get(parts, 2).alias("customer"),
        F.get(parts, 4).try_cast("int").alias("rating"),
        F.get(parts, 6).try_cast("int").alias("votes"),
        F.get(parts, 8).try_cast("int").alias("helpful"),
    ]


def reviews(value: Column) -> Column:
    """All review lines of a record as ``array<struct<date, customer, rating, votes, helpful>>``.

    Linear in the record: the lines are found once and each element is parsed from its own line (a lambda
    reading the whole record per element would rescan it once per review).
    """
    return F.transform(review_lines(value), lambda line: F.struct(*review_fields(line)))
