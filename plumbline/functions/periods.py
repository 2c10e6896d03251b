"""Quarter keys ``YYYYQn``: they sort as strings and carry an ordinal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a quarter is written in text and in a chunk id.
PERIOD_TOKEN = r"\d{4}Q\d"
PERIOD_LOOSE = r"(\d{4})\s*[Qq]\s*([1-4])"
CHUNK_ID = r"\d{4}Q\d-P\d+"


def period_of(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def period_ord(period: Column) -> Column:
    """``year * 10 + quarter``."""
    return F.substring(period, 1, 4).cast("int") * 10 + F.substring(period, 6, 1).cast("int")


def page_id(period: Column, page_no: Column) -> Column:
    """``2025Q4-P09``: two digits at least, more when the page number needs them."""
    number = page_no.cast("string")
    return F.concat(period, F.lit("-P"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0")))


def periods_in(text: Column) -> Column:
    """Explicit quarters in a text, normalised, distinct and sorted."""
    raw = F.regexp_extract_all(text, F.lit(PERIOD_LOOSE), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(raw, lambda m: F.upper(F.regexp_replace(m, r"\s", "")))))
