"""Dates found in headings and names, and stamps of a given moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

DATE = r"(\d{4})-(\d{2})-(\d{2})([a-z])?"


def first_date(text: str | Column) -> Column:
    """The date in the first line, null for none or an impossible one."""
    return F.try_to_date(F.nullif(F.regexp_extract(F.split(col(text), "\n", 2)[0], r"\d{4}-\d{2}-\d{2}", 0), F.lit("")), "yyyy-MM-dd")


def section_key(text: str | Column) -> Column:
    """struct(date text, suffix letter) of a section's heading; null if it has no date."""
    head = F.split(col(text), "\n", 2)[0]
    found = F.regexp_extract(head, DATE, 0)
    return F.when(found != "", F.struct(F.substring(found, 1, 10).alias("d"), F.regexp_extract(head, DATE, 4).alias("s")))


def days_before(date: str | Column, today: str) -> Column:
    return F.datediff(F.lit(today).cast("date"), col(date))


def day_of(epoch: str | Column) -> Column:
    return F.to_date(F.timestamp_seconds(col(epoch)))
