"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_name(name: Column, keep: str = "") -> Column:
    """Lower case, everything but ASCII letters, digits and `keep` to spaces, one space at most, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), f"[^a-z0-9{keep}]", " "), " +", " "))


def fuzzy_process(text: Column) -> Column:
    """Lower case, all but letters, digits and underscores to spaces, one space at most, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", " "), " +", " "))


def natural_key(text: Column, width: int = 20) -> Column:
    """A key that sorts digit runs by value: each run is preceded by its zero-padded form."""
    runs = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    gaps = F.split(text, r"\d+", -1)
    padded = F.transform(runs, lambda r: F.lpad(r, width, "0"))
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(padded, i), F.lit("")))), "")


def sanitize_xml(text: Column) -> Column:
    """Characters that XML 1.0 forbids become `?`."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uD800-\\uDFFF\\uFFFE\\uFFFF]", "?")


def context(text: Column, start: Column, end: Column, skip: int = 0) -> tuple[Column, Column]:
    """What stands before start and from end + skip on."""
    return F.substring(text, F.lit(1), start), F.substring(text, end + 1 + skip, F.length(text))
