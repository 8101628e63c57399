"""Scalar functions with the source dialect's semantics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8

# strftime codes and their Java pattern letters (fixed values)
DATE_CODES = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%F": "yyyy-MM-dd",
}


def java_format(fmt: str) -> str:
    for code, letters in DATE_CODES.items():
        fmt = fmt.replace(code, letters)
    return fmt


def parse_date_safe(fmt: str, text: Column) -> Column:
    return F.try_to_date(text, java_format(fmt))


def net_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def net_scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)


def reg_domain(url: Column) -> Column:
    """Last two labels of the host (no public-suffix list)."""
    return F.regexp_extract(net_host(url), r"([^.]+\.[^.]+)$", 1)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def count_coerce(text: Column) -> Column:
    """Whole numbers and digit strings from zero up; anything else is unknown."""
    n = text.try_cast("long")
    return F.when(text.rlike(r"^\d+$") & (n >= 0), n)


def leaf_segment(path: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit(sep)), sep), -1)


def segment_after(path: Column, name: str) -> Column:
    """Part after a named segment; empty text when it is absent."""
    return F.regexp_extract(path, rf"(?:^|/){name}/([^/?#]+)", 1)
