"""Titles and number formats of the printed reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def titled(name: Column) -> Column:
    """Fund code as a title: only the first underscore becomes a blank."""
    return F.initcap(F.regexp_replace(name, "^([^_]*)_", "$1 "))


def header(name: str) -> str:
    return name.replace("_", " ").title()


def as_number(value: Column, decimals: int = 2) -> Column:
    """Fixed decimals with thousands separators, rounded half away from zero as written; a tiny negative keeps its sign.

    Rounded before it is formatted: the format alone rounds the binary value, which turns 12.345 into 12.34.
    """
    rounded = F.round(value, decimals)
    signed = F.when((value < 0) & (rounded == 0), F.lit(-0.0)).otherwise(rounded)
    return F.format_number(signed, decimals)


def as_percent(value: Column, decimals: int = 2) -> Column:
    return F.concat(as_number(value * 100.0, decimals), F.lit("%"))
