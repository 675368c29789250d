"""Column functions on names and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ACCENTS, PLAIN = "ãáàâäéêèëíîìïóôõòöúûùüçñ", "aaaaaeeeeiiiiooooouuuucn"


def fold_accents(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTS, PLAIN)


def parse_timestamp(c: Column) -> Column:
    """A time from text of which the first 19 characters count; null if they are none."""
    return F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))


def middle_name(c: Column) -> Column:
    """A column's name without its first and last part between underscores."""
    return F.regexp_extract(c, r"^[^_]*_(.*)_[^_]*$", 1)
