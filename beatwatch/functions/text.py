"""Text clean-up and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_empty(c: Column | str) -> Column:
    """Empty text becomes null; blanks are kept as they are."""
    return F.nullif(_col(c), F.lit(""))


def is_present(c: Column | str) -> Column:
    """True when the text is neither null nor empty; blanks count as present."""
    return F.coalesce(_col(c) != "", F.lit(False))


def truthy(c: Column | str) -> Column:
    """true / yes / 1 in any case, with blanks around; null stays null."""
    return F.lower(F.trim(_col(c))).isin("true", "yes", "1")


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or null."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def pad_left(c: Column | str, width: int, fill: str = "0") -> Column:
    """Pad short text; longer text is kept whole (``lpad`` alone would cut it)."""
    c = _col(c)
    return F.when(F.length(c) < width, F.lpad(c, width, fill)).otherwise(c)


def district_key(c: Column | str) -> Column:
    """'11', '011', ' 0011 ' -> '011'."""
    return pad_left(F.regexp_replace(F.trim(_col(c)), "^0+", ""), 3)


def district_number(c: Column | str) -> Column:
    """Integer district, null when the text is not a number."""
    return _col(c).try_cast("int")


def first_items(c: Column | str, n: int = 3, sep: str = ", ") -> Column:
    """The first n entries of a separated list."""
    return F.concat_ws(sep, F.slice(F.split(_col(c), sep), 1, n))


def short_id(c: Column | str, n: int = 10) -> Column:
    return F.substring(_col(c), 1, n)
