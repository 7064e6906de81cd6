"""Date and time parsing that returns null on bad text instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatwatch.functions.text import _col, is_present

# The datasets' date formats.
MERIDIEM_FORMAT = "MM/dd/yyyy hh:mm:ss a"
CLOCK_FORMATS = ("MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm")
DATE_FORMAT = "MM/dd/yyyy"
UNKNOWN_DATE = "unknown"


def parse_time(c: Column | str, fmt: str = MERIDIEM_FORMAT) -> Column:
    return F.try_to_timestamp(_col(c), F.lit(fmt))


def split_date(c: Column | str) -> Column:
    """Date part: text before the first space; 'unknown' when null or empty."""
    c = _col(c)
    return F.when(is_present(c), F.substring_index(F.trim(c), " ", 1)).otherwise(F.lit(UNKNOWN_DATE))


def split_time(c: Column | str, clock: str = "as_is") -> Column:
    """Time part, null when there is none.

    ``as_is`` keeps the digits and drops a trailing AM/PM, as the published feed does.
    ``24h`` turns a full ``hh:mm:ss AM/PM`` into a 24-hour clock and falls back to ``as_is``.
    """
    c = F.trim(_col(c))
    space = F.instr(c, " ")
    rest = F.ltrim(F.substring(c, space + 1, F.length(c)))
    as_is = F.when(space > 0, F.substring_index(rest, " ", 1))
    if clock == "as_is":
        return as_is
    if clock != "24h":
        raise ValueError("clock is 'as_is' or '24h'")
    return F.coalesce(F.date_format(parse_time(c), "HH:mm:ss"), as_is)


def event_time(date: Column | str, time: Column | str, ingested: Column | str) -> Column:
    """First that parses: date with time, date alone, ingest time."""
    date, time = _col(date), _col(time)
    stamp = F.concat(date, F.lit(" "), time)
    tries = [F.try_to_timestamp(stamp, F.lit(f)) for f in CLOCK_FORMATS]
    return F.coalesce(*tries, F.try_to_timestamp(date, F.lit(DATE_FORMAT)), _col(ingested).cast("timestamp"))


def lag_ms(later: Column | str, earlier: Column | str, exact: bool = False) -> Column:
    """Lag in milliseconds; whole seconds unless ``exact``."""
    later, earlier = _col(later), _col(earlier)
    if exact:
        return F.unix_millis(later) - F.unix_millis(earlier)
    return (later.cast("long") - earlier.cast("long")) * F.lit(1000).cast("long")


def hour_label(c: Column | str) -> Column:
    return F.date_format(_col(c), "HH:00")
