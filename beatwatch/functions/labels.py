"""Display labels and colour bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatwatch.functions.text import _col, is_present

# Display labels.
SEVERITY_LABELS = {5: "CRITICAL", 4: "HIGH", 3: "MEDIUM", 2: "LOW", 1: "INFO"}
DATASET_LABELS = {
    "crimes": "CRIMES",
    "violence": "VIOLENCE",
    "arrests": "ARRESTS",
    "sex-offenders": "SEX OFFENDERS",
}


def _lookup(values: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def severity_label(c: Column | str) -> Column:
    """CRITICAL..INFO; null and unknown levels are INFO."""
    return F.coalesce(_lookup(SEVERITY_LABELS, _col(c)), F.lit("INFO"))


def dataset_label(c: Column | str) -> Column:
    """Known label, else the upper-cased name, else UNKNOWN."""
    c = _col(c)
    return F.coalesce(_lookup(DATASET_LABELS, c), F.upper(c), F.lit("UNKNOWN"))


def severity_band(avg: Column | str) -> Column:
    avg = _col(avg)
    return F.when(avg >= 4.5, "red").when(avg >= 4.0, "orange").when(avg >= 3.0, "yellow").otherwise("cyan")


def rate_band(rate: Column | str) -> Column:
    rate = _col(rate)
    return F.when(rate > 0.5, "red").when(rate > 0.25, "yellow").otherwise("green")


def event_label(crime_type: Column | str, injury_type: Column | str) -> Column:
    """Crime type when it is not empty, else the injury type."""
    crime_type = _col(crime_type)
    return F.when(is_present(crime_type), crime_type).otherwise(_col(injury_type))


def display_label(label: Column | str, crime_type: Column | str, injury_type: Column | str) -> Column:
    return F.coalesce(_col(label), _col(crime_type), _col(injury_type))


def district_label(c: Column | str) -> Column:
    return F.concat(F.lit("D"), _col(c).cast("string"))
