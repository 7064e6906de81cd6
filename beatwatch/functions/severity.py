"""Severity 1 (low) to 5 (critical), one rule set per dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatwatch.functions.text import _col

# Severity tables of the public-safety datasets.
VIOLENCE_TERMS = {
    5: ("fatality", "fatal", "homicide"),
    4: ("shooting", "gunshot"),
    3: ("head", "brain", "chest"),
    2: ("leg", "arm"),
}
CRIME_TYPES = {
    5: ("HOMICIDE",),
    4: (
        "ASSAULT",
        "BATTERY",
        "ROBBERY",
        "ARSON",
        "KIDNAPPING",
        "CRIMINAL SEXUAL ASSAULT",
        "HUMAN TRAFFICKING",
    ),
    3: (
        "THEFT",
        "BURGLARY",
        "MOTOR VEHICLE THEFT",
        "STALKING",
        "INTIMIDATION",
        "SEX OFFENSE",
        "CRIM SEXUAL ASSAULT",
    ),
    2: (
        "DECEPTIVE PRACTICE",
        "FRAUD",
        "FORGERY",
        "NARCOTICS",
        "WEAPONS VIOLATION",
        "CONCEALED CARRY LICENSE VIOLATION",
    ),
}
CHARGE_CLASSES = {5: ("X",), 4: ("1", "2"), 3: ("3", "4"), 2: ("A",)}
ALERT_FROM = 3
CRITICAL_FROM = 4


def _ladder(rungs: list[tuple[Column, int]], default: int) -> Column:
    """CASE over (condition, value) in order; a null condition falls through."""
    first, *rest = rungs
    chain = reduce(lambda acc, r: acc.when(r[0], F.lit(r[1])), rest, F.when(first[0], F.lit(first[1])))
    return chain.otherwise(F.lit(default))


def severity_violence(gunshot: Column | str, victimization: Column | str) -> Column:
    """A confirmed gunshot is 4 whatever the text says; else the first term found decides."""
    text = F.lower(_col(victimization))
    terms = [(reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in ts]), s) for s, ts in VIOLENCE_TERMS.items()]
    return _ladder([(F.upper(F.trim(_col(gunshot))) == "YES", 4), *terms], 1)


def severity_crime(primary_type: Column | str) -> Column:
    text = F.upper(_col(primary_type))
    return _ladder([(text.isin(*types), s) for s, types in CRIME_TYPES.items()], 1)


def severity_arrest(charge_class: Column | str) -> Column:
    text = F.upper(F.trim(_col(charge_class)))
    return _ladder([(text.isin(*classes), s) for s, classes in CHARGE_CLASSES.items()], 1)


def severity_offender(victim_minor: Column | str) -> Column:
    return _ladder([(F.upper(F.trim(_col(victim_minor))) == "Y", 5)], 3)
