"""How far an estimate can be trusted, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Drift in milliseconds below which an estimate is good or fair, and beyond which it is an outlier.
HIGH, MEDIUM = 50, 500


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drift(start, end) -> Column:
    return F.abs(_col(start) - _col(end))


def confidence(start, end) -> Column:
    """high, medium or low; low if either delay is missing."""
    d = drift(start, end)
    return F.when(d < HIGH, "high").when(d < MEDIUM, "medium").otherwise("low")


def outlier(start, end) -> Column:
    """More than the limit apart, or missing.  A drift of just the limit is low but no outlier."""
    return F.coalesce(drift(start, end) > MEDIUM, F.lit(True))


def has_error(error) -> Column:
    return F.coalesce(_col(error), F.lit("")) != ""


def confidence_cli(start, end, error) -> Column:
    """High, Medium or Low where there is no error and both delays are there, else a dash."""
    known = ~has_error(error) & _col(start).isNotNull() & _col(end).isNotNull()
    return F.when(known, F.initcap(confidence(start, end))).otherwise("-")


def status_cli(start, error) -> Column:
    return F.when(has_error(error), F.concat(F.lit("ERROR: "), _col(error))).when(_col(start).isNotNull(), "OK").otherwise("Failed")


def pair_status(other) -> Column:
    return F.when(_col(other).isNull(), "missing").otherwise("matched")


def result_status(error) -> Column:
    return F.when(has_error(error), "error").otherwise("success")
