"""Path, number and time formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slashed(path) -> Column:
    return F.replace(_col(path), F.lit("\\"), F.lit("/"))


def basename(path) -> Column:
    """What follows the last slash."""
    return F.substring_index(slashed(path), "/", -1)


def parent_folder(path) -> Column:
    """What precedes the last slash, with forward slashes; null if that is nothing."""
    return F.nullif(F.regexp_extract(slashed(path), "^(.+)/[^/]*$", 1), F.lit(""))


def extension(name) -> Column:
    """The last dot and what follows it, in lower case; empty if there is none (a leading dot starts no extension)."""
    return F.lower(F.regexp_extract(basename(name), r"^.*[^.].*?(\.[^.]*)$|^[^.]+(\.[^.]*)$", 1))


def has_extension(name, extensions) -> Column:
    """Whether the name ends in one of the extensions, whatever its case."""
    return F.lower(F.regexp_extract(_col(name), r"\.([^./\\]+)$", 1)).isin(*extensions)


def format_size(size) -> Column:
    """Bytes as B, KB, MB or GB of 1024, one decimal beyond B; two dashes for null, 0 and below."""
    n = _col(size).cast("double")
    # The units.
    scaled = F.when(n < 1024, F.format_string("%.0fB", n))
    for k, unit in enumerate(("KB", "MB"), 1):
        scaled = scaled.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f{unit}", F.round(n / 1024.0**k, 1)))
    scaled = scaled.otherwise(F.format_string("%.1fGB", F.round(n / 1024.0**3, 1)))
    return F.when(n.isNull() | (n <= 0), "--").otherwise(scaled)


def format_eta(ms) -> Column:
    """Milliseconds as m:ss, rounded to seconds, never negative."""
    total = F.greatest(F.lit(0), F.floor(_col(ms) / 1000 + 0.5)).cast("long")
    return F.concat(F.floor(total / 60).cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0"))


def format_delay(ms, *, plus_zero: bool = False, null: str = "--") -> Column:
    """A delay with one decimal (halves away from 0) and its sign, suffix ms; with ``plus_zero`` a 0 has a plus too."""
    x = _col(ms)
    positive = x >= 0 if plus_zero else x > 0
    return F.when(x.isNull(), null).otherwise(F.concat(F.when(positive, "+").otherwise(""), F.format_string("%.1fms", F.round(x, 1))))


def format_delay_cli(ms, null: str = "N/A") -> Column:
    """A delay with one decimal (halves to even) and always a sign."""
    x = _col(ms)
    return F.when(x.isNull(), null).otherwise(F.format_string("%+.1f", F.bround(x, 1)))


def csv_cell(value) -> Column:
    return F.coalesce(_col(value).cast("string"), F.lit(""))


def seconds_text(ms) -> Column:
    return F.format_string("%.1f", F.round(_col(ms) / 1000, 1))


def percent(processed, total) -> Column:
    """Whole percent, halves up; 0 of a total of 0."""
    return F.coalesce(F.floor(F.try_divide(_col(processed) * 100, _col(total)) + 0.5), F.lit(0)).cast("int")


def date_text(ts) -> Column:
    return F.date_format(_col(ts), "M/d/yyyy, hh:mm a")


def pad_start(text, width: int = 2, fill: str = "0") -> Column:
    """Fill on the left; longer texts stay whole."""
    x = _col(text)
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, fill))


def capitalise(text) -> Column:
    """The first character in upper case; the rest stays."""
    x = _col(text)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1))


def contains_ignoring_case(text, part: str) -> Column:
    return F.contains(F.lower(_col(text)), F.lit(part.lower()))
