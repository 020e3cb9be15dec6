"""Key extraction and pairing of two lists of names.

Engine rules: case-sensitive keys of all groups, the last path of a key wins, a waterfall of patterns, and all digit runs as the last
resort.  Preview rules: case-insensitive keys of two padded groups, the first name of a key wins, unmatched names stay.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagstone.functions import text

# The patterns that are tried in order, and the one that the preview begins with.
PATTERNS = (r"[Ss](\d+)[Ee](\d+)", r"(\d+)x(\d+)", r"[._\s-](\d{1,3})[._\s-]")
PREVIEW_PATTERN = r"S(\d+)E(\d+)"

#: Constructs that Java's expressions read otherwise, or in which a group can stay unset (null here, empty there).
_NOT_PORTABLE = re.compile(r"\(\?[P<(#]|\\[AZzbBGhHRXQE]|\||\)[?*]|\)\{0|\[\[|&&")


def arity(pattern: str) -> int:
    """The number of groups; ValueError if the pattern is no expression."""
    try:
        return re.compile(pattern).groups
    except re.error as e:
        raise ValueError(f"invalid pattern: {e}") from e


def usable_pattern(pattern: str) -> bool:
    """Whether the pattern compiles and finds two groups or more in a usual name."""
    try:
        m = re.search(pattern, "S01E02", re.IGNORECASE)
    except re.error:
        return False
    return bool(m and len(m.groups()) >= 2)


def match_key(name: Column, pattern: str) -> Column:
    """All groups of the first match as an array, null without a match.

    Portable patterns stay in the JVM; the others run in an Arrow-batched function.  A pattern without groups gives an empty array.
    """
    groups = arity(pattern)
    if _NOT_PORTABLE.search(pattern):

        @F.pandas_udf("array<string>")
        def searched(names: pd.Series) -> pd.Series:
            compiled = re.compile(pattern)
            return names.map(lambda x: (lambda m: list(m.groups()) if m else None)(compiled.search(x)) if x is not None else None)

        return searched(name)
    unicode = "(?U)" + pattern
    parts = [F.regexp_extract(name, unicode, k + 1) for k in range(groups)]
    found = F.array(*parts) if parts else F.array().cast("array<string>")
    return F.when(F.regexp_like(name, F.lit(unicode)), found)


def digits_key(name: Column) -> Column:
    """All runs of digits of the name, extension included; null if there are none."""
    runs = F.regexp_extract_all(name, F.lit(r"(?U)\d+"), F.lit(0))
    return F.when(F.size(runs) > 0, runs)


def keyed(files: DataFrame, key: Column, *, path: str = "path") -> DataFrame:
    """key and path, without null keys."""
    return files.select(key.alias("key"), F.col(path).alias("path")).where(F.col("key").isNotNull())


def last_wins(keys: DataFrame) -> DataFrame:
    """One path per key: the last in path order."""
    return keys.groupBy("key").agg(F.max("path").alias("path"))


def first_wins(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.min("path").alias("path"))


def keys_meet(primary: DataFrame, secondary: DataFrame) -> bool:
    """Whether any key stands on both sides; stops at the first."""
    return bool(primary.select("key").join(secondary.select("key"), "key", "left_semi").limit(1).count())


def join_keys(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Pairs of the paths that share a key, one per key."""
    p = last_wins(primary).withColumnRenamed("path", "primary_path")
    s = last_wins(secondary).withColumnRenamed("path", "secondary_path")
    return p.join(s, "key").select("primary_path", "secondary_path")


def choose_keys(primary: DataFrame, secondary: DataFrame, pattern: str | None = None, *, path: str = "path") -> tuple[DataFrame, DataFrame, str]:
    """Both sides' keys by the first pattern whose keys meet, and its text; by all digits if none does.

    A given pattern replaces the waterfall but not the last resort.
    """
    name = text.basename(path)
    for p in (pattern,) if pattern else PATTERNS:
        sides = [keyed(x, match_key(name, p), path=path) for x in (primary, secondary)]
        if keys_meet(*sides):
            return *sides, p
    return keyed(primary, digits_key(name), path=path), keyed(secondary, digits_key(name), path=path), "digits"


def pair_files(primary: DataFrame, secondary: DataFrame, pattern: str | None = None, *, path: str = "path") -> DataFrame:
    """primary_path and secondary_path of what belongs together, in order."""
    p, s, _ = choose_keys(primary, secondary, pattern, path=path)
    return join_keys(p, s).orderBy("primary_path", "secondary_path")


def pair_in_one_plan(primary: DataFrame, secondary: DataFrame, *, path: str = "path") -> DataFrame:
    """The waterfall as one plan: every pattern's pairs with its rank, of which the least rank stays.  Columns as above and pattern_rank."""
    name = text.basename(path)
    keys = [*(match_key(name, p) for p in PATTERNS), digits_key(name)]
    ranked = F.posexplode(F.array(*keys)).alias("pattern_rank", "key")
    sides = []
    for side, label in ((primary, "primary_path"), (secondary, "secondary_path")):
        rows = side.select(F.col(path).alias("path"), ranked).where("key IS NOT NULL")
        sides.append(rows.groupBy("pattern_rank", "key").agg(F.max("path").alias(label)))
    pairs = sides[0].join(sides[1], ["pattern_rank", "key"])
    best = pairs.agg(F.min("pattern_rank").alias("best"))
    return pairs.join(F.broadcast(best), F.col("pattern_rank") == F.col("best")).select("primary_path", "secondary_path", "pattern_rank")


def pair_with_one(primary: DataFrame, secondary_path: str, *, path: str = "path") -> DataFrame:
    """Every primary with the one secondary."""
    return primary.select(F.col(path).alias("primary_path"), F.lit(secondary_path).alias("secondary_path"))


def preview_key(name: Column, pattern: str = PREVIEW_PATTERN) -> Column:
    """The first two groups, filled to two digits and joined by a dash; null without a match, with fewer groups or a bad pattern."""
    try:
        if re.compile(pattern).groups < 2:
            return F.lit(None).cast("string")
    except re.error:
        return F.lit(None).cast("string")
    found = match_key(name, f"(?i){pattern}")
    return F.when(found.isNotNull(), F.concat(text.pad_start(F.get(found, F.lit(0))), F.lit("-"), text.pad_start(F.get(found, F.lit(1)))))


def preview(primary: DataFrame, secondary: DataFrame, pattern: str = PREVIEW_PATTERN, *, name: str = "name") -> DataFrame:
    """primary_name, secondary_name ('No match' if there is none) and status of every primary."""
    right = first_wins(keyed(secondary, preview_key(F.col(name), pattern), path=name)).withColumnRenamed("path", "other")
    left = primary.select(F.col(name).alias("primary_name"), preview_key(F.col(name), pattern).alias("key"))
    status = F.when(F.col("other").isNull(), "missing").otherwise("matched")
    return left.join(right, "key", "left").select("primary_name", F.coalesce("other", F.lit("No match")).alias("secondary_name"), status.alias("status"))


def preview_movie(primary: DataFrame, secondary_name: str | None, *, name: str = "name") -> DataFrame:
    """Every primary with the one secondary, or missing."""
    return primary.select(F.col(name).alias("primary_name"), F.lit(secondary_name or "No match").alias("secondary_name"), F.lit("matched" if secondary_name else "missing").alias("status"))
