from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lagstone.operators import matching


def frame(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def pairs(spark, primary, secondary, pattern=None):
    return [tuple(r) for r in matching.pair_files(frame(spark, primary), frame(spark, secondary), pattern).collect()]


CASES = [
    ("Show.S01E02.mkv", "show_s01e02.eac3", None, True),
    ("Show 1x02.mkv", "Show 1x02.ac3", None, True),
    ("Show.07.mkv", "dub.07.aac", None, True),
    ("Ep7.mkv", "Dub7.aac", None, True),
    ("Ep7.mp4", "Ep7.mp3", None, False),
    ("S1E2.mkv", "S01E02.aac", None, False),
    ("s01e02.mkv", "S01E02.aac", r"S(\d+)E(\d+)", True),
]


@pytest.mark.parametrize(("p", "s", "pattern", "paired"), CASES)
def test_rules(spark, p, s, pattern, paired):
    assert pairs(spark, [f"/v/{p}"], [f"/a/{s}"], pattern) == ([(f"/v/{p}", f"/a/{s}")] if paired else [])


def test_last_wins_and_zero_groups(spark):
    assert pairs(spark, ["A.1920x1080.mkv", "B.1920x1080.mkv"], ["C.1920x1080.aac"]) == [("B.1920x1080.mkv", "C.1920x1080.aac")]
    assert pairs(spark, ["S01E01.mkv", "S01E02.mkv"], ["S01E01.aac"], r"E\d+") == [("S01E02.mkv", "S01E01.aac")]


def test_bad_and_empty(spark):
    with pytest.raises(ValueError, match="invalid pattern"):
        pairs(spark, ["a1"], ["b1"], "(")
    assert pairs(spark, [], ["b1"]) == []


def test_unset_groups_are_null(spark):
    rows = frame(spark, ["E01", "E01b"])
    got = rows.select(matching.match_key(rows.path, r"E(\d+)(b)?").alias("k")).collect()
    assert [r.k for r in got] == [["01", None], ["01", "b"]]


def test_preview(spark):
    p = spark.createDataFrame([("S1E2.mkv",), ("s03e04.mkv",), ("x.mkv",)], "name string")
    s = spark.createDataFrame([("b_S01E02.aac",), ("a_S01E02.aac",)], "name string")
    got = {tuple(r) for r in matching.preview(p, s).collect()}
    assert got == {("S1E2.mkv", "a_S01E02.aac", "matched"), ("s03e04.mkv", "No match", "missing"), ("x.mkv", "No match", "missing")}
    assert {r.status for r in matching.preview(p, s, r"S(\d+)").collect()} == {"missing"}
    assert {r.status for r in matching.preview_movie(p, None).collect()} == {"missing"}


def test_one_plan_agrees(spark):
    p, s = ["A.S01E01.mkv", "B.S01E02.mkv", "C.1x3.mkv"], ["x.S01E02.aac", "y.1x3.aac"]
    one = matching.pair_in_one_plan(frame(spark, p), frame(spark, s)).collect()
    assert sorted((r.primary_path, r.secondary_path) for r in one) == pairs(spark, p, s)


def test_usable():
    assert matching.usable_pattern(r"s(\d+)e(\d+)")
    assert not matching.usable_pattern(r"S(\d+)")
    assert not matching.usable_pattern("(")


names = st.text(alphabet="SEx0129._- ", min_size=1, max_size=10)


@settings(max_examples=8, deadline=None)
@given(st.lists(names, max_size=6, unique=True), st.lists(names, max_size=6, unique=True))
def test_pairs_are_a_partial_injection(spark, primary, secondary):
    got = pairs(spark, primary, secondary)
    assert len({p for p, _ in got}) == len({s for _, s in got}) == len(got)

    def expected():
        for pattern in matching.PATTERNS:
            sides = [{m.groups(): x for x in sorted(side) if (m := re.search(pattern, x))} for side in (primary, secondary)]
            if set(sides[0]) & set(sides[1]):
                return sides
        return [{tuple(re.findall(r"\d+", x)): x for x in sorted(side) if re.findall(r"\d+", x)} for side in (primary, secondary)]

    a, b = expected()
    assert got == sorted((a[k], b[k]) for k in set(a) & set(b))
