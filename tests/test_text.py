from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lagstone.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("size", "shown"), [(None, "--"), (0, "--"), (-5, "--"), (1023, "1023B"), (1024, "1.0KB"), (1536, "1.5KB"), (1024**2, "1.0MB"), (2**40, "1024.0GB")])
def test_size(spark, size, shown):
    assert one(spark, text.format_size(F.lit(size).cast("long"))) == shown


@pytest.mark.parametrize(("ms", "shown"), [(61_500, "1:02"), (0, "0:00"), (-10, "0:00"), (3_600_000, "60:00"), (499, "0:00"), (500, "0:01")])
def test_eta(spark, ms, shown):
    assert one(spark, text.format_eta(F.lit(ms))) == shown


@pytest.mark.parametrize(("ms", "ui", "table", "cli"), [(0.0, "0.0ms", "+0.0ms", "+0.0"), (12.25, "+12.3ms", "+12.3ms", "+12.2"), (-12.25, "-12.3ms", "-12.3ms", "-12.2"), (None, "--", "--", "N/A"), (0.125, "+0.1ms", "+0.1ms", "+0.1")])
def test_delays(spark, ms, ui, table, cli):
    x = F.lit(ms).cast("double")
    assert one(spark, text.format_delay(x)) == ui
    assert one(spark, text.format_delay(x, plus_zero=True)) == table
    assert one(spark, text.format_delay_cli(x)) == cli


@pytest.mark.parametrize(("path", "parent", "name", "ext"), [("/a", None, "a", ""), (r"C:\x\y.mkv", "C:/x", "y.mkv", ".mkv"), ("/v/S01.E02.MKV", "/v", "S01.E02.MKV", ".mkv"), ("plain", None, "plain", ""), ("/v/.hidden", "/v", ".hidden", "")])
def test_paths(spark, path, parent, name, ext):
    x = F.lit(path)
    assert one(spark, text.parent_folder(x)) == parent
    assert one(spark, text.basename(x)) == name
    assert one(spark, text.extension(x)) == ext


def test_small_ones(spark):
    assert one(spark, text.pad_start(F.lit("123"))) == "123"
    assert one(spark, text.pad_start(F.lit("7"))) == "07"
    assert one(spark, text.capitalise(F.lit("high lOw"))) == "High lOw"
    assert one(spark, text.percent(F.lit(1), F.lit(0))) == 0
    assert one(spark, text.percent(F.lit(1), F.lit(8))) == 13
    assert one(spark, text.csv_cell(F.lit(None).cast("double"))) == ""
    assert one(spark, text.contains_ignoring_case(F.lit("Run CANCELED."), "canceled"))
    assert one(spark, text.seconds_text(F.lit(1250))) == "1.3"
