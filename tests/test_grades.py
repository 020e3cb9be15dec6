from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lagstone.functions import grades
from lagstone.operators import summary

CASES = [(49.999, "high", False), (50.0, "medium", False), (499.999, "medium", False), (500.0, "low", False), (500.001, "low", True), (None, "low", True)]


@pytest.mark.parametrize(("drift", "confidence", "outlier"), CASES)
def test_thresholds(spark, drift, confidence, outlier):
    row = spark.range(1).select(F.lit(0.0).alias("s"), F.lit(drift).cast("double").alias("e")).select(grades.confidence("s", "e").alias("c"), grades.outlier("s", "e").alias("o")).first()
    assert (row.c, row.o) == (confidence, outlier)


def test_cli_columns(spark):
    rows = [(0.0, 10.0, None), (0.0, None, None), (None, None, None), (0.0, 900.0, ""), (0.0, 10.0, "bad")]
    got = spark.createDataFrame(rows, "s double, e double, error string").select(grades.confidence_cli("s", "e", "error"), grades.status_cli("s", "error")).collect()
    assert [tuple(r) for r in got] == [("High", "OK"), ("-", "OK"), ("-", "Failed"), ("Low", "OK"), ("-", "ERROR: bad")]


def test_counts_overlap(spark):
    rows = [(0.0, 1.0, None), (0.0, 100.0, None), (None, None, "bad"), (0.0, None, "")]
    df = spark.createDataFrame(rows, "start_delay_ms double, end_delay_ms double, error string").withColumn("confidence", grades.confidence("start_delay_ms", "end_delay_ms"))
    assert summary.result_counts(df).first().asDict() == {"high": 1, "medium": 1, "low": 2, "error": 1, "total": 4}
    assert summary.success_counts(df).first().asDict() == {"success": 3, "failed": 1}
    assert summary.any_low(df).first().warn
    assert not summary.any_low(df.limit(0)).first().warn
