import pytest
from pyspark.sql import functions as F

from conftest import ts
from tidemark.functions.periods import (Span, in_period, label_of_start, period_bounds, period_key, period_start,
                                        period_trunc, shift_period)


def test_period_bounds():
    assert period_bounds("2024-12", "month") == ("2024-12-01", "2025-01-01")
    assert period_bounds("2024-Q4", "quarter") == ("2024-10-01", "2025-01-01")
    assert period_bounds("2024-Q1", "quarter") == ("2024-01-01", "2024-04-01")
    assert period_bounds("2024-02-29", "day") == ("2024-02-29", "2024-03-01")
    assert period_bounds("1999", "year") == ("1999-01-01", "2000-01-01")


@pytest.mark.parametrize("grain", ["day", "month", "quarter", "year"])
def test_trunc_then_label_equals_label_and_bounds(spark, grain):
    times = ["2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-03-31 12:00:00", "2024-04-01 00:00:00",
             "2024-02-29 08:00:00"]
    df = spark.createDataFrame([(ts(t),) for t in times], "ts timestamp_ntz")
    rows = df.select(period_key("ts", grain).alias("a"),
                     label_of_start(period_trunc("ts", grain), grain).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    for r, t in zip(rows, times):
        lo, hi = period_bounds(r.a, grain)
        assert lo <= t[:10] < hi
        assert df.filter((F.col("ts") == ts(t)) & in_period(df, "ts", r.a, grain)).count() == 1
    starts = df.select(period_start(period_key("ts", grain), grain).alias("s"),
                       period_trunc("ts", grain).alias("t")).collect()
    assert all(r.s == r.t for r in starts)


def test_span_closed_and_half_open(spark):
    df = spark.createDataFrame([(ts("2024-06-30 00:00:00"),), (ts("2024-06-30 10:00:00"),), (ts("2024-07-01"),)],
                               "ts timestamp_ntz")
    assert Span("2024-06-01", "2024-06-30").apply(df).count() == 1
    assert Span("2024-06-01", "2024-07-01", closed=False).apply(df).count() == 2
    assert Span(None, None).apply(df).count() == 3


def test_shift_period(spark):
    df = spark.createDataFrame([("2024-11",)], "m string")
    r = df.select(shift_period(period_start("m"), 3).alias("x"), shift_period(period_start("m"), 2, "quarter").alias("q")).collect()[0]
    assert (str(r.x), str(r.q)) == ("2025-02-01", "2025-05-01")
