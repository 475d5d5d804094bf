"""Extremes from the footers against scans."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tidemark.operators import sales
from tidemark.sources import statistics
from tidemark.sources.tables import SCHEMAS, table_path
from tidemark.sources.views import sales_view


def test_lineitem_prices_from_the_footers(spark):
    path = table_path(SF01, "lineitem")
    with statistics._newer_reader(spark):
        plan = statistics.pushed_extremes(spark, path, "l_extendedprice", SCHEMAS["lineitem"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(l_extendedprice), MAX(l_extendedprice)]" in plan
    lo, hi, footers = statistics.column_extremes(spark, path, "l_extendedprice", SCHEMAS["lineitem"])
    want = spark.read.parquet(path).agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    assert footers and (lo, hi) == tuple(want)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false" and "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    v = sales_view(spark, SF01, "price", "date")
    assert sales.trim_extremes(v, "price", (lo, hi)).count() == sales.trim_extremes(v, "price").count() < v.count()


@pytest.mark.parametrize("values", [[1.5, -2.0, None, 7.25], [float("nan"), 3.0, -1.0, None], [None, None], [0.0, -0.0], [float("inf"), 1.0], []])
def test_odd_columns(spark, tmp_path, values):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(v,) for v in values], "x double")
    df.repartition(2).write.parquet(path)
    lo, hi, _ = statistics.column_extremes(spark, path, "x")
    numbers = [v for v in values if v is not None and v == v]
    assert (lo, hi) == ((min(numbers), max(numbers)) if numbers else (None, None))
    a, b = (sorted(map(str, sales.trim_extremes(df, "x", e).collect())) for e in (None, (lo, hi)))
    assert a == b
