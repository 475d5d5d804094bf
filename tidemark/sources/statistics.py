"""Least and greatest value of a Parquet column from the files' own statistics (FLT10, OP44, OP45).

Spark's newer Parquet reader answers MIN and MAX from the footers (aggregate push-down), so no row is read. It
refuses where a file keeps no usable statistics, for example where a writer met NaN; then the column is scanned once instead. Either
way NULL and NaN are no values.
"""

from __future__ import annotations

from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@contextmanager
def _newer_reader(spark: SparkSession):
    conf = {"spark.sql.sources.useV1SourceList": ",".join(x for x in spark.conf.get("spark.sql.sources.useV1SourceList").split(",") if x != "parquet"),
            "spark.sql.parquet.aggregatePushdown": "true"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def pushed_extremes(spark: SparkSession, path: str, column: str, schema: T.StructType | None = None) -> DataFrame:
    """``lo, hi`` of the column as the newer reader plans them; to be used inside ``_newer_reader``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))


def column_extremes(spark: SparkSession, path: str, column: str, schema: T.StructType | None = None) -> tuple[object, object, bool]:
    """(least, greatest, from the footers?) of a column of numbers, dates or booleans; None for no values."""
    try:
        with _newer_reader(spark):
            df = pushed_extremes(spark, path, column, schema)
            pushed = "PushedAggregation: [MIN" in df._jdf.queryExecution().executedPlan().toString()
            if pushed:
                lo, hi = df.first()
                if not any(isinstance(x, float) and x != x for x in (lo, hi)):
                    return lo, hi, True
    except (PySparkException, Py4JJavaError):
        pass  # a file without usable statistics
    df = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        c = F.nullif(c, F.lit(float("nan")))
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    return lo, hi, False
