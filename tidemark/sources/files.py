"""Sheets as DataFrames (SRC2-SRC5, PRJ6).

A sheet is one of a workbook (``fmt="workbook"``, see ``workbook.py``) or a CSV or Parquet dataset. Schemas
are declared (never inferred on large data); column names are trimmed on load.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.sales import union_sources
from tidemark.sources.workbook import FORMAT, read_workbook


def trim_column_names(df: DataFrame) -> DataFrame:
    """PRJ6: strip spaces around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def read_sheet(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "csv", header: bool = True, sheet: str | int = 0) -> DataFrame:
    """SRC2 / SRC3: one sheet (dataset) as a DataFrame with trimmed column names.

    With a header, the fields of ``schema`` are found by their trimmed names, whatever the
    order of the columns; a field that the sheet lacks is an error. Without one they go by
    position. CSV cells that do not fit the declared type load as NULL,
    like a coerced spreadsheet read. ``sheet``: which one of a workbook.
    """
    if fmt == FORMAT:
        return read_workbook(spark, path, sheet, schema, header)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", header).option("mode", "PERMISSIVE")
        if schema is not None and not header:
            reader = reader.schema(schema)
    sheet = trim_column_names(reader.load(path))
    if schema is None or (fmt == "csv" and not header):
        return sheet
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [f.name for f in fields if f.name not in sheet.columns]
    if missing:
        raise ValueError(f"{path} has no column(s) {missing}; it has {sheet.columns}")
    return sheet.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def read_sheets(spark: SparkSession, paths: Mapping[str, str],
                schema: Mapping[str, T.StructType | str] | T.StructType | str | None = None,
                fmt: str = "csv") -> dict[str, DataFrame]:
    """SRC4: several sheets by name, with one schema for all or a mapping of one per sheet. Of a workbook the
    names are its sheets' (several sheets may be of one workbook)."""
    own = schema if isinstance(schema, Mapping) else dict.fromkeys(paths, schema)
    return {name: read_sheet(spark, p, own.get(name), fmt, sheet=name if fmt == FORMAT else 0) for name, p in paths.items()}


def read_sources(spark: SparkSession, specs: Mapping[str, tuple[str, str, str]], fmt: str = "csv",
                 name: str = "artist") -> DataFrame:
    """SRC5: N sources, each ``(path, date column, price column)``, stacked as
    ``<name>, date, price`` (dates and prices coerced, bad values NULL)."""
    frames = {label: (read_sheet(spark, path, None, fmt), d, p) for label, (path, d, p) in specs.items()}
    return union_sources(frames, name)
