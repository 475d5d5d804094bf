"""Side-by-side check of a Spark result against a DuckDB SQL result.

Rows are compared as multisets after sorting columns by name; doubles are
compared after rounding to ``digits`` significant places.
"""

from __future__ import annotations

import datetime as _dt
import math
import os

from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.{digits}g}")
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "is_finite"):  # Decimal
        return float(f"{float(v):.{digits}g}")
    return v


# Spark simple type name -> DuckDB type name of the same values.
_TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "boolean": "BOOLEAN",
             "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def compare(spark_df: DataFrame, con, sql: str, digits: int = 17) -> dict:
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    d_rows = rel.fetchall()
    s_cols = spark_df.columns
    s_types = dict(spark_df.dtypes)
    s_rows = [tuple(r) for r in spark_df.collect()]
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    type_diffs = {c: (s_types[c], d_types.get(c)) for c in s_cols
                  if c in d_types and _TYPE_MAP.get(s_types[c], s_types[c]) != d_types[c]}
    if type_diffs:
        out["type_diffs"] = type_diffs
    if not out["columns_match"]:
        out["spark_columns"], out["oracle_columns"] = s_cols, d_cols
        out["match"] = False
        return out
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    a = sorted((tuple(_norm(r[i], digits) for i in si) for r in s_rows), key=key)
    b = sorted((tuple(_norm(r[i], digits) for i in di) for r in d_rows), key=key)
    out["match"] = a == b
    if not out["match"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["first_diffs"] = diff
    return out
