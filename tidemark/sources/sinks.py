"""Staging, persisting and changing tables (SRC6-SRC14, OP14).

Parquet tables have no in-place UPDATE: a change is derived as a new
DataFrame, written to a new table, and swapped in by name. The table being
read is never overwritten while it is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stage(df: DataFrame, name: str) -> DataFrame:
    """SRC6: a session temp table. Spark views are lazy, so the snapshot is persisted;
    lost blocks are recomputed from the same plan."""
    staged = df.persist(StorageLevel.MEMORY_AND_DISK)
    staged.createOrReplaceTempView(name)
    return staged


def persist_table(df: DataFrame, name: str, mode: str = "errorifexists", fmt: str = "parquet",
                  partition_by: Sequence[str] | None = None) -> None:
    """SRC7 / SRC14: ``CREATE TABLE name AS SELECT``; ``mode="overwrite"`` is drop-then-create.

    ``partition_by`` (for example a month column of an order table) lets later
    date-range filters prune whole folders instead of reading every file.
    """
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def persist_bucketed(df: DataFrame, name: str, key: str, buckets: int, mode: str = "errorifexists") -> None:
    """SRC6 / SRC7 as a bucketed layout: rows are dealt by ``key`` once, when they are written (a file per
    bucket, sorted by the key). Aggregates by the key and joins on it, also between tables of
    the same number of buckets, then need no shuffle. A hot key makes its bucket as large as it is."""
    df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def drop_table(spark: SparkSession, name: str, temporary: bool = False) -> None:
    """SRC8: ``DROP [TEMPORARY] TABLE IF EXISTS``."""
    if temporary:
        spark.catalog.dropTempView(name)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def insert_into(spark: SparkSession, table: str, df: DataFrame, columns: Sequence[str] | None = None) -> None:
    """SRC9: ``INSERT INTO t (cols) SELECT``: ``df``'s columns fill ``columns`` by
    position; other table columns get NULL."""
    target = spark.table(table)
    names = list(columns) if columns else list(df.columns)
    if len(names) != len(df.columns):
        raise ValueError("column list and SELECT list differ in length")
    src = dict(zip(names, df.columns))
    row = [F.col(src[f.name]).cast(f.dataType).alias(f.name) if f.name in src
           else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    df.select(*row).write.insertInto(table)


def add_column(spark: SparkSession, table: str, column: str, sql_type: str) -> None:
    """SRC10: ``ALTER TABLE t ADD COLUMN c type`` (existing rows read NULL)."""
    spark.sql(f"ALTER TABLE {table} ADD COLUMN {column} {sql_type}")


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a table; some catalogs move its folder but leave its partitions' places behind, so set these."""
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
    if not any(c.isPartition for c in spark.catalog.listColumns(new)):
        return
    home = next(r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {new}").collect() if r["col_name"] == "Location")
    for r in spark.sql(f"SHOW PARTITIONS {new}").collect():  # a catalog entry each, no data
        pairs = [x.split("=", 1) for x in r["partition"].split("/")]
        spec = ", ".join(f"`{k}` = " + ("NULL" if v == "__HIVE_DEFAULT_PARTITION__" else "'" + unquote(v).replace("'", "\\'") + "'")
                         for k, v in pairs)
        spark.sql(f"ALTER TABLE {new} PARTITION ({spec}) SET LOCATION '{home}/{r['partition']}'")
    spark.catalog.refreshTable(new)


def replace_table(spark: SparkSession, table: str, df: DataFrame) -> None:
    """Write ``df`` (usually derived from ``table``) to a new table, then swap names.

    The new table keeps the old one's partition columns and format. Its rows are fully
    written, under a name of their own, before any rename, and the old table
    is dropped last. If a failure strikes between the two renames, the old rows are in
    ``<table>__old``; ``recover_table`` (called by every update here) puts them back.
    """
    staging, retired = f"{table}__next_{uuid.uuid4().hex[:12]}", f"{table}__old"
    if not spark.catalog.tableExists(table):
        raise ValueError(f"{table} does not exist; recover_table brings back what an interrupted swap left")
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition and c.name in df.columns]
    provider = [r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect() if r["col_name"] == "Provider"]
    writer = df.write.format(provider[0] if provider else "parquet")
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(staging)
    spark.sql(f"DROP TABLE IF EXISTS {retired}")  # of a finished swap: the table itself is there
    _rename(spark, table, retired)
    _rename(spark, staging, table)
    spark.sql(f"DROP TABLE {retired}")


def recover_table(spark: SparkSession, table: str) -> bool:
    """Put back the old rows if a swap was interrupted between its renames; True if it did."""
    retired = f"{table}__old"
    if spark.catalog.tableExists(table) or not spark.catalog.tableExists(retired):
        return False
    _rename(spark, retired, table)
    return True


def updated_from(target: DataFrame, source: DataFrame, key: str, assignments: Mapping[str, str]) -> DataFrame:
    """SRC11 as a DataFrame: ``UPDATE a JOIN b ON key SET a.c = b.c``.

    ``source`` must have one row per key (it is an aggregate in the source
    SQL); target rows without a match keep their values.
    """
    src = source.select(F.col(key).alias("_k"), *[F.col(s).alias(f"_v_{t}") for t, s in assignments.items()])
    joined = target.join(src, target[key] == src["_k"], "left")
    out = [F.when(F.col("_k").isNotNull(), F.col(f"_v_{c}")).otherwise(F.col(c)).cast(target.schema[c].dataType)
           .alias(c) if c in assignments else F.col(c) for c in target.columns]
    return joined.select(*out)


def update_from(spark: SparkSession, table: str, source: DataFrame, key: str, assignments: Mapping[str, str]) -> None:
    """SRC11 on a stored table."""
    recover_table(spark, table)
    replace_table(spark, table, updated_from(spark.table(table), source, key, assignments))


def update_column(spark: SparkSession, table: str, column: str, expr: Column) -> None:
    """SRC12: ``UPDATE t SET c = expr`` (every row)."""
    recover_table(spark, table)
    t = spark.table(table)
    replace_table(spark, table, t.withColumn(column, expr))


def retype_column(spark: SparkSession, table: str, column: str, sql_type: str, coerce: bool = False) -> None:
    """SRC13: ``ALTER TABLE t MODIFY COLUMN c type``. A value that does not convert is an
    error and the table stays as it is; with ``coerce`` it becomes NULL."""
    recover_table(spark, table)
    new = F.col(column).try_cast(sql_type)
    if not coerce:
        bad = F.concat(F.lit(f"{table}.{column} does not convert to {sql_type}: "), F.col(column).cast("string"))
        new = F.when(new.isNull() & F.col(column).isNotNull(), F.raise_error(bad).cast(sql_type)).otherwise(new)
    replace_table(spark, table, spark.table(table).withColumn(column, new))


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    """SRC14: ``CREATE TABLE target AS SELECT * FROM source``."""
    persist_table(spark.table(source), target)


def activity_status_two_writes(spark: SparkSession, table: str, churned: DataFrame, recent: DataFrame,
                               grades: DataFrame) -> DataFrame:
    """OP14: the activity status table built as the source does: create with the
    'Inactive' rows, then append the 'Active' rows with a column list."""
    from tidemark.operators.lapse import ACTIVE, INACTIVE

    drop_table(spark, table)
    persist_table(churned.select("user_id", "spending_grade", F.lit(INACTIVE).alias("activity_status")), table)
    active = (recent.select("user_id").join(grades.select("user_id", "spending_grade"), "user_id")
              .select("user_id", "spending_grade", F.lit(ACTIVE).alias("activity_status")))
    insert_into(spark, table, active, ["user_id", "spending_grade", "activity_status"])
    return spark.table(table)
