"""Changes to partitioned tables that rewrite only the partitions touched (SRC9, SRC11, SRC12).

An update finds the partitions that hold a row to change, computes their new rows, writes these in full under the
shared checkpoint folder, notes that place in the table's properties and then replaces just those partitions
(dynamic partition overwrite). Files of all other partitions stay as they are. If the job dies before the note, nothing has
happened; if it dies after it, ``finish_update`` repeats the replacement from the written rows, however far it had
come: doing it again changes nothing. Every change here calls it first.

``append_batch`` makes an append idempotent: the rows of a batch are one partition of the batch column, so
the same batch written twice, or again after a failure, is there once.
"""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.relational import materialize
from tidemark.sources.sinks import updated_from

PENDING = "tidemark.pending_update"


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


@contextmanager
def _dynamic(spark: SparkSession):
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _overwrite(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """Replace the partitions that ``rows`` has; ``rows`` has the table's columns in the table's order."""
    with _dynamic(spark):
        rows.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    spark.catalog.refreshTable(table)


def _pending(spark: SparkSession, table: str) -> str | None:
    found = [r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if r["key"] == PENDING]
    return found[0] if found and found[0] else None


def finish_update(spark: SparkSession, table: str) -> bool:
    """Finish a replacement that was interrupted after its rows were written; True if there was one."""
    path = _pending(spark, table)
    if path is None:
        return False
    _overwrite(spark, table, spark.read.schema(spark.table(table).schema).parquet(path))
    spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ('{PENDING}')")
    return True


def _replace_partitions(spark: SparkSession, table: str, rows: DataFrame) -> None:
    written = materialize(rows.select(*spark.table(table).columns), "update")
    path = written.inputFiles()[0].rpartition("/")[0] if written.inputFiles() else None
    if path is None:  # no partition holds a row to change
        return
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{PENDING}' = '{path}')")
    finish_update(spark, table)


def _in_partitions(spark: SparkSession, table: str, parts: list[str], hit: DataFrame) -> DataFrame | None:
    """The table's rows in the partitions that ``hit`` has. Their names, a catalog entry each, are literals
    of the filter, so no other partition is listed or read."""
    names = hit.select(*parts).distinct().collect()
    if not names:
        return None
    kinds = spark.table(table).schema
    conditions = [[F.col(p).eqNullSafe(F.lit(r[p]).cast(kinds[p].dataType)) for p in parts] for r in names]
    where = F.lit(False)
    for cs in conditions:
        one = F.lit(True)
        for c in cs:
            one = one & c
        where = where | one
    return spark.table(table).filter(where)


def _parts(spark: SparkSession, table: str, assigned) -> list[str]:
    parts = partition_columns(spark, table)
    if not parts:
        raise ValueError(f"{table} has no partitions; use sinks.update_from or update_column")
    moved = sorted(set(parts) & set(assigned))
    if moved:
        raise ValueError(f"{moved} place a row in its partition and cannot be assigned")
    return parts


def update_partitions_from(spark: SparkSession, table: str, source: DataFrame, key: str, assignments: Mapping[str, str]) -> None:
    """SRC11 on a partitioned table: ``UPDATE a JOIN b ON key SET a.c = b.c``. Only the key and the
    partition columns are read to find the partitions; ``source`` has one row per key."""
    finish_update(spark, table)
    parts = _parts(spark, table, assignments)
    hit = spark.table(table).select(key, *parts).join(source.select(key).distinct(), key, "left_semi")
    rows = _in_partitions(spark, table, parts, hit)
    if rows is not None:
        _replace_partitions(spark, table, updated_from(rows, source, key, assignments))


def update_partitions_where(spark: SparkSession, table: str, assignments: Mapping[str, Column], where: Column) -> None:
    """SRC12 on a partitioned table: ``UPDATE t SET c = expr WHERE condition``."""
    finish_update(spark, table)
    parts = _parts(spark, table, assignments)
    rows = _in_partitions(spark, table, parts, spark.table(table).filter(where))
    if rows is not None:
        hit = F.coalesce(where, F.lit(False))
        new = rows.withColumn("_hit", hit).select(*[F.when(F.col("_hit"), assignments[c]).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c)
                                                   if c in assignments else F.col(c) for c in rows.columns])
        _replace_partitions(spark, table, new)


def append_batch(spark: SparkSession, table: str, rows: DataFrame, batch: str, batch_col: str = "batch_id",
                 partition_by: tuple[str, ...] = ()) -> None:
    """SRC9, idempotent: the rows become the partition ``batch`` of ``table``, which is made if it is absent. A batch
    that was written before is replaced, so a repeated append counts once. With further ``partition_by`` columns a repeat must
    bring the same rows, as a batch does."""
    tagged = rows.withColumn(batch_col, F.lit(batch))
    if not spark.catalog.tableExists(table):
        tagged.limit(0).write.partitionBy(batch_col, *partition_by).saveAsTable(table)
    _overwrite(spark, table, tagged)
