"""Partition-scoped updates: what changes, which files stay, and what an interruption leaves."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sinks, updates

SCHEMA = "user_id long, amount double, note string, month string, region int"


@pytest.fixture
def table(spark):
    name = f"upd_{uuid.uuid4().hex[:8]}"
    rows = [(i, float(i), f"n{i}", ["2024-01", "2024-02", "2024-03", None][i % 4], i % 2) for i in range(40)]
    sinks.persist_table(spark.createDataFrame(rows, SCHEMA).repartition(3), name, partition_by=["month", "region"])
    yield name
    sinks.drop_table(spark, name)


def _files(spark, table):
    home = next(r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect() if r["col_name"] == "Location")
    return {os.path.relpath(f, home.removeprefix("file:")): os.stat(f).st_mtime_ns for f in glob.glob(home.removeprefix("file:") + "/**/*.parquet", recursive=True)}


def _rows(spark, table):
    return {r["user_id"]: r.asDict() for r in spark.table(table).collect()}


def test_update_from_touches_only_the_keys_partitions(spark, table):
    before, old = _files(spark, table), _rows(spark, table)
    source = spark.createDataFrame([(4, 400.0, None), (8, 800.0, "x"), (999, 1.0, "absent")], "user_id long, a double, b string")  # 2024-01, region 0
    updates.update_partitions_from(spark, table, source, "user_id", {"amount": "a", "note": "b"})
    after, new = _files(spark, table), _rows(spark, table)
    touched = {f for f in before if f.startswith("month=2024-01/region=0")}
    assert touched and not touched & set(after)
    assert {f: t for f, t in before.items() if f not in touched}.items() <= after.items()
    want = {k: dict(v) for k, v in old.items()}
    want[4] |= {"amount": 400.0, "note": None}
    want[8] |= {"amount": 800.0, "note": "x"}
    assert new == want


def test_update_where_and_null_partitions(spark, table):
    before, old = _files(spark, table), _rows(spark, table)
    updates.update_partitions_where(spark, table, {"amount": F.col("amount") * 10, "note": F.lit("seen")}, F.col("user_id").isin(3, 7) | F.col("note").isNull())
    after, new = _files(spark, table), _rows(spark, table)
    assert {f.split("/")[0] for f in set(before) - set(after)} == {"month=__HIVE_DEFAULT_PARTITION__"}
    assert new[3]["amount"] == 30.0 and new[7]["note"] == "seen" and new[11] == old[11] and len(new) == 40
    updates.update_partitions_where(spark, table, {"amount": F.lit(0.0)}, F.col("user_id") > 1000)
    updates.update_partitions_from(spark, table, spark.createDataFrame([], "user_id long, a double"), "user_id", {"amount": "a"})
    assert _files(spark, table) == after
    with pytest.raises(ValueError, match="place a row"):
        updates.update_partitions_where(spark, table, {"month": F.lit("x")}, F.lit(True))


@pytest.mark.parametrize("stop", ["before the note", "before the replacement", "after the replacement"])
def test_interruptions(spark, table, monkeypatch, stop):
    old = _rows(spark, table)
    source = spark.createDataFrame([(0, -1.0), (1, -2.0)], "user_id long, a double")
    change = lambda: updates.update_partitions_from(spark, table, source, "user_id", {"amount": "a"})

    def die(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        if stop == "before the note":
            real = updates.materialize
            m.setattr(updates, "materialize", lambda *a: (real(*a), die())[0])
        elif stop == "before the replacement":
            m.setattr(updates, "_overwrite", die)
        else:
            real = updates._overwrite
            m.setattr(updates, "_overwrite", lambda *a: (real(*a), die()))
        with pytest.raises(RuntimeError, match="stopped"):
            change()
    if stop != "after the replacement":
        assert _rows(spark, table) == old
    assert updates.finish_update(spark, table) is (stop != "before the note")
    assert updates.finish_update(spark, table) is False
    new = _rows(spark, table)
    assert new == old if stop == "before the note" else (new[0]["amount"], new[1]["amount"], len(new)) == (-1.0, -2.0, 40)
    change()
    assert (_rows(spark, table)[0]["amount"], len(_rows(spark, table))) == (-1.0, 40)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_a_batch_counts_once(spark):
    name = f"batch_{uuid.uuid4().hex[:8]}"
    one, two = (spark.range(a, b).selectExpr("id AS user_id", "id % 3 AS month") for a, b in ((0, 10), (10, 15)))
    updates.append_batch(spark, name, one, "b1", partition_by=("month",))
    updates.append_batch(spark, name, two, "b2", partition_by=("month",))
    before = _files(spark, name)
    updates.append_batch(spark, name, one, "b1", partition_by=("month",))
    assert sorted(r["user_id"] for r in spark.table(name).collect()) == list(range(15))
    kept = {f: t for f, t in before.items() if f.startswith("batch_id=b2")}
    assert kept and kept.items() <= _files(spark, name).items()
    sinks.drop_table(spark, name)


def test_unpartitioned_tables_are_refused(spark):
    name = f"flat_{uuid.uuid4().hex[:8]}"
    sinks.persist_table(spark.range(3).toDF("user_id"), name)
    with pytest.raises(ValueError, match="no partitions"):
        updates.update_partitions_where(spark, name, {"user_id": F.lit(0)}, F.lit(True))
    sinks.drop_table(spark, name)
