import pytest
from pyspark.sql import functions as F

from conftest import ts
from tidemark.sources import sinks


def test_table_lifecycle(spark):
    df = spark.createDataFrame([(1, "2024-06"), (2, None), (3, "bad")], "user_id long, churned_month string")
    sinks.drop_table(spark, "gaps_t")
    sinks.persist_table(df, "gaps_t")
    sinks.copy_table(spark, "gaps_t", "gaps_copy")
    assert spark.table("gaps_copy").count() == 3
    # SRC12 + SRC13: month text to a first-of-month date, then retype
    sinks.update_column(spark, "gaps_t", "churned_month",
                        F.when(F.col("churned_month").isNotNull(), F.concat("churned_month", F.lit("-01"))))
    with pytest.raises(Exception, match="does not convert"):
        sinks.retype_column(spark, "gaps_t", "churned_month", "date")
    assert sorted(r.churned_month or "" for r in spark.table("gaps_t").collect()) == ["", "2024-06-01", "bad-01"]
    sinks.retype_column(spark, "gaps_t", "churned_month", "date", coerce=True)
    got = {r.user_id: r.churned_month for r in spark.table("gaps_t").collect()}
    assert str(got[1]) == "2024-06-01" and got[2] is None and got[3] is None
    assert dict(spark.table("gaps_t").dtypes)["churned_month"] == "date"
    sinks.drop_table(spark, "gaps_t")
    sinks.drop_table(spark, "gaps_copy")
    assert not spark.catalog.tableExists("gaps_t")


def test_add_column_and_update_from_join(spark):
    sinks.drop_table(spark, "status_t")
    sinks.persist_table(spark.createDataFrame([(1, "Active"), (2, "Inactive")], "user_id long, activity_status string"),
                        "status_t")
    sinks.add_column(spark, "status_t", "last_order_date", "timestamp_ntz")
    assert spark.table("status_t").filter("last_order_date is not null").count() == 0
    latest = spark.createDataFrame([(1, ts("2024-05-03 10:00:00")), (7, ts("2024-01-01"))],
                                   "user_id long, last_order_date timestamp_ntz")
    sinks.update_from(spark, "status_t", latest, "user_id", {"last_order_date": "last_order_date"})
    got = {r.user_id: r.last_order_date for r in spark.table("status_t").collect()}
    assert got == {1: ts("2024-05-03 10:00:00"), 2: None}
    sinks.drop_table(spark, "status_t")


def test_insert_with_column_list_and_stage(spark):
    sinks.drop_table(spark, "ins_t")
    sinks.persist_table(spark.createDataFrame([(1, "a", "x")], "user_id long, g string, s string"), "ins_t")
    sinks.insert_into(spark, "ins_t", spark.createDataFrame([("b", 2)], "g string, u long"), ["g", "user_id"])
    assert sorted(tuple(r) for r in spark.table("ins_t").collect()) == [(1, "a", "x"), (2, "b", None)]
    staged = sinks.stage(spark.table("ins_t"), "ins_v")
    assert spark.table("ins_v").count() == 2
    staged.unpersist()
    sinks.drop_table(spark, "ins_v", temporary=True)
    sinks.drop_table(spark, "ins_t")


def test_partitioned_table_prunes_by_month(spark):
    from conftest import SF01
    from tidemark.sources.views import orders_view

    o = orders_view(spark, SF01).withColumn("order_month", F.date_format("ts", "yyyy-MM"))
    sinks.drop_table(spark, "orders_by_month")
    sinks.persist_table(o, "orders_by_month", partition_by=["order_month"])
    q = spark.table("orders_by_month").filter(F.col("order_month") == "1997-03")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan
    assert q.count() == o.filter(F.col("order_month") == "1997-03").count()
    sinks.drop_table(spark, "orders_by_month")


def test_replace_keeps_partitioning_and_survives_an_interrupted_swap(spark):
    for t in ("part_t", "part_t__old"):
        sinks.drop_table(spark, t)
    sinks.persist_table(spark.createDataFrame([(1, "a"), (2, "b'c d")], "id long, p string"), "part_t", partition_by=["p"])
    sinks.update_column(spark, "part_t", "id", F.col("id") + 10)
    assert [c.name for c in spark.catalog.listColumns("part_t") if c.isPartition] == ["p"]
    assert sorted(tuple(r) for r in spark.table("part_t").select("id", "p").collect()) == [(11, "a"), (12, "b'c d")]
    sinks._rename(spark, "part_t", "part_t__old")  # a crash after the first rename
    with pytest.raises(ValueError, match="does not exist"):
        sinks.replace_table(spark, "part_t", spark.table("part_t__old"))
    sinks.update_column(spark, "part_t", "id", F.col("id") + 10)
    assert sorted(tuple(r) for r in spark.table("part_t").select("id", "p").collect()) == [(21, "a"), (22, "b'c d")]
    assert not spark.catalog.tableExists("part_t__old")
    sinks.drop_table(spark, "part_t")
