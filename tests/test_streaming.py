import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF01
from tidemark.sources.tables import SCHEMAS, read_table
from tidemark.streaming import append_new_files


def test_append_new_files_exactly_once(spark):
    root = tempfile.mkdtemp(prefix="tidemark-stream-")
    src, dst = os.path.join(root, "in"), os.path.join(root, "out")
    ev = read_table(spark, SF01, "events")
    ev.filter(F.col("event_id") < 4000).write.parquet(os.path.join(src, "a"))
    ckpt = os.path.join(root, "ckpt")
    only_purchases = lambda df: df.filter(F.col("event_type") == "purchase")
    append_new_files(spark, os.path.join(src, "a"), SCHEMAS["events"], dst, ckpt, only_purchases)
    first = ev.filter((F.col("event_id") < 4000) & (F.col("event_type") == "purchase")).count()
    assert spark.read.parquet(dst).count() == first
    append_new_files(spark, os.path.join(src, "a"), SCHEMAS["events"], dst, ckpt, only_purchases)
    assert spark.read.parquet(dst).count() == first
    # a later application: another session, whose own checkpoint folder differs, finds new files
    later = spark.newSession()
    ev.filter(F.col("event_id").between(4000, 4999)).write.mode("append").parquet(os.path.join(src, "a"))
    append_new_files(later, os.path.join(src, "a"), SCHEMAS["events"], dst, ckpt, only_purchases)
    assert spark.read.parquet(dst).count() == ev.filter((F.col("event_id") < 5000) & (F.col("event_type") == "purchase")).count()


def test_appended_orders_feed_batch_operators(spark):
    from tidemark.functions.periods import Span
    from tidemark.operators import acquisition
    from tidemark.sources.views import events_view

    root = tempfile.mkdtemp(prefix="tidemark-stream-")
    src, dst = os.path.join(root, "in"), os.path.join(root, "out")
    read_table(spark, SF01, "events").write.parquet(src)
    as_orders = lambda df: df.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("order_id"), F.col("value").alias("amount"), "ts")
    append_new_files(spark, src, SCHEMAS["events"], dst, os.path.join(root, "ckpt"), as_orders)
    span = Span("2024-01-01", "2024-02-01", closed=False)
    incremental = sorted(tuple(r) for r in acquisition.monthly_totals(spark.read.parquet(dst), span, "day").collect())
    batch = sorted(tuple(r) for r in acquisition.monthly_totals(events_view(spark, SF01, "purchase"), span, "day").collect())
    assert incremental == batch and len(batch) > 20
