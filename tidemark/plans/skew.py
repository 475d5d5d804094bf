"""Skew check from Spark's event log (developer tool).

usage: python -m tidemark.plans.skew [sf_dir]

Derives a copy of the orders view in which one user holds a third of all
rows (every third order is re-assigned to user 7) and a copy of lineitem in
which one part holds a third of all lines, writes them to a scratch folder,
runs the user-keyed operators and a sales aggregate over them with the event
log on and broadcasting off, and prints, for every stage that reads shuffle
data, the records read by the busiest task against the median task. With
map-side partial aggregation the hot user reaches the reduce side as one row
per map task; the hot part's join partition is split by AQE's skew-join
handling (its threshold is lowered here to this data size).
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _stage_stats(log_root: str) -> dict[int, list[int]]:
    """Shuffle records read per task, by stage, from every event-log file under ``log_root``."""
    per_stage: dict[int, list[int]] = {}
    files = [f for f in glob.glob(os.path.join(log_root, "**", "*"), recursive=True) if os.path.isfile(f)]
    for log_path in files:
        with open(log_path, encoding="utf-8") as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = ev.get("Task Metrics") or {}
                rec = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                if rec:
                    per_stage.setdefault(ev["Stage ID"], []).append(rec)
    return per_stage


def main(argv: list[str]) -> None:
    from tidemark.functions.periods import Span
    from tidemark.operators import grades, lapse, sales
    from tidemark.plans import params as P
    from tidemark.sources.tables import read_table
    from tidemark.sources.views import orders_view, sales_from

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="tidemark-skew-")
    logs = os.path.join(scratch, "events")
    os.makedirs(logs)
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logs)
             .config("spark.eventLog.compress", "false")
             # the skewed join partition here is small; lower AQE's skew threshold to this data size
             .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "256k")
             .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
             .config("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    path = os.path.join(scratch, "orders_skewed")
    (orders_view(spark, sf_dir)
     .withColumn("user_id", F.when(F.col("order_id") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("user_id")))
     .repartition(16).write.parquet(path))  # 16 files: several map tasks, as any large scan has
    o = spark.read.parquet(path)
    jobs = {
        "grade_by_spend": lambda: grades.grade_by_spend(o),
        "lapsed": lambda: lapse.lapsed(o, P.LAPSE_ACTIVE, P.LAPSE_SILENT),
        "cohort_trend": lambda: lapse.cohort_trend(
            o, lapse.consistent_counts(o, P.CONSISTENT_SPAN, P.CONSISTENT_GRAIN, P.CONSISTENT_K), P.TREND_SINCE),
        "with_last_order": lambda: lapse.with_last_order(
            lapse.recent_buyers(o, Span("1998-01-01", None)).withColumn("spending_grade", F.lit("x")), o),
    }
    # sales lines: every third line of lineitem re-assigned to part 1
    li_path = os.path.join(scratch, "lineitem_skewed")
    (read_table(spark, sf_dir, "lineitem")
     .withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("l_partkey")))
     .repartition(16).write.parquet(li_path))
    skewed_sales = sales_from(spark.read.parquet(li_path), read_table(spark, sf_dir, "part"),
                              read_table(spark, sf_dir, "supplier"))
    jobs["compare_before_after (sales join)"] = lambda: sales.compare_before_after(skewed_sales, P.SALES_CUT)
    sc = spark.sparkContext
    groups = {}
    for name, build in jobs.items():
        sc.setJobGroup(name, name)
        build().write.format("noop").mode("overwrite").save()
        groups[name] = set()
        for j in sc.statusTracker().getJobIdsForGroup(name):
            info = sc.statusTracker().getJobInfo(j)
            groups[name].update(info.stageIds if info else [])
    spark.stop()
    stats = _stage_stats(logs)
    print("| operator | stage | tasks | max records / task | median | max / median |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, stages in groups.items():
        for st in sorted(stages):
            recs = stats.get(st)
            if not recs or len(recs) < 2:
                continue
            med = statistics.median(recs)
            print(f"| {name} | {st} | {len(recs)} | {max(recs)} | {med:g} | {max(recs) / med:.2f} |")


if __name__ == "__main__":
    main(sys.argv)
