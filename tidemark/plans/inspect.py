"""Physical-plan summaries of the registered queries (developer tool).

usage: python -m tidemark.plans.inspect [sf_dir] > PLANS.md

For each query, two plans are summarised: the default one, and one with
broadcasting off, which is what a 100 TB run sees when the smaller side of a
join no longer fits under the broadcast threshold.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame


def main_tree(df: DataFrame) -> str:
    """The operator tree of ``explain("formatted")``, without subqueries and details."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return text.split("\n\n\n")[0]


def summarize(df: DataFrame) -> dict:
    """Counts over the main plan only (subqueries run once each and are listed apart)."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    main, _, subs = text.partition("===== Subqueries =====")
    tree = main.split("\n\n\n")[0]
    details = re.split(r"\n\(\d+\) ", main)
    exchanges = [d for d in details if d.startswith("Exchange")]
    return {
        "shuffles": sum(1 for d in exchanges if re.search(r"Arguments: (hash|range)partitioning", d)),
        "single": sum(1 for d in exchanges if "Arguments: SinglePartition" in d),
        "broadcasts": tree.count("BroadcastExchange"),
        "smj": tree.count("SortMergeJoin"),
        "scans": tree.count("Scan parquet"),
        "windows": tree.count("Window ("),
        "subqueries": len(set(re.findall(r"Subquery:(\d+)", subs))),
        "pushed": bool(re.search(r"PushedFilters: \[[^\]]*(GreaterThan|LessThan|EqualTo)", main)),
    }


def main(argv: list[str]) -> None:
    from tidemark.plans.catalog import QUERIES
    from tidemark.session import get_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    print("| query | shuffles (default / no broadcast) | broadcasts | sort-merge joins at scale | scans | "
          "single-task exchanges | windows | distinct subqueries | range filter pushed |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name, q in QUERIES.items():
        a = summarize(q(spark, sf_dir))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        b = summarize(q(spark, sf_dir))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        print(f"| `{name}` | {a['shuffles']} / {b['shuffles']} | {a['broadcasts']} | {b['smj']} | {a['scans']} | "
              f"{a['single']} | {a['windows']} | {a['subqueries']} | {'yes' if a['pushed'] else 'no'} |")


if __name__ == "__main__":
    main(sys.argv)
