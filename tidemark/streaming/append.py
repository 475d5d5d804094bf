"""Append newly arrived files to a dataset, exactly once (SRC9, incremental)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def append_new_files(spark: SparkSession, source_dir: str, schema: T.StructType, target_dir: str,
                     checkpoint_location: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                     fmt: str = "parquet") -> None:
    """Append every file in ``source_dir`` not seen before to ``target_dir``.

    Runs one ``availableNow`` trigger. ``checkpoint_location`` is a shared folder that
    belongs to this source and target and is the same in every application: with it
    and the file sink's commit log a re-run, in the same application or a
    later one, appends what is new and nothing twice. ``transform`` must be a per-row projection or filter (for example
    a view such as ``orders_view`` minus its read); aggregates belong to the
    batch operators that read ``target_dir``.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    if transform is not None:
        stream = transform(stream)
    query = (stream.writeStream.format("parquet")
             .option("path", target_dir)
             .option("checkpointLocation", checkpoint_location)
             .outputMode("append")
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()
