"""Reproducible shuffle and sharding by a Feistel permutation of row numbers.

Rows get global numbers 0..n-1 in the order of (id, text checksum, size); a keyed
Feistel network over the smallest even-bit domain that holds n, applied again
while a value falls outside (cycle walking), permutes the numbers. Shard and
slot are the remainder and quotient of the permuted number by the shard count:
computable from the number alone, counts at most one apart (law ``rows``),
slots gapless.

Scale: only (id, size, checksum) rows are sorted, by range partitions; the global
number is the place in the partition plus the partition's offset, so no
task sees all rows. Equal rows are spread over the partitions: a random-looking but fixed tie
key (partition and place in the input scan) splits a hot id.

Cases: a null text has no bytes (size 1, checksum 0); null ids sort first;
equal rows get different slots in any order (they can't be told apart); an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import materialize
from .common import mix, only

SHARDS = 16
SEED = 17
ROUNDS = 6


def feistel(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The permuted place of each row number of ``x`` among 0..n-1 (bijective)."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(ROUNDS + 1))

    def once(v):
        left, right = v >> half, v & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << half) | right

    out = once(np.asarray(x).astype(np.uint64))
    while True:
        outside = out >= n
        if not outside.any():
            return out.astype(np.int64)
        out[outside] = once(out[outside])


def global_numbers(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """(``rows`` with ``_number`` 0..n-1 in the given order, n). Range partitions,
    written once, plus one offset per partition."""
    tie = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    spread = tie.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    tagged = materialize(spread.select("*", F.monotonically_increasing_id().alias("_at")).drop("_tie"), "numbers")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = {r["_part"]: r["n"] for r in tagged.groupBy(part).agg(F.count("*").alias("n")).collect()}  # a row per partition
    starts, n = {}, 0
    for p in sorted(sizes):
        starts[p], n = n, n + sizes[p]
    first = rows.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "_part long, _first long")
    numbered = tagged.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(first), "_part")
    number = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("_number", number).drop("_part", "_first", "_at"), n


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``size`` (bytes plus 1), ``text_crc32``,
    ``shard`` and ``slot``."""
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    light = only(docs, id_col, text_col).select(
        id_col, (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b""))).alias("text_crc32"))
    numbered, n = global_numbers(light, id_col, "text_crc32", "size")

    def placed(batches):
        for b in batches:
            to = feistel(np.asarray(b.column(3)), n, seed)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array((to % shards).astype(np.int32)), pa.array(to // shards)],
                names=[id_col, "size", "text_crc32", "shard", "slot"])

    kind = dict(light.dtypes)[id_col]
    return numbered.select(id_col, "size", "text_crc32", "_number").mapInArrow(
        placed, f"`{id_col}` {kind}, size long, text_crc32 long, shard int, slot long")
