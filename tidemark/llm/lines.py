"""Cross-site boilerplate lines, by distinct-site spread.

Every line (trimmed of ASCII white space) is known by two 64-bit hashes. Per line
a HyperLogLog sketch of the sites it stands on is built and merged by
aggregation, map-side first, so a line of a third of all documents costs a sketch per
task. Lines whose estimate lies clear of the limit are decided by it; those near the
limit get an exact distinct count of their sites. A line on ``sites`` sites or
more is boilerplate: it stays at its first occurrence (smallest id, then
position) and goes from everywhere else, so no content is lost whole when
documents are copies of each other across sites.

Scale: the work runs on (hash, site, place) rows, written once. The boilerplate
lines are counted: up to ``broadcast_lines`` of them go to every task, which finds
the positions to drop while it scans the texts, and no text is shuffled. Of more lines,
the positions are joined to the texts by document (written tables, so Spark knows the
sizes, and splits hot keys). Both ways give the same rows.

Cases: a null text stays null and an empty one empty; lines of fewer than
``min_words`` words (blank ones too) are layout, never boilerplate; a null site
is no site; of rows equal in id and text all keep a line that one of them keeps; an empty
table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import materialize
from .common import fresh, only, ship

SITES = 10
MIN_WORDS = 3
LG_K = 12
BROADCAST_LINES = 250_000  # about 25 MB in a task
BAND = 0.1  # share of the limit within which an estimate is not trusted (over 5 standard errors)

_BLANK = " \t\r\x0b\x0c"


def _drop_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for t, g in zip(text, gone):
        if t is None or g is None:
            out.append(t)
            continue
        g = set(g)
        out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in g))
    return pd.Series(out, dtype=object)


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int) -> DataFrame:
    """(id, key, pos, site, a, b): one row per line of ``min_words`` words or more."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"),
                        F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(_BLANK)))
    words = F.size(F.split("line", "[ \\t\\r\\x0b\\x0c]+"))
    return lines.where((F.col("line") != "") & (words >= min_words)).select(
        "id", "key", "pos", "site", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(a, b, first_id, first_key, first_pos) of the lines on ``sites`` sites or more."""
    spread = materialize(lines.groupBy("a", "b").agg(
        F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("id", "key", "pos")).alias("first"))
        .select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("estimate"))
        .where(F.col("estimate") >= sites * (1 - BAND) - 1), "spread")
    near = spread.where(F.col("estimate") <= sites * (1 + BAND) + 1)
    exact = (lines.join(near.select("a", "b"), ["a", "b"], "left_semi").where("site is not null")
             .select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("n"))
             .where(F.col("n") >= sites).select("a", "b"))
    found = spread.where(F.col("estimate") > sites * (1 + BAND) + 1).unionByName(near.join(exact, ["a", "b"]))
    return found.select("a", "b", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"),
                        F.col("first.pos").alias("first_pos"))


def _id_text(c: str) -> Column:
    """An id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def kept_in_scan(known: pd.DataFrame, docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Which lines of each text stay (null: all), looked up in the broadcast lines
    ``known``: a (distinct), b, first_id, first_key, first_pos."""
    known = known.sort_values("a")
    table = docs.sparkSession.sparkContext.broadcast(
        {c: known[c].to_numpy(object if c == "first_id" else np.int64) for c in known.columns})

    def kept(ids: pd.Series, keys: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        t, out = table.value, [None] * len(a)
        sizes = np.array([0 if x is None else len(x) for x in a], np.int64)
        if sizes.sum():
            a, b = (np.concatenate([x for x in part if x is not None]) for part in (a, b))
            at = np.minimum(np.searchsorted(t["a"], a), len(t["a"]) - 1)
            hits = np.flatnonzero((t["a"][at] == a) & (t["b"][at] == b))
            at, row = at[hits], np.repeat(np.arange(len(sizes)), sizes)[hits]
            pos = hits - (np.cumsum(sizes) - sizes)[row]
            first = ((t["first_pos"][at] == pos) & (t["first_key"][at] == keys.to_numpy()[row])
                     & (t["first_id"][at] == ids.to_numpy(object)[row]).astype(bool))
            row, pos = row[~first], pos[~first]
            where, starts = np.unique(row, return_index=True)
            for r, p in zip(where, np.split(pos, starts[1:])):
                out[r] = np.ones(sizes[r], bool)
                out[r][p] = False
        return pd.Series(out, dtype=object)

    trimmed = F.transform(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)))
    return F.pandas_udf(kept, "array<boolean>").asNondeterministic()(
        _id_text(f"`{id_col}`"), F.xxhash64(f"`{text_col}`"), F.transform(trimmed, lambda x: F.xxhash64(x)),
        F.transform(trimmed, lambda x: F.xxhash64(F.lit(1), x)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
               sites: int = SITES, min_words: int = MIN_WORDS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` without repeated cross-site boilerplate lines, and with ``_ld_lines``
    (lines before) and ``_ld_removed`` (lines removed)."""
    only(docs, id_col, text_col, site_col)
    ship(docs.sparkSession)
    lines = materialize(line_table(docs, id_col, text_col, site_col, min_words), "lines")
    found = materialize(boilerplate(lines, sites), "boilerplate")
    text, known = F.col(f"`{text_col}`"), None
    if found.count() <= broadcast_lines:
        known = found.select("a", "b", _id_text("first_id").alias("first_id"), "first_key", "first_pos").toPandas()
    if known is not None and known["a"].is_unique:
        mark = fresh(docs, "_ld_kept")
        kept = kept_in_scan(known, docs, id_col, text_col) if len(known) else F.lit(None).cast("array<boolean>")
        marked = docs.withColumn(mark, kept)
        rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: F.get(F.col(mark), i)), "\n")
        removed = F.size(F.filter(mark, lambda stays: ~stays))
    else:
        mark = fresh(docs, "_ld_gone")
        here = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")) & (F.col("pos") == F.col("first_pos"))
        gone = materialize(lines.join(found, ["a", "b"]).where(~here).groupBy("id", "key")
                           .agg(F.array_sort(F.collect_set("pos")).alias(mark)), "gone")
        gone = gone.withColumnsRenamed({"id": "_ld_id", "key": "_ld_key"})
        marked = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("_ld_id")) & (F.xxhash64(text_col) == F.col("_ld_key")), "left")
        rest = F.pandas_udf(_drop_lines, "string")(F.when(F.col(mark).isNotNull(), text), mark)
        removed = F.size(F.col(mark))
    some = F.col(mark).isNotNull()
    cleaned = F.when(some, rest).otherwise(text)
    n = F.coalesce(F.length(text_col) - F.length(F.translate(text_col, "\n", "")) + 1, F.lit(0)).cast("long")
    return marked.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], n.alias("_ld_lines"),
                         F.when(some, removed).otherwise(0).cast("long").alias("_ld_removed"))
