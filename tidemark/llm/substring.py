"""Exact substring deduplication by fixed-block anchors.

Every aligned, non-overlapping block of ``(window + 1) // 2`` words is indexed
and every rolling window of that length probes the index: whatever word window
two places share holds, at one of them, a whole aligned block that the other
place probes. Each hit is then extended to the word windows around it, and the
windows that start in two or more places are kept; overlapping ones merge to
the maximal exact repeats, whose words are removed.

How it runs: texts are dealt into chunks of a few MB by a hash of the row. A
chunk sends, per hash bucket, its *distinct* block and probe fingerprints as one
packed row (4 bytes a word, so a passage that fills a third of the corpus
costs each chunk one entry, whatever its count). A bucket answers each chunk with
the fingerprints that hit. The chunk extends them and sends the 64-bit hashes
of the windows around them in the same way; the answers say which windows are
repeats. Nothing is paired, so a group of n copies costs n, not n squared.
Fingerprint collisions of the first step only add windows to the second one;
there a window is known by more than 64 hash bits (hash and bucket).

Cases: a null or empty text has no words (kept text ''); a text shorter than the
window keeps all; repeated rows repeat each other's passages; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import member, mix, only, slices, window_hashes, within, word_hashes, words_of

WINDOW = 35
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20

_PACKED = "_chunk int, _bucket int, _hashes binary, _flags binary"
_FOUND = "_chunk int, _hashes binary"


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper and a 32-bit fingerprint in the lower half."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _packed(chunk: int, bucket: np.ndarray, value: np.ndarray, flag: np.ndarray | None, width) -> pa.Table:
    """One row per bucket: the distinct values, with bit 0 set where a value
    came more than once and bit 1 where ``flag`` holds for one of them."""
    order = np.lexsort((value, bucket))
    bucket, value = bucket[order], value[order]
    n = len(value)
    first = np.ones(n, bool)
    if n:
        first[1:] = (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(first)
    many = np.diff(np.append(at, n)) > 1
    flags = many.astype(np.uint8)
    if flag is not None and n:
        flags |= np.logical_or.reduceat(flag[order], at).astype(np.uint8) << 1
    bucket, value = bucket[at], value[at].astype(width)
    cut = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else np.zeros(0, int)
    lows, highs = np.append(0, cut), np.append(cut, len(bucket))
    rows = [(lo, hi) for lo, hi in zip(lows, highs) if hi > lo]
    bits = [np.packbits(np.stack([flags[lo:hi] & 1, flags[lo:hi] >> 1])) for lo, hi in rows]
    return pa.table({"_chunk": pa.array([chunk] * len(rows), pa.int32()),
                     "_bucket": pa.array([int(bucket[lo]) for lo, _ in rows], pa.int32()),
                     "_hashes": pa.array([value[lo:hi].tobytes() for lo, hi in rows], pa.binary()),
                     "_flags": pa.array([b.tobytes() for b in bits], pa.binary())})


def _answers(table: pa.Table, width, wants_flag: bool) -> pa.Table:
    """Of one bucket: per chunk the values that start at two places at least
    (and, if wanted, of which one is an indexed block)."""
    parts, flags = [], []
    for h, f in zip(table["_hashes"], table["_flags"]):
        value = np.frombuffer(h.as_buffer(), width)
        bits = np.unpackbits(np.frombuffer(f.as_buffer(), np.uint8), count=2 * len(value))
        parts.append(value)
        flags.append(bits.reshape(2, -1))
    value, flag = np.concatenate(parts), np.concatenate(flags, axis=1)
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    hit = np.add.reduceat(1 + flag[0][order].astype(np.int64), at) > 1
    if wants_flag:
        hit &= np.logical_or.reduceat(flag[1][order].astype(bool), at)
    hits = ordered[at][hit]
    bucket = np.uint64(table["_bucket"][0].as_py())
    chunks, out = [], []
    for c, v in zip(table["_chunk"].to_pylist(), parts):
        found = v[member(v, hits)]
        if len(found):
            chunks.append(c)
            out.append(((bucket << np.uint64(32)) | found.astype(np.uint64) if wants_flag else found).tobytes())
    return pa.table({"_chunk": pa.array(chunks, pa.int32()), "_hashes": pa.array(out, pa.binary())})


def _hashed(text, block: int):
    """Per slice of a chunk: row, bytes, offsets, words per text, word hashes and rolling block hashes."""
    for lo, data, offs in slices(text):
        starts, ends, counts = words_of(data, offs)
        words = word_hashes(data, starts, ends)
        yield lo, data, offs, counts, words, window_hashes(words, block), within(counts, block)


def _joined(table: pa.Table) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(h.as_buffer(), np.uint64) for h in table["_hashes"]]
                                    or [np.zeros(0, np.uint64)]))


def _text(table: pa.Table):
    return table["_text"].combine_chunks() if table.num_rows else pa.array([], pa.string())


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that also starts
    elsewhere in ``docs`` (judged on the input). Returns one row per document:
    ``id_col``, ``text`` (kept words joined by one space), ``n_words``,
    ``n_removed`` and ``repeats`` (the maximal repeats as [first word, end))."""
    if window < 2:
        raise ValueError("window must be 2 words at least")
    block = (window + 1) // 2
    reach = window - block + 1  # anchors in a window
    docs = only(docs, id_col, text_col).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    size = docs.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    chunks = max(64, math.ceil(size / CHUNK_BYTES))
    buckets = max(256, math.ceil(size / BUCKET_BYTES))
    chunked = docs.select(F.pmod(F.xxhash64("_id", "_text"), F.lit(chunks)).cast("int").alias("_chunk"), "_id", "_text")

    def probes(table: pa.Table) -> pa.Table:
        chunk = table["_chunk"][0].as_py()
        keys, blocks = [], []
        for _, _, _, counts, words, rolling, whole in _hashed(_text(table), block):
            place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
            keys.append(_keys(rolling, buckets)[whole])
            blocks.append((place[:len(rolling)] % block == 0)[whole])
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        flag = np.concatenate(blocks) if blocks else np.zeros(0, bool)
        return _packed(chunk, key >> np.uint64(32), key & np.uint64(0xFFFFFFFF), flag, np.uint32)

    def extended(table: pa.Table, found: pa.Table) -> pa.Table:
        hits = _joined(found)
        bucket, value = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        if len(hits) and table.num_rows:
            for _, _, _, counts, words, rolling, whole in _hashed(_text(table), block):
                hit = member(_keys(rolling, buckets), hits) & whole
                if not hit.any():
                    continue
                near = np.append(0, np.cumsum(hit))
                fits = within(counts, window)
                at = np.flatnonzero(fits & (near[reach:][:len(fits)] > near[:len(fits)]))
                value.append(window_hashes(words, window)[at])
                bucket.append(window_hashes(words, window, "b")[at] % np.uint64(buckets))
        chunk = (found if not table.num_rows else table)["_chunk"][0].as_py()
        return _packed(chunk, np.concatenate(bucket), np.concatenate(value), None, np.uint64)

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        repeats = _joined(found)
        ids = table["_id"].combine_chunks() if table.num_rows else pa.array([], table["_id"].type)
        texts, n_words, n_removed, spans = [], [], [], []
        for lo, data, offs in slices(_text(table)):
            starts, ends, counts = words_of(data, offs)
            total = int(counts.sum())
            hit = np.zeros(0, bool)
            if len(repeats):
                hit = member(window_hashes(word_hashes(data, starts, ends), window), repeats)
                hit &= within(counts, window)
            cover = np.zeros(total + 1, np.int32)
            at = np.flatnonzero(hit)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover)[:total] > 0
            raw = data.tobytes()
            first = np.cumsum(counts) - counts
            lost = np.diff(np.append(0, np.cumsum(gone))[np.append(first, total)])
            for i in range(len(counts)):
                parts = raw[offs[i]:offs[i + 1]].split()
                span = []
                if lost[i]:
                    mask = gone[first[i]:first[i] + counts[i]]
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    span = [{"first": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])]
                    parts = [w for w, g in zip(parts, mask.tolist()) if not g]
                texts.append(b" ".join(parts))
                spans.append(span)
            n_words.append(counts)
            n_removed.append(lost)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "_id": ids, "text": pa.array(texts, pa.binary()).cast(pa.string()),
            "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
            "n_removed": pa.array(np.concatenate(n_removed) if n_removed else [], pa.int64()),
            "repeats": pa.array(spans, kind)})

    by_chunk = chunked.groupBy("_chunk")
    hits = (by_chunk.applyInArrow(probes, _PACKED).groupBy("_bucket")
            .applyInArrow(lambda t: _answers(t, np.uint32, True), _FOUND))
    found = (by_chunk.cogroup(hits.groupBy("_chunk")).applyInArrow(extended, _PACKED).groupBy("_bucket")
             .applyInArrow(lambda t: _answers(t, np.uint64, False), _FOUND))
    kind = dict(docs.dtypes)["_id"]
    schema = f"_id {kind}, text string, n_words long, n_removed long, repeats array<struct<first:long,end:long>>"
    return by_chunk.cogroup(found.groupBy("_chunk")).applyInArrow(cut, schema).withColumnRenamed("_id", id_col)
