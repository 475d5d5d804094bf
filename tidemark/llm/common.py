"""Helpers shared by the training-data operators: Arrow text slices, word
boundaries, word and window hashes (numpy, vectorised), column checks."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20  # text bytes worked on at once inside a task

#: ASCII white space: the separators of the word rule ``[^\x20\x09-\x0D]+``
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_LETTER = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = {"byte": 0x9E3779B97F4A7C15, "a": 0xD6E8FEB86659FD93, "b": 0xCA9B0E4F2D7531A5}
_POWERS: dict[tuple[str, bool], np.ndarray] = {}


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package (once per application), so that they
    need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-py-"), "tidemark_workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._tidemark_shipped = True


def need(df: DataFrame, *names: str) -> None:
    """Raise when a column the operator reads is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns cannot clash."""
    need(df, *names)
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def powers(kind: str, n: int, inverse: bool = False) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64 (or of the inverse of the base)."""
    known = _POWERS.get((kind, inverse))
    if known is None or len(known) < n:
        base = pow(_BASE[kind], -1, 2**64) if inverse else _BASE[kind]
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 2 * SLICE_BYTES:
            _POWERS[(kind, inverse)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), as uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; null counts as empty."""
    import pyarrow as pa

    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = array.buffers()
    offs = np.frombuffer(offs, kind)[array.offset:array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(array, limit: int = SLICE_BYTES):
    """Yield (first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, offs = utf8(array)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def words_of(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE):
    """(start, end, words per text) of the maximal runs of non-space bytes; no word crosses a text."""
    n = len(data)
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal for equal words wherever they stand."""
    n = len(data)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * powers("byte", n), out=run[1:])
    h = (run[ends] - run[starts]) * powers("byte", n, True)[starts] if n else np.zeros(0, np.uint64)
    return mix(h + (ends - starts).astype(np.uint64) * _U(0x632BE59BD9B4E019))


def window_hashes(words: np.ndarray, length: int, kind: str = "a") -> np.ndarray:
    """Hash of every ``length`` consecutive entries of ``words`` (fewer entries: none)."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(kind, n), out=run[1:])
    return mix((run[length:] - run[:n - length + 1]) * powers(kind, n, True)[:n - length + 1])


def within(counts: np.ndarray, length: int) -> np.ndarray:
    """For the windows of ``window_hashes``: does the window stay inside one text?"""
    n = int(counts.sum())
    if n < length:
        return np.zeros(0, bool)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    return (left >= length)[:n - length + 1]


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted array ``ordered``."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def roots(n: int, pairs) -> np.ndarray:
    """Smallest index of the component of each of ``n`` nodes; ``pairs`` yields (u, v) arrays."""
    parent = np.arange(n)
    for u, v in pairs:
        while True:
            a, b = parent[u], parent[v]
            open_ = a != b
            if not open_.any():
                break
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            parent[np.maximum(a, b)] = np.minimum(a, b)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent
