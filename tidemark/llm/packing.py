"""Best-fit packing of token pieces into fixed-length sequences.

Documents become token ids (and one end id); those longer than a sequence are
cut into full ones and a rest. Pieces above a third of the capacity are large:
two at most share a sequence, and pairing the largest left with the largest
partner that fits uses the fewest sequences. Pieces below best-fit the remaining gaps, longest
first, each into the smallest gap that takes it; what fits nowhere opens new
sequences.

Scale: the plan depends only on how many pieces there are of each length, at
most ``capacity`` numbers, so it is made on the driver from that histogram for
all pieces at once, in runs ("k sequences take m pieces of this length at this
offset"); its size follows the capacity, not the input. Pieces are numbered within
their length by (length, salt) groups plus offsets, so a length that a third of
all pieces have is many groups, and find their sequence and offset by a join
with the runs of their length. Token ids never leave the task that made them, but for
their checksum.

Cases: null and empty texts are one end id; a very long text is many pieces;
ties are broken by the number within the length; repeated rows are packed one
by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.relational import materialize
from .common import only, slices, word_hashes, words_of

CAPACITY = 4096
END_ID = 1
KNOWN = 200_000  # pretokens whose ids a worker remembers, to twice as many
TOKEN_SLICE = 1 << 18  # text bytes whose distinct words are looked up at once
SALT_ROWS = 1_000  # pieces of one length in a numbering group, about


#: how byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SPELL = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)  # ASCII punctuation without the apostrophe
_MARK[[b for b in range(33, 127) if b != 39 and not chr(b).isalnum()]] = True


def _folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z and the Latin capitals of U+00C0 to U+00DE in lower case, and which
    of them belong to letters of these two ranges."""
    low = _LOWER[data]
    letter = _LETTER[low]
    lead = np.flatnonzero(low[:-1] == 0xC3)
    after = low[lead + 1]
    capital = (after <= 0x9E) & (after != 0x97)
    low[lead[capital] + 1] += 0x20
    both = lead[(after != 0x97) & (after != 0xB7)]  # the signs of times and division are no letters
    letter[both] = letter[both + 1] = True
    return low, letter


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _same(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each pair of ranges of ``sizes`` (1 at least): are the bytes equal?"""
    if not len(sizes):
        return np.zeros(0, bool)
    return np.logical_and.reduceat(a[_spread(a_at, sizes)] == b[_spread(b_at, sizes)], np.cumsum(sizes) - sizes)


class _Memory:
    """Ids of byte strings, found by 64-bit hash and checked byte by byte."""

    def __init__(self):
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted, and which entry it is
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.text_at, self.ids_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def find(self, keys, data, starts, sizes) -> np.ndarray:
        """The entry of each string, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        out = np.where(self.keys[at] == keys, self.entry[at], -1)
        hit = np.flatnonzero(out >= 0)
        e = out[hit]
        good = np.diff(self.text_at)[e] == sizes[hit]
        good[good] = _same(self.text, self.text_at[e[good]], data, starts[hit[good]], sizes[hit[good]])
        out[hit[~good]] = -1
        return out

    def add(self, keys, data, starts, sizes, ids: np.ndarray, counts: np.ndarray) -> None:
        """Strings that ``find`` did not find, with their ids one after the other."""
        order = np.argsort(keys, kind="stable")
        place = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, place, keys[order])
        self.entry = np.insert(self.entry, place, order + len(self.text_at) - 1)
        self.text = np.append(self.text, data[_spread(starts, sizes)])
        self.ids = np.append(self.ids, ids)
        self.text_at = np.append(self.text_at, self.text_at[-1] + np.cumsum(sizes))
        self.ids_at = np.append(self.ids_at, self.ids_at[-1] + np.cumsum(counts))


class WordTokenizer:
    """Ids of a lower-casing byte-level BPE tokenizer that splits at white space before
    all else. A word that is Latin letters and then punctuation is two pretokens, so the library's BPE
    model takes those directly, without its normaliser and splitter; any other word goes through the whole
    tokenizer. Each distinct pretoken or word of a slice of texts is looked up once, among the last ``KNOWN`` to twice as many."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core alone
        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = self.tokenizer.model
        self.new, self.old = _Memory(), _Memory()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def _encode(self, unit: bytes, plain: bool) -> list[int]:
        if not plain:
            return self._whole(unit)
        return [t.id for t in self.bpe.tokenize(unit.decode() if unit.isascii() else "".join(map(_SPELL.get, unit)))]

    def _known(self, keys, data, starts, sizes, plain) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct strings one after the other, how many each has)."""
        if len(self.new.keys) >= KNOWN:
            self.new, self.old = _Memory(), self.new
        entry, earlier = self.new.find(keys, data, starts, sizes), self.old.find(keys, data, starts, sizes)
        miss = np.flatnonzero((entry < 0) & (earlier < 0))
        raw, flat, counts = data.tobytes(), array("I"), np.zeros(len(miss), np.int64)
        for i, (a, n, p) in enumerate(zip(starts[miss].tolist(), sizes[miss].tolist(), plain[miss].tolist())):
            ids = self._encode(raw[a:a + n], p)
            flat.extend(ids)
            counts[i] = len(ids)
        learnt = np.array(flat, np.uint32)
        at, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        pool = [self.new.ids, self.old.ids, learnt]
        for found, memory, base in ((entry, self.new, 0), (np.where(entry < 0, earlier, -1), self.old, len(pool[0]))):
            hit = found >= 0
            at[hit] = base + memory.ids_at[found[hit]]
            size[hit] = np.diff(memory.ids_at)[found[hit]]
        at[miss], size[miss] = len(pool[0]) + len(pool[1]) + np.cumsum(counts) - counts, counts
        out = np.concatenate(pool)[_spread(at, size)]
        if len(miss):
            self.new.add(keys[miss], data, starts[miss], sizes[miss], learnt, counts)
        return out, size

    def ids(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Ids of each text of a slice (UTF-8 bytes and offsets), as little-endian unsigned 32-bit numbers."""
        starts, ends, counts = words_of(data, offs)
        low, letter = _folded(data)
        # a word's letters end after its last byte that is no mark
        last = np.maximum.accumulate(np.where(_MARK[low], 0, np.arange(1, len(low) + 1)))
        middle = np.maximum(last[ends - 1], starts) if len(ends) else ends
        odd = np.append(0, np.cumsum(~letter))
        plain = (middle > starts) & (odd[middle] == odd[starts])
        middle = np.where(plain, middle, ends)
        # units in the order of the text: the letters (or the odd word), then the marks if any
        two = middle < ends
        place = np.arange(len(starts)) + np.append(0, np.cumsum(two))[:-1]
        units = len(starts) + int(two.sum())
        begin, end, kind = np.zeros(units, np.int64), np.zeros(units, np.int64), np.ones(units, bool)
        begin[place], end[place], kind[place] = starts, middle, plain
        begin[place[two] + 1], end[place[two] + 1] = middle[two], ends[two]
        size = end - begin
        keys = word_hashes(low, begin, end) ^ np.where(kind, np.uint64(0), np.uint64(0x5851F42D4C957F2D))
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if not ((size[first][back] == size).all() and _same(low, begin[first][back], low, begin, size).all()):
            first = back = np.arange(units)  # two strings of one hash: none stands for another
        flat, n = self._known(keys[first], low, begin[first], size[first], kind[first])
        at, n = (np.cumsum(n) - n)[back], n[back]
        found = flat[_spread(at, n)].astype("<u4").tobytes()
        until = np.append(0, np.cumsum(n))
        words = np.append(0, np.cumsum(counts))
        cut = (4 * until[np.append(place, units)[words]]).tolist()
        out = [found[a:b] for a, b in zip(cut, cut[1:])]
        raw = data.tobytes()
        if any(s in raw for s in self.special):  # these may stand inside words
            for i, (a, b) in enumerate(zip(offs.tolist(), offs[1:].tolist())):
                if any(s in raw[a:b] for s in self.special):
                    out[i] = np.array(self._whole(raw[a:b]), "<u4").tobytes()
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32) for every piece of every document.
    ``tokenizer``: file that every worker can read."""
    docs = only(docs, id_col, text_col)

    def cut(batches):
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = WordTokenizer(tokenizer)
        encode, end = _TOKENIZERS[tokenizer].ids, np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            n = 0
            for _, data, offs in slices(b.column(1), TOKEN_SLICE):
                for token in encode(data, offs):
                    token += end
                    for k, at in enumerate(range(0, len(token), 4 * capacity)):
                        part = token[at:at + 4 * capacity]
                        ids.append(n)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                    n += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return docs.mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, pieces, first sequence, pieces in a sequence, offset)
    that place the pieces numbered 0.. of each length: piece p of a run stands in
    sequence ``first + p // m``, as number ``p % m`` from the offset on."""
    left = dict(sorted((k, v) for k, v in counts.items() if v > 0))
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: [(first sequence, sequences)]
    sizes: list[int] = []  # the gaps there are, sorted
    sequences = 0

    def put(length, sequence, n, m, offset):
        """n pieces, m to a sequence."""
        runs.append((length, used[length], n, sequence, m, offset))
        used[length] += n
        left[length] -= n

    def gap(size, sequence, n):
        if size and n:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            heapq.heappush(gaps[size], (sequence, n))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    smaller = large[::-1]
    for a in large:
        while left[a]:
            i = bisect_left(smaller, capacity - a + 1) - 1
            while i >= 0 and not (left[smaller[i]] > (smaller[i] == a)):
                i -= 1
            if i < 0:
                n = left[a]
                put(a, sequences, n, 1, 0)
                gap(capacity - a, sequences, n)
            elif smaller[i] == a:
                n = left[a] // 2
                put(a, sequences, 2 * n, 2, 0)
                gap(capacity - 2 * a, sequences, n)
            else:
                b = smaller[i]
                n = min(left[a], left[b])
                put(a, sequences, n, 1, 0)
                put(b, sequences, n, 1, a)
                gap(capacity - a - b, sequences, n)
            sequences += n
        smaller = [k for k in smaller if k != a and left[k]]
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[a]:
            i = bisect_left(sizes, a)
            if i == len(sizes):
                m = capacity // a
                full = -(-left[a] // m)
                gap(capacity, sequences, full)
                sequences += full
                continue
            size = sizes[i]
            first, n = heapq.heappop(gaps[size])
            if not gaps[size]:
                del gaps[size], sizes[i]
            m = min(size // a, left[a])
            k = min(n, left[a] // m)  # sequences that take m pieces each
            put(a, first, k * m, m, capacity - size)
            gap(size - m * a, first, k)
            gap(size, first + k, n - k)
    return runs


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``pieces`` with their place: ``sequence_id`` and ``offset``."""
    cut = materialize(pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = cut.sparkSession.createDataFrame(plan(counts, capacity) or [(0, 0, 0, 0, 1, 0)],
                                            "length long, _from long, _n long, _sequence long, _m long, _offset long")
    # a length's pieces are numbered in groups of about SALT_ROWS; a row for each length, so capacity rows at most
    split = cut.sparkSession.createDataFrame([(n, -(-k // SALT_ROWS)) for n, k in counts.items()], "length long, _salts long")
    place = (F.col(id_col), F.col("piece"), F.col("ids_crc32"))
    salted = cut.join(F.broadcast(split), "length").withColumn("_salt", F.pmod(F.xxhash64(*place), F.col("_salts")).cast("int")).drop("_salts")
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_size"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    # lengths + pieces / SALT_ROWS rows at most
    base = materialize(sizes.select("length", "_salt", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base")), "base")
    within = F.row_number().over(W.partitionBy("length", "_salt").orderBy(*place))
    numbered = salted.withColumn("_at", within).join(base, ["length", "_salt"]).withColumn("_at", F.col("_at") - 1 + F.col("_base"))
    inside = (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + F.col("_n"))
    # runs: bounded by the capacity, see plan()
    placed = numbered.join(F.broadcast(runs.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & inside)
    nth = F.col("_at") - F.col("_from")
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_m"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(nth, F.col("_m")) * F.col("length")).cast("long").alias("offset"))
