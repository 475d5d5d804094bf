"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits over word shingles, each bit the majority of that bit in
the shingles' XXH64 values. Search for all pairs within ``max_bits``: the 64
bits are dealt into m partitions, strongly correlated bits together; thresholds
t_1..t_m with sum ``max_bits - m + 1`` (each -1 or more, -1 unused) guarantee that
a pair within ``max_bits`` differs in at most t_i bits of some partition i. m and
the thresholds come from a dynamic program over the estimated candidate count
of every (partition, threshold), from bit statistics of *all* distinct
fingerprints. Each fingerprint is indexed under its exact partition values and
probes all values within t_i; candidates are verified on all 64 bits.

Scale: equal fingerprints are one class before the search. Probe rows are
grouped by (partition, value); a value with over ``BLOCK`` rows is split into
blocks and each pair of blocks is a group of its own, so no task holds a hot value.
A task verifies in numpy and returns a spanning forest of the links it found
(fewer rows than fingerprints), never the pairs; components come from star
contraction over those.

Cases: null, empty and blank texts have fingerprint zero and link like any
other; fewer words than a shingle form one shingle; equal rows share a
component; null ids take part, and a component's id is its smallest id that is
not null; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import materialize
from .common import fresh, only, roots, slices, words_of
from .components import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCK = 8192  # rows of one probed value that a task takes whole
GROUP_ROWS = 50_000  # probe rows in a task's group, about
ROW_COST, PAIR_COST = 1e-6, 1e-8  # seconds, for choosing the partitions

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _fingerprints(array, shingle: int) -> np.ndarray:
    """One uint64 per text."""
    from xxhash import xxh64_intdigest

    out = [np.zeros(0, np.uint64)]
    for _, data, offs in slices(array, 1 << 20):
        raw = data.tobytes().translate(_LOWER)
        starts, ends, counts = words_of(np.frombuffer(raw, np.uint8), offs)
        # the words again, one space between neighbours: a shingle is one range of bytes
        spaced = b" ".join(raw[offs[i]:offs[i + 1]] for i in range(len(offs) - 1))
        flat = b" ".join(spaced.split())
        size = ends - starts
        begin = np.append(0, np.cumsum(size + 1))[:-1]
        stop = begin + size
        n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
        first = np.cumsum(counts) - counts
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        last = np.minimum(at + shingle - 1, np.repeat(np.cumsum(counts) - 1, n))
        hashes = np.fromiter((xxh64_intdigest(flat[a:b], SEED) for a, b in zip(begin[at].tolist(), stop[last].tolist())),
                             np.uint64, len(at))
        prints = np.zeros(len(counts), np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            heads = (np.cumsum(n) - n)[some]
            sums = np.zeros((len(some), 64), np.int64)
            step = 1 << 15
            for lo in range(0, len(hashes), step):  # whole-text sums from bounded blocks of shingles
                bits = np.unpackbits(hashes[lo:lo + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                a = int(np.searchsorted(heads, lo, "right")) - 1
                b = int(np.searchsorted(heads, lo + len(bits)))
                cut = np.maximum(heads[a:b] - lo, 0)
                sums[a:b] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
            major = np.packbits(2 * sums > n[some][:, None], axis=1)
            prints[some] = major.view(">u8")[:, 0].astype(np.uint64)
        out.append(prints)
    return np.concatenate(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(``id_col``, ``fp`` as a signed long) for each row of ``docs``."""
    docs = only(docs, id_col, text_col)

    def prints(batches):
        for b in batches:
            fp = _fingerprints(b.column(1), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.mapInArrow(prints, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(count, 64 x 64 counts of both bits set) over all rows of ``prints``."""

    def counted(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.asarray(b.column(0)).astype(np.int64)
            bits = np.unpackbits(x.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))],
                                             names=["n", "both"])

    parts = prints.select("fp").mapInArrow(counted, "n long, both array<double>")
    cells = (parts.select(F.posexplode("both").alias("at", "both")).groupBy("at").agg(F.sum("both").alias("both"))
             .collect())  # 4096 rows whatever the input
    n = parts.agg(F.sum("n")).first()[0] or 0
    both = np.zeros(4096)
    for r in cells:
        both[r["at"]] = r["both"]
    return n, both.reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of nearly equal width, each grown from
    a free bit by the bit most correlated with the group."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        left = sorted(free)
        group = [max(left, key=lambda b: (corr[b, left].max(), -b))]
        free.remove(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: corr[b, group].mean())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def plan(n: int, both: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of least estimated cost with thresholds that sum to
    ``max_bits - m + 1``, over m partitions from 2 to ``max_bits + 1``."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)  # of two fingerprints, how often a bit differs
    best_cost, best = np.inf, None
    for m in range(2, max_bits + 2):
        groups = group_bits(n, both, m)
        costs = []
        for bits in groups:
            chance = np.array([1.0])  # distribution of the distance within the partition
            for b in bits:
                chance = np.convolve(chance, [1 - differ[b], differ[b]])
            upto = np.cumsum(chance)
            costs.append([0.0] + [n * sum(comb(len(bits), d) for d in range(t + 1)) * ROW_COST
                                  + n * n / 2 * upto[min(t, len(bits))] * PAIR_COST for t in range(max_bits + 1)])
        target = max_bits - m + 1
        table = {0: (0.0, [])}
        for cost in costs:  # thresholds -1, 0, 1, ... of this partition on top of the cheapest sums so far
            nxt: dict[int, tuple[float, list[int]]] = {}
            for done, (c, ts) in table.items():
                for t in range(-1, max_bits + 1):
                    new = (c + cost[t + 1], [*ts, t])
                    if done + t not in nxt or new[0] < nxt[done + t][0]:
                        nxt[done + t] = new
            table = nxt
        c, ts = table[target]
        if c < best_cost:
            best_cost, best = c, list(zip(groups, ts))
    return best


def _probe_rows(schemes):
    """mapInArrow function: fingerprints to (key, fp, exact) rows."""
    packed = []
    for k, (bits, t) in enumerate(schemes):
        if t < 0:
            continue
        shift = np.array([63 - b for b in bits], np.uint64)  # bit 0 of the statistics is the most significant
        masks = [0] + [sum(1 << i for i in c) for d in range(1, t + 1) for c in combinations(range(len(bits)), d)]
        packed.append((np.uint64(k) << np.uint64(48), shift, np.array(masks, np.uint64)))

    def rows(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for lo in range(0, len(fps), 4096):
                x = fps[lo:lo + 4096]
                for part, shift, masks in packed:
                    value = np.zeros(len(x), np.uint64)
                    for i, s in enumerate(shift):
                        value |= ((x >> s) & np.uint64(1)) << np.uint64(i)
                    key = (part | (value[:, None] ^ masks[None, :])).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.repeat(x.view(np.int64), len(masks))),
                         pa.array(np.tile(np.arange(len(masks)) == 0, len(x)))], names=["key", "fp", "exact"])

    return rows


def _verify(table: pa.Table, max_bits: int) -> pa.Table:
    """Links of a group of probe rows, as (fp, smallest fp of its local component)."""
    key, pair, block = (np.asarray(table[c].combine_chunks()) for c in ("key", "pair", "block"))
    fp = np.asarray(table["fp"].combine_chunks())
    exact = np.asarray(table["exact"].combine_chunks().cast(pa.int8())).astype(bool)
    order = np.lexsort((pair, key))
    key, pair, block, fp, exact = key[order], pair[order], block[order], fp[order], exact[order]
    new = np.append(True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))
    end = np.append(np.flatnonzero(new), len(key))[np.cumsum(new)]  # where the row's run ends
    nodes, node = np.unique(fp, return_inverse=True)
    bits = fp.view(np.uint64)

    def links():
        at, step = np.arange(len(key)), 1
        while True:  # each row with the row ``step`` further on in its run
            at = at[at + step < end[at]]
            if not len(at):
                return
            to = at + step
            near = np.bitwise_count(bits[at] ^ bits[to]) <= max_bits
            near &= exact[at] | exact[to]
            near &= (pair[at] < 0) | (block[at] != block[to]) | (pair[at] >> 20 == (pair[at] & 0xFFFFF))
            if near.any():
                yield node[at[near]], node[to[near]]
            step += 1

    root = roots(len(nodes), links())
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"u": pa.array(nodes[linked]), "v": pa.array(nodes[root[linked]])})


def link_forest(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) links between the distinct fingerprints ``fp`` of ``prints`` whose
    components are those of all pairs within ``max_bits`` differing bits."""
    n, both = bit_statistics(prints)
    schemes = plan(n, both, max_bits)
    rows = prints.select("fp").mapInArrow(_probe_rows(schemes), "key long, fp long, exact boolean")
    hot = rows.groupBy("key").count().where(F.col("count") > BLOCK)
    hot = materialize(hot.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")
    total = n * sum(sum(comb(len(b), d) for d in range(t + 1)) for b, t in schemes if t >= 0)
    rows = rows.join(hot, "key", "left").select(
        "key", "fp", "exact", "blocks", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")), F.lit(0)).cast("int").alias("block"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long")))
                      .otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda j: (
                          F.least("block", j).cast("long") * (1 << 20) + F.greatest("block", j).cast("long")))))
    rows = rows.withColumn("pair", other).drop("blocks")
    groups = max(256, total // GROUP_ROWS)
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("key", "pair"), F.lit(groups)))
    return rows.groupBy("_group").applyInArrow(lambda t: _verify(t, max_bits), "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``fp`` and ``component_id``, the smallest id
    reachable over fingerprints that differ in ``max_bits`` bits at most."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    root = materialize(connected_components(link_forest(classes, max_bits)), "roots")
    linked = classes.join(root, classes["fp"] == root["node"]).select("fp", "root", "least")
    first = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "first")
    named = materialize(linked.join(first, "root").select("fp", "component_id"), "named")
    label = materialize(classes.join(named, "fp", "left")
                        .select("fp", F.coalesce("component_id", "least").alias("component_id")), "label")
    return prints.join(label, "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component kept: that of the smallest id (of
    equal ids, one). Columns as they came."""
    columns = docs.columns
    row = fresh(docs, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keyed = rows.select(F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row"))
                        .alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    groups = simhash_groups(keyed, "_id", "_text", shingle, max_bits)
    gone = materialize(groups.where("_id.row <> component_id.row").select(F.col("_id.row").alias(row)), "gone")
    return rows.join(gone, row, "left_anti").select(*[f"`{c}`" for c in columns])
