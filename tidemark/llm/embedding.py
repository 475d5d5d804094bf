"""Embedding near-duplicates with product quantisation.

Equal vectors form one class first. A coarse k-means deals the classes into
inverted lists; each keeps the product-quantised code of its residual and the
length of the error that the code leaves. Let r be the radius that the cosine
limit allows. A vector of list b lies nearer to centroid b than to any other, so a query
must cross the bisecting plane between b and each of its own nearest centroids to reach
it. The query probes every list whose planes are all within r, so no link can be
missed. ``spread`` = s is an opt-in that looks at fewer lists: of a difference of length r
in a *random* direction, the part across a given plane has the standard deviation
r / sqrt(dim), and only planes within s such deviations are crossed. Where differences
have a few strong directions it loses links. In a
list, the distance to a code (the sum of its subspaces' table entries) is that to the
decoded vector, so a block's distances are one matrix product; a candidate
is one whose code is at most r plus the code's error away, which by the
triangle inequality misses no vector within r. Exact double cosines rerank the
candidates. Centroids and codebooks are fitted on at most ``SAMPLE`` vectors,
those of smallest hash; every vector is indexed.

Scale: neighbouring lists form groups. A vector goes once to each group that holds a
list it probes, with a bit for each of the group's lists, so the rows dealt per vector
follow the number of groups (``GROUPS``; more only where groups would pass
``INDEX_BLOCK`` vectors) and of the parts of a group's queries, not that of the lists. The pairs compared still grow
nearly with the square where planes prune little, as with vectors without clusters.
A pair is looked at from its lower list only. Groups (and the queries of
a group) beyond a block size are split, so a hot list is many blocks. Tasks
return link counts and a spanning forest, never the pairs; components come
from star contraction. The driver sees the sample and one row per list.

Cases: null, empty and zero vectors and those with null or non-finite
components link with nothing; vectors of unequal length don't link; equal
vectors link whatever their ids; repeated ids stay separate rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import materialize
from .common import only, roots
from .components import connected_components

COSINE = 0.95
SAMPLE = 20_000
MOST_LISTS = 4096
SUBSPACES, CODES = 8, 256
GROUPS = 16  # of neighbouring lists, at least
INDEX_BLOCK, QUERY_BLOCK = 16384, 16384
PRODUCT = 1 << 18  # entries of a product of queries and codes
NEAREST = 6  # centroids whose bisecting planes are tried


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision without overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres (at most one per row of x); an empty one moves to the row farthest off."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = _squares(x, centres)
        near = d.argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        if not full.all():
            far = np.argsort(-d[np.arange(len(x)), near])[:int((~full).sum())]
            centres[~full] = x[far]
    return centres


class Index:
    """Centroids and residual codebooks; small, sent to tasks by closure."""

    def __init__(self, sample: np.ndarray, lists: int, share: float = 1.0):
        """``share``: of the vectors, about how many one group of lists may hold."""
        centroids = _kmeans(sample, lists, 8, 1)
        coarse = _kmeans(centroids, math.ceil(1 / share), 8, 1)
        self.centroids = centroids[_squares(centroids, coarse).argmin(1).argsort(kind="stable")]  # neighbours side by side
        self.gaps = np.sqrt(_squares(self.centroids, self.centroids))
        near = _squares(sample, self.centroids).argmin(1)
        held = np.bincount(near, minlength=len(self.centroids)) / len(sample)
        self.group = np.unique(((np.cumsum(held) - held) / share).astype(np.int64), return_inverse=True)[1]
        self.first = np.searchsorted(self.group, np.arange(self.group[-1] + 2))  # a group's lists: first[g] to first[g + 1]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        residual = sample - self.centroids[near]
        self.books = [_kmeans(residual[:, c], CODES, 6, 2 + i) for i, c in enumerate(self.cuts)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _squares(x, self.centroids)
        return d.argmin(1), d

    def encode(self, residual: np.ndarray) -> np.ndarray:
        """The code of each subspace."""
        return np.stack([((b * b).sum(1) - 2 * residual[:, c] @ b.T).argmin(1) for c, b in zip(self.cuts, self.books)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), sum(map(len, self.cuts))))
        for s, c in enumerate(self.cuts):
            out[:, c] = self.books[s][codes[:, s]]
        return out

    def probes(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(own list, for each list: can it hold a vector within the margin)."""
        own, d = self.assign(x)
        reach = np.ones(d.shape, bool)
        near = np.argpartition(d, min(NEAREST, d.shape[1]) - 1, axis=1)[:, :NEAREST]
        for j in range(near.shape[1]):
            a = near[:, j]
            gap = self.gaps[a]
            reach &= (d - d[np.arange(len(x)), a][:, None] <= 2 * margin * gap + 1e-9) | (gap == 0)
        reach[np.arange(len(x)), own] = True
        return own, reach

    def asked(self, own: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, groups beyond the own one with a list to probe; each has higher numbers)."""
        some = np.logical_or.reduceat(reach, self.first[:-1], axis=1)
        return np.nonzero(some & (np.arange(some.shape[1])[None, :] > self.group[own][:, None]))

    def bits(self, reach: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Of each row, the packed bits of the lists of the group beside it."""
        width = int(np.diff(self.first).max())
        at = self.first[groups][:, None] + np.arange(width)[None, :]
        inside = at < self.first[groups + 1][:, None]
        return np.packbits(np.take_along_axis(reach, np.where(inside, at, 0), 1) & inside, axis=1)


def _block(dim: int) -> int:
    """Vectors that a block indexes: fewer of long ones, for the memory of a task."""
    return min(INDEX_BLOCK, max(4096, INDEX_BLOCK * 256 // dim))


def _matrix(batch, name: str, dim: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)).flatten()).reshape(-1, dim)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    kind = pa.binary(rows.shape[1] * rows.itemsize)
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _search(table: pa.Table, index: Index, dim: int, number, limit: float, radius: float) -> pa.Table:
    """One block of one group of lists against one block of its queries."""
    table = table.combine_chunks()
    lo, hi = index.first[table["group"][0].as_py():][:2]
    vec = np.frombuffer(b"".join(table["vec"].to_pylist()), number).reshape(-1, dim)
    cid, n, own = (np.asarray(table[c].combine_chunks()) for c in ("cid", "n", "own"))
    indexed = np.asarray(table["indexed"].combine_chunks().cast(pa.int8())).astype(bool)
    asks = np.frombuffer(b"".join(table["asks"].to_pylist()), np.uint8).reshape(len(cid), -1)
    asks = np.unpackbits(asks, axis=1)[:, :hi - lo].astype(bool)
    if table["part"][0].as_py():  # the first part compares the members
        asks[indexed] = False
    unit = _unit(vec)
    members = np.flatnonzero(indexed)
    members = members[own[members].argsort(kind="stable")]
    ends = np.searchsorted(own[members], np.arange(lo, hi + 1))
    links = np.zeros(len(cid), np.int64)
    pairs = []
    if len(members):
        centre = index.centroids[own[members]]
        known = centre + index.decode(index.encode(unit[members] - centre))
        error = np.sqrt(((unit[members] - known) ** 2).sum(1))
        # |q - known| <= radius + error, as a bound on their product, lowered by the rounding of single precision
        least = (1 + (known * known).sum(1) - (radius + error + 1e-6) ** 2) / 2 - (dim + 16) * 2.0 ** -22
        known = np.concatenate([known, -least[:, None]], axis=1).astype(np.float32)
        query = np.ones((len(unit), dim + 1), np.float32)
        query[:, :-1] = unit
    for at in range(hi - lo) if len(members) else ():
        held, code = members[ends[at]:ends[at + 1]], known[ends[at]:ends[at + 1]]
        asking = np.flatnonzero(asks[:, at]) if len(held) else held
        step = max(16, PRODUCT // max(1, len(held)))
        for k in range(0, len(asking), step):
            q = asking[k:k + step]
            i, j = np.divmod(np.flatnonzero(query[q] @ code.T >= 0), len(held))
            a, b = q[i], held[j]
            keep = ~indexed[a] | (own[a] != own[b]) | (a < b)
            a, b = a[keep], b[keep]
            for m in range(0, len(a), 1 << 15):
                u, v = a[m:m + (1 << 15)], b[m:m + (1 << 15)]
                close = (unit[u] * unit[v]).sum(1) >= limit
                u, v = u[close], v[close]
                np.add.at(links, u, n[v])
                np.add.at(links, v, n[u])
                if len(u):
                    pairs.append((u, v))
                if len(pairs) > 64:  # keep a forest, not the pairs
                    root = roots(len(cid), pairs)
                    some = np.flatnonzero(root != np.arange(len(cid)))
                    pairs = [(some, root[some])]
    root = roots(len(cid), pairs)
    out = np.flatnonzero(links)
    return pa.table({"cid": cid[out], "links": links[out], "root": cid[root[out]]})


def _dealt(classes: DataFrame, index: Index, dim: int, margin: float) -> DataFrame:
    """Each class once to each part of its own block, and as a query to the blocks that it asks."""
    def blocks(batch):
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            raw = _matrix(part, "vec", dim)
            yield raw, np.asarray(part.column(0)), np.asarray(part.column(1)), *index.probes(_unit(raw), margin)

    groups, block = len(index.first) - 1, _block(dim)

    def counted(batches):
        members, asked = (np.zeros(groups, np.int64) for _ in range(2))
        for batch in batches:
            for _, _, _, own, reach in blocks(batch):
                members += np.bincount(index.group[own], minlength=groups)
                asked += np.bincount(index.asked(own, reach)[1], minlength=groups)
        yield pa.RecordBatch.from_pydict({"group": np.arange(groups, dtype=np.int32), "members": members, "asked": asked})

    rows = classes.select("cid", "n", "vec")
    sizes = (rows.mapInArrow(counted, "group int, members long, asked long").groupBy("group")
             .agg(F.sum("members").alias("members"), F.sum("asked").alias("asked")).collect())  # a row per group
    cut = np.ones(groups, np.int64)
    parts = cut.copy()
    for r in sizes:
        cut[r["group"]] = max(1, math.ceil(r["members"] / block))
        inner = r["members"] if r["members"] > block else 0  # a split group also asks itself
        parts[r["group"]] = max(1, math.ceil((r["asked"] + inner) / QUERY_BLOCK))

    def dealt(batches):
        for batch in batches:
            for raw, cid, n, own, reach in blocks(batch):
                home = index.group[own]
                mine = np.mod(cid, cut[home])
                above = reach & (np.arange(reach.shape[1])[None, :] >= own[:, None])
                where = []  # (row, group, block, part, indexed, bits)
                copies = np.repeat(np.arange(len(cid)), parts[home])
                nth = np.arange(len(copies)) - np.repeat(np.cumsum(parts[home]) - parts[home], parts[home])
                where.append((copies, home[copies], mine[copies], nth, True, index.bits(above, home)[copies]))
                split = np.flatnonzero(cut[home] > 1)
                for rows_, groups_, low in ((*index.asked(own, reach), None), (split, home[split], True)):
                    r = np.repeat(np.arange(len(rows_)), cut[groups_])
                    b = np.arange(len(r)) - np.repeat(np.cumsum(cut[groups_]) - cut[groups_], cut[groups_])
                    if low:  # other blocks of the own group, each pair of blocks once, so with lists of lower number too
                        r, b = r[b > mine[rows_][r]], b[b > mine[rows_][r]]
                    asks = index.bits(reach[rows_], groups_)
                    where.append((rows_[r], groups_[r], b, np.mod(cid[rows_[r]] // 7, parts[groups_[r]]), False, asks[r]))
                row = np.concatenate([w[0] for w in where])
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(np.concatenate([w[i] for w in where]).astype(np.int32)) for i in (1, 2, 3)),
                    pa.array(np.concatenate([np.full(len(w[0]), w[4]) for w in where])), pa.array(own[row].astype(np.int32)),
                    _binary(np.concatenate([w[5] for w in where])), pa.array(cid[row]), pa.array(n[row]), _binary(raw[row])],
                    names=["group", "block", "part", "indexed", "own", "asks", "cid", "n", "vec"])

    return rows.mapInArrow(dealt, "group int, block int, part int, indexed boolean, own int, asks binary, cid long, n long, vec binary")


def _index(classes: DataFrame, count: int, dim: int, lists: int | None) -> Index:
    sample = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toArrow()["vec"]
    sample = _unit(np.concatenate([np.asarray(c.flatten()).reshape(-1, dim) for c in sample.chunks if len(c)]))
    held = min(_block(dim), max(1, count // GROUPS))
    return Index(sample, lists or max(1, min(MOST_LISTS, math.isqrt(count))), held / count)


def _linked_classes(classes: DataFrame, dim: int, cosine: float, lists: int | None,
                    spread: float | None) -> tuple[DataFrame, DataFrame]:
    """Of classes of one length: (cid, links to other classes' vectors) and (node, root)."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    margin = radius * (1 if spread is None else min(1, spread / math.sqrt(dim)))
    number = np.float32 if "float" in dict(classes.dtypes)["vec"] else np.float64
    index = _index(classes, classes.count(), dim, lists)
    dealt = _dealt(classes, index, dim, margin)
    found = (dealt.groupBy("group", "block", "part")
             .applyInArrow(lambda t: _search(t, index, dim, number, cosine, radius), "cid long, links long, root long"))
    found = materialize(found, "found")
    return (found.groupBy("cid").agg(F.sum("links").alias("links")),
            connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v"))))


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                     cosine: float = COSINE, lists: int | None = None, spread: float | None = None) -> DataFrame:
    """Per row of ``vectors``: ``id_col``, ``n_links`` (other rows within the cosine
    limit), ``component_id`` (smallest id reachable by links) and ``kept``. All links
    are found unless ``spread`` narrows the lists that are probed."""
    rows = only(vectors, id_col, vec_col).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    kind = dict(rows.dtypes)["vec"]
    if kind not in ("array<float>", "array<double>"):
        raise ValueError(f"{vec_col} must be an array of float or double, not {kind}")
    # F.forall is null where a component is null, so null components count as not good
    fine = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists("vec", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("fine", fine)
    classes = (marked.where("fine").groupBy("vec").agg(F.count("*").alias("n"), F.min("id").alias("least"))
               .withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    classes = materialize(classes, "vectors")
    named = None
    for r in sorted(x["dim"] for x in classes.select("dim").distinct().collect()):
        some = classes.where(F.col("dim") == r).select("cid", "n", "vec", "least")
        links, root = _linked_classes(some, r, cosine, lists, spread)
        root = materialize(root, "roots")
        of = some.join(root, some["cid"] == root["node"]).select("cid", "root", "least")
        first = materialize(of.groupBy("root").agg(F.min("least").alias("component_id")), "first")
        one = (some.select("cid", "n", "vec", "least").join(links, "cid", "left")
               .join(of.join(first, "root").select("cid", "component_id"), "cid", "left")
               .select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                       F.coalesce("component_id", "least").alias("component_id")))
        named = one if named is None else named.unionByName(one)
    alone = marked.where("NOT fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if named is not None:
        named = materialize(named, "classes")
        alone = alone.unionByName(marked.where("fine").join(named, "vec").select("id", "n_links", "component_id"))
    return alone.select(F.col("id").alias(id_col), "n_links", "component_id",
                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
