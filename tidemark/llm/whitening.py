"""Embedding whitening by incremental eigendecomposition.

Every entry c of a vector becomes the whole number ``floor(256 * c)``. The covariance is taken
over the distinct whole-number vectors (the fit list), each once; components are its unit
eigenvectors by falling eigenvalue, and a vector is whitened by projecting it, centred, on them
and dividing by the square root of the eigenvalue.

Method: a task reads its share of the fit list once and keeps the eigenvalues and eigenvectors of
the scatter about its running mean: each vector is one centred rank-one update, whose new
eigenvalues are the roots of a secular equation (``rank_one``). Directions that the update does not touch
and equal eigenvalues are deflated first. Spectra are combined a few at a time in a tree:
the pairs of the one are rank-one updates of the other, and so is the difference of the means. The
combined basis then meets the data once more: each task projects its centred vectors on it and adds
up products, and the eigenpairs of that small matrix are the final ones (Rayleigh-Ritz). With a basis of all
dimensions one such pass is exact to double precision; with ``rank`` below it, passes repeat until the residual is small.

Scale: the distinct vectors are one hash aggregate (copies go before the shuffle), written once; all
passes read that. A task returns one spectrum, (rank + 1) x dimension numbers, and at most ``FAN`` of them
meet in a task; sums of products are added row by row of the matrix. The driver holds matrices of dimension
x dimension, never vectors. Counts and sums are exact whole numbers.

Cases: null vectors, empty ones and those with null or non-finite entries are dropped; so are vectors whose length is
not the commonest one (of two as common, the longer). Repeated rows and ids keep a row each. Entries
beyond 64 bits saturate. Null ids are kept. Components without variance (eigenvalue 0 to rounding) are not returned, so a
table of one distinct vector, like an empty table, gives an empty result. Eigenvectors of equal eigenvalues are any basis of
their space. A deviation that does not fit a long is null. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import materialize
from .common import need, ship

SCALE = 256
COMPONENTS = 4
FAN = 8  # spectra that meet in a task
PASSES = 50  # of Rayleigh-Ritz, when the basis has fewer dimensions than the vectors
_EPS = np.finfo(float).eps


def secular_roots(values: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``diag(values) + z z'`` for rising, distinct ``values`` and no zero in ``z``, and the
    differences values[i] - root[j], each taken from its nearest pole so that no digits cancel."""
    k, z2 = len(values), z * z
    total = z2.sum()
    gap = np.append(np.diff(values), total)
    upper = np.zeros(k, int)  # the pole a root is measured from: its left one, or 1: its right one
    if k > 1:
        middle = (values[:-1] + values[1:]) / 2
        with np.errstate(divide="ignore", over="ignore"):
            upper[:-1] = 1 + (z2[:, None] / (values[:, None] - middle[None, :])).sum(0) < 0
    pole = np.arange(k) + upper
    apart = values[:, None] - values[pole][None, :]
    weight = np.repeat(z2[:, None], k, axis=1)
    own = z2[pole]
    weight[pole, np.arange(k)] = 0
    right = upper == 0
    low, high = np.where(right, 0.0, -gap / 2), np.where(right, np.where(np.arange(k) == k - 1, total, gap / 2), 0.0)
    t = (low + high) / 2
    for _ in range(60):
        off = apart - t
        part = weight / off
        level = 1 + part.sum(0)
        slope = (part / off).sum(0)
        pull = own / t
        error = level - pull
        settled = np.abs(error) <= 8 * _EPS * (1 + np.abs(part).sum(0) + np.abs(pull))  # rounding's share of the sum
        over = error > 0
        high, low = np.where(over, t, high), np.where(over, low, t)
        # the pole's own term is exact, the others are a line: a quadratic for the new place
        b = level - slope * t
        root = np.sqrt(b * b + 4 * slope * own)
        with np.errstate(divide="ignore", invalid="ignore"):
            new = np.where(right, np.where(b > 0, 2 * own / (b + root), (root - b) / (2 * slope)),
                           np.where(b < 0, 2 * own / (b - root), -(root + b) / (2 * slope)))
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        settled |= (np.abs(new - t) <= 4 * _EPS * np.abs(new)) | (new == 0)
        t = np.where(settled, t, new)
        if settled.all():
            break
    return values[pole] + t, apart - t


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rank: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of ``vectors diag(values) vectors' + v v'``; values rise, vectors are columns. At most
    ``rank`` pairs are kept, the largest."""
    size = float(np.sqrt(v @ v))
    if size == 0:
        return values, vectors
    z = vectors.T @ v
    rest = v - vectors @ z
    more = vectors.T @ rest
    z, rest = z + more, rest - vectors @ more
    new = float(np.sqrt(rest @ rest))
    if len(values) < len(v) and new > 1e-12 * size:  # a direction not seen before
        values, vectors, z = np.append(0.0, values), np.column_stack([rest / new, vectors]), np.append(new, z)
    scale = max(float(values[-1]) if len(values) else 0.0, size * size)
    near = 8 * _EPS * scale
    live = np.abs(z) * size > near
    if (np.diff(values[live]) <= near).any():  # deflation of equal eigenvalues: turn them until only the last meets the update
        vectors, z = vectors.copy(), z.copy()
        at = np.flatnonzero(live)
        for i, j in zip(at, at[1:]):
            if values[j] - values[i] <= near:
                h = float(np.hypot(z[i], z[j]))
                c, s = z[j] / h, z[i] / h
                vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
                z[i], z[j] = 0.0, h
        live = np.abs(z) * size > near
    values = values.copy()
    if live.any():
        old = values[live]
        roots, off = secular_roots(old, z[live])
        # the update vector that has exactly these roots, so that the new vectors are orthogonal
        ratio = -off.copy()
        other = old[None, :] - old[:, None]
        np.fill_diagonal(other, 1.0)
        ratio /= other
        turned = np.sqrt(np.abs(ratio.prod(1))) * np.sign(z[live])
        turn = turned[:, None] / off
        turn /= np.sqrt((turn * turn).sum(0))
        moved = vectors[:, live] @ turn
        vectors = vectors.copy()
        vectors[:, live] = moved
        values[live] = roots
        order = np.argsort(values, kind="stable")
        values, vectors = values[order], vectors[:, order]
    if rank is not None and len(values) > rank:
        values, vectors = values[-rank:], vectors[:, -rank:]
    return values, vectors


@dataclass
class Spectrum:
    """Scatter of ``n`` vectors about their ``mean`` by its eigenpairs."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> "Spectrum":
        return cls(0, np.zeros(d), np.zeros(0), np.zeros((d, 0)))

    def add(self, x: np.ndarray, rank: int | None = None) -> None:
        off = x - self.mean
        self.n += 1
        self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt((self.n - 1) / self.n), rank)
        self.mean = self.mean + off / self.n

    def merge(self, other: "Spectrum", rank: int | None = None) -> None:
        if not other.n:
            return
        for e, u in zip(other.values, other.vectors.T):
            if e > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, u * np.sqrt(e), rank)
        n = self.n + other.n
        off = other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt(self.n * other.n / n), rank)
        self.mean = self.mean + off * (other.n / n)
        self.n = n


_SPECTRUM = "part int, n long, high array<long>, low array<long>, mean array<double>, values array<double>, vectors array<double>"


def _packed(part: int, high: np.ndarray, low: np.ndarray, s: Spectrum) -> pa.RecordBatch:
    lists = [high.astype(np.int64), low.astype(np.int64), s.mean, s.values, s.vectors.T.ravel()]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([s.n], pa.int64()), *(pa.array([v], pa.list_(pa.from_numpy_dtype(v.dtype))) for v in lists)],
        names=["part", "n", "high", "low", "mean", "values", "vectors"])


def _unpacked(row: dict) -> Spectrum:
    d = len(row["mean"])
    return Spectrum(row["n"], np.array(row["mean"]), np.array(row["values"]), np.array(row["vectors"], float).reshape(-1, d).T)


def _matrix(column, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(``id_col``, ``x``): the rows with usable vectors, as whole numbers."""
    need(embeddings, id_col, vec_col)
    ship(embeddings.sparkSession)
    v = F.col(f"`{vec_col}`")
    usable = F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))), F.lit(False)) & (F.size(v) > 0)
    return embeddings.select(F.col(f"`{id_col}`"), F.when(usable, F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))).alias("x")
                             ).where(F.col("x").isNotNull())


@dataclass
class Whitening:
    """The fitted components (rows, by falling eigenvalue) and exact count and sums of the fit list."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # Python's quotient of whole numbers rounds once


def _products(fit: DataFrame, d: int, one, rows: int) -> np.ndarray:
    """Sum over the fit list of the ``rows`` x ? matrices ``one(x)`` of batches x, added row by row by Spark."""

    def partial(batches):
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                got = one(_matrix(b.column(0), d))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * rows, pa.int32()), pa.array(range(rows), pa.int32()),
                                              pa.array(list(total), pa.list_(pa.float64()))], names=["part", "row", "values"])

    def added(table):
        table = table.sort_by("part")
        values = table["values"].combine_chunks()
        total = _matrix(values, len(values[0])).sum(0)
        return pa.table({"row": table["row"][:1], "values": pa.array([total], pa.list_(pa.float64()))})

    got = fit.mapInArrow(partial, "part int, row int, values array<double>").groupBy("row").applyInArrow(added, "row int, values array<double>").collect()
    return np.array([r["values"] for r in sorted(got)])


def fit(embeddings: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS, rank: int | None = None) -> Whitening | None:
    """The whitening of a table of vectors; None when no component has variance."""
    spark = embeddings.sparkSession
    named = whole_vectors(embeddings.select(F.col(f"`{vec_col}`"), F.lit(0).alias("_id")), "_id", vec_col)
    distinct = materialize(named.select("x").distinct(), "vectors")
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0]["d"]
    if rank is not None and rank < components:
        raise ValueError("rank must be at least the number of components")
    keep = None if rank is None or rank >= d else rank
    listed = distinct.where(F.size("x") == d)

    def learn(batches):
        from pyspark import TaskContext

        s, high, low = Spectrum.empty(d), np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b.column(0), d)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
            for v in x.astype(float):
                s.add(v, keep)
        if s.n:
            yield _packed(TaskContext.get().partitionId(), high, low, s)

    def combine(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        s = _unpacked(rows[0])
        for r in rows[1:]:
            s.merge(_unpacked(r), keep)
        high, low = (np.sum([r[k] for r in rows], axis=0) for k in ("high", "low"))
        return pa.Table.from_batches([_packed(rows[0]["part"] // FAN, high, low, s)])

    spectra = materialize(listed.mapInArrow(learn, _SPECTRUM), "spectra")
    parts = spectra.agg(F.max("part")).first()[0]
    while parts > 0:  # a tree: each round leaves an eighth
        spectra = materialize(spectra.groupBy(F.floor(F.col("part") / FAN).alias("_to")).applyInArrow(combine, _SPECTRUM), "spectra")
        parts //= FAN
    row = spectra.collect()[0].asDict()  # one spectrum: dimension x dimension numbers
    n, sums = row["n"], [(h << 32) + lo for h, lo in zip(row["high"], row["low"])]
    mean = np.array([s / n for s in sums])
    basis = np.linalg.qr(_unpacked(row).vectors[:, ::-1])[0] if row["values"] else np.zeros((d, 0))
    if not basis.shape[1]:
        return None

    def project(q):
        def one(x):
            off = x - mean
            return np.column_stack([(off @ q).T @ off, np.full(q.shape[1], (off * off).sum())])
        return one

    for _ in range(PASSES):
        got = _products(listed, d, project(basis), basis.shape[1]) / n
        trace, image = float(got[0, -1]), got[:, :-1].T  # the covariance times the basis
        small = basis.T @ image
        e, y = np.linalg.eigh((small + small.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        k = min(components, int((e > d * 8 * _EPS * trace).sum()))
        residual = np.abs(image @ y[:, :k] - basis @ y[:, :k] * e[:k]).max() if k else 0.0
        pairs = (basis @ y)[:, :k].T, e[:k]
        if basis.shape[1] == d or residual <= 1e-13 * trace:
            break
        basis = np.linalg.qr(image @ y)[0]
    if not k:
        return None
    found, e = pairs
    found = found / np.sqrt((found * found).sum(1))[:, None]
    found = found * np.sign(found[np.arange(k), np.abs(found).argmax(1)])[:, None]

    def check(x):
        white = ((x - mean) @ found.T) / np.sqrt(e)
        return np.column_stack([white.T @ white, white.sum(0)])

    moments = _products(listed, d, check, k) / n
    centre = moments[:, -1]
    error = float(np.abs(moments[:, :-1] - np.outer(centre, centre) - np.eye(k)).max())
    return Whitening(n, sums, found, e, trace, error)


def whiten(embeddings: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(``id_col``, deviation, whitened) for each row with a usable vector of the model's length: the exact squared
    length of n * x - sums, and the projections on the components over their standard deviations."""
    rows = whole_vectors(embeddings, id_col, vec_col)
    kind = dict(rows.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, deviation long, whitened array<double>"
    if model is None:
        return rows.select(id_col, F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")).limit(0)
    d, n, sums, mean = len(model.sums), model.n, model.sums, model.mean
    turn = (model.components / np.sqrt(model.values)[:, None]).T
    k = turn.shape[1]

    def transformed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), d)
            most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
            if d * most * most < 2 ** 63:
                off = n * x - np.array(sums, np.int64)
                deviation = pa.array((off * off).sum(1))
            else:  # exact beyond 64 bits on the way
                off = n * x.astype(object) - np.array(sums, object)
                deviation = pa.array([v if v < 2 ** 63 else None for v in (off * off).sum(1).tolist()], pa.int64())
            white = np.zeros((len(x), k))
            np.matmul(x - mean, turn, out=white)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), deviation, pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k), pa.int32()), pa.array(white.ravel()))],
                names=[id_col, "deviation", "whitened"])

    return rows.where(F.size("x") == d).mapInArrow(transformed, schema)
