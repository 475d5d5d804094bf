"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features are coarse
shares of its bytes and words (capitals, symbols, digits, separators, repeated
words, word lengths, ...), language-free, together with those of the line
before and after it. Forward-backward gives each line's marginal of being good;
the marginals weighted by line length make the document's quality, and a logistic
fit maps that to the share of good documents.

Training: a line of a labelled document carries the document's label; the
conditional likelihood (of the whole chain) is maximised by Adam with L2. The
sample is bounded: ``SAMPLE`` distinct training rows of smallest hash, of at most
``MOST_LINES`` lines each and ``SAMPLE_LINES`` in all; only their feature bytes reach the driver, and the
gradient is added up in blocks of lines. Scoring reads
every whole text, in one pass without a shuffle.

Cases: null and empty texts are one empty line and get that line's score; very
long texts are one chain; rows are scored one by one, so repeated rows score
alike; null labels or ids don't train; several labels of an id count as their mean (0.5
or more is good); without training rows every score is 0.5; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, only, slices, word_hashes, words_of

SAMPLE = 6000
MOST_LINES = 500
SAMPLE_LINES = 500_000  # lines of all training documents
FOLDS = 5
THRESHOLD = 0.3


def _table(*ranges) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for lo, hi in ranges:
        t[lo:hi + 1] = 1
    return t


_UPPER, _LOWER, _DIGIT = _table((65, 90)), _table((97, 122)), _table((48, 57))
_ODD = _table((33, 38), (40, 43), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126))  # symbols; not . , : ; ? ' -
_LEAD = _table((128, 191))  # UTF-8 continuation bytes: don't count as characters

#: cut points of the coarse features; each (feature, cut) is one binary feature
_CUTS = {
    "upper": (0.02, 0.06, 0.15, 0.4, 0.7), "odd": (0.005, 0.02, 0.06, 0.12), "digit": (0.02, 0.1, 0.3),
    "new_words": (0.05, 0.15, 0.3, 0.5, 0.7, 0.9), "word_len": (2.5, 3.5, 4.5, 6, 8, 12), "words": (1, 3, 6, 12, 30, 100),
    "short_words": (0.05, 0.15, 0.3, 0.5), "odd_words": (0.05, 0.2, 0.5, 0.8), "again": (0.5,), "full_stop": (0.5,),
    "stops": (0.01, 0.04, 0.1), "other": (0.02, 0.1, 0.3),
}
N_LINE = sum(map(len, _CUTS.values()))
N_FEATURES = 3 * N_LINE + 3  # own line, the one before, the one after; is first, is last, bias


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[ends] - run[starts]


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(binary features of each line, its length in bytes, lines per text)."""
    newline = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], newline + 1]))  # an empty text has one empty line
    lines = np.diff(np.searchsorted(newline, offs)) + 1
    last = np.cumsum(lines) - 1
    ends = np.append(starts[1:] - 1, len(data))  # without the newline ...
    ends[last] = offs[1:]  # ... and where the text ends
    size = ends - starts
    chars = np.maximum(size - _sums(_LEAD[data], starts, ends), 1)
    ws, we, _ = words_of(data, np.append(starts, len(data)), SPACE)
    line = np.searchsorted(starts, ws, "right") - 1
    n_words = np.bincount(line, minlength=len(starts))
    some = np.maximum(n_words, 1)
    wh = word_hashes(data, ws, we)
    order = np.lexsort((wh, line))
    fresh = np.append(True, (wh[order][1:] != wh[order][:-1]) | (line[order][1:] != line[order][:-1])) if len(wh) else np.zeros(0, bool)
    distinct = np.bincount(line[order][fresh], minlength=len(starts))
    odd_bytes = _sums(_ODD[data], starts, ends)
    run = np.append(0, np.cumsum(_ODD[data]))
    odd_word = (run[we] - run[ws]) > 0
    text = np.repeat(np.arange(len(lines)), lines)
    whole = np.zeros(len(starts), np.uint64)
    np.add.at(whole, line, wh * (np.uint64(2) * (np.arange(len(wh)) - (np.cumsum(n_words) - n_words)[line]).astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((whole, text))
    same = np.append(False, (whole[order][1:] == whole[order][:-1]) & (text[order][1:] == text[order][:-1]))
    same |= np.append(same[1:], False)
    again = np.zeros(len(starts))
    again[order] = same
    again *= n_words > 0
    tail = np.where(size > 0, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    letters = np.maximum(_sums(_UPPER[data] | _LOWER[data], starts, ends), 1)
    values = {
        "upper": _sums(_UPPER[data], starts, ends) / letters, "odd": odd_bytes / chars,
        "digit": _sums(_DIGIT[data], starts, ends) / chars, "new_words": distinct / some,
        "word_len": chars / some - 1, "words": n_words,
        "short_words": np.bincount(line, we - ws <= 3, len(starts)) / some,
        "odd_words": np.bincount(line, odd_word, len(starts)) / some, "again": again,
        "full_stop": np.isin(tail, (33, 46, 63)), "stops": _sums((data == 46) | (data == 44), starts, ends) / chars,
        "other": _sums(data >= 192, starts, ends) / chars,
    }
    out = np.concatenate([np.stack([values[k] > c for c in cuts]) for k, cuts in _CUTS.items()]).T
    return out.astype(np.uint8), size, lines


def chain_features(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A line's features with those of its neighbours in the same text."""
    first, last = np.cumsum(lines) - lines, np.cumsum(lines) - 1
    out = np.zeros((len(own), N_FEATURES), np.float32)
    out[:, :N_LINE] = own
    out[1:, N_LINE:2 * N_LINE] = own[:-1]
    out[first, N_LINE:2 * N_LINE] = 0
    out[:-1, 2 * N_LINE:3 * N_LINE] = own[1:]
    out[last, 2 * N_LINE:3 * N_LINE] = 0
    out[first, -3] = out[last, -2] = out[:, -1] = 1
    return out


def feature_sums(own: np.ndarray, lines: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``chain_features(own, lines).T @ weight`` in blocks of lines."""
    first, last = np.cumsum(lines) - lines, np.cumsum(lines) - 1
    # a line's weight meets its own features, those of the line before and of the line after
    before, after = weight.copy(), weight.copy()
    before[first], after[last] = 0, 0
    each = np.stack([weight, np.append(before[1:], 0), np.append(0, after[:-1])], 1)
    total = np.zeros((own.shape[1], 3))
    for i in range(0, len(own), 65536):
        total += own[i:i + 65536].T.astype(np.float64) @ each[i:i + 65536]
    return np.concatenate([total.T.ravel(), [weight[first].sum(), weight[last].sum(), weight.sum()]])


def forward_backward(unary: np.ndarray, step: np.ndarray, lines: np.ndarray):
    """Chains of two states (bad, good) with score ``unary`` for good and ``step[i, j]``
    from state i to j. Returns (marginal of good per line, expected transitions, log-partition)."""
    first = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")  # long chains first: those still running are a prefix
    first, length = first[order], lines[order]
    n, most = len(unary), int(length[0]) if len(length) else 0
    score = np.stack([np.zeros(n), unary], 1)
    score -= score.max(1, keepdims=True)
    weight = np.exp(score)
    move = np.exp(step - step.max())
    alpha, beta, scale = np.zeros((n, 2)), np.ones((n, 2)), np.ones(n)
    running = np.searchsorted(-length, -np.arange(1, most + 1), "right")  # chains of at least t + 1 lines
    for t in range(most):
        at = first[:running[t]] + t
        a = weight[at] if t == 0 else weight[at] * (alpha[at - 1] @ move)
        scale[at] = a.sum(1)
        alpha[at] = a / scale[at][:, None]
    expected = np.zeros((2, 2))
    for t in range(most - 1, 0, -1):
        at = first[:running[t]] + t
        out = weight[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = out @ move.T
        expected += (alpha[at - 1].T @ out) * move
    both = alpha * beta
    good = both[:, 1] / both.sum(1)
    inner = n - len(lines)
    log_z = np.log(scale).sum() + np.maximum(unary, 0).sum() + inner * step.max()
    return good, expected, log_z


@dataclass
class Model:
    """Weights of the chain and of the map from mean marginal to score."""

    weight: np.ndarray
    step: np.ndarray
    slope: float = 1.0
    bias: float = 0.0

    def unary(self, own: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """``chain_features(own, lines) @ weight`` in bounded memory."""
        w = self.weight[:3 * N_LINE].reshape(3, N_LINE).T
        part = np.concatenate([own[i:i + 65536].astype(np.float64) @ w for i in range(0, len(own), 65536)] or [np.zeros((0, 3))])
        first, last = np.cumsum(lines) - lines, np.cumsum(lines) - 1
        before, after = np.append(0, part[:-1, 1]), np.append(part[1:, 2], 0)
        before[first] = self.weight[-3]
        after[last] = self.weight[-2]
        return part[:, 0] + before + after + self.weight[-1]

    def quality(self, own: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean over a text's lines of the marginal of being good."""
        good, _, _ = forward_backward(self.unary(own, lines), self.step, lines)
        weight = np.maximum(size, 1).astype(float)
        first = np.cumsum(lines) - lines
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)

    def score(self, quality: np.ndarray) -> np.ndarray:
        q = np.clip(quality, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(q / (1 - q)) + self.bias)))


def train(own: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray, rounds: int = 200) -> Model:
    """Fit the chain, then the map to scores, on texts' lines with one label per text."""
    y = np.repeat(label, lines).astype(float)
    inside = np.ones(len(y), bool)
    inside[np.cumsum(lines) - lines] = False  # lines with one before them
    at = np.flatnonzero(inside)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    model = Model(np.zeros(N_FEATURES), np.zeros((2, 2)))
    theta, m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for r in range(1, rounds + 1):
        model.weight = theta[:-4]
        good, expected, _ = forward_backward(model.unary(own, lines), theta[-4:].reshape(2, 2), lines)
        grad = np.concatenate([feature_sums(own, lines, y - good), (seen - expected).ravel()]) / len(lines) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.1 * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
    model.weight, model.step = theta[:-4].copy(), theta[-4:].reshape(2, 2).copy()
    q = np.clip(model.quality(own, size, lines), 1e-6, 1 - 1e-6)
    z = np.stack([np.log(q / (1 - q)), np.ones(len(q))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):  # Newton steps of the logistic map, kept increasing
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hess, z.T @ (label - p) - 1e-3 * (w - [1.0, 0.0]))
        w[0] = np.clip(w[0], 0.05, 5)
        w[1] = np.clip(w[1], -10, 10)
    model.slope, model.bias = float(w[0]), float(w[1])
    return model


def held_out(id_col: str):
    """True for the documents that are never trained on: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """A model from the labelled documents that are not held out (a bounded sample, see above)."""
    known = only(labels, id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.where(~held_out(id_col)).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    texts = only(docs, id_col, text_col).where(
        F.coalesce(F.length(text_col) - F.length(F.translate(text_col, "\n", "")), F.lit(0)) < MOST_LINES)
    # drawn by hash among the rows present, not the ids: a repeated id has no more than its share, equal rows count once
    texts = texts.withColumn("_at", F.xxhash64(id_col, text_col))
    drawn = texts.select(id_col, "_at").join(known, id_col).groupBy("_at").agg(F.max("_label").alias("_label")).orderBy("_at").limit(SAMPLE)

    def lines_of(batches):
        for b in batches:
            for lo, data, offs in slices(b.column(0)):
                own, size, lines = line_features(data, offs)
                first = np.append(np.cumsum(lines) - lines, len(size))
                yield pa.RecordBatch.from_arrays([
                    b.column(1).slice(lo, len(lines)), b.column(2).slice(lo, len(lines)),
                    pa.array([own[a:z].tobytes() for a, z in zip(first, first[1:])], pa.binary()),
                    pa.array([size[a:z].astype(np.int64).tobytes() for a, z in zip(first, first[1:])], pa.binary())],
                    names=["label", "at", "own", "size"])

    # broadcast: at most SAMPLE rows
    rows = (texts.join(F.broadcast(drawn), "_at").groupBy("_at").agg(F.first(text_col).alias("text"), F.first("_label").alias("label"))
            .select("text", "label", F.col("_at").alias("at")).mapInArrow(lines_of, "label int, at long, own binary, size binary"))
    got = rows.toArrow()
    order = np.argsort(np.asarray(got["at"].combine_chunks()) if got.num_rows else np.zeros(0), kind="stable")
    label = np.array(got["label"].to_pylist(), float)[order]
    if not len(label):
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)))
    own_parts, size_parts = got["own"].to_pylist(), got["size"].to_pylist()
    own = [np.frombuffer(own_parts[i], np.uint8).reshape(-1, N_LINE) for i in order]
    size = [np.frombuffer(size_parts[i], np.int64) for i in order]
    lines = np.array([len(s) for s in size])
    use = np.cumsum(lines) <= max(SAMPLE_LINES, lines[0])  # in the order of the hash
    own, size = [o for o, u in zip(own, use) if u], [s for s, u in zip(size, use) if u]
    return train(np.concatenate(own), np.concatenate(size), lines[use], label[use])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score",
                    keep_text: bool = True) -> DataFrame:
    """``docs`` with a quality score from 0 to 1 for each row's whole text."""
    only(docs, text_col)
    docs = docs.drop(score_col)  # an older score gives way
    kinds = dict(docs.dtypes)
    kept = [c for c in docs.columns if keep_text or c != text_col]

    def scored(batches):
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            out = [np.zeros(0)]
            for _, data, offs in slices(cols[text_col]):
                out.append(model.score(model.quality(*line_features(data, offs))))
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in kept), pa.array(np.concatenate(out))], names=[*kept, score_col])

    return docs.mapInArrow(scored, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{score_col}` double"]))
