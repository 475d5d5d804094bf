"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are words (ASCII upper case folded; runs of letters, digits and bytes from 0x80). A
token's log-odds compares the share of toxic training texts that hold it with that of clean ones, under a
Dirichlet prior: the pseudo-counts follow the odds of the word's opening (its first 5 bytes), whose own
prior follows those of 4 bytes, then 3. An opening counts word types, not texts, so one frequent
word says nothing about others that begin alike, and a word never seen takes the odds of its longest
known opening. A text is the sequence of these log-odds less a constant drift; all its maximal scoring
segments are found in one linear scan (``segments``). Segments are calibrated by extreme-value theory: for scores of negative
mean the greatest segment of n clean tokens follows ``P(S < s) = exp(-K n exp(-L s))``; L solves
``mean(exp(L score)) = 1`` over clean tokens and K is the maximum-likelihood fit to clean texts. A passage is
significant if fewer than ``EXPECTED`` such are expected by chance in a text of its length, a text's evidence is the
sum of ``L s - log(K n)`` over its significant passages (without one, that of its best segment, 0 at least), and a logistic fit maps its logarithm (of 1 more) to the score.

Training: at most ``SAMPLE`` labelled texts of each class, of smallest hash and at most ``MOST_CHARS`` characters, equal
texts once, as toxic if any of them is. The calibration takes ``CALIBRATED`` of them, each scored by counts that leave its fifth of the sample out. The model keeps the ``VOCABULARY`` words and openings
farthest from their prior. Scoring reads every whole text in one pass without a shuffle.

Cases: null and empty texts and texts without tokens have the evidence 0 and that score; very long texts are scanned
whole, slice by slice of documents; rows are scored one by one, so repeated rows score alike; null labels or ids
don't train; several labels of an id count as their mean (0.5 or more is toxic); with no training rows of
either class every score is 0.5; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import materialize
from .common import need, only, ship, slices, word_hashes, words_of

FOLDS, HELD = 3, 1
THRESHOLD = 0.7
SAMPLE = 10_000  # training texts of each class
MOST_CHARS = 10_000
CALIBRATED, PARTS = 5_000, 5  # texts that fit the calibration; parts of the sample left out in turn
VOCABULARY = 200_000
PRIOR = 2.0  # pseudo-counts at each level
DRIFT = 1.0  # taken from each token's log-odds
EXPECTED = 0.001  # chance passages in a text of the same length
OPENINGS = (3, 4, 5)  # bytes

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_APART = np.ones(256, bool)  # not part of a word
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


def held_out(id_col: str):
    """True for the documents that are never trained on: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def token_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, ends, words per text): a row of keys for the openings of each length and one for the words."""
    data = _FOLD[data]
    starts, ends, counts = words_of(data, offs, _APART)
    rows = [word_hashes(data, starts, np.minimum(starts + k, ends)) ^ np.uint64(k) for k in OPENINGS]
    return np.stack([*rows, word_hashes(data, starts, ends)]), starts, ends, counts


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, sum) of all maximal scoring segments, in order: runs that no
    part of theirs and no run around them beats. Linear in the number of scores."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    run = np.append(0.0, np.cumsum(scores))
    out: list[list] = []  # [first, end, sum before, sum through, place of the last one with a smaller sum before]
    for i in at.tolist():
        first, end, left, right = i, i + 1, float(run[i]), float(run[i + 1])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append([first, end, left, right, j])
                break
            first, left = out[j][0], out[j][2]  # the two and all between them are one
            del out[j:]
    return [(a, b, right - left) for a, b, left, right, _ in out]


@dataclass
class Model:
    """Log-odds of known words and openings (sorted 64-bit keys), calibration and the map to scores."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    rate: float = 1.0  # L
    size: float = 1.0  # K
    slope: float = 0.0
    bias: float = 0.0

    def log_odds(self, keys: np.ndarray) -> np.ndarray:
        """Of each token: the word's, or its longest known opening's, or 0."""
        out = np.zeros(keys.shape[1])
        if not len(self.keys):
            return out
        for row in keys:  # longer ones overwrite
            at = np.searchsorted(self.keys, row)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == row
            out[known] = self.odds[at[known]]
        return out

    def passages(self, scores: np.ndarray) -> tuple[list[tuple[int, int, float]], float]:
        """Significant passages (first token, end, ``L s - log(K n)``) of one text, and its evidence."""
        found = segments(scores)
        if not found:
            return [], 0.0
        chance = np.log(self.size * len(scores))
        normal = [(a, b, self.rate * s - chance) for a, b, s in found]
        kept = [p for p in normal if np.exp(-p[2]) < EXPECTED]
        return kept, sum(p[2] for p in kept) if kept else max(0.0, *(p[2] for p in normal))

    def score(self, evidence):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.bias, -500, 500)))


def log_odds_table(words: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int,
                   prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, log-odds, distance from the prior) of openings and words; ``words``: ``token_keys`` of each
    distinct word, ``toxic`` and ``clean``: how many texts of a class hold it."""
    # the larger class counts down to the smaller
    bad, good = toxic * min(1.0, n_clean / max(n_toxic, 1)), clean * min(1.0, n_toxic / max(n_clean, 1))
    seen = bad + good > 0
    words, bad, good = words[:, seen], bad[seen], good[seen]
    share = bad / (bad + good)
    above = np.zeros(len(bad))
    keys, odds, far = [], [], []
    for opening in words[:-1]:
        u, first, back = np.unique(opening, return_index=True, return_inverse=True)
        pull = 1 / (1 + np.exp(-above[first]))
        own = np.log((np.bincount(back, share) + prior * pull) / (np.bincount(back, 1 - share) + prior * (1 - pull)))
        keys.append(u)
        odds.append(own)
        far.append(np.abs(own - above[first]))
        above = own[back]
    pull = 1 / (1 + np.exp(-above))
    own = np.log((bad + prior * pull) / (good + prior * (1 - pull)))
    keys.append(words[-1])
    odds.append(own)
    far.append(np.abs(own - above))
    return np.concatenate(keys), np.concatenate(odds), np.concatenate(far)


def _token_model(*table) -> Model:
    keys, odds, far = log_odds_table(*table)
    chosen = np.argsort(-far, kind="stable")[:VOCABULARY]
    chosen = chosen[np.argsort(keys[chosen], kind="stable")]
    return Model(keys[chosen], odds[chosen].astype(np.float32))


def calibrate(model: Model, texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> Model:
    """Fit rate and size on the clean texts' token scores, then the logistic map on all; ``texts``: scores per text."""
    clean = np.concatenate([t for t, y in zip(texts, label) if not y] or [np.zeros(0)])
    model.rate = 1.0
    if len(clean) and (clean > 0).any() and clean.mean() < 0:
        low, high = 1e-3, 1.0
        while np.mean(np.exp(np.minimum(high * clean, 700))) < 1 and high < 50:
            low, high = high, 2 * high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.mean(np.exp(np.minimum(mid * clean, 700))) < 1 else (low, mid)
        model.rate = low
    spread = [len(t) * np.exp(-model.rate * max((s for _, _, s in segments(t)), default=0.0)) for t, y in zip(texts, label) if not y and len(t)]
    model.size = len(spread) / sum(spread) if spread else 1.0
    z, w = np.stack([np.log1p([model.passages(t)[1] for t in texts]), np.ones(len(texts))], 1), np.zeros(2)
    for _ in range(100):  # Newton steps, a little ridge keeps separable data finite
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (label - p)) - 1e-3 * w
        w = w + np.clip(np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), grad), -5, 5)
    model.slope, model.bias = max(float(w[0]), 0.0), float(w[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled documents that are not held out (a bounded sample, see above)."""
    known = only(labels, id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.where(~held_out(id_col)).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    texts = only(docs, id_col, text_col).where(F.col(text_col).isNotNull() & (F.length(text_col) <= MOST_CHARS))
    texts = texts.withColumn("_at", F.xxhash64(text_col))
    # equal texts train once, as toxic if any is; the hash is the text's whole identity here, and the order of the sample
    present = materialize(texts.select(id_col, "_at").join(known, id_col).groupBy("_at").agg(F.max("_label").alias("_label")), "labelled")
    share = {r["_label"]: r["n"] for r in present.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if set(share) != {0, 1}:
        return Model()
    drawn = present.where("_label = 1").orderBy("_at").limit(SAMPLE).union(present.where("_label = 0").orderBy("_at").limit(SAMPLE))
    # broadcast: at most 2 * SAMPLE hashes and labels
    rows = texts.join(F.broadcast(drawn), "_at").groupBy("_at").agg(F.first("_label").alias("label"), F.first(text_col).alias("text"))
    got = rows.toArrow().sort_by("_at")  # at most 2 * SAMPLE texts of MOST_CHARS characters
    label = np.asarray(got["label"]).astype(float)
    weight = np.where(label > 0, share[1] / max(label.sum(), 1), share[0] / max((1 - label).sum(), 1))
    return train(got["text"].combine_chunks(), label, weight / weight.mean())


def train(texts: pa.Array, label: np.ndarray, weight: np.ndarray) -> Model:
    """Token log-odds from all texts; the calibration takes texts whose own part was left out of the counts."""
    label = np.asarray(label, float)
    part = np.arange(len(label)) % PARTS
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of a slice: its distinct words; the text and word of each pair
    tables: list[np.ndarray] = []
    for lo, data, offs in slices(texts):
        keys, _, _, counts = token_keys(data, offs)
        words, first, back = np.unique(keys[-1], return_index=True, return_inverse=True)
        if len(words):
            pairs = np.unique((lo + np.repeat(np.arange(len(counts)), counts)) * len(words) + back)
            found.append((words, (pairs // len(words)).astype(np.int32), (pairs % len(words)).astype(np.int32)))
            tables.append(keys[:, first])
    if not tables or not label.any() or label.all():
        return Model()
    table = np.concatenate(tables, 1)
    del tables
    words, first = np.unique(table[-1], return_index=True)
    table = table[:, first]
    count = np.zeros((2, PARTS, len(words)), np.int32)
    for known, text, word in found:
        np.add.at(count, (label[text].astype(int), part[text], np.searchsorted(words, known)[word]), 1)
    del found
    size = np.array([[((label == y) & (part == p)).sum() for p in range(PARTS)] for y in (0, 1)])
    judged = np.arange(len(label)) < CALIBRATED
    scores: dict[int, np.ndarray] = {}
    for p in range(PARTS):
        own = np.flatnonzero(judged & (part == p))
        rest = [q for q in range(PARTS) if q != p]
        model = _token_model(table, count[1, rest].sum(0), count[0, rest].sum(0), size[1, rest].sum(), size[0, rest].sum())
        for lo, data, offs in slices(texts.take(pa.array(own))):
            keys, _, _, counts = token_keys(data, offs)
            for i, one in enumerate(np.split(model.log_odds(keys) - DRIFT, np.cumsum(counts)[:-1])):
                scores[int(own[lo + i])] = one
    model = _token_model(table, count[1].sum(0), count[0].sum(0), size[1].sum(), size[0].sum())
    at = sorted(scores)
    return calibrate(model, [scores[i] for i in at], label[at], weight[at])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", passages_col: str = "passages",
                    keep_text: bool = True) -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1 of each row's whole text and its significant passages: byte
    places in the UTF-8 text and calibrated strength (minus the logarithm of the passages expected by chance)."""
    need(docs, text_col)
    ship(docs.sparkSession)
    docs = docs.drop(score_col, passages_col)
    kinds = dict(docs.dtypes)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    spans = "array<struct<start:int,end:int,strength:double>>"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY keys and numbers at most

    def scored(batches):
        model = shared.value
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            evidence, size, start, end, strength = [], [], [], [], []
            for _, data, offs in slices(cols[text_col]):
                keys, a, b, counts = token_keys(data, offs)
                score = model.log_odds(keys) - DRIFT
                positive = np.append(0, np.cumsum(score > 0))
                first = np.append(0, np.cumsum(counts))
                some = positive[first[1:]] > positive[first[:-1]]
                for i, (lo, hi, any_) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), some.tolist())):
                    found, e = model.passages(score[lo:hi]) if any_ else ((), 0.0)
                    evidence.append(e)
                    size.append(len(found))
                    for x, y, p in found:
                        start.append(int(a[lo + x] - offs[i]))
                        end.append(int(b[lo + y - 1] - offs[i]))
                        strength.append(p)
            places = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(strength, pa.float64())],
                                                names=["start", "end", "strength"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), places)
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in kept), pa.array(model.score(np.array(evidence, float))), lists],
                                             names=[*kept, score_col, passages_col])

    return docs.mapInArrow(scored, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{score_col}` double", f"`{passages_col}` {spans}"]))
