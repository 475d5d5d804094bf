"""Toxicity: segments, log-odds and scores against plain recomputation, and held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import toxicity as T

SF1 = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, passages string, lang string"


def _best(scores, lo, hi):
    """All maximal segments by definition: the best run, then the best ones left and right of it."""
    top, at = 0.0, None
    for i in range(lo, hi):
        total = 0.0
        for j in range(i, hi):
            total += scores[j]
            if total > top:
                top, at = total, (i, j + 1)
    if at is None:
        return []
    return [*_best(scores, lo, at[0]), at, *_best(scores, at[1], hi)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(0, 40), st.floats(-2, 1))
def test_segments_are_the_maximal_ones(seed, n, shift):
    scores = np.random.default_rng(seed).normal(shift, 1.5, n)
    got = T.segments(scores)
    assert [(a, b) for a, b, _ in got] == _best(scores.tolist(), 0, n)
    for a, b, s in got:
        assert math.isclose(s, scores[a:b].sum(), abs_tol=1e-9)


def test_segments_with_ties_and_in_linear_time():
    assert T.segments(np.array([])) == [] and T.segments(np.array([-1.0, 0.0])) == []
    assert [(a, b) for a, b, _ in T.segments(np.array([1.0, -1.0, 1.0]))] == [(0, 1), (2, 3)]
    rng = np.random.default_rng(3)
    assert len(T.segments(rng.normal(-0.5, 1, 400_000))) > 10_000


def _words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def _odds(texts, label):
    """The hierarchical Dirichlet odds from their definition, in dictionaries."""
    count = [Counter(w for t, y in zip(texts, label) if y == c for w in set(_words(t))) for c in (0, 1)]
    n1, n0 = sum(label), len(label) - sum(label)
    words = set(count[0]) | set(count[1])
    bad = {w: count[1][w] * min(1, n0 / n1) for w in words}
    good = {w: count[0][w] * min(1, n1 / n0) for w in words}
    level = {0: {b"": 0.0}}
    for k in T.OPENINGS:
        up = level[max(level)]
        types = {}
        for w in words:
            types.setdefault(w[:k], []).append(bad[w] / (bad[w] + good[w]))
        length = max(level)
        level[k] = {}
        for o, shares in types.items():
            pull = 1 / (1 + math.exp(-up[o[:length]]))
            level[k][o] = math.log((sum(shares) + 2 * pull) / (sum(1 - x for x in shares) + 2 * (1 - pull)))
    out = {}
    for w in words:
        pull = 1 / (1 + math.exp(-level[5][w[:5]]))
        out[w] = math.log((bad[w] + 2 * pull) / (good[w] + 2 * (1 - pull)))
    return out, level


def _corpus(n, seed):
    rng = np.random.default_rng(seed)
    common = ["".join(rng.choice(list("abcdeéß"), rng.integers(2, 8))) for _ in range(300)]
    texts, label = [], []
    for i in range(n):
        words = list(rng.choice(common, rng.integers(5, 60)))
        y = int(rng.random() < 0.2)
        for _ in range(y * int(rng.integers(1, 4))):
            words.insert(int(rng.integers(0, len(words))), rng.choice(["Vile", "vilest", "grubby", "grubber" + str(i)]))
        texts.append(" ".join(words) + ".")
        label.append(y)
    return texts, label


def test_log_odds_equal_their_definition():
    texts, label = _corpus(120, 1)
    model = T.train(pa.array(texts), np.array(label), np.ones(len(label)))
    words, level = _odds(texts, label)
    for text in [*texts[:20], "unseen vilemost grubbier ab z 7 GRUBBY", ""]:
        raw = np.frombuffer(text.encode(), np.uint8)
        got = model.log_odds(T.token_keys(raw, np.array([0, len(raw)]))[0])
        want = [next((d[o] for d, o in ((words, w), (level[5], w[:5]), (level[4], w[:4]), (level[3], w[:3])) if o in d), 0.0) for w in _words(text)]
        np.testing.assert_allclose(got, want, atol=1e-5)
    assert abs(T.Model().score(0.0) - 0.5) < 1e-12


def test_calibration_solves_its_equations():
    rng = np.random.default_rng(0)
    texts = [rng.normal(-1, 1, rng.integers(20, 300)) for _ in range(400)]
    model = T.calibrate(T.Model(), texts, np.r_[np.zeros(399), 1], np.ones(400))
    clean = np.concatenate(texts[:399])
    assert abs(np.exp(model.rate * clean).mean() - 1) < 1e-6 and 1.5 < model.rate < 2.5  # N(-1, 1): 2
    chance = [model.size * len(t) * math.exp(-model.rate * max(s for *_, s in T.segments(t))) for t in texts[:399] if len(T.segments(t))]
    assert abs(np.mean(chance) - 1) < 0.05 and abs(np.var(chance) - 1) < 0.5  # exponential: the extreme-value law holds


def test_scores_of_all_kinds_of_rows(spark):
    texts, label = _corpus(300, 2)
    rows = [(i, t, "s", "p", "en") for i, t in enumerate(texts)]
    odd = [None, "", " \n", "!!! ...", "vile", "VILE grubby vilest", "a " * 50_000 + "vile grubby vile " + "b " * 50_000, "\x00é"]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(odd)] + [rows[0], rows[0], (None, "grubby vile", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    marks = spark.createDataFrame([(i, y, 1) for i, y in enumerate(label)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    model = T.fit(docs, marks)
    got = T.score_documents(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        raw = np.frombuffer(text.encode(), np.uint8)
        found, evidence = model.passages(model.log_odds(T.token_keys(raw, np.array([0, len(raw)]))[0]) - T.DRIFT)
        assert math.isclose(r["score"], float(model.score(evidence)), rel_tol=1e-9)
        assert len(r["passages"]) == len(found)
        for p, (a, b, strength) in zip(r["passages"], found):
            assert _words(text.encode()[p["start"]:p["end"]].decode()) == _words(text)[a:b] and math.isclose(p["strength"], strength)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert len(set(by[0])) == 1 and len(by[0]) == 3
    assert by[1000] == by[1001] == by[1002] == by[1003] and by[1000][0] < 0.2 and by[1005][0] > 0.9 and by[1006][0] > 0.7
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(by[i][0] >= T.THRESHOLD) == label[i] for i in held]) > 0.95


def test_empty_tables_and_one_class(spark):
    docs = spark.createDataFrame([(i, f"word{i}", "s", "p", "l") for i in range(9)], SCHEMA)
    one = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    for marks in (one, one.limit(0)):
        scored = T.score_documents(docs, T.fit(docs, marks))
        assert {r["score"] for r in scored.collect()} == {0.5}
    assert T.score_documents(docs.limit(0), T.fit(docs.limit(0), one)).collect() == []
    with pytest.raises(ValueError, match="missing column"):
        T.score_documents(docs.drop("text"), T.Model())


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels)
    scored = T.score_documents(docs.select("doc_id", "text"), model, keep_text=False)
    rows = scored.where(T.held_out("doc_id")).join(labels, "doc_id").select("score", "toxic").collect()
    toxic = [r["score"] >= T.THRESHOLD for r in rows if r["toxic"]]
    clean = [r["score"] >= T.THRESHOLD for r in rows if not r["toxic"]]
    assert len(rows) > 1000 and np.mean(toxic) > 0.9 and np.mean(clean) < 0.01
