"""The ten operators against brute force, on small tables with nulls, empty and
long texts, ties, repeated rows, clashing extra columns, and on empty tables."""

import gzip
import hashlib
import io
import itertools
import json
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, embedding, lines, packing, quality, sharding, simhash, substring, warc_zip
from tidemark.llm.common import roots

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, fp string, n_words string, score string, "
        "component_id string, _row string, piece string")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdéßñ"), rng.integers(1, 9))) for _ in range(n))


def _texts():
    base = [_prose(i, 60 + i) for i in range(12)]
    shared = _prose(99, 45)
    long_ = _prose(100, 12_000)
    texts = [None, "", "  \n\t ", "one", "A b C", *base, *base[:4], base[0] + " tail", shared + "\n" + base[1], "x " + shared + " y", long_,
             long_[:30_000], "UPPER lower " + base[2].upper(), base[3].replace(" ", "  \n "), "cookie banner text here\n" + base[5],
             "cookie banner text here\n" + base[6], " cookie banner text here \r\n" + base[7], "a\n\nb\n", "<|endoftext|> a", "a\x00b \x1cc\x85d"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 7}", len(t or ""), "fp", "w", "s", "c", "r", "p") for i, t in enumerate(_texts())]
    rows += [rows[5], rows[5], (None, rows[6][1], None, None, None, *rows[6][5:]), (None, None, None, None, None, *rows[6][5:])]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _multiset(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def _kept(texts, window):
    count = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    for w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        yield gone


@pytest.mark.parametrize("window", [35, 2, 7])
def test_substring_dedup_equals_brute_force(docs, window):
    got = _rows(substring.substring_dedup(docs, window=window))
    source = _rows(docs)
    words = [(r["text"] or "").encode().split() for r in source]
    want = Counter((r["doc_id"], b" ".join(x for x, g in zip(w, gone) if not g).decode(), len(w), sum(gone))
                   for r, w, gone in zip(source, words, _kept(words, window)))
    assert _multiset(got, "doc_id", "text", "n_words", "n_removed") == want
    for r in got:
        assert sum(s["end"] - s["first"] for s in r["repeats"]) == r["n_removed"]


def _fingerprint(text):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _near_roots(prints, bits=4):
    f = np.array(prints, np.uint64)
    pairs = []
    for i in range(len(f)):
        j = np.flatnonzero(np.bitwise_count(f[i] ^ f) <= bits)
        pairs.append((np.full(len(j), i), j))
    return roots(len(f), pairs)


def _components(prints, ids, bits=4):
    root = _near_roots(prints, bits)
    least = {}
    for r, i in zip(root, ids):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in root]


def test_simhash_groups_equal_brute_force(docs):
    source = _rows(docs)
    prints = [_fingerprint(r["text"]) for r in source]
    want = Counter(zip([r["doc_id"] for r in source], prints, _components(prints, [r["doc_id"] for r in source])))
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in _rows(simhash.simhash_groups(docs)))
    assert got == want


def test_simhash_keeps_one_of_each_group(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = [_fingerprint(r["text"]) for r in _rows(docs)]
    n_groups = len(set(_near_roots(prints).tolist()))
    assert {r["_row"] for r in _rows(kept)} == {"r"}
    assert kept.count() == n_groups


@pytest.mark.parametrize("block", [8192, 40])
def test_link_forest_finds_every_component(spark, monkeypatch, block):
    """Dense balls of near fingerprints, hot partition values split into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    prints = {int(c) for c in centre}
    for c in centre:
        for _ in range(200):
            prints.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False)))
    prints = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    from tidemark.llm.components import connected_components

    root = {r["node"]: r["root"] for r in connected_components(
        simhash.link_forest(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    want = _components(prints, signed)
    assert [root.get(s, s) for s in signed] == want


def test_thresholds_satisfy_the_pigeonhole_principle():
    rng = np.random.default_rng(1)
    for n in (100, 10**6, 10**9):
        bits = (rng.random((500, 64)) < rng.uniform(0.2, 0.8, 64)).astype(float)
        scheme = simhash.plan(n, bits.T @ bits * (n / 500))
        assert sorted(b for group, _ in scheme for b in group) == list(range(64))
        assert sum(t for _, t in scheme) == simhash.MAX_BITS - len(scheme) + 1


def _line_dedup(rows, sites, words):
    blank, spread, first = " \t\r\x0b\x0c", defaultdict(set), {}
    for r in rows:
        for i, x in enumerate((r["text"].split("\n") if r["text"] is not None else [])):
            x = x.strip(blank)
            if x and len(re.split(r"[ \t\r\x0b\x0c]+", x)) >= words:
                if r["source"] is not None:
                    spread[x].add(r["source"])
                key = (r["doc_id"] is not None, r["doc_id"] or 0, i)
                first[x] = min(first.get(x, key), key)
    for r in rows:
        if r["text"] is None:
            yield None
            continue
        yield "\n".join(x for i, x in enumerate(r["text"].split("\n")) if len(spread[x.strip(blank)]) < sites
                        or first[x.strip(blank)] == (r["doc_id"] is not None, r["doc_id"] or 0, i))


@pytest.mark.parametrize("sites,words", [(3, 3), (2, 1)])
@pytest.mark.parametrize("broadcast_lines", [lines.BROADCAST_LINES, 0])
def test_line_dedup_equals_brute_force(docs, sites, words, broadcast_lines):
    one = docs.dropDuplicates(["doc_id"]).where("doc_id is not null or text is null")
    source = _rows(one)
    want = Counter(zip([r["doc_id"] for r in source], _line_dedup(source, sites, words)))
    got = lines.line_dedup(one, sites=sites, min_words=words, broadcast_lines=broadcast_lines)
    assert got.columns == [*docs.columns, "_ld_lines", "_ld_removed"]
    assert _multiset(_rows(got), "doc_id", "text") == want


def test_line_dedup_of_repeated_rows(docs):
    wide, joined = (lines.line_dedup(docs, sites=2, broadcast_lines=n) for n in (lines.BROADCAST_LINES, 0))
    assert wide.count() == docs.count()
    assert _multiset(_rows(wide), *wide.columns) == _multiset(_rows(joined), *wide.columns)


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i, f"line on {k} sites\nown {i}", f"site{j}") for k in (9, 10, 11) for j in range(k) for i in [k * 100 + j]]
    got = {r["doc_id"]: r["_ld_removed"] for r in _rows(lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    assert got == {i: int(i >= 1000 and i % 100 > 0) for i, _, _ in rows}


def test_zip64_directory_and_range_reads():
    for wide in (False, True):
        out = io.BytesIO()
        z = warc_zip.ZipStore(out, force64=wide)
        z.add("a/b.bin", [b"hello", b"!"], 6, zlib.crc32(b"hello!"))
        z.add("empty", [], 0, 0)
        z.close()
        raw = out.getvalue()
        assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
        assert (b"PK\x06\x06" in raw) == wide
        reads = []
        found = warc_zip.zip_directory(lambda at, n: reads.append(n) or raw[at:at + n], len(raw))
        assert {k: raw[s:s + n] for k, (s, n) in found.items()} == {"a/b.bin": b"hello!", "empty": b""}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:  # another writer's archive, with a comment and a packed member
        z.writestr("stored", b"plain")
        z.writestr("packed", b"x" * 999, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    raw = out.getvalue()
    found = warc_zip.zip_directory(lambda at, n: raw[at:at + n], len(raw))
    assert {k: raw[s:s + n] for k, (s, n) in found.items()} == {"stored": b"plain"}
    with pytest.raises(ValueError):
        warc_zip.zip_directory(lambda at, n: b"no zip"[at:at + n], 6)


def test_warc_round_trip_and_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "ARCHIVE_BYTES", 5000)
    big, other, long_ = "x" * 1500, "é" * 600, "long " * 200_000
    rows = [(None, None, None), (1, "u", big), (2, "u2", big), (2, "u2", big), (3, "u", "short"), (4, "u", "short"), (5, "a\r\nb", other),
            (6, "", other), (None, "n", big), (7, "u", ""), (8, "u", long_), (9, "u", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    archives = warc_zip.write_archives(pages)
    got = _rows(warc_zip.read_archives(archives))
    assert len(got) == len(rows)
    want = Counter()
    for page_id, _, html in rows:
        raw = (html or "").encode()
        top = {big: 2, other: 6}.get(html)
        revisit = top is not None and (page_id != top)
        want[page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None,
             None if revisit else raw] += 1
    digest = hashlib.sha1(big.encode()).hexdigest()  # of the equal rows of page 2 one revisits the other
    want[2, 1500, digest, "response", None, big.encode()] -= 1
    want[2, 1500, digest, "revisit", 2, None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                    None if r["payload"] is None else bytes(r["payload"])) for r in got) == want


def test_archives_are_read_by_tasks_of_their_own(spark):
    pages = spark.createDataFrame([(i, "u", "y" * 1000 + str(i)) for i in range(24)], "page_id long, url string, html string").repartition(12)
    archives = warc_zip.write_archives(pages)
    n = archives.count()
    read = warc_zip.read_archives(archives).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("records"))
    rows = read.collect()
    assert n >= 8 and len(rows) == n and sum(r["records"] for r in rows) == 24


def _package(path, archives, indexes):
    """A ZIP of stored members: archives {name: page ids}, indexes {name: (archives, with key and time)}."""
    places, members = {}, {}
    for name, ids in archives.items():
        parts, at = [], 0
        for i in ids:
            html = f"page {i}".encode()
            parts.append(gzip.compress(warc_zip.warc_record(i, "u", html, hashlib.sha1(html).digest(), None, False)))
            places.setdefault(name, []).append({"filename": name, "offset": at, "length": len(parts[-1])})
            at += len(parts[-1])
        members[f"archive/{name}"] = b"".join(parts)
    for name, (of, keyed) in indexes.items():
        members[f"indexes/{name}"] = "".join(
            ("com,u)/ 20240101000000 " if keyed else "") + json.dumps(p) + "\n" for a in of for p in places[a]).encode()
    with open(path, "wb") as out:
        z = warc_zip.ZipStore(out)
        for name, raw in members.items():
            z.add(name, [raw], len(raw), zlib.crc32(raw))
        z.close()
    return (str(path),)


def test_archives_of_several_members_and_indexes(spark, tmp_path):
    both = _package(tmp_path / "a", {"data.warc.gz": [1, 2], "more.warc.gz": [3, 4]}, {"index.cdxj": (["data.warc.gz"], False),
                                                                                     "more.cdxj": (["more.warc.gz", "data.warc.gz"], True)})
    other = _package(tmp_path / "b", {"rec-0.warc.gz": [5], "rec-1.warc.gz": [6]}, {"all.cdx": (["rec-0.warc.gz", "rec-1.warc.gz"], True)})
    got = _rows(warc_zip.read_archives(spark.createDataFrame([both, other], "path string")))
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got) == [(i, f"page {i}") for i in range(1, 7)]
    path, = _package(tmp_path / "c", {"data.warc.gz": [1], "lost.warc.gz": [2]}, {"index.cdxj": (["data.warc.gz"], False)})
    raw = open(path, "rb").read()
    with pytest.raises(ValueError, match="no index"):
        warc_zip.record_places(lambda at, n: raw[at:at + n], len(raw), path)


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(5)
    counts = np.array([1, 4, 2, 6])
    unary, step = rng.normal(size=13) * 3, rng.normal(size=(2, 2)) * 2
    good, expected, log_z = quality.forward_backward(unary, step, counts)
    at, total, moves = 0, 0.0, np.zeros((2, 2))
    for n in counts:
        score = {y: sum(unary[at + i] * y[i] for i in range(n)) + sum(step[a, b] for a, b in zip(y, y[1:])) for y in product((0, 1), repeat=n)}
        z = np.log(sum(np.exp(s) for s in score.values()))
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(np.exp(s - z) for y, s in score.items() if y[i]), abs=1e-9)
        for y, s in score.items():
            for a, b in zip(y, y[1:]):
                moves[a, b] += np.exp(s - z)
        at, total = at + n, total + z
    assert log_z == pytest.approx(total) and np.allclose(moves, expected)


def test_line_features_see_each_line_alone():
    texts = ["", "a\n\nb B", "THE!! END!!\nThe the the the", "x"]
    raw = [t.encode() for t in texts]
    offs = np.append(0, np.cumsum([len(r) for r in raw]))
    own, size, counts = quality.line_features(np.frombuffer(b"".join(raw), np.uint8), offs)
    assert counts.tolist() == [1, 3, 2, 1] and size.tolist() == [0, 1, 0, 3, 11, 15, 1]
    at = 0
    for r, n in zip(raw, counts):
        alone, _, _ = quality.line_features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert (alone == own[at:at + n]).all()
        at += n


def test_unary_equals_features_times_weights():
    rng = np.random.default_rng(2)
    own = rng.integers(0, 2, (9, quality.N_LINE)).astype(np.uint8)
    counts = np.array([1, 5, 3])
    model = quality.Model(rng.normal(size=quality.N_FEATURES), np.zeros((2, 2)))
    assert np.allclose(model.unary(own, counts), quality.chain_features(own, counts) @ model.weight, atol=1e-5)


def test_feature_sums_equal_features_times_weights():
    rng = np.random.default_rng(1)
    counts = np.array([1, 5, 1, 9, 2])
    own = (rng.random((18, quality.N_LINE)) < 0.3).astype(np.uint8)
    weight = rng.normal(size=18)
    assert np.allclose(quality.feature_sums(own, counts, weight), quality.chain_features(own, counts).T @ weight, atol=1e-5)


def test_training_rows_and_lines_are_bounded(spark, monkeypatch):
    """A repeated id with other texts, equal rows and long documents stay within the sample's bounds."""
    seen = []

    def train(own, size, lines, label, rounds=200):
        seen.append((len(label), int(lines.sum()), len(own)))
        return quality.Model(np.zeros(quality.N_FEATURES), np.zeros((2, 2)))

    monkeypatch.setattr(quality, "train", train)
    monkeypatch.setattr(quality, "SAMPLE", 50)
    rows = [(1, f"text {i}\nof id 1") for i in range(400)] + [(1, "same")] * 300 + [(i, "a\n" * 99 + str(i)) for i in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 300)], "doc_id long, quality int")
    quality.fit(docs, labels)
    monkeypatch.setattr(quality, "SAMPLE_LINES", 500)
    quality.fit(docs, labels)
    assert seen[0][0] == 50 and seen[1][0] < 50 and seen[1][1] <= 500 and all(n == m for _, n, m in seen)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    scored = quality.score_documents(docs.select("doc_id", "text"), model, keep_text=False)
    rows = scored.where(quality.held_out("doc_id")).join(labels, "doc_id").collect()
    right = np.mean([(r["score"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in rows])
    assert right > 0.98 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)


def test_quality_of_odd_rows_and_labels(spark, docs):
    labels = spark.createDataFrame([(5, 1, "x"), (6, 0, "x"), (6, 0, "x"), (7, None, "x"), (None, 1, "x"), (777, 1, "x")],
                                   "doc_id long, quality int, text string")
    model = quality.fit(docs, labels)
    got = quality.score_documents(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"]
    scores = [r["score"] for r in _rows(got)]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    blank = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in _rows(quality.score_documents(docs.limit(3), blank))} == {0.5}


def test_pack_places_every_token_once(docs):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER).encode
    want, total = Counter(), 0
    for r in _rows(docs):
        ids = np.array([*encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), 256)):
            want[r["doc_id"], k, a, len(ids[a:a + 256]), zlib.crc32(ids[a:a + 256].tobytes())] += 1
    got = _rows(packing.pack(docs, TOKENIZER, capacity=256))
    assert _multiset(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        end = 0
        for a, n in sorted(p):
            assert a == end
            end += n
        assert end <= 256
    assert len(places) <= 1.05 * total / 256 + 1


def test_plan_is_gapless_and_tight():
    rng = np.random.default_rng(0)
    for cap, most, n in ((10, 10, 500), (4096, 4096, 3000), (4096, 900, 3000), (100, 60, 2000), (50, 50, 1)):
        counts = Counter(rng.integers(1, most + 1, n).tolist())
        places, seen = defaultdict(list), Counter()
        for length, first, k, sequence, m, offset in packing.plan(counts, cap):
            assert first == seen[length]
            seen[length] += k
            for p in range(k):
                places[sequence + p // m].append((offset + p % m * length, length))
        assert seen == counts
        for p in places.values():
            end = 0
            for a, size in sorted(p):
                assert a == end
                end += size
            assert end <= cap
        large = sum(v for k, v in counts.items() if 2 * k > cap)
        assert len(places) <= max(large, 1.12 * sum(k * v for k, v in counts.items()) / cap) + 1


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4096, 4097):
        assert sorted(sharding.feistel(np.arange(n), n).tolist()) == list(range(n))


def test_shard_laws(docs):
    got = _rows(sharding.shard(docs, shards=16))
    source = _rows(docs)
    assert _multiset(got, "doc_id", "size", "text_crc32") == Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in source)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1
    again = _rows(sharding.shard(docs.repartition(5), shards=16))
    assert _multiset(again, "doc_id", "text_crc32", "shard", "slot") == _multiset(got, "doc_id", "text_crc32", "shard", "slot")


@pytest.mark.parametrize("shards", [1, 7, 16])
def test_shard_and_slot_from_a_sorted_list(docs, shards):
    """Rows numbered by a sort in Python; the permutation written out for single numbers."""
    rows = sorted(((r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in _rows(docs)),
                  key=lambda r: (r[0] is not None, r))
    n, mask = len(rows), 2 ** 64 - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    half = next(b for b in range(1, 40) if 4 ** b >= n)
    keys = [mixed(k + sharding.SEED * 7) for k in range(1, 7)]

    def place(v):
        while True:
            left, right = v >> half, v % 2 ** half
            for k in keys:
                left, right = right, left ^ mixed(right + k & mask) % 2 ** half
            v = left * 2 ** half + right
            if v < n:
                return v

    want = Counter((*r, place(i) % shards, place(i) // shards) for i, r in enumerate(rows))
    assert _multiset(_rows(sharding.shard(docs, shards=shards)), "doc_id", "text_crc32", "size", "shard", "slot") == want


def _item_words(text):
    raw = (text or "").encode()
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw))


@pytest.mark.parametrize("part_words", [10**6, 40])
def test_contamination_equals_brute_force(spark, docs, monkeypatch, part_words):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part_words)
    base = [t for t in _texts() if t and len(t) > 300]
    rows = [(1, " ".join(base[0].split()[5:30])), (1, " ".join(base[0].split()[5:30])), (20, base[2].upper()[:200]), (3, "one"), (4, None),
            (5, "..."), (None, " ".join(base[1].split()[:12])), (6, "A, b"), (7, " ".join(base[0].split()[10:21]) + " zzz"), (8, "not there")]
    items = spark.createDataFrame([(*r, "clash") for r in rows], "item_id long, text string, doc_id string")
    windows = defaultdict(set)
    for i, t in rows:
        w = _item_words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k:k + 10])] |= set() if i is None else {str(i)}
    want = Counter()
    for r in _rows(docs):
        w, found = _item_words(r["text"]), set()
        hit = [0] * len(w)
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit[i:i + size] = [1] * size
                    found |= windows[tuple(w[i:i + size])]
        want[r["doc_id"], len(w), sum(hit), tuple(sorted(found))] += 1
    got = _rows(decontaminate.contamination(docs, items))
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    clean = decontaminate.decontaminate(docs, items, most_cover=0.5)
    assert clean.columns == docs.columns
    left = _multiset(_rows(clean), "doc_id", "text")
    hit = Counter(r["doc_id"] for r in got if r["n_hit"])
    for r in _rows(docs):  # what is not hit stays as it is
        assert r["doc_id"] in hit or left[r["doc_id"], r["text"]]


@pytest.mark.parametrize("part_words", [10**6, 40])
def test_items_stay_out_of_the_driver(spark, docs, monkeypatch, part_words):
    def here(*_):
        raise AssertionError("an automaton is built in the driver")

    monkeypatch.setattr(decontaminate, "PART_WORDS", part_words)
    monkeypatch.setattr(decontaminate.SuffixAutomaton, "__init__", here)  # tasks have the class as it is
    monkeypatch.setattr(type(docs), "toLocalIterator", here)
    texts = [t for t in _texts() if t and len(t) > 300][:3]
    items = spark.createDataFrame([(k, " ".join(t.split()[:20 + k])) for k, t in enumerate(texts)], "item_id long, text string")
    got = _rows(decontaminate.contamination(docs, items))
    assert {i for r in got for i in r["items"]} == {"0", "1", "2"}


def test_an_item_text_of_very_many_ids_comes_back_whole(spark):
    text = " ".join(f"word{i}" for i in range(30))
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit(text).alias("text")).unionByName(
        spark.createDataFrame([(-1, "word3 word4 other"), (None, text)], "item_id long, text string"))
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "word3 word4 other"), (3, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    assert got[1]["items"] == sorted(str(i) for i in range(20_000)) and got[1]["n_hit"] == 30
    assert got[2]["items"] == ["-1"] and got[3]["items"] == []


def test_a_large_automaton_stays_small():
    import pickle
    import tracemalloc

    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}".encode() for i in range(20_000)]
    texts = [([str(k)], [vocabulary[i] for i in rng.zipf(1.3, 100) % 20_000]) for k in range(1000)]
    raw = pickle.dumps(decontaminate.SuffixAutomaton(texts, 10), pickle.HIGHEST_PROTOCOL)
    tracemalloc.start()
    automaton = pickle.loads(raw)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 80 * 100_000 and automaton.scan(texts[7][1])[1] >= {"7"}  # bytes a word


def test_remove_words_keeps_the_rest():
    raw = "Héllo, the (cat) sat. On\tmats!".encode()
    assert decontaminate.remove_words(raw, [(1, 3)]).decode() == "Héllo, ) sat. On\tmats!"[:7] + ") sat. On\tmats!"
    assert decontaminate.remove_words(raw, []) == raw


def _vectors(spark, dim=24):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, dim))
    rows = [b.astype(np.float32).tolist() for b in base]
    rows += [(base[i % 20] + 0.03 * rng.normal(size=dim)).astype(np.float32).tolist() for i in range(200)]
    rows += [rows[0]] * 30 + [(2 * np.array(rows[1])).tolist()]
    rows += [None, [], [0.0] * dim, [float("nan")] + rows[2][1:], [float("inf")] + rows[2][1:], [None] + rows[2][1:], [1.0, 2.0], [2.0, 4.0], [3e38] * dim, [1e38] * dim]
    out = [(i, r, "x") for i, r in enumerate(rows)] + [(3, rows[3], "x"), (None, rows[4], "x")]
    return spark.createDataFrame(out, "vec_id long, embedding array<float>, kept string")


@pytest.mark.parametrize("blocks", [(4096, 16384), (16, 32)])
def test_embedding_groups_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(embedding, "INDEX_BLOCK", blocks[0])
    monkeypatch.setattr(embedding, "QUERY_BLOCK", blocks[1])
    vectors = _vectors(spark)
    source = vectors.collect()
    good, units = [], []
    for k, r in enumerate(source):
        v = r["embedding"]
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append(k)
            units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)))
    links, pairs = Counter(), []
    for a, i in enumerate(good):
        for b, j in enumerate(good):
            if a != b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.95:
                links[i] += 1
                pairs.append((np.array([i]), np.array([j])))
    root, least = roots(len(source), pairs), {}
    for k, r in enumerate(source):
        if r["vec_id"] is not None:
            least[root[k]] = min(least.get(root[k], r["vec_id"]), r["vec_id"])
    want = Counter((r["vec_id"], links[k], least.get(root[k]), r["vec_id"] is not None and r["vec_id"] == least.get(root[k]))
                   for k, r in enumerate(source))
    got = _rows(embedding.embedding_groups(vectors, spread=None))
    assert _multiset(got, "vec_id", "n_links", "component_id", "kept") == want
    near = _rows(embedding.embedding_groups(vectors))
    assert sum(r["n_links"] for r in near) >= 0.9 * sum(links.values())


def test_embedding_links_along_few_directions(spark):
    rng = np.random.default_rng(8)
    flat = rng.normal(size=(600, 3)) @ np.linalg.qr(rng.normal(size=(256, 3)))[0].T  # differences have no random direction
    unit = flat / np.linalg.norm(flat, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    rows = [(i, v.tolist()) for i, v in enumerate(flat)]
    got = _rows(embedding.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate((close.sum(1) - 1).tolist()))
    root = roots(600, [np.nonzero(close)])
    assert {r["vec_id"]: r["component_id"] for r in got} == dict(enumerate(root.tolist()))


@pytest.fixture
def dealt(spark, monkeypatch):
    """The rows that embedding_groups deals to blocks of lists, once per call."""
    frames, kind = [], type(spark.range(0))
    grouped = kind.groupBy

    def kept(self, *cols):
        if "block" in cols:
            frames.append(self)
        return grouped(self, *cols)

    monkeypatch.setattr(kind, "groupBy", kept)
    return frames


def test_embedding_rows_dealt_follow_the_vectors(spark, dealt):
    rng = np.random.default_rng(14)
    per = []
    for n in (1000, 4000):  # vectors without clusters: planes prune little, and lists are as many as the root of n
        rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 32)))]
        embedding.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        per.append(dealt[-1].count() / n)
    assert per[1] < 1.4 * per[0] and per[1] < 10


def test_embedding_links_of_split_groups_of_lists(spark, monkeypatch, dealt):
    monkeypatch.setattr(embedding, "INDEX_BLOCK", 60)
    monkeypatch.setattr(embedding, "QUERY_BLOCK", 50)
    rng = np.random.default_rng(15)
    unit = np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(300, 6)) * 0.4 + [2, 1, 0, 0, 0, 0]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    side = rng.normal(size=(100, 6))
    side -= (side * unit[:100]).sum(1)[:, None] * unit[:100]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    at = 0.95 + np.where(np.arange(100) % 2, 1e-9, -1e-9)[:, None]  # just above and just below the limit
    unit = np.concatenate([unit, at * unit[:100] + np.sqrt(1 - at * at) * side])
    close = unit @ unit.T >= 0.95
    assert (close[np.arange(100), np.arange(600, 700)] == (np.arange(100) % 2 == 1)).all()
    rows = [(i, v.tolist()) for i, v in enumerate(unit)]
    got = _rows(embedding.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lists=40))
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate((close.sum(1) - 1).tolist()))
    root = roots(700, [np.nonzero(close)])
    assert {r["vec_id"]: r["component_id"] for r in got} == dict(enumerate(root.tolist()))
    assert dealt[-1].where("block > 0 AND NOT indexed").groupBy("group", "part").agg(F.countDistinct("own").alias("k")).where("k > 1").count()


def test_viterbi_in_blocks_equals_whole_path(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for conv, turns in ((1, 60), (2, 1), (3, 9), (None, 4), (4, 2)):
        for t in range(turns):
            role = "system" if t == 0 and conv == 3 else ("user", "assistant")[t % 2]
            rows.append((conv, t, role, None if conv == 4 and t else _prose(int(rng.integers(1000)), int(rng.integers(1, 40))) + "\nsecond line", "clash"))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, line string")
    out = []
    for block in (8192, 7):
        monkeypatch.setattr(chat, "BLOCK", block)
        out.append(_multiset(_rows(chat.format_chats(turns)), "conv_id", "turn", "role", "text", "rendered"))
    assert out[0] == out[1]


def test_viterbi_equals_enumeration():
    """Every state path of short transcripts, scored from its definition."""
    rng = np.random.default_rng(8)
    k = len(chat.STATES)
    for n in (1, 2, 3, 5):
        step = rng.uniform(0.001, 1, (k, k))
        model = chat.Hmm(np.log(rng.dirichlet(np.ones(k))), np.log(step / step.sum(1, keepdims=True)), np.log(rng.dirichlet(np.ones(chat.N_SYMBOLS), k)))
        symbol = rng.integers(0, chat.N_SYMBOLS, n)

        def score(path, enter):
            first = model.start[path[0]] if enter < 0 else model.step[enter, path[0]]
            return first + sum(model.step[a, b] for a, b in zip(path, path[1:])) + sum(model.seen[s, o] for s, o in zip(path, symbol))

        paths = list(itertools.product(range(k), repeat=n))
        for enter, leave in ((-1, -1), (2, -1), (-1, 3), (4, 1)):
            best = max((score(p, enter), p) for p in paths if leave in (-1, p[-1]))
            got = model.path(symbol, enter, leave).tolist()
            assert abs(score(got, enter) - best[0]) < 1e-9 and leave in (-1, got[-1])
        whole = model.reduce(symbol)
        for enter in (-1, 0, 5):
            for leave in range(k):
                assert abs(whole[enter, leave] - max(score(p, enter) for p in paths if p[-1] == leave)) < 1e-9


def test_rows_of_one_turn_keep_their_lines(spark):
    """Repeated rows and rows of equal turn with other texts; conversations 0 to 59 train or not, in all styles."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"say {c} {t}\nmore {c} {t}") for c in range(60) for t in range(4)]
    for c in range(60):
        rows += [(c, 1, "assistant", f"other {c}\nsecond {c}"), (c, 2, "user", f"say {c} 2\nmore {c} 2"), (c, None, "user", f"null {c}\nturn {c}")]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, row string, tie string").repartition(6)
    lines = chat.transcript_lines(turns)
    style = {r["conv"]: r["s"] for r in lines.select("conv", F.pmod(F.xxhash64("conv"), F.lit(4)).alias("s")).distinct().collect()}
    got = defaultdict(list)
    for r in sorted(_rows(chat.format_chats(turns)), key=lambda r: (r["conv_id"], r["turn"])):
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert set(style.values()) == {0, 1, 2, 3}
    for c in range(60):
        said = [(role, text) for conv, _, role, text in rows if conv == c]
        if style[c] == 3:  # no markers: turns may be joined, but lines stay next to each other
            flat = "\n".join(t for _, t in got[c])
            assert all(flat.replace("\n\n", "\n").count(t) >= said.count((r, t)) for r, t in said)
        else:
            assert Counter(got[c]) == Counter(said) and got[c][0] == ("user", f"null {c}\nturn {c}")


def test_chat_recovers_marked_roles_and_texts(spark):
    sf = "/root/testdata/sf0.01"
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in _rows(chat.format_chats(turns))}
    want = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in _rows(turns)}
    held = [k for k in want if zlib.crc32(str(k[0]).encode()) % 5 == 0]
    assert np.mean([got.get(k) == want[k] for k in held]) > 0.95


def test_markers():
    for line, role, rest in (("User: hi", 1, "hi"), ("### Assistant", 2, ""), ("[system] be kind", 0, "be kind"), ("<|human|> x", 1, "x"),
                             ("**Answer:** y", 2, "y"), ("a: z", 2, "z"), ("usermode: x", -1, "usermode: x"), ("User hi", -1, "User hi"), ("", -1, "")):
        assert (chat.marker(line)[0], line[chat.marker(line)[1]:]) == (role, rest)


def test_empty_tables(spark, docs):
    empty = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert substring.substring_dedup(empty).count() == 0
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).columns == docs.columns
    assert lines.line_dedup(empty).count() == 0
    assert packing.pack(empty, TOKENIZER).count() == 0
    assert sharding.shard(empty).count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert {r["n_hit"] for r in _rows(decontaminate.contamination(docs, items))} == {0}
    assert quality.score_documents(empty, quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    assert embedding.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert warc_zip.read_archives(warc_zip.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_missing_columns_are_named(docs):
    with pytest.raises(ValueError, match="nothing"):
        substring.substring_dedup(docs, text_col="nothing")
