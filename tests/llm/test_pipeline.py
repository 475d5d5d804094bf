"""The registered queries against DuckDB and the pipeline against its stages' own brute force."""

from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from conftest import SF001, SF01
from tidemark.llm.queries import QUERIES, SQL
from tidemark.plans.compare import compare, duckdb_connection
from test_operators import _fingerprint, _item_words, _line_dedup


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, name):
    res = compare(QUERIES[name](spark, SF01), duckdb_connection(SF01), SQL[name])
    assert res["match"] and "type_diffs" not in res, res


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(registered.queries())
    assert set(SQL) <= set(registered.oracle_sql())
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_stages_on_the_small_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF001)
        if name != "best_fit_packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        seen[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in spark.read.parquet(str(tmp_path / str(k))).collect()])
        docs = spark.read.parquet(str(tmp_path / str(k)))

    before, after = seen["quality_classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    good = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1]
    assert np.mean([i in kept for i in good]) > 0.95

    before, after = seen["line_dedup"]
    want = dict(zip([r["doc_id"] for r in before], _line_dedup(before, 10, 3)))
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = seen["simhash_near_dedup"]
    prints = {r["doc_id"]: _fingerprint(r["text"]) for r in before}
    kept = [r["doc_id"] for r in after]
    near = lambda a, b: (a ^ b).bit_count() <= 4
    group = {i: i for i in prints}
    for i in sorted(prints):  # components by repeated relabelling
        for j in prints:
            if near(prints[i], prints[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert sorted(kept) == sorted(set(group.values()))

    before, after = seen["benchmark_decontamination"]
    windows = {tuple(w[i:i + 10]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
               for w in [_item_words(r["text"])] for i in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[i:i + 10]) in windows for w in [_item_words(t)] for i in range(len(w) - 9))
    old, new = {r["doc_id"]: r["text"] for r in before}, {r["doc_id"]: r["text"] for r in after}
    assert not any(hit(t) for t in new.values())
    assert all(new[i] == t for i, t in old.items() if not hit(t))

    before, after = seen["best_fit_packing"]
    assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF001).collect()) == Counter(
        (r["doc_id"], r["piece"], r["ids_crc32"]) for r in after)
