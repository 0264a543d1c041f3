"""The pipeline's stages against brute force on the smallest tables."""

import re
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

import corpus_pipeline
from test_llm_pairs import groups, words
from test_llm_texts import BASE, holds


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


STAGES = dict(corpus_pipeline.STAGES)


def test_quality_follows_the_labels(spark, sf_dir, documents):
    kept = set(ids(STAGES["quality"](spark, documents, sf_dir)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert sum((r["doc_id"] in kept) == (r["quality"] == 1) for r in labels) >= 0.93 * len(labels)


def test_one_of_each_group_stays(spark, sf_dir, documents, rows):
    component = groups(rows, 80, 100)
    assert ids(STAGES["near_duplicates"](spark, documents, sf_dir)) == sorted(i for i, (_, c) in component.items() if c == i)


def test_documents_with_benchmark_windows_go(spark, sf_dir, documents, rows):
    windows = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r["text"])
        n = min(10, len(w))
        windows.setdefault(n, set()).update(tuple(w[k:k + n]) for k in range(len(w) - n + 1))
    clean = [i for i, t in rows if not any(tuple(d[p:p + n]) in of for d in [words(t)] for n, of in windows.items() if n for p in range(len(d) - n + 1))]
    assert ids(STAGES["decontamination"](spark, documents, sf_dir)) == sorted(clean) and len(clean) < len(rows)


def test_personal_data_is_replaced_and_nothing_else(spark, sf_dir, documents, rows):
    out = {r["doc_id"]: r for r in STAGES["pii"](spark, documents, sf_dir).collect()}
    assert len(out) == len(rows)
    found = lambda t: [m.group() for k, p in BASE.items() for m in re.finditer(p, t) if holds(k, m.group())]
    for i, t in rows:
        assert out[i]["n_chars"] == len(out[i]["text"])
        assert (out[i]["text"] == t) == (not found(t)) and not found(out[i]["text"])


def test_every_piece_of_the_rest_is_packed(spark, sf_dir):
    result = corpus_pipeline.run(spark, sf_dir).collect()
    filled = {}
    for r in sorted(result, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
