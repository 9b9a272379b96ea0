"""The registered queries against plain versions, over whole tables."""

import os
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm import brute
from tools.check import compare, connect

FOLDER = os.environ.get("LLM_FOLDER", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


def name_of(prefix):
    return next(n for n in entry.queries() if n.startswith(prefix))


def result(spark, prefix, *columns):
    return sorted(tuple(r[c] for c in columns) for r in entry.queries()[name_of(prefix)](spark, FOLDER).collect())


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()


@pytest.mark.parametrize("prefix", ["op2_", "op7_", "op9_"])
def test_sql(prefix, spark):
    name = name_of(prefix)
    line = compare(name, entry.queries()[name], entry.oracle_sql()[name], spark, FOLDER, connect(FOLDER))
    assert line.startswith("ok") and "TYPES" not in line, line


def test_near_duplicates(spark, docs):
    assert result(spark, "op1_", "doc_id", "fingerprint", "component_id") == sorted(brute.near(docs))


def test_exact_duplicates(spark, docs):
    assert result(spark, "op2_", "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(docs))


def test_tokens(spark, docs):
    assert result(spark, "op3_", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(brute.tokens(docs))


def test_license_base(spark, docs):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    found = result(spark, "op4_", *columns)
    assert [r[:6] for r in found] == sorted(brute.licenses(docs), key=lambda r: r[0])
    assert all(set(r[5].split(",")) <= set(r[6].split(",")) | {""} and 0 <= r[7] <= 1 for r in found)
    assert any(r[6] != r[5] for r in found)


def test_packing(spark, docs):
    found = result(spark, "op5_", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert [r[:5] for r in found] == sorted(brute.pieces(docs))
    by = defaultdict(list)
    for r in found:
        by[r[5]].append((r[6], r[3]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by) == brute.best_fit_decreasing([r[3] for r in found])


def test_quality(spark, docs):
    found = result(spark, "op6_", "doc_id", "held_out", "score", "predicted")
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    assert [r[0] for r in found] == sorted(i for i, _ in docs)
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, _, s, p in found)
    good, bad = ([s for i, h, s, _ in found if h and labels.get(i) == q] for q in (1, 0))
    wins = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print("held-out area under the curve", wins)
    assert wins > 0.9


def test_personal_data(spark, docs):
    found = result(spark, "op10_", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    want = sorted(brute.personal(docs))
    assert [r[:6] for r in found] == [r[:6] for r in want]
    assert all(set(w[6]) <= set(r[6].split(",")) for r, w in zip(found, want))


def test_nearest_recall(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    found = defaultdict(dict)
    for q, rank, v, score in result(spark, "op8_", "query_id", "rank", "vec_id", "score"):
        found[q][rank] = (v, score)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = np.lexsort((ids, -scores))[: min(20, len(ids) - 1)]
        own = [found[ids[q]][r] for r in sorted(found[ids[q]])]
        assert sorted(found[ids[q]]) == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
        by_id = dict(zip(ids, scores))
        assert all(abs(by_id[v] - s) < 1e-12 for v, s in own)
        hits += len({v for v, _ in own} & set(ids[want]))
        total += len(want)
    print("recall", hits / total)
    assert hits / total >= 0.9
