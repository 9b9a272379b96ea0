"""The pipeline's rows against plain versions of its stages, one after the other."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from weekgrid.llm import pii, quality

FOLDER = os.environ.get("LLM_FOLDER", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


def kept_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(brute.UPPER)
    owner = {}
    for i, t in docs:
        for k in map(key, t.split("\n")):
            owner[k] = min(i, owner.get(k, i))
    return [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i)) for i, t in docs]


def near_groups(docs):
    """The least id of each document's group, chained over all pairs of Jaccard similarity 0.8 or more of five-word shingles."""
    sets = []
    for _, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t.translate(brute.UPPER))
        sets.append({" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = [i for i, _ in docs]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and 10 * len(a & b) >= 8 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_pipeline(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    model = quality.fit(read("documents"), read("labels"))
    docs = [(i, t) for i, t in docs if quality.score_text(model, t) >= corpus_pipeline.THRESHOLD]
    docs = kept_lines(docs)
    stays = set(near_groups(docs))
    assert len(stays) < len(docs)
    docs = [(i, t) for i, t in docs if i in stays]
    spans = pii.personal_spans(spark.createDataFrame(docs, "doc_id long, text string"))
    by = {r["doc_id"]: sorted((s["start"], s["end"], s["kind"]) for s in r["spans"]) for r in spans.collect()}
    masked = []
    for i, t in docs:
        out, at = "", 0
        for start, end, kind in by[i]:
            if start >= at:
                out += t[at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, end)
        masked.append((i, out + t[at:]))
    found = entry.queries()["pipeline"](spark, FOLDER).collect()
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    assert got == sorted(brute.pieces(masked))
    assert len({r["sequence_id"] for r in found}) == brute.best_fit_decreasing([r["length"] for r in found])
    assert not any(brute.personal(masked)[k][j] for k in range(len(masked)) for j in range(1, 5))
