"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; and the operators' inner parts."""

import random
from collections import Counter
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from weekgrid.llm import ann, bpe, chat, exact, licenses, lines, packing, pii, quality, queries, simhash

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
TEXTS = [
    (1, None), (2, ""), (3, "Hello World, this is a test"), (4, "hello world, THIS is a test"), (4, "hello world, THIS is a test"),
    (5, LONG), (6, LONG.upper()), (7, LONG + "x"), (8, "É é"), (9, "é é"), (10, "\n\n \n"), (11, "one\ntwo lines of it\nTwo LINES of it \n"),
    (12, "two lines of it"), (13, "a\u0000b\U0001f600 c"), (None, "two lines of it"), (None, None),
]
SCHEMA = "doc_id long, text string"
# Columns named as the operators' own ones.
CLASH = ["fp", "key", "hash", "part", "digest", "kept", "label", "line_doc", "line_hashes", "line_dedup", "place", "kept_id", "spans", "n_chars", "score"]


def frame(spark, rows=TEXTS, clash=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in CLASH}) if clash else df


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_rows(spark):
    found = rows(exact.content_groups(frame(spark, clash=True)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert len(found) == len(TEXTS)
    groups = {}
    for i, t in TEXTS:
        groups.setdefault((t or "").translate(brute.UPPER), []).append(i)
    by = {sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for _, keep, size, _, digest in found:
        assert keep == max(i for i in by[digest] if i is not None) and size == len(by[digest])
    assert Counter(r[4] for r in found if r[3]) == Counter(dict.fromkeys(by, 1))  # one row of a group stays, also of rows with one id
    assert exact.content_groups(frame(spark, [])).count() == 0
    only = rows(exact.content_groups(frame(spark, [(None, "x"), (None, "x")])), "keep_id", "group_size", "kept")
    assert sorted(only, key=repr) == [(None, 2, False), (None, 2, True)]


def test_grace_spills_and_recurses():
    rng = random.Random(5)
    contents = [bytes([rng.randrange(97, 103)]) * rng.randrange(1, 9) for _ in range(3000)] + [b"hot"] * 3000
    records = [(c, [i], 1, (True, i, i)) for i, c in enumerate(contents)]
    groups = {c: (sorted(v[0]), v[1], v[2]) for c, v in exact.grace(iter(records), memory=300)}
    want = {}
    for i, c in enumerate(contents):
        want.setdefault(c, []).append(i)
    assert groups == {c: (v, len(v), (True, max(v), max(v))) for c, v in want.items()}


def test_exact_with_little_memory(spark):
    rows_ = [(i, f"text {i % 37} " * (i % 5 + 1)) for i in range(900)]
    found = rows(exact.content_groups(frame(spark, rows_), memory=500), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert found == sorted(brute.exact(rows_), key=repr)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    given_ = [r for r in TEXTS if r[0] is not None and r != (4, "hello world, THIS is a test")] + [(4, "Hello World, this is a test\nhello"), (14, None)]
    found = lines.dedup_lines(frame(spark, given_), batches=batches, fanout=fanout)
    got = rows(found.select("doc_id", "line_dedup.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")), "doc_id", "n_lines", "n_dropped", "h")
    assert got == sorted(brute.lines(given_), key=repr)


def test_lines_defined_cases(spark):
    found = lines.dedup_lines(frame(spark, clash=True))
    assert found.columns == ["doc_id", "text", *CLASH, "line_dedup_"] and found.count() == len(TEXTS)
    kept = rows(found.filter("doc_id IS NULL OR doc_id IN (4, 12)"), "doc_id", "text")
    assert (None, "two lines of it") in kept  # without an id nothing goes
    assert (12, "") in kept and kept.count((4, "")) == 2  # 3 holds the line of 4
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_near_duplicate_rows(spark):
    known = [r for r in TEXTS if r[0] is not None]
    found = rows(simhash.near_duplicates(frame(spark, known, clash=True)).select("doc_id", simhash.hex_column(F.col("fp")).alias("f"), "component_id"), "doc_id", "f", "component_id")
    assert found == sorted(brute.near(known), key=repr)
    everything = simhash.near_duplicates(frame(spark))
    assert everything.count() == len(TEXTS) and everything.filter("component_id IS NULL").count() == 0
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [16_384, 3])
def test_links_are_whole(spark, bucket):
    """Dense clusters around few centers, and strangers: every component is found, also in split buckets."""
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set(rng.integers(0, 1 << 63, 200, dtype=np.uint64).tolist()) | {0, (1 << 64) - 1}
    for c in centers:
        at = int(c)
        for _ in range(120):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                at ^= 1 << int(b)
            fps.add(at)
            at = at if rng.random() < 0.5 else int(c)
    fps = np.array(sorted(fps), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    found = simhash.components(simhash.links(df, bucket=bucket)).collect()
    root = np.arange(len(fps))
    for i, f in enumerate(fps):
        roots = np.unique(root[np.bitwise_count(fps ^ f) <= 4])
        root[np.isin(root, roots)] = roots[0]
    want = {}
    for f, r in zip(fps.view(np.int64).tolist(), root.tolist()):
        want.setdefault(r, set()).add(f)
    got = {}
    for r in found:
        got.setdefault(r["root"], {r["root"]}).add(r["node"])
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}
    # A forest, not all pairs: every entry brings a bounded number of links, however large its cluster.
    assert simhash.links(df, bucket=bucket).count() <= 45 * len(fps)


@pytest.mark.parametrize("cell", [1 << 17, 40])
def test_similar_links_are_whole(spark, cell):
    """Tight and loose groups of long fingerprints beside strangers, also in split buckets and crowded cells."""
    rng = np.random.default_rng(5)
    made = [int.from_bytes(rng.bytes(64), "little") for _ in range(150)] + [0, (1 << 512) - 1]
    for center, steps in ((made[0], 2), (made[1], 30), (made[2], 60)):
        at = center
        for _ in range(150):
            for b in rng.choice(512, rng.integers(1, steps), replace=False):
                at ^= 1 << int(b)
            made.append(at)
            at = at if rng.random() < 0.3 else center
    made = sorted({x.to_bytes(64, "little") for x in made})
    distance = simhash.similar_distance(0.8)
    edges = simhash.similar_links(spark.createDataFrame([(x,) for x in made], "fp binary").repartition(4), distance, cell)
    got = {}
    for r in simhash.components(edges).collect():
        got.setdefault(bytes(r["root"]), {bytes(r["root"])}).add(bytes(r["node"]))
    want = {}
    for x, c in zip(made, brute.linked([np.frombuffer(x, "<u8") for x in made], distance)):
        want.setdefault(c, set()).add(x)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_similar_stage(spark):
    """Copies with changed words go, less alike texts stay; rows without an id, repeated rows and ids, clashing columns."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    few, many = list(words), list(words)
    for k in (50, 200, 350):
        few[k] = "changed"
    for k in range(5, 400, 12):
        many[k] = "changed"
    text = " ".join(words)
    given = [(9, text), (3, " ".join(few)), (5, " ".join(many)), (7, text), (7, "another text under this id"), (7, "another text under this id"),
             (None, text), (None, "only here, without an id"), (1, None), (2, ""), (4, " \n"), (6, "short"), (8, "SHORT")]
    found = corpus_pipeline.near_dedup(spark, frame(spark, given, clash=True), "")
    assert found.columns == ["doc_id", "text", *CLASH]
    kept = [(r["doc_id"], (r["text"] or "")[:7]) for r in found.collect()]
    assert sorted(kept, key=repr) == sorted([(3, text[:7]), (5, text[:7]), (7, "another"), (None, "only he"), (1, ""), (6, "short")], key=repr)
    assert corpus_pipeline.near_dedup(spark, frame(spark, []), "").count() == 0


@lru_cache
def encoders(name):
    ranks = brute.ranks(name)
    others = [tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (P.PATTERN, queries.PATTERN)]
    return bpe.encoder(P.path(name), P.PATTERN), *others


ANY = st.text(alphabet=st.one_of(st.sampled_from("aehtn \n'.,19é世ß"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(ANY)
def test_tokens_of_any_text(text):
    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        own, other, fast = encoders(name)
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text.encode()
        assert ids == fast.encode_ordinary(text)


def test_every_token_is_a_merge():
    own, *_ = encoders("byte_bpe_multi_50k.tiktoken")
    for rank, token in own.bytes_of.items():
        if len(token) > 1:
            own.halves(rank)


def test_token_rows(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    found = rows(bpe.token_digests(frame(spark, clash=True), path, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == sorted(brute.tokens(TEXTS), key=repr)
    ids = frame(spark).select("text", bpe.encode_column(F.col("text"), path, P.PATTERN).alias("ids"))
    back = ids.select("text", bpe.decode_column(F.col("ids"), path, P.PATTERN).alias("data")).collect()
    assert all((r["text"] or "").encode() == bytes(r["data"]) for r in back)
    assert bpe.token_digests(frame(spark, []), path, P.PATTERN).count() == 0


def test_license_edits():
    near = "Foo.\nLicensd under teh Apache License, Version 2.0!  The MIT lcense. Released undr the MIT License; CC-BY."
    found = licenses.scan(near)
    assert {s[0] for s in found["spans"]} == {"apache-2.0", "mit", "cc-by"}
    for label, _, start, end, score in found["spans"]:
        assert 0.8 <= score <= 1 and {"apache-2.0": "Licensd", "mit": "Released", "cc-by": "CC"}[label] == near[start:end].split()[0].split("-")[0]
    # Any k edits leave a seed: every notice is found with random edits up to its allowance.
    rng = random.Random(2)
    for notice, label in licenses.NOTICES:
        for _ in range(20):
            chars = list(notice)
            for _ in range(max(1, len(notice) // licenses.CHARS_PER_EDIT) - 1):
                at = rng.randrange(1, len(chars) - 1)
                rng.choice([lambda: chars.insert(at, "q"), lambda: chars.pop(at), lambda: chars.__setitem__(at, "z")])()  # noqa: B023
            assert any(licenses.NOTICES[n][1] == label for n, *_ in licenses.fuzzy("so " + "".join(chars) + " it is"))
    assert licenses.scan("the quick brown fox has no license at all")["spans"] == []


def test_license_rows(spark):
    assert licenses.license_spans(frame(spark, clash=True)).count() == len(TEXTS)
    found = licenses.license_spans(frame(spark, [(1, None), (2, "CC BY cc by, All Rights\nReserved")])).collect()
    assert found[0]["n_words"] + found[1]["n_words"] == 7
    assert max(found, key=lambda r: r["n_words"])["places"] == [0, 2, 4]
    assert licenses.license_spans(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.integers(40, 64))
def test_rounds_are_best_fit_decreasing(lengths, capacity):
    runs = dict(Counter(lengths))
    matches, sequences = packing.plan_rounds(runs, capacity)
    assert sequences == brute.best_fit_decreasing(lengths, capacity)
    at, seen = {}, Counter()
    for length, rank, count, first, offset in matches:
        for i in range(count):
            at.setdefault(first + i, []).append((offset, length))
            seen[length, rank + i] += 1
    assert seen == Counter({(n, i): 1 for n, c in runs.items() for i in range(c)})
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


def test_packing_rows(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    found = packing.pack(packing.document_pieces(frame(spark, clash=True), path, queries.PATTERN, with_ids=True))
    assert rows(found, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(brute.pieces([(i, t or "") for i, t in TEXTS]), key=repr)
    assert found.filter(F.length("ids") != 4 * F.col("length")).count() == 0
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    empty = packing.pack(packing.document_pieces(frame(spark, []), path, queries.PATTERN))
    assert empty.count() == 0 and empty.columns[-2:] == ["sequence_id", "offset"]


def test_quality_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(3, None), (None, 1), (999, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, ("fine words in a row number %d " if i % 2 else "BAD!! STUFF!! %d!! ") % i * 20) for i in range(1, 60)], SCHEMA)
    model = quality.fit(docs, labels)
    assert quality.score_text(model, "fine words in a row number 77 " * 20) > 0.5 > quality.score_text(model, "BAD!! STUFF!! 77!! " * 20)
    assert quality.score_text(model, None) == quality.score_text(model, "") == model.base
    scores = rows(frame(spark, clash=True).select(quality.score_column(spark, model, F.col("text")).alias("s")), "s")
    assert len(scores) == len(TEXTS) and all(0 <= s <= 1 for (s,) in scores)
    for few in (labels.filter("quality = 1"), labels.limit(0)):
        plain = quality.fit(docs, few)
        assert quality.score_text(plain, "anything") == plain.base == (1.0 if few.count() else 0.5)


def vectors(spark, rows_):
    return spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int")


def test_nearest_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[50:150] = x[50]  # a hot vector
    data = [(i, [float(v) for v in x[i]], 1) for i in range(300)]
    bad = [(300, None, 1), (320, [0.0] * 8, 1), (340, [None] + [1.0] * 7, 1), (360, [float("nan")] + [1.0] * 7, 1), (380, [1.0], 1), (None, data[0][1], 1), (400, [], 1), (420, [float("inf")] * 8, 1)]
    found = ann.nearest(vectors(spark, data + bad + data[:40]).withColumns({c: F.lit(1) for c in ("v", "gid", "ids")}), F.col("vec_id") % 20 == 0, tables=8, probes=200).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(by) == set(range(0, 300, 20))
    hits = 0
    for q, own in by.items():
        own = [own[i] for i in range(1, len(own) + 1)]
        assert len(own) == 20 and q not in [v for v, _ in own]
        scores = x.astype(float) @ x[q].astype(float)
        assert own == sorted(own, key=lambda p: (-p[1], p[0])) and all(abs(scores[v] - s) < 1e-9 for v, s in own)
        scores[q] = -np.inf
        # Ties of equal vectors are exact; what rounding of a plain product parts, it would wrongly order.
        hits += len({v for v, _ in own} & set(np.lexsort((np.arange(300), -scores.round(9)))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(by)
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(vectors(spark, data[:3]), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]


def test_nearest_of_many_blocks(spark, monkeypatch):
    """Small blocks, so that lists of many blocks are merged; every bucket is visited, so the result is exact. Merging must not compare all of them with each other."""
    monkeypatch.setattr(ann, "BLOCK", 0, raising=False)
    plans, write = [], ann.stored
    monkeypatch.setattr(ann, "stored", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or write(df))
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 6)).astype(np.float32)
    found = ann.nearest(vectors(spark, [(i, [float(v) for v in x[i]], 1) for i in range(6000)]), F.col("vec_id") % 1000 == 0, tables=2, functions=2, probes=9, width=50.0)
    by = {}
    for r in found.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, own in by.items():
        scores = x.astype(float) @ x[q].astype(float)
        scores[q] = -np.inf
        assert [v for _, v, _ in sorted(own)] == np.argsort(-scores)[:20].tolist()
    assert len(by) == 6 and not any("array_distinct(flatten" in plan for plan in plans)


def test_products_only_choose():
    """Equal scores, scores a rounding apart and overflow: the same rows as by scoring every pair."""
    rng = np.random.default_rng(3)
    v = np.concatenate([np.repeat(rng.standard_normal((40, 5)), 30, axis=0), rng.standard_normal((1200, 5)), np.full((3, 5), 1e200)])
    q = np.concatenate([rng.standard_normal((30, 5)), v[:5], np.full((1, 5), -1e200)])
    ids = rng.permutation(len(v)).astype(np.int64)
    with np.errstate(all="ignore"):
        best, at = ann.best_in_buckets(q, v, ids, [(np.arange(len(q)), 0, 900), (np.arange(20), 900, 1500), (np.arange(len(q)), 1500, len(v))], 21)
        for i in range(len(q)):
            seen = np.arange(len(v)) if i < 20 else np.concatenate([np.arange(900), np.arange(1500, len(v))])
            exact = np.einsum("id,jd->ij", q[i : i + 1], v[seen])[0]
            order = np.lexsort((ids[seen], -exact))[:21]
            assert at[i].tolist() == ids[seen][order].tolist() and best[i].tolist() == exact[order].tolist()


PIECES = st.lists(st.sampled_from(["### user: ", "### ", "</turn>", "\n", "\\", "### a%20: ", "x", ": ", "#", "\n</turn>\n", "é", ""]), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.sampled_from(["user", "assistant", "", "sys tem: é", "### user"]))
def test_chat_round_trip(text, role):
    formatted = chat.render(role, text)
    assert [t[:2] for t in chat.parse(formatted)] == [(role, text)]
    twice = [t[:2] for t in chat.parse(formatted + chat.render("user", text))]
    assert twice == [(role, text), ("user", text)]
    if not chat.MARK.search(text):
        assert text in formatted


def test_chat_rows(spark):
    rows_ = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "assistant", "last\\"), (2, 3, "user", "</turn>"), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    turns = chat.format_turns(df)
    found = {r["conv_id"]: r for r in chat.conversation_digests(turns).collect()}
    digest = lambda *t: sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    assert found[1]["turns_sha256"] == digest(("user", ""), ("assistant", "b"), ("assistant", "b")) and found[1]["loss_chars"] == 2
    assert found[2]["turns_sha256"] == digest(("assistant", "last\\"), ("user", "</turn>")) and found[2]["n_turns"] == 2
    assert found[None]["turns_sha256"] == digest(("", "x")) and found[None]["loss_sha256"] == sha256(b"").hexdigest()
    assert found[3]["loss_chars"] == len(LONG)
    spans = {(r["conv_id"], r["turn"]): (r["start"], r["end"]) for r in chat.loss_spans(turns).collect()}
    assert spans[3, 0] == (len("### assistant: "), len("### assistant: ") + len(LONG))
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


PERSONAL = [
    (1, "a@b.c_d@e.f.g, x@y z@ @q.com a.@b-.c.d-"), (2, "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.4"), (3, "4111 1111 1111 1111, 4111-1111-1111-1112 4 1 1"),
    (4, "+1 (017) 555-7713. +12 +49.30.1234567 ++1 555 123 4567-"), (5, None), (6, ""), (7, "9" * 5000 + " " + "x" * 30000 + " a." * 3000), (8, "é@é.com ü1.2.3.4\U0001f600 +33 1 23 45 67 89"),
    (9, "mail me: joe (at) site (dot) org or call 555-123-4567, ssn 123-45-6789"), (10, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here'), (1, "a@b.cc a@b.cc"),
]


def test_personal_rows(spark):
    df = frame(spark, PERSONAL, clash=True)
    found = pii.personal_spans(df).select("doc_id", F.sha2(pii.listing(F.filter("spans", lambda s: s["base"])), 256).alias("h"), pii.listing(F.col("spans")).alias("spans"))
    want = brute.personal(PERSONAL)
    assert rows(found, "doc_id", "h") == sorted([(r[0], r[5]) for r in want], key=repr)
    assert pii.personal_spans(frame(spark, [])).count() == 0
    assert pii.train(frame(spark, [(1, "no data at all")])) is None


def test_masking(spark):
    spans = [(0, 2, 5, True), (2, 4, 7, True), (3, 9, 10, True)]
    df = spark.createDataFrame([("abXXXXXcdYé", spans), ("plain", []), ("", [])], "text string, spans array<struct<kind:int,start:int,end:int,base:boolean>>")
    assert rows(df.select(pii.masked(F.col("text"), F.col("spans")).alias("t")), "t") == [("",), ("ab[EMAIL]cd[PHONE]é",), ("plain",)]


def test_reliabilities_follow_agreement():
    # The last labeler votes at random; the first two agree with each other.
    counts = {(0, 1, 1, 0, 0, 0): 400, (0, -1, -1, 0, 0, 0): 300, (0, 1, 1, 1, 0, 0): 380, (0, -1, -1, 1, 0, 0): 320, (0, 1, -1, 1, 0, 0): 5}
    p = pii.estimate(counts)
    assert p[0, 1, 1, 0, 0, 0] > 0.9 > 0.1 > p[0, -1, -1, 1, 0, 0]


def test_stages_keep_columns(spark, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(14)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for given_ in (frame(spark, clash=True), frame(spark, [], clash=True)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given_, str(tmp_path))
            assert out.columns == given_.columns and out.count() <= given_.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, given_, str(tmp_path)).columns[:2] == ["doc_id", "piece"]
