"""Operators 11 to 13 against plain versions, over whole tables, and their edges."""

import os
import random
import re
from collections import Counter, defaultdict
from itertools import permutations, product
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm.brute import UPPER
from tools.check import compare, connect
from weekgrid.llm import interactions, language, spelling

FOLDER = os.environ.get("LLM_FOLDER", "/root/testdata/sf0.001")
mounted = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows):
    df = spark.createDataFrame([(*r, *([None] * (4 - len(r)))) for r in rows], SCHEMA).repartition(3)
    # Columns named as the operators' own ones.
    return df.withColumns({c: F.lit(1) for c in ("id", "word", "n", "prefix", "kind", "hash", "mask", "part", "possible", "first", "draw", "share", "found", "score")})


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Spelling variants


def plain_counts(docs):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    counts = plain_counts(docs)
    near = defaultdict(list)
    if len(counts) < 3000:
        for a, b in product(counts, counts):
            if one_edit(a, b):
                near[a].append(b)
    else:  # by one wildcard in place of any letter and in any gap
        groups = defaultdict(set)
        for w in counts:
            for i in range(len(w)):
                groups[w[:i] + "*" + w[i + 1 :]].add(w)
            for i in range(len(w) + 1):
                groups[w[:i] + "*" + w[i:]].add(w)
        pairs = {(a, b) for g in groups.values() for a in g for b in g if a != b and one_edit(a, b)}
        for a, b in pairs:
            near[a].append(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@mounted
def test_variants_of_the_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    want = plain_variants(docs)
    assert len(want) > 1000 and any(r[1] for r in want) and any(r[1] != r[2] for r in want if r[1])
    assert rows(entry.queries()["op11_spelling_variants"](spark, FOLDER), *COLUMNS) == want


def test_variants_of_near_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 8))) for _ in range(2000)]
    docs = [(i, " ".join(rng.choices(words, k=120)).upper() if i % 3 else " ".join(rng.choices(words[:40], k=200))) for i in range(150)]
    assert rows(spelling.variants(frame(spark, docs)), *COLUMNS) == plain_variants(docs)


def test_variants_of_long_words_and_odd_rows(spark):
    long = "xyzzy" * 2000
    words = ["a" * n for n in range(60, 70)] + [long, long + "q", long[:500] + "k" + long[501:], "ß" * 64, "ß" * 65, "÷×÷×÷"]
    docs = [(i % 3, "\n".join(words * (1 + i % 2))) for i in range(6)] + [(None, "hello HELLO hello"), (None, None), (1, ""), (4, "hullo hullo hullo hullo hullo hullo")]
    assert rows(spelling.variants(frame(spark, docs)), *COLUMNS) == plain_variants(docs)
    assert spelling.variants(frame(spark, [])).count() == 0


def test_a_long_word_costs_its_length():
    assert sum(len(p) for p, _ in spelling.rotations("ab" * 20000)) < 40001 * 2 * 100


# Languages


def plain_phrases(model, name, text):
    """Greedy phrases by the transitions of one language, a letter at a time, block by block."""
    k = model.names.index(name)
    classes = []
    for c in text:
        c = language._class(model.letters, c)
        if c or (classes and classes[-1]):
            classes.append(c)
    if classes and not classes[-1]:
        classes.pop()
    n = 0
    for i in range(0, len(classes), language.BLOCK):
        state = int(model.start[k])
        n += 1
        for c in classes[i : i + language.BLOCK]:
            to = int(model.step[state + c])
            n += to < 0
            state = -1 - to if to < 0 else to
    return n, len(classes)


def test_phrases_are_longest_matches():
    own = "the cat sat on the mat and the dog ran after the cat that ran"
    model = language.build({"en": [own], "xx": ["qqq www zzz"]})
    # Greedy longest substrings, found by search.
    text = "the dog sat after that qat ran on xylophones"
    n, at = 0, 0
    while at < len(text):
        at += text[at] not in own  # an unknown letter stands before the match
        end = at
        while end < len(text) and text[at : end + 1] in own + " ":
            end += 1
        at = end
        n += 1
    assert plain_phrases(model, "en", text)[0] == n
    parser = language.Parser(model)
    rng = random.Random(1)
    texts = ["".join(rng.choices("the catsonmdr .5É ", k=rng.randrange(0, 2000))) for _ in range(50)] + ["", " ", "x", "The  Cat!", "\U0001f600", "ж字"]
    got = parser.phrases([parser.squeezed(t) for t in texts])
    want = [[plain_phrases(model, name, t)[0] for name in model.names] for t in texts]
    assert got.tolist() == want
    assert [len(parser.squeezed(t)) for t in texts] == [plain_phrases(model, "en", t)[1] for t in texts]


@mounted
def test_held_out_languages(spark):
    found = rows(entry.queries()["op12_language_id"](spark, FOLDER), "doc_id", "held_out", "lang_pred", "score")
    given = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{FOLDER}/documents.parquet'").fetchall())
    assert [r[0] for r in found] == sorted(given, key=repr)
    assert all(h == (crc32(str(i).encode()) % 4 == 2) and 0 <= s <= 1 for i, h, _, s in found)
    right = np.mean([p == given[i] for i, h, p, _ in found if h and given[i]])
    print("held-out accuracy", right)
    assert right > 0.95


@mounted
def test_predictions_are_the_plain_ones(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(docs)
    found = {r["doc_id"]: r["found"] for r in docs.select("doc_id", language.predict_column(spark, model, F.col("text")).alias("found")).collect()}
    for r in docs.select("doc_id", "text").collect():
        bits = np.array([plain_phrases(model, name, r["text"])[0] for name in model.names]) * model.bits
        assert found[r["doc_id"]]["lang_pred"] == model.names[int(np.argmin(bits))]
        assert abs(found[r["doc_id"]]["score"] - 1 / np.exp2(bits.min() - bits).sum()) < 1e-9


def test_language_cases(spark):
    texts = ["un deux trois quatre", "one two three four", "eins zwei drei vier"]
    docs = [(i, texts[i % 3] + f" {i}", ("fr", "en", "de")[i % 3]) for i in range(30)] + [(None, "uno dos", "es"), (40, None, "pt"), (41, "12 ! 3", "it"), (42, "cinq six", None)]
    data = frame(spark, docs)
    model = language.fit(data)
    assert model.names == ("de", "en", "fr")
    asked = frame(spark, [(1, None), (2, ""), (3, "12 ... 3"), (4, "ONE two"), (5, "zwei " * 100_000), (6, "字"), (None, "trois")])
    got = {r["text"]: (r["p"]["lang_pred"], r["p"]["score"]) for r in asked.select("text", language.predict_column(spark, model, F.col("text")).alias("p")).collect()}
    assert got[None] == got[""] == got["12 ... 3"] == ("und", 0.0)
    assert got["ONE two"][0] == "en" and got["trois"][0] == "fr" and got["zwei " * 100_000][0] == "de"
    assert got["字"][0] in model.names and 0 < got["字"][1] < 0.5
    nothing = language.fit(frame(spark, []))
    assert {tuple(r["p"]) for r in asked.select(language.predict_column(spark, nothing, F.col("text")).alias("p")).collect()} == {("und", 0.0)}


# Filters


def plain_audit(docs, labels):
    masks = []
    seen = defaultdict(list)
    for i, t, _, _ in docs:
        if i is not None:
            seen[t or ""].append(i)
    for i, t, _, part in docs:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t))]
        fails.append(i is not None and min(seen[t]) < i)
        good, toxic = (any(label[k] == 1 for label in labels if label[0] == i and i is not None) for k in (1, 2))
        masks.append((part or "", {f for f, bad in zip("ABCDE", fails) if bad}, good, toxic))
    out = []
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        lost = Counter()
        report = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                lost[f] += len(gone)
                failing = sum(f in m[1] for m in own)
                report.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone), f))
        out += [(*r[:-1], lost[r[-1]]) for r in report]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def corpus():
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["Alpha", "beta", "gamma", "Delta's", "x&y", "#1", "omega"] + [f"w{k}" for k in range(200)], k=rng.choice((3, 49, 50, 51, 300)))) for _ in range(60)]
    texts += ["", " \n\t", "A", "A" * 40_000 + "|", "a b " * 70, "É" * 19 + "E", None]
    docs = [(i, rng.choice(texts), None, rng.choice(("s1", "s2", None, ""))) for i in range(200)]
    docs += [(None, texts[0], None, "s1"), (None, texts[0], None, "s1"), (7, docs[7][1], None, "s1"), (7, docs[3][1], None, "s2"), (-5, texts[1], None, "s3")]
    labels = [(i, int(rng.random() < 0.7), int(rng.random() < 0.2)) for i in range(0, 200, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1), (999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("sent", [interactions.SENT, 1])
def test_audit(spark, sent, monkeypatch):
    docs, labels = corpus()
    monkeypatch.setattr(interactions, "SECTION", 64)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    data = spark.createDataFrame(docs, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("part", "hash", "mask", "possible", "first", "n", "good", "toxic")})
    found = interactions.order_report(interactions.mask_counts(data, marks, sent=sent))
    assert rows(found, *AUDIT) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(frame(spark, []), none).count() == 0
    assert rows(interactions.audit(frame(spark, [(1, "x")]), none), *AUDIT) == plain_audit([(1, "x", None, None)], [])


def test_sketch_clears_single_texts_only():
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, 20_000)
    hashes = np.concatenate([hashes, hashes[:500], np.repeat(hashes[-1], 5000)])
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(part)], ["hash"]) for part in np.array_split(hashes, 7)]
    raised = [b for part in batches for b in interactions._raised(2)([part])]
    raised = pa.Table.from_batches(raised).sort_by("section").to_batches()
    full = {r["section"]: np.unpackbits(np.frombuffer(r["full"], np.uint8)) for b in interactions._merged(raised) for r in b.to_pylist()}
    section, cells = interactions._cells(hashes, 2)
    possible = np.array([full[s][c].all() for s, c in zip(section, cells)])
    counts = Counter(hashes.tolist())
    repeated = np.array([counts[h] > 1 for h in hashes.tolist()])
    assert possible[repeated].all() and possible[~repeated].mean() < 0.1


@mounted
def test_audit_sql(spark):
    name = "op13_filter_interactions"
    line = compare(name, entry.queries()[name], entry.oracle_sql()[name], spark, FOLDER, connect(FOLDER))
    assert line.startswith("ok") and "TYPES" not in line, line
