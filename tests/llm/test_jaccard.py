"""The near-duplicate stage against brute-force Jaccard similarity."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weekgrid.llm import jaccard, simhash
from weekgrid.session import stored, stored_by


def words_of(rng, n):
    return [f"w{k}" for k in rng.integers(0, 1 << 30, n)]


def families():
    """Texts of 1 to 400 words beside copies with some words changed, added or cut, around the limit."""
    rng = np.random.default_rng(3)
    out = []
    for n in (1, 4, 5, 6, 8, 9, 12, 17, 30, 60, 120, 400):
        for _ in range(3):
            base = words_of(rng, n)
            out.append(base)
            for _ in range(14):
                copy = list(base if rng.random() < 0.7 else out[-1])
                for k in rng.choice(len(copy), min(len(copy), rng.integers(0, 2 + n // 40)), replace=False):
                    copy[k] = "changed" + str(rng.integers(0, 9))
                cut = int(rng.integers(0, 1 + len(copy) // 10 + 1))
                out.append(copy[: len(copy) - cut] or copy if rng.random() < 0.5 else copy + words_of(rng, cut))
    return [" ".join(x) for x in out]


def jaccard_of(a, b):
    return len(a & b) / len(a | b)


def sets_of(texts):
    split = [t.split() for t in texts]
    return [frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in split]


def groups(texts):
    sets = sets_of(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard_of(sets[i], sets[j]) >= 0.8 - 1e-12:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def partition(named):
    by = {}
    for doc, name in named:
        by.setdefault(name, set()).add(doc)
    return {frozenset(x) for x in by.values()}


@pytest.mark.parametrize("dense, cell", [(jaccard.DENSE, jaccard.CELL), (2, jaccard.CELL), (2, 7)])
def test_groups_are_exact(spark, dense, cell):
    texts = families()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = jaccard.similar_documents(df, dense=dense, cell=cell).collect()
    assert partition((r["doc_id"], r["component"]) for r in found) == partition(enumerate(groups(texts)))


def test_pairs_share_a_key():
    """Every pair at the limit or above, sizes at the edges of the classes and sparse sets included."""
    rng = np.random.default_rng(8)
    met = 0
    for n in [*range(1, 130), 500, 1000]:
        for _ in range(4):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            gone = int(rng.integers(0, n // 5 + 1))
            most = math.floor((n - gone) / 0.8 + 1e-9) - n  # as many as still may be added
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, max(0, most), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if jaccard.similar(a, b, 0.8):
                met += 1
                assert len(np.intersect1d(jaccard.set_keys(a), jaccard.set_keys(b)))
    assert met > 400


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_keys_across_batches(size):
    """Small keys yield all pairs, crowded ones a star, however the rows are cut into batches."""
    rng = np.random.default_rng(4)
    counts = [1, 2, 8, 9, 30, 1, 8, 100, 3]
    key = np.repeat(np.arange(len(counts)), counts)
    name = np.concatenate([np.sort(rng.choice(1 << 40, c, replace=False)) for c in counts])
    table = pa.RecordBatch.from_arrays([pa.array(key), pa.array(name)], ["key", "name"])
    found = list(jaccard._paired(8, 2)(iter([table.slice(i, size) for i in range(0, len(key), size)])))
    rows = [r for b in found for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
    pairs, stars = set(), set()
    for k, c in enumerate(counts):
        own = name[key == k].tolist()
        pairs |= {(a, b) for a in own for b in own if a < b} if c <= 8 else set()
        stars |= {(k, a, b) for a in own[:2] for b in own if a < b} if c > 8 else set()
    assert sorted((a, b) for k, a, b in rows if k is None) == sorted(pairs)
    assert sorted(r for r in rows if r[0] is not None) == sorted(stars)


def test_bitmaps_rule_out_no_pair():
    """However they are folded, bitmaps differ in no more bits than the sets in shingles."""
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 53, 54, 400, 7000, 20_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for gone in (0, n // 9, n // 2):
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]))
            x, y = jaccard.parity(a), jaccard.parity(b)
            width = min(len(x), len(y))
            far = np.bitwise_count(jaccard._folded(x, width) ^ jaccard._folded(y, width)).sum()
            assert far <= len(np.setxor1d(a, b))
            if jaccard.similar(a, b, 0.8):
                assert far <= jaccard._allowed(len(a), len(b), 0.8)


def test_large_group_around_the_limit(spark):
    """2,000 texts that share most of one text, similarities of pairs from below 0.7 to 0.9, against all pairs."""
    rng = np.random.default_rng(6)
    base = words_of(rng, 120)
    texts = []
    for k in range(2000):
        copy = list(base)
        for place in rng.choice(24, rng.integers(1, 4), replace=False):
            copy[place * 5 + 2] = f"other{rng.integers(0, 3)}"
        texts.append(" ".join(copy))
    sets = sets_of(texts)
    names = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    flags = np.zeros((len(sets), len(names)), np.float32)
    for i, own in enumerate(sets):
        flags[i, [names[s] for s in own]] = 1
    common = flags @ flags.T
    size = flags.sum(axis=1)
    alike = common / (size[:, None] + size - common)
    assert alike.min() < 0.7
    linked = alike >= 0.8 - 1e-6
    root = np.arange(len(sets))
    while True:
        new = np.where(linked, root[None, :], len(root)).min(axis=1)
        if (new == root).all():
            break
        root = new
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = jaccard.similar_documents(df).collect()
    assert partition((r["doc_id"], r["component"]) for r in found) == partition(enumerate(root.tolist()))


def test_short_texts_at_the_limit(spark):
    """4 of 5 shingles are near copies, 11 of 15 (0.73) and 7 of 9 (0.78) are not."""
    rng = np.random.default_rng(1)
    given = []
    for k in range(40):
        eight, other, longer = words_of(rng, 8), words_of(rng, 16), words_of(rng, 12)
        given += [(10 * k, eight), (10 * k + 1, [*eight, "more"])]
        given += [(10 * k + 2, other), (10 * k + 3, [*other[:15], *words_of(rng, 3)])]
        given += [(10 * k + 4, longer), (10 * k + 5, [*longer[:11], "else"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in given], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {i for i, _ in given if i % 10 != 1}


def test_fingerprints_give_the_first_links(spark, monkeypatch):
    """Near copies are linked by SimHash and need no pair of the pigeonhole; what fingerprints miss, it adds."""
    rng = np.random.default_rng(7)
    base = words_of(rng, 300)
    copies = [" ".join([*base[:-1], f"end{k}"]) for k in range(6)]
    far = " ".join([*base[:-30], *words_of(rng, 28)])  # just over the limit
    others = [" ".join(words_of(rng, 50)) for _ in range(3)]
    texts = [*copies, far, *others]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, real = [], jaccard.fingerprint_pairs
    monkeypatch.setattr(jaccard, "fingerprint_pairs", lambda prints: seen.append(real(prints).count()) or real(prints))
    found = {r["doc_id"]: r["component"] for r in jaccard.similar_documents(df).collect()}
    assert seen and seen[0] >= 5
    assert partition(found.items()) == partition(enumerate(groups(texts)))
    assert found[6] == found[0]


def test_rows_sharing_id_and_text_stay_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_dedup(spark, df, "").collect())) == [(1, "a b c d e f"), (2, "x y z")]


def test_stars_need_no_round(spark, monkeypatch):
    """Edges that lead to roots already are written once; chains and cycles end at the least node."""
    made = []
    monkeypatch.setattr(simhash, "stored", lambda df: made.append(1) or stored(df))
    roots = lambda edges: {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert roots([(k, 0) for k in range(1, 40)] + [(50, k) for k in range(51, 60)] + [(7, 7), (3, 0)]) == {**dict.fromkeys(range(1, 40), 0), **dict.fromkeys(range(51, 60), 50)}
    assert len(made) == 1
    assert roots([(k, k + 1) for k in range(20)] + [(20, 0), (30, 31), (32, 31)]) == {**dict.fromkeys(range(1, 21), 0), 31: 30, 32: 30}


def test_texts_stay_where_they_are(spark):
    """A join by the key of a table in buckets moves its other side only."""
    table, name = stored_by(spark.range(500).select((F.col("id") * 7).alias("name"), F.lit("text").alias("text")), "name")
    met = table.join(spark.range(200).select(F.col("id").alias("name")), "name", "left_semi")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert met.count() == len(range(0, 200, 7))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")
