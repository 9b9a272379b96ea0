"""Near duplicates by the exact Jaccard similarity of word shingles: complete candidates, verified links, components.

The distinct shingles of a text are its set. Sets are put in classes of size, such that two sets of at least ``SIMILARITY`` are
in one class or in neighbouring ones; a set takes part in the level of its class and in the next one. Of two
sets of a level at most ``k`` shingles are in one only, so of ``k + 1`` partitions by hash one is equal in both (pigeonhole). A
partition's content is a key, and sets that share a key are candidates. An empty partition says nothing: there are spare
partitions for them, and a set with more empty ones than spare ones is also cut with more spare ones. One that is still too
sparse also has its least ``n - ceil(similarity * n) + 1`` shingles as keys, of which two such sets share one (prefix filter). No pair at the similarity or above is left out, so there is no
recall to measure; every candidate is verified on the complete sets.

A set also has a parity bitmap: bit ``h mod size`` is flipped by every shingle hash ``h``. Each shingle that is in one set only flips one bit, so
two bitmaps never differ in more bits than the sets in shingles; candidates beyond what the similarity allows are left
out, and no pair is lost by it. A bitmap has some eight bits for every shingle that may differ, up to ``WIDEST``; sets of crowded
keys whose sets are not one component get a wider one (``WIDE``), which leaves hardly any pair below the similarity to verify.

Of a key with up to ``DENSE`` sets all pairs are candidates. The sets of a crowded key are first paired with ``CENTRES`` of
them. Candidates are verified nearest first, and those inside a component need no verification any more. Where that leaves several components in a
crowded key, all pairs between them are compared by bitmaps, folded ones first, inside the key's task; each set offers its ``most`` nearest ones that pass, and ``most``
grows until none passes that wasn't offered. So what leaves a task grows with the key's sets, not with their pairs.
Keys of more than ``CELL`` sets are dealt to several tasks.

The first links are those of SimHash (operator 1: fingerprints of the same shingles, multi-index hashing), each verified on the complete sets;
what they put in one component takes no further part as a pair. The pigeonhole adds the links that fingerprints can't promise.

Sets are named by 64 bits of their hash. Defined cases: a text without words has the empty set, and such texts are one
component; fewer words than a shingle has are one shingle; a null text is empty.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrid.llm import simhash
from weekgrid.llm.simhash import components, shingle_hashes
from weekgrid.session import stored, stored_by

SIMILARITY = 0.8
SHINGLE = 5  # words
SPARE = (10, 3)  # one partition is spare for every so many shingles that may differ, and for sets that this leaves sparse
DENSE = 4  # sets of a key up to which every pair is a candidate
CENTRES = 1
GROW = 8
WIDEST = 1 << 13  # bits of a bitmap
WIDE = 8  # how many times as many bits a wide bitmap has
CELL = 1 << 13  # sets of a key that one task compares
EPS = 1e-9


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted, distinct) have that Jaccard similarity at least."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - EPS


@lru_cache(maxsize=8)
def _tops(similarity: float) -> list[int]:
    """The largest size of each class."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, math.floor(tops[-1] / similarity + EPS)))
    return tops


def _mix(x: np.ndarray) -> np.ndarray:
    """The output function of SplitMix64 (public domain)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_keys(hashes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The keys of a set that isn't empty: two sets of at least the similarity share one."""
    tops = _tops(similarity)
    n = len(hashes)
    own = int(np.searchsorted(tops, n))
    mixed, keys, sparse = _mix(hashes), [], False
    for level in (own, own + 1):
        differing = math.floor(2 * tops[level] * (1 - similarity) / (1 + similarity) + EPS)
        for step, share in enumerate(SPARE):
            spare = 1 + step + differing // share
            parts = differing + 1 + spare
            at = (hashes % np.uint64(parts)).astype(np.int64)
            filled = np.bincount(at, minlength=parts) > 0
            content = np.zeros(parts, np.uint64)
            np.add.at(content, at, mixed)
            name = (np.arange(parts, dtype=np.uint64) + np.uint64((level << 40) + (step << 36))) * np.uint64(0x9E3779B97F4A7C15)
            keys.append(_mix(content ^ _mix(name))[filled])
            if parts - int(filled.sum()) <= spare:
                break
        else:
            sparse = True
    if sparse:
        keys.append(_mix(hashes[: n - math.ceil(similarity * n - EPS) + 1] ^ np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(keys)


def _name(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def parity(hashes: np.ndarray, wide: int = 1) -> bytes:
    """The parity bitmap of a set; its size is a power of two, as ``wide`` is, so that longer ones can be folded."""
    size = wide * min(WIDEST, max(64, 1 << math.ceil(math.log2(1.2 * max(1, len(hashes))))))
    flips = np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size)
    return np.packbits(flips & 1, bitorder="little").tobytes()


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap as ``width`` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0).view("<u8")


def _allowed(n_a, n_b, similarity: float):
    """Shingles that may be in one of two sets only."""
    return (1 - similarity) / (1 + similarity) * (n_a + n_b) + EPS


def print_column(text: Column, shingle: int = SHINGLE) -> Column:
    """Name, size and bitmap of a text's set, and its fingerprint; the name is null for the empty one."""

    @F.arrow_udf("struct<name: bigint, n: bigint, bits: binary, fp: bigint>")
    def prints(texts: pa.Array) -> pa.Array:
        names, sizes, bits, fps = [], [], [], []
        for t in texts:
            every = shingle_hashes(t.as_py(), shingle)
            hashes = np.unique(every)
            fps.append(simhash.fingerprint_of(every))
            names.append(_name(hashes))
            sizes.append(len(hashes))
            bits.append(parity(hashes))
        named = pa.array(np.array(names, dtype=np.uint64).view(np.int64), mask=np.array(sizes) == 0)
        prints_ = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
        return pa.StructArray.from_arrays([named, pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), prints_], ["name", "n", "bits", "fp"])

    return prints(text)


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of names from rows (name, fp): a forest over linked fingerprints, and every set beside the least one of its fingerprint."""
    least = stored(prints.groupBy("fp").agg(F.min("name").alias("least")))
    linked = simhash.links(least.select("fp"))
    for side in ("a", "b"):
        linked = linked.join(least.select(F.col("fp").alias(side), F.col("least").alias(f"name_{side}")), side)
    equal = prints.join(least, "fp").filter("name <> least").select("least", "name")
    pairs = linked.select("name_a", "name_b").union(equal).toDF("x", "y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _keyed(shingle: int, similarity: float):
    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                keys = [set_keys(shingle_set(t.as_py(), shingle), similarity) for t in part.column(1)]
                if keys:
                    names = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(names)], ["key", "name"])

    return run


def _paired(dense: int, centres: int):
    """Candidates (key, a, b) from rows (key, name) sorted so; the key is null where all pairs of it are there.

    A key with more rows is followed as a stream, and only its first ones are held.
    """

    def run(batches):
        last, held, size = None, np.empty(0, np.int64), 0

        def all_pairs(key, name):
            """Every pair of rows that share a key; sorted by key."""
            out = []
            for step in range(1, dense):
                same = np.flatnonzero(key[:-step] == key[step:]) if step < len(key) else []
                if not len(same):
                    break
                out.append((name[same], name[same + step]))
            return out

        def table(key, a, b):
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a), pa.array(b)], ["key", "a", "b"])

        def closed(key, name):
            """Candidates of complete keys."""
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(first, len(key)))
            crowded = np.repeat(count > dense, count)
            pairs = all_pairs(key[~crowded], name[~crowded])
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs))
                a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield table([None] * len(a), a, b)
            for i in np.flatnonzero(count > dense):
                yield from star(key[first[i]], name[first[i] : first[i] + min(centres, count[i])], name[first[i] : first[i] + count[i]], 0)

        def star(key, middle, names, seen):
            for j, m in enumerate(middle):
                others = names[max(0, j + 1 - seen) :]
                if len(others):
                    yield table(np.full(len(others), key), np.full(len(others), m), others)

        # ``held``: the rows of the key that the last batch ended in, or its centres once it is known to be crowded.
        for batch in batches:
            key, name = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            if size > dense:
                own = int(np.searchsorted(key != last, True)) if (key != last).any() else len(key)
                yield from star(last, held, name[:own], size)
                size += own
                key, name = key[own:], name[own:]
                if not len(key):
                    continue
            elif size:
                key, name = np.concatenate([np.full(size, last), key]), np.concatenate([held, name])
            end = int(np.flatnonzero(key == key[-1])[0])
            if end:
                yield from closed(key[:end], name[:end])
            last, held, size = key[-1], name[end:], len(key) - end
            if size > dense:
                held = held[:centres]
                yield from star(last, held, name[end:], 0)
        if size and size <= dense:
            yield from closed(np.full(size, last), held)

    return run


def _near(pairs: DataFrame, signs: DataFrame, similarity: float) -> DataFrame:
    """(a, b, far) of the pairs that sizes and bitmaps don't rule out."""

    @F.arrow_udf("bigint")
    def apart(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for one, other in zip(x.to_pylist(), y.to_pylist()):
            width = min(len(one), len(other))
            out.append(int(np.bitwise_count(_folded(one, width) ^ _folded(other, width)).sum()))
        return pa.array(out, pa.int64())

    left = signs.select(F.col("name").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x"))
    right = signs.select(F.col("name").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y"))
    met = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - EPS)
    met = met.select("a", "b", apart("x", "y").alias("far"), _allowed(F.col("n_a"), F.col("n_b"), similarity).alias("most"))
    return met.filter("far <= most").select("a", "b", "far")


def _between(similarity: float, most: int):
    """Pairs (a, b, far, more) between the components of a key that bitmaps don't rule out; ``more``: some weren't offered.

    From rows (key, part, name, root, n, bits) sorted by key and part, with wide bitmaps. Every pair is compared once, from the
    side of the shorter bitmap, and that side offers its ``most`` nearest.
    """

    def of_key(rows: pa.Table):
        name, root, n = (rows.column(c).to_numpy() for c in ("name", "root", "n"))
        order = np.lexsort((name, root))
        name, root, n = name[order], root[order], n[order]
        bits = rows.column("bits").take(pa.array(order)).to_pylist()
        width = np.array([len(b) for b in bits])
        for w in np.unique(width):
            wide = np.flatnonzero(width >= w)
            full = np.stack([_folded(bits[i], int(w)) for i in wide])
            words = max(1, full.shape[1] // WIDE)
            folded = np.bitwise_xor.reduce(full.reshape(len(wide), -1, words), axis=1)
            own_root, own_n = root[wide], n[wide]
            for k in np.flatnonzero(width[wide] == w):
                low, high = np.searchsorted(own_root, own_root[k], "left"), np.searchsorted(own_root, own_root[k], "right")
                others = np.concatenate([np.flatnonzero(width[wide[:low]] > w), np.arange(high, len(wide))])
                sizes = own_n[others]
                others = others[np.minimum(sizes, own_n[k]) >= similarity * np.maximum(sizes, own_n[k]) - EPS]
                for some in (folded, full):
                    far = np.bitwise_count(some[others] ^ some[k]).sum(axis=1, dtype=np.int64)
                    near = far <= _allowed(own_n[others], own_n[k], similarity)
                    others, far = others[near], far[near]
                best = np.argsort(far, kind="stable")[:most]
                if len(best):
                    yield np.full(len(best), name[wide[k]]), name[wide[others[best]]], far[best], np.full(len(best), len(far) > most)

    def run(batches):
        kept, last = [], None

        def closed():
            found = list(of_key(pa.Table.from_batches(kept)))
            if found:
                a, b, far, more = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(a, b), np.maximum(a, b), far, more)], ["a", "b", "far", "more"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            for begin, end in zip([0, *edges], [*edges, len(key)]):
                if kept and last != (key[begin], part[begin]):
                    yield from closed()
                    kept.clear()
                kept.append(batch.slice(begin, end - begin))
                last = (key[begin], part[begin])
        if kept:
            yield from closed()

    return run


def _dealt(rows: DataFrame, cell: int) -> DataFrame:
    """The rows with a part of their key: keys over ``cell`` rows are cut, and every two of their slices meet in one part."""
    count = rows.groupBy("key").count()
    crowded = stored(count.filter(F.col("count") > cell).select("key", F.ceil(F.col("count") / cell).cast("int").alias("parts")))
    if crowded.isEmpty():
        return rows.withColumn("part", F.lit(0))
    parts, own = F.col("parts"), F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(j, own) * parts + F.greatest(j, own))
    return rows.join(crowded, "key", "left").withColumn("part", F.explode(F.when(parts.isNull(), F.array(F.lit(0))).otherwise(meets))).drop("parts")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity. Texts travel, since their sets would be larger and can't be compressed."""

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        read = lambda v: shingle_set(v.as_py(), shingle)
        return pa.array([similar(read(a), read(b), similarity) for a, b in zip(x, y)], pa.bool_())

    left = texts.select(F.col("name").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("name").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").filter(alike("x", "y")).select("a", "b")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sides are in different components."""
    for side in ("a", "b"):
        own = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.filter("root_a <> root_b").drop("root_a", "root_b")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE,
    dense: int = DENSE, cell: int = CELL,
) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and component (a set's name, null for the empty set) for every row of ``docs``."""
    text = F.col(text_col).cast("string")
    prints = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), print_column(text, shingle).alias("own"))
    prints = stored(prints.select("doc_id", "text_hash", "own.*"))
    named = prints.filter("name IS NOT NULL").groupBy("name")
    one = stored(named.agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("fp").alias("fp")))
    signs = one.select("name", "n", "bits")

    @F.arrow_udf("bigint")
    def name_of(column: pa.Array) -> pa.Array:
        return pa.array(np.array([_name(shingle_set(t.as_py(), shingle)) for t in column], np.uint64).view(np.int64))

    # A text for each set, which travels once; texts without words have no set to compare.
    worded = docs.select(text.alias("text")).filter(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    texts, table = stored_by(worded.groupBy(name_of("text").alias("name")).agg(F.first("text").alias("text")), "name")

    def settled(candidates: DataFrame, roots: DataFrame) -> DataFrame:
        """Roots after verifying candidates (a, b, far), the nearest of each set first, until the rest is inside components."""
        order = Window.partitionBy("b").orderBy("far", "a")
        ranked = stored(candidates.withColumn("place", F.row_number().over(order)))
        last = ranked.agg(F.max("place")).first()[0] or 0
        met = ranked.select(F.col("a").alias("name")).union(ranked.select("b")).distinct()
        own = stored(texts.join(met, "name", "left_semi")) if last else None
        low, most = 0, 1
        while low < last:
            new = _rooted(ranked.filter((F.col("place") > low) & (F.col("place") <= most)), roots)
            new = stored(_verified(stored(new.select("a", "b")), own, similarity, shingle))
            if not new.isEmpty():
                roots = components(roots.union(new))
            low, most = most, most * GROW
        return roots

    @F.arrow_udf("binary")
    def wide_of(column: pa.Array) -> pa.Array:
        return pa.array([parity(shingle_set(t.as_py(), shingle), WIDE) for t in column], pa.binary())

    first = _near(fingerprint_pairs(one.select("name", "fp")), signs, similarity)
    roots = settled(first, docs.sparkSession.createDataFrame([], "node bigint, root bigint"))
    keyed = texts.select("name", "text").mapInArrow(_keyed(shingle, similarity), "key bigint, name bigint")
    rows = keyed.repartition("key").sortWithinPartitions("key", "name")
    found = stored(rows.mapInArrow(_paired(dense, CENTRES), "key bigint, a bigint, b bigint"))
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    tried = stored(_near(_rooted(pairs, roots), signs, similarity))
    roots = settled(tried, roots)
    members = found.filter("key IS NOT NULL")
    members = stored(members.select("key", F.col("a").alias("name")).union(members.select("key", "b")).distinct())
    most, wide = 1, None
    while not members.isEmpty():
        rooted = members.join(roots, F.col("name") == F.col("node"), "left").select("key", "name", F.coalesce("root", "name").alias("root"))
        # Keys whose sets are one component have nothing left to find.
        of_key = Window.partitionBy("key")
        rooted = rooted.withColumns({"low": F.min("root").over(of_key), "high": F.max("root").over(of_key)}).filter("low <> high")
        rooted = stored(rooted.drop("low", "high"))
        members = rooted.select("key", "name")
        if wide is None:
            wide = texts.join(members.select("name").distinct(), "name", "left_semi").join(signs.select("name", "n"), "name")
            wide = stored(wide.select("name", "n", wide_of("text").alias("bits")))
        rows = _dealt(rooted, cell).join(wide, "name").select("key", "part", "name", "root", "n", "bits")
        rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")
        offered = stored(rows.mapInArrow(_between(similarity, most), "a bigint, b bigint, far bigint, more boolean"))
        new = offered.groupBy("a", "b").agg(F.first("far").alias("far"))
        new = stored(new.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        roots = settled(new, roots)
        tried = stored(tried.unionByName(new))
        if offered.filter("more").isEmpty():
            break
        most *= GROW
    docs.sparkSession.sql(f"DROP TABLE {table}")
    named = prints.join(roots, F.col("name") == F.col("node"), "left")
    return named.select("doc_id", "text_hash", F.coalesce("root", "name").alias("component"))
