"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; two link at ``DISTANCE`` or fewer differing bits. The bits are cut into segments, and every segment
gets a radius so that the radii plus one sum to more than the distance: then some segment of a linked pair differs by no
more than its radius (pigeonhole). Each fingerprint stands in the table under each of its segment values, and
enumerates the Hamming ball around each of them to fetch table matches, whose complete distance is verified.

* Equal fingerprints are one entry, so exact copies cost nothing here.
* Of a pair that differs in one bit of a segment one side has that bit clear; only that side enumerates it.
* Within a bucket, links are reduced to a spanning forest as they are found: a probe is linked once to every cluster of
  table entries it touches, and the clusters become one. A bucket of near copies yields as many links as it has entries, not
  their pairs, and loses no connection.
* Buckets with more entries than a task should hold are dealt to several tasks; their probes visit each of them.

Connected components run on distinct fingerprints by alternating large-star and small-star steps; every step is
written to the shared folder.

``similar_links`` is the same method for a stated similarity of word shingles, as an estimate; the pipeline's stage is exact
(``jaccard``). 64 bits are too few to tell 0.8 from 0.7, so
its fingerprints are ``WORDS`` times as long and count every distinct shingle once; the share of differing bits estimates the
angle between two shingle sets, which gives the distance of the asked similarity. That distance has two standard errors to
either side of it; one of them is added, so that most pairs of exactly that similarity link. Segments have ``LANE`` bits and a
radius of one. A segment is cut in two: a pair within the radius agrees in one half at least, which is the key of the
bucket, and the ball is enumerated over the other half inside the bucket. So a fingerprint is sent twice for every segment, not
once for every member of the ball.

Defined cases: a text without words has fingerprint zero and links like any other; a null text is empty; null ids get
components, but are never their name unless no other id is there; rows that share an id are fingerprinted row by row.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.common import lowered
from weekgrid.session import stored

SHINGLE = 4  # words
DISTANCE = 4  # differing bits that still link
SEED = 42
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))  # first bit, bits, radius
BUCKET = 16_384  # table entries of a bucket that one task holds
DENSE = 32  # table entries of a bucket from which on links are reduced while they are found
SPAN = 1 << 16  # shingles whose bits are counted together

SIMILARITY = 0.8  # of the sets of shingles (Jaccard)
SIMILAR_SHINGLE = 5  # words
WORDS = 8  # 64-bit words of a long fingerprint
LANE = 21  # bits of its segments
LANES = tuple((word, first) for first in (0, LANE) for word in range(WORDS))  # word and first bit of each segment
HALVES = (11, LANE - 11)  # bits of the lower and the upper half of a segment
CELL = 1 << 17  # rows of a bucket of halves that one task holds


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words than a shingle has are one, no words are none."""
    words = lowered(text).split()  # splits at the six ASCII blanks
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    first = (ends - sizes)[: len(last)].tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(joined[a:b], SEED) for a, b in zip(first, last)], dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text: a bit is set if it is set in over half of the shingles' hashes."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SPAN):
        bits = np.unpackbits(hashes[i : i + SPAN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return prints(text.cast("string"))


def hex_column(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _segment(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _key(segment: int, value: Column) -> Column:
    return value.bitwiseOR(F.lit(segment << 32).cast("long"))


def table_rows(prints: DataFrame) -> DataFrame:
    keys = [_key(i, _segment(F.col("fp"), first, bits)) for i, (first, bits, _) in enumerate(SEGMENTS)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def probe_rows(prints: DataFrame) -> DataFrame:
    """The balls: the value itself, and every value with up to radius clear bits set (a pair meets from its clear side).

    With a radius over one, pairs may differ in both directions, so flips are enumerated both ways.
    """
    arrays = []
    for i, (first, bits, radius) in enumerate(SEGMENTS):
        value = _segment(F.col("fp"), first, bits)
        keys = [_key(i, value)]
        for size in range(1, radius + 1):
            for flips in combinations(range(bits), size):
                mask = F.lit(sum(1 << b for b in flips)).cast("long")
                flipped = _key(i, value.bitwiseXOR(mask))
                keys.append(F.when(value.bitwiseAND(mask) == 0, flipped) if size == 1 == radius else flipped)
        arrays.append(F.array(*keys))
    return prints.select("fp", F.explode(F.filter(F.concat(*arrays), lambda k: k.isNotNull())).alias("key"))


def _forest(entries: np.ndarray, probes: np.ndarray, distance: int, out: list) -> None:
    """Links of one bucket: each probe once to every cluster of entries that it touches."""
    cluster = np.arange(len(entries))
    for p in probes:
        near = np.flatnonzero((np.bitwise_count(entries ^ p) <= distance) & (entries != p))
        if len(near):
            roots = np.unique(cluster[near])
            for r in roots:
                out.append((p, entries[r]))
            if len(roots) > 1:
                cluster[np.isin(cluster, roots)] = roots[0]


def _links(distance: int):
    """Linked fingerprints from rows (key, part, kind, fp) sorted so that the entries of a bucket precede its probes."""

    def run(batches):
        carried = np.empty((2, 0), np.int64), np.empty(0, np.uint64)  # entries of the bucket that the last batch ended in
        for batch in batches:
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            probe = batch.column(2).to_numpy(zero_copy_only=False) == 1
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            where, fp = np.concatenate([carried[0], where], axis=1), np.concatenate([carried[1], fp])
            probe = np.concatenate([np.zeros(len(carried[1]), bool), probe])
            # Number the buckets in order of appearance; the rows are sorted, so neighbours tell.
            bucket = np.concatenate([[0], np.cumsum((where[:, 1:] != where[:, :-1]).any(axis=0))])
            entry_at = np.flatnonzero(~probe)
            begin = np.searchsorted(bucket[entry_at], bucket, "left")
            count = np.searchsorted(bucket[entry_at], bucket, "right") - begin
            out: list = []
            few = np.flatnonzero(probe & (count > 0) & (count <= DENSE))
            pairs_p = np.repeat(fp[few], count[few])
            runs = np.repeat(begin[few] - np.concatenate([[0], np.cumsum(count[few])[:-1]]), count[few]) if len(few) else np.empty(0, np.int64)
            pairs_e = fp[entry_at[runs + np.arange(len(pairs_p))]] if len(few) else np.empty(0, np.uint64)
            linked = (np.bitwise_count(pairs_p ^ pairs_e) <= distance) & (pairs_p != pairs_e)
            found = [np.stack([pairs_p[linked], pairs_e[linked]])]
            many = np.flatnonzero(probe & (count > DENSE))
            for b in np.unique(bucket[many]):
                own = many[np.searchsorted(bucket[many], b, "left") : np.searchsorted(bucket[many], b, "right")]
                i = own[0]
                _forest(fp[entry_at[begin[i] : begin[i] + count[i]]], fp[own], distance, out)
            if out:
                found.append(np.array(out, dtype=np.uint64).T)
            pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(pairs)], ["a", "b"])
            last = (bucket == bucket[-1]) & ~probe
            carried = where[:, last], fp[last]

    return run


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """A forest of links (a, b) among distinct fingerprints, with the components of all links."""
    if sum(radius + 1 for _, _, radius in SEGMENTS) <= distance:
        raise ValueError("the segments' radii don't cover the distance")
    entries, probes = table_rows(prints), probe_rows(prints)
    crowded = stored(entries.groupBy("key").count().filter(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("int").alias("parts")))
    if crowded.isEmpty():
        entries, probes = (x.withColumn("part", F.lit(0)) for x in (entries, probes))
    else:
        # Crowded keys are few: at most a bucket-th of all entries. Their number decides how they travel.
        small = F.broadcast(crowded) if crowded.count() <= 100_000 else crowded
        entries = entries.join(small, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("fp"), "parts").cast("int"), F.lit(0)))
        probes = probes.join(small, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    rows = entries.select("key", "part", F.lit(0).alias("kind"), "fp").unionByName(probes.select("key", "part", F.lit(1).alias("kind"), "fp"))
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "kind")
    return rows.mapInArrow(_links(distance), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge, root being the least node of its component."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Link every neighbour (the larger ones, or the smaller ones and the node) to the least of the neighbourhood."""
        if large:
            around = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        else:
            around = pairs.select(F.greatest("a", "b"), F.least("a", "b")).toDF("u", "v")
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        met = around.join(least, "u")
        if large:
            met = met.filter("v > u").select("v", "m")
        else:
            met = met.select("v", "m").union(least.select("u", "m"))
        return met.toDF("a", "b").filter("a <> b")

    def open_nodes(pairs: DataFrame) -> DataFrame:
        """Nodes with two roots, or with one although they are the root of others."""
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(pairs.select("b", F.lit(0)))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).filter("up > 1 OR up = 1 AND least = 0")

    edges = edges.toDF("a", "b")
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not open_nodes(edges).isEmpty():
        edges = stored(star(star(edges, True), False).distinct())
    # Every node is now linked to its root and to nothing else.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE,
    bucket: int = BUCKET,
) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the least id reachable over links, for every row of ``docs``."""
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(least.select("fp"), distance, bucket))
    rooted = least.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def similar_distance(similarity: float, words: int = WORDS) -> int:
    """Differing bits of two shingle sets of that Jaccard similarity and like size, and one standard error."""
    bits = 64 * words
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + math.sqrt(bits * share * (1 - share)))


def long_fingerprint(text: str | None, shingle: int = SIMILAR_SHINGLE) -> bytes:
    """``WORDS`` fingerprint words over the distinct shingles; every word sees another mix of a shingle's hash."""
    hashes = np.unique(shingle_hashes(text, shingle))
    counts = np.zeros(64 * WORDS, np.int64)
    steps = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(hashes), SPAN):
        # The output function of SplitMix64 (public domain) of WORDS successive states.
        mixed = hashes[i : i + SPAN, None] + steps
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def _words(prints: pa.Array) -> np.ndarray:
    """The words of long fingerprints, a row each."""
    return np.frombuffer(b"".join(prints.to_pylist()), "<u8").reshape(-1, WORDS)


def _half(words: np.ndarray, word, first, half) -> np.ndarray:
    """One half of a segment: the lower (0) or the upper one (1). Everything may be an array."""
    shift = np.asarray(first + np.where(half, HALVES[0], 0), np.uint64)
    mask = np.where(half, (1 << HALVES[1]) - 1, (1 << HALVES[0]) - 1).astype(np.uint64)
    return ((words[np.arange(len(words)), word] >> shift) & mask).astype(np.int64)


def _buckets(print_of: Column) -> Column:
    """The keys of both halves of every segment: number of the half, then its value."""

    @F.arrow_udf("array<bigint>")
    def keys_of(prints: pa.Array) -> pa.Array:
        words = _words(prints)
        keys = [((2 * i + half) << 32) | _half(words, word, first, half) for i, (word, first) in enumerate(LANES) for half in (0, 1)]
        flat = pa.array(np.stack(keys, axis=1).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(keys)), pa.int32()), flat)

    return keys_of(print_of)


def _close(words: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which of the rows ``a`` and ``b`` are within the distance; in steps, so that the memory stays bounded."""
    return np.concatenate([np.empty(0, bool)] + [
        np.bitwise_count(words[a[i : i + SPAN]] ^ words[b[i : i + SPAN]]).sum(axis=1, dtype=np.int64) <= distance
        for i in range(0, len(a), SPAN)
    ])


def _ball_links(bucket: np.ndarray, value: np.ndarray, words: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of the same bucket whose values differ in one bit at most.

    Rows of one value form a cell. Between small cells every pair is verified. Around a crowded cell, links are followed
    breadth first and only to rows not reached yet, which keeps the components and costs a group of near copies its size.
    """
    cell_of = (bucket << HALVES[0]) | value
    order = np.argsort(cell_of, kind="stable")
    cells, begin, count = np.unique(cell_of[order], return_index=True, return_counts=True)
    crowded = count > DENSE
    around: dict[int, set] = {}  # cells within the radius, of every cell that is crowded or beside a crowded one
    found = []
    for flip in (0, *(1 << i for i in range(HALVES[0]))):
        left = np.flatnonzero(cells & flip == 0)
        right = np.minimum(np.searchsorted(cells, cells[left] | flip), len(cells) - 1)
        met = cells[right] == cells[left] | flip
        left, right = left[met], right[met]
        full = crowded[left] | crowded[right]
        for a, b in zip(left[full].tolist(), right[full].tolist()):
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
        left, right = left[~full], right[~full]
        sizes = count[left] * count[right]
        pair = np.repeat(np.arange(len(left)), sizes)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        a, b = begin[left[pair]] + at // count[right[pair]], begin[right[pair]] + at % count[right[pair]]
        if not flip:
            a, b = a[a < b], b[a < b]
        a, b = order[a], order[b]
        near = _close(words, a, b, distance)
        found.append((a[near], b[near]))
    open_rows = {c: order[begin[c] : begin[c] + count[c]] for c in around}
    cell_at = {}
    for c, rows in open_rows.items():
        cell_at.update(dict.fromkeys(rows.tolist(), c))
    waiting, reached, out = list(cell_at), set(), []
    for seed in waiting:
        if seed in reached:
            continue
        reached.add(seed)
        own = cell_at[seed]
        open_rows[own] = open_rows[own][open_rows[own] != seed]
        front = [seed]
        while front:
            row = front.pop()
            for c in around[cell_at[row]]:
                rest = open_rows[c]
                if not len(rest):
                    continue
                near = np.bitwise_count(words[rest] ^ words[row]).sum(axis=1, dtype=np.int64) <= distance
                if near.any():
                    new = rest[near].tolist()
                    open_rows[c] = rest[~near]
                    reached.update(new)
                    front += new
                    out += ((row, other) for other in new)
    if out:
        found.append(tuple(np.array(out, np.int64).T))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _similar_links(distance: int):
    """Linked fingerprints from rows (key, part, fp) sorted by key and part; a bucket is bounded by its number of rows."""
    word, first = np.array(LANES).T

    def run(batches):
        kept, last = [], None

        def linked():
            key, part, words = (np.concatenate(x) for x in zip(*kept))
            bucket = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1]))])
            number = key >> 32
            lane, half = number // 2, number % 2
            value = _half(words, word[lane], first[lane], 1 - half)
            a, b = _ball_links(bucket, value, words, distance)
            a, b = (np.ascontiguousarray(words[x]) for x in (a, b))
            sides = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (a, b)]
            return pa.RecordBatch.from_arrays(sides, ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            words = _words(batch.column(2))
            # Rows of the last bucket wait for the rest of it.
            ends = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = ends[-1] + 1 if len(ends) else 0
            if cut or last != (key[0], part[0]):
                if kept and last != (key[0], part[0]):
                    yield linked()
                    kept = []
                if cut:
                    kept.append((key[:cut], part[:cut], words[:cut]))
                    yield linked()
                    kept = []
            kept.append((key[cut:], part[cut:], words[cut:]))
            last = (key[-1], part[-1])
        if kept:
            yield linked()

    return run


def similar_links(prints: DataFrame, distance: int, cell: int = CELL) -> DataFrame:
    """Links (a, b) among distinct long fingerprints (column fp), with the components of all links found in a common bucket."""
    rows = prints.select("fp", F.explode(_buckets(F.col("fp"))).alias("key"))
    crowded = rows.groupBy("key").count().filter(F.col("count") > cell).select("key", F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    # There are no more keys than halves times values (65,536), so that crowded ones can be sent to every task. A crowded bucket
    # becomes one for every two of its parts.
    own, parts = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.col("parts")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(j, own) * parts + F.greatest(j, own))
    rows = rows.join(F.broadcast(stored(crowded)), "key", "left")
    rows = rows.select("key", F.explode(F.when(parts.isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part"), "fp")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_similar_links(distance), "a binary, b binary")
