"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to unit length for hashing, which turns the largest inner product of unit vectors into the least
Euclidean distance; vectors of other lengths get one more component that makes them equally long. Each of ``TABLES`` tables cuts
``FUNCTIONS`` Gaussian projections into cells of width ``WIDTH``. A query visits its own bucket and those of neighbouring cells, in
the order of the expected squared distance to the cells' borders (the rank-based template of query-directed probing), and the
candidates of all tables are reranked by the exact inner product of the original vectors in double precision. Matrix products tell which
candidates can be among the best; only these are scored pair by pair.

Equal vectors are one entry with its ``k + 1`` least ids, so a vector that a third of all rows share is scored once. Buckets are
gathered into blocks; crowded blocks are split on the side of the entries and on that of the queries, so a
block has a bounded number of either. Per block a query keeps its ``k + 1`` best, and blocks are merged by bounded lists.
Queries whose buckets held fewer than ``k`` candidates in all visit every bucket of one table instead, which is exact.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, have no id, or another length than most take
no part, neither as candidates nor as queries. Rows that share an id and a vector are one; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekgrid.llm.common import arrow_schema
from weekgrid.session import stored

NEIGHBOURS = 20
TABLES = 6
FUNCTIONS = 10
WIDTH = 3.0
PROBES = 128
SEED = 11
BLOCK = 16 << 20  # bytes of the entries of a block, as doubles
ENTRIES = 1 << 15  # of a block at most
ASKING = 4  # entries of a block for each of its queries
PAIRS = 1 << 16  # scored at once


def probe_template(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of places among the ``2 * functions`` borders sorted by distance, best expected score first.

    The j-th smallest of the squared distances has a known expectation; a set must not cross both borders of a cell.
    """
    k = functions
    score = [j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    score += [1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(k + 1, 2 * k + 1)]
    found, heap = [()], [(score[0], (1,))]
    while len(found) < probes and heap:
        total, places = heapq.heappop(heap)
        if all(2 * k + 1 - j not in places for j in places):
            found.append(places)
        last = places[-1]
        if last < 2 * k:
            heapq.heappush(heap, (total - score[last - 1] + score[last], (*places[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last], (*places, last + 1)))
    return found


class Hashes:
    """The tables' projections; the same for every task, from the seed alone."""

    def __init__(self, dims: int, longest: float, tables: int, functions: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.normals = rng.standard_normal((tables, dims + 1, functions))
        self.shifts = rng.uniform(0, 1, (tables, functions))
        self.mix = rng.integers(1, 1 << 62, functions) | 1
        self.width, self.longest, self.functions = width, longest, functions

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Entries, made equally long by one more component."""
        scaled = vectors / self.longest
        rest = np.sqrt(np.clip(1 - (scaled * scaled).sum(axis=1), 0, None))
        return np.concatenate([scaled, rest[:, None]], axis=1)

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        """Queries: their length does not change the order of candidates."""
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        return np.concatenate([unit, np.zeros((len(vectors), 1))], axis=1)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        return (cells * self.mix).sum(axis=1)

    def places(self, lifted: np.ndarray, table: int) -> np.ndarray:
        return lifted @ self.normals[table] / self.width + self.shifts[table]

    def entry_keys(self, lifted: np.ndarray, table: int) -> np.ndarray:
        return self.keys(np.floor(self.places(lifted, table)).astype(np.int64))

    def probe_keys(self, asked: np.ndarray, table: int, template: list) -> np.ndarray:
        """One column per probe, in order of estimated success."""
        place = self.places(asked, table)
        cell = np.floor(place).astype(np.int64)
        rest = place - cell
        borders = np.argsort(np.concatenate([rest, 1 - rest], axis=1), axis=1, kind="stable")
        rows, out = np.arange(len(asked)), np.empty((len(asked), len(template)), np.int64)
        for p, chosen in enumerate(template):
            moved = cell.copy()
            for j in chosen:
                border = borders[:, j - 1]
                moved[rows, border % self.functions] += np.where(border < self.functions, -1, 1)
            out[:, p] = self.keys(moved)
        return out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else pa.array([])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their number of components. Single precision stays so until it is computed with."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0.0)
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = lengths["n"] if lengths else 1
    return rows.filter(F.size("v") == dims), dims


def best_in_buckets(q: np.ndarray, v: np.ndarray, ids: np.ndarray, buckets, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the ``width`` best of each query among the entries that it visits, ties to the smaller id, -inf where there are fewer.

    ``buckets`` gives (queries, begin, end): these queries visit these entries. A query leaves out what a matrix product shows to be below its best so far by
    more than both ways of adding can differ.
    """
    best, at = np.full((len(q), width), -np.inf), np.full((len(q), width), -1, np.int64)
    with np.errstate(all="ignore"):
        length = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (q, v)]
        slack = 8 * q.shape[1] * np.finfo(float).eps * length[0] * length[1].max(initial=0) + np.finfo(float).tiny
    limit = np.full(len(q), -np.inf)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        who, place = (np.concatenate(x) for x in zip(*held))
        held.clear()
        # One sum of products per pair, so a pair has the same score in every block.
        parts = [slice(i, i + PAIRS) for i in range(0, len(who), PAIRS)]
        scores = [np.einsum("ij,ij->i", q[who[p]], v[place[p]]) for p in parts]
        some = np.unique(who)
        score, own = np.concatenate([best[some].ravel(), *scores]), np.concatenate([at[some].ravel(), ids[place]])
        who = np.concatenate([np.repeat(some, width), who])
        order = np.lexsort((own, -score, who))
        first = np.searchsorted(who[order], some)
        take = order[(first[:, None] + np.arange(width)).ravel()]
        best[some], at[some] = score[take].reshape(-1, width), own[take].reshape(-1, width)
        limit[some] = best[some, -1] - slack[some]

    with np.errstate(all="ignore"):
        for mine, a, b in buckets:
            for i in range(a, b, 1024):
                j = min(b, i + 1024)
                for k in range(0, len(mine), 2048):
                    own = mine[k : k + 2048]
                    rough, low = q[own] @ v[i:j].T, limit[own]
                    fresh = np.flatnonzero(np.isneginf(low))
                    if len(fresh) and j - i > width:
                        low[fresh] = np.fmax(low[fresh], np.partition(rough[fresh], j - i - width, axis=1)[:, j - i - width] - 2 * slack[own[fresh]])
                    row, column = np.nonzero(~(rough < low[:, None]))
                    if len(row):
                        held.append((own[row], i + column))
                    if sum(len(x) for x, _ in held) >= PAIRS:
                        settle()
        if held:
            settle()
    return best, at


def nearest(
    vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, tables: int = TABLES,
    functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best found for the rows whose id satisfies ``queries``, a column of ``vec_id``."""
    rows, dims = valid_vectors(vectors, id_col, vector_col)
    one = rows.distinct()
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = one.withColumn("place", place).filter(F.col("place") <= k + 1)
    entries = stored(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("gid", F.col("ids")[0]))
    asking = stored(one.filter(queries).join(entries.select("v", "gid"), "v").select(F.col("vec_id").alias("query_id"), "gid"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = entries.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"), F.max(F.sqrt(square)).alias("longest")).first()
    # Vectors of one length need no lift: rounding must not give them one.
    hashes = Hashes(dims, (facts["longest"] or 1.0) * (1 + 1e-7), tables, functions, width, seed)
    template = probe_template(functions, probes)
    room = max(1024, min(ENTRIES, BLOCK // (8 * max(1, dims))))  # entries of a block
    spread = max(1, math.ceil((facts["n"] or 0) / room))  # blocks of a table before crowded ones are split

    entry_schema, probe_schema = "gid bigint, block bigint, key bigint", "gid bigint, block bigint, keys binary"

    def entry_rows(batches):
        for batch in batches:
            if batch.num_rows:
                lifted = hashes.lifted(matrix(batch.column(1), dims))
                for t in range(tables):
                    key = hashes.entry_keys(lifted, t)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t * spread + key % spread), pa.array(key)], schema=arrow_schema(entry_schema))

    def probe_rows(batches):
        """Per query and block the keys to visit there."""
        for batch in batches:
            if batch.num_rows:
                gid, asked = batch.column(0).to_numpy(), hashes.asked(matrix(batch.column(1), dims))
                for t in range(tables):
                    keys = hashes.probe_keys(asked, t, template)
                    block = keys % spread
                    order = np.argsort(block, axis=1, kind="stable")
                    keys, block = (np.take_along_axis(x, order, 1).ravel() for x in (keys, block))
                    row = np.repeat(np.arange(len(gid)), len(template))
                    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])]))
                    ends = np.append(first, len(row)).astype(np.int32) * np.int32(8)
                    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(keys.astype("<i8"))])
                    yield pa.RecordBatch.from_arrays([pa.array(gid[row[first]]), pa.array(t * spread + block[first]), packed], schema=arrow_schema(probe_schema))

    placed = stored(entries.select("gid", "v").mapInArrow(entry_rows, entry_schema))
    probed = stored(asking.select("gid").distinct().join(entries.select("gid", "v"), "gid").mapInArrow(probe_rows, probe_schema))

    vector = entries.select("gid", "v")
    out = pa.schema([("gid", pa.int64()), ("best", pa.list_(pa.struct([("below", pa.float64()), ("gid", pa.int64())])))])

    def visit(entry: pa.Table, query: pa.Table) -> pa.Table:
        if not entry.num_rows or not query.num_rows:
            return out.empty_table()
        key = entry["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        key, ids = key[order], entry["gid"].to_numpy()[order]
        v = matrix(entry["v"].combine_chunks(), dims)[order]
        q = matrix(query["v"].combine_chunks(), dims)
        kinds, begins = np.unique(key, return_index=True)
        # A query without keys visits every bucket.
        wanted = [np.frombuffer(x, "<i8") if x else kinds for x in query["keys"].to_pylist()]
        who = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted])
        wanted = np.concatenate(wanted)
        by_key = np.argsort(wanted, kind="stable")
        who, wanted = who[by_key], wanted[by_key]
        ends, begin = [*begins[1:], len(key)], np.searchsorted(wanted, kinds, "left")
        end = np.searchsorted(wanted, kinds, "right")
        buckets = ((np.unique(who[x:y]), a, b) for x, y, a, b in zip(begin, end, begins, ends) if y > x)
        best, at = best_in_buckets(q, v, ids, buckets, k + 1)
        there = (at >= 0) | (best > -np.inf)
        pairs = pa.StructArray.from_arrays([pa.array(-best[there]), pa.array(at[there])], fields=list(out.field("best").type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]), pa.int32()), pairs)
        return pa.Table.from_arrays([pa.array(query["gid"].to_numpy()), lists.cast(out.field("best").type)], schema=out)

    def search(probed: DataFrame) -> DataFrame:
        """(gid, best) with the ``k + 1`` best ids, the query's own among them."""
        # Sizes of blocks: one row per block, blocks being few thousand entries each.
        parts = (
            placed.groupBy("block").agg(F.ceil(F.count("*") / room).cast("int").alias("parts"))
            .join(probed.groupBy("block").agg(F.ceil(F.count("*") / (room // ASKING)).cast("int").alias("rounds")), "block")
        )
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        some = lambda n: F.pmod(F.xxhash64("gid"), F.col(n)).cast("int")
        left = placed.join(parts, "block").withColumn("part", some("parts"))
        right = probed.join(parts, "block").withColumn("round", some("rounds"))
        # Rows get their vectors before they are repeated.
        left = left.join(vector, "gid").select("block", "part", every("rounds").alias("round"), "gid", "key", "v")
        # New names for the columns that both sides take from the same table.
        right = right.join(vector, "gid").withColumn("part", every("parts")).select(*(F.col(c).alias(c) for c in ("block", "part", "round", "gid", "keys", "v")))
        keys = ["block", "part", "round"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(visit, "gid bigint, best array<struct<below:double, gid:bigint>>")
        # A pair is met once in each table, so what is distinct among the first of the sorted pairs holds the best; all of them would be compared with each other.
        ranked = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, (k + 1) * tables)
        merged = found.groupBy("gid").agg(ranked.alias("best")).select("gid", F.slice(F.array_distinct("best"), 1, k + 1).alias("best"))
        # From distinct vectors to ids: each of the k + 1 best brings at most k + 1 ids.
        wide = merged.select("gid", F.explode("best").alias("b")).select("gid", "b.below", F.col("b.gid").alias("other"))
        wide = wide.join(entries.select(F.col("gid").alias("other"), "ids"), "other")
        listed = wide.select("gid", F.transform("ids", lambda i: F.struct(F.col("below"), i.alias("vec_id"))).alias("some"))
        return listed.groupBy("gid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k + 1).alias("best"))

    listed = stored(search(probed))
    needed = min(k + 1, facts["ids"] or 0)
    short = asking.select("gid").distinct().join(listed.filter(F.size("best") >= needed), "gid", "left_anti")
    short = stored(short.select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("block"), F.lit(b"").alias("keys")))
    if not short.isEmpty():
        listed = listed.filter(F.size("best") >= needed).unionByName(search(short))
    own = asking.join(listed, "gid").select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.below")).alias("score")
    )
