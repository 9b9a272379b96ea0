"""Interaction audit of filters: what each of five filters removes, in every order in which they can be applied.

Four filters look at a text alone and are bits of a mask, computed in one scan together with a hash of the text. The fifth fails a text
that a smaller id has as well. For it, hashes go into a counting Bloom sketch first: a section of the sketch is chosen by
the hash, ``PROBES`` counters in it are raised, and counters stop at two. Tasks send the counters that they have raised, and sections
are merged by adding. A text with a counter below two is the only one of its kind and done. The rest, true repeats and a few others,
are read again whole and shuffled for the least id of every complete text.

Masks are additive: documents are counted by (part, mask), at most 32 masks a part, and every order, step and share is a sum over
them. So the 120 orders cost nothing that grows with the documents.

The merged sketch takes one byte a document. Up to ``SENT`` bytes it is sent to the scan tasks, and texts are dropped there. A larger
one is sent section by section and meets the narrow rows only (a pass for every ``SENT`` bytes); the texts of possible
repeats are then found by a semi join on the hash.

Defined cases: a null text is empty; a null part is the empty string; a null id is neither smaller nor larger than another, so it repeats
nothing and makes nothing a repeat; rows that share an id and a text are no repeats of each other; several labels of an id
count if one of them does; an empty table has no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.common import filled
from weekgrid.session import stored

FILTERS = "ABCDE"
REPEATED = 16  # the bit of E
ORDERS = ["".join(p) for p in permutations(FILTERS)]

CELLS = 1 << 17  # counters of a section
SECTION = CELLS // 8  # documents of a section
PROBES = 3
SENT = 64 << 20  # bytes of the merged sketch that are sent at once
FLUSH = 1 << 20  # hashes that a task turns into counters at once

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failing = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate(failing)), F.lit(0)).cast("int")


def _cells(hashes: np.ndarray, sections: int) -> tuple[np.ndarray, np.ndarray]:
    """The section of every hash, and its counters there (a row each)."""
    x = hashes.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    section = hashes % sections
    return section, np.stack([(x >> np.uint64(20 * i)).astype(np.int64) % CELLS for i in range(PROBES)], axis=1)


def _raised(sections: int):
    """(section, counters) of a task: little-endian, the place twice, plus one if it was raised more than once."""

    def run(batches):
        def table(hashes):
            section, cells = _cells(hashes, sections)
            places, counts = np.unique(section[:, None] * CELLS + cells, return_counts=True)
            packed = ((places % CELLS << 1) | (counts > 1)).astype("<u4")
            names, begin = np.unique(places // CELLS, return_index=True)
            parts = [p.tobytes() for p in np.split(packed, begin[1:])]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(parts, pa.binary())], ["section", "counters"])

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= FLUSH:
                yield table(np.concatenate(held))
                held, size = [], 0
        if size:
            yield table(np.concatenate(held))

    return run


def _merged(batches):
    """(section, full): a bit for every counter that has reached two, from rows sorted by section."""
    last, counters = None, np.zeros(CELLS, np.uint8)

    def table():
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([np.packbits(counters > 1).tobytes()], pa.binary())], ["section", "full"])

    for batch in batches:
        for section, raised in zip(batch.column(0).to_pylist(), batch.column(1)):
            if section != last:
                if last is not None:
                    yield table()
                last, counters = section, np.zeros(CELLS, np.uint8)
            raised = np.frombuffer(raised.as_py(), "<u4")
            places = raised >> 1
            counters[places] = np.minimum(counters[places] + 1 + (raised & 1), 2)
    if last is not None:
        yield table()


def sketch(prints: DataFrame, sections: int) -> DataFrame:
    """(section, full) of the hashes of ``prints``."""
    raised = prints.select("hash").mapInArrow(_raised(sections), "section bigint, counters binary")
    return raised.repartition("section").sortWithinPartitions("section").mapInArrow(_merged, "section bigint, full binary")


def _possible(spark, full: DataFrame, sections: int):
    """A function of hash columns: whether its counters have all reached two. False outside the given sections."""
    sent = spark.sparkContext.broadcast({r["section"]: np.frombuffer(r["full"], np.uint8) for r in full.collect()})

    @F.arrow_udf("boolean")
    def possible(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False)
        section, cells = _cells(h, sections)
        out = np.zeros(len(h), bool)
        for s in np.unique(section):
            if s in sent.value:
                own = np.flatnonzero(section == s)
                bits = sent.value[s][cells[own] >> 3] >> (7 - (cells[own] & 7)).astype(np.uint8)
                out[own] = (bits & 1).all(axis=1)
        return pa.array(out)

    return possible


def mask_counts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", sent: int = SENT,
) -> DataFrame:
    """(part, mask, n, good, toxic): documents of every part by the filters that they fail, and how many are labelled so."""
    spark = docs.sparkSession
    text = filled(text_col)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("doc_id"), part.alias("part"), text.alias("text"), F.xxhash64(text).alias("hash"))
    prints = stored(given.select("doc_id", "part", "hash", own_mask(F.col("text")).alias("mask")))
    sections = max(1, -(-prints.count() // SECTION))
    full = stored(sketch(prints, sections))
    at_once = max(1, sent // (CELLS // 8))
    if sections <= at_once:
        possible = _possible(spark, full, sections)
        marked = prints.withColumn("possible", possible("hash"))
        suspects = given.filter(possible("hash"))
    else:
        passes = []
        section = F.pmod("hash", F.lit(sections))
        for first in range(0, sections, at_once):
            own = full.filter((F.col("section") >= first) & (F.col("section") < first + at_once))
            rows = prints.filter((section >= first) & (section < first + at_once))
            passes.append(stored(rows.withColumn("possible", _possible(spark, own, sections)("hash"))))
        marked = passes[0]
        for rows in passes[1:]:
            marked = marked.unionByName(rows)
        suspects = given.join(marked.filter("possible").select("hash").distinct(), "hash", "left_semi")
    # A document repeats another one unless it is the first of its text. Id and hash name a text well enough where the id is known.
    firsts = suspects.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.first("hash").alias("hash"))
    firsts = firsts.filter("doc_id IS NOT NULL").select("doc_id", "hash", F.lit(True).alias("first")).distinct()
    flags = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    known = marked.filter("doc_id IS NOT NULL").join(firsts, ["doc_id", "hash"], "left").join(flags, "doc_id", "left")
    mask = F.col("mask") + F.when(F.col("possible") & F.col("first").isNull(), REPEATED).otherwise(0)
    known = known.select("part", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # Rows without an id have nothing to join, and would meet in one task.
    other = prints.filter("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.unionByName(other).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")
    )


def order_report(counts: DataFrame) -> DataFrame:
    """One row for every part, order of the filters and step, from the counts by mask."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.lit([1, 2, 3, 4, 5])))
    letter, earlier = F.expr("substring(filter_order, step, 1)"), F.expr("substring(filter_order, 1, step - 1)")

    def bits(of: Column) -> Column:
        return sum((F.when(F.instr(of, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))

    rows = rows.withColumn("own", bits(letter)).withColumn("before", bits(earlier))

    def total(chosen, value=lambda m: m["n"]) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("masks", zero, lambda sofar, m: sofar + F.when(chosen(m["mask"]), value(m)).otherwise(zero))

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    removed = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"),
        total(removed, lambda m: m["toxic"]).alias("toxic_lost"),
        # Of all orders, a document is removed by each of its failing filters equally often.
        total(fails, lambda m: m["n"] * (F.lit(len(ORDERS)) / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    return order_report(mask_counts(docs, labels, id_col, text_col, part_col))
