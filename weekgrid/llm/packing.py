"""Best-fit packing of token sequences, bulk-synchronous over runs of equal length.

Documents longer than a sequence are cut into full pieces; what is left over is the first piece. All pieces are
range-sorted by descending length, so that every piece has a global rank: the place of its partition plus its place inside it,
from partition counts alone. Equal lengths form runs of ranks, and equal gaps form runs of sequence numbers; there are at
most as many lengths and gaps as a sequence has tokens, whatever the number of documents.

A round takes the longest run of pieces left and sweeps to its successor, the run of smallest gaps that hold it.
Where more pieces than gaps meet, lower ranks go first and the others go on to the next larger gaps, or open new sequences; the gaps
are updated and the next round begins. Each match is an interval of ranks that maps to an interval of sequences
at one offset. The pieces then find their interval in parallel, by length and rank. The result is that of
best-fit decreasing piece by piece, while the state of all rounds is bounded by the sequence length.

Defined cases: the name of an added token in a text is that token, as the ``tokenizers`` library reads it; a null text has only the closing token; rows that share an id are packed each for itself; no rows give none.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.common import over_batches
from weekgrid.session import stored

CAPACITY = 1024
CLOSING = 2  # the id behind each document
ADDED = {"<|endoftext|>": 50256}  # the added tokens of byte_bpe_50k.json, which the rank file doesn't hold

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)


def encode(path: str, pattern: str, text: str) -> list[int]:
    """The ids of a text. A run of blanks that is too long for the encoder's own splitting is split by the ``regex`` module."""
    own = _tokenizer(path, pattern)
    try:
        return own.encode(text, allowed_special="all", disallowed_special=())
    except ValueError:
        ids: list[int] = []
        for part in re.split(f"({'|'.join(map(re.escape, ADDED))})", text):
            if part in ADDED:
                ids.append(ADDED[part])
            else:
                for piece in regex.findall(pattern, part):
                    ids += own._encode_single_piece(piece)
        return ids


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` tokens; only the first may be shorter."""
    first = total % capacity or min(total, capacity)
    edges = [0, *range(first, total + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def document_pieces(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Tokenize and cut: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian bytes."""

    def pieces(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(path, pattern, text.as_py() or ""), CLOSING], dtype="<u4")
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length].tobytes()
                    row = {"doc_id": doc.as_py(), "piece": i, "start": start, "length": length, "ids_crc32": zlib.crc32(own)}
                    yield row | {"ids": own} if with_ids else row

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return over_batches(source, pieces, PIECES + ", ids binary" * with_ids)


def plan_rounds(runs: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Matches (length, first rank in the run, count, first sequence, offset) from the run sizes, and the number of sequences.

    Piece ``i`` of a match goes to sequence ``first + i``.
    """
    matches, sequences = [], 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by size: (first sequence, count)
    for length in sorted(runs, reverse=True):
        rank, left, gap = 0, runs[length], length
        while left:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap <= capacity:
                first, count = gaps[gap].pop()
                size = gap
            else:
                size = capacity
                first, count = sequences, -(-left // (capacity // length))
                sequences += count
            each = min(size // length, left)  # a gap goes on being the best one while it holds another piece
            full = min(count, left // each)
            offset = capacity - size
            for j in range(each):
                matches.append((length, rank, full, first, offset + j * length))
                rank += full
            left -= full * each
            if size - each * length:
                gaps[size - each * length].append((first, full))
            if full < count:
                rest = min(left, each)  # the last pieces of the run share one more gap
                for j in range(rest):
                    matches.append((length, rank, 1, first + full, offset + j * length))
                    rank += 1
                left -= rest
                if rest and size - rest * length:
                    gaps[size - rest * length].append((first + full, 1))
                if full + bool(rest) < count:
                    gaps[size].append((first + full + bool(rest), count - full - bool(rest)))
            gap = length
    return matches, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset; lengths lie between 1 and ``capacity``."""
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece")]
    # Range sorting reads its input twice, so the tokens are counted once and written.
    ranged = stored(pieces).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Partition number and place inside it; written, so that no later pass can deal the rows anew.
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # At most a row per partition and length, folded again to the two small tables below.
    counts = ranged.groupBy(part.alias("part"), "length").count().cache()
    runs = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    sizes = {r["part"]: r["n"] for r in counts.groupBy("part").agg(F.sum("count").alias("n")).collect()}
    counts.unpersist()
    matches, _ = plan_rounds(runs, capacity)
    before, begins = 0, {}
    for length in sorted(runs, reverse=True):
        begins[length], before = before, before + runs[length]
    starts = np.zeros(max(sizes, default=0) + 1, dtype=np.int64)
    for p in sorted(sizes)[:-1]:
        starts[p + 1 :] += sizes[p]
    plan = {length: ([], [], []) for length in runs}
    for length, rank, _, first, offset in matches:
        for into, value in zip(plan[length], (rank, first, offset)):
            into.append(value)
    # Bounded by the number of lengths times gaps, not by the documents.
    sent = spark.sparkContext.broadcast((starts, begins, {k: tuple(np.array(x) for x in v) for k, v in plan.items()}))

    @F.arrow_udf("struct<sequence_id:bigint, offset:bigint>")
    def placed(parts_: pa.Array, places: pa.Array, lengths: pa.Array) -> pa.Array:
        starts, begins, plan = sent.value
        lengths_ = lengths.to_numpy(zero_copy_only=False)
        rank = starts[parts_.to_numpy(zero_copy_only=False)] + places.to_numpy(zero_copy_only=False)
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for length in np.unique(lengths_):
            mine = lengths_ == length
            ranks, firsts, offsets = plan[int(length)]
            own = rank[mine] - begins[int(length)]
            i = np.searchsorted(ranks, own, "right") - 1
            sequence[mine], offset[mine] = firsts[i] + own - ranks[i], offsets[i]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    found = ranged.withColumn("at", placed(part, place, "length"))
    return found.select(*pieces.columns, F.col("at")["sequence_id"].alias("sequence_id"), F.col("at")["offset"].alias("offset"))
