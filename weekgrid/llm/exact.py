"""Exact deduplication by Grace hashing.

Contents are equal when their bytes are equal after lower-casing A-Z. Three steps:

1. Each scan task folds its own repeats into one partial group per content, so a content that fills a third of all
   rows leaves a task once, however many copies the task saw. The result is written to the shared folder, so that a
   lost task cannot renumber partial groups that others already refer to.
2. Partial groups are shuffled by the hash of the content. Each task runs Grace hashing over its share: contents go to
   an open-addressing table that compares complete contents; when the table outgrows its memory, everything is dealt
   to spill files by a hash with another seed, and each file is handled the same way. Equal contents are absorbed on
   entering a table, so only distinct contents count towards its size. Spill files are unnamed and vanish with the task.
3. Rows find their group through the number of their partial group, which is local to a task: no key is hot.

Defined cases: a null text is empty; a row with a null id ranks below every other; among rows with the same id the one
read last in the task with the highest number stays, and exactly one row of a group stays in any case.
"""

from __future__ import annotations

import pickle
import tempfile
from array import array
from collections.abc import Iterator
from hashlib import sha256

import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.common import lowered, over_batches
from weekgrid.session import stored

MEMORY = 48 << 20  # bytes of distinct content a table may hold
FANOUT = 16  # spill files per level


class ContentTable:
    """Open addressing with linear probing; equal hash values are settled by comparing complete contents."""

    def __init__(self):
        self.slots, self.hashes, self.contents, self.values, self.bytes = array("q", [-1]) * 64, [], [], [], 0

    def find(self, content: bytes) -> tuple[int, bool]:
        """The entry of a content and whether it is new."""
        h, mask = xxhash.xxh64_intdigest(content), len(self.slots) - 1
        i = h & mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            i = (i + 1) & mask
        self.slots[i] = e = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(None)
        self.bytes += len(content) + 100
        if 3 * len(self.contents) > 2 * len(self.slots):
            self.grow()
        return e, True

    def grow(self):
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = e


PARTS = "row bigint, part bigint, doc bigint, digest binary, content binary, hash bigint, n bigint, top bigint, top_row bigint"


def _partial(memory: int):
    """Rows of the task with the number of their partial group, and the partial groups themselves."""

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        row = part = base
        table = ContentTable()

        def groups():
            for content, h, (number, n, top) in zip(table.contents, table.hashes, table.values):
                yield {"part": number, "content": content, "hash": h - (1 << 63), "n": n, "top": top[1] if top[0] else None, "top_row": top[2]}

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, content = doc.as_py(), lowered(text.as_py())
                e, new = table.find(content)
                rank = (doc is not None, doc or 0, row)
                if new:
                    table.values[e] = [part, 1, rank]
                    part += 1
                else:
                    value = table.values[e]
                    value[1] += 1
                    value[2] = max(value[2], rank)
                yield {"row": row, "part": table.values[e][0], "doc": doc, "digest": sha256(content).digest()}
                row += 1
                if table.bytes > memory:
                    yield from groups()
                    table = ContentTable()
        yield from groups()

    return run


def grace(records: Iterator[tuple], memory: int, level: int = 0) -> Iterator[tuple]:
    """Groups of equal content from (content, part numbers, n, top) records, in bounded memory."""
    table, files = ContentTable(), None

    def spill(record):
        where = xxhash.xxh64_intdigest(record[0], seed=level + 1) % FANOUT
        pickle.dump(record, files[where], pickle.HIGHEST_PROTOCOL)

    for record in records:
        if files:
            spill(record)
            continue
        e, new = table.find(record[0])
        if new:
            table.values[e] = [list(record[1]), record[2], record[3]]
        else:
            value = table.values[e]
            value[0] += record[1]
            value[1] += record[2]
            value[2] = max(value[2], record[3])
        if table.bytes > memory and len(table.contents) > 1:
            files = [tempfile.TemporaryFile() for _ in range(FANOUT)]
            for content, value in zip(table.contents, table.values):
                spill((content, *value))
            table = ContentTable()
    if not files:
        yield from zip(table.contents, table.values)
        return
    for file in files:
        file.seek(0)
        yield from grace(_records(file), memory, level + 1)
        file.close()


def _records(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _merged(memory: int):
    def run(batches):
        def records():
            for batch in batches:
                for content, part, n, top, top_row in zip(*batch.columns):
                    top = top.as_py()
                    yield content.as_py(), [part.as_py()], n.as_py(), (top is not None, top or 0, top_row.as_py())

        for _, (parts, n, top) in grace(records(), memory):
            for part in parts:
                yield {"part": part, "keep_id": top[1] if top[0] else None, "keep_row": top[2], "group_size": n}

    return run


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept and the SHA-256 of the normalised text."""
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    parts = stored(over_batches(source, _partial(memory), PARTS, rows=512))
    contents = parts.filter("content IS NOT NULL").repartition("hash").select("content", "part", "n", "top", "top_row")
    groups = over_batches(contents, _merged(memory), "part bigint, keep_id bigint, keep_row bigint, group_size bigint")
    rows = parts.filter("row IS NOT NULL").select("row", "part", "doc", "digest")
    return rows.join(groups, "part").select(
        F.col("doc").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
