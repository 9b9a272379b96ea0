"""CSV records whose quoted fields hold line breaks, read in parallel from the middle of files.

Whether a line break ends a record depends on all quotes before it. A line is a function of one bit (is a quoted field open?), and
so is a block of lines; such functions can be chained. The first pass gives the function of every block (a file split), one row each. They are chained in
order, which tells for every block how it begins; that is metadata, as many rows as there are splits. In the second pass each block cuts
its lines into records. A record that lies in several blocks comes in fragments, at most two for a block, which are put together
afterwards.

A quote opens a field at the field's beginning only; inside, two quotes are one; what follows a closing quote up to the comma belongs to
the field. Lines end with a line feed; a carriage return before it belongs to the line end, inside quotes to the field. Bytes that are no UTF-8 become the
replacement character. Blank lines between records are no records. A field that is open for more than ``LONGEST`` code points is
an error, for then a quote is missing and the rest of the file would be one record.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 1 << 24
RECORD, TAIL, HEAD, FIRST = 0, 1, 2, 3  # complete; begun here; begun earlier; complete and the first of its file
CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
FRAGMENTS = "path string, start bigint, kind tinyint, closed boolean, text string"


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one or not."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        closed = CLOSING.match(line, at)
        if not closed:
            return True
        inside = False
        at = line.find(",", closed.end()) + 1
        if not at:
            return False


def lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """(path, start, value): lines of the files; those of a split come in order."""
    text = spark.read.options(lineSep="\n", **options).text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.make_valid_utf8("value").alias("value"))


def _grouped(batches):
    """(path, start, lines) of consecutive rows of one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start, value = batch.columns
        edges = [0]
        if batch.num_rows > 1:
            differ = pc.or_(pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)), pc.not_equal(start.slice(1), start.slice(0, len(start) - 1)))
            edges += [i + 1 for i, d in enumerate(differ.to_pylist()) if d]
        for a, b in zip(edges, [*edges[1:], batch.num_rows]):
            yield path[a].as_py(), start[a].as_py(), value.slice(a, b - a)


def _functions(batches):
    """A row for every split: how it ends if it begins outside or inside a quoted field, and whether any record goes on behind a line."""
    found: dict = {}
    for path, start, value in _grouped(batches):
        state = found.setdefault((path, start), [False, True, False])
        quoted = pc.indices_nonzero(pc.match_substring(value, '"')).to_pylist()
        for i in quoted:
            line = value[i].as_py()
            state[0], state[1] = open_after(line, state[0]), open_after(line, state[1])
            state[2] |= state[0]
    rows = [{"path": p, "start": s, "outside": a, "inside": b, "broken": c} for (p, s), (a, b, c) in found.items()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("broken", pa.bool_())]))


def blocks(spark: SparkSession, path: str | list[str], **options: str) -> tuple[dict[tuple[str, int], bool], bool]:
    """How each split begins (inside a quoted field or not), and whether any record has a line break in it."""
    found = lines(spark, path, **options).mapInArrow(_functions, "path string, start bigint, outside boolean, inside boolean, broken boolean").collect()
    begins: dict[tuple[str, int], bool] = {}
    last, state = None, False
    for r in sorted(found, key=lambda r: (r["path"], r["start"])):
        state = False if r["path"] != last else state
        begins[r["path"], r["start"]] = state
        last, state = r["path"], r["inside"] if state else r["outside"]
    return begins, any(r["broken"] for r in found)


def _cut(begins):
    """Records and fragments from the lines of whole splits."""

    def run(batches):
        rows: list = []
        key, inside, held, size, first, led = None, False, [], 0, False, False

        def put(kind, closed, text):
            rows.append({"path": key[0], "start": key[1], "kind": kind, "closed": closed, "text": text})

        def end():
            if held:
                put(HEAD if led else TAIL, False, "\n".join(held))

        def table():
            return pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.int8()), ("closed", pa.bool_()), ("text", pa.string())]))

        for path, start, value in _grouped(batches):
            if (path, start) != key:
                end()
                key, held, size = (path, start), [], 0
                inside = led = begins[key]
                first = start == 0
            for line in value.to_pylist():
                inside = open_after(line, inside)
                if inside or held or led:
                    held.append(line)
                    size += len(line)
                    if size > LONGEST:
                        raise ValueError(f"a quoted field of {path} is open for more than {LONGEST} characters: a quote is missing")
                    if inside:
                        continue
                    text = "\n".join(held)
                    held, size = [], 0
                else:
                    text = line
                text = text.removesuffix("\r")
                if led:
                    put(HEAD, True, text)
                elif text.strip():
                    put(FIRST if first else RECORD, True, text)
                    first = False
                led = False
                if len(rows) >= 4096:
                    yield table()
                    rows.clear()
        end()
        if rows:
            yield table()

    return run


def read_records(spark: SparkSession, path: str | list[str], begins: dict[tuple[str, int], bool], **options: str) -> DataFrame:
    """(path, first, record): the records of the files; ``first``: it is the first of its file."""
    sent = spark.sparkContext.broadcast(begins)

    def cut(batches):
        yield from _cut(sent.value)(batches)

    found = lines(spark, path, **options).mapInArrow(cut, FRAGMENTS)
    whole = found.filter(F.col("kind").isin(RECORD, FIRST)).select("path", (F.col("kind") == FIRST).alias("first"), F.col("text").alias("record"))
    # At most two fragments for a split: those behind a beginning belong to it.
    order = F.expr("count_if(kind = 1) OVER (PARTITION BY path ORDER BY start, kind DESC)")
    parts = found.filter(F.col("kind").isin(HEAD, TAIL)).withColumn("number", order)
    joined = parts.groupBy("path", "number").agg(F.sort_array(F.collect_list(F.struct("start", F.col("kind") == TAIL, "text"))).alias("texts"), F.min("start").alias("start"))
    record = F.regexp_replace(F.array_join(F.transform("texts", lambda t: t["text"]), "\n"), "\r$", "")
    # The first record of a file may itself be in fragments: then its beginning is the only fragment of the first split's first line.
    begun = found.filter(F.col("kind") == FIRST).select("path").distinct().withColumn("has_first", F.lit(True))
    joined = joined.join(begun, "path", "left")
    first = F.col("has_first").isNull() & (F.col("number") == 1) & (F.col("start") == 0)
    return whole.unionByName(joined.select("path", first.alias("first"), record.alias("record")))
