"""Line deduplication over levelled sorted runs of line hashes.

The first document that holds a line owns it. Documents come in batches of ascending ids; a batch reduces its lines to
(hash, least document), anti-joins the runs so far and keeps what is left as a run of level 0. When a level is
full its runs are merged into one of the next level. A run is a table bucketed and sorted by hash, so the anti-joins are
merge joins that shuffle the batch only. Together the runs say which document owns which line; owned lines are
gathered per document, so a line that stands in a third of all documents is one row there and no key is hot.

Hashes are 128-bit MD5 of the key. Defined cases: a null text is one empty line; a document with a null id keeps all its
lines and owns none; rows that share an id are one document; lines whose key is short always stay.
"""

from __future__ import annotations

import uuid
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.common import filled, lower_ascii, unused
from weekgrid.session import shared_dir

BLANK = " \t\n\u000b\u000c\r"
MIN_CHARS = 10  # code points of a key that takes part
BATCHES = 4
FANOUT = 2  # runs of a level before they are merged


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


class Runs:
    """The levels: lists of bucketed tables with columns (hash, doc)."""

    def __init__(self, spark, folder: str, fanout: int):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "hash").sortWithinPartitions("hash").write.option("path", f"{self.folder}/{name}")
         .bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(name))
        return self.spark.table(name)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Append what no run holds yet; merge full levels."""
        for run in self.all():
            batch = batch.join(run.select("hash").hint("merge"), "hash", "left_anti")
        carried, at = self.write(batch), 0
        while True:
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(carried)
            if len(self.levels[at]) < self.fanout:
                return
            merged = self.levels[at][0]
            for run in self.levels[at][1:]:
                merged = merged.unionByName(run)
            self.levels[at], carried, at = [], self.write(merged), at + 1


def owned_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """(hash, doc): the least document of every line that takes part, hash being MD5 of the line's key."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    cuts = [i / batches for i in range(1, batches)]
    limits = docs.select(F.col(id_col).cast("double").alias("d")).approxQuantile("d", cuts, 0.001) if cuts else []
    batch = F.lit(0)
    for limit in sorted(set(limits)):
        batch = batch + F.when(F.col("doc") > limit, 1).otherwise(0)
    lines = (
        docs.select(F.col(id_col).cast("long").alias("doc"), filled(text_col).alias("text"))
        .filter("doc IS NOT NULL")
        .select("doc", F.explode(F.split("text", "\n")).alias("line"))
        .select("doc", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc", F.unhex(F.md5("key")).alias("hash"), batch.cast("int").alias("batch"))
    )
    lines.write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema("doc bigint, hash binary, batch int").parquet(f"{folder}/lines")
    runs = Runs(spark, folder, fanout)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i).groupBy("hash").agg(F.min("doc").alias("doc")))
    owned = runs.all()
    result = owned[0]
    for run in owned[1:]:
        result = result.unionByName(run)
    return result.select("hash", "doc")


def _kept(min_chars: int):
    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    blank = BLANK.encode()

    @F.arrow_udf("struct<text:string, n_lines:bigint, n_dropped:bigint>")
    def kept(texts: pa.Array, known: pa.Array, owned: pa.Array) -> pa.Array:
        out = []
        for text, has_id, own in zip(texts, known, owned):
            lines = (text.as_py() or "").split("\n")
            if has_id.as_py():
                own = set(own.as_py() or ())
                stay = []
                for line in lines:
                    key = line.encode().strip(blank).lower()
                    # Bytes bound code points from above, so most lines need no second count.
                    if len(key) < min_chars or len(key.decode()) < min_chars or md5(key, usedforsecurity=False).digest() in own:
                        stay.append(line)
            else:
                stay = lines
            out.append({"text": "\n".join(stay), "n_lines": len(lines), "n_dropped": len(lines) - len(stay)})
        return pa.array(out, kind)

    return kept


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """All columns of ``docs`` with the remaining lines as text, and a struct column ``line_dedup`` (n_lines, n_dropped).

    If ``docs`` has a column of that name, the new one gets underscores appended; it is always the last.
    """
    key, own, out = unused(docs, "line_doc"), unused(docs, "line_hashes"), unused(docs, "line_dedup")
    owned = owned_lines(docs, id_col, text_col, batches, fanout, min_chars)
    owned = owned.groupBy(F.col("doc").alias(key)).agg(F.collect_list("hash").alias(own))
    joined = docs.join(owned, F.col(id_col).cast("long") == F.col(key), "left")
    joined = joined.withColumn(out, _kept(min_chars)(F.col(text_col).cast("string"), F.col(id_col).isNotNull(), F.col(own)))
    columns = [F.col(out)["text"].alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.struct(F.col(out)["n_lines"].alias("n_lines"), F.col(out)["n_dropped"].alias("n_dropped")).alias(out))
