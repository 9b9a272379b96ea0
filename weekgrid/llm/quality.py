"""Compression classifier: how much better does a text compress beside good text than beside bad?

Two raw zstandard dictionaries are laid out from labelled texts, one good, one bad; lines that several of those texts share are
left out, for they tell where a text was copied from, not how good it is. A text is cut into blocks (all of it, so that
length doesn't dilute the dictionaries' effect), every block is compressed with either dictionary, and the difference of
the compressed sizes, divided by the raw size, is the signal: over the whole text, and of its worst block. A logistic
curve calibrates it to a probability on labelled rows that the dictionaries have not seen, weighted to the labels' own
base rate. The curve also sees the compressed size without a dictionary, which tells repetition from prose, and how
short a text is, for short texts say less. Signals are clipped to the range of the rows the curve was fitted on.

The model is fitted on a bounded sample of labelled rows: ``per_label`` rows of each label with the least hash of the id,
half of them for the dictionaries and half for the curve. Scoring reads every whole text.

Defined cases: a null or empty text scores the base rate of the labels; labelled ids without a document and labels that
are null are left out; without labelled rows of both kinds every text scores the base rate (0.5 if there are none).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.common import logistic

PER_LABEL = 2000  # labelled rows of each label that the model is fitted on, at most
DICTIONARY = 96 << 10  # bytes of each dictionary
SHARE = 2 << 10  # bytes that a row gives to a dictionary, at most
FITTED = 64 << 10  # bytes of a row that the sample carries to the driver, at most
BLOCK = 1 << 10  # bytes compressed together
LEVEL = 5  # with a dictionary
LEVEL_ALONE = 1
FRAME = 9  # bytes of a compressed frame without content, about
EDGE = 0.005  # share of the fitted rows beyond which signals are clipped, on either side


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    least: tuple[float, ...]
    most: tuple[float, ...]
    base: float


class Sizes:
    """Compressed sizes beside either dictionary and alone, as signals of a text."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(content: bytes, level: int):
            plain = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if not content:
                return zstandard.ZstdCompressor(**plain)
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            return zstandard.ZstdCompressor(dict_data=data, **plain)

        self.by = [compressor(good, LEVEL).compress, compressor(bad, LEVEL).compress, compressor(b"", LEVEL_ALONE).compress]

    def features(self, data: bytes) -> list[float]:
        edges = list(range(0, len(data), BLOCK))
        if len(edges) > 1 and len(data) - edges[-1] < BLOCK // 2:
            edges.pop()  # a short rest goes with the block before it
        blocks = [data[a:b] for a, b in zip(edges, [*edges[1:], len(data)])]
        gains, alone = [], -FRAME
        good, bad, plain = self.by
        for block in blocks:
            gains.append(len(bad(block)) - len(good(block)))
            alone += len(plain(block))
        gain, alone, seen = sum(gains) / len(data), alone / len(data), min(len(data), BLOCK)
        worst = min(g / len(b) for g, b in zip(gains, blocks))
        return [1.0, gain, worst, alone, alone * alone, 1 / seen, gain * math.sqrt(seen)]


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_label: int, seed: int) -> DataFrame:
    """(label, text) of at most ``per_label`` labelled rows of each label, by the least hash of the id."""
    ids = labels.select(F.col(id_col).alias("sample_id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)")
    chosen = None
    for label in (0, 1):
        # A top-k: every task passes on its own k at most.
        own = ids.filter(F.col("label") == label).orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id").limit(per_label)
        chosen = own if chosen is None else chosen.unionByName(own)
    # The chosen rows are bounded by the parameter, so they can be sent to every scan task.
    texts = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("text_id") == F.col("sample_id")).select("label", "text_id", F.xxhash64("text_id", F.lit(seed + 1)).alias("draw"), "text")


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    per_label: int = PER_LABEL, seed: int = 7,
) -> Model:
    """Dictionaries from one half of the sample, the curve from the other."""
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, per_label, seed)
    data = F.encode(F.substring("text", 1, FITTED), "utf-8").alias("data")
    rows = [(r["label"], bytes(r["data"])) for r in sample.select("label", "draw", "text_id", data).orderBy("draw", "text_id").collect() if r["data"]]
    by = {label: [d for own, d in rows if own == label] for label in (0, 1)}
    totals = {r["label"]: r["count"] for r in labels.groupBy(F.col(label_col).cast("int").alias("label")).count().collect()}
    totals = {label: totals.get(label, 0) for label in (0, 1)}
    base = totals[1] / sum(totals.values()) if any(totals.values()) else 0.5
    if not by[0] or not by[1]:
        return Model(b"", b"", (), (), (), (), (), base)
    holders = Counter(line for _, d in rows for line in set(d.split(b"\n")))
    dictionaries, rest = [], []
    for label in (1, 0):
        own = by[label]
        half = max(1, len(own) // 2)
        # Shares are dealt so that the rows at hand fill the dictionary.
        share = max(SHARE, DICTIONARY // half)
        alone = (b"\n".join(line for line in d.split(b"\n") if holders[line] == 1)[:share] for d in own[:half])
        dictionaries.append(b"\n".join(alone)[-DICTIONARY:])
        rest += [(label, d) for d in (own[half:] or own)]
    sizes = Sizes(*dictionaries)
    x = np.array([sizes.features(d) for _, d in rest])
    y = np.array([float(label) for label, _ in rest])
    least, most = np.quantile(x, EDGE, axis=0), np.quantile(x, 1 - EDGE, axis=0)
    x = np.clip(x, least, most)
    center, scale = x.mean(axis=0), x.std(axis=0)
    center[0], scale = 0.0, np.where(scale > 0, scale, 1.0)
    weights = np.where(y == 1, base / max(y.sum(), 1), (1 - base) / max((1 - y).sum(), 1))
    fitted = logistic((x - center) / scale, y, weights)
    return Model(*dictionaries, *(tuple(v.tolist()) for v in (fitted, center, scale, least, most)), base)


_SIZES: dict[int, Sizes] = {}  # of the last model that this worker has seen


def score_text(model: Model, text: str | None) -> float:
    if not text or not model.weights:
        return model.base
    key = hash((model.good, model.bad))
    if key not in _SIZES:
        _SIZES.clear()
        _SIZES[key] = Sizes(model.good, model.bad)
    signals = _SIZES[key].features(text.encode())
    z = 0.0
    for w, v, center, scale, least, most in zip(model.weights, signals, model.center, model.scale, model.least, model.most):
        z += w * (min(max(v, least), most) - center) / scale
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score_column(spark, model: Model, text: Column) -> Column:
    """The probability that a text is good. The model is a few hundred kilobytes, whatever the data."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([score_text(sent.value, t.as_py()) for t in texts], pa.float64())

    return score(text.cast("string"))
