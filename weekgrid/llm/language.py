"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built. A text is parsed greedily into phrases: each is the longest match
of what follows anywhere in the language's text, and ends where the automaton has no transition. Few long phrases mean
that the text is made like the language's. A phrase costs the logarithm of the labelled text's length in bits (its place), so the number
of phrases times that logarithm, divided by the text's length, estimates the cross entropy; the least one wins.

The automata of all languages are one table of transitions: a missing one holds the state in which the next phrase has begun, marked
by its sign, so a step is one look-up for many blocks of text and all languages at once. A text is cut into blocks, all of
it; a phrase ends where its block ends. Letters are lower-cased, everything else is a blank, and blanks in a row are one. Letters beyond the
``ALPHABET`` most frequent ones share classes.

The score is the posterior of the winner where each language codes the text in that many bits: ties and very short texts score
low, long plain ones near 1.

The model is fitted on a bounded sample: for each language up to ``ROWS`` distinct labelled texts with the least hashes, a piece of at most ``PIECE``
code points of each, ``CHARS`` in all (``TOTAL`` over all languages, the ``LANGUAGES`` with most rows). Scoring reads whole texts.

Defined cases: a null text, one without a letter, and every text if nothing was learned, is ``und`` with score 0; ties go to
the first name; labelled rows with a null language, null text or null id are not learned from.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = 256  # texts of a language
PIECE = 512  # code points of a text that is learned from
CHARS = 24 << 10  # code points of a language
TOTAL = 1 << 20  # of all languages
LANGUAGES = 256
ALPHABET = 96  # letters with a class of their own
SHARED = 31  # classes of all other letters
BLOCK = 512  # code points parsed together
LANES = 4096  # blocks parsed side by side
SUM = 8 << 20  # code points that a task works on at once
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    key: str
    names: tuple[str, ...]
    bits: np.ndarray  # of a phrase, for every language
    step: np.ndarray  # (state's offset + class of the next letter) -> offset of the next state; negative: -1 - offset, a phrase has ended
    start: np.ndarray  # offset of the first state of every language
    letters: dict[int, int]  # class of a code point; 0 is blank


def sample(docs: DataFrame, lang_col: str, id_col: str, text_col: str, rows: int, seed: int) -> dict[str, list[str]]:
    """Pieces of at most ``rows`` distinct texts of each language."""
    text = F.col(text_col).cast("string")
    given = docs.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text, F.lit(seed)).alias("draw"))
    given = given.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & docs[id_col].isNotNull() & text.rlike(r"\p{L}"))
    # At most LANGUAGES rows reach the driver and are sent back.
    counts = given.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return {}
    # Of each language about eight times the rows that are needed pass on, so that no window sees a large language whole.
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["lang"], min(1.0, 8 * rows / r["count"])) for r in counts], "lang string, share double")
    few = given.join(F.broadcast(shares), "lang").filter((F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)) < F.col("share"))
    begin = F.pmod(F.shiftright("draw", 30), F.greatest(F.length("text") - PIECE + 1, F.lit(1))) + 1
    pieces = few.select("lang", "draw", F.col("text").substr(begin.cast("int"), F.lit(PIECE)).alias("piece"))
    one = pieces.groupBy("lang", "draw").agg(F.min("piece").alias("piece"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
    found: dict[str, list[str]] = {}
    for r in ranked.filter(F.col("rank") <= rows).orderBy("lang", "rank").select("lang", "piece").collect():
        found.setdefault(r["lang"], []).append(r["piece"])
    return found


def lower_letter(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


class Automaton:
    """The suffix automaton of a sequence of classes: dictionaries of transitions, built online."""

    def __init__(self, classes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in classes:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at != -1 and c not in self.next[at]:
                self.next[at][c] = new
                at = link[at]
            if at != -1:
                met = self.next[at][c]
                if length[met] == length[at] + 1:
                    link[new] = met
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[met]))
                    length.append(length[at] + 1)
                    link.append(link[met])
                    link[met] = link[new] = twin
                    while at != -1 and self.next[at].get(c) == met:
                        self.next[at][c] = twin
                        at = link[at]
            last = new


def build(texts: dict[str, list[str]], chars: int = CHARS, total: int = TOTAL) -> Model:
    each = max(256, min(chars, total // max(1, len(texts))))
    seen = Counter(ord(lower_letter(c)) for own in texts.values() for t in own for c in t if c.isalpha())
    letters = {point: i + 1 for i, (point, _) in enumerate(sorted(seen.items(), key=lambda p: (-p[1], p[0]))[:ALPHABET])}
    width = ALPHABET + 1 + SHARED
    names, bits, steps, starts, offset = [], [], [], [], 0
    for name in sorted(texts):
        classes: list[int] = []
        for t in texts[name]:
            for c in f"{t} ":
                k = _class(letters, c)
                if k or (classes and classes[-1]):
                    classes.append(k)
        found = Automaton(classes[:each]).next
        step = np.zeros((len(found), width), np.int32)
        has = np.zeros((len(found), width), bool)
        for state, onward in enumerate(found):
            for c, to in onward.items():
                step[state, c] = to * width + offset
                has[state, c] = True
        # Where nothing goes on, the letter begins the next phrase; one that the language lacks stands before that phrase's match.
        begin = np.where(has[0], step[0], offset)
        step = np.where(has, step, -1 - begin)
        names.append(name)
        bits.append(np.log2(max(2, min(len(classes), each))))
        steps.append(step.ravel())
        starts.append(offset)
        offset += step.size
    table = np.concatenate(steps) if steps else np.empty(0, np.int32)
    return Model(uuid.uuid4().hex, tuple(names), np.array(bits), table, np.array(starts, np.int32), letters)


def _class(letters: dict[int, int], c: str) -> int:
    if not c.isalpha():
        return 0
    low = ord(lower_letter(c))
    return letters.get(low) or ALPHABET + 1 + low % SHARED


def fit(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, chars: int = CHARS,
    seed: int = 11,
) -> Model:
    return build(sample(docs, lang_col, id_col, text_col, rows, seed), chars)


class Parser:
    """Counts of phrases for many texts at once."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.zeros(0x110000, np.uint8)
        for point in range(0x110000):
            self.table[point] = _class(model.letters, chr(point))

    def squeezed(self, text: str) -> np.ndarray:
        """Classes of a text, blanks in a row as one, none at its edges."""
        # Lone surrogates can't be in Spark's strings.
        own = self.table[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        own = own[(own > 0) | np.append([False], own > 0)[: len(own)]]
        return own[: len(own) - int((own[-1:] == 0).sum())]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of every text (rows) by every language (columns)."""
        model = self.model
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        joined = np.concatenate([*texts, np.empty(0, np.uint8)])
        first = np.repeat(np.cumsum(sizes) - sizes, blocks) + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        length = np.minimum(BLOCK, np.repeat(np.cumsum(sizes), blocks) - first)
        counts = np.zeros((len(texts), len(model.names)), np.int64)
        # Long blocks first, so that those still going on are always the first ones.
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), LANES):
            lanes = order[i : i + LANES]
            size, at = length[lanes], first[lanes]
            state = np.tile(model.start, (len(lanes), 1))
            ended = np.ones((len(lanes), len(model.names)), np.int32)  # the phrase that the block's end cuts
            active = np.searchsorted(-size, -np.arange(size[0]), "left") if len(size) else []
            for t, k in enumerate(active):
                to = model.step[state[:k] + joined[at[:k] + t, None]]
                mark = to >> 31
                ended[:k] -= mark
                np.bitwise_xor(to, mark, out=state[:k])
            np.add.at(counts, owner[lanes], ended)
        return counts

    def languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.model.names:
            return out
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end] or "") <= SUM):
                size += len(texts[end] or "")
                end += 1
            known = [(i, own) for i in range(begin, end) if len(own := self.squeezed(texts[i] or ""))]
            cost = self.phrases([own for _, own in known]) * self.model.bits
            for (i, _), bits in zip(known, cost):
                best = int(np.argmin(bits))
                out[i] = (self.model.names[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -60)).sum()))
            begin = end
        return out


_PARSER: dict[str, Parser] = {}  # of the last model that this worker has seen


def predict_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(lang_pred, score). The model's size is bounded by the parameters, whatever the data."""
    sent = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        model = sent.value
        if model.key not in _PARSER:
            _PARSER.clear()
            _PARSER[model.key] = Parser(model)
        found = _PARSER[model.key].languages(texts.to_pylist())
        return pa.array([{"lang_pred": name, "score": score} for name, score in found], kind)

    return predict(text.cast("string"))
