"""Single very long texts: nothing fails, and twice the text takes about twice the time."""

import re
import time

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weekgrid.llm import chat, licenses, packing, pii, queries

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("text", [" " * 3_000_000 + "x", "\n" * 1_000_000 + " x", "x<|endoftext|>" + " " * 1_000_000 + "it's", "a" * 3_000_000, "!" * 3_000_000], ids=["blanks", "lines", "added", "letters", "marks"])
def test_long_runs_are_encoded(text):
    ids = packing.encode(RANKS, queries.PATTERN, text)
    assert packing._tokenizer(RANKS, queries.PATTERN).decode(ids) == text


def test_the_other_split_gives_the_same_ids(monkeypatch):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["it's  a\n\n test<|endoftext|>  of 12 ways\t", " ", "", "é世  !!x"]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]

    class Failing:
        def __init__(self, inner):
            self._encode_single_piece = inner._encode_single_piece

        def encode(self, *_, **__):
            raise ValueError("stack")

    inner = packing._tokenizer(RANKS, queries.PATTERN)
    monkeypatch.setattr(packing, "_tokenizer", lambda *_: Failing(inner))
    assert [packing.encode(RANKS, queries.PATTERN, t) for t in texts] == want


def seconds(fn, *args):
    return min(_timed(fn, *args) for _ in range(3))


def _timed(fn, *args):
    begin = time.perf_counter()
    fn(*args)
    return time.perf_counter() - begin


@pytest.mark.parametrize("fn, unit, times", [
    (licenses.scan, "cc by ", 20_000), (licenses.scan, "releazed under the mit license ", 1_000),
    (lambda t: chat.MARK.findall(t), "\\", 200_000), (lambda t: list(chat.parse(chat.render("user", t))), "\\", 20_000),
], ids=["exact", "fuzzy", "marks", "turn"])
def test_time_is_linear(fn, unit, times):
    fn(unit * 10)
    assert seconds(fn, unit * (2 * times)) < 2.7 * seconds(fn, unit * times) + 0.02


def test_a_weaker_notice_before_a_better_one_is_found():
    exact, near = "released under the mit license", "releazed under the mit license"
    for text in (f"{near} {exact}", f"{exact} {near}", f"{near} {near} {exact} {near}"):
        found = [(text[s[2] : s[3]], s[4] == 1) for s in licenses.scan(text)["spans"] if not s[1]]
        wanted = [(p, p == exact) for p in text.replace(" rel", "|rel").split("|")]
        assert [f for f in found if f in wanted] == wanted


def test_what_stands_beside_a_span(spark):
    """Places and context of matches against slices of the text; matches side by side and characters outside the BMP included."""
    rng = np.random.default_rng(2)
    parts = ["1.2.3.4", "1.2.3.4", "+", "\U0001f600", "é", " ", "a" * 45, "\n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 90))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", pii.places(F.col("text"), r"[0-9](?:\.[0-9]){3}", F.lit(True)).alias("found")).collect():
        t = r["text"]
        wanted = [(m.start(), m.end(), m.group(), t[max(0, m.start() - pii.CONTEXT) : m.start()], t[m.end() : m.end() + 1]) for m in re.finditer(r"[0-9](?:\.[0-9]){3}", t)]
        assert list(map(tuple, r["found"])) == wanted


def test_many_addresses_in_one_text(spark):
    """All are masked, and twice as many take about twice the time."""
    weights = dict.fromkeys(("constant", *pii.KINDS, *pii.VOTES), -1.0)

    def masked(n):
        df = spark.createDataFrame([("".join(f"mail user{i}@host{i % 7}.org now " for i in range(n)),)], "text string")
        assert df.select(pii.masked(F.col("text"), pii.spans_column(F.col("text"), weights))).first()[0] == "mail [EMAIL] now " * n

    masked(10)
    assert min(_timed(masked, 16_000) for _ in range(2)) < 2.7 * min(_timed(masked, 8_000) for _ in range(2)) + 1
