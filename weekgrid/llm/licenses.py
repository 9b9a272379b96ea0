"""License scan: exact phrases, and short notices found with a bounded number of edits.

Texts are lower-cased (A-Z) and reduced to words joined by single spaces. A notice of k allowed edits is cut into k + 1
seeds; k edits cannot touch all of them, so one seed stands unchanged in every occurrence (pigeonhole). One
Aho-Corasick pass over all seeds locates candidates, and the regex library's bounded-error matching verifies the window around each,
which the notice's length bounds, and reports the span and its edits.

Defined cases: a null or empty text has no words, no spans and score 0. Overlapping finds of different notices
are all reported; of one notice those that don't overlap, fewer edits first, then the leftmost.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose exact places are counted, with their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Short notices that are searched with edits, with their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the gnu general public license", "gpl"),
    ("this is free software you can redistribute it and or modify it", "gpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("copyright all rights reserved", "reserved"),
)

CHARS_PER_EDIT = 10  # one edit is allowed for so many characters of a notice
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@lru_cache
def matcher(notices: tuple, chars_per_edit: int):
    """The automaton over all seeds; per seed the notice and its offset there; per notice its edits and pattern."""
    automaton, uses, patterns = ahocorasick.Automaton(), {}, []
    for n, (notice, _) in enumerate(notices):
        edits = max(1, len(notice) // chars_per_edit)
        cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
        for a, b in zip(cuts, cuts[1:]):
            uses.setdefault(notice[a:b], []).append((n, a))
        patterns.append((edits, regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")))
    for seed, places in uses.items():
        automaton.add_word(seed, (len(seed), tuple(places)))
    automaton.make_automaton()
    return automaton, patterns


def fuzzy(joined: str, notices: tuple = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> Iterator[tuple[int, int, int, int]]:
    """(notice, start, end, edits) in ``joined``, a text of lower-case words between single spaces."""
    automaton, patterns = matcher(notices, chars_per_edit)
    seen: dict[int, list] = {}
    for last, (size, places) in automaton.iter(joined):
        for n, offset in places:
            seen.setdefault(n, []).append(last + 1 - size - offset)
    for n, begins in seen.items():
        edits, pattern = patterns[n]
        length = len(notices[n][0])
        # Around every place a seed tells of, the best match: what a search reads is bounded by the notice, not by the text.
        found = set()
        for begin in sorted(set(begins)):
            if m := pattern.search(joined, max(0, begin - edits), min(len(joined), begin + length + edits)):
                found.add((sum(m.fuzzy_counts), m.start(), m.end()))
        taken: list[tuple[int, int]] = []
        for cost, a, b in sorted(found):
            at = bisect_right(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
                yield n, a, b, cost


def scan(text: str | None, phrases: tuple = PHRASES, notices: tuple = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> dict:
    """Word count, exact places (in words), and spans (label, exact, start, end in code points of the text, score)."""
    text = text or ""
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    joined = " ".join(words := WORD.findall(low))
    framed = f" {joined} "
    begins = [0]  # of the words in the joined text
    for w in words:
        begins.append(begins[-1] + len(w) + 1)
    exact, found = [], []
    for phrase, label in phrases:
        at = framed.find(f" {phrase} ")
        while at >= 0:
            exact.append((bisect_left(begins, at), len(phrase.split()), label))
            at = framed.find(f" {phrase} ", at + 1)
    for n, a, b, edits in fuzzy(joined, notices, chars_per_edit):
        found.append((notices[n][1], a, b, 1 - edits / len(notices[n][0])))
    spans = []
    if exact or found:
        places = [m.span() for m in WORD.finditer(low)]

        def place(i: int) -> int:
            """Where a position of the joined text lies in the text itself."""
            w = min(max(bisect_right(begins, i) - 1, 0), len(words) - 1)
            return min(places[w][0] + i - begins[w], places[w][1])

        spans = [(label, True, places[w][0], places[w + n - 1][1], 1.0) for w, n, label in exact]
        spans += [(label, False, place(a), place(b - 1) + 1, score) for label, a, b, score in found]
    return {
        "n_words": len(words), "places": sorted(w for w, _, _ in exact), "base": sorted({x[2] for x in exact}),
        "spans": sorted(spans, key=lambda s: (s[2], s[3], s[0])),
    }


FOUND = pa.struct([
    ("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("base_labels", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
])
FOUND_DDL = (
    "struct<n_words:bigint, places:array<bigint>, base_labels:array<string>,"
    " spans:array<struct<label:string, exact:boolean, start:bigint, end:bigint, score:double>>>"
)


def license_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES,
    chars_per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """doc_id, n_words, places (words), base_labels, and spans (label, exact, start, end, score) per row of ``docs``."""

    @F.arrow_udf(FOUND_DDL)
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            x = scan(text.as_py(), phrases, notices, chars_per_edit)
            spans = [dict(zip(("label", "exact", "start", "end", "score"), s)) for s in x["spans"]]
            out.append({"n_words": x["n_words"], "places": x["places"], "base_labels": x["base"], "spans": spans})
        return pa.array(out, FOUND)

    return docs.select(F.col(id_col).alias("doc_id"), found(F.col(text_col).cast("string")).alias("found")).select("doc_id", "found.*")
