"""Spelling variants: words within one edit of each other, by sorted permuterm rotations.

A word is marked with a terminator at its end. Words that differ in one replaced code point have a rotation that is equal but for
its last code point; a word and the same word with one code point inserted have rotations of which one is the other and one
code point more. So every word stands in the table with all of its complete rotations, and with every rotation that ends in a letter cut
by that letter, the edited one. After sorting by that prefix, the rows of one prefix are a group of near words: those with
another letter at the edited place, and at most one without a letter there.

A group holds no word twice and no two words with one letter at the edited place, so its size is bounded by the alphabet, however large
the table is. Pairs are not emitted: a row of a group needs the number of the others and the most frequent of them, which
are the group's first two. Replacements meet in exactly one group. Deleting any letter of a run of equal letters
gives the same word, so insertions count for the run's first letter only; then they meet in exactly one group as well.

Prefixes longer than ``PLAIN`` are replaced by polynomial hashes of their two sides, so that a long word costs its length, not the
square of it.

Words are numbered in code-point order, and rows carry the number. Words are reduced to counts inside the scan tasks, so
a very frequent word is one row of each task.

Defined cases: a null text has no words; a null id counts as the empty string in the checksum; rows that share an id are counted
one by one; an empty table has no words.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.session import stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MODULUS = 97  # of the checksums that mark a run for deletion
MIN_CHARS = 5  # code points
MIN_COUNT = 3
RATIO = 2  # a form is so many times as frequent at least
END = "$"  # no letter
PLAIN = 64  # code points of a prefix that is sorted as it is
HELD_WORDS, HELD_CHARS = 1 << 19, 1 << 24  # counts that a scan task holds before it passes them on
CHUNK = 1 << 15  # rotations that travel together

WHOLE, FIRST, AGAIN = 0, 1, 2  # a complete rotation; cut by a letter that begins a run of equal ones; cut by another letter
PRIME, BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15


def document_words(doc_id, text: str | None, modulus: int = MODULUS) -> Counter:
    """The words of a text with their numbers, after the deletions."""
    found: Counter = Counter()
    if text:
        seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
        # ``bytes.lower`` changes A-Z only.
        for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
            h = crc32(run.encode(), seed)
            if h % modulus == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += n
    return found


def _counted(modulus: int, min_chars: int):
    def run(batches):
        counts: Counter = Counter()
        chars = 0

        def table():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for word, n in document_words(doc_id.as_py(), text.as_py(), modulus).items():
                    if len(word) >= min_chars:
                        if word not in counts:
                            chars += len(word)
                        counts[word] += n
                if len(counts) >= HELD_WORDS or chars >= HELD_CHARS:
                    yield table()
                    counts, chars = Counter(), 0
        if counts:
            yield table()

    return run


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
    modulus: int = MODULUS,
) -> DataFrame:
    """(id, word, n): the words that are long and frequent enough, ids in code-point order."""
    given = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = given.mapInArrow(_counted(modulus, min_chars), "word string, n bigint")
    frequent = stored(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))
    return stored(frequent.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def rotations(word: str) -> list[tuple[str, int]]:
    """(prefix, kind) of every rotation: complete ones, then those cut by a letter."""
    size = len(word)
    cut = [FIRST if i == 0 or word[i] != word[i - 1] else AGAIN for i in range(size)]
    turned = (word + END) * 2
    # A complete rotation is one longer than a cut one, and each length has its own way of writing.
    if size + 1 > PLAIN:
        left, power = [0], [1]
        for c in word:
            left.append((left[-1] * BASE + ord(c)) % PRIME)
            power.append(power[-1] * BASE % PRIME)

        def hashed(i: int, j: int) -> str:
            right = (left[size] - left[j] * power[size - j]) % PRIME
            return f"{END}{i}:{size - j}:{left[i]:x}:{right:x}"

        whole = [hashed(i, i) for i in range(size + 1)]
    else:
        whole = [turned[i : i + size + 1] for i in range(size + 1)]
    part = [hashed(i, i + 1) for i in range(size)] if size > PLAIN else [turned[i + 1 : i + 1 + size] for i in range(size)]
    return [(p, WHOLE) for p in whole] + list(zip(part, cut))


def _rotated(batches):
    def table(rows):
        prefix, kind, n, word = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(kind, pa.int8()), pa.array(n), pa.array(word)], ["prefix", "kind", "n", "id"])

    for batch in batches:
        rows: list = []
        for i, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            rows += [(prefix, kind, n, i) for prefix, kind in rotations(word)]
            if len(rows) >= CHUNK:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)


def group_neighbours(group: np.ndarray, kind: np.ndarray, n: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, near words, count and id of the most frequent one) of every row with near words in its group.

    Rows are sorted by group, then by falling count, then by id; groups are numbered from 0.
    """
    none = len(group)  # stands for no row; it has the least count
    n, word = np.append(n, -1), np.append(word, np.iinfo(np.int64).max)
    total = int(group[-1]) + 1 if none else 0

    def leading(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, first and second of the chosen rows of every group."""
        at = np.flatnonzero(chosen)
        count = np.bincount(group[at], minlength=total)
        begin = np.cumsum(count) - count
        at = np.append(at, [none, none])
        return count, np.where(count > 0, at[np.minimum(begin, len(at) - 1)], none), np.where(count > 1, at[np.minimum(begin + 1, len(at) - 1)], none)

    cut, most, second = leading(kind != WHOLE)
    begun, most_begun, _ = leading(kind == FIRST)
    whole, without, _ = leading(kind == WHOLE)
    row = np.arange(none)
    other = np.where(most[group] == row, second[group], most[group])
    inserted = np.where(kind == FIRST, without[group], none)
    better = (n[inserted] > n[other]) | (n[inserted] == n[other]) & (word[inserted] < word[other])
    best = np.where(kind == WHOLE, most_begun[group], np.where(better, inserted, other))
    near = np.where(kind == WHOLE, begun[group], cut[group] - 1 + (kind == FIRST) * whole[group])
    met = near > 0
    return word[:-1][met], near[met], n[best[met]], word[best[met]]


def _scanned(batches):
    """The neighbours of all groups from rows (prefix, kind, n, id) sorted by prefix; the last group of a batch waits for its rest."""

    def found(rows: pa.Table):
        prefix = rows.column(0).combine_chunks()
        edge = pc.not_equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False)
        group = np.concatenate([[0], np.cumsum(edge)])
        kind, n, word = (rows.column(i).to_numpy() for i in (1, 2, 3))
        columns = group_neighbours(group, kind, n, word)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["id", "near", "best_n", "best"])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not rows.num_rows:
            continue
        prefix = rows.column(0).combine_chunks()
        first = pc.index(prefix, prefix[len(prefix) - 1]).as_py()
        if first:
            yield found(rows.slice(0, first))
        held = rows.slice(first)
    if held is not None and held.num_rows:
        yield found(held)


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best) of every word (id, word, n) with a near one."""
    rows = words.select("id", "word", "n").mapInArrow(_rotated, "prefix string, kind tinyint, n bigint, id bigint")
    rows = rows.repartition("prefix").sortWithinPartitions("prefix", F.desc("n"), "id")
    found = rows.mapInArrow(_scanned, "id bigint, near bigint, best_n bigint, best bigint")
    best = F.max(F.struct("best_n", (-F.col("best")).alias("last"))).alias("best")
    met = found.groupBy("id").agg(F.sum("near").alias("n_near"), best)
    return met.select("id", "n_near", F.col("best.best_n").alias("best_n"), (-F.col("best.last")).alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): every form followed to the last; paths are halved in each round, for a count doubles at every step."""
    roots = stored(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("id", "root")
        if moved.filter("moved").isEmpty():
            return roots


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
    ratio: float = RATIO, modulus: int = MODULUS,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``."""
    words = word_counts(docs, id_col, text_col, min_chars, min_count, modulus)
    near = stored(neighbours(words))
    formed = near.join(words.select("id", "n"), "id").filter(F.col("best_n") >= ratio * F.col("n"))
    forms = stored(formed.select("id", F.col("best").alias("form"), F.col("best_n").alias("form_n")))
    roots = follow(forms)
    # Names are looked up for words with a form only, so that no join has a null key.
    name = words.select(F.col("id").alias("named"), "word")
    named = forms.join(roots, "id").join(name.withColumnRenamed("word", "form_word"), F.col("form") == F.col("named")).drop("named")
    named = named.join(name.withColumnRenamed("word", "root_word"), F.col("root") == F.col("named")).select("id", "form_word", "root_word", "form_n")
    all_words = words.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return all_words.select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
    )
