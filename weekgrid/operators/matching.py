"""Best fuzzy match per name: token-sort similarity, exact and without pairing everything.

Names are reduced to their sorted tokens first, so copies and reordered names fall together. Then, in order
of cost:

1. equal sorted tokens: score 100, an equi join;
2. names that can be settled by shared character pairs. If a candidate scores at least ``bar``, both strings
   share a minimum number of pairs, so one of the rarest pairs of the name must occur in the candidate
   (prefix filter). A best score at or above the bar found this way is therefore the true best. Names whose
   pairs occur in too large a share of the candidates are not joined at all, so no group of a frequent pair is expanded;
3. the rest: names and candidates are hashed into a grid of bounded cells, each cell emits only its best
   candidate per name, and the partial bests are merged by an aggregate. Inside a cell, candidates of one length and one count of
   characters by class are a bucket. What two strings have in common is at most what their counts have, so a bucket has an upper bound
   for its scores; buckets are visited by falling bound and left once it is below the best score found. Those that are
   visited are scored with one machine word per candidate.

Scores are 200 * LCS / (length + length).
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

# The scorer travels with the job, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 2_000
BLOCK = 20_000
COMMON_SHARE = 0.05  # of all candidates; names whose needed pairs occur in more of them are scanned
CLASSES = 24  # of characters, whose counts bound what two strings have in common
WORD = 64  # characters of a name that one machine word holds


def sorted_tokens(c: str):
    tokens = F.filter(F.split(F.trim(F.col(c)), r"\s+"), lambda x: x != "")
    return F.array_join(F.array_sort(tokens), " ")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per row of the table (bit-parallel)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def similarity(a: str, b: str) -> float:
    length = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / length if length else 100.0


class Offers:
    """Candidates as one matrix of character codes, scored against a name all at once.

    The same bit-parallel table as :func:`lcs_length`, one machine word per candidate. Padding has no bits and changes nothing.
    """

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.lengths = np.array([len(k) for k in keys], dtype=np.int64)
        codes = np.array(keys, dtype=str).view(np.uint32).reshape(len(keys), -1) if any(keys) else np.zeros((len(keys), 0), np.uint32)
        self.letters, self.codes = np.unique(codes, return_inverse=True)
        self.codes = self.codes.reshape(codes.shape)
        self.scored = 0  # candidates that best() has scored
        counts = np.zeros((len(keys), CLASSES), np.int32)
        for column in codes.T:
            # Padding is no character; a zero inside a key would be, but then the key is scored by itself.
            counts[np.arange(len(keys)), column % CLASSES] += column > 0
        signature = np.concatenate([self.lengths[:, None], counts], axis=1)
        buckets, owner = np.unique(signature, axis=0, return_inverse=True)
        self.bucket_lengths, self.bucket_counts = buckets[:, 0], buckets[:, 1:]
        self.members = np.argsort(owner.ravel(), kind="stable")
        self.begin = np.searchsorted(owner.ravel()[self.members], np.arange(len(buckets) + 1))
        self.odd = np.array([i for i, k in enumerate(keys) if "\0" in k], dtype=np.int64)

    def bounds(self, name: str) -> np.ndarray:
        """No candidate of a bucket scores higher than this."""
        own = np.bincount(np.array([ord(c) % CLASSES for c in name], dtype=np.int64), minlength=CLASSES)
        both = len(name) + self.bucket_lengths
        return np.where(both > 0, 200.0 * np.minimum(self.bucket_counts, own).sum(axis=1) / np.maximum(both, 1), 100.0)

    def best(self, name: str) -> tuple[int, float]:
        """The first of the candidates with the highest score, and the score."""
        bounds = self.bounds(name)
        order = np.argsort(-bounds, kind="stable")
        best, score = -1, -1.0
        if len(self.odd):  # keys that the counts don't describe
            own = self.scores(name, self.odd)
            best, score = int(self.odd[own.argmax()]), float(own.max())
        step, at = 4, 0
        while at < len(order) and bounds[order[at]] >= score - 1e-9:
            chosen = order[at : at + step]
            rows = np.sort(np.concatenate([self.members[self.begin[b] : self.begin[b + 1]] for b in chosen]))
            own = self.scores(name, rows)
            self.scored += len(rows)
            top = int(own.argmax())
            if own[top] > score or own[top] == score and rows[top] < best:
                best, score = int(rows[top]), float(own[top])
            at, step = at + step, min(step * 2, 256)
        return best, score

    def scores(self, name: str, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        lengths = self.lengths[of]
        if len(name) > WORD or "\0" in name:
            return np.array([similarity(name, k) for k in np.array(self.keys, dtype=object)[of]])
        where = np.zeros(len(self.letters), np.uint64)
        for i, ch in enumerate(name):
            at = np.searchsorted(self.letters, ord(ch))
            if at < len(where) and self.letters[at] == ord(ch):
                where[at] |= np.uint64(1 << i)
        full = np.uint64((1 << len(name)) - 1)
        row = np.full(len(lengths), full)
        for column in self.codes[of].T:
            hit = row & where[column]
            row = ((row + hit) | (row - hit)) & full
        both = len(name) + lengths
        common = len(name) - np.bitwise_count(row).astype(np.int64)
        return np.where(both > 0, 200.0 * common / np.maximum(both, 1), 100.0)


@F.pandas_udf(T.DoubleType())
def _pair_score(a: pd.Series, b: pd.Series) -> pd.Series:
    offers, out = Offers(b.tolist()), np.zeros(len(a))
    for name, own in a.groupby(a).indices.items():
        out[own] = offers.scores(name, own)
    return pd.Series(out)


def _pairs(c: str):
    """Distinct character pairs of a string; none for strings shorter than two."""
    n = F.length(c)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(c), i, F.lit(2))))


def _best(scored: DataFrame) -> DataFrame:
    """Highest score per name; ties to the candidate that comes first."""
    return scored.groupBy("name_key").agg(
        F.max(F.struct("match_score", (-F.col("place")).alias("back"), "candidate_key")).alias("_b")
    ).select("name_key", "_b.match_score", "_b.candidate_key")


def _rare_pairs(names: DataFrame, candidates: DataFrame, bar: float, common: float) -> tuple[DataFrame, DataFrame]:
    """(names, candidates) keyed by pair, for names whose needed pairs together occur in a small share of the candidates.

    The share is relative, so the same names are settled this way whatever the number of candidates.
    """
    pairs = candidates.select("candidate_key", "place", F.explode(_pairs("candidate_key")).alias("pair"))
    frequency = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("_f"))
    owned = names.withColumn("_all", _pairs("name_key")).withColumn("_n", F.size("_all"))
    # score >= bar and lengths a, b: insertions + deletions d <= (1 - bar/100)(a + b), and b is at most
    # a * (200 - bar) / bar. Each edit spoils at most two of the name's pairs.
    a = F.length("name_key")
    edits = F.floor((1 - bar / 100) * (a + F.floor(a * (200 - bar) / bar)))
    needed = F.col("_n") - 2 * edits  # at least this many of the name's distinct pairs are in the candidate
    ranked = (
        owned.withColumn("_take", F.col("_n") - needed + 1)
        .filter(needed >= 1)
        .select("name_key", "_take", F.explode("_all").alias("pair"))
        .join(frequency, "pair", "left")
        .groupBy("name_key", "_take")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("pair").alias("p")))).alias("_r"))
        .withColumn("_r", F.slice("_r", 1, F.col("_take").cast("int")))
        .withColumn("_met", F.aggregate("_r", F.lit(0).cast("bigint"), lambda s, r: s + r["f"]))
        .crossJoin(F.broadcast(candidates.agg(F.count(F.lit(1)).alias("_candidates"))))  # one row
        .filter(F.col("_met") <= common * F.col("_candidates"))
    )
    return ranked.select("name_key", F.explode("_r.p").alias("pair")), pairs


def _scan_cell(names: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """Best candidate of one block for each name of one batch."""
    out = []
    # In order of place, so that the first of the best scores is the one that comes first.
    candidates = candidates.sort_values("place")
    keys, places = candidates["candidate_key"].tolist(), candidates["place"].tolist()
    offers = Offers(keys)
    for name in names["name_key"] if keys else ():
        at, score = offers.best(name)
        out.append((name, score, places[at], keys[at]))
    return pd.DataFrame(out, columns=["name_key", "match_score", "place", "candidate_key"])


def best_matches(
    names: DataFrame, players: DataFrame, name: str = "injury_name", bar: float = 90.0, common: float = COMMON_SHARE
) -> DataFrame:
    """injury_name, candidate_name, match_score, player_id for every non-null name.

    Ties go to the candidate with the least player_id; a player name used twice keeps its greatest id.
    """
    named = players.filter(F.col("name").isNotNull()).groupBy("name").agg(
        F.min("player_id").alias("place"), F.max("player_id").alias("player_id")
    )
    keyed = named.withColumn("candidate_key", sorted_tokens("name"))
    # One representative per key: the candidate that comes first.
    candidates = keyed.groupBy("candidate_key").agg(
        F.min(F.struct("place", "name", "player_id")).alias("_c")
    ).select("candidate_key", "_c.place", F.col("_c.name").alias("candidate_name"), "_c.player_id")
    wanted = names.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("name_key", sorted_tokens(name))
    keys = wanted.select("name_key").distinct()
    slim = candidates.select("candidate_key", "place")

    # Names and candidates grow with the input, and their files look small to the planner: without the hints it would
    # broadcast them through the driver.
    equal = keys.join(slim.hint("merge"), F.col("name_key") == F.col("candidate_key")).select(
        "name_key", F.lit(100.0).alias("match_score"), "candidate_key"
    )
    open_keys = keys.join(equal.select("name_key").hint("merge"), "name_key", "left_anti")
    asked, offered = _rare_pairs(open_keys, slim, bar, common)
    near = asked.join(offered.hint("merge"), "pair").select("name_key", "candidate_key", "place").distinct()
    settled = _best(near.withColumn("match_score", _pair_score("name_key", "candidate_key"))).filter(
        F.col("match_score") >= bar
    )
    # Written once: it both answers these names and decides which ones are left to scan.
    found = stored(equal.unionByName(settled))
    left_over = keys.join(found.select("name_key").hint("merge"), "name_key", "left_anti")
    found = found.unionByName(scan_matches(left_over, slim))
    return (
        wanted.join(found.hint("merge"), "name_key")
        .join(candidates.select("candidate_key", "candidate_name", "player_id").hint("merge"), "candidate_key")
        .select(name, "candidate_name", "match_score", "player_id")
    )


def scan_matches(keys: DataFrame, candidates: DataFrame, batch: int = BATCH, block: int = BLOCK) -> DataFrame:
    """Best candidate per key by scanning, for keys no filter can settle.

    Keys and candidates are hashed into a grid of batches and blocks; each cell holds a bounded number of
    distinct strings on either side and returns one row per key. Only the two counts reach the driver.
    """
    n_batches = max(1, math.ceil(keys.count() / batch))
    n_blocks = max(1, math.ceil(candidates.count() / block))

    def part(c: str, n: int):
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = keys.select("name_key", part("name_key", n_batches).alias("_batch"), every(n_blocks).alias("_block"))
    offered = candidates.select(
        "candidate_key", "place", part("candidate_key", n_blocks).alias("_block"), every(n_batches).alias("_batch")
    )
    cells = asked.groupBy("_batch", "_block").cogroup(offered.groupBy("_batch", "_block"))
    schema = "name_key string, match_score double, place long, candidate_key string"
    return _best(cells.applyInPandas(_scan_cell, schema))
