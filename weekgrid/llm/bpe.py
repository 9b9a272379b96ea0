"""Byte-level BPE: linear-time encoding by longest matches and backtracking, and decoding.

The merges of BPE are reproduced without merging: a token sequence is the encoding of its bytes exactly when every two
neighbours are the encoding of theirs. So a text piece is walked from the left with the longest token that fits the
token before it; where no token fits, the last one gives way to its next shorter match, and its end is marked dead, for the
encoding of a prefix is unique. Each position dies at most once, which keeps the walk linear. The matches come from one
Aho-Corasick pass over the piece, whose bytes are mapped to the 256 characters of Latin-1.

Whether two tokens are compatible is remembered. It is found from their edges: the tokens that merge into the left one along
its right edge, and into the right one along its left edge, each at the time of its rank. The pair stands unless two edge
tokens that lie side by side at some time make a token that comes before whatever would swallow either of them.

Defined cases: a null text is empty and has no tokens. Bytes that are no token by themselves raise an error.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REMEMBERED = 250_000  # pieces, and pairs of neighbours, of a generation; a worker remembers two generations
LONG = 64  # longer pieces are not remembered


class Memory:
    """A bounded memo of two generations: what is asked for again outlives the change of generation."""

    def __init__(self, compute, size: int = REMEMBERED):
        self.compute, self.size, self.young, self.old = compute, size, {}, {}

    def add(self, key):
        """The value of a key that the young generation lacks."""
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value
        return value


class Encoder:
    """Ranks by token bytes; ``pattern`` splits a text before encoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_of = {rank: str(rank) for rank in self.bytes_of}
        self.split = regex.compile(pattern).findall
        self.pieces = Memory(self.piece)
        self.edges: tuple[dict, dict] = {}, {}  # at most one entry per token
        self.fits = Memory(self.compatible)  # by left rank << 32 | right rank
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()

    def merged(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain BPE: merge the pair of least rank (under ``below``), leftmost first, until none is left. For a few bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.ranks) + 1 if below is None else below
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes a token of more than one byte."""
        parts = self.merged(self.bytes_of[rank], below=rank)
        if len(parts) != 2:
            raise ValueError(f"token {rank} is no merge of two others")
        return parts[0], parts[1]

    def edge(self, rank: int, side: int) -> list[int]:
        """The tokens along the left (0) or right (1) edge of a token, from the single byte to the token itself."""
        known = self.edges[side].get(rank)
        if known is None:
            known = [rank]
            if len(self.bytes_of[rank]) > 1:
                known = self.edge(self.halves(rank)[side], side) + known
            self.edges[side][rank] = known
        return known

    def compatible(self, pair: int) -> bool:
        lefts, rights = self.edge(pair >> 32, 1), self.edge(pair & 0xFFFFFFFF, 0)
        none, i, j = len(self.ranks) + 1, 0, 0
        while True:
            across = self.ranks.get(self.bytes_of[lefts[i]] + self.bytes_of[rights[j]], none)
            left = lefts[i + 1] if i + 1 < len(lefts) else none
            right = rights[j + 1] if j + 1 < len(rights) else none
            # Of equal ranks the leftmost merges first: the left token's own, then the one across, then the right one's.
            if across < left and across <= right and across != none:
                return False
            if left == right == none:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def walk(self, data: bytes) -> list[int]:
        """The encoding of one piece."""
        end = len(data)
        matches: list[list[tuple[int, int]]] = [[] for _ in data]
        for last, match in self.automaton.iter(data.decode("latin-1")):
            matches[last + 1 - match[0]].append(match)  # ends ascend, so the longest is last
        fits, dead = self.fits, bytearray(end + 1)
        # Per token taken: itself, its start, and how many of the shorter matches at its start are left to try.
        tokens, starts, untried = [], [], []
        at, left, options = 0, len(matches[0]), matches[0]
        before = -1  # the token before, shifted
        while at < end:
            while left:
                left -= 1
                size, rank = options[left]
                if dead[at + size]:
                    continue
                if before >= 0:
                    known = fits.young.get(before | rank)
                    if not (fits.add(before | rank) if known is None else known):
                        continue
                tokens.append(rank)
                starts.append(at)
                untried.append(left)
                at += size
                before = rank << 32
                if at < end:
                    options = matches[at]
                    left = len(options)
                break
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks single bytes")
                dead[at] = 1
                tokens.pop()
                at, left = starts.pop(), untried.pop()
                options = matches[at]
                before = tokens[-1] << 32 if tokens else -1
        return tokens

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.walk(data))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        pieces = self.pieces
        for p in self.split(text):
            # Long pieces hardly come back; they are not kept.
            ids += pieces.young.get(p) or (pieces.add(p) if len(p) <= LONG else self.piece(p))
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """An encoder from a file of base64 token bytes and ranks; built once per worker."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return Encoder(ranks, pattern)


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """Token ids of a text column, as an array of integers."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder(path, pattern).encode
        return pa.array([encode(t.as_py() or "") for t in texts], pa.list_(pa.int32()))

    return ids(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of arrays of token ids."""

    @F.arrow_udf("binary")
    def data(arrays: pa.Array) -> pa.Array:
        decode = encoder(path, pattern).decode
        return pa.array([decode(a.as_py() or ()) for a in arrays], pa.binary())

    return data(ids)


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to, without moving the ids out of the worker."""
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("struct<n_tokens:bigint, ids_sha256:string, decoded_sha256:string>")
    def digests(texts: pa.Array) -> pa.Array:
        e, out = encoder(path, pattern), []
        for text in texts:
            ids = e.encode(text.as_py() or "")
            written = ",".join(map(e.text_of.__getitem__, ids)).encode()
            out.append((len(ids), sha256(written).hexdigest(), sha256(e.decode(ids)).hexdigest()))
        return pa.array([dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), x)) for x in out], kind)

    found = docs.select(F.col(id_col).alias("doc_id"), digests(F.col(text_col).cast("string")).alias("d"))
    return found.select("doc_id", "d.*")
