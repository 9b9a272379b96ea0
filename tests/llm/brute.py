"""Plain, slow versions of the contracts, one document after the other."""

import base64
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import tiktoken
import xxhash
from tokenizers import Tokenizer

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hexed(text):
    return sha256(text.encode()).hexdigest()


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(UPPER)) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs, distance=4):
    prints = [(i, fingerprint(t)) for i, t in docs]
    fps = np.array(sorted({f for _, f in prints}), dtype=np.uint64)
    root = np.arange(len(fps))
    for i, f in enumerate(fps):
        close = np.flatnonzero(np.bitwise_count(fps ^ f) <= distance)
        roots = np.unique(root[close])
        root[np.isin(root, roots)] = roots[0]
    at = {int(f): int(r) for f, r in zip(fps, root)}
    least = {}
    for i, f in prints:
        least[at[f]] = min(i, least.get(at[f], i))
    return [(i, f"{f:016x}", least[at[f]]) for i, f in prints]


def similar(docs, distance):
    """(id, component) by long fingerprints: five words, every shingle once; a segment that differs in one bit at most, and the distance."""
    even, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    prints = []
    for i, t in docs:
        words = [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(UPPER)) if w]
        shingles = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        counts = np.zeros((8, 64), int)
        for s in shingles:
            for k in range(8):
                z = (xxhash.xxh64_intdigest(s.encode(), 42) + (k + 1) * even) & mask
                z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
                z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
                z ^= z >> 31
                counts[k] += [z >> b & 1 for b in range(64)]
        prints.append((i, tuple(sum(1 << b for b in range(64) if 2 * c[b] > len(shingles)) for c in counts)))
    return [(i, c) for (i, _), c in zip(prints, linked([p for _, p in prints], distance))]


def linked(prints, distance):
    """The component of every long fingerprint (tuples of 8 words), named by a place in the list."""
    words = np.array(prints, dtype=np.uint64)
    root = np.arange(len(words))
    for i, own in enumerate(words):
        differing = words ^ own
        near = np.bitwise_count(differing).sum(axis=1) <= distance
        segments = np.stack([differing >> np.uint64(first) & np.uint64((1 << 21) - 1) for first in (0, 21)])
        near &= (np.bitwise_count(segments) <= 1).any(axis=(0, 2))
        root[np.isin(root, np.unique(root[near]))] = root[i]
    return root.tolist()


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(UPPER)].append(i)
    return [(i, max(g := groups[n := (t or "").translate(UPPER)]), len(g), i == max(g), hexed(n)) for i, t in docs]


def ranks(name):
    with open(P.path(name), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def tokens(docs):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks("byte_bpe_multi_50k.tiktoken"), special_tokens={})
    out = []
    for i, t in docs:
        ids = own.encode_ordinary(t or "")
        out.append((i, len(ids), hexed(",".join(map(str, ids))), sha256(own.decode_bytes(ids)).hexdigest()))
    return out


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def licenses(docs):
    out = []
    for i, t in docs:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(UPPER))
        found = [(k, label) for k in range(len(words)) for p, label in PHRASES.items() if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in found]
        out.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return out


def pieces(docs):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    out = []
    for i, t in docs:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        out += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return out


def best_fit_decreasing(lengths, capacity=1024):
    gaps = Counter()
    used = 0
    for n in sorted(lengths, reverse=True):
        gap = min((g for g, c in gaps.items() if c and g >= n), default=None)
        if gap is None:
            used, gap = used + 1, capacity
        else:
            gaps[gap] -= 1
        gaps[gap - n] += 1
    return used


def lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for i, t in docs:
        for k in map(key, (t or "").split("\n")):
            if len(k) >= 10:
                holders[k] = min(i, holders.get(k, i))
    out = []
    for i, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < 10 or holders[key(x)] == i]
        out.append((i, len(all_lines), len(all_lines) - len(kept), hexed("\n".join(kept))))
    return out


def personal(docs):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    out = []
    for i, t in docs:
        found = {k: [m.span() for m in re.finditer(p, t or "") if ok(m[0])] for k, (p, ok) in kinds.items()}
        listed = [f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans]
        out.append((i, *(len(s) for s in found.values()), hexed(",".join(listed)), listed))
    return out
