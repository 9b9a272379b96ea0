"""Personal data by weak supervision, in DataFrame expressions only.

Base spans follow fixed patterns and always stay. Wider patterns propose further spans. Labelers vote on every candidate (yes, no,
or no opinion): its strict pattern, its checksum or structure, a gazetteer, cue words before it, and what it is glued to.
Candidates are counted by kind and votes; those counts, whose number is bounded by the possible votes, are all that training
needs. Expectation-maximisation estimates how reliable each labeler is and how likely each combination of votes is
personal data; a logistic span classifier over kind and votes is trained on that and decides on the proposed spans.

Positions are code points, end exclusive. A pattern's places come from the texts between its matches (``split``) and the matches
(``regexp_extract_all``). Patterns are possessive where that cannot change a match, and start at the start of a run, so
that long runs of one kind of character stay linear.

Defined cases: a null text is empty; without candidates the classifier is not fitted and adds nothing.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.common import filled, logistic

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")  # in the order of a listing; the first four have base patterns

# The base patterns. ``\G`` is the end of the match before.
NAME = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{NAME})|\G){NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"  # 0 to 255
HINTS = {"email": "@", "phone": "+"}  # without it there is no match

# Patterns that propose spans.
WIDE = {
    "email": rf"(?i)(?:(?<!{NAME})|\G){NAME}++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3} )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)[\"']? ?[:=] ?[\"']?[A-Za-z0-9/+_-]{16,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
WIDE_HINTS = {"email": r"(?i)[(\[]at[)\]]", "secret": "(?i)token|secret|passw|api[_-]?key"}

# The gazetteer: what known instances of a kind hold.
KNOWN = {
    "email": r"(?i)\b(?:com|org|net|edu|gov|de|fr|es|uk|io|info)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": "^(?:4|5[1-5]|3[47]|6(?:011|5))",
    "phone": r"^\+?(?:1|33|34|44|49)?\D",
    "secret": "(?i)^(?:token|secret|password|passwd|api)",
    "ssn": "^(?!000|666|9)",
}
CUES = {
    "email": "mail|contact|write|reach|correo|kontakt|courriel",
    "ip": r"\bip\b|address|host|server|login|dirección|adresse",
    "card": "card|visa|credit|account|tarjeta|karte|carte",
    "phone": "phone|call|tel|mobile|fax|teléfono|anruf|appel",
    "secret": "key|token|secret|auth|bearer|password",
    "ssn": "ssn|social|security|number",
}
VOTES = ("strict", "structure", "known", "cue", "glued")
CONTEXT = 40  # characters before a span that are searched for cues
SPAN = "struct<start:int, end:int, value:string, before:string, after:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _running(items: Column, kind: str, first: Column, step, close, given=lambda at, part: F.lit(0)):
    """What ``step(at, item, given)``, (the next ``at``, an array to append), makes of all items in order, and the last ``at``.

    Appending copies an array, so the items are taken in blocks of about the cube root of their number; ``close`` makes one
    value of what a block appended (values of ``kind``), ``given(at, block)`` something its steps share. The state is
    struct(at, out), ``out`` having a value for each block.
    """
    empty = F.expr(f"cast(array() AS array<{kind}>)")

    def whole(held: Column) -> Column:
        size = F.greatest(F.ceil(F.cbrt(2.0 * F.size(held))).cast("int"), F.lit(1))

        def steps(begin: Column, own: Column) -> Column:
            def one(done: Column, item: Column) -> Column:
                at, new = step(done["at"], item, own["given"])
                return F.struct(at.alias("at"), F.concat(done["out"], new).alias("out"))

            return F.aggregate(own["items"], F.struct(begin.alias("at"), empty.alias("out")), one)

        def block(done: Column, k: Column) -> Column:
            part = F.slice(held, k, size)
            # An array of one value is a value that is made once, however often it is read.
            own = F.array(F.struct(part.alias("items"), given(done["at"], part).alias("given")))
            made = F.transform(own, lambda o: steps(done["at"], o))
            return F.transform(made, lambda p: F.struct(p["at"].alias("at"), F.concat(done["out"], F.array(close(p["out"]))).alias("out")))[0]

        starts = F.when(F.size(held) > 0, F.sequence(F.lit(1), F.size(held), size)).otherwise(F.expr("cast(array() AS array<int>)"))
        return F.aggregate(starts, F.struct(first.alias("at"), F.slice(F.array(close(empty)), 1, 0).alias("out")), block)

    return F.transform(F.array(items), whole)[0]


def places(text: Column, pattern: str, hint: Column) -> Column:
    """Leftmost non-overlapping matches as an array of ``SPAN``; texts without the hint are not searched.

    What stands before and after a match is taken from the texts between matches: a substring of the whole text would be
    counted from its start for each of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    gaps = F.transform(between, lambda g: F.struct(g.alias("gap"), F.substring(g, 1, 1).alias("first"), F.right(g, F.lit(CONTEXT)).alias("last")))

    def paired(held: Column) -> Column:
        m, g = held["m"], held["gaps"]
        after = F.zip_with(F.slice(g, 2, F.size(m)), F.slice(m, 2, F.size(m)), lambda gap, n: F.coalesce(F.nullif(gap["first"], F.lit("")), F.substring(n, 1, 1), F.lit("")))
        ahead = F.zip_with(m, F.slice(g, 1, F.size(m)), lambda n, gap: F.struct(n.alias("m"), F.length(gap["gap"]).alias("skip"), gap["last"].alias("last")))
        return F.zip_with(ahead, after, lambda p, c: F.struct(p.alias("p"), c.alias("after")))

    pairs = F.transform(F.array(F.struct(found.alias("m"), gaps.alias("gaps"))), paired)[0]

    def step(at: Column, pair: Column, _) -> tuple[Column, Column]:
        value = pair["p"]["m"]
        start = at["at"] + pair["p"]["skip"]
        end = start + F.length(value)
        before = F.right(F.concat(at["tail"], pair["p"]["last"]), F.lit(CONTEXT))
        span = F.struct(start.alias("start"), end.alias("end"), value.alias("value"), before.alias("before"), pair["after"].alias("after"))
        return F.struct(end.alias("at"), F.right(F.concat(before, value), F.lit(CONTEXT)).alias("tail")), F.array(span)

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    spans = F.flatten(_running(pairs, SPAN, first, step, lambda out: out)["out"])
    return F.when(hint & text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() AS array<{SPAN}>)"))


def is_base(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _valid(kind: str, span: Column) -> Column:
    return is_base(kind, span["value"])


def _structure(kind: str, value: Column) -> Column:
    """What a checksum or the make-up of a value says."""
    digits = _digits(value)
    return {
        "email": value.rlike(r"(?i)[.)\]] ?[a-z]{2,6}$"),
        "ip": value.rlike(rf"^{PART}(?:\.{PART}){{3}}$|^[0-9A-Fa-f:]+$"),
        "card": F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(10, 13),
        "secret": value.rlike("[0-9]") & value.rlike("[=:].*[A-Za-z]") & (F.length(value) >= 24),
        "ssn": value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
    }[kind]


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0)


def candidates(text: Column) -> Column:
    """All base and proposed spans: array of (kind, start, end, base, votes)."""
    def judging(kind: str, strict: bool):
        def judged(span: Column) -> Column:
            value = span["value"]
            base = is_base(kind, value) if strict else F.lit(False)
            before = span["before"]
            beside = F.concat(F.right(before, F.lit(1)), F.lit(" "), span["after"])
            votes = (
                F.when(base, 1).otherwise(0),
                _vote(_structure(kind, value)),
                _vote(value.rlike(KNOWN[kind])),
                F.when(before.rlike(f"(?i){CUES[kind]}"), 1).otherwise(0),
                F.when(beside.rlike("[A-Za-z0-9_/]"), -1).otherwise(0),
            )
            named = (vote.alias(name) for vote, name in zip(votes, VOTES))
            number = F.lit(KINDS.index(kind)).alias("kind")
            return F.struct(number, span["start"].alias("start"), span["end"].alias("end"), base.alias("base"), *named)

        return judged

    found = []
    for kind in KINDS:
        if kind in BASE:
            hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
            spans = places(text, BASE[kind], hint)
            if kind == "card":  # shorter and longer numbers are neither cards nor proposed
                spans = F.filter(spans, lambda s: F.length(_digits(s["value"])).between(13, 19))
            elif kind != "email":
                spans = F.filter(spans, partial(_valid, kind))
            found.append(F.transform(spans, judging(kind, strict=True)))
        if kind in WIDE:
            hint = text.rlike(WIDE_HINTS[kind]) if kind in WIDE_HINTS else F.lit(True)
            found.append(F.transform(places(text, WIDE[kind], hint), judging(kind, strict=False)))
    return F.concat(*found)


def estimate(counts: dict[tuple, int], rounds: int = 100) -> dict[tuple, float]:
    """Probability of personal data by (kind, votes), by expectation-maximisation over the counts of those.

    Votes are independent given the truth; each labeler has its own chances of each vote for either truth, each kind its own base rate.
    """
    keys = list(counts)
    n = np.array([counts[k] for k in keys], float)
    kinds, votes = np.array([k[0] for k in keys]), np.array([k[1:] for k in keys]) + 1
    p = np.clip(0.5 + 0.2 * (votes - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        log_odds = np.zeros(len(keys))
        for kind in np.unique(kinds):
            own = kinds == kind
            yes, no = (n * p)[own].sum() + 1, (n * (1 - p))[own].sum() + 1
            log_odds[own] = np.log(yes / no)
        for labeler in range(votes.shape[1]):
            for vote in range(3):
                own = votes[:, labeler] == vote
                if own.any():
                    yes = ((n * p)[own].sum() + 1) / ((n * p).sum() + 3)
                    no = ((n * (1 - p))[own].sum() + 1) / ((n * (1 - p)).sum() + 3)
                    log_odds[own] += np.log(yes / no)
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return dict(zip(keys, p.tolist()))


def train(docs: DataFrame, text_col: str = "text") -> dict[str, float] | None:
    """Weights of the span classifier: constant, one per kind, one per labeler; None without candidates."""
    spans = docs.select(F.explode(candidates(filled(text_col))).alias("c")).select("c.*")
    # At most kinds x 3^labelers rows, however many documents.
    rows = spans.groupBy("kind", *VOTES).count().collect()
    if not rows:
        return None
    counts = {(r["kind"], *(r[v] for v in VOTES)): r["count"] for r in rows}
    p = estimate(counts)
    x = np.array([[1.0, *(float(k[0] == i) for i in range(len(KINDS))), *map(float, k[1:])] for k in counts])
    w = logistic(x, np.array(list(p.values())), np.array(list(counts.values()), float))
    return dict(zip(("constant", *KINDS, *VOTES), w.tolist()))


def spans_column(text: Column, weights: dict[str, float] | None) -> Column:
    """Base and accepted spans, sorted by kind and start: array of (kind, start, end, base)."""

    def accepted(c: Column) -> Column:
        if weights is None:
            return c["base"]
        by_kind = F.element_at(F.array(*(F.lit(weights[k]) for k in KINDS)), c["kind"] + 1)
        z = reduce(lambda s, v: s + F.lit(weights[v]) * c[v], VOTES, F.lit(weights["constant"]) + by_kind)
        return c["base"] | (z >= 0)

    kept = F.filter(candidates(text), accepted)
    spans = F.array_sort(F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))))
    # Sorted, so that equal ones are neighbours; ``array_distinct`` compares every two structs.
    return F.transform(F.array(spans), lambda held: F.filter(held, lambda x, i: (i == 0) | (x != F.get(held, i - 1))))[0]


def listing(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans`` per row of ``docs``: array of (kind, start, end, base), kind being the place in ``KINDS``."""
    weights = train(docs, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), spans_column(filled(text_col), weights).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones joined, replaced by its kind in brackets."""
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def ahead(at: Column, part: Column) -> Column:
        """The text up to a block's last start, so that its pieces aren't counted from the start of the whole text."""
        return F.struct(at.alias("from"), F.substring(text, at + 1, F.element_at(part, -1)["start"] - at).alias("text"))

    def step(at: Column, s: Column, given: Column) -> tuple[Column, Column]:
        piece = F.concat(F.substring(given["text"], at - given["from"] + 1, s["start"] - at), F.element_at(tags, s["kind"] + 1))
        return F.greatest(at, -s["less"]), F.when(s["start"] >= at, F.array(piece)).otherwise(F.expr("cast(array() AS array<string>)"))

    done = F.array(_running(ordered, "string", F.lit(0), step, lambda out: F.array_join(out, ""), ahead))
    done = F.transform(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))[0]
    return F.when(F.size(spans) > 0, done).otherwise(text)
