"""Chat formatting with a grammar that is read back.

Grammar of the output, one turn after the other::

    turn  = "### " role ": " body "\\n</turn>\\n"
    role  = characters [A-Za-z0-9_-], any other as %XX of its UTF-8 bytes
    mark  = "### " role ": " | "</turn>"

In a body a mark stands only behind one or more backslashes. Rendering starts with the plain text, parses what it wrote,
and compares; where the parse differs, every mark in the text, with the backslashes before it, gets one more backslash.
Reading takes one away, so ``\\</turn>`` and ``</turn>`` in a text stay apart. Texts without marks are never touched.

Each turn is rendered and verified by itself, before rows meet; only the assembly of a conversation reads its
turns in order, one at a time, from a sorted partition, so a conversation of any length needs the memory of one turn.

Defined cases: null text and null role are empty; a null conversation id is a conversation; turns sort by (turn, role,
text) with null turns first, so repeated turns are kept and their order is fixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrid.llm.common import over_batches

END = "\n</turn>\n"
# A run of backslashes is looked at from its beginning only, so a long one costs its length.
MARK = re.compile(r"(?<!\\)(\\*)(### [A-Za-z0-9_%-]*: |</turn>)")
TRAINED = "assistant"  # the role whose texts are under the loss mask


def role_out(role: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), role)


def role_in(role: str) -> str:
    return re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), role)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end enclose the body in the formatted string."""
    role = start = None
    for mark in MARK.finditer(formatted):
        if mark[1]:  # a backslash before it: text
            continue
        if mark[2] != "</turn>":
            if role is None and mark.start() == (start or 0):
                role, start = role_in(mark[2][4:-2]), mark.end()
            else:
                raise ValueError(f"a turn begins inside another at {mark.start()}")
        else:
            if role is None or formatted[mark.start() - 1] != "\n" or mark.start() - 1 < start:
                raise ValueError(f"no turn ends at {mark.start()}")
            body = formatted[start : mark.start() - 1]
            yield role, MARK.sub(lambda m: m[0][1:], body), start, mark.start() - 1
            role, start = None, mark.end() + 1
    if role is not None or (start or 0) != len(formatted):
        raise ValueError("text outside of turns")


def render(role: str, text: str) -> str:
    """The formatted turn; escapes are added only as far as reading it back asks for them."""
    body, head = text, f"### {role_out(role)}: "
    for _ in range(2):
        formatted = head + body + END
        try:
            if [turn[:2] for turn in parse(formatted)] == [(role, text)]:
                return formatted
        except ValueError:
            pass
        body = MARK.sub(lambda m: "\\" + m[0], text)
    raise ValueError("the turn cannot be read back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the formatted turn; a conversation is its turns in order, joined without a gap."""

    @F.arrow_udf("string")
    def rendered(roles: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([render(r.as_py(), t.as_py()) for r, t in zip(roles, texts)], pa.string())

    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.withColumn("formatted", rendered("role", "text"))


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read_back(batches):
    """One row per conversation from rows sorted by it, by parsing the formatted turns."""
    now, state = object(), None

    def row():
        conv, n, turns, chars, loss, length = state
        return {
            "conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
            "loss_sha256": loss.hexdigest(), "formatted_chars": length,
        }

    for batch in batches:
        for conv, formatted in zip(batch.column(0), batch.column(1)):
            conv, formatted = conv.as_py(), formatted.as_py()
            if state is None or conv != now:
                if state is not None:
                    yield row()
                now, state = conv, [conv, 0, sha256(), 0, sha256(), 0]
            for role, text, _, _ in parse(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if role == TRAINED:
                    state[3] += len(text)
                    state[4].update(text.encode())
            state[5] += len(formatted)
    if state is not None:
        yield row()


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Read formatted turns back: counts and digests per conversation, and of what its loss mask covers."""
    order = ["conv_id", "turn", "role", "text"]
    ordered = turns.repartition("conv_id").sortWithinPartitions(*order).select(F.col("conv_id").cast("long"), "formatted")
    return over_batches(ordered, _read_back, DIGESTS)


def loss_spans(turns: DataFrame) -> DataFrame:
    """Spans of the bodies under the loss mask: conv_id, turn, start and end in the formatted turn."""

    @F.arrow_udf("struct<start:bigint, end:bigint>")
    def span(formatted: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("start", "end"), next(parse(f.as_py()))[2:])) for f in formatted], pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    return turns.filter(F.col("role") == TRAINED).select("conv_id", "turn", span("formatted").alias("at")).select("conv_id", "turn", "at.*")
