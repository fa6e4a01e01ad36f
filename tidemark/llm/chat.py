"""Chat formatting with a grammar round trip.

Grammar of the output, one conversation:

    conversation := turn*
    turn         := "### " role ": " body "</turn>\\n"
    role, body   := ( "\\" control | any character that starts no control )*
    control      := "\\" | "###" | "</turn>"          (in a role also ":")

A turn is rendered plainly first and reparsed; if the turn that comes back is not
the source, the control strings inside it are escaped and it is parsed again, so
a text is changed only where it has to be. Beside the text stands the loss mask:
the span of the body of every assistant turn. Reading back runs the same parser over
the whole conversation as a stream of turns: a conversation of any length takes
the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import pick

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
#: Role whose texts are learned from.
LEARNED = "assistant"
#: Control strings in a body and in a role.
BODY = re.compile(r"\\|###|</turn>")
ROLE = re.compile(r"\\|###|</turn>|:")
_TOKEN = re.compile(r"\\(\\|###|</turn>|:)|(\\|###|</turn>|:)")


class NotATurn(ValueError):
    """The text is not in the grammar."""


def escaped(text: str, control: re.Pattern) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def read_field(text: str, at: int, closing: str) -> tuple[str, int]:
    """The unescaped field from `at` up to `closing`, and the position behind it."""
    out, in_role = [], closing == SEP
    while True:
        m = _TOKEN.search(text, at)
        if m is None:
            raise NotATurn("a field has no end")
        out.append(text[at : m.start()])
        if m[1] is not None and (m[1] != ":" or in_role):
            out.append(m[1])
            at = m.end()
        elif m[2] == ":" and not in_role:
            out.append(":")
            at = m.end()
        elif text.startswith(closing, m.start()):
            return "".join(out), m.start() + len(closing)
        else:
            raise NotATurn(f"unexpected {m[0]!r}")


def read_turn(text: str, at: int = 0) -> tuple[str, str, int]:
    """(role, body, position behind the turn)."""
    if not text.startswith(OPEN, at):
        raise NotATurn("a turn opens with its mark")
    role, at = read_field(text, at + len(OPEN), SEP)
    body, at = read_field(text, at, CLOSE)
    return role, body, at


def render_turn(role: str, body: str) -> str:
    """The turn's text; it reads back as (role, body), or this raises."""
    for r, b in ((role, body), (escaped(role, ROLE), body), (role, escaped(body, BODY)), (escaped(role, ROLE), escaped(body, BODY))):
        out = f"{OPEN}{r}{SEP}{b}{CLOSE}"
        try:
            if read_turn(out) == (role, body, len(out)):
                return out
        except NotATurn:
            continue
    raise NotATurn(f"no rendering of {role!r} reads back")


def body_span(rendered: str) -> tuple[int, int]:
    """Where the (escaped) body of a rendered turn stands, in code points."""
    _, start = read_field(rendered, len(OPEN), SEP)
    return start, len(rendered) - len(CLOSE)


def under_mask(rendered: str, start: int, end: int) -> str:
    """The unescaped text of a span of the loss mask."""
    text, at = read_field(rendered, start, CLOSE)
    if at != end + len(CLOSE):
        raise NotATurn("the mask doesn't cover a whole body")
    return text


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered (each row's text in the template) and the
    loss mask over rendered: loss_start, loss_end in code points (null: no loss).

    A null role or text is empty. Rows keep their null ids and turns; repeated
    rows are rendered each; further columns are left out. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = ([x or "" for x in b.column(i).to_pylist()] for i in (2, 3))
            out = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            mask = [body_span(x) if r == LEARNED else (None, None) for r, x in zip(roles, out, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(out, pa.string()), pa.array([x for x, _ in mask], pa.int64()), pa.array([x for _, x in mask], pa.int64())],
                names=["conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end"],
            )

    return pick(turns, conv_id="conv_id", turn="turn", role="role", text="text").mapInArrow(run, "conv_id long, turn long, role string, text string, rendered string, loss_start long, loss_end long")


def round_trip(turns: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text as it reads back: conv_id,
    n_turns, turns_sha256 (role, \\n, text, \\n per turn), loss_chars,
    loss_sha256 (the text under the loss mask, unescaped), formatted_chars.

    Turns are read in order of turn, nulls first, equal turns by role and text.
    Rows without conv_id make one conversation of their own. A conversation's
    digest is sequential, so it is read by one task, as a stream in sorted order.
    """
    rows = formatted(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begun, state = None, False, None

        def done():
            return {"conv_id": at, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for b in batches:
            out = []
            for conv, rendered, *mask in zip(*[b.column(i).to_pylist() for i in (0, 4, 5, 6)], strict=True):
                if not begun or conv != at:
                    if begun:
                        out.append(done())
                    at, begun, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                pos = 0
                while pos < len(rendered):
                    role, body, pos = read_turn(rendered, pos)
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                if mask[0] is not None:
                    learned = under_mask(rendered, *mask)
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(rendered)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
        if begun:
            yield pa.RecordBatch.from_pylist([done()], schema=shape)

    shape = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )


def probe(spark) -> DataFrame:
    """The conversation that quotes the template itself."""
    text = r"\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """round_trip of all turns and of probe(). Null texts and roles are empty, null turns
    come first, rows without conv_id are one conversation, repeated rows count each;
    other columns are not read; of an empty table only the probe comes back."""
    return round_trip(pick(turns, conv_id="conv_id", turn="turn", role="role", text="text").unionByName(probe(turns.sparkSession)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g'))
     + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
