"""Chat formatting with a grammar round trip.

    formatted := turn*        turn := "<|im_start|>" role "\n" text "<|im_end|>\n"

Inside a role or text no "<|" may stand, and in a role no newline. A turn is rendered verbatim, parsed
again and compared with its source; as long as they differ, the conflicting content is escaped. The
escape is reversible: "<", any number of backslashes, "|" gains one backslash, and loses it again. In
a role, backslashes are then doubled and newlines become a backslash and n.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
#: A conversation's output is cut between turns into pieces of about so many characters.
PIECE_CHARS = 1 << 20

_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role))


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """Turns as (role, text, start and end of the text in the output), or None if it isn't well formed."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.find("\n", at)
        close = formatted.find("<|", line + 1)
        if not formatted.startswith(START, at) or line < 0 or close < 0 or not formatted.startswith(END, close):
            return None
        role = formatted[at + len(START) : line]
        if "<|" in role:
            return None
        turns.append((unescape_role(role), unescape(formatted[line + 1 : close]), line + 1, close))
        at = close + len(END)
    return turns


def render(role: str, text: str) -> str:
    """The turn's output, escaped only as far as reading it back needs."""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), escape(text))):
        out = f"{START}{r}\n{t}{END}"
        got = parse(out)
        if got is not None and len(got) == 1 and got[0][:2] == (role, text):
            return out
    raise ValueError("a turn can't be read back")  # not reached: both escapes are one to one


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted conversations as (conv_id, piece, text, loss array<struct<start,end>>).

    Turns stand in the order of turn, then role and text for ties; null turns first, null roles and
    texts empty; rows without conv_id form one conversation of null id. Repeated rows are repeated
    turns. ``loss`` has the places of the assistant's texts in the piece, in characters. A conversation
    of usual length is one piece; a longer one is cut between turns, so no value is unbounded. Turns
    are rendered where they are read; one conversation's rows then stream through one task in order,
    with a piece in memory at a time. Extra columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(turns.sparkSession)

    def rendered(batches):
        for b in batches:
            out = [render(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], ["conv_id", "turn", "role", "text", "out"])

    def pieces(batches):
        conv, piece, parts, loss, size, begun = None, 0, [], [], 0, False
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def row():
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([piece], pa.int32()), pa.array(["".join(parts)], pa.string()), pa.array([loss], kind)], ["conv_id", "piece", "text", "loss"])

        for b in batches:
            for c, out, learned in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if begun and (c != conv or size >= PIECE_CHARS):
                    yield row()
                    piece, parts, loss, size = (piece + 1 if c == conv else 0), [], [], 0
                conv, begun = c, True
                if learned:
                    loss.append({"start": size + out.index("\n") + 1, "end": size + len(out) - len(END)})
                parts.append(out)
                size += len(out)
        if begun:
            yield row()

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # compared as the reader gets them: by turn, role, text
    out = rows.mapInArrow(rendered, "conv_id long, turn long, role string, text string, out string")
    out = out.select("conv_id", "turn", "out", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return out.select("conv_id", "out", (F.col("role") == LEARNED_ROLE).alias("learned")).mapInArrow(pieces, "conv_id long, piece int, text string, loss array<struct<start:long,end:long>>")


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from it alone; pieces must come in order, as they are formatted.

    Empty texts count as turns without characters; a conversation without assistant turns has the hash of no
    text; a null conv_id is one conversation; an empty table gives an empty result."""

    def run(batches):
        state, conv, begun = None, None, False

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}

        def row():
            s = state
            values = [[conv], [s["n"]], [s["turns"].hexdigest()], [s["chars"]], [s["loss"].hexdigest()], [s["size"]]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for c, text, loss in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if begun and c != conv:
                    yield row()
                if not begun or c != conv:
                    state, conv, begun = fresh(), c, True
                for role, content, _, _ in parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{content}\n".encode())
                for span in loss:
                    learned = unescape(text[span["start"] : span["end"]])
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
                state["size"] += len(text)
        if begun:
            yield row()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
