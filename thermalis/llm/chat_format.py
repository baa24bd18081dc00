"""Chat formatting with a grammar round trip.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. The grammar is deterministic:
a start mark, the role up to the line feed, the text up to the next end mark. What the
parser recovers is compared with the source, and a turn that comes back different is
written again with its conflicting content escaped, until it comes back identical:
``<`` and any backslashes before ``|`` get one more backslash (``<|`` to ``<\\|``), which
the parser takes off; in roles backslashes and line feeds are escaped as ``\\\\``, ``\\n``.

Turns are rendered and checked row by row where they lie. Only digests need a
conversation's turns together: they are dealt by conversation, sorted inside the
partitions and hashed as a stream, so no conversation, however long, is held whole.

A turn is held whole, however long its text. Null texts and roles count as empty, null conversation ids form one conversation, turns
are ordered by turn (nulls first), then role and text, and repeated rows stay. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalis.llm.arrowio import map_columns

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\+)\|")


def escape_text(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape_text(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "<" + m[1][1:] + "|", text)


def escape_role(role: str) -> str:
    return escape_text(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_text(role), flags=re.S)


def write_turn(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the text's span) of each turn; None outside the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find("\n", at)
        stop = rendered.find(END, line + 1)
        if line < 0 or stop < 0 or not rendered.startswith("\n", stop + len(END)):
            return None
        role, text = rendered[at + len(START) : line], rendered[line + 1 : stop]
        if "<|" in role or "<|" in text:
            return None  # control strings stand only where the grammar has them
        turns.append((unescape_role(role), unescape_text(text), line + 1, stop))
        at = stop + len(END) + 1
    return turns


class Reader:
    """The grammar over a conversation's text that arrives in pieces; holds one unfinished turn at most."""

    def __init__(self):
        self.held, self.at = "", 0

    def feed(self, piece: str):
        """(role, text, start and end of the text's span in the conversation) of every turn completed by ``piece``."""
        self.held += piece
        done = 0
        while True:
            line = self.held.find("\n", done)
            stop = self.held.find(END + "\n", line + 1) if line >= 0 else -1
            if stop < 0:
                break
            end = stop + len(END) + 1
            turn = parse(self.held[done:end])
            if turn is None or len(turn) != 1:
                raise ValueError("a conversation's text left the grammar")
            role, text, a, z = turn[0]
            yield role, text, self.at + done + a, self.at + done + z
            done = end
        self.held, self.at = self.held[done:], self.at + done

    def close(self) -> None:
        if self.held:
            raise ValueError("a conversation's text ends inside a turn")


def render_turn(role: str, text: str) -> str:
    """The turn as written once its reparse equals the source."""
    shown_role, shown_text = role, text
    while True:
        got = parse(write_turn(shown_role, shown_text))
        if got is not None and len(got) == 1 and got[0][:2] == (role, text):
            return write_turn(shown_role, shown_text)
        before = shown_role, shown_text
        if got is None or len(got) != 1 or got[0][0] != role:
            shown_role = escape_role(role)
        if got is None or len(got) != 1 or got[0][1] != text:
            shown_text = escape_text(text)
        if (shown_role, shown_text) == before:
            raise ValueError(f"a turn can't be written reversibly: {role[:40]!r}")


def format_turns(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per turn: conv_id, turn, ``rendered``, and the span of it under the loss mask.

    ``loss_start`` and ``loss_end`` count code points of ``rendered``; both are null
    for roles without loss. A conversation's text is its turns' in order.
    """

    def run(batches):
        for b in batches:
            rendered, start, end = [], [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                r = render_turn(role, text)
                _, _, a, z = parse(r)[0]
                rendered.append(r)
                start.append(a if role in loss_roles else None)
                end.append(z if role in loss_roles else None)
            yield b.column("id"), [b.column("turn"), b.column("role"), b.column("text"), rendered, start, end]

    rows = df.select(
        F.col("conv_id").cast("long").alias("id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return map_columns(rows, "conv_id long, turn long, role string, text string, rendered string, loss_start long, loss_end long", run)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its joined text: turns by the parser, loss text by the mask, and their digests.

    The mask's spans are cut out of the joined text and unescaped; the parser does not decide what is under it.
    """
    dealt = formatted.select("conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        out, now, state = [], None, None

        def close():
            conv, n, turns, chars, loss, length, reader = state
            reader.close()
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        def emit():
            cols = list(zip(*out, strict=True)) or [()] * 6
            out.clear()
            return pa.array(cols[0], pa.int64()), [list(c) for c in cols[1:]]

        for b in batches:
            for conv, rendered, start, end in zip(*(b.column(c).to_pylist() for c in ("id", "rendered", "loss_start", "loss_end")), strict=True):
                if state is None or conv != now:
                    if state:
                        close()
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, Reader()]
                for role, text, _, _ in state[6].feed(rendered):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    text = unescape_text(rendered[start:end])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(rendered)
            if out:
                yield emit()
        if state:
            close()
            yield emit()

    return map_columns(dealt.withColumnRenamed("conv_id", "id").select("id", "rendered", "loss_start", "loss_end"), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", run)
