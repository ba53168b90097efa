"""Chat formatting by prefix-target expansion.

``examples(turns)`` explodes every assistant turn into a training example of its
own: all preceding turns of the conversation are its context, and only that
reply is trainable. Columns: conv_id, example (from 0), formatted, loss_start,
loss_end (code points of ``formatted``, end exclusive: the reply's text). If a
conversation's last turn is not an assistant's, one more example holds all turns
and has no loss (null spans), so that nothing of the conversation is lost.

Template: ``<|role|>``, a line break, the text, ``</s>``, a line break, for each
turn. In roles and texts every backslash is doubled, and the first character of
each control string (``CONTROLS``: this template's and other usual ones) is
followed by a backslash, overlapping ones included. So no control string survives
inside a text, and dropping each backslash but the doubled one's second restores it.

How it runs: turns are dealt by conv_id and sorted by turn (then role and text,
for ties) inside each partition; a task walks its turns once and holds the prefix
of the one conversation it is in. The output is a text for each reply with its
whole context, so a conversation of n turns yields in the order of n^2 turns: that is
what the method asks for, and rows leave the task as they are made. ``read_back``
walks the examples the same way.

Defined cases: null texts and roles are empty; null conv_ids form one
conversation; turns are sorted nulls first; repeated rows are turns of their own;
a conversation without assistant turns has the one example without loss; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .util import batched, ready

# Control strings of usual chat templates, this one's included (fixed values).
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.S)
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub("\\1\\\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where its text is."""
    head, body = f"<|{escape(role)}|>\n", escape(text)
    return f"{head}{body}</s>\n", len(head), len(head) + len(body)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


_EXAMPLE = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("formatted", pa.string()),
                      ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        begun, conv, n, prefix, size, replied = False, None, 0, [], 0, True
        for b in batches:
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if not begun or c != conv:
                    if not replied:
                        yield conv, n, "".join(prefix), None, None
                    begun, conv, n, prefix, size = True, c, 0, [], 0
                turn, start, end = formatted_turn(role or "", text or "")
                replied = role == ASSISTANT
                prefix.append(turn)
                if replied:
                    prefix = ["".join(prefix)]
                    yield c, n, prefix[0], size + start, size + end
                    n += 1
                size += len(turn)
        if not replied:
            yield conv, n, "".join(prefix), None, None
    yield from batched(rows(), _EXAMPLE)


def examples(turns: DataFrame) -> DataFrame:
    """See the module's text. ``turns``: conv_id, turn (long), role, text."""
    ready(turns.sparkSession)
    t = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return t.mapInArrow(_expand, "conv_id long, example int, formatted string, loss_start long, loss_end long")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        conv, last, chars, total, loss = None, None, 0, 0, hashlib.sha256()

        def done():
            turns = turns_of(last)
            h = hashlib.sha256()
            for role, text in turns:
                h.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            return conv, len(turns), h.hexdigest(), chars, loss.hexdigest(), total

        for b in batches:
            for c, f, s, e in zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if last is None or c != conv:
                    if last is not None:
                        yield done()
                    conv, chars, total, loss = c, 0, 0, hashlib.sha256()
                last = f  # the last example holds every turn
                total += len(f)
                if s is not None:
                    text = unescape(f[s:e])
                    chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
        if last is not None:
            yield done()
    yield from batched(rows(), _READ)


def read_back(ex: DataFrame) -> DataFrame:
    """One row for each conversation, from its examples alone: conv_id,
    n_turns, turns_sha256 (role, line break, text, line break of each turn),
    loss_chars and loss_sha256 (the texts under the loss spans, unescaped, in
    order), formatted_chars (code points of all its examples)."""
    t = ex.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return t.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
