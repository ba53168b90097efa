"""Column helpers for message headers and bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, nonempty_or, prefix, py_strip

HTML_BODY_CHARS = 2000  # fixed: html fallback body is cut to 2000 characters


def parse_sender(c) -> Column:
    """From header -> struct(name, email).

    With a ``<``: the name is the part before the first ``<``, stripped, then
    outer double quotes removed; the email is the part after the first ``<``
    up to the next ``<``, trailing ``>`` removed, then stripped. Without a
    ``<``: no name, the email is the stripped header.
    """
    raw = F.coalesce(col(c), F.lit(""))
    has_lt = F.instr(raw, "<") > 0
    before = F.substring_index(raw, "<", 1)
    after = F.element_at(F.split(raw, "<", -1), 2)
    name = F.regexp_replace(py_strip(before), r'^"+|"+$', "")
    email = py_strip(F.regexp_replace(after, ">+$", ""))
    return F.struct(
        F.when(has_lt, name).otherwise(F.lit("")).alias("name"),
        F.when(has_lt, email).otherwise(py_strip(raw)).alias("email"),
    )


def select_body(text_body, html_body) -> Column:
    """Stored body: the plain-text part if non-empty, else the start of the
    html part."""
    return nonempty_or(F.coalesce(col(text_body), F.lit("")),
                       prefix(F.coalesce(col(html_body), F.lit("")), HTML_BODY_CHARS))


def reply_subject(subject) -> Column:
    """``Re: `` prefix unless the subject already starts with ``Re:``."""
    s = F.coalesce(col(subject), F.lit(""))
    return F.when(s.startswith("Re:"), s).otherwise(F.concat(F.lit("Re: "), s))
