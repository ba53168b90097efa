"""Column helpers for text: whitespace, tokens, prefixes.

All are native Spark expressions (no Python workers), so they stay inside
whole-stage code generation where the operator allows it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts. Written with
# \x{..} escapes so the same pattern text works in Java regex and in RE2
# (DuckDB), whose \s differ.
WS_CLASS = r"[\t\n\x{0B}\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"
WS_RUN = WS_CLASS + "+"
# The same set as characters, for btrim (built from Python's own rule; no
# whitespace character lies above U+3000).
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# A token is a maximal run of Unicode letters, digits and underscore
# (Python's \w on lower-cased text).
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace
    (character-set trim, no regex)."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def py_split_words(c) -> Column:
    """Python ``str.split()``: the non-empty runs between whitespace."""
    return F.filter(F.split(col(c), WS_RUN), lambda x: x != "")


def tokens(c) -> Column:
    """Lower-cased word tokens of a text column (array<string>)."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN_PATTERN), 0)


def prefix(c, n: int) -> Column:
    """First ``n`` characters (Python ``s[:n]``); NULL stays NULL."""
    return F.substring(col(c), 1, n)


def nonempty_or(c, other) -> Column:
    """Python ``a or b`` for strings: ``a`` unless it is NULL or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), col(other))


def sql_like_literal(text: str) -> str:
    """Pattern for Spark's (i)like that matches ``%text%`` with the text's
    own ``%`` and ``_`` still acting as wildcards (no escape character in the
    source semantics), and a backslash matching itself."""
    return "%" + text.replace("\\", "\\\\") + "%"
