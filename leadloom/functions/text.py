"""Text column builders shared by the phone, name and page functions.

Python's ``\\s``, ``\\w`` and ``\\d`` are Unicode-aware; Java's (and RE2's) are
ASCII by default. The classes below spell out the Unicode sets explicitly so
Spark and a second engine (RE2 in the oracle) agree with Python semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str.isspace() set, written as a character-class body.
SPACE = r"\t\n\x0B\f\r\x1c-\x1f \x{85}\p{Z}"
# Python \w (letters, numbers, underscore).
WORD = r"\p{L}\p{N}_"
# Python \d.
DIGIT = r"\p{Nd}"
# Printable ASCII kept by the body-line cleaner.
PRINTABLE_ASCII = r"\x20-\x7E"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c) -> Column:
    """NULL -> ''."""
    return F.coalesce(col(c), F.lit(""))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, also inside
    array functions (which don't share equal subexpressions)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode whitespace."""
    return F.regexp_replace(col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def words_regex(words: list[str], flags: str = "(?iu)") -> str:
    """Case-insensitive alternation of literal words (regex-escaped)."""
    return flags + "(" + "|".join(quote_regex(w) for w in words) + ")"


_REGEX_META = set("\\^$.|?*+()[]{}")


def quote_regex(s: str) -> str:
    """Escape a literal so both Java regex and RE2 read it literally."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in s)


def clean_line(c) -> Column:
    """Body-line cleaner: strip first, then drop characters outside 0x20-0x7E."""
    return F.regexp_replace(py_strip(c), f"[^{PRINTABLE_ASCII}]", "")
