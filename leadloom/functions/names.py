"""Company-name key used to recognise one company across sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import NAME_REMOVALS
from .text import SPACE, WORD, blank


def name_key(c) -> Column:
    """lower -> remove the fixed suffix pieces one after another (anywhere in
    the string, in the listed order) -> drop non-word, non-space characters ->
    collapse whitespace -> trim.

    Leading/trailing whitespace is removed by the final collapse + trim, which
    equals stripping first (no removal piece starts or ends with a blank).
    """
    s = F.lower(blank(c))
    for piece in NAME_REMOVALS:
        s = F.replace(s, F.lit(piece), F.lit(""))
    s = F.regexp_replace(s, f"[^{WORD}{SPACE}]", "")
    s = F.regexp_replace(s, f"[{SPACE}]+", " ")
    return F.trim(s)
