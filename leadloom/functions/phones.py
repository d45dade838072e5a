"""Phone column builders (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGIT, SPACE, blank, words_regex
from .patterns import CONTEXT_WORDS, FAX_WORDS

# Phone shapes with Python classes spelled out (see patterns.py for the
# plain-text originals).
BUTTON_PHONE_RE = rf"(\+?6?0{DIGIT}[{DIGIT}{SPACE}\-]{{7,12}})"
TEXT_PHONE_RE = rf"(\+?6?0[1-9][{DIGIT}{SPACE}\-.]{{7,13}})"
CHAT_PHONE_RE = rf"(\+?6?01{DIGIT}{{8,9}})"
CONTEXT_RE = words_regex(CONTEXT_WORDS)
FAX_RE = words_regex(FAX_WORDS)

# Characters dropped before classifying: Python \s, '-', '+', '.'
_CLASSIFY_DROP = rf"[{SPACE}\-+.]"


def classify_phone(c) -> Column:
    """'mobile' for 010-019 numbers, 'landline' for any other non-empty value,
    '' for empty. A leading 60 (country code) becomes 0 without a length check."""
    local = F.regexp_replace(F.regexp_replace(blank(c), _CLASSIFY_DROP, ""), "^60", "0")
    return (F.when(local.rlike("^01[0-9]"), F.lit("mobile"))
            .when(local != "", F.lit("landline"))
            .otherwise(F.lit("")))


def clean_phone(c) -> Column:
    """Keep digits and '+'."""
    return F.regexp_replace(blank(c), rf"[^{DIGIT}+]", "")


def normalize_phone(c) -> Column:
    """Local format 0XX...: '+0..' drops '+', '+60..' -> '0..', '60..' (longer
    than 9) -> '0..'."""
    cl = clean_phone(c)
    return (F.when(cl.startswith("+0"), F.regexp_replace(cl, r"^\+", ""))
            .when(cl.startswith("+60"), F.regexp_replace(cl, r"^\+60", "0"))
            .when(cl.startswith("60") & (F.length(cl) > 9), F.regexp_replace(cl, "^60", "0"))
            .otherwise(cl))


def is_valid_phone(c) -> Column:
    """Digits only, 60 -> 0, must start with 0 and have 9..12 digits."""
    local = F.regexp_replace(F.regexp_replace(blank(c), rf"[^{DIGIT}]", ""), "^60", "0")
    return local.startswith("0") & F.length(local).between(9, 12)


def is_fax_context(c) -> Column:
    return blank(c).rlike(FAX_RE)


def has_context_word(c) -> Column:
    return blank(c).rlike(CONTEXT_RE)


def text_phone_confidence(ctx) -> Column:
    """'medium' when a context word is near, else 'low' (fax is filtered first)."""
    return F.when(has_context_word(ctx), F.lit("medium")).otherwise(F.lit("low"))

