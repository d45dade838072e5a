from .names import name_key
from .phones import (classify_phone, clean_phone, normalize_phone, is_valid_phone,
                     is_fax_context, has_context_word, text_phone_confidence,
                     BUTTON_PHONE_RE, TEXT_PHONE_RE, CHAT_PHONE_RE, CONTEXT_RE, FAX_RE)
from .text import py_strip, clean_line, blank, quote_regex, words_regex, SPACE, WORD, DIGIT

__all__ = [
    "name_key", "classify_phone", "clean_phone", "normalize_phone", "is_valid_phone",
    "is_fax_context", "has_context_word", "text_phone_confidence",
    "BUTTON_PHONE_RE", "TEXT_PHONE_RE", "CHAT_PHONE_RE", "CONTEXT_RE", "FAX_RE",
    "py_strip", "clean_line", "blank", "quote_regex", "words_regex", "SPACE", "WORD", "DIGIT",
]
