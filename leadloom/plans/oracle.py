"""DuckDB-dialect SQL pieces for the oracle texts.

Written out by hand: no pattern, list or constant is taken from the operators'
code, so a wrong value there shows as a mismatch. Only the input fixtures are
shared.
"""

from __future__ import annotations

from ..sources.fixtures import fixture_cte

# Character classes as Python understands \s, \w and \d.
SPACE = r"\t\n\x0B\f\r\x1c-\x1f \x{85}\p{Z}"
TEXT_PHONE = rf"(\+?6?0[1-9][\p{{Nd}}{SPACE}\-.]{{7,13}})"
BUTTON_PHONE = rf"(\+?6?0\p{{Nd}}[\p{{Nd}}{SPACE}\-]{{7,12}})"
CHAT_PHONE = r"(\+?6?01\p{Nd}{8,9})"
FAX = "(?i)(fax|faks|facsimile)"
NEAR = "(?i)(phone|tel|call|contact|mobile|fax|whatsapp|hotline|office|hubungi|telefon|talian)"
BEFORE, AFTER = 60, 20
# a link ends at its end tag or, where that is missing, at the next link's start
ANCHOR = r"(?is)<a(\s[^>]*)?>((?:[^<]|<[^/a]|<a[a-z]|</[^a]|</a[a-z])*)"
BUTTON = r"(?is)<button(\s[^>]*)?>(.*?)</button>"
H1 = r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1>"
RATING = r'(?is)class="F7nice ?">.*?<span aria-hidden="true">(.*?)</span>'
BLOCK = (r"(?i:</?(?:p|div|li|td|th|tr|ul|ol|dl|dt|dd|table|section|article|header|footer|nav|main|aside|form|"
         r"blockquote|pre|address|figure|hr|h[1-6]|body|html|br)(?:\s[^>]*)?/?>)")


def q(s: str) -> str:
    """DuckDB string literal (backslashes are literal in DuckDB)."""
    return "'" + s.replace("'", "''") + "'"


def blank(x: str) -> str:
    return f"coalesce({x}, '')"


def phone_type(x: str) -> str:
    drop = rf"[{SPACE}\-+.]"
    local = f"regexp_replace(regexp_replace({blank(x)}, {q(drop)}, '', 'g'), '^60', '0')"
    return (f"(CASE WHEN regexp_matches({local}, '^01[0-9]') THEN 'mobile' "
            f"WHEN {local} <> '' THEN 'landline' ELSE '' END)")


def name_key(x: str) -> str:
    s = f"lower({blank(x)})"
    for piece in ("sdn. bhd.", "sdn bhd.", "sdn bhd", "bhd.", "bhd", "plt.", "plt", "llp.", "llp", "(m)", "(malaysia)"):
        s = f"replace({s}, {q(piece)}, '')"
    s = f"regexp_replace({s}, {q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + SPACE + ']')}, '', 'g')"
    s = f"regexp_replace({s}, {q('[' + SPACE + ']+')}, ' ', 'g')"
    return f"trim({s})"


def clean_phone(x: str) -> str:
    return f"regexp_replace({blank(x)}, '[^\\p{{Nd}}+]', '', 'g')"


def normalize_phone(x: str) -> str:
    c = clean_phone(x)
    return (f"(CASE WHEN starts_with({c}, '+0') THEN substr({c}, 2) "
            f"WHEN starts_with({c}, '+60') THEN '0' || substr({c}, 4) "
            f"WHEN starts_with({c}, '60') AND length({c}) > 9 THEN '0' || substr({c}, 3) "
            f"ELSE {c} END)")


def valid_phone(x: str) -> str:
    d = f"regexp_replace(regexp_replace({blank(x)}, '[^\\p{{Nd}}]', '', 'g'), '^60', '0')"
    return f"(starts_with({d}, '0') AND length({d}) BETWEEN 9 AND 12)"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^[' + SPACE + ']+|[' + SPACE + ']+$')}, '', 'g')"


def clean_line(x: str) -> str:
    return f"regexp_replace({py_strip(x)}, '[^\\x20-\\x7E]', '', 'g')"


# Oracle-side views built on top of the shared fixtures.
LEADS_VIEW = ("leads", "SELECT *, " + phone_type("phone") + " AS phone_type, "
              "'' AS website_phone_type, '' AS website_phone2, '' AS website_phone2_type "
              "FROM leads_raw")


def with_fixtures(fixtures: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH RECURSIVE <fixture CTEs>, <extra CTEs> <body>``."""
    seen: set = set()
    ctes: list[tuple[str, str]] = []
    for f in fixtures:
        ctes += fixture_cte(f, seen)
    ctes += list(extra)
    if not ctes:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{s}\n)" for n, s in ctes) + "\n" + body


# ---- HTML pieces


def markup(x: str) -> str:
    s = f"regexp_replace({blank(x)}, '(?s)<!--.*?(-->|$)', '', 'g')"
    s = f"regexp_replace({s}, '(?is)<script[\\s>].*?</script\\s*>', '', 'g')"
    return f"regexp_replace({s}, '(?is)<style[\\s>].*?</style\\s*>', '', 'g')"


def decode(x: str) -> str:
    """The entities that the fixtures and the pages table hold."""
    for ent, ch in (("&#39;", "'"), ("&#233;", "é"), ("&#x2B;", "+"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                    ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def strip_tags(x: str) -> str:
    return decode(f"regexp_replace(regexp_replace({blank(x)}, {q('(?:' + BLOCK + chr(92) + 's*)+')}, chr(10), 'g'), '(?s)</?[a-zA-Z!][^>]*>', '', 'g')")


def inner_text(x: str) -> str:
    return py_strip(strip_tags(x))


def attr(attrs: str, name: str) -> str:
    """One of the three ways to write a value."""
    a = blank(attrs)
    return decode("(" + " || ".join(f"coalesce(regexp_extract({a}, {q(p)}, 1), '')" for p in (
        rf'(?is)\s{name}\s*=\s*"([^"]*)"', rf"(?is)\s{name}\s*=\s*'([^']*)'", rf"""(?is)\s{name}\s*=\s*([^\s"'>]+)""")) + ")")


def extract_all(x: str, pattern: str, group: int) -> str:
    return f"list_transform(regexp_extract_all({x}, {q(pattern)}, {group}), lambda v: coalesce(v, ''))"


def first_h1(x: str) -> str:
    return inner_text(f"regexp_extract({markup(x)}, {q(H1)}, 1)")
