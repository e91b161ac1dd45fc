"""Column functions on text. All are Catalyst expressions but for the two Unicode normal forms, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's \s has it, spelled out since the engines' own classes differ.
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: A word-ish unit: letters, marks and numbers in a row.
UNIT = r"[\p{L}\p{M}\p{N}]+"
WORD = r"[\p{L}\p{N}_]"
IM_START, IM_END, THINK, UNTHINK = "<|im_start|>", "<|im_end|>", "<think>", "</think>"
#: Full-width think tags and what the cleaning rules take for personal data and benchmarks.
WIDE_TAGS = {"＜think＞": THINK, "＜/think＞": UNTHINK}
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
PHONE = r"(?:^|[^\p{L}\p{N}_])(\p{Nd}{3}[-.]\p{Nd}{3}[-.]\p{Nd}{4})(?![\p{L}\p{N}_])"
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "test.com", "acme.com", "acme.io", "globex.com", "initech.org", "wayne.co", "hooli.com", "bar.com", "ex.com", "mail.net", "domain.org", "sub.domain.com", "site.org", "github.com")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def pinned(c: Column) -> Column:
    """c, computed once: a value the optimiser must take for changing is neither copied into each later expression nor
    computed again below a filter."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


#: Ranges that composition never changes: no code point in them decomposes, composes with the one before it, or has a
#: combining class other than the virama's (which meets no other mark in them).
STABLE = (
    (0x0, 0x2FF), (0x400, 0x45F), (0x900, 0x93B), (0x93D, 0x950), (0x955, 0x957), (0x960, 0x97F), (0xB80, 0xBBD), (0xBBF, 0xBD6), (0xBD8, 0xBFF),
    (0xC00, 0xC3B), (0xC3D, 0xC54), (0xC58, 0xC7F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3001, 0x3020), (0x4E00, 0x9FFF), (0xFF01, 0xFF5E),
)
UNSTABLE = "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in STABLE) + "]"


def nfc(c: Column) -> Column:
    """Canonical composition. Texts of stable ranges only are composed already and never leave the JVM; what the wide
    first range has is taken away before the rest is looked at."""
    rest = F.regexp_replace(c, r"[\x00-\x{2ff}]+", "")
    return F.coalesce(_nfc(F.when(rest.rlike(UNSTABLE), c)), c)


def nfkc(c: Column) -> Column:
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def fix_tags(c: Column) -> Column:
    for wide, plain in WIDE_TAGS.items():
        c = F.replace(c, F.lit(wide), F.lit(plain))
    return c


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


def normalise(c: Column) -> Column:
    """NFC, then plain think tags, then no control characters."""
    return strip_controls(fix_tags(nfc(c)))


def ascii_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\x00-\x7F]+", "")) / F.greatest(F.length(c), F.lit(1))


def occurrences(c: Column, marker: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker)).cast("bigint")


def asks_translation(c: Column) -> Column:
    return c.rlike(rf"(?i)(?<!{WORD})translat(e|ion)(?!{WORD})")


def empty_assistant(c: Column) -> Column:
    return c.rlike(rf"<\|im_start\|>assistant{WS}*<\|im_end\|>")


def chars(c: Column) -> Column:
    return F.length(c).cast("bigint")


def units(c: Column) -> Column:
    return F.regexp_count(c, F.lit(UNIT)).cast("bigint")


def visible(c: Column) -> Column:
    return F.regexp_replace(c, WS, "")


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def emails(c: Column) -> Column:
    """Addresses in order; texts without the sign, i.e. most, are not searched."""
    return F.when(c.contains("@"), F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0))).when(c.isNotNull(), F.array().cast("array<string>"))


def phones(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PHONE), F.lit(1))


def real_email(found: Column) -> Column:
    """Whether a match is neither a placeholder nor shaped like a dotted local part with a digit."""

    def real(e: Column) -> Column:
        low, local = F.lower(e), F.substring_index(e, "@", 1)
        placeholder = low.contains("example") | F.element_at(F.split(low, "@"), -1).isin(*PLACEHOLDER_DOMAINS)
        return ~placeholder & ~(e.rlike(f"^{EMAIL}$") & local.contains(".") & local.rlike(r"\p{Nd}"))

    return F.exists(found, real)


def inference_template(c: Column) -> Column:
    return c.rlike(r"(?i)Premise:[^\n]*hypothesis")


def choice_template(c: Column) -> Column:
    return c.contains("Available choices:")


def system_prompt(c: Column) -> Column:
    """The first system turn's text; null where there is none, empty where it is empty."""
    pattern = r"(?s)<\|im_start\|>system\n(.*?)<\|im_end\|>"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def markdown_normalise(c: Column) -> Column:
    c = F.replace(c, F.lit(" "), F.lit(" "))
    c = F.regexp_replace(c, r"\n{4,}", "\n\n\n")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    return F.concat(strip(c), F.lit("\n"))


def others_to_space(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", " ")


def byte_name(b: Column) -> Column:
    return F.format_string("<0x%02X>", b)


def fixed(c: Column, digits: int) -> Column:
    """A number at a fixed number of places; exact ties go to the even digit."""
    return F.bround(c.cast("decimal(38,18)"), digits).cast(f"decimal(38,{digits})").cast("string")


def path_quoted(c: Column) -> Column:
    """Percent-encoding for a path: spaces as %20, slash and tilde kept."""
    c = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page_url(lang: Column, title: Column, host: str) -> Column:
    return F.concat(F.lit("https://"), lang, F.lit(f".{host}/api/rest_v1/page/html/"), path_quoted(title))


def absolute_link(link: Column, lang: Column, host: str) -> Column:
    """Protocol-relative, dot-relative and root-relative links made absolute; others as they are."""
    base = F.concat(F.lit("https://"), lang, F.lit(f".{host}"))
    return (
        F.when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("./"), F.concat(base, F.lit("/wiki/"), F.substring(link, 3, 1 << 30)))
        .when(link.startswith("/"), F.concat(base, link))
        .otherwise(link)
    )


def without_noise(html: Column) -> Column:
    """No script, style, meta; category links as text, other link tags gone."""
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", "")
    html = F.regexp_replace(html, r"(?is)<meta\b[^>]*>", "")
    html = F.regexp_replace(html, r'(?is)<link\b[^>]*rel="[^"]*mw:PageProp/Category[^"]*"[^>]*href="([^"]+)"[^>]*>', "\nCategory: $1\n")
    return F.regexp_replace(html, r"(?is)<link\b[^>]*>", "")


def body(html: Column) -> Column:
    pattern = r"(?is)<body[^>]*>(.*)</body>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1)).otherwise(html)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<(?:a|img|source)\b[^>]*?\b(?:href|src)="([^"]*)"'), F.lit(1))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def matches_search(token: Column, id_: Column, term: str) -> Column:
    """Vocabulary search: a part of the token, or the very id; a blank term finds all."""
    t = term.strip().lower()
    return F.lit(True) if not t else F.lower(token).contains(t) | (id_.cast("string") == t)
