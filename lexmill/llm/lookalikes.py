"""Problem 3: visually identical text with different characters.

Compatibility forms that look the same are composed to one form, white space of other widths is mapped to a space,
default-ignorable characters go, look-alike letters of other alphabets become one letter; full case folding gives
the form for comparisons. The tables are made by rule from the Unicode database; each Arrow batch is treated per
distinct value.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.base import arrow_map, first_and_copies, id_and_text
from lexmill.session import materialise

#: Letters of Cyrillic, Greek and Armenian that look like a Latin letter.
ALIKE = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "κ": "k", "γ": "y", "χ": "x",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Օ": "O", "Տ": "S", "ԍ": "G", "Ԍ": "G", "ɡ": "g", "ɑ": "a", "ı": "i", "к": "k", "ѵ": "v", "Ѵ": "V",
}
#: Letters of two alphabets side by side, as no word has them by right.
MIXED = re.compile(r"[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z]")
#: Kinds of compatibility decomposition that keep the look (not circles, fractions, raised signs).
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>")


def ignorable(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" and not 0x600 <= o <= 0x8FF or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


@lru_cache(None)
def table(alike: bool) -> dict[int, str]:
    """str.translate table; `alike` also maps look-alike letters."""
    out: dict[int, str] = {}
    for o in [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)]:
        c = chr(o)
        if ignorable(c):
            out[o] = ""
        elif unicodedata.category(c) == "Zs":
            out[o] = " "
        elif (kind := unicodedata.decomposition(c).split(" ")[0]) in SAME_LOOK:
            to = unicodedata.normalize("NFKC", c)
            letters = all(unicodedata.category(x)[0] in "LMN" for x in to)
            if kind != "<compat>" or letters:
                out[o] = to
    if alike:
        out = {k: "".join(ALIKE.get(x, x) for x in v) for k, v in out.items()}
        out |= {ord(k): v for k, v in ALIKE.items()}
    return out


def canonical(text: str, alike: bool = True) -> str:
    """The one form of text: composed, special spaces as spaces, invisible characters gone."""
    if text.isascii():
        return text
    text = text.translate(table(False))
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.translate(table(True)) if alike else text


def skeleton(text: str) -> str:
    """The form two texts share if they look the same to a reader."""
    if text.isascii():
        return text
    text = text.translate(table(True))
    if unicodedata.is_normalized("NFC", text):
        return text
    text = unicodedata.normalize("NFC", text)
    return text.translate(table(True))


def folded(text: str) -> str:
    """skeleton with full case folding: the form for comparisons."""
    return skeleton(text).casefold()


def _int64(text: str) -> tuple[int, int]:
    d = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _keys(batches):
    for b in batches:
        d = b.column(1).dictionary_encode()
        forms = []
        for t in d.dictionary.to_pylist():
            if t is None or not t.strip():
                forms.append((None, None, None, None))
                continue
            s = skeleton(t)
            a, z = _int64(s)
            forms.append((a, z, _int64(s.casefold())[0], a if s is t or s == t else _int64(t)[0]))
        index = d.indices.to_pylist()
        rows = [(i, *forms[k]) for i, k in zip(b.column(0).to_pylist(), index) if k is not None and forms[k][0] is not None]
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["_id", "k1", "k2", "fold", "stored"])


def keys(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(_id, k1, k2, fold, stored): hashes of the look, of the folded form and of the text as stored."""
    return arrow_map(id_and_text(df, id_col, text_col), _keys, "_id long, k1 long, k2 long, fold long, stored long")


def _canonical(batches):
    for b in batches:
        d = b.column(1).dictionary_encode()
        values = d.dictionary.to_pylist()
        forms = pa.array([None if t is None else canonical(t, alike=False) for t in values], pa.string())
        folds = pa.array([None if t is None else folded(t) for t in values], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), forms.take(d.indices), folds.take(d.indices)], names=["_id", "canonical", "folded"])


def normalise(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(id, canonical, folded) of every row; a null text stays null, an empty one empty."""
    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(id_and_text(df, id_col, text_col), _canonical, f"_id {kind}, canonical string, folded string").withColumnRenamed("_id", id_col)


def found(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(ord_first, ord_copy) of transcripts that look the same but are stored differently."""
    return first_and_copies(materialise(keys(df, id_col, text_col), "p3"), ["fold", "k1", "k2"], stored="stored")
