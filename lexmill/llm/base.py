"""What the text operators share: Unicode classes by rule, Arrow mapping, groups of equal records."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import ship


def ranges(test, stop: int) -> str:
    """A character class (without brackets) of all code points below stop for which test(char) holds."""
    out, first = [], None
    for o in range(stop + 1):
        ok = o < stop and not 0xD800 <= o < 0xE000 and test(chr(o))
        if ok and first is None:
            first = o
        elif not ok and first is not None:
            out.append(re.escape(chr(first)) + ("-" + re.escape(chr(o - 1)) if o - 1 > first else ""))
            first = None
    return "".join(out)


@lru_cache(None)
def word_pattern() -> re.Pattern:
    """Letters, marks and digits in a row: a word. (Ranges above U+FFFF would make the class slow; astral letters
    are in the first part.)"""
    marks = ranges(lambda c: unicodedata.category(c)[0] == "M", 0x10000)
    return re.compile(rf"[^\W_]+(?:[{marks}]+[^\W_]*)*")


def hash64(text: str) -> int:
    """What Spark's xxhash64 gives for a string."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """df.mapInArrow with the package at hand on every executor."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, renamed: extra columns, whatever their names, never clash."""
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def first_and_copies(keys: DataFrame, by: list[str], id_col: str = "_id", stored: str | None = None) -> DataFrame:
    """(ord_first, ord_copy) of each group of rows equal in `by`; keys must be materialised and narrow.

    Groups are counted with map-side partial aggregation; the join back streams the narrow keys and AQE splits
    a hot group's partition. With `stored`, copies stored as the first is are left out.
    """
    aggs = [F.min(id_col).alias("ord_first"), F.count(F.lit(1)).alias("_n")]
    if stored:
        aggs += [F.min_by(stored, id_col).alias("_stored_first"), F.min(stored).alias("_s0"), F.max(stored).alias("_s1")]
    firsts = keys.groupBy(*by).agg(*aggs).where("_n > 1")
    if stored:
        firsts = firsts.where("_s0 <> _s1").drop("_s0", "_s1")
    pairs = keys.join(firsts, by).where(F.col(id_col) != F.col("ord_first"))
    if stored:
        pairs = pairs.where(F.col(stored) != F.col("_stored_first"))
    return pairs.select("ord_first", F.col(id_col).alias("ord_copy"))
