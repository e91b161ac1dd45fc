"""Conversations as text of marked turns, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import IM_END, IM_START


def turns(c: Column) -> Column:
    """array<struct<role, content>>: pieces between start markers that are closed; other pieces are left out, and no
    turn spans two markers."""
    pattern = r"(?s)^(\w+)\n(.*?)<\|im_end\|>"
    pieces = F.filter(F.split(c, r"<\|im_start\|>"), lambda p: p.rlike(pattern))
    return F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, pattern, 1).alias("role"), F.regexp_extract(p, pattern, 2).alias("content")))


def parse(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(id, turn, role, content), a row a turn."""
    return df.select(id_col, F.posexplode(turns(F.col(text_col))).alias("turn", "t")).select(id_col, F.col("turn").cast("bigint").alias("turn"), "t.role", "t.content")


def compose(turn_rows: DataFrame, id_col: str = "ord") -> DataFrame:
    """(id, text) from turn rows: the inverse of parse for well-formed texts."""
    marked = F.concat(F.lit(IM_START), "role", F.lit("\n"), "content", F.lit(IM_END))
    ordered = F.array_sort(F.collect_list(F.struct("turn", marked.alias("m"))))
    return turn_rows.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["m"]), "\n").alias("text"))
