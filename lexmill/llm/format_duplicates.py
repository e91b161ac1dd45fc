"""Problem 6: duplicates hidden by formatting differences.

Each turn of a record is one value, or, where it is made only of `key: value` lines or of one flat JSON object, a
set of field values. The distinct values make a dictionary: each is brought to its canonical form once, and each form
gets an integer. A record becomes the tuple of its turns' integers, fields sorted, and the compact tuples are grouped.
All of it is JVM-side; of texts only distinct values are shuffled, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.base import first_and_copies, id_and_text
from lexmill.session import materialise

#: Punctuation and ordinary white space; invisible and special characters stay.
BETWEEN = r"[\p{P}$+<=>^`|~\s]+"
#: Letters that full case folding would turn into other letters although only their look differs.
KEPT = "ﬀﬁﬂﬃﬄﬅﬆſ\u212a\u212b"
FOR = "".join(chr(0xE000 + k) for k in range(len(KEPT)))
STRING = r'"(?:[^"\\]|\\.)*"'
#: Between a field's key and its value.
CUT = "\u0001"
PAIR = rf"({STRING})\s*:\s*({STRING}|-?[0-9][0-9.eE+-]*|true|false|null)"
LINE = r"[^\p{L}\p{N}\n]*([\p{L}\p{N}_][^:\n]{0,60}):[ \t]*(\S[^\n]*)"


def canonical(value: Column) -> Column:
    """Case folded, each run of punctuation and white space one space, trimmed. (lower directly around upper would be
    simplified to lower, which keeps letters that fold to two.)"""
    return F.trim(F.lower(F.regexp_replace(F.upper(value), BETWEEN, " ")))


def values(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(_r, _id, turn, frame, field, raw): each value of each turn as it is stored, with the turn's role and end as one
    integer. A turn of fields gives a value a field, key and value apart; any other turn is one value. Null and blank
    texts have none."""
    d = id_and_text(df, id_col, text_col).where(F.col("_text").rlike(r"\S")).withColumn("_r", F.monotonically_increasing_id())
    text = F.when(F.col("_text").rlike(f"[{KEPT}]"), F.translate("_text", KEPT, FOR)).otherwise(F.col("_text"))
    t = d.select("_r", "_id", F.posexplode(F.filter(F.split(text, r"<\|im_start\|>"), lambda x: x.rlike(r"\S"))).alias("turn", "t"))
    t = t.withColumn("role", F.regexp_extract("t", r"^\s*(\w+)[ \t\r]*\n", 1))
    body = F.when(F.col("role") != "", F.regexp_replace("t", r"^\s*\w+[ \t\r]*\n", "")).otherwise(F.col("t"))
    t = t.select("_r", "_id", "turn", F.xxhash64(F.lower("role"), F.col("t").contains("<|im_end|>")).alias("frame"), F.replace(body, F.lit("<|im_end|>"), F.lit(" ")).alias("inner"))
    inner = F.col("inner")
    json = inner.rlike(r"^\s*\{") & F.regexp_replace(inner, PAIR, "").rlike(r"^[^\p{L}\p{N}\[\]]*$")
    lines = F.filter(F.split(inner, "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    # most turns are neither: their first line tells
    may = inner.contains(":") & ~inner.startswith("<think>") & inner.rlike(rf"^(?:[^\p{{L}}\p{{N}}\n]*\n)*{LINE}(?:\n|$)")
    keyed = may & (F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike("^" + LINE + "$"))
    field = lambda k, v: F.concat(k, F.lit(CUT), v)
    of_json = F.transform(F.arrays_zip(F.regexp_extract_all(inner, F.lit(PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(inner, F.lit(PAIR), F.lit(2)).alias("v")), lambda x: field(x["k"], x["v"]))
    of_lines = F.transform(lines, lambda x: field(F.regexp_extract(x, LINE, 1), F.regexp_extract(x, LINE, 2)))
    t = t.withColumn("kind", F.when(json, 1).when(keyed, 2).otherwise(0))
    parts = F.when(F.col("kind") == 1, of_json).when(F.col("kind") == 2, of_lines).otherwise(F.array(inner))
    return t.select("_r", "_id", "turn", "frame", (F.col("kind") > 0).alias("field"), F.explode(parts).alias("raw"))


def dictionary(occurrences: DataFrame) -> DataFrame:
    """(h1, h2, id): each distinct value, by a 128-bit hash of it as stored, with the integer of its canonical form.

    Equal values meet before they are shuffled and after; then each is brought to its canonical form once, and each
    distinct form gets one integer.
    """
    distinct = occurrences.select("h1", "h2", "field", "raw").distinct()
    cut = F.split("raw", CUT)
    form = F.when(F.col("field"), F.concat(canonical(cut[0]), F.lit(CUT), canonical(cut[1]))).otherwise(canonical(F.col("raw")))
    forms = distinct.select("h1", "h2", form.alias("form")).select("h1", "h2", F.xxhash64("form").alias("c1"), F.xxhash64(F.lit("b"), "form").alias("c2"))
    forms = materialise(forms, "p6f")
    numbered = materialise(forms.select("c1", "c2").distinct().withColumn("id", F.monotonically_increasing_id()), "p6i")
    return forms.join(numbered, ["c1", "c2"]).select("h1", "h2", "id")


def encoded(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(_id, ids): the integer tuple of each record, fields in order of their integers. Null and blank texts have none and
    are left out; rows that share an id are rows of their own."""
    v = values(df, id_col, text_col).withColumn("h1", F.xxhash64("field", "raw")).withColumn("h2", F.xxhash64(F.lit("b"), "field", "raw"))
    of_value = materialise(dictionary(v), "p6d")
    narrow = v.select("_r", "_id", "turn", "frame", "h1", "h2").join(of_value, ["h1", "h2"])
    whole = narrow.groupBy("_r").agg(F.min("_id").alias("_id"), F.array_sort(F.collect_list(F.struct("turn", "id", "frame"))).alias("x"))
    return whole.select("_id", F.flatten(F.transform("x", lambda e: F.array(e["turn"].cast("long"), e["frame"], e["id"]))).alias("ids"))


def keys(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    return encoded(df, id_col, text_col).select("_id", F.xxhash64("ids").alias("k1"), F.xxhash64(F.lit("b"), "ids").alias("k2"))


def collapse(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """One row of each group of copies: (ord_first, copies); a record without a copy has copies = 1.

    Null and blank texts come out in no group. Ties: the smallest id stands for its group.
    """
    return keys(df, id_col, text_col).groupBy("k1", "k2").agg(F.min("_id").alias("ord_first"), F.count(F.lit(1)).alias("copies")).select("ord_first", "copies")


def found(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(ord_first, ord_copy): each other member of a group beside its first."""
    return first_and_copies(materialise(keys(df, id_col, text_col), "p6"), ["k1", "k2"])
