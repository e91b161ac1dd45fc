"""The cleaning pipeline: each stage a DataFrame to DataFrame function, its counts from one pass before and one after.

Rows are (ord, text) with a text; keep-first and hashes follow ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.session import materialise

MIN_CHARS, MAX_CHARS, MIN_ASCII = 200, 20_000, 0.90


def scan(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """Null texts are no rows of the pipeline."""
    return df.select(F.col(id_col).alias("ord"), F.col(text_col).alias("text")).where("text is not null")


def flags(df: DataFrame) -> DataFrame:
    """Normalised text with every stage's flag beside it."""
    d = df.select("ord", F.col("text").alias("raw"), T.pinned(T.normalise(F.col("text"))).alias("text"))
    t = F.col("text")
    return d.select(
        "ord", "text",
        F.col("raw").rlike(T.CONTROLS).alias("had_controls"), F.col("raw").contains("＜think＞").alias("had_wide_tags"),
        T.ascii_ratio(t).alias("ascii_ratio"), T.asks_translation(t).alias("translation"),
        (T.occurrences(t, T.IM_START) != T.occurrences(t, T.IM_END)).alias("tag_mismatch"), (T.occurrences(t, T.THINK) != T.occurrences(t, T.UNTHINK)).alias("think_mismatch"),
        (~t.contains(f"{T.IM_START}assistant")).alias("no_assistant"), T.empty_assistant(t).alias("empty_assistant"), T.chars(t).alias("chars"),
    ).withColumns({
        "malformed": F.col("tag_mismatch") | F.col("think_mismatch") | F.col("no_assistant") | F.col("empty_assistant"),
        "short": F.col("chars") < MIN_CHARS, "long": F.col("chars") > MAX_CHARS, "foreign": F.col("ascii_ratio") < MIN_ASCII,
    })


def keep_quality(flagged: DataFrame) -> DataFrame:
    return flagged.where(~F.col("malformed") & ~F.col("short") & ~F.col("long"))


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def first_of(keyed: DataFrame) -> DataFrame:
    """The row of the smallest ord of each _digest; ord is unique.

    Only digests are shuffled: groups of more than one row are found with partial aggregation, and the texts meet that
    smaller table, which AQE broadcasts where its measured size allows and otherwise joins with skew handling.
    """
    again = keyed.groupBy("_digest").agg(F.min("ord").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return keyed.join(again, "_digest", "left").where("_first is null or _first = ord").drop("_first")


def keep_first(df: DataFrame, key: Column | None = None) -> DataFrame:
    """The row of the smallest ord of each equal text, or of each equal key."""
    return first_of(df.withColumn("_digest", T.pinned(_digest(key if key is not None else F.col("text"))))).select(*df.columns)


def sound_rows(df: DataFrame) -> DataFrame:
    """(ord, text, _digest) of the rows that pass the quality rules, normalised and written once: what follows reads
    digests alone, or texts without any rule being applied again."""
    return materialise(keep_quality(flags(df)).select("ord", "text", _digest(F.col("text")).alias("_digest")), "sound")


def survivor_flags(df: DataFrame) -> DataFrame:
    t = F.col("text")
    found = T.emails(t)
    return df.select(
        "ord", "text", T.chars(t).alias("chars"), (F.size(found) > 0).alias("email"), (F.size(T.phones(t)) > 0).alias("phone"), T.real_email(found).alias("real_email"),
        T.inference_template(t).alias("inference"), T.choice_template(t).alias("choice"), T.system_prompt(t).alias("system_prompt"), (~t.startswith(f"{T.IM_START}system")).alias("no_system"),
    )


def cleaned(df: DataFrame) -> DataFrame:
    """(ord, text) of the rows that survive."""
    return first_of(sound_rows(df)).select("ord", "text")


def count_if(c: str) -> Column:
    return F.count_if(F.col(c))


def tree_hash(df: DataFrame, bucket: int = 4096) -> DataFrame:
    """(content_hash): a two-level digest over rows in order of ord; no row or task holds more than `bucket` digests
    times the levels, whatever the corpus."""
    leaf = df.select(F.floor(F.col("ord") / bucket).alias("b"), "ord", F.sha2("text", 256).alias("h"))
    joined = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), "")
    first = leaf.groupBy("b").agg(F.sha2(joined("ord"), 256).alias("h"))
    second = first.groupBy(F.floor(F.col("b") / bucket).alias("c")).agg(F.sha2(joined("b"), 256).alias("h"))
    return second.groupBy().agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "h"))), lambda x: x["h"]), ""), 256), 1, 16).alias("content_hash"))


def ordered_hash(df: DataFrame, order: str = "ord", text: str = "text") -> DataFrame:
    """(content_hash): of all texts in a row, for bounded tables only."""
    return df.groupBy().agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), ""), 256), 1, 16).alias("content_hash"))


def manifest(df: DataFrame) -> DataFrame:
    """One row with every stage's counts: waterfall drops, non-exclusive mismatches, duplicates, flags, lengths."""
    text, sound = F.col("text"), ~F.col("malformed") & ~F.col("short") & ~F.col("long")
    digest = lambda c: F.when(sound, _digest(c))
    # every rule is applied once; the counts then read narrow columns, the survivors' flags the texts
    flagged = materialise(flags(df).withColumns({"_digest": digest(text), "_spaced": digest(T.collapse_space(text))}), "flags")
    before = flagged.agg(
        F.count(F.lit(1)).alias("raw_count"), count_if("had_controls").alias("control_rows"), count_if("had_wide_tags").alias("wide_tag_rows"),
        count_if("foreign").alias("foreign_rows"), F.count_if(F.col("foreign") & F.col("translation")).alias("foreign_translation_rows"),
        count_if("tag_mismatch").alias("tag_mismatch_rows"), count_if("think_mismatch").alias("think_mismatch_rows"), F.count_if(F.col("no_assistant") | F.col("empty_assistant")).alias("empty_assistant_rows"),
        count_if("malformed").alias("malformed_dropped"), F.count_if(F.col("short") & ~F.col("malformed")).alias("short_dropped"),
        F.count_if(F.col("long") & ~F.col("malformed") & ~F.col("short")).alias("long_dropped"),
        F.count_if(sound).alias("rows_before_dedup"), F.count_distinct("_spaced").alias("distinct_spaced"),
    )
    final = survivor_flags(first_of(keep_quality(flagged).select("ord", "text", "_digest")))
    after = final.agg(
        F.count(F.lit(1)).alias("final_count"), count_if("email").alias("email_rows"), count_if("phone").alias("phone_rows"), count_if("real_email").alias("real_email_rows"),
        count_if("inference").alias("inference_rows"), count_if("choice").alias("choice_rows"), F.round(F.avg("chars"), 1).alias("mean_chars"), F.median("chars").cast("bigint").alias("median_chars"),
        F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"), count_if("no_system").alias("no_system_rows"),
    )
    one = before.crossJoin(F.broadcast(after))  # each side is one row
    exact = F.col("rows_before_dedup") - F.col("final_count")
    return one.withColumn("exact_duplicates", exact).withColumn("extra_spaced_duplicates", F.greatest(F.col("rows_before_dedup") - F.col("distinct_spaced") - exact, F.lit(0))).withColumn(
        "retention_pct", F.round(F.try_divide(100.0 * F.col("final_count"), F.col("raw_count")), 2)
    ).drop("distinct_spaced")


def prompt_counts(final: DataFrame) -> DataFrame:
    """(system_prompt, rows): prompts of the rows that have one, most frequent first."""
    p = final.select(T.system_prompt(F.col("text")).alias("system_prompt")).where("system_prompt is not null")
    return p.groupBy("system_prompt").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "system_prompt")
