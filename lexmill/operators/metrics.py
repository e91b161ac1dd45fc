"""Fertility of tokenizers: tokens over word-ish units by language, their spread and score, penalties, gates, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T

PENALTY_FROM, FEASIBLE_BELOW, SWEEP_BELOW = 1.2, 1.2, 1.19


def fertility(rows: DataFrame, *by: str) -> DataFrame:
    """(by…, lang, tokens, wordish_units, unk, ratio): the ratio of sums; null where there are no units."""
    got = rows.groupBy(*by, "lang").agg(F.sum("tokens").alias("tokens"), F.sum("wordish_units").alias("wordish_units"), F.sum("unk").alias("unk"))
    return got.withColumn("ratio", F.try_divide(F.col("tokens").cast("double"), F.col("wordish_units")))


def penalty(ratio: Column) -> Column:
    return F.exp(F.greatest(F.lit(0.0), ratio / PENALTY_FROM - 1.0))


def spread(ratios: DataFrame, *by: str) -> DataFrame:
    """(by…, min_ratio, max_ratio, min_lang, max_lang, spread, score): score is null where the spread is 0."""
    got = ratios.where("ratio is not null").groupBy(*by).agg(
        F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"),
        F.min(F.struct("ratio", "lang"))["lang"].alias("min_lang"), F.max(F.struct(F.col("ratio"), F.col("lang")))["lang"].alias("max_lang"),
    )
    got = got.withColumn("spread", F.col("max_ratio") - F.col("min_ratio"))
    return got.withColumn("score", F.try_divide(F.lit(1000.0), "spread"))


def penalised(ratios: DataFrame, lang: str, *by: str) -> DataFrame:
    """spread with a language's penalty and the score adjusted by it."""
    factor = ratios.where(F.col("lang") == lang).groupBy(*by).agg(penalty(F.max("ratio")).alias("penalty"))
    base = spread(ratios, *by)
    both = base.join(factor, list(by), "left") if by else base.crossJoin(F.broadcast(factor))  # without by, one row each
    return both.withColumn("adjusted_score", F.col("score") / F.col("penalty"))


def latest_runs(sweep: DataFrame) -> DataFrame:
    """One row a run and language: repeated rows collapse to the one logged last, null ratios leave."""
    order = F.struct("logged_at", "tokens", "wordish_units", "unk", "weight", "variant", "ratio")
    return sweep.where("ratio is not null").groupBy("run_id", "lang").agg(F.max(order).alias("m")).select("run_id", "lang", "m.variant", "m.weight", "m.tokens", "m.wordish_units", "m.unk", "m.ratio", "m.logged_at")


def sweep_ranking(sweep: DataFrame, top: int = 12) -> DataFrame:
    """The best runs whose lowest ratio is below the limit, by score."""
    ranked = spread(latest_runs(sweep), "run_id").where(F.col("min_ratio") < SWEEP_BELOW)
    return ranked.orderBy(F.desc("score"), "run_id").limit(top)


def gate(checked: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """(passed): whether the visible characters of every row are the same before and after."""
    return checked.agg(F.bool_and(T.visible(F.col(before)) == T.visible(F.col(after))).alias("passed"))


def parameter_grid(spark, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Every combination of bounded integer ranges, a column each."""
    out = None
    for name, (lo, hi) in ranges.items():
        axis = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(name))
        out = axis if out is None else out.crossJoin(axis)
    return out
