"""Problem 8: mixing sources to target weights.

Capped water-filling over the sources' sizes in tokens: a source whose share asks for more than its cap of repetitions
is clamped and its excess goes to the others in proportion to their shares, until nothing is above its cap. Each
source's repetition is a whole number of copies of every record and a seeded fraction of one more. The fraction is cut
on a seeded hash of the record at the place where a histogram of tokens by hash reaches it, so the shares are met
closely without sorting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm.tokens import count
from lexmill.session import materialise

BINS = 1024


def water_fill(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float) -> dict[str, float]:
    """Tokens to take of each source; together `total`, or all caps where those are less."""
    room = {s: float(sizes.get(s, 0)) * max(0, caps[s]) for s in shares}
    want, open_, left = {s: 0.0 for s in shares}, {s for s in shares if room[s] > 0 and shares[s] > 0}, float(total)
    while open_ and left > 0:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if left * shares[s] / weight >= room[s]}
        if not full:
            for s in open_:
                want[s] = left * shares[s] / weight
            break
        for s in full:
            want[s] = room[s]
            left -= room[s]
        open_ -= full
    return want


PLAN = "source string, target_share double, max_repeat int, records long, tokens long, wanted double, whole int, part double"
#: A record's place is below this.
PLACES = 1 << 30


def plan(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokenizer: str | None = None, most_sources: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(records with their place and size, the plan: a row a source). The driver sees one row a target source, refused
    above most_sources; where each source's fraction is cut is found by a histogram of BINS bins a source."""
    goals = [(r.source, float(r.target_share or 0), int(r.max_repeat or 0)) for r in targets.where("source is not null").limit(most_sources + 1).collect()]
    if len(goals) > most_sources:
        raise ValueError("more target sources than most_sources")
    records = documents.select("doc_id", "source", "text").where("source is not null")
    sized = materialise(count(records, keep=("doc_id", "source"), tokenizer=tokenizer).withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(PLACES))), "p8")
    of_targets = sized.join(targets.select("source").where("source is not null").distinct(), "source", "left_semi")
    bins = materialise(of_targets.groupBy("source", F.floor(F.col("place") / (PLACES // BINS)).alias("bin")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("records")), "p8b")
    sizes_of = {r.source: (int(r.n), int(r.records)) for r in bins.groupBy("source").agg(F.sum("n").alias("n"), F.sum("records").alias("records")).collect()}
    sizes = {s: n for s, (n, _) in sizes_of.items()}
    shares, caps = {s: w for s, w, _ in goals}, {s: c for s, _, c in goals}
    want = water_fill(sizes, shares, caps, total if total is not None else sum(sizes.get(s, 0) for s in shares))
    rows = []
    for s in shares:
        size = sizes.get(s, 0)
        whole = min(int(want[s] / size + 1e-9), caps[s]) if size else 0
        rows.append((s, shares[s], caps[s], sizes_of.get(s, (0, 0))[1], size, float(want[s]), whole, float(max(0.0, want[s] - whole * size))))
    by_source = documents.sparkSession.createDataFrame(rows, PLAN)
    # the bin in which the fraction is reached, and linearly the place in it
    so_far = Window.partitionBy("source").orderBy("bin")
    run = bins.join(F.broadcast(by_source.select("source", "part")), "source").withColumn("before", F.sum("n").over(so_far) - F.col("n"))
    at = ((F.col("bin") + (F.col("part") - F.col("before")) / F.col("n")) * (PLACES // BINS)).cast("long")
    cuts = run.where("n > 0 and before < part and before + n >= part").groupBy("source").agg(F.min(at).alias("cut"))
    return of_targets, materialise(by_source.join(cuts, "source", "left").withColumn("cut", F.coalesce("cut", F.lit(0))), "p8p")


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the records used, copies at most the source's max_repeat.

    A record without a source, or of one without a target, is not used; null and empty texts have 0 tokens and follow
    their source; repeated doc_ids are drawn alike; no target or no record gives an empty mixture. `total` is the
    mixture's size in tokens, without it that of all records of target sources.
    """
    sized, p = plan(documents, targets, total, seed, tokenizer)
    by_source = p.select("source", "whole", "cut")
    copies = (F.col("whole") + (F.col("place") < F.col("cut")).cast("int")).alias("copies")
    return sized.join(F.broadcast(by_source), "source").select("doc_id", "source", "n_tokens", copies).where("copies > 0")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokenizer: str | None = None) -> DataFrame:
    """One row a target source: what was asked and what was reached."""
    sized, p = plan(documents, targets, total, seed, tokenizer)
    copies = F.col("whole") + (F.col("place") < F.col("cut")).cast("int")
    used = sized.join(F.broadcast(p), "source").groupBy("source").agg(F.sum(copies * F.col("n_tokens")).alias("used_tokens"), F.max(copies).alias("most_repeats"))
    joined = p.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    everything = joined.agg(F.sum("used_tokens").alias("_all"))
    return joined.crossJoin(F.broadcast(everything)).select(
        "source", "target_share", "max_repeat", "records", "tokens", F.col("used_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.try_divide("used_tokens", "tokens"), F.lit(0.0)).alias("repetition"), F.coalesce(F.try_divide("used_tokens", "_all"), F.lit(0.0)).alias("actual_share"),
    )
