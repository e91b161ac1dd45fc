"""Near-duplicates: verified MinHash over runs of words, classes by connected components, or without any link missed by
shared rare runs; and vectors that are alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialise, release, ship

#: Words in a run, and the least share of runs in common.
SPAN, ALIKE = 5, 0.8
#: Six rows a band: two sets that are 0.8 alike share a bucket of sixteen with 0.992, two that are 0.5 alike with 0.22.
BANDS, ROWS = 16, 6
#: Buckets of up to so many members are compared each with each.
SMALL = 64

_rng = np.random.default_rng(11)
_A = _rng.integers(1, 1 << 61, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 61, BANDS * ROWS, dtype=np.uint64)


def shingles(words: Column) -> Column:
    """Hashes of the distinct runs of SPAN words of an array; one of the whole where it is shorter."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (SPAN - 1), F.lit(1))), lambda k: F.xxhash64(F.array_join(F.slice(words, k, SPAN), " ")))
    return F.array_distinct(runs)


def _bands(batches):
    for b in batches:
        lists = b.column(1)
        start = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
        h = np.asarray(lists.flatten()).astype(np.uint64)
        h ^= h >> np.uint64(31)
        n, bucket = len(start), []
        for k in range(0, BANDS * ROWS, ROWS):
            mixed = np.zeros(n, np.uint64)
            for x, y in zip(_A[k : k + ROWS], _B[k : k + ROWS]):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (np.minimum.reduceat(h * x + y, start) if n else mixed)
                mixed ^= mixed >> np.uint64(29)
            bucket.append(mixed.astype(np.int64))
        o = pa.concat_arrays([b.column(0)] * BANDS) if n else b.column(0)
        yield pa.RecordBatch.from_arrays([o, pa.array(np.repeat(np.arange(BANDS, dtype=np.int32), n)), pa.array(np.concatenate(bucket) if n else np.empty(0, np.int64))], names=["o", "band", "bucket"])


def links(sets: DataFrame) -> DataFrame:
    """(o, rep), rep < o, of (o, s) with distinct o and sets of hashes, none empty, that are ALIKE or more, verified;
    sets must be written.

    Members of a bucket of up to SMALL are compared each with each. In a larger one all are compared with its smallest,
    then those left unlike it with the smallest of them, and so on until no one is left: no bucket is paired whole, and a
    set that is unlike the first still meets the others.
    """
    ship(sets.sparkSession)
    banded = materialise(sets.select("o", "s").mapInArrow(_bands, "o long, band int, bucket long"), "bands")
    theirs = sets.select(F.col("o").alias("rep"), F.col("s").alias("t"))
    same = F.size(F.array_intersect("s", "t"))
    verified = lambda met: met.join(sets.select("o", "s"), "o").join(theirs, "rep").withColumn("ok", same >= ALIKE * (F.size("s") + F.size("t") - same))
    counted = banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    small = banded.join(counted.where(F.col("n") <= SMALL).select("band", "bucket"), ["band", "bucket"])
    met = small.join(small.select("band", "bucket", F.col("o").alias("rep")), ["band", "bucket"]).where("rep < o").select("o", "rep").distinct()
    out = verified(met).where("ok").select("o", "rep")
    left = materialise(banded.join(counted.where(F.col("n") > SMALL).select("band", "bucket"), ["band", "bucket"]), "hot")
    while left.limit(1).count():
        first = left.groupBy("band", "bucket").agg(F.min("o").alias("rep"))
        told = materialise(verified(left.join(first, ["band", "bucket"]).where("o <> rep")).select("band", "bucket", "o", "rep", "ok"), "told")
        out = out.unionByName(told.where("ok").select("o", "rep"))
        left = told.where("not ok").select("band", "bucket", "o")
    return out.distinct()


def postings(sets: DataFrame) -> DataFrame:
    """(x, o, n) of (o, s): of each set of n hashes those of which a set that is ALIKE has one too, also among its own.

    Of two sets that are ALIKE the larger one misses no more than n - ALIKE * n of its hashes in the other; so, with all
    hashes in one order, the first that both have is among the first n - ALIKE * n + 1 of either. The order is the rarest
    first, which keeps common hashes out; a hash of one set alone takes a place and meets nothing.
    """
    each = sets.select("o", F.size("s").alias("n"), F.explode("s").alias("x"))
    again = each.groupBy("x").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    rare = each.join(again, "x").groupBy("o", "n").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("r"))
    first = F.size("r") - F.ceil(ALIKE * F.col("n")).cast("int") + 1
    return rare.where(first > 0).select(F.explode(F.slice("r", 1, first)).alias("r"), "o", "n").select("r.x", "o", "n")


def classes(sets: DataFrame) -> DataFrame:
    """(o, cluster) of each o of (o, s), distinct and written, that is linked to another: by the smallest o to which
    links lead, two sets being linked if they are ALIKE or more. No link is missed.

    All pairs of a posting are compared. Where one has more than SMALL members they are compared with its smallest first;
    then only members of different classes are, since between those of one no link is needed.
    """
    mine, theirs = sets.select("o", "s"), sets.select(F.col("o").alias("rep"), F.col("s").alias("t"))
    same = F.size(F.array_intersect("s", "t"))
    verified = lambda met: met.distinct().join(mine, "o").join(theirs, "rep").where(same >= ALIKE * (F.size("s") + F.size("t") - same)).select("o", "rep")
    near = materialise(postings(sets), "postings")
    hot = near.groupBy("x").agg(F.count(F.lit(1)).alias("m"), F.min("o").alias("rep")).where(F.col("m") > SMALL).select("x", "rep")
    stars = materialise(verified(near.join(hot, "x").where("o <> rep").select("o", "rep")), "stars")
    found, member = stars, near.withColumn("c", F.col("o"))
    if stars.limit(1).count():
        member = near.join(components(stars).withColumnRenamed("cluster", "c"), "o", "left").withColumn("c", F.coalesce("c", "o"))
    member = materialise(member, "members")
    group = member.select("x", "c").distinct()
    apart = group.join(group.select("x", F.col("c").alias("d")), "x").where("c < d")
    other = member.select("x", F.col("o").alias("rep"), F.col("n").alias("k"), F.col("c").alias("d"))
    met = apart.join(member, ["x", "c"]).join(other, ["x", "d"]).where(F.least("n", "k") >= ALIKE * F.greatest("n", "k")).select("o", "rep")
    found = materialise(found.unionByName(verified(met)), "edges")
    return components(found) if found.limit(1).count() else found.select("o", F.col("rep").alias("cluster"))


def components(edges: DataFrame) -> DataFrame:
    """(o, cluster) of every o in (o, rep), by the smallest member. Labels go along the links until they stay, each round
    also from label to label, so rounds grow with the logarithm of a chain. edges must be written."""
    both = edges.unionByName(edges.select(F.col("rep").alias("o"), F.col("o").alias("rep")))
    label = materialise(both.select("o", F.col("o").alias("cluster")).distinct(), "labels")
    while True:
        near = both.join(label.select(F.col("o").alias("rep"), F.col("cluster").alias("c")), "rep").groupBy("o").agg(F.min("c").alias("c"))
        nxt = label.join(near, "o").select("o", F.least("cluster", "c").alias("next"), "cluster")
        jump = label.select(F.col("o").alias("next"), F.col("cluster").alias("far"))
        nxt = materialise(nxt.join(jump, "next").select("o", F.least("next", "far").alias("next"), "cluster"), "labels")
        release(label)
        if not nxt.where("next < cluster").limit(1).count():
            return nxt.select("o", "cluster")
        label = materialise(nxt.select("o", F.col("next").alias("cluster")), "labels")
        release(nxt)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: str | None = None) -> DataFrame:
    """(id, class_id, links, copies) of each row with a word: the smallest id of its class, to how many different texts
    its text is linked, and how many rows have the same words. With `within`, only rows of an equal value (or of none)
    are compared.

    Rows of the same words are one text, whatever their number; only classes of different texts are compared. Null texts
    and texts without a word are left out.
    """
    group = F.col(within).cast("string") if within else F.lit(None).cast("string")
    words = F.regexp_extract_all(F.lower("_text"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    d = df.select(F.col(id_col).cast("long").alias("_id"), group.alias("_group"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    d = d.select("_id", "_group", words.alias("w")).where("size(w) > 0")
    d = d.select("_id", F.xxhash64("_group").alias("g"), F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(3), "w").alias("k2"), F.transform(shingles(F.col("w")), lambda x: F.xxhash64(F.col("_group"), x) if within else x).alias("s"))
    d = materialise(d, "words")
    key = ["g", "k1", "k2"]
    firsts = materialise(d.groupBy(*key).agg(F.min("_id").alias("o"), F.count(F.lit(1)).alias("copies")), "firsts")
    sets = materialise(d.select(F.col("_id").alias("o"), "s").join(firsts.select("o"), "o", "left_semi"), "sets")
    edges = materialise(links(sets), "edges")
    degree = edges.select(F.explode(F.array("o", "rep")).alias("o")).groupBy("o").agg(F.count(F.lit(1)).alias("links"))
    told = firsts.join(components(edges), "o", "left").join(degree, "o", "left")
    told = told.select(*key, F.coalesce("cluster", "o").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    return d.select("_id", *key).join(told, key).select(F.col("_id").alias(id_col), "class_id", "links", "copies")


def alike_vectors(queries: DataFrame, vectors: DataFrame, least: float, id_col: str = "vec_id", col: str = "embedding", label: str = "label", most_queries: int = 20_000) -> DataFrame:
    """(id, other, similarity): vectors of another label whose cosine with a query's is `least` or more, all of them.
    Queries are a stated, bounded set, compared in blocks with every vector; null vectors have none."""
    rows = queries.select(F.col(id_col).cast("long"), F.col(col).cast("array<double>"), F.col(label).cast("string")).where(F.col(col).isNotNull()).limit(most_queries + 1).collect()
    if len(rows) > most_queries:
        raise ValueError("more queries than most_queries; take them in blocks")
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1.0, n)
    shared = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), unit(np.array([r[1] for r in rows])) if rows else None, np.array([r[2] for r in rows], object)))

    def run(batches):
        q, units, labels = shared.value
        for b in batches:
            v = np.asarray(b.column(0))
            if not len(v) or units is None:
                continue
            m, of = unit(np.asarray(b.column(1).flatten()).reshape(len(v), -1)), np.array(b.column(2).to_pylist(), object)
            for at in range(0, len(q), 512):  # a block of queries at a time bounds the matrix of similarities
                s = units[at : at + 512] @ m.T
                i, j = np.nonzero((s >= least) & (labels[at : at + 512, None] != of[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(q[at + i]), pa.array(v[j]), pa.array(s[i, j])], names=["q", "other", "similarity"])

    narrow = vectors.select(F.col(id_col).cast("long").alias("v"), F.col(col).cast("array<double>").alias("x"), F.col(label).cast("string").alias("l")).where("x is not null")
    return narrow.mapInArrow(run, "q long, other long, similarity double").withColumnRenamed("q", id_col)
