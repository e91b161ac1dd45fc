"""Seeded generators, small models and their evaluation.

The random stream is a linear congruence, so its k-th state is an affine image of the seed: streams are columns over
spark.range, in parallel and of any length. Trainers are sequential by nature and run as one numpy group each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import vectors as V

#: The congruence and its modulus.
A, C, M = 1664525, 1013904223, 1 << 32


def _times(a: Column, b: Column) -> Column:
    """a * b mod 2^32 without leaving 64 bits."""
    hi, lo = F.shiftright(a, 16), a.bitwiseAND(0xFFFF)
    return (((hi * b) % 65536) * 65536 + lo * b) % M


def lcg_state(k: Column, seed: int) -> Column:
    """The stream's k-th state (k from 1), by binary powers of the step."""
    powers, a, c = [], A, C
    for bit in range(32):
        powers.append(F.struct(F.lit(1 << bit).cast("bigint").alias("bit"), F.lit(a).cast("bigint").alias("a"), F.lit(c).cast("bigint").alias("c")))
        a, c = a * a % M, (a * c + c) % M
    start = F.lit(seed % M).cast("bigint")
    return F.aggregate(F.array(*powers), start, lambda s, p: F.when(k.bitwiseAND(p["bit"]) != 0, (_times(s, p["a"]) + p["c"]) % M).otherwise(s))


def lcg(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(i, state, u) of the first n draws, i from 1."""
    d = spark.range(1, n + 1).select(F.col("id").alias("i"))
    return d.withColumn("state", lcg_state(F.col("i"), seed)).withColumn("u", F.col("state") / float(M))


def uniform(i: Column, draw: int, stride: int, seed: int) -> Column:
    """Draw number `draw` (from 1) of row i (from 0) where each row takes `stride` draws."""
    return lcg_state((i * stride + draw).cast("bigint"), seed) / float(M)


def normals(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(i, z): n normal draws by pairs of uniforms, i from 1; each pair gives a cosine and a sine value."""
    k = F.floor((F.col("i") - 1) / 2)
    u, v = uniform(k, 1, 2, seed), uniform(k, 2, 2, seed)
    mag = F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12))))
    angle = 2 * np.pi * v
    return spark.range(1, n + 1).select(F.col("id").alias("i")).withColumn("z", mag * F.when(F.col("i") % 2 == 1, F.cos(angle)).otherwise(F.sin(angle)))


def noisy_points(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(i, x, y, label): uniform points, the sign of a wavy score, 8 % flipped."""
    i = F.col("i")
    d = spark.range(n).select(F.col("id").alias("i"))
    d = d.withColumn("x", -2 + 4 * uniform(i, 1, 3, seed)).withColumn("y", -2 + 4 * uniform(i, 2, 3, seed)).withColumn("flip", uniform(i, 3, 3, seed) < 0.08)
    score = F.sin(2.8 * F.col("x")) + F.cos(2.2 * F.col("y")) + 0.35 * F.sin(3 * F.col("x") * F.col("y"))
    return d.withColumn("label", ((score > 0) != F.col("flip")).cast("int")).select("i", "x", "y", "label")


#: The toy language's words; the last six only follow.
TOY = ["cat", "dog", "cow", "apple", "mango", "eat", "chase", "see", "runs", "sleeps", "moves", "sweet", "ripe", "fresh"]


def toy_bigrams(spark: SparkSession, rounds: int = 900, seed: int = 21) -> DataFrame:
    """(i, input, target): three pairs a round from six draws."""
    r = F.col("r")
    pick = lambda draw, first, n: (F.lit(first) + F.floor(uniform(r, draw, 6, seed) * n)).cast("int")
    three = F.array(
        F.struct(pick(1, 0, 3).alias("input"), pick(2, 8, 3).alias("target")),
        F.struct(pick(3, 3, 2).alias("input"), pick(4, 11, 3).alias("target")),
        F.struct(pick(5, 5, 3).alias("input"), pick(6, 0, 5).alias("target")),
    )
    d = spark.range(rounds).select(F.col("id").alias("r")).select("r", F.posexplode(three).alias("k", "p"))
    return d.select((F.col("r") * 3 + F.col("k")).alias("i"), "p.input", "p.target")


def grid(spark: SparkSession, width: int, height: int, step: int) -> DataFrame:
    """(px, py): the pixels of a plot at a step."""
    axis = lambda n, name: spark.range(0, n, step).select(F.col("id").alias(name))
    return axis(width, "px").crossJoin(axis(height, "py"))


class Stream:
    """The same stream drawn one by one, with the spare normal kept: for generators that are sequential."""

    def __init__(self, seed: int):
        self.state, self.spare = seed % M, None

    def next(self) -> float:
        self.state = (A * self.state + C) % M
        return self.state / M

    def normal(self) -> float:
        if self.spare is not None:
            z, self.spare = self.spare, None
            return z
        u, v = max(self.next(), 1e-12), self.next()
        mag = np.sqrt(-2 * np.log(u))
        self.spare = mag * np.sin(2 * np.pi * v)
        return mag * np.cos(2 * np.pi * v)

    def below(self, n: int) -> int:
        return int(self.next() * n)

    def shuffle(self, xs: list) -> None:
        for k in range(len(xs) - 1, 0, -1):
            j = self.below(k + 1)
            xs[k], xs[j] = xs[j], xs[k]


def ring_points(n: int = 320, seed: int = 7) -> pd.DataFrame:
    """(i, x, y, label): an inner and an outer ring, shuffled."""
    s, rows = Stream(seed), []
    for label, count, radius, wide in ((0, n // 2, 0.72, 0.08), (1, n - n // 2, 1.55, 0.10)):
        for _ in range(count):
            angle = s.next() * np.pi * 2
            r = radius + wide * s.normal()
            x = r * np.cos(angle) + 0.025 * s.normal()
            rows.append((x, r * np.sin(angle) + 0.025 * s.normal(), label))
    s.shuffle(rows)
    return pd.DataFrame([(k, *row) for k, row in enumerate(rows)], columns=["i", "x", "y", "label"])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def evaluate(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(accuracy, loss)."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(((p >= 0.5) == (y == 1)).mean()), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit_logistic(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 1200, lr: float = 0.1):
    s = Stream(seed)
    w, b = np.array([0.1 * s.normal(), 0.1 * s.normal()]), 0.0
    for _ in range(epochs):
        d = sigmoid(x @ w + b) - y
        w, b = w - lr * (x.T @ d) / len(y), b - lr * d.mean()
    return w, b


def new_layers(sizes: list[int], s: Stream, hidden_scale=None, last_scale: float = 0.16, identity: bool = False):
    """Weights row by row from the stream, zero offsets; hidden layers scaled by fan-in, or near the identity."""
    out = []
    for k, (i, o) in enumerate(zip(sizes, sizes[1:])):
        hidden = k < len(sizes) - 2
        z = np.array([[s.normal() for _ in range(o)] for _ in range(i)])
        if identity and hidden and i == o:
            out.append([np.eye(i) + 0.02 * z, np.zeros(o)])
        else:
            scale = (np.sqrt(2 / i) if hidden_scale is None else hidden_scale) if hidden else last_scale
            out.append([scale * z, np.zeros(o)])
    return out


def forward(layers, x: np.ndarray, linear: bool = False):
    a, seen = x, [x]
    for k, (w, b) in enumerate(layers):
        z = a @ w + b
        a = sigmoid(z) if k == len(layers) - 1 else z if linear else np.maximum(z, 0)
        seen.append(a)
    return seen


def step(layers, x, y, lr: float, linear: bool = False, decay: float = 0.0) -> None:
    """One step of gradient descent over the rows given."""
    seen = forward(layers, x, linear)
    d = seen[-1] - y[:, None]
    grads = []
    for k in range(len(layers) - 1, -1, -1):
        grads.append((seen[k].T @ d / len(y), d.mean(axis=0)))
        if k:
            d = d @ layers[k][0].T
            if not linear:
                d = d * (seen[k] > 0)
    for layer, (gw, gb) in zip(layers, reversed(grads)):
        layer[0] = layer[0] - lr * (gw + decay * layer[0])
        layer[1] = layer[1] - lr * gb


def fit_dense(x, y, sizes, seed: int, epochs: int, lr: float, linear: bool = False, identity: bool = False):
    layers = new_layers(sizes, Stream(seed), 0.16 if linear else None, 0.16, identity)
    for _ in range(epochs):
        step(layers, x, y, lr, linear)
    return layers


def fit_batches(x, y, hidden: int, seed: int, steps: int, batch: int, lr: float = 0.045, decay: float = 2e-5):
    """Mini-batches drawn with replacement, weight decay; with a batch as large as the data, all rows in turn."""
    s = Stream(seed)
    layers = new_layers([2, hidden, hidden, 1], s, None, 0.1)
    n = len(y)
    batch = min(batch, n)
    for _ in range(steps):
        rows = np.arange(batch) % n if batch >= n else np.array([s.below(n) for _ in range(batch)])
        step(layers, x[rows], y[rows], lr, False, decay)
    return layers


def collapse(layers) -> tuple[np.ndarray, np.ndarray]:
    """One affine map that equals a chain of affine maps."""
    w, b = layers[0]
    for v, c in layers[1:]:
        w, b = w @ v, b @ v + c
    return w, b


def noisy_pandas(n: int, seed: int) -> pd.DataFrame:
    s, rows = Stream(seed), []
    for k in range(n):
        x, y = -2 + 4 * s.next(), -2 + 4 * s.next()
        label = int(np.sin(2.8 * x) + np.cos(2.2 * y) + 0.35 * np.sin(3 * x * y) > 0)
        rows.append((k, x, y, 1 - label if s.next() < 0.08 else label))
    return pd.DataFrame(rows, columns=["i", "x", "y", "label"])


#: Sizes, steps, batches and seeds of the gap experiment.
GAP = [(20, 1800, 20, 51), (200, 700, 64, 52), (2000, 900, 96, 53)]


def gap(spark: SparkSession) -> DataFrame:
    """(n, train_accuracy, train_loss, test_accuracy, test_loss, gap), the sizes in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, steps, batch, seed = (int(pdf[c].iloc[0]) for c in ("n", "steps", "batch", "seed"))
        train, test = noisy_pandas(n, 10 + n), noisy_pandas(800, 99)
        layers = fit_batches(train[["x", "y"]].to_numpy(), train.label.to_numpy(float), 24, seed, steps, batch)
        a, b = (evaluate(forward(layers, d[["x", "y"]].to_numpy())[-1][:, 0], d.label.to_numpy(float)) for d in (train, test))
        return pd.DataFrame([(n, *a, *b, b[1] - a[1])], columns=["n", "train_accuracy", "train_loss", "test_accuracy", "test_loss", "gap"])

    return spark.createDataFrame(GAP, "n int, steps int, batch int, seed int").groupBy("n").applyInPandas(run, "n int, train_accuracy double, train_loss double, test_accuracy double, test_loss double, gap double")


#: The ring experiments: name, sizes (none: logistic), seed, epochs, rate, linear.
RINGS = [("logistic", "", 2, 1200, 0.1, False), ("relu_16", "2,16,1", 4, 1200, 0.05, False), ("five_linear", "2,2,2,2,2,1", 5, 1200, 0.08, True), ("five_relu", "2,8,8,8,8,1", 6, 800, 0.04, False)]


def ring_models(spark: SparkSession) -> DataFrame:
    """(model, accuracy, loss, w0, w1, b): fits on the rings, in parallel; the affine ones with their weights."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        d = ring_points()
        x, y = d[["x", "y"]].to_numpy(), d.label.to_numpy(float)
        w0 = w1 = b0 = None
        if not r.sizes:
            w, b0 = fit_logistic(x, y, int(r.seed), int(r.epochs), r.rate)
            p, (w0, w1) = sigmoid(x @ w + b0), w
        else:
            layers = fit_dense(x, y, [int(k) for k in r.sizes.split(",")], int(r.seed), int(r.epochs), r.rate, bool(r.linear), bool(r.linear))
            p = forward(layers, x, bool(r.linear))[-1][:, 0]
            if r.linear:
                w, c = collapse(layers)
                w0, w1, b0 = w[0, 0], w[1, 0], c[0]
        return pd.DataFrame([(r.model, *evaluate(p, y), w0, w1, b0)], columns=["model", "accuracy", "loss", "w0", "w1", "b"])

    rows = spark.createDataFrame(RINGS, "model string, sizes string, seed int, epochs int, rate double, linear boolean")
    return rows.groupBy("model").applyInPandas(run, "model string, accuracy double, loss double, w0 double, w1 double, b double")


def fit_embeddings(seed: int = 21, rounds: int = 900, epochs: int = 44, size: int = 6, lr: float = 0.055, decay: float = 9e-4) -> np.ndarray:
    """One vector a word of the toy language, from its bigrams, a pair at a time."""
    s = Stream(seed)
    pairs = []
    for _ in range(rounds):
        pairs.append((s.below(3), 8 + s.below(3)))
        pairs.append((3 + s.below(2), 11 + s.below(3)))
        pairs.append((5 + s.below(3), s.below(5)))
    n = len(TOY)
    e = np.array([[0.03 * s.normal() for _ in range(size)] for _ in range(n)])
    w = np.array([[0.03 * s.normal() for _ in range(n)] for _ in range(size)])
    b = np.zeros(n)
    for _ in range(epochs):
        s.shuffle(pairs)
        for i, t in pairs:
            h = e[i].copy()
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[t] -= 1
            g = w @ p
            w -= lr * (np.outer(h, p) + decay * w)
            b -= lr * p
            e[i] -= lr * (g + decay * e[i])
    return e


def toy_embeddings(spark: SparkSession) -> DataFrame:
    """(word, id, embedding), learnt in one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = fit_embeddings(int(pdf.seed.iloc[0]))
        return pd.DataFrame({"id": range(len(TOY)), "word": TOY, "embedding": [list(map(float, r)) for r in e]})

    return spark.createDataFrame([(21,)], "seed int").groupBy("seed").applyInPandas(run, "id int, word string, embedding array<double>")


def covariance(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """(i, j, cov): sample covariance of every two places; null of fewer than two vectors. Each task sums its vectors'
    products into one small matrix, so what is shuffled does not grow with the rows. Null vectors are left out."""

    def run(batches):
        n, sums, products = 0, None, None
        for b in batches:
            if b.num_rows:
                m = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                n += len(m)
                sums = m.sum(axis=0) if sums is None else sums + m.sum(axis=0)
                products = m.T @ m if products is None else products + m.T @ m
        if n:
            d = len(sums)
            i, j = np.repeat(np.arange(d, dtype=np.int32), d), np.tile(np.arange(d, dtype=np.int32), d)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.full(d * d, n)), pa.array(sums[i]), pa.array(sums[j]), pa.array(products.ravel())], names=["i", "j", "n", "x", "y", "xy"])

    parts = vectors.select(F.col(col).cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "i int, j int, n long, x double, y double, xy double")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xy")])
    return total.select("i", "j", F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.col("n") - 1).alias("cov"))


def principal_two(vectors: DataFrame, id_col: str, col: str = "embedding", most_places: int = 4096) -> DataFrame:
    """(id, pc1, pc2): covariance and means in Spark, the two leading directions of that small matrix by power
    iteration, the projection in Spark again."""
    width = vectors.select(F.max(F.size(col))).first()[0] or 0
    if width > most_places:
        raise ValueError("vectors longer than most_places")
    cov = np.zeros((width, width))
    for r in covariance(vectors, col).toLocalIterator():
        cov[r.i, r.j] = r.cov or 0.0
    mean = [r.m for r in vectors.select(F.posexplode(col).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]
    norm = lambda v: v / (np.linalg.norm(v) or 1)
    v1 = np.array([1.0] + [0.13] * (width - 1)) if width else np.zeros(0)
    for _ in range(80):
        v1 = norm(cov @ v1)
    rest = cov - (v1 @ cov @ v1) * np.outer(v1, v1)
    v2 = np.full(width, -0.07)
    if width > 1:
        v2[1] = 1.0
    for _ in range(80):
        v2 = rest @ v2
        v2 = norm(v2 - (v2 @ v1) * v1)
    centred = F.zip_with(F.col(col), F.array(*map(F.lit, map(float, mean))), lambda x, m: x.cast("double") - m)
    place = lambda v: V.dot(F.col("_c"), F.array(*map(F.lit, map(float, v))))
    return vectors.select(id_col, centred.alias("_c")).select(id_col, place(v1).alias("pc1"), place(v2).alias("pc2"))


def neighbours(queries: DataFrame, vectors: DataFrame, k: int = 2, id_col: str = "vec_id", col: str = "embedding", most_queries: int = 20_000) -> DataFrame:
    """(id, neighbour, rank, similarity): the k most alike other vectors of each query, by cosine. Queries are a stated,
    bounded set; each batch of vectors keeps its k best a query, so only those are shuffled. Null vectors have none."""
    rows = queries.select(F.col(id_col).cast("long"), F.col(col).cast("array<double>")).limit(most_queries + 1).collect()
    if len(rows) > most_queries:
        raise ValueError("more queries than most_queries; take them in blocks")
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1.0, n)
    ids = np.array([r[0] for r in rows], np.int64)
    shared = queries.sparkSession.sparkContext.broadcast((ids, unit(np.array([r[1] for r in rows])) if rows else None))

    def run(batches):
        q, units = shared.value
        for b in batches:
            v = np.asarray(b.column(0))
            if not len(v) or units is None:
                continue
            m = unit(np.asarray(b.column(1).flatten()).reshape(len(v), -1))
            for at in range(0, len(q), 512):  # a block of queries at a time bounds the matrix of similarities
                s = units[at : at + 512] @ m.T
                s[q[at : at + 512, None] == v[None, :]] = -np.inf
                for r in range(len(s)):
                    best = np.lexsort((v, -s[r]))[:k] if len(v) <= 4 * k else _top(s[r], v, k)
                    best = best[s[r][best] > -np.inf]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q[at + r])), pa.array(v[best]), pa.array(s[r][best])], names=["q", "v", "similarity"])

    narrow = vectors.select(F.col(id_col).cast("long").alias("v"), F.col(col).cast("array<double>").alias("x")).where("x is not null")
    best = narrow.mapInArrow(run, "q long, v long, similarity double")
    w = Window.partitionBy("q").orderBy(F.desc("similarity"), "v")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(id_col), F.col("v").alias("neighbour"), "rank", "similarity")


def _top(s: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, ties by the smaller id."""
    least = np.partition(s, len(s) - k)[len(s) - k]
    at = np.flatnonzero(s >= least)
    return at[np.lexsort((v[at], -s[at]))[:k]]
