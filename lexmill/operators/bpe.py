"""Byte-pair tokenizers: pre-tokens, weighted word counts, learning of merges, encoding with byte fallback, decoding.

Spark counts words; merges are learnt over the distinct words with incremental pair counts, in one place since each
merge depends on the last. Encoding and decoding run in Arrow batches with a table of known words.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.session import materialise

SPACE = "▁"
BYTES = [f"<0x{b:02X}>" for b in range(256)]


def space_pretokens(c: Column) -> Column:
    """Spaces as a visible sign before each word, one put in front; pieces start at the sign; other white space stays
    inside words; an empty text has none."""
    t = F.replace(c, F.lit(" "), F.lit(SPACE))
    t = F.when(t.startswith(SPACE), t).otherwise(F.concat(F.lit(SPACE), t))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(t, F.lit(f"{SPACE}[^{SPACE}]*"), F.lit(0)))


#: What belongs to a word: alphabetic characters (circled letters too), marks, digits, connectors, joiners; and white space.
WORD = r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}"
BLANK = r"\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def word_pretokens(c: Column) -> Column:
    """Runs of word characters and runs of other visible ones."""
    return F.regexp_extract_all(c, F.lit(f"[{WORD}]+|[^{WORD}{BLANK}]+"), F.lit(0))


def lossy_pretokens(c: Column) -> Column:
    """NFKC, everything but letters, marks and numbers as a space, then word pre-tokens."""
    return word_pretokens(T.others_to_space(T.nfkc(c)))


def lines(c: Column) -> Column:
    """Lines with their end."""
    return F.regexp_extract_all(c, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


def word_counts(corpus: DataFrame, weights: DataFrame | None = None, pretokens=space_pretokens, by_line: bool = True) -> DataFrame:
    """(word, n): how often each pre-token occurs, times its language's weight. A weight multiplies counts as so many
    copies of the text would; a null weight, or none, counts 1."""
    d = corpus.select("lang", "text").where("text is not null")
    if weights is not None:
        d = d.join(weights.select("lang", F.coalesce("weight", F.lit(1)).alias("weight")), "lang", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    else:
        d = d.withColumn("weight", F.lit(1))
    if by_line:
        d = d.select("weight", F.explode(lines(F.col("text"))).alias("text"))
    return d.select("weight", F.explode(pretokens(F.col("text"))).alias("word")).groupBy("word").agg(F.sum(F.col("weight").cast("bigint")).alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """(left, right, n): adjacent characters over all words, the first step of learning."""
    cs = F.filter(F.split("word", ""), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("left"), F.element_at("c", i + 1).alias("right")))
    d = counts.select("n", cs.alias("c")).where("size(c) > 1").select("n", F.explode(pairs).alias("p"))
    return d.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def learn(counts: Iterable[tuple[str, int]], vocab_size: int, specials: list[str] = BYTES, min_frequency: int = 1) -> tuple[list[str], list[tuple[str, str]]]:
    """(tokens by id, merges by rank). Ids: specials, then the alphabet by code point, then merges; the most frequent
    pair is merged first, ties by the pair of ids."""
    words = [(w, n) for w, n in counts if w]
    token_id = {s: k for k, s in enumerate(specials)}
    for c in sorted({c for w, _ in words for c in w}):
        token_id.setdefault(c, len(token_id))
    names = list(token_id)
    seqs = [[token_id[c] for c in w] for w, _ in words]
    freq = [n for _, n in words]
    total: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, s in enumerate(seqs):
        for p in zip(s, s[1:]):
            total[p] += freq[k]
            where[p].add(k)
    heap = [(-n, p) for p, n in total.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while len(names) < vocab_size and heap:
        n, pair = heapq.heappop(heap)
        if total.get(pair, 0) != -n:
            if total.get(pair, 0) > 0:
                heapq.heappush(heap, (-total[pair], pair))
            continue
        if -n < max(1, min_frequency):
            break
        a, b = pair
        name = names[a] + names[b]
        new = token_id.get(name)
        if new is None:
            new = token_id[name] = len(names)
            names.append(name)
        merges.append((names[a], names[b]))
        touched = set()
        for k in where.pop(pair):
            s, out, i = seqs[k], [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            if len(out) == len(s):
                continue
            for p in zip(s, s[1:]):
                total[p] -= freq[k]
                touched.add(p)
            for p in zip(out, out[1:]):
                total[p] += freq[k]
                where[p].add(k)
                touched.add(p)
            seqs[k] = out
        total.pop(pair, None)
        for p in touched:
            if p != pair and total.get(p, 0) > 0:
                heapq.heappush(heap, (-total[p], p))
    return names, merges


class Encoder:
    """Lowest-ranked merge first, all its occurrences from the left; what the vocabulary lacks falls back to bytes."""

    def __init__(self, tokens: list[str], merges: list[tuple[str, str]], unknown: str | None = None):
        self.tokens, self.unknown = tokens, unknown
        self.id = {t: k for k, t in enumerate(tokens)}
        self.rank = {m: k for k, m in enumerate(merges)}
        self.known: dict[str, list[str]] = {}

    def word(self, word: str) -> list[str]:
        got = self.known.get(word)
        if got is not None:
            return got
        s = self.merged(word)
        got = []
        for t in s:
            got += [t] if t in self.id else [self.unknown] if self.unknown else [BYTES[b] for b in t.encode("utf-8")]
        if len(self.known) < 500_000:
            self.known[word] = got
        return got

    def merged(self, word: str) -> list[str]:
        """The word's pieces: a queue of the pairs that have a rank, over a chain of pieces; of equal ranks the leftmost
        first. A pair is stale if one of its pieces has been merged since. The work grows with n log n."""
        piece: list[str | None] = list(word)
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        queue = [(r, k, piece[k], piece[k + 1]) for k in range(n - 1) if (r := rank((piece[k], piece[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, left, right = heapq.heappop(queue)
            j = after[k] if piece[k] == left else n
            if j >= n or piece[j] != right:
                continue
            piece[k], piece[j] = left + right, None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := rank((piece[k], piece[after[k]]))) is not None:
                    heapq.heappush(queue, (r, k, piece[k], piece[after[k]]))
            h = before[k]
            if h >= 0 and (r := rank((piece[h], piece[k]))) is not None:
                heapq.heappush(queue, (r, h, piece[h], piece[k]))
        return [t for t in piece if t is not None]

    def decode(self, tokens: list[str]) -> str:
        """Byte tokens joined as UTF-8 (an invalid run gives one replacement sign a byte), signs as spaces, the first
        space dropped."""
        out, raw = [], bytearray()

        def flush():
            if raw:
                try:
                    out.append(raw.decode("utf-8"))
                except UnicodeDecodeError:
                    out.append("�" * len(raw))
                raw.clear()

        for t in tokens:
            if re.fullmatch("<0x[0-9A-F]{2}>", t):
                raw.append(int(t[3:5], 16))
            else:
                flush()
                out.append(t)
        flush()
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


#: Distinct words that learning takes at most; merges depend on one another, so they are learnt in one place.
MOST_WORDS = 5_000_000


def bounded_words(counts: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """The counts, written once, if they are no more than most_words; else an error before any word leaves the cluster."""
    counts = materialise(counts, "words")
    n = counts.count()
    if n > most_words:
        raise ValueError(f"{n} distinct words, more than {most_words}")
    return counts


def train(corpus: DataFrame, weights: DataFrame | None, vocab_size: int, pretokens=space_pretokens, specials: list[str] = BYTES, most_words: int = MOST_WORDS) -> Encoder:
    """An encoder from weighted word counts; the distinct words, not the corpus, come to the driver."""
    counts = [(r.word, r.n) for r in bounded_words(word_counts(corpus, weights, pretokens), most_words).orderBy("word").toLocalIterator()]
    tokens, merges = learn(counts, vocab_size, specials)
    return Encoder(tokens, merges, "[UNK]" if "[UNK]" in specials else None)


def best_merges(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(word, at, left, right, rank): the first merge of each word, i.e. its adjacent pair of the lowest rank, the leftmost
    of equal ones, by one join of pairs with the merge table (left, right, rank). Words without a ranked pair are left
    out."""
    cs = F.filter(F.split("word", ""), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(i.alias("at"), F.element_at("c", i).alias("left"), F.element_at("c", i + 1).alias("right")))
    d = counts.select("word", cs.alias("c")).where("size(c) > 1").select("word", F.inline(pairs))
    best = d.join(ranks, ["left", "right"]).groupBy("word").agg(F.min(F.struct("rank", "at", "left", "right")).alias("m"))
    return best.select("word", "m.at", "m.left", "m.right", "m.rank")


def vocabulary(spark, encoder: Encoder) -> DataFrame:
    """(id, token, is_byte)."""
    return spark.createDataFrame([(k, t, t in set(BYTES)) for k, t in enumerate(encoder.tokens)], "id int, token string, is_byte boolean")


def merge_table(spark, encoder: Encoder) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for (a, b), k in encoder.rank.items()], "rank int, left string, right string")


def encode(df: DataFrame, encoder: Encoder, text_col: str = "text", pretokens=space_pretokens) -> DataFrame:
    """The other columns and (tokens, decoded) of each text."""
    shared = df.sparkSession.sparkContext.broadcast(encoder)
    rest = [c for c in df.columns if c != text_col]
    d = df.select(*rest, F.col(text_col), pretokens(F.col(text_col)).alias("_pre"))

    def run(batches):
        for b in batches:
            e = shared.value
            toks = [None if pre is None else [t for w in pre for t in e.word(w)] for pre in b.column(b.num_columns - 1).to_pylist()]
            texts = [None if t is None else e.decode(t) for t in toks]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(toks, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "tokens", "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{fields}, tokens array<string>, decoded string")


def measured(corpus: DataFrame, encoder: Encoder, pretokens=space_pretokens) -> DataFrame:
    """(lang, tokens, wordish_units, unk) of each corpus row; units are those of the raw text."""
    e = encode(corpus.select("lang", "text").where("text is not null"), encoder, pretokens=pretokens)
    return e.select("lang", F.size("tokens").cast("bigint").alias("tokens"), T.units(F.col("text")).alias("wordish_units"), F.size(F.filter("tokens", lambda t: t == "[UNK]")).cast("bigint").alias("unk"))


def sweep(corpus: DataFrame, grid: DataFrame, vocab_size: int, most_words: int = MOST_WORDS) -> DataFrame:
    """(config, lang, tokens, wordish_units, ratio): a tokenizer learnt for each row of weights (a column a language),
    configurations in parallel. Word counts by language are shared by all, whole texts' word counts measure them."""
    langs = [c for c in grid.columns if c != "config"]
    texts = corpus.where(F.col("lang").isin(langs) & F.col("text").isNotNull())
    by_line = texts.select("lang", F.explode(lines(F.col("text"))).alias("text")).select("lang", F.explode(space_pretokens(F.col("text"))).alias("word"))
    counted = lambda d: bounded_words(d.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), most_words)
    count = lambda d: [(r.lang, r.word, r.n) for r in counted(d).orderBy("lang", "word").toLocalIterator()]
    learnt, whole = count(by_line), count(texts.select("lang", F.explode(space_pretokens(F.col("text"))).alias("word")))
    units = {r.lang: r.u for r in texts.groupBy("lang").agg(F.sum(T.units(F.col("text"))).alias("u")).collect()}
    shared = corpus.sparkSession.sparkContext.broadcast((learnt, whole, units))

    def run(_, pdf):
        import pandas as pd

        words, full, u = shared.value
        weight = {c: int(pdf[c].iloc[0]) for c in langs}
        total: dict[str, int] = defaultdict(int)
        for c, w, n in words:
            total[w] += weight[c] * n
        e = Encoder(*learn(sorted(total.items()), vocab_size))
        tokens: dict[str, int] = defaultdict(int)
        for c, w, n in full:
            tokens[c] += n * len(e.word(w))
        return pd.DataFrame([(int(pdf["config"].iloc[0]), c, tokens[c], u.get(c, 0)) for c in langs], columns=["config", "lang", "tokens", "wordish_units"])

    spread = grid.repartition(max(1, grid.count()), "config")  # a configuration is a task's worth of work
    got = spread.groupBy("config").applyInPandas(lambda pdf: run(None, pdf), "config long, lang string, tokens long, wordish_units long")
    return got.withColumn("ratio", F.try_divide(F.col("tokens").cast("double"), F.col("wordish_units")))
