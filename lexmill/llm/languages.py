"""Problem 1: missing or wrong document language labels.

A linear-chain conditional random field labels the words of each paragraph: features of a word are its affixes and
character n-grams and the word itself (lexicon), transitions are learned, forward-backward gives every word's
posterior. It is trained here, on a bounded sample of labelled rows whose noisy labels are first checked by a naive
Bayes pass over the same features, with stretches of different languages joined so that switches are seen.
Inference is numpy over many paragraphs at once; a word's emission scores are computed once a worker.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.base import arrow_map, ranges
from lexmill.llm.lookalikes import canonical, skeleton

LANGS = ("en", "hi", "mai", "sa", "te", "ta", "de", "fr", "es", "pt", "ru", "zh")
INDEX = {c: k for k, c in enumerate(LANGS)}
#: How a language is named in other conventions (three letters, English name).
NAMES = {
    "en": ("eng", "english"), "hi": ("hin", "hindi"), "mai": ("maithili",), "sa": ("san", "sanskrit"), "te": ("tel", "telugu"), "ta": ("tam", "tamil"), "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"), "es": ("spa", "spanish", "castilian"), "pt": ("por", "portuguese"), "ru": ("rus", "russian"), "zh": ("zho", "chi", "chinese", "cmn", "mandarin"),
}
BY_NAME = {n: c for c, names in NAMES.items() for n in (c, *names)}
#: Labels that say nothing.
NOTHING = {"", "und", "xx", "n/a", "na", "unknown", "none", "null", "mul", "zxx", "mis", "-", "?"}
#: Rows of each language, at most about, that training sees; and sentences of each.
SAMPLE_ROWS, SAMPLE_SENTENCES = 500, 1500
MIN_WORDS = 3
#: A sentence of fewer words counts if its confidence is above this: one or two names tell no language.
SURE_SHORT = 0.97
#: A sentence of less confidence counts only where its text has no better one.
SURE = 0.6

MARKUP = re.compile(
    r"<\|im_start\|>\s*system[ \t\r]*\n.*?(?:<\|im_end\|>|\Z)|<\|im_start\|>[ \t]*\w*|<\|im_end\|>|```.*?(?:```|(?=<\|im_end\|>)|\Z)|(?m:^[ \t>]*\|.*$)|</?think>|`[^`\n]*`|https?://\S+|\{[^{}]*\}",
    re.S | re.I,
)
CONTACT = re.compile(r"\S+@\S+|\S+\s?[(\[]at[)\]]\s?\S+")
HARD, STOP = 0, 1


@lru_cache(None)
def tokens() -> re.Pattern:
    import unicodedata

    marks = ranges(lambda c: unicodedata.category(c)[0] == "M", 0x10000)
    return re.compile(rf"[㐀-鿿]|[^\W\d_]+(?:[{marks}­​-‍⁠]+[^\W\d_]*)*|\n|[।॥。！？．]|(?<!\W[^\W\d_])[.!?…]+(?=[\s\"”’»)<*]|$)")


def code_of(label: str | None) -> str | None:
    """The language a label names, whatever its convention; None where it names none; unknown names as they are."""
    if label is None:
        return None
    s = label.strip().lower()
    if s in NOTHING:
        return None
    base = re.split(r"[-_ (]", s)[0]
    return BY_NAME.get(s) or BY_NAME.get(base) or (None if base in NOTHING else base)


def stripped(text: str) -> str:
    """The text without system turns, code, tables, markup and contact data."""
    text = MARKUP.sub("\n", text)
    if "@" in text or "at)" in text or "at]" in text:
        text = CONTACT.sub(" ", text)
    return text


def grams(word: str) -> list[str]:
    """A word's features: n-grams with its ends marked (so affixes too), and the word as a lexicon entry."""
    if not word.isascii():
        word = canonical(word, alike=False)
        if re.search(r"[a-z]", word) and re.search(r"[Ͱ-ϿЀ-ӿ]", word):
            word = skeleton(word)
    p = f"^{word}$"
    n = len(p)
    out = [p[i : i + 2] for i in range(n - 1)]
    out += [p[i : i + 3] for i in range(n - 2)]
    out += [p[i : i + 4] for i in range(n - 3)]
    out += list(word)
    out.append("=" + word)
    return out


class Tagger:
    """Weights by feature, transitions and start scores, all in log space; float32."""

    def __init__(self, feature: dict[str, int], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.feature, self.weights, self.transitions, self.start = feature, weights, transitions, start

    def __getstate__(self):
        return self.feature, self.weights, self.transitions, self.start

    def __setstate__(self, s):
        self.feature, self.weights, self.transitions, self.start = s
        self.reset()

    def reset(self):
        self.word: dict[str, int] = {"\n": HARD}
        for c in "।॥。！？．":
            self.word[c] = STOP
        self.emission = np.zeros((1024, len(LANGS)), np.float32)
        self.size = 2

    def learn(self, new: list[str]) -> None:
        """Adds emission scores of words not met before."""
        get, idx, starts = self.feature.get, [], []
        for w in new:
            starts.append(len(idx))
            idx.extend([k for g in grams(w) if (k := get(g)) is not None])
            idx.append(0)  # feature 0 is no feature
        scores = np.add.reduceat(self.weights[np.array(idx)], np.array(starts), axis=0)
        while self.size + len(new) > len(self.emission):
            self.emission = np.concatenate([self.emission, np.zeros_like(self.emission)])
        self.emission[self.size : self.size + len(new)] = scores
        self.size += len(new)

    def ids(self, words: list[str]) -> np.ndarray:
        if self.size > 400_000:
            self.reset()
        word, new = self.word, []
        got = list(map(word.get, words))
        if None in got:
            for k, i in enumerate(got):
                if i is None:
                    w = words[k]
                    i = word.get(w)
                    if i is None:
                        if w[0] in ".!?…":
                            i = word[w] = STOP
                        else:
                            i = word[w] = self.size + len(new)
                            new.append(w)
                    got[k] = i
            if new:
                self.learn(new)
        return np.array(got, np.int64)

    def posteriors(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward over sequences laid end to end; rows of the result as those of emission."""
        e = np.exp(emission - emission.max(axis=1, keepdims=True))
        return forward_backward(e, lengths, np.exp(self.transitions), np.exp(self.start))


def forward_backward(e: np.ndarray, lengths: np.ndarray, t: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posteriors of words (and expected transition counts). Longest sequences first, so each step is one slice."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")
    at = [begin[:a] + k for k, a in enumerate(active)]
    alpha = np.empty_like(e)
    for k in range(steps):
        a = e[at[k]]
        a *= start if k == 0 else alpha[at[k] - 1] @ t
        a /= a.sum(axis=1, keepdims=True)
        alpha[at[k]] = a
    post = alpha.copy()
    counts = np.zeros_like(t)
    if steps:
        beta = np.ones((active[-1], e.shape[1]), e.dtype)
        back = t.T.copy()
        for k in range(steps - 1, 0, -1):
            right = e[at[k]] * beta
            if pairs:
                left = alpha[at[k] - 1]
                norm = ((left @ t) * right).sum(axis=1, keepdims=True)
                counts += t * (left.T @ (right / norm))
            b = right @ back
            b /= b.sum(axis=1, keepdims=True)
            beta = np.ones((active[k - 1], e.shape[1]), e.dtype)
            beta[: len(b)] = b
            p = alpha[at[k - 1]] * beta
            p /= p.sum(axis=1, keepdims=True)
            post[at[k - 1]] = p
    return (post, counts) if pairs else post


def sentences(text: str) -> list[list[str]]:
    """Words of each whole sentence of a stripped text: what ends with a sentence's mark on its line."""
    out, now = [], []
    for w in tokens().findall(stripped(text).lower()):
        if w == "\n":
            now = []
        elif w[0] in ".!?…।॥。！？．":
            if len(now) >= MIN_WORDS:
                out.append(now)
            now = []
        else:
            now.append(w)
    return out


def fit(rows: list[tuple[str, str]], seed: int = 5, rounds: int = 40) -> Tagger:
    """A tagger from (language, text) rows; labels may be wrong here and there."""
    rng = np.random.default_rng(seed)
    by_doc = [(INDEX[c], s) for c, t in rows if c in INDEX and (s := sentences(t))]
    n = len(LANGS)
    words: dict[str, int] = {}
    feature: dict[str, int] = {"": 0}
    idx, starts = [], []

    def ids(sentence):
        out = []
        for w in sentence:
            k = words.get(w)
            if k is None:
                k = words[w] = len(words)
                starts.append(len(idx))
                idx.extend(feature.setdefault(g, len(feature)) for g in grams(w))
            out.append(k)
        return out

    docs = [(c, [ids(s) for s in ss]) for c, ss in by_doc]
    if not docs:
        z = np.zeros((1, n), np.float32)
        t = Tagger(feature, z, np.zeros((n, n), np.float32), np.zeros(n, np.float32))
        t.reset()
        return t
    cols, first = np.array(idx), np.array(starts)
    owner = np.repeat(np.arange(len(words)), np.diff([*starts, len(idx)]))
    # naive Bayes over lexicon words checks the labels: wrong ones and sentences of other languages leave
    seen = np.zeros((len(words), n))
    for c, ss in docs:
        for s in ss:
            np.add.at(seen[:, c], s, 1)
    for _ in range(2):
        logp = np.log((seen + 0.05) / (seen.sum(axis=0) + 0.05 * len(words)))
        kept: list[list[list[int]]] = [[] for _ in LANGS]
        seen = np.zeros_like(seen)
        for c, ss in docs:
            whole = sum(logp[s].sum(axis=0) for s in ss)
            if int(np.argmax(whole)) != c:
                continue
            for s in ss:
                if int(np.argmax(logp[s].sum(axis=0))) == c:
                    kept[c].append(s)
                    np.add.at(seen[:, c], s, 1)
    for c in range(n):
        if len(kept[c]) > SAMPLE_SENTENCES:
            kept[c] = [kept[c][k] for k in rng.permutation(len(kept[c]))[:SAMPLE_SENTENCES]]
    # sequences of one to three stretches; a language's share is levelled
    stretches = [(c, ss[k : k + 2]) for c, ss in enumerate(kept) for k in range(0, len(ss), 2)]
    order, x, y, lengths = rng.permutation(len(stretches)), [], [], []
    k = 0
    while k < len(order):
        take = int(rng.integers(1, 4))
        m = 0
        for j in order[k : k + take]:
            c, ss = stretches[j]
            for s in ss:
                x.extend(s), y.extend([c] * len(s))
                m += len(s)
        lengths.append(m)
        k += take
    x, y, lengths = np.array(x), np.array(y), np.array(lengths)
    w = np.zeros((len(feature), n))
    trans, start = np.zeros((n, n)), np.zeros(n)
    follows = np.ones(len(x), bool)
    follows[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(follows)
    true_t = np.zeros((n, n))
    np.add.at(true_t, (y[at - 1], y[at]), 1)
    true_w = np.zeros((len(words), n))
    np.add.at(true_w, (x, y), 1)
    heads = np.cumsum(lengths) - lengths
    true_s = np.bincount(y[heads], minlength=n)
    gw, gt, gs = np.full_like(w, 1e-2), np.full_like(trans, 1e-2), np.full_like(start, 1e-2)
    pieces = []  # of the words, so that the driver never holds all features' weights at once
    for k in range(0, len(words), 2000):
        f = first[k : k + 2000]
        pieces.append((int(f[0]), int(first[k + 2000]) if k + 2000 < len(words) else len(cols), f))
    for _ in range(rounds):  # full-batch adaptive gradient
        per_word = np.concatenate([np.add.reduceat(w[cols[a:b]], f - a, axis=0) for a, b, f in pieces])
        scores = per_word[x]
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        post, counts = forward_backward(e, lengths, np.exp(trans), np.exp(start), pairs=True)
        mine = np.stack([np.bincount(x, weights=post[:, c], minlength=len(words)) for c in range(n)], axis=1)
        d = true_w - mine
        grad = np.stack([np.bincount(cols, weights=d[owner, c], minlength=len(feature)) for c in range(n)], axis=1) - 0.05 * w
        gw += grad * grad
        w += 0.5 * grad / np.sqrt(gw)
        dt = true_t - counts - 0.05 * trans
        gt += dt * dt
        trans += 0.3 * dt / np.sqrt(gt)
        ds = true_s - post[heads].sum(axis=0) - 0.05 * start
        gs += ds * ds
        start += 0.3 * ds / np.sqrt(gs)
    w[0] = 0
    t = Tagger(feature, w.astype(np.float32), trans.astype(np.float32), start.astype(np.float32))
    t.reset()
    return t


def code_column(label: Column) -> Column:
    """code_of as an expression, for labels that name one of LANGS; null for all others."""
    known = F.create_map(*[F.lit(x) for pair in BY_NAME.items() for x in pair])
    name = F.lower(F.trim(label))
    return F.coalesce(known[name], known[F.split(name, r"[-_ (]")[0]])


def labelled(df: DataFrame, text_col: str = "text", label_col: str = "lang_label", id_col: str = "ord", rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows: about `rows` of each language, drawn by a hash of the id."""
    coded = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), code_column(F.col(label_col).cast("string")).alias("_code"))
    counts = {r[0]: r[1] for r in coded.where("_code is not null").groupBy("_code").count().collect()}  # at most a row a language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, rows / n)])[F.col("_code")]
    place = F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1_000_003)) / 1_000_003.0
    got = coded.where("_code is not null").where(F.col("_text").isNotNull() & (place < share)).select("_code", "_text").limit(3 * rows * len(LANGS)).collect()
    return sorted((r[0], r[1]) for r in got)


#: Taggers fitted in this session, by the plan of the table they were fitted on; the last few.
_FITTED: dict[tuple, Tagger] = {}


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang_label", id_col: str = "ord") -> Tagger:
    """A tagger fitted on a table's sample; one table of files gives it once a session."""
    files = df._jdf.inputFiles()  # stays in the JVM: a large table has many
    if not len(files):
        return fit(labelled(df, text_col, label_col, id_col))
    key = (df.sparkSession.sparkContext.applicationId, df.select(id_col, text_col, label_col).semanticHash(), len(files), files[0])
    if key not in _FITTED:
        while len(_FITTED) > 3:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[key] = fit(labelled(df, text_col, label_col, id_col))
    return _FITTED[key]


def save(tagger: Tagger, spark: SparkSession, path: str) -> None:
    """The model as a table of one row a feature, and its transitions and start scores under the names of languages."""
    rows = [("feature", f, [float(x) for x in tagger.weights[k]]) for f, k in tagger.feature.items()]
    rows += [("transition", c, [float(x) for x in tagger.transitions[k]]) for c, k in INDEX.items()] + [("start", "", [float(x) for x in tagger.start])]
    spark.createDataFrame(rows, "part string, name string, weights array<float>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, most_features: int = 2_000_000) -> Tagger:
    """A saved model; its size is bounded by the sample it was fitted on, and refused above most_features."""
    rows = spark.read.parquet(path).limit(most_features + 100).collect()
    if len(rows) > most_features:
        raise ValueError("more features than most_features")
    names = ["", *sorted(r.name for r in rows if r.part == "feature" and r.name)]
    of = {(r.part, r.name): r.weights for r in rows}
    t = Tagger({f: k for k, f in enumerate(names)}, np.array([of["feature", f] for f in names], np.float32), np.array([of["transition", c] for c in LANGS], np.float32), np.array(of["start", ""], np.float32))
    t.reset()
    return t


def tag_texts(tagger: Tagger, texts: list[str | None]):
    """Over a batch: (text number of each sentence, its words, its language, its confidence, whole?)."""
    find, lists, sizes = tokens().findall, [], []
    for t in texts:
        w = find(stripped(t).lower()) if t else []
        w.append("\n")
        lists.extend(w)
        sizes.append(len(w))
    i = tagger.ids(lists)
    return of_ids(tagger, i, np.repeat(np.arange(len(texts)), sizes))


def of_ids(tagger: Tagger, i: np.ndarray, doc: np.ndarray):
    hard, stop = i == HARD, i == STOP
    is_word = ~(hard | stop)
    line = np.cumsum(hard) - hard
    at = np.flatnonzero(is_word)
    if not len(at):
        z = np.empty(0, np.int64)
        return z, z, z, z.astype(np.float32), z.astype(bool)
    lengths = np.unique(line[at], return_counts=True)[1]
    post = tagger.posteriors(tagger.emission[i[at]], lengths)
    # sentence number: a new one after each stop or line end
    part = np.cumsum(~is_word) - (~is_word)
    mine = part[at]
    first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
    n = np.diff(np.concatenate([first, [len(at)]]))
    mean = np.add.reduceat(post, first, axis=0) / n[:, None]
    ends = np.flatnonzero(~is_word)
    whole = stop[ends[np.searchsorted(ends, at[first], "left")]]
    best = mean.argmax(axis=1)
    return doc[at[first]], n, best, mean[np.arange(len(best)), best], whole


def spoken(tagger: Tagger, texts: list[str]) -> list[dict[int, int]]:
    """Words by language of each text, told sentence by sentence from the words' scores alone; sentences that fit two
    languages about as well are left out, and so are fragments of fewer than MIN_WORDS words."""
    find, lists, sizes = tokens().findall, [], []
    for t in texts:
        s = stripped(t)
        w = find((s if re.search(r"[^\W\d_]{2}", s) else t).lower())
        w.append("\n")
        lists.extend(w)
        sizes.append(len(w))
    out: list[dict[int, int]] = [{} for _ in texts]
    i = tagger.ids(lists)
    is_word = i > STOP
    at = np.flatnonzero(is_word)
    if not len(at):
        return out
    part = (np.cumsum(~is_word) - (~is_word))[at]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    n = np.diff(np.concatenate([first, [len(at)]]))
    score = np.add.reduceat(tagger.emission[i[at]], first, axis=0)
    top = np.partition(score, -2, axis=1)
    best, doc = score.argmax(axis=1), np.repeat(np.arange(len(texts)), sizes)[at[first]]
    ok = (top[:, -1] - top[:, -2] > 3) & (n >= MIN_WORDS)
    for d, c, k in zip(doc[ok].tolist(), best[ok].tolist(), n[ok].tolist()):
        out[d][c] = out[d].get(c, 0) + k
    return out


def _batches(tagger, batches, slice_rows: int = 1000):
    for b in batches:
        for k in range(0, b.num_rows, slice_rows):
            part = b.slice(k, slice_rows)
            yield part, tag_texts(tagger.value, part.column(1).to_pylist())


def counting(n: np.ndarray, conf: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which sentences count: whole ones, short ones only if they are sure."""
    return whole & ((n >= MIN_WORDS) | (conf > SURE_SHORT))


def segments(df: DataFrame, tagger: Tagger, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(id, segment, lang, confidence, words): stretches of whole sentences in one language, in order.

    Null, blank and wordless texts have no segment; a text is taken whole whatever its length.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)  # its size is bounded by the sample it was fitted on

    def run(batches):
        for part, (doc, n, lang, conf, whole) in _batches(shared, batches):
            ok = counting(n, conf, whole)
            doc, n, lang, conf = doc[ok], n[ok], lang[ok], conf[ok]
            if not len(doc):
                continue
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])]))
            words = np.add.reduceat(n, first)
            mean = np.add.reduceat(conf * n, first) / words
            d = doc[first]
            begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            number = np.arange(len(d)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(d)]])))
            names = np.array(LANGS, object)[lang[first]]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(number, pa.int32()), pa.array(names, pa.string()), pa.array(mean, pa.float64()), pa.array(words, pa.int64())], names=["_id", "segment", "lang", "confidence", "words"])

    kind = df.schema[id_col].dataType.simpleString()
    d = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return arrow_map(d, run, f"_id {kind}, segment int, lang string, confidence double, words long").withColumnRenamed("_id", id_col)


def documents(df: DataFrame, tagger: Tagger, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(id, lang, confidence, langs): the language with the most words of each text; all languages with a whole
    sentence. A text without one has null, 0 and an empty list."""
    seg = segments(df, tagger, id_col, text_col)
    per = seg.groupBy(id_col, "lang").agg(F.sum("words").alias("w"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("c"))
    top = per.groupBy(id_col).agg(F.max(F.struct("w", "c", "lang")).alias("m"), F.array_sort(F.collect_set("lang")).alias("langs"), F.sum("w").alias("all"))
    out = df.select(id_col).join(top, id_col, "left")
    return out.select(id_col, F.col("m.lang").alias("lang"), F.coalesce(F.col("m.c") * F.col("m.w") / F.col("all"), F.lit(0.0)).alias("confidence"), F.coalesce("langs", F.array().cast("array<string>")).alias("langs"))


def found(df: DataFrame, tagger: Tagger | None = None, id_col: str = "ord", text_col: str = "text", label_col: str = "lang_label") -> DataFrame:
    """(ord, lang) of rows whose label is missing, names nothing or another language, and of mixed rows."""
    shared = df.sparkSession.sparkContext.broadcast(tagger or train(df, text_col, label_col, id_col))

    def run(batches):
        for part, (doc, n, lang, conf, whole) in _batches(shared, batches):
            ok = counting(n, conf, whole)
            best = np.zeros(part.num_rows, conf.dtype)
            np.maximum.at(best, doc[ok], conf[ok])
            ok &= (conf > SURE) | (conf == best[doc])
            both = np.unique(np.stack([doc[ok], lang[ok]], axis=1), axis=0)
            many = np.bincount(both[:, 0], minlength=part.num_rows) > 1
            said = np.array([INDEX.get(code_of(x), -1) for x in part.column(2).to_pylist()])
            case = many[both[:, 0]] | (said[both[:, 0]] != both[:, 1])
            d, names = both[case, 0], np.array(LANGS, object)[both[case, 1]]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(names, pa.string())], names=["_id", "lang"])

    kind = df.schema[id_col].dataType.simpleString()
    d = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(label_col).alias("_label"))
    return arrow_map(d, run, f"_id {kind}, lang string").withColumnRenamed("_id", id_col)
