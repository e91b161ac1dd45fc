"""Problem 9: garbled text from wrong character encoding.

Every distinct clean word of the corpus is put through all encoding chains; the garbled forms, as 64-bit hashes, are
joined with the corpus' own tokens. A token that is the garbled form of a clean word, verified by running the chain
again, is substituted by that word. Words are tokens with a character beyond ASCII: runs of such characters, tokens
that mix them with ASCII letters, and, for Chinese, single characters against aligned pairs.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.base import arrow_map, hash64, id_and_text
from lexmill.session import materialise

#: Single-byte encodings a text may have been read in.
ONE_BYTE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8_r", "mac_cyrillic", "iso8859_2", "iso8859_5", "iso8859_15", "cp1254")
CHINESE = ("gb18030", "big5", "shift_jis", "euc_kr")
#: (written as, read as, twice, on errors). "replace" chains cannot be undone.
CHAINS = (
    *[("utf-8", r, False, "strict") for r in (*ONE_BYTE, *CHINESE)],
    *[("utf-8", r, True, "strict") for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251")],
    *[(w, r, False, "strict") for w in CHINESE for r in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437")],
    *[(w, r, False, "strict") for w in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250") for r in ONE_BYTE if w != r],
    *[(w, r, False, "strict") for w in ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5") for r in ONE_BYTE if w != r],
    ("utf-8", "ascii", False, "replace"),
    *[("utf-8", r, False, "replace") for r in ("gb18030", "shift_jis", "big5")],
    *[(w, "utf-8", False, "replace") for w in ("cp1252", "mac_roman", "cp437", "cp1251", "koi8_r", "gb18030")],
)
STRUCTURAL = frozenset(k for k, (w, r, _, e) in enumerate(CHAINS) if e == "replace" or w == "utf-8" and r not in CHINESE)
PAIRS = frozenset(k for k, (w, r, _, e) in enumerate(CHAINS) if w in CHINESE and e == "strict")
TOKEN = r"(?<![0-9A-Za-z])[0-9A-Za-z]*+[^\x00-\x7f][^\x00-/:-@\[-`{-\x7f]*"
RUN = r"[^\x00-\x7f]+"
ODD_RUN = r"\p{L}[\p{S}\p{No}\p{Cc}]+\p{L}"
LATIN_RUN = r"[\x{80}-\x{17f}\x{2018}-\x{2122}\x{2c6}\x{2dc}]{6,}"


@lru_cache(None)
def _tables(encoding: str) -> tuple[dict[int, str], dict[int, int]] | None:
    """byte -> char and char -> byte of a single-byte encoding; undefined bytes are control characters."""
    if encoding not in ONE_BYTE:
        return None
    chars = {}
    for b in range(256):
        try:
            chars[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            chars[b] = chr(b)
    return chars, {ord(c): b for b, c in reversed(chars.items())}


@lru_cache(None)
def _decoder(encoding: str) -> str:
    return "".join(_tables(encoding)[0][b] for b in range(256))


def _write(text: str, encoding: str) -> bytes | None:
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        t = _tables(encoding)
        if t is None:
            return None
        try:
            return bytes([t[1][ord(c)] for c in text])
        except KeyError:
            return None


def _read(raw: bytes, encoding: str, errors: str) -> str | None:
    if encoding in ONE_BYTE:
        t = _decoder(encoding)
        return "".join([t[b] for b in raw])
    if encoding == "ascii":
        return "".join([chr(b) if b < 128 else "�" for b in raw])
    try:
        return raw.decode(encoding, errors)
    except UnicodeDecodeError:
        return None


def garble(word: str, chain: int) -> str | None:
    """The word as the chain leaves it, or None where it does not apply or changes nothing."""
    w, r, twice, errors = CHAINS[chain]
    for _ in range(2 if twice else 1):
        raw = _write(word, w)
        if raw is None:
            return None
        out = _read(raw, r, errors)
        if out is None or out == word:
            return None
        word = out
    return None if errors == "replace" and "�" not in word else word


def restore(token: str, chain: int) -> str | None:
    """The token before the chain, if that can be told."""
    w, r, twice, errors = CHAINS[chain]
    if errors == "replace":
        return None
    for _ in range(2 if twice else 1):
        raw = _write(token, r)
        if raw is None:
            return None
        try:
            token = raw.decode(w)
        except UnicodeDecodeError:
            return None
    return token


def suspect(word: str) -> bool:
    """Whether the word itself looks like UTF-8 read in another encoding, or lost characters."""
    if "�" in word or any(0x80 <= ord(c) < 0xA0 for c in word):
        return True
    if len(word) == 1:
        return False
    for r in ("cp1252", "mac_roman", "cp437", "cp1251", "cp850", "cp866", "koi8_r"):
        raw = _write(word, r)
        if raw is not None:
            try:
                if raw.decode("utf-8") != word:
                    return True
            except UnicodeDecodeError:
                pass
    return False


def _symbol(c: str) -> bool:
    return unicodedata.category(c) in ("Sm", "Sc", "Sk", "So", "No", "Cc", "Cn", "Co") or c in "¡¿§¶†‡•‰"


def _alphabets(word: str) -> set[str]:
    return {unicodedata.name(c, "?").split(" ")[0] for c in word if c.isalpha()}


@lru_cache(65536)
def odd(token: str) -> bool:
    """Whether no writing system makes such a word: symbols between letters, letters of two alphabets, or small letters
    before capitals twice or in letters beyond ASCII alone."""
    k = [0 if c.isalpha() else 1 if _symbol(c) else 2 for c in token]
    at = [j for j, x in enumerate(k) if x == 0]
    if at and any(x == 1 for x in k[at[0] : at[-1]]) and all(x < 2 for x in k[at[0] : at[-1]]):
        return True
    found = _alphabets(token)
    if len(found & {"LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "HEBREW", "ARABIC"}) > 1:
        return True
    breaks = sum(a.islower() and b.isupper() for a, b in zip(token, token[1:]))
    return breaks > 1 or breaks == 1 and len(token) > 3 and all(ord(c) > 0x7F for c in token)


def evident(token: str, word: str) -> bool:
    """Whether the two forms alone tell which is the garbled one, however often either occurs: the clean one is a plain
    word of one alphabet, the other is odd or a run of accented letters only where the word is of another alphabet."""
    if len(word) < 3 or not all(c.isalpha() or unicodedata.category(c)[0] == "M" for c in word):
        return False
    if not (word[1:].islower() or word.isupper()) or odd(word):
        return False
    clean = _alphabets(word)
    if len(clean) != 1:
        return False
    return odd(token) or clean != {"LATIN"} and len(token) > 3 and _alphabets(token) == {"LATIN"} and all(ord(c) > 0x7F and (c.isalpha() or _symbol(c)) for c in token)


def _chinese(word: str) -> bool:
    return all("\u3400" <= c <= "\u9fff" or "\u3000" <= c <= "\u303f" or "\uff00" <= c <= "\uff5e" for c in word)


@lru_cache(None)
def _letters(encoding: str) -> tuple[dict[int, str], re.Pattern]:
    """char -> byte, as the character of that number, of a single-byte writer; and lines it cannot write."""
    to_byte = _tables(encoding)[1]
    return {o: chr(b) for o, b in to_byte.items()}, re.compile("[^" + re.escape("".join(map(chr, to_byte))) + "]")


def _written(words: list[str], writer: str) -> tuple[list[int], str]:
    """(which words the writer can write, their bytes line by line, as characters of those numbers). No writer has the
    byte of a line end within a character."""
    if writer in ONE_BYTE:
        at = [k for k, x in enumerate(words) if not _letters(writer)[1].search(x)]
        return at, "\n".join([words[k] for k in at]).translate(_letters(writer)[0])
    raw = [_write(x, writer) for x in words]
    at = [k for k, x in enumerate(raw) if x is not None]
    return at, b"\n".join([raw[k] for k in at]).decode("latin-1")


def garbled_lines(words: list[str], chain: int, written: dict[str, tuple[list[int], str]]) -> list[str | None]:
    """garble() of each word, none of which has a line end: the words go through the chain as the lines of one text.
    `written` keeps what each writer made of the same words."""
    w, r, twice, errors = CHAINS[chain]
    if r not in ONE_BYTE:
        return [garble(x, chain) for x in words]
    if w not in written:
        written[w] = _written(words, w)
    at, raw = written[w]
    out: list[str | None] = [None] * len(words)
    if not at:
        return out
    text = raw.translate(_decoder(r))
    if twice:
        text = text.encode(w).decode("latin-1").translate(_decoder(r))
    for k, g in zip(at, text.split("\n")):
        if g != words[k]:
            out[k] = g
    return out


def _forms(batches):
    far = {k for k, c in enumerate(CHAINS) if c[0] == "utf-8"}
    for b in batches:
        words, df = [], []
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if "\n" not in w and not suspect(w):
                words.append(w), df.append(n)
        # scripts that only Unicode writes skip the chains of other writers
        near = [k for k, w in enumerate(words) if not all(0x900 <= ord(c) < 0xE00 for c in w)]
        near_words, written = [words[j] for j in near], {}
        at, chain, form = [], [], []
        for k in range(len(CHAINS)):
            some = range(len(words)) if k in far else near
            got = garbled_lines(words if k in far else near_words, k, written)
            hit = [(j, hash64(g)) for j, g in zip(some, got) if g is not None]
            at += [j for j, _ in hit]
            form += [h for _, h in hit]
            chain += [k] * len(hit)
        at, chain, form = np.array(at, np.int64), np.array(chain, np.int32), np.array(form, np.int64)
        # of chains that leave the same form the first one counts
        order = np.lexsort((chain, form, at))
        at, chain, form = at[order], chain[order], form[order]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1]) | (form[1:] != form[:-1])
        at, chain, form = at[first], chain[first], form[first]
        own, size = np.array([hash64(w) for w in words], np.int64), np.array([len(w) for w in words], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(form), pa.array(chain), pa.array(np.array(df, np.int64)[at]), pa.array(own[at]), pa.array(size[at])], names=["hg", "chain", "w_df", "hw", "w_len"])


def _verified(batches):
    for b in batches:
        rows = []
        for g, w, k, n, certain in zip(*(b.column(c).to_pylist() for c in ("token", "word", "chain", "w_df", "certain"))):
            if garble(w, k) != g:
                continue
            sure = len(w) > 1 and _chinese(w) and odd(g) if k in PAIRS else k not in STRUCTURAL and evident(g, w)
            if certain or sure or k not in PAIRS and k not in STRUCTURAL:
                rows.append((g, w, k, n, 2 if sure else int(certain)))
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["token", "word", "chain", "w_df", "level"])


def doc_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, token) of each distinct token with a character beyond ASCII."""
    d = id_and_text(df, id_col, text_col).where(F.col("_text").rlike(r"[^\x00-\x7f]"))
    # every run of such characters stands in a token: the other patterns look at the distinct tokens alone
    d = d.select("_id", F.array_distinct(F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0))).alias("_tokens"))
    d = d.select("_id", "_tokens", F.array_join("_tokens", "\n").alias("_text"))
    tokens, runs = F.col("_tokens"), F.regexp_extract_all("_text", F.lit(RUN), F.lit(0))
    han = F.regexp_extract_all("_text", F.lit(r"[\x{3000}-\x{303f}\x{3400}-\x{9fff}\x{ff00}-\x{ff5e}]"), F.lit(0))
    # other readings of Chinese bytes: runs in which letters and symbols alternate
    mixed = F.filter(runs, lambda x: (F.length(x) > 5) & x.rlike(ODD_RUN))
    pairs = F.flatten(F.transform(F.array_union(F.regexp_extract_all("_text", F.lit(LATIN_RUN), F.lit(0)), mixed), lambda x: F.regexp_extract_all(x, F.lit("(?s).."), F.lit(0))))
    return d.select("_id", F.explode(F.array_distinct(F.concat(tokens, runs, han, pairs))).alias("token"))


def matches(tokens: DataFrame) -> DataFrame:
    """(token, word, chain, level) from (_id, token) of distinct texts: garbled tokens of the corpus with their clean
    word, the most frequent one. level 2: the word alone shows it, 1: so does its frequency or chain, 0: another word of
    the document must show the chain; such a token comes with each of its chains."""
    vocabulary = materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("h", F.xxhash64("token")), "p9")
    # the words' work is even, however few files hold them; a stated number is not merged again for being small in bytes
    spark = tokens.sparkSession
    spread = vocabulary.select("token", "df").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "token")
    forms = arrow_map(spread, _forms, "hg long, chain int, w_df long, hw long, w_len int")
    joined = forms.join(vocabulary.select("token", "df", F.col("h").alias("hg")), "hg")
    # a chain that keeps to one byte a letter may turn one word into another: the rarer is the garbled one
    whole = (F.col("w_len") > 1) | F.col("token").rlike(r"^[^\x00-\x7f]+$")
    certain = F.col("chain").isin(*sorted(STRUCTURAL)) | (F.col("chain").isin(*sorted(PAIRS)) & whole)
    # or it is the one that no writing system makes, at any frequency, which the verification tells
    rarer = (F.col("w_df") >= 3) & (F.col("w_df") > 5 * F.col("df"))
    joined = joined.where(certain | (F.col("w_len") >= 3)).withColumn("certain", certain | rarer)
    words = vocabulary.select(F.col("h").alias("hw"), F.col("token").alias("word"))
    both = joined.join(words, "hw").select("token", "word", "chain", "w_df", "certain")
    checked = arrow_map(both, _verified, "token string, word string, chain int, w_df long, level int")
    # one chain a token where it is shown, else each
    told = F.when(F.col("level") > 0, -1).otherwise(F.col("chain"))
    best = checked.groupBy("token", told.alias("told")).agg(F.max(F.struct("w_df", F.struct(-F.col("chain"), "word"))).alias("m"), F.max("level").alias("level"))
    best = materialise(best.select("token", F.col("m.col2.word").alias("word"), (-F.col("m.col2.col1")).alias("chain"), "level"), "p9b")
    shown = best.where("level > 0")
    best = shown.unionByName(best.where("level = 0").join(shown.select("token"), "token", "left_anti"))
    # words met nowhere clean: their letters are; the letters of a corpus are as bounded as Unicode
    letters = vocabulary.join(shown.select("token"), "token", "left_anti").select("df", F.explode(F.array_distinct(F.split("token", ""))).alias("c")).groupBy("c").agg(F.sum("df").alias("n")).where("n > 1 and c <> ''")
    known = tokens.sparkSession.sparkContext.broadcast({r.c for r in letters.select("c").collect()})
    rest = vocabulary.join(shown.select("token"), "token", "left_anti").select("token", "df")
    return best.unionByName(arrow_map(rest, _spelled(known), "token string, word string, chain int, level int"))


def _spelled(known):
    """Tokens whose whole letter sequence is that of a garbled word of known letters."""
    chains = [k for k in sorted(STRUCTURAL) if CHAINS[k][3] == "strict"]
    chinese = [k for k in sorted(PAIRS) if CHAINS[k][0] in ("gb18030", "big5")]

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                if len(t) > 3 and all(ord(c) > 0x7F for c in t) and "�" not in t and odd(t):
                    for k in chinese:
                        o = restore(t, k)
                        if o is not None and 2 * len(o) == len(t) and _chinese(o) and all(c in known.value for c in o):
                            out.append((t, o, k, 2))
                            break
                if (not out or out[-1][0] != t) and len(t) > 3 and "�" not in t and suspect(t):
                    for k in chains:
                        o = restore(t, k)
                        if o is not None and len(o) < len(t) and all(c in known.value for c in o) and not suspect(o):
                            out.append((t, o, k, 2))
                            break
            cols = list(zip(*out)) if out else [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["token", "word", "chain", "level"])

    return run


def hits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, token, word, chain) of each document's garbled tokens.

    Pairs of letters count only where a document has three that are Chinese characters, and words garbled byte by byte
    only where it has two of them or the word is one that no writing system makes. Equal texts count once: a document
    that is a third of all rows weighs as any other; its copies come out by its first.
    """
    d = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    keyed = d.where(F.col("_text").rlike(r"[^\x00-\x7f]")).select("_id", F.xxhash64("_text").alias("k1"), F.xxhash64(F.lit(9), "_text").alias("k2"))
    firsts = keyed.groupBy("k1", "k2").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = materialise(keyed.join(firsts, ["k1", "k2"]).where("_id <> _first").select("_id", "_first"), "p9c")
    tokens = materialise(doc_tokens(d.join(copies.select("_id"), "_id", "left_anti"), "_id", "_text"), "p9t")
    got = materialise(tokens.join(materialise(matches(tokens), "p9m"), "token"), "p9h")
    got = got.withColumn("kind", F.when(F.col("chain").isin(*sorted(STRUCTURAL)), 0).when(F.col("chain").isin(*sorted(PAIRS)), 1).otherwise(2))
    n = lambda kind: F.count_if((F.col("level") > 0) & (F.col("kind") == kind))
    enough = got.groupBy("_id").agg(n(0).alias("n0"), n(1).alias("n1"), n(2).alias("n2"), F.max("level").alias("most"), F.collect_set(F.when(F.col("level") > 0, F.col("chain"))).alias("chains"))
    ok = enough.where("n0 > 0 or n1 >= 3 or n2 >= 2 or most = 2").select("_id", "chains")
    got = got.join(ok, "_id").where("level > 0 or array_contains(chains, chain)").drop("chains")
    again = got.withColumnRenamed("_id", "_first").join(copies, "_first").select(*got.columns)
    return got.unionByName(again)


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id): documents whose text, or a part of it, was decoded with the wrong encoding.

    Null, empty and pure ASCII texts are no case; equal documents come out each by its id.
    """
    return hits(df, id_col, text_col).select(F.col("_id").alias(id_col)).distinct()


def _script(word: str) -> str:
    return unicodedata.name(word[0], "").split(" ")[0]


def _restored(batches):
    token = re.compile(TOKEN)
    run = re.compile(RUN)
    for b in batches:
        texts, left = [], []
        for t, found_ in zip(b.column("_text").to_pylist(), b.column("found").to_pylist()):
            words = {m["token"]: m["word"] for m in found_}
            chains = sorted({m["chain"] for m in found_ if CHAINS[m["chain"]][3] == "strict"})

            scripts = {_script(w) for w in words.values()}

            def put(m, words=words, chains=chains, scripts=scripts):
                s = m.group()
                if s in words and len(s) > 1:
                    return words[s]
                if "�" not in s:
                    for k in chains:
                        o = restore(s, k)
                        if o is not None and o != s and not suspect(o) and (len(o) < len(s) if CHAINS[k][0] == "utf-8" or CHAINS[k][0] in CHINESE else _script(o) in scripts and _script(s) not in scripts):
                            return o
                return s

            out = run.sub(put, token.sub(put, t))
            texts.append(out)
            left.append("�" in out or any(suspect(s) for s in set(run.findall(out))))
        yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(texts, pa.string()), pa.array([not x for x in left], pa.bool_())], names=["_id", "restored", "whole"])


def restored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored, whole) of each garbled document; whole: nothing garbled is left in it."""
    per = hits(df, id_col, text_col).groupBy("_id").agg(F.collect_list(F.struct("token", "word", "chain")).alias("found"))
    kind = df.schema[id_col].dataType.simpleString()
    both = id_and_text(df, id_col, text_col).join(per, "_id")
    return arrow_map(both, _restored, f"_id {kind}, restored string, whole boolean").withColumnRenamed("_id", id_col)
