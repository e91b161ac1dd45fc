"""Problem 2: broken prompt and response pairs.

One pass over the transcripts pairs each user turn with the assistant turn after it and checks it: nothing or a
stand-in for an answer, a copy of the question, an unfinished end, an answer in another language than the question
(by the word scores of the language tagger). Refusals are told by recurrence alone, without a list of phrases: the
openings of responses, i.e. the first clause of long ones and every clause of those of a sentence or two, with names
and numbers masked, are clustered by the shingles they share, no link being missed; a cluster that recurs under unrelated
prompts and, wherever it does, stands in an answer of a sentence or two is a template, and an answer made of templates
refuses. A longer refusal is one whose whole answer recurs under unrelated prompts.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import languages
from lexmill.llm.base import arrow_map, hash64, id_and_text, ranges, word_pattern
from lexmill.llm.lookalikes import ALIKE, MIXED, skeleton
from lexmill.operators import similar
from lexmill.session import materialise

#: Stand-ins for an answer, by their letters.
STAND_INS = {"", "na", "n a", "no answer", "blank", "empty", "tbd", "tba", "null", "nil", "nan", "no response", "todo", "pending", "not available", "no reply", "no output", "undefined", "placeholder", "your answer here", "insert answer here", "answer here", "to be done", "to be determined", "left blank", "missing", "no content"}
ENDS = ".!?…।॥。！？．｡"
CLOSERS = "*_\"”’»)]}'`>）」』】 \t\r"
INVISIBLE = "​‌‍⁠﻿­‎‏"
ASKED = re.compile(
    r"\btranslat\w+|übersetz\w+|\btradu(?:ire|is|isez|ction|ce|cir|za|zir|ção|zca)\b|перевед\w+|перевод\w*|अनुवाद|翻译|అనువ|மொழிபெயர்|anuvad|tarjuma"
    r"|\b(?:in|into|to|the|auf|en|em|ins|ao|au|на)\s+(?:english|hindi|maithili|sanskrit|telugu|tamil|german|french|spanish|portuguese|russian|chinese|englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|russisch\w*|hindi|anglais|allemand|français|espagnol|russe|chinois|inglés|alemán|francés|español|portugués|ruso|chino|inglês|alemão|francês|espanhol|português|russo|chinês|английск\w*|немецк\w*|французск\w*|русск\w*|хинди|китайск\w*)\b"
    r"|(?:अंग्रेज़ी|अंग्रेजी|हिंदी|हिन्दी|संस्कृत|मैथिली|तमिल|तेलुगु|रूसी|जर्मन|चीनी)(?: भाषा)? (?:में|मे)|ఆంగ్లంలో|ఇంగ్లీషులో|హిందీలో|ஆங்கிலத்தில்|இந்தியில்|(?:用|成|译)(?:英|中|德|法|俄|西班牙|葡萄牙|印地|泰米尔|泰卢固|梵)(?:文|语)|angrezi mein|hindi mein",
    re.I,
)
REPEAT = re.compile(r"\b(?:repeat|copy|echo|say back|write out|quote|wiederhol\w+|répét\w+|repit\w+|repet\w+|повтор\w+)\b|दोहरा|重复|పునరావృత|மீண்டும்", re.I)
#: A template recurs under at least so many prompts. Three in a hundred answers are closed, so a clause that has nothing
#: to do with refusing is met in closed answers alone four times in a row once in a million. Prompts of the same words,
#: in whatever order, are one.
PROMPTS = 4
#: Of a template's answers at least so many are closed, i.e. of at most so many sentences.
CLOSED, SENTENCES = 0.9, 2
#: Its prompts are unrelated: no opening of prompts, i.e. their first words, has more than this share of them.
FRAME, FRAME_WORDS = 0.8, 6

WIDE, NARROW = re.compile("[！-～]"), {k: k - 0xFEE0 for k in range(0xFF01, 0xFF5F)}


#: Letters of scripts written without spaces: Thai, Lao, Burmese, Khmer, kana, Chinese characters.
UNSPACED = "\u0e01-\u0e5b\u0e81-\u0edf\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")


@lru_cache(None)
def unit_pattern() -> re.Pattern:
    """A word; in scripts written without spaces, a letter with its marks."""
    marks = ranges(lambda c: unicodedata.category(c)[0] == "M", 0x10000)
    return re.compile(rf"[{UNSPACED}][{marks}]*|(?:(?![{UNSPACED}])[^\W_])+(?:[{marks}]+(?:(?![{UNSPACED}])[^\W_])*)*")


def few_words(text: str) -> bool:
    """At most three words; two letters of a script without spaces count as one."""
    if not HAS_UNSPACED.search(text):
        return len(word_pattern().findall(text)) <= 3
    found = unit_pattern().findall(text)
    letters = sum(1 for w in found if HAS_UNSPACED.match(w))
    return len(found) - letters + (letters + 1) // 2 <= 3


#: A text without any of these mixes no alphabets.
_MAY_MIX, _WORD, _ALIKE = re.compile("[\u0370-\u04ff]"), re.compile(r"\w+"), {ord(k): v for k, v in ALIKE.items()}


def folded(text: str) -> str:
    """The text with look-alike letters plain in words that mix alphabets."""
    if not _MAY_MIX.search(text) or not MIXED.search(text):
        return text
    return _WORD.sub(lambda m: m.group().translate(_ALIKE) if MIXED.search(m.group()) else m.group(), text)


def is_copy(answer: str, question: str) -> bool:
    """Whether an answer only repeats its question, by words or, in scripts without spaces, by letters."""
    a, q = answer.lower(), question.lower()
    for pattern in (word_pattern(), unit_pattern()) if HAS_UNSPACED.search(q) else (word_pattern(),):
        wq = pattern.findall(q)
        wa = [m.group() for m in islice(pattern.finditer(a), len(wq) + 3)]
        if len(wa) > len(wq) + 2:  # longer: only the question again and again
            if wa[: len(wq)] != wq:
                continue
            wa = pattern.findall(a)
        # two letters beside a short question may be an answer to it
        if pattern is not word_pattern() and len(wq) < len(wa) <= len(wq) + 2 and len(wq) < 8:
            continue
        if len(wa) >= 2 and 0.85 * len(wq) <= len(wa) and _copied(wa, wq) and not (REPEAT.search(question) and len(wa) < len(wq)):
            return True
    return False


def stands_in(answer: str) -> bool:
    """Whether an answer has no word, or only those of a stand-in."""
    return " ".join(m.group() for m in islice(word_pattern().finditer(answer.lower()), 5)) in STAND_INS


def turns(text: str) -> list[tuple[str, str]]:
    """(role, content) of each turn; full-width tags are read as tags."""
    if WIDE.search(text):
        text = text.translate(NARROW)
    out = []
    for piece in text.split("<|im_start|>")[1:]:
        role, _, body = piece.partition("\n")
        out.append((role.strip().lower(), body.partition("<|im_end|>")[0]))
    return out


def answer_of(content: str) -> tuple[str, bool]:
    """(the answer without its think part, whether the thinking is open)."""
    if "<think>" not in content and "</think>" not in content:
        return content.strip(), False
    head, tag, rest = content.partition("</think>")
    if not tag:
        before, _, open_ = content.partition("<think>")
        return (before.strip() or open_.strip()), True
    before = head.partition("<think>")[0] if "<think>" in head else ""
    more, open_ = answer_of(rest) if "<think>" in rest else (rest, False)
    return (before + more).strip(), open_


def unfinished(answer: str) -> bool:
    """Whether a text breaks off: an open code block or table row, or a last sentence without its end."""
    a = answer.rstrip(INVISIBLE + CLOSERS + "\n")
    if answer.count("```") % 2:
        return True
    last = answer.rstrip(INVISIBLE + " \t\r\n").rpartition("\n")[2].strip()
    if last.rstrip(ENDS + " ").endswith("```"):
        return False
    if last.lstrip("> ").startswith("|"):
        return not last.rstrip(ENDS + ";, ").endswith("|")
    if not a or a[-1] in ENDS or few_words(answer):
        return False
    item = re.compile(r"\s*(?:[-*•]|\d+[.)])\s")
    if item.match(last):
        others = [x.rstrip(CLOSERS) for x in answer.split("\n") if item.match(x)][:-1]
        if others and not any(x and x[-1] in ENDS for x in others):
            return False
    return True


#: What ends a clause, and what ends a sentence.
CLAUSE = re.compile("[.!?…](?=[\\s\"'”’»)*_`]|$)|[।॥。！？．,;:，；：、\u2013\u2014|\n]|\\s-\\s")
SENTENCE = re.compile("[.!?…](?=[\\s\"'”’»)*_`]|$)|[।॥。！？．\n]")
#: In whole answers: numbers and words with a capital, at a sentence's start too.
_SLOT = re.compile(r"[A-Z\d]\w*")


def masked(clause: str, prompt: str = "") -> str:
    """The words of a clause, with numbers and names masked: capitalised words but the first, and the first too if it is
    the prompt's. Where most words have a capital it shows no names."""
    words = word_pattern().findall(clause)
    if not words:
        return ""
    names = [w[0].isupper() and len(w) > 1 for w in words]
    names[0] = names[0] and words[0] in prompt
    if 2 * sum(names[1:]) > len(words):
        names = [False] * len(words)
    return " ".join(["#" if named or w[0].isdigit() else w.lower() for w, named in zip(words, names)])


def whole_of(answer: str) -> str:
    """What two answers share that differ in numbers, names, case and spacing only."""
    text, n = _SLOT.subn("#", answer)
    words = text.split()
    return " ".join(words) if 2 * n <= len(words) else " ".join(answer.lower().split())


def one_word(clauses: list[str]) -> bool:
    """Whether there is one word only; in scripts written without spaces two letters count as one."""
    return sum(len(c) / 2 if HAS_UNSPACED.search(c) else c.count(" ") + 1 for c in clauses) < 2


def closed_clauses(answer: str, prompt: str) -> list[str] | None:
    """The clauses of an answer of at most SENTENCES sentences, None for a longer one."""
    n, start, letters = 0, 0, re.compile(r"\w").search
    for m in SENTENCE.finditer(answer):
        if letters(answer, start, m.start()):
            n += 1
            if n > SENTENCES:
                return None
        start = m.end()
    if n == SENTENCES and letters(answer, start):
        return None
    return [c for x in CLAUSE.split(answer) if (c := masked(x, prompt))]


def opening_of(answer: str, prompt: str) -> str:
    """The first clause of an answer."""
    start = 0
    for m in CLAUSE.finditer(answer):
        if first := masked(answer[start : m.start()], prompt):
            return first
        start = m.end()
    return masked(answer[start:], prompt)


ROW = "_id long, pair_no int, defect string, clauses array<string>, opening string, whole long, prompt long, frame long"
KINDS = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.int64())


def _first_pass(tagger):
    find = word_pattern().findall

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                yield of_part(part)

    def of_part(part):
        rows, asks, queries, answers = [], [], [], []
        told = (None,) * 5
        for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if not t or not t.strip():
                continue
            ts, n, before = turns(t), 0, ""
            for j, (role, q) in enumerate(ts):
                if role == "system":
                    before += q + "\n"
                if role != "user":
                    continue
                n += 1
                if j + 1 == len(ts) or ts[j + 1][0] != "assistant":
                    rows.append((i, n, "empty", *told))
                    continue
                a, open_ = answer_of(ts[j + 1][1])
                if open_ and unfinished(a):
                    rows.append((i, n, "truncated", *told))
                    continue
                if stands_in(a):
                    rows.append((i, n, "empty", *told))
                    continue
                fa, fq = folded(a), folded(q)
                if is_copy(fa, fq):
                    rows.append((i, n, "copy", *told))
                    continue
                plain = fa.replace("’", "'").replace("'", "")
                clauses = closed_clauses(plain, fq)
                opening = None if clauses is not None else opening_of(plain, fq) or None
                whole = hash64("\n" + whole_of(plain))
                if clauses is not None and one_word(clauses):
                    clauses, whole = [], None  # an answer, however often it recurs
                asked = find(skeleton(q).casefold())
                rows.append((i, n, "truncated" if unfinished(a) else None, clauses, opening, whole, hash64(" ".join(sorted(set(asked)))), hash64(" ".join("#" if w[0].isdigit() else w for w in asked[:FRAME_WORDS]))))
                asks.append((len(rows) - 1, before + q))
                queries.append(q), answers.append(a)
        said = languages.spoken(tagger.value, queries + answers)
        for (k, asked), q, a in zip(asks, said, said[len(queries) :]):
            if rows[k][2] is None and q and a:
                top = max(a, key=a.get)
                if a[top] >= 0.6 * sum(a.values()) and a[top] >= 4 and top not in q and sum(q.values()) >= 3 and not ASKED.search(asked):
                    rows[k] = (*rows[k][:2], "other_language", *rows[k][3:])
        cols = list(zip(*rows)) if rows else [()] * len(KINDS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS)], names=[c.split(" ")[0] for c in ROW.split(", ")])

    return run


def _copied(a: list[str], q: list[str]) -> bool:
    """Whether a's words are q's, all in a row, once or again and again; up to two words may stand around them."""
    n = min(len(a), len(q))
    if len(a) > len(q) + 2:
        return len(q) > 3 and all(w == q[k % len(q)] for k, w in enumerate(a))
    if a[:n] == q[:n] or a[-n:] == q[-n:]:
        return True
    return len(a) < len(q) and any(q[k : k + len(a)] == a for k in range(len(q) - len(a) + 1))


def clusters(openings: DataFrame) -> DataFrame:
    """(o, cluster) of distinct (o, opening): those whose five-word shingles are 0.8 alike, verified, and what they are
    linked to; an opening without a link is its own cluster."""
    # two openings that are 0.8 alike share four shingles of five, so neither has fewer than eight words; or they have
    # the same shingles, which fewer words give in one order only unless one recurs
    words, n = F.split("opening", " "), similar.SPAN
    linkable = (F.size(words) >= n + 3) | (F.size(words) >= n) & (F.size(F.array_distinct(words)) < F.size(words))
    linked = similar.classes(materialise(openings.where(linkable).select("o", similar.shingles(words).alias("s")), "p2s"))
    return openings.select("o").join(linked, "o", "left").select("o", F.coalesce("cluster", "o").alias("cluster"))


def _spread(counted: DataFrame, key: str) -> DataFrame:
    """(key, prompts in closed answers, in others, kinds of prompts, prompts of the most frequent kind) from (key, frame,
    closed, open)."""
    per = counted.groupBy(key, "frame").agg(F.sum("closed").alias("closed"), F.sum("open").alias("open"))
    return per.groupBy(key).agg(F.sum("closed").alias("closed"), F.sum("open").alias("open"), F.count_if(F.col("closed") > 0).alias("kinds"), F.max("closed").alias("most"))


def templates(passed: DataFrame) -> DataFrame:
    """(h, template) of clauses and whole answers, from all clauses of closed answers and the openings of longer ones:
    true where its cluster is a template, false where it recurs mostly in longer answers; others are left out. h is the
    clause's hash; clauses of one cluster count together."""
    said, closed = F.coalesce("clauses", F.array("opening")), F.col("clauses").isNotNull()
    words = F.transform(said, lambda c: F.struct(F.when(c.isNotNull(), F.xxhash64(c)).alias("h"), closed.alias("c")))
    seen = passed.where("prompt is not null").select("prompt", "frame", F.explode(F.array_union(F.array(F.struct(F.col("whole").alias("h"), F.lit(True).alias("c"))), words)).alias("x"))
    # a prompt counts once, however many copies it has: equal rows go before they are shuffled
    once = seen.where("x.h is not null").groupBy("x.h", "x.c", "prompt").agg(F.min("frame").alias("frame"))
    counted = materialise(once.groupBy("h", "frame").agg(F.count_if("c").alias("closed"), F.count_if(~F.col("c")).alias("open")), "p2n")
    mostly = f"closed >= {CLOSED} * (closed + open)"
    # all are clustered: what stands in longer answers counts for the templates that it is alike
    openings = passed.select(F.explode(said).alias("opening")).where("opening is not null").distinct()
    openings = materialise(openings.withColumn("o", F.xxhash64("opening")), "p2o")
    member = materialise(clusters(openings), "p2c")
    whole = counted.join(member.withColumnRenamed("o", "h"), "h", "left").withColumn("cluster", F.coalesce("cluster", "h"))
    good = f"{mostly} and closed >= {PROMPTS} and kinds > 1 and most <= {FRAME} * closed"
    told = _spread(whole, "cluster").select("cluster", F.when(F.expr(good), True).when(F.expr("closed + open >= 3 and closed < open"), False).alias("template")).where("template is not null")
    return member.select(F.col("o").alias("h"), "cluster").join(told, "cluster").select("h", "template").unionByName(told.select(F.col("cluster").alias("h"), "template").join(member.select(F.col("o").alias("h")), "h", "left_anti"))


def refusals(passed: DataFrame) -> DataFrame:
    """(_id, pair_no) of answers that are a template as a whole, or closed ones of which at least half of the words are
    in templates and no clause is one of longer answers. One word (in scripts written without spaces three letters) is
    an answer, however often it recurs."""
    told = materialise(templates(passed), "p2t")
    again = passed.where("whole is not null").join(told.where("template").select(F.col("h").alias("whole")), "whole", "left_semi").select("_id", "pair_no")
    parts = passed.where("clauses is not null").select("_id", "pair_no", F.explode("clauses").alias("clause"))
    parts = parts.select("_id", "pair_no", F.xxhash64("clause").alias("h"), F.size(F.split("clause", " ")).alias("n")).join(told, "h", "left")
    whole = parts.groupBy("_id", "pair_no").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("template"), F.col("n")).otherwise(0)).alias("m"), F.count_if(~F.col("template")).alias("others"))
    return again.unionByName(whole.where("2 * m >= n and others = 0").select("_id", "pair_no")).distinct()


def check(df: DataFrame, tagger: languages.Tagger | None = None, id_col: str = "ord", text_col: str = "text", label_col: str = "lang_label") -> DataFrame:
    """(id, pair_no, defect) of each defective pair, one defect a pair.

    Null and blank texts, and texts without a turn, have no pair; the order of the checks is: no answer, an answer
    broken off while thinking, copy, refusal, end, language. A refusal is told by its recurrence: one in words met under
    fewer than PROMPTS prompts in the whole table is not seen.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger or languages.train(df, text_col, label_col, id_col))
    passed = materialise(arrow_map(id_and_text(df, id_col, text_col), _first_pass(shared), ROW), "p2")
    refused = materialise(refusals(passed), "p2r")
    rest = passed.where("defect is not null").select("_id", "pair_no", "defect").join(refused, ["_id", "pair_no"], "left_anti")
    return refused.withColumn("defect", F.lit("refusal")).unionByName(rest).select(F.col("_id").alias(id_col), F.col("pair_no").cast("long").alias("pair_no"), "defect")
