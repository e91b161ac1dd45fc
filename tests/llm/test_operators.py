"""Each training-data operator on small hand-made tables, with the odd cases: nulls, blanks, long texts, ties, repeated
rows, empty tables, extra columns whose names clash."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import format_duplicates, garbled, languages, leaks, lookalikes, mixing, pairs, personal, tokens

U, V = "<|im_start|>", "<|im_end|>"
EXTRA = ["'x' as _id", "'y' as _text", "'z' as token", "1 as k1", "'u' as ids", "'w' as word", "2 as chain", "'v' as n_tokens", "3 as place"]


def chat(q, a, system=None):
    head = f"{U}system\n{system}{V}\n" if system is not None else ""
    return f"{head}{U}user\n{q}{V}\n{U}assistant\n{a}{V}"


def transcripts(spark, rows):
    """(ord, text, lang_label) with clashing extra columns."""
    rows = [(k, *(r if isinstance(r, tuple) else (r, None))) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, "ord long, text string, lang_label string").selectExpr("*", *EXTRA)


def documents(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", *EXTRA)


def found(df):
    return sorted(map(tuple, df.collect()))


# ---------------------------------------------------------------- 6: formatting


def test_format_duplicates(spark):
    a = chat("Tell me: what is NEW, here?", "One answer.\n\nTwo.")
    fields = chat("topic: maps 1\nlevel: seeds 2", "Done.")
    json_turn = chat('{"topic": "maps 1", "level": "seeds 2", "n": 3}', "Done.")
    rows = [
        a, a, chat("tell me what is new here", "ONE answer - two!"), chat("tell me what is new", "here one answer two"), fields, chat("Level: seeds 2\ntopic: MAPS 1", "done"),
        chat("level: maps 1\ntopic: seeds 2", "Done."), json_turn, chat('{\n "n": 3,\n "level": "seeds 2",\n "topic": "maps 1"}', "Done!"), None, "", " \n", a.replace("new".upper(), "N​EW"), a.replace("One", "Оne"),
        "no turns at all", "No turns, at all!", chat("x " * 30000, "y"), chat("x  " * 30000, "y."),
    ]
    got = found(format_duplicates.found(transcripts(spark, rows)))
    assert got == [(0, 1), (0, 2), (4, 5), (7, 8), (14, 15), (16, 17)]
    counts = {r.ord_first: r.copies for r in format_duplicates.collapse(transcripts(spark, rows)).collect()}
    assert counts[0] == 3 and counts[6] == 1 and sum(counts.values()) == 15


def test_case_pairs_that_fold(spark):
    assert found(format_duplicates.found(transcripts(spark, ["Straße Σας", "STRASSE ΣΑΣ", "ﬁne", "fine"]))) == [(0, 1)]


def test_hot_group(spark):
    df = spark.range(4000).selectExpr("id as ord", "case when id % 3 = 0 then 'The Same!' else concat('t', id) end as text")
    assert format_duplicates.found(df).count() == 1333


# ---------------------------------------------------------------- 3: look-alikes


def test_lookalikes(spark):
    base = "Café “Ofﬁce” number 5086 opens at nine. Ask Peter."
    rows = [
        base, base.replace("é", "é"), base.replace("ﬁ", "fi"), base.replace("5086", "５０８６"), base.replace(" ", " "), base.replace("o", "ο"), base.replace("Peter", "Реtеr"), base.replace("n", "n​"),
        base.upper(), base.replace(". ", ".  "), base.replace("“", '"'), base.replace(".", "…"), None, "", " ", base, "x² ① ½", "x2 1 1⁄2", "plain", "plain",
    ]
    got = found(lookalikes.found(transcripts(spark, rows)))
    assert got == [(0, k) for k in range(1, 8)]


def test_normalise_keeps_rows(spark):
    df = transcripts(spark, [None, "", "Ｎｏ　ﬀ­", "वह  किसान", "Привет"])
    got = {r.ord: (r.canonical, r.folded) for r in lookalikes.normalise(df).collect()}
    assert got[0] == (None, None) and got[1] == ("", "") and got[2] == ("No ff", "no ff") and got[4][0] == "Привет"
    assert lookalikes.normalise(df.where("ord < 0")).count() == 0


# ---------------------------------------------------------------- 4: leaks


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for k in range(40)] + [(90, None), (91, ""), (92, "too short")]
    texts = []
    for k in range(300):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))
        if k % 3 == 0:
            w = items[k % 40][1].split()
            cut = w[rng.randint(0, 3) :][: rng.randint(8, 30)]
            t += " — " + ", ".join(x.upper() for x in cut) + "! " + t
        texts.append(t)
    texts += [None, "", " ", items[0][1], items[0][1]]
    ev = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in items:
        w = leaks.words(t or "")
        for o, x in enumerate(texts):
            y = leaks.words(x or "")
            have = {tuple(y[k : k + 12]) for k in range(len(y) - 11)}
            if any(tuple(w[k : k + 12]) in have for k in range(len(w) - 11)):
                want.add((i, o))
    assert set(found(leaks.found(transcripts(spark, texts), ev))) == want and want
    assert set(found(leaks.overlaps(transcripts(spark, texts), ev, block=7).where("run >= 12").select("item_id", "ord").distinct())) == want


def test_leak_with_substitution(spark):
    w = [f"word{k}" for k in range(30)]
    changed = list(w)
    for k in (8, 17, 26):
        changed[k] = "other"
    ev = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    r = leaks.overlaps(transcripts(spark, [" ".join(changed)]), ev).first()
    assert r.words == 30 and r.run == 8
    assert leaks.found(transcripts(spark, [" ".join(changed)]), ev).count() == 0
    assert leaks.found(transcripts(spark, ["x"]), ev.where("item_id < 0")).count() == 0


@pytest.mark.parametrize("errors", range(6))
def test_masks_miss_no_pattern(errors):
    from itertools import combinations

    for places in combinations(range(1, leaks.SPAN), errors):
        assert any(all(m[k] == "0" for k in places) for m in leaks.masks(errors)), places
    assert all(m[0] == "1" and len(m) == leaks.SPAN for m in leaks.masks(errors))


def test_leaks_with_any_three_substitutions(spark):
    from itertools import combinations

    w = [f"word{k}" for k in range(60)]
    texts = [" ".join("other" if k % 6 == 5 else x for k, x in enumerate(w)), " ".join("other" if k % 4 == 3 else x for k, x in enumerate(w)), " ".join("other" if k % 3 == 2 else x for k, x in enumerate(w))]
    # one passage of words with three replaced, and elsewhere a longer run of equal words that is none
    texts += [" ".join([*w[:7], *["other"] * 13, *(w[k] if k - 20 not in gone else "other" for k in range(20, 32))]) for gone in combinations(range(1, 11), 3)]
    ev = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    got = {r.ord: r.words for r in leaks.overlaps(transcripts(spark, texts), ev).collect()}
    assert got == {0: 59, 1: 59} | {k: 12 for k in range(3, len(texts))}


# ---------------------------------------------------------------- 7: token ids


def test_tokens_equal_the_library(spark):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.default_tokenizer())
    lib.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["", None, " ", "a" * 5000, "<|endoftext|> don't I'LL", "नमस्ते दुनिया 🙂👩‍🌾\u0085x", "  two\n\n\tthree   ", "ſ 'S 'ſ", *["".join(rng.choice("ab cdeé'\n-_09न 夜") for _ in range(rng.randint(0, 60))) for _ in range(300)]]
    df = documents(spark, texts)
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    for k, t in enumerate(texts):
        assert got[k] == (lib.encode(t, add_special_tokens=False).ids if t else [])
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts))
    n = {r.doc_id: r.n_tokens for r in tokens.count(df).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert tokens.encode(df.where("doc_id < 0")).count() == 0


# ---------------------------------------------------------------- 8: mixing


def test_water_fill():
    got = mixing.water_fill({"a": 100, "b": 1000, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 1, "c": 9}, 600)
    assert got == {"a": 200.0, "b": 400.0, "c": 0.0}
    assert mixing.water_fill({"a": 10}, {"a": 1.0}, {"a": 3}, 1000) == {"a": 30.0}
    assert mixing.water_fill({}, {"a": 1.0}, {"a": 3}, 10) == {"a": 0.0}


def test_mixture(spark):
    rows = [(k, f"some words number {k} " * (1 + k % 5), ("big", "big", "big", "small", None, "other")[k % 6]) for k in range(3000)] + [(9000, None, "big"), (9001, "", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *EXTRA)
    goals = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 4), ("none", 0.0, 3)], "source string, target_share double, max_repeat int")
    total = 30000
    mix = mixing.mixture(docs, goals, total).collect()
    assert {r.source for r in mix} == {"big", "small"} and max(r.copies for r in mix if r.source == "small") <= 4 and max(r.copies for r in mix if r.source == "big") == 1
    used = {s: sum(r.copies * r.n_tokens for r in mix if r.source == s) for s in ("big", "small")}
    assert used["big"] / sum(used.values()) == pytest.approx(0.6, abs=0.02)
    s = {r.source: r for r in mixing.shares(docs, goals, total).collect()}
    assert s["small"].used_tokens == used["small"] and s["none"].used_tokens == 0
    assert sorted(mix) == sorted(mixing.mixture(docs, goals, total).collect())
    assert mixing.mixture(docs.where("doc_id < 0"), goals).count() == 0 and mixing.shares(docs, goals.where("source = 'x'")).count() == 0


# ---------------------------------------------------------------- 9: garbled


def test_garbled(spark):
    clean = ["Der nächste Müller hat für Gäste Platz.", "El jardín público está junto al río, dicen los niños.", "नया पुल नदी के किनारे बसा हुआ है", "Терпеливый читатель никогда не считали дважды, как правило.", "They call it “Nice”… or don’t — naïve café £5.",
             "后来，小图书馆从来没有被数过两次。其实，夜市很受孩子们喜欢。"] * 8
    utf = lambda t, e: "".join(garbled._tables(e)[0][b] for b in t.encode())
    bad = [utf(clean[0], "cp1252"), utf(clean[1], "mac_roman"), utf(clean[2], "cp1252"), clean[3].encode("cp1251").decode("koi8_r"), utf(utf(clean[4], "cp1252"), "cp1252"), clean[5].encode("gb18030").decode("latin-1"),
           "ok words " + utf("नदी", "latin-1"), clean[4].encode("cp1252").decode("utf-8", "replace"), utf(clean[3], "cp866")]
    fine = [None, "", " ", "plain ascii", "🙂👩‍🌾 ✈️ ⑦ Ⅸ ٦٧", "line sep\x85x", "Ångström résumé ÀÉ"]
    df = documents(spark, clean + bad + fine)
    n = len(clean)
    assert found(garbled.found(df)) == [(k,) for k in range(n, n + len(bad))]
    back = {r.doc_id: (r.restored, r.whole) for r in garbled.restored(df).collect()}
    for k, want in ((0, clean[0]), (1, clean[1]), (2, clean[2]), (4, clean[4]), (6, "ok words नदी"), (8, clean[3])):
        assert back[n + k] == (want, True)
    assert not back[n + 7][1]
    assert back[n + 3][0].startswith("Терпеливый читатель никогда ")
    assert garbled.found(df.where("doc_id < 0")).count() == 0


def test_garbled_at_any_frequency(spark):
    ru, de, zh = "Терпеливый читатель хранит записи.", "Der Müller hat Gäste.", "后来小图书馆很受孩子们喜欢，夜市一直在河边"
    clean = [ru, de, zh, "Olá Ångström ÀÉ", "Иван и Müller", "x ± y, 25°C «Да»", "ИванПетров"]
    one_word = "Der Müller hat Gäste, sagt " + "читатель".encode("cp1251").decode("latin-1")
    bad = [ru.encode("cp1251").decode("latin-1")] * 12 + [ru.encode("cp1251").decode("koi8_r"), one_word, "Der " + "Müller".encode("cp1252").decode("cp1251") + " hat.", "see " + "图书馆".encode("gb18030").decode("latin-1") + " here",
           zh.encode("gb18030").decode("cp1251")]
    n = len(clean)
    assert found(garbled.found(documents(spark, clean + bad))) == [(k,) for k in range(n, n + len(bad))]


def test_lines_go_through_chains_as_words_do():
    words = ["Müller", "naïve", "читатель", "नदी", "图书馆", "“Nice”", "…", "\x85x", "ÀÉ", "한국", "ñandú"]
    written = {}
    for k in range(len(garbled.CHAINS)):
        assert garbled.garbled_lines(words, k, written) == [garbled.garble(w, k) for w in words], garbled.CHAINS[k]
    assert garbled.garbled_lines([], 0, {}) == []


def test_hash_is_sparks(spark):
    for t in ("", "a", "naïve", "नदी" * 30):
        assert spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t) h").first().h == garbled.hash64(t)


# ---------------------------------------------------------------- 1 and 2: languages and pairs

SENTENCES = {
    "en": ["The old bridge has never been counted twice.", "A patient reader keeps a ledger of every spring.", "For that reason, the public garden is open after dinner.", "The village choir moves slowly through the fog."],
    "de": ["Der alte Hafen wird nur selten gezählt.", "Das nächste Kapitel öffnet erst am frühen Nachmittag.", "Aus diesem Grund ist die kleine Bücherei bekannt.", "Ein müder Bote hat für viele Gäste genug Platz."],
    "es": ["El mercado nocturno nunca se ha contado dos veces.", "La pequeña biblioteca está junto al río.", "Por esa razón, el jardín público cambia con cada estación.", "Un aprendiz terco gusta mucho a los niños."],
    "hi": ["नया पुल नदी के किनारे बसा हुआ है।", "यह विद्यालय बच्चों को कहानी सुनाता है।", "इस कारण वह किसान अपने काम में लगा रहता है।", "पुराना बाज़ार लोगों को बहुत पसंद है।"],
    "ru": ["Старый мост никогда не считали дважды.", "Терпеливый читатель хранит записи за год.", "По этой причине ночной рынок открыт до ужина.", "Новый учитель объясняет правило на примере."],
}


def labelled():
    rng = random.Random(2)
    out = []
    for c, ss in SENTENCES.items():
        for _ in range(30):
            out.append((chat(rng.choice(ss), " ".join(rng.sample(ss, 3))), c))
    return out


@pytest.fixture(scope="module")
def tagger():
    return languages.fit([(c, t) for t, c in labelled()])


def test_labels():
    got = [languages.code_of(x) for x in (None, "", "und", "mul", "EN", "eng", "en-GB", "Hindi", "zh-CN", "tam", "it", "xx", " German ")]
    assert got == [None, None, None, None, "en", "en", "en", "hi", "zh", "ta", "it", None, "de"]


def test_found_languages(spark, tagger):
    s = SENTENCES
    rows = [
        (chat(s["en"][0], s["en"][1]), "en"), (chat(s["en"][0], s["en"][1]), None), (chat(s["de"][0], s["de"][1]), "English"), (chat(s["es"][0], s["es"][1]), "spa"), (chat(s["en"][0], f"{s['en'][1]} {s['ru'][0]} {s['ru'][1]}"), "en"),
        (None, "en"), ("", None), (" ", "xx"), (chat(s["hi"][0], s["hi"][1], "Answer the user plainly and show your steps."), "hi-IN"), (chat(s["ru"][0], f"{s['ru'][1]}\n\n```python\nfor the bridge in a garden.\n```\n| The old | bridge is here. |"), "rus"),
        (chat(" ".join(s["de"] * 400), s["de"][1]), "mul"),
    ]
    got = found(languages.found(transcripts(spark, rows), tagger))
    assert got == [(1, "en"), (2, "de"), (4, "en"), (4, "ru"), (10, "de")]
    short = [(chat(s["en"][0], f"{s['en'][1]}\n\nЧитатель хранит."), "en"), (chat(s["en"][0], f"{s['en'][1]} Zorfel Bran."), "en")]
    assert found(languages.found(transcripts(spark, short), tagger)) == [(0, "en"), (0, "ru")]
    docs = {r.ord: r for r in languages.documents(transcripts(spark, rows), tagger).collect()}
    assert docs[5].lang is None and docs[5].langs == [] and docs[4].langs == ["en", "ru"] and docs[0].confidence > 0.9
    seg = found(languages.segments(transcripts(spark, rows), tagger).where("ord = 4").select("segment", "lang"))
    assert seg == [(0, "en"), (1, "ru")]
    assert languages.found(transcripts(spark, rows).where("ord < 0")).count() == 0


def test_forward_backward_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    e, t, start = rng.random((5, 3)), rng.random((3, 3)), rng.random(3)
    got = languages.forward_backward(e.copy(), np.array([3, 2]), t, start)
    for first, n in ((0, 3), (3, 2)):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            p = start[path[0]] * np.prod([e[first + k, c] for k, c in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:])])
            for k, c in enumerate(path):
                want[k, c] += p
        assert np.allclose(got[first : first + n], want / want.sum(axis=1, keepdims=True))


def test_labels_as_an_expression(spark):
    names = [None, "", "und", "mul", "EN", "eng", "en-GB", "Hindi", "zh-CN", "tam", "it", "xx", "German", "pt_BR", "portuguese (brazil)"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(names)], "k int, x string").select("k", languages.code_column(F.col("x")).alias("c")).collect()
    assert [r.c for r in sorted(got)] == [c if (c := languages.code_of(x)) in languages.INDEX else None for x in names]


def test_saved_tagger(spark, tagger, tmp_path):
    languages.save(tagger, spark, f"{tmp_path}/m")
    back = languages.load(spark, f"{tmp_path}/m")
    text = [" ".join(ss) for ss in SENTENCES.values()]
    for a, b in zip(languages.tag_texts(tagger, text), languages.tag_texts(back, text)):
        assert np.allclose(a, b, atol=1e-4)


def test_held_out_accuracy(tagger):
    right = 0
    for c, ss in SENTENCES.items():
        doc, n, lang, conf, whole = languages.tag_texts(tagger, [f"{ss[0]} {ss[2]}"])
        right += int(all(languages.LANGS[k] == c for k in lang))
    assert right == len(SENTENCES)


def test_pairs(spark, tagger):
    en, de = SENTENCES["en"], SENTENCES["de"]
    q = "How does the old bridge near the garden keep its maps?"
    good = f"{en[0]} {en[1]}"
    rows = [
        chat(q, good), f"{U}user\n{q}{V}", chat(q, "<think>a b c.</think>\n\n"), chat(q, "(no answer)"), chat(q, "<think>" + good + " The"), chat(q, good + " The village choir moves"), chat(q, "```python\nx = 1"), chat(q, f"> {q}"),
        chat(q, f"{q}\n{q}"), chat(q, "I'm sorry, but I can't help with that. Please ask something else."), chat(q, f"{de[0]} {de[1]} {de[2]}"), chat(f"Translate into German: {en[0]}", de[0]),
        chat("Repeat the following line exactly, with nothing added: " + en[0], en[0]), chat("Answer with one word only. " + q, "Yes"), chat(q, f"You cannot skip it. I can't stress that enough: {good}"), chat(q, f"{good}\n\n| a | b |\n|---|---|\n| 1 | 2 |"),
        chat(q, good) + "\n" + chat(q, "—") + "\n" + chat(q, "TBD"), None, "", " ", "no turns", chat(q, "​"), chat(q, f"{good}\n\n- Foo 12\n- Foo 13"), chat(q, "＜think＞\nLet me see.\n＜/think＞\n\n" + good),
    ]
    # a refusal is one that recurs under unrelated prompts
    rows += [chat(x, "I'm sorry, but I can't help with that. Please ask something else.") for x in (en[1], en[2], en[3], "Where does the village choir meet?")]
    got = found(pairs.check(transcripts(spark, rows), tagger))
    assert got[-4:] == [(k, 1, "refusal") for k in range(24, 28)]
    assert got[:-4] == [
        (1, 1, "empty"), (2, 1, "empty"), (3, 1, "empty"), (4, 1, "truncated"), (5, 1, "truncated"), (6, 1, "truncated"), (7, 1, "copy"), (8, 1, "copy"), (9, 1, "refusal"), (10, 1, "other_language"),
        (16, 2, "empty"), (16, 3, "empty"), (21, 1, "empty"),
    ]
    assert pairs.check(transcripts(spark, rows).where("ord < 0"), tagger).count() == 0


def test_pairs_in_scripts_without_spaces(spark, tagger):
    q = "怎样把8258本书从沐荻岑棠送到岑芷霁溪？"
    rows = [chat(q, q), chat(q, f"你的问题是：{q}"), chat(q, f"{q}\n{q}"), chat(q, "先坐船，然后走山路到岑芷霁溪的小"), chat(q, "先坐船，然后走山路。"), chat(q, "坐船"), chat("你好", "你好吗？"), chat("我怎么去车站？", "走路。")]
    assert found(pairs.check(transcripts(spark, rows), tagger).where("defect <> 'other_language'")) == [(0, 1, "copy"), (1, 1, "copy"), (2, 1, "copy"), (3, 1, "truncated")]
    assert pairs.unit_pattern().findall("ab นี้ 中文x नया 9") == ["ab", "นี้", "中", "文", "x", "नया", "9"]


def test_copies_of_any_length_and_look(spark, tagger):
    q = "How does the old bridge near the garden keep its maps?"
    rows = [chat(q, " ".join([q] * 9)), chat(q, q.replace("bridge", "brіdge").replace("garden", "gаrden")), chat(q, f"{q} It keeps them dry. " * 9)]
    assert found(pairs.check(transcripts(spark, rows), tagger)) == [(0, 1, "copy"), (1, 1, "copy")]


PROMPTS = ["Where does the choir meet at noon?", "Compare the harvest of Bohoul with that of Klaep.", "How many crates fit in the mill?", "Write a short note about tidal clocks.", "Who keeps the ledger of the spring?", "Name three rules of the river law."]


def test_refusals_in_unseen_words(spark, tagger):
    en = SENTENCES["en"]
    long = " ".join(f"This house keeps its counsel on matter {w}, and on the ones beside it, as it was told to do." for w in ("one", "two", "three", "four", "five"))
    rows = [chat(q, "That lies outside my remit today. Kindly choose some other matter.") for q in PROMPTS]
    rows += [chat(q, long) for q in PROMPTS]
    rows += [chat(q, f"{en[k % 4]} {en[(k + 1) % 4]} {en[(k + 2) % 4]}") for k, q in enumerate(PROMPTS * 4)]
    # recurs under prompts that begin alike, or under one prompt in several forms: none
    rows += [chat(f"Answer with one word only, please: {q}", "Certainly") for q in PROMPTS]
    # so is one word, whatever the prompts
    rows += [chat(q, "Yes.") for q in PROMPTS] + [chat(q, "可以。") for q in PROMPTS]
    rows += [chat(q, "The mill stands on the left bank. It was built in spring.") for q in ("Where is the mill of Bohoul?", "where is the MILL of Bohoul", "Of Bohoul, where is the mill?", "Is the mill of Bohoul where?", "the mill of Bohoul is where?")]
    got = found(pairs.check(transcripts(spark, rows), tagger).where("defect = 'refusal'"))
    assert got == [(k, 1, "refusal") for k in range(12)]


def test_refusal_clauses():
    assert pairs.closed_clauses("Sorry, but 12 Foo things! Ask again.", "x") == ["sorry", "but # # things", "ask again"]
    assert pairs.closed_clauses("One. Two. Three.", "") is None and pairs.closed_clauses("One. Two. Three", "") is None
    assert pairs.closed_clauses("Vuhir is closed to me", "Where is Vuhir?") == ["# is closed to me"]
    assert pairs.masked("THE OLD MILL IS 3 MILES OFF") == "the old mill is # miles off" and pairs.masked("ask Peter Zorfel at noon", "") == "ask # # at noon"
    assert pairs.whole_of("THE OLD  MILL.") == pairs.whole_of("the old mill.") and pairs.whole_of("Vuhir is far, and 3 days off") == pairs.whole_of("Sihen is far, and 12 days off")
    assert pairs.one_word(["yes"]) and pairs.one_word(["可以"]) and not pairs.one_word(["对不起", "不行"]) and not pairs.one_word(["ask again"])
    assert pairs.opening_of("— First part, then. More of it. And so on.", "") == "first part" and pairs.opening_of("…", "") == ""


def test_refusals_by_cluster(spark):
    texts = ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven", "alpha beta gamma delta epsilon zeta eta theta", "x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "o long, opening string")
    got = {r.o: r.cluster for r in pairs.clusters(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_cluster_recall_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(60):  # many begin alike, so buckets are hot
        base = words[:6] + [rng.choice(words) for _ in range(rng.randint(8, 30))]
        for _ in range(4):
            t = list(base)
            if rng.random() < 0.8:
                t[rng.choice((-1, len(t) - 2))] = rng.choice(words)
            texts.append(" ".join(t))
    texts = sorted(set(texts))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    want = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    label = {r.o: r.cluster for r in pairs.clusters(spark.createDataFrame(list(enumerate(texts)), "o long, opening string")).collect()}
    together = sum(label[a] == label[b] for a, b in want)
    assert len(want) > 50 and together >= 0.9 * len(want)


def brute_clusters(texts):
    """The smallest member of each text's class, by every pair."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {a: root(a) for a in range(len(texts))}


def test_no_link_at_the_threshold_is_missed(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(700):  # pairs of four shingles in five
        base = [word() for _ in range(8)]
        texts += [" ".join(base), " ".join([*base, word()])]
    texts += ["na na na na na", "na na na na na na", "ha he ha he ha he", "he ha he ha he ha", "so so so so", "so so so"]
    got = {r.o: r.cluster for r in pairs.clusters(spark.createDataFrame(list(enumerate(texts)), "o long, opening string")).collect()}
    assert got == {k: k - k % 2 for k in range(1404)} | {1404: 1404, 1405: 1405}


def test_clusters_of_common_words_against_brute_force(spark):
    rng = random.Random(5)
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join([*common[k : k + 10], *(["x"] if k % 2 else []), f"t{rng.randrange(30)}"]) for k in range(50) for _ in range(6)]  # a chain through common words
    texts += [" ".join([*common[:12], *(f"d{rng.randrange(25)}" for _ in range(3))]) for _ in range(400)]  # more members than SMALL share their rarest runs
    texts += [" ".join([*common[:n], f"e{rng.randrange(6)}"]) for n in range(5, 40) for _ in range(8)]
    texts = sorted(set(texts))
    rng.shuffle(texts)
    got = {r.o: r.cluster for r in pairs.clusters(spark.createDataFrame(list(enumerate(texts)), "o long, opening string")).collect()}
    want = brute_clusters(texts)
    assert got == want and len(set(want.values())) > 20


def test_templates_count_what_is_alike_in_longer_answers(spark, tagger):
    en = SENTENCES["en"]
    prompts = [f"{q} {a} {b}" for q in PROMPTS for a in ("mill", "bridge", "garden", "ledger") for b in ("noon", "dusk")]
    one, two = "That sort of matter lies well outside my remit today", "That sort of matter lies well outside my remit today then"
    three, four = "Crates of this size are kept in the lower mill", "Crates of this size are kept in the lower mill now"
    rows = [chat(q, one + ".") for q in prompts[:30]]
    # one answer in four that begins so is longer, but of both clauses only one in thirty-four
    rows += [chat(q, two + ".") for q in prompts[30:33]] + [chat(prompts[33], f"{two}. {en[0]} {en[1]}")]
    # met in short answers alone, but what is alike begins longer ones
    rows += [chat(q, f"{three}. They {w}.") for q, w in zip(prompts[4:14], "wait rest dry age lie stay stand hold keep last".split())] + [chat(q, f"{four}. {en[k % 4]} {en[(k + 1) % 4]}") for k, q in enumerate(prompts[10:20])]
    assert found(pairs.check(transcripts(spark, rows), tagger).where("defect = 'refusal'")) == [(k, 1, "refusal") for k in range(33)]


# ---------------------------------------------------------------- 5: personal information


@pytest.fixture(scope="module")
def model():
    filler = [chat("How far is the old bridge from the mill?", "The harbour office has never been counted twice and has 65 apples.") for _ in range(60)]
    seen = [chat("x", f"My name is {g} Zor{k}el and my mailbox is a.b{k}@velm.test. Call me on +44 7700 9000{k}. Aadhaar 0411 4984 70{k}. I live at P.O. Box 8{k}, Klita 479{k}.") for k, g in enumerate(["Lena", "Hugo", "Ruth"] * 5, 10)]
    other = [chat("x", f"The order number is 4538-9121-90{k} and the batch is 77675655{k}. Install foo{k}@6.19.7 before you run it.") for k in range(10, 25)]
    return personal.learn(filler + seen + other)


def test_mentions(spark, model):
    rows = [
        "Dr. Hugo L. Brandelm signed with passport Z02763047, call (555) 016-7053 or 06 39 98 34 81.", "Write to nora.x [at] fernway [dot] invalid or KLA@CAMPUS.VELM.TEST", "The order number is 4538-9121-9097, batch 7767565555, ip 203.0.113.233 on 2026-03-25.",
        "Owen has 65 apples and gives 6 to Nora.", "I live at Flat 25A, 87 Broveix Lane, Jafeiboul.", "मेरा नाम अनिल पुपेचघो है और मेरा फ़ोन नंबर ०५५५०१ ७५७५६ है।", "Follow @grudaes_pemeist; install takoleim@6.19.7", None, "", "SSN: 000-32-8802 and SSN: 000-32-8802",
        "Ich heiße Greta Klouqueist und wohne in der Bralousstraße 109, 00575 Klefun.", "My name is Rυth Wunаs, mail me.", "ＨＵＧＯ ＢＲＡＮＤＥＬＭ ｐｈｏｎｅ ５５５－０１６－７０５３",
    ]
    got = found(personal.mentions(transcripts(spark, rows), model).select("ord", "kind", "nth"))
    assert got == sorted([
        (0, "name", 1), (0, "id_number", 1), (0, "phone", 1), (0, "phone", 2), (1, "email", 1), (1, "email", 2), (4, "address", 1), (5, "name", 1), (5, "phone", 1), (9, "id_number", 1), (9, "id_number", 2),
        (10, "name", 1), (10, "address", 1), (11, "name", 1), (12, "name", 1), (12, "phone", 1),
    ])
    red = {r.ord: r.redacted for r in personal.redact(transcripts(spark, rows), model).collect()}
    assert red[0] == "Dr. [NAME] signed with passport [ID_NUMBER], call [PHONE] or [PHONE]." and red[7] is None and red[8] == "" and red[3] == rows[3]
    assert red[10] == "Ich heiße [NAME] und wohne in der [ADDRESS]."


def test_names_without_letter_case(model):
    for t, name in (
        ("मेरा नाम मीरा झेमेधिसु है और मेरा फ़ोन नंबर 01632 960151 है।", "मीरा झेमेधिसु"), ("आवेदक: मीरा रेटीमझी, आधार 0529 1519 2970।", "मीरा रेटीमझी"), ("मीरा टिलेबोसे से +915550104732 पर बात करें।", "मीरा टिलेबोसे"),
        ("शांत तालाब।\nमीरा परुमीशे का पता: मकान नंबर 52, गली 8, माशेचिड नगर", "मीरा परुमीशे"),
    ):
        assert [t[s:e] for kind, s, e, _ in personal.spans(model, t) if kind == "name"] == [name]
    seen = personal.learn([f"मेरा नाम मीरा झेमे{k} है और मेरा फ़ोन नंबर 01632 96015{k} है।" for k in "कखगघ"] + ["the old bridge " + chr(97 + k % 26) * (1 + k // 26) for k in range(200)])
    assert "मीरा" in seen.lexicon.given


def test_names_of_all_rows(spark):
    # five mentions among 6,000 rows: a sample has less than three of them; no prefix of 200 letters tells texts apart
    head = "the bridge was counted " * 20
    rows = [f"{head} {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(6000)]
    for k in range(5):
        rows[k * 1100] = f"{head} My name is Qorwin Zor{'abcde'[k]}el and my mailbox is a{k}@velm.test."
    df = transcripts(spark, rows + rows[:1] * 3000)
    got = personal.train(df, rows=50).lexicon
    assert "qorwin" in got.given and {"bridge", "counted"} <= got.common and "zorael" not in got.given


@pytest.mark.parametrize("name", ["Lena Zorfel Brandelm", "Hugo de la Zorven", "Ruth Zorfel-Brandelm", "Lena Zorfel"])
def test_family_names_of_two_words(model, name):
    t = f"My name is {name} and my mailbox is a.b@velm.test."
    assert [t[s:e] for kind, s, e, _ in personal.spans(model, t) if kind == "name"] == [name]


def test_places_in_the_original(model):
    text = "x​ Lena Zorfel​ is here"
    (kind, s, e, _) = personal.spans(model, text)[0]
    assert kind == "name" and text[s:e] == "Lena Zorfel"


def test_empty_table_and_long_text(spark, model):
    df = transcripts(spark, ["word " * 200000 + "Call me on +44 7700 900123."])
    assert found(personal.mentions(df, model).select("kind", "nth")) == [("phone", 1)]
    assert personal.found(df.where("ord < 0")).count() == 0


def test_queries_are_registered():
    from lexmill.llm import queries

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} | {"p7_ids", "p8_mixture"} <= set(queries.queries())
