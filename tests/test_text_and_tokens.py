import json
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import bpe, html
from lexmill.sources import sinks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_units_on_many_scripts(spark):
    assert one(spark, "भारत गणराज्य, 1,42 café x_y", T.units) == 7
    assert one(spark, "", T.units) == 0


def test_white_space_is_spelled_out(spark):
    ws = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    assert one(spark, f"a{ws}b", T.visible) == "ab"
    assert one(spark, f"{ws}a{ws}", T.strip) == "a"


def test_lossy_normaliser(spark):
    got = one(spark, "India's population is 1,428,627,663. ½ ① Ⅻ x_y", lambda c: T.others_to_space(T.nfkc(c)))
    assert got == "India s population is 1 428 627 663 1 2 1 XII x y"


@pytest.mark.parametrize(("text", "want"), [(" a", ["▁a"]), ("a  b", ["▁a", "▁", "▁b"]), ("a\nb", ["▁a\nb"]), ("", []), ("  ", ["▁", "▁"])])
def test_space_pretokens(spark, text, want):
    assert one(spark, text, bpe.space_pretokens) == want


def test_word_pretokens(spark):
    assert one(spark, "a-b c..d", bpe.word_pretokens) == ["a", "-", "b", "c", "..", "d"]


@pytest.mark.parametrize("text", ["मेरा नाम தமிழ் x_y a-b c..d ½ तेलुगु", "Ⓐb ⅫⅢ क्‍ष ౧౨ é́ –　end", "ab  c", ""])
def test_word_pretokens_equal_the_library(spark, text):
    pre = pytest.importorskip("tokenizers").pre_tokenizers.Whitespace()
    assert one(spark, text, bpe.word_pretokens) == [w for w, _ in pre.pre_tokenize_str(text)]


def test_markdown_and_links(spark):
    assert one(spark, " a  \n\n\n\n\nb \n", T.markdown_normalise) == "a\n\n\nb\n"
    host = "w.example"
    got = [one(spark, x, lambda c: T.absolute_link(c, F.lit("hi"), host)) for x in ("//m/x", "./P", "/w", "#a", "https://z")]
    assert got == ["https://m/x", "https://hi.w.example/wiki/P", "https://hi.w.example/w", "#a", "https://z"]
    assert one(spark, "भारत a/b~*", T.path_quoted) == "%E0%A4%AD%E0%A4%BE%E0%A4%B0%E0%A4%A4%20a/b~%2A"


def test_html_to_markdown():
    page = "<h2>T_x</h2><p>A <b>b</b> <i>c</i> <a href='u'>l</a></p><ul><li>1</li><li>2</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    md = html.markdown(page)
    assert "## T\\_x" in md and "A **b** *c* [l](u)" in md and "- 1\n- 2" in md and "| a | b |\n| --- | --- |\n| 1 | 2 |" in md


def test_first_merges_of_the_toy_corpus(spark):
    text = "aa bb\ncc dd\n\nab cc\n" * 3 + "xyz xyz\n"
    df = spark.createDataFrame([("en", text)], "lang string, text string")
    counts = sorted((r.word, r.n) for r in bpe.word_counts(df).collect())
    _, merges = bpe.learn(counts, 256 + 30)
    assert merges[:8] == [("c", "c"), ("▁", "a"), ("▁", "cc"), ("b", "\n"), ("b", "b\n"), ("d", "\n"), ("d", "d\n"), ("▁", "\n")]


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    df = spark.createDataFrame([("en", "the cat sat\non the mat, the cat\n" * 4), ("hi", "भारत देश महान है। देश\n" * 3)], "lang string, text string")
    w = spark.createDataFrame([("en", 2), ("hi", 5)], "lang string, weight int")
    e = bpe.train(df, w, 330)
    doc = {"version": "1.0", "truncation": None, "padding": None, "normalizer": None, "post_processor": None, "added_tokens": [], "decoder": None,
           "pre_tokenizer": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True},
           "model": json.loads(sinks.tokenizer_json(e))["model"] | {"byte_fallback": True, "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "ignore_merges": False}}
    lib = tokenizers.Tokenizer.from_str(json.dumps(doc))
    for text in ("the cat", "a new mat é 🙂 देशों", "  two  spaces", ""):
        row = bpe.encode(spark.createDataFrame([(text,)], "text string"), e).first()
        assert row.tokens == lib.encode(text).tokens
        assert "".join(row.decoded.split()) == "".join(text.split())


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=30))
def test_decode_inverts_encode(text):
    e = bpe.Encoder([*bpe.BYTES, "a", "b", "ab"], [("a", "b")])
    if "▁" in text or "<0x" in text:
        return
    shown = "▁" + text.replace(" ", "▁") if not text.startswith(" ") else text.replace(" ", "▁")
    pre = [p if k == 0 else "▁" + p for k, p in enumerate(shown.split("▁"))][1 if shown.startswith("▁") else 0 :]
    got = e.decode([t for w in pre for t in e.word(w)])
    assert "".join(got.split()) == "".join(text.split())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=40))
def test_merges_against_brute_force(word):
    merges = [("a", "b"), ("ab", "c"), ("a", "a"), ("b", "c"), ("aa", "ab"), ("abc", "abc"), ("c", "c")]
    e = bpe.Encoder([*bpe.BYTES, *"abc", *(a + b for a, b in merges)], merges)
    s = list(word)
    while ranked := [(e.rank[p], k) for k, p in enumerate(zip(s, s[1:])) if p in e.rank]:
        k = min(ranked)[1]
        s[k : k + 2] = [s[k] + s[k + 1]]
    assert e.merged(word) == s


def test_merging_long_words_takes_no_square():
    import time

    e = bpe.Encoder([*bpe.BYTES, "a", "b", "ab"], [("a", "b"), ("ab", "ab")])
    began = time.time()
    assert len(e.merged("ab" * 100_000)) == 50_000
    assert time.time() - began < 10


def test_words_beyond_the_bound_are_refused(spark):
    with pytest.raises(ValueError, match="distinct words"):
        bpe.train(spark.createDataFrame([("en", "a b c d")], "lang string, text string"), None, 300, most_words=2)


def test_best_merge(spark):
    counts = spark.createDataFrame([("abab", 2), ("xy", 1), ("cab", 1)], "word string, n long")
    ranks = spark.createDataFrame([("a", "b", 1), ("b", "a", 0), ("c", "a", 2)], "left string, right string, rank int")
    assert sorted((r.word, r.at, r.rank) for r in bpe.best_merges(counts, ranks).collect()) == [("abab", 2, 0), ("cab", 2, 1)]


def test_numbers_at_fixed_places(spark):
    assert [one(spark, x, lambda c: T.fixed(c.cast("double"), 2)) for x in ("0.125", "0.375", "2", "1.005")] == ["0.12", "0.38", "2.00", "1.00"]


def test_invalid_bytes_give_one_sign_each():
    assert bpe.Encoder([], []).decode(["<0xE0>", "<0xA4>", "a"]) == "��a"


def test_nfc_guard(spark):
    assert one(spark, "é क़", T.nfc) == unicodedata.normalize("NFC", "é क़")
    assert one(spark, None, T.nfc) is None
    assert one(spark, "plain é", T.nfc) == "plain é"


def test_stable_ranges_are_stable():
    seconds = {chr(int(d.split()[-1], 16)) for o in range(0x110000) if (d := unicodedata.decomposition(chr(o))) and d[0] != "<" and len(d.split()) == 2}
    for a, b in T.STABLE:
        for c in map(chr, range(a, b + 1)):
            assert unicodedata.is_normalized("NFC", c) and c not in seconds and unicodedata.combining(c) in (0, 9), hex(ord(c))
