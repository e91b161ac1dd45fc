"""The cleaning rules on the 26 hand-made transcripts and their totals."""

from lexmill.operators import chatml, clean

U, V = "<|im_start|>", "<|im_end|>"


def ok(n, e=""):
    return f'{U}user\nq{V}\n{U}assistant\n<think>t</think>{e}{"a" * n}{V}'


def padded(size):
    return ok(size - len(ok(0)))


def cases():
    one = ok(200)
    six = f"{U}user\n{'q' * 300}{V}"
    wide = one.replace("<think>", "＜think＞").replace("</think>", "＜/think＞")
    return [
        one, one, one.replace("\n", "\n\n", 1), one[: -len(V)], one.replace("</think>", ""), six, f"{six}\n{U}assistant\n  \n{V}", ok(10), ok(20000), wide, ok(200, "é\x01\x0b\t\x7f"),
        ok(200, "Translate: " + "भारत" * 30), ok(200, " x pnpm@9.1.0 "), ok(200, " jane.doe1@corp.com "), ok(200, " bob@corp.com 800-799-7233 "), ok(200, " a@ACME.com b@my.example.net "),
        ok(200, "Premise: p Hypothesis: h"), ok(200, "Premise: p\nHypothesis: h"), ok(200, "Available choices: A"), f"{U}system\nYou are S.{V}\n{one}", f"{U}system\n{V}\n{one}", ok(200, "translated"),
        padded(199), padded(200), padded(20000), padded(20001),
    ]


def test_manifest_totals(spark):
    df = spark.createDataFrame(list(enumerate(cases())), "ord long, text string")
    m = clean.manifest(clean.scan(df)).first().asDict()
    assert m["raw_count"] == 26
    assert (m["malformed_dropped"], m["short_dropped"], m["long_dropped"], m["rows_before_dedup"]) == (4, 2, 2, 18)
    assert (m["exact_duplicates"], m["final_count"], m["extra_spaced_duplicates"]) == (2, 16, 2)
    assert (m["email_rows"], m["real_email_rows"], m["phone_rows"], m["inference_rows"], m["choice_rows"]) == (4, 2, 1, 1, 1)
    assert m["control_rows"] == 1 and m["wide_tag_rows"] == 1 and m["foreign_rows"] == 1 and m["foreign_translation_rows"] == 1
    kept = {r.ord for r in clean.cleaned(clean.scan(df)).collect()}
    assert 0 in kept and 1 not in kept and 9 not in kept and 23 in kept and 25 not in kept


def test_conservation_and_prompts(spark):
    df = spark.createDataFrame(list(enumerate(cases())), "ord long, text string")
    m = clean.manifest(clean.scan(df)).first().asDict()
    assert m["rows_before_dedup"] + m["malformed_dropped"] + m["short_dropped"] + m["long_dropped"] == m["raw_count"]
    prompts = {r.system_prompt: r.rows for r in clean.prompt_counts(clean.cleaned(clean.scan(df))).collect()}
    assert prompts == {"You are S.": 1, "": 1}


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None)], "ord long, text string")
    m = clean.manifest(clean.scan(df)).first().asDict()
    assert m["raw_count"] == 0 and m["final_count"] == 0 and m["retention_pct"] is None and m["median_chars"] is None


def test_compose_parse_round_trip(spark):
    text = f"{U}user\nq1{V}\n{U}assistant\n<think>x</think>a\nb{V}\n{U}user\n{V}"
    df = spark.createDataFrame([(1, text), (2, "no turns"), (3, f"{U}user\nopen")], "ord long, text string")
    parsed = chatml.parse(df)
    assert [(r.ord, r.turn, r.role, r.content) for r in parsed.orderBy("ord", "turn").collect()] == [(1, 0, "user", "q1"), (1, 1, "assistant", "<think>x</think>a\nb"), (1, 2, "user", "")]
    assert chatml.compose(parsed).first().text == text


def test_first_copy_of_hot_text(spark):
    df = spark.range(3000).selectExpr("id as ord", "case when id % 3 = 0 then 'same' else concat('t', id) end as text")
    assert clean.keep_first(df).count() == 2001
    assert clean.keep_first(df).where("text = 'same'").first().ord == 0
