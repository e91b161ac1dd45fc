"""Scalar text functions and filters over whole transcripts, documents and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import chatml, clean
from lexmill.plans.common import BASE, DOMAINS, EMAIL, NORM, PHONE, UNIT, WS, Registry, count_sql, table, texts

R = Registry()
HOST = "quarrypedia.example"


@R.add("src1_scan", "SELECT ord, text, lang_label, contributor FROM transcripts")
def _(s, d):
    return table(s, d, "transcripts").select("ord", "text", "lang_label", "contributor")


@R.add("src2_projection", "SELECT ord, text FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    return texts(s, d)


@R.add("src3_whole_texts", "SELECT lang, variant, CAST(length(text) AS BIGINT) AS chars FROM corpus")
def _(s, d):
    return table(s, d, "corpus").select("lang", "variant", T.chars(F.regexp_replace("text", "\r\n?", "\n")).alias("chars"))


@R.add("src4_json", "SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@R.add("src6_page_url", f"SELECT lang, title, 'https://'||lang||'.{HOST}/api/rest_v1/page/html/'||url_encode(title) AS url FROM corpus_meta WHERE title IS NOT NULL")
def _(s, d):
    return table(s, d, "corpus_meta").where("title is not null").select("lang", "title", T.page_url(F.col("lang"), F.col("title"), HOST).alias("url"))


@R.add("str1_nfc", "SELECT ord, md5(nfc_normalize(text)) AS digest, CAST(length(nfc_normalize(text)) AS BIGINT) AS chars FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    return texts(s, d).select("ord", T.nfc(F.col("text")).alias("n")).select("ord", F.md5("n").alias("digest"), T.chars(F.col("n")).alias("chars"))


@R.add("str2_nfkc")
def _(s, d):
    return texts(s, d).select("ord", T.nfkc(F.col("text")).alias("text"))


@R.add("str3_replace", "SELECT ord, md5(replace(replace(replace(text,'＜think＞','<think>'),'＜/think＞','</think>'),chr(160),' ')) AS digest FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    return texts(s, d).select("ord", F.md5(F.replace(T.fix_tags(F.col("text")), F.lit(" "), F.lit(" "))).alias("digest"))


@R.add("str4_controls", r"SELECT ord, md5(regexp_replace(text,'[\x00-\x08\x0b\x0c\x0e-\x1f]','','g')) AS digest FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    return texts(s, d).select("ord", F.md5(T.strip_controls(F.col("text"))).alias("digest"))


@R.add("str5_normalise", f"SELECT ord, md5({NORM}) AS digest FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    return texts(s, d).select("ord", F.md5(T.normalise(F.col("text"))).alias("digest"))


@R.add("str6_str7_contains", r"SELECT ord, regexp_matches(text,'[\x00-\x08\x0b\x0c\x0e-\x1f]') AS controls, contains(text,'＜think＞') AS wide, contains(text,'<|im_start|>assistant') AS assistant FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    return texts(s, d).select("ord", F.col("text").rlike(T.CONTROLS).alias("controls"), F.col("text").contains("＜think＞").alias("wide"), F.col("text").contains("<|im_start|>assistant").alias("assistant"))


@R.add("str8_ascii_ratio", r"SELECT ord, round(length(regexp_replace(text,'[^\x00-\x7F]','','g'))/greatest(length(text),1),6) AS ratio FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    return texts(s, d).select("ord", F.round(T.ascii_ratio(F.col("text")), 6).alias("ratio"))


@R.add("str9_translation", r"SELECT ord, regexp_matches(text,'(?i)(^|[^\p{L}\p{N}_])translat(e|ion)($|[^\p{L}\p{N}_])') AS asks FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    return texts(s, d).select("ord", T.asks_translation(F.col("text")).alias("asks"))


@R.add("str10_occurrences", f"SELECT ord, {count_sql('<|im_start|>')} AS starts, {count_sql('<|im_end|>')} AS ends, {count_sql('<think>')} AS thinks, {count_sql('</think>')} AS unthinks FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    return texts(s, d).select("ord", *[T.occurrences(F.col("text"), m).alias(n) for m, n in ((T.IM_START, "starts"), (T.IM_END, "ends"), (T.THINK, "thinks"), (T.UNTHINK, "unthinks"))])


@R.add("str11_empty_assistant", rf"SELECT ord FROM transcripts WHERE text IS NOT NULL AND regexp_matches(text,'<\|im_start\|>assistant{WS}*<\|im_end\|>')")
def _(s, d):
    return texts(s, d).where(T.empty_assistant(F.col("text"))).select("ord")


@R.add("str12_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, length(text)=n_chars AS agrees FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.chars(F.col("text")).alias("chars"), (T.chars(F.col("text")) == F.col("n_chars")).alias("agrees"))


@R.add("str13_space_key", f"SELECT ord, md5(regexp_replace(text,'{WS}+',' ','g')) AS digest FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    return texts(s, d).select("ord", F.md5(T.collapse_space(F.col("text"))).alias("digest"))


@R.add("str14_emails", f"SELECT ord, len(regexp_extract_all(text,'{EMAIL}')) AS n, array_to_string(regexp_extract_all(text,'{EMAIL}'),' ') AS found FROM transcripts WHERE text IS NOT NULL AND regexp_matches(text,'{EMAIL}')")
def _(s, d):
    return texts(s, d).select("ord", T.emails(F.col("text")).alias("e")).where("size(e) > 0").select("ord", F.size("e").cast("bigint").alias("n"), F.array_join("e", " ").alias("found"))


@R.add("str15_phones", f"SELECT ord, array_to_string(regexp_extract_all(text,'{PHONE}',1),' ') AS found FROM transcripts WHERE text IS NOT NULL AND regexp_matches(text,'{PHONE}')")
def _(s, d):
    return texts(s, d).select("ord", T.phones(F.col("text")).alias("p")).where("size(p) > 0").select("ord", F.array_join("p", " ").alias("found"))


REAL = rf"""len(list_filter(regexp_extract_all(text,'{EMAIL}'), lambda e: NOT (contains(lower(e),'example') OR split_part(lower(e),'@',-1) IN {DOMAINS})
 AND NOT (contains(split_part(e,'@',1),'.') AND regexp_matches(split_part(e,'@',1),'\p{{Nd}}'))))>0"""


@R.add("str16_str17_real_email", f"SELECT ord, {REAL} AS is_real FROM transcripts WHERE text IS NOT NULL AND regexp_matches(text,'{EMAIL}')")
def _(s, d):
    return texts(s, d).select("ord", T.emails(F.col("text")).alias("e")).where("size(e) > 0").select("ord", T.real_email(F.col("e")).alias("is_real"))


@R.add("str18_str19_templates", r"SELECT item_id, regexp_matches(text,'(?i)Premise:[^\n]*hypothesis') AS inference, contains(text,'Available choices:') AS choice, contains(text,'Options:') AS options FROM eval_items WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "eval_items").where("text is not null").select("item_id", T.inference_template(F.col("text")).alias("inference"), T.choice_template(F.col("text")).alias("choice"), F.col("text").contains("Options:").alias("options"))


SYSTEM = r"(?s)<\|im_start\|>system\n(.*?)<\|im_end\|>"


@R.add("str20_system_prompt", f"SELECT ord, regexp_extract(text,'{SYSTEM}',1) AS prompt FROM transcripts WHERE text IS NOT NULL AND regexp_matches(text,'{SYSTEM}')")
def _(s, d):
    return texts(s, d).select("ord", T.system_prompt(F.col("text")).alias("prompt")).where("prompt is not null")


@R.add("str21_starts_with", "SELECT ord, NOT starts_with(text,'<|im_start|>system') AS no_system FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    return texts(s, d).select("ord", (~F.col("text").startswith("<|im_start|>system")).alias("no_system"))


@R.add("str22_agg10_ordered_hash", "SELECT substring(sha256(string_agg(text,'' ORDER BY lang||variant)),1,16) AS content_hash FROM corpus")
def _(s, d):
    return clean.ordered_hash(table(s, d, "corpus").select(F.concat("lang", "variant").alias("k"), "text"), "k")


@R.add("str23_units", f"SELECT doc_id, CAST(len(regexp_extract_all(text,'{UNIT}')) AS BIGINT) AS units FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.units(F.col("text")).alias("units"))


@R.add("str24_visible", f"SELECT doc_id, md5(regexp_replace(text,'{WS}','','g')) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(T.visible(F.col("text"))).alias("digest"))


MARKDOWN = rf"regexp_replace(regexp_replace(regexp_replace(replace(text,chr(160),' '),'\n{{4,}}',chr(10)||chr(10)||chr(10),'g'),'[ \t]+\n',chr(10),'g'),'^{WS}+|{WS}+$','','g')||chr(10)"


@R.add("str25_markdown", f"SELECT doc_id, md5({MARKDOWN}) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(T.markdown_normalise(F.col("text"))).alias("digest"))


@R.add("str26_others_to_space", r"SELECT doc_id, md5(regexp_replace(text,'[^\p{L}\p{M}\p{N}]+',' ','g')) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(T.others_to_space(F.col("text"))).alias("digest"))


#: A page around each title, with every kind of link and noise; the same text on both sides.
PAGE = """'<html><head><meta charset="utf-8"><script>var a = "<p>";</script><style>p {}</style></head><body class="x"><link rel="mw:PageProp/Category" href="./Category:'||lang||'"><link rel="stylesheet" href="/s.css"><h1>'||title||'</h1><p>A <b>bold</b> <a href="./'||title||'">page</a> <a href="//media.example/x">media</a> <a href="/w/index">root</a> <a href="#x">here</a> <a href="">none</a><img src="//media.example/i.png" alt="i"></p></body></html>'"""


def pages(s, d):
    return table(s, d, "corpus_meta").where("title is not null").select("lang", "title", "variant", "chars", F.expr(PAGE).alias("html"))


LINKS = rf"""SELECT lang, title, chars, pos, link, CASE WHEN starts_with(link,'//') THEN 'https:'||link WHEN starts_with(link,'./') THEN 'https://'||lang||'.{HOST}/wiki/'||substr(link,3) WHEN starts_with(link,'/') THEN 'https://'||lang||'.{HOST}'||link ELSE link END AS absolute
FROM (SELECT lang, title, chars, unnest(regexp_extract_all({PAGE},'(?is)<(?:a|img|source)\b[^>]*?\b(?:href|src)="([^"]*)"',1)) AS link, generate_subscripts(regexp_extract_all({PAGE},'(?is)<(?:a|img|source)\b[^>]*?\b(?:href|src)="([^"]*)"',1),1)-1 AS pos FROM corpus_meta WHERE title IS NOT NULL) WHERE link<>''"""


@R.add("str27_flt11_links", LINKS)
def _(s, d):
    e = pages(s, d).select("lang", "title", "chars", F.posexplode(T.links(F.col("html"))).alias("pos", "link")).where("link <> ''")
    return e.withColumn("pos", F.col("pos").cast("bigint")).withColumn("absolute", T.absolute_link(F.col("link"), F.col("lang"), HOST))


NOISE = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({PAGE},'(?is)<script\b.*?</script>','','g'),'(?is)<style\b.*?</style>','','g'),'(?is)<meta\b[^>]*>','','g'),'(?is)<link\b[^>]*rel="[^"]*mw:PageProp/Category[^"]*"[^>]*href="([^"]+)"[^>]*>',chr(10)||'Category: \1'||chr(10),'g'),'(?is)<link\b[^>]*>','','g')"""


@R.add("str28_str29_noise", f"SELECT lang, title, chars, regexp_extract(h,'(?is)<body[^>]*>(.*)</body>',1) AS body FROM (SELECT lang, title, chars, {NOISE} AS h FROM corpus_meta WHERE title IS NOT NULL)")
def _(s, d):
    return pages(s, d).select("lang", "title", "chars", T.body(T.without_noise(F.col("html"))).alias("body"))


@R.add("str30_markdown_pages")
def _(s, d):
    from lexmill.operators.html import to_markdown

    return to_markdown(pages(s, d))


@R.add("str31_timestamp", "SELECT lang, chars, strftime(CAST(generated_at AS TIMESTAMP),'%Y-%m-%dT%H:%M:%SZ') AS stamp FROM corpus_meta WHERE generated_at IS NOT NULL")
def _(s, d):
    return table(s, d, "corpus_meta").where("generated_at is not null").select("lang", "chars", T.iso_utc(F.to_timestamp("generated_at")).alias("stamp"))


@R.add("str32_byte_names", "SELECT CAST(i AS BIGINT) AS i, '<0x'||lpad(upper(to_hex(i)),2,'0')||'>' AS name FROM range(256) r(i)")
def _(s, d):
    return s.range(256).select(F.col("id").alias("i"), T.byte_name(F.col("id").cast("int")).alias("name"))


@R.add("str33_number_format", "SELECT run_id, lang, logged_at, printf('%.3f', CAST(tokens AS DOUBLE)/16) AS formatted FROM sweep_metrics")
def _(s, d):
    # sixteenths: half of them are ties at three places, which go to the even digit
    return table(s, d, "sweep_metrics").select("run_id", "lang", "logged_at", T.fixed(F.col("tokens").cast("double") / 16, 3).alias("formatted"))


@R.add("str34_search", "SELECT DISTINCT w AS token FROM (SELECT unnest(string_split(text,' ')) AS w FROM gate_samples g(text)) WHERE contains(lower(w),'a') OR w='1'")
def _(s, d):
    words = table(s, d, "gate_samples").select(F.explode(F.split("sample", " ")).alias("token")).distinct()
    return words.where(T.matches_search(F.col("token"), F.lit(0), "a") | (F.col("token") == "1"))


TURNS = r"""SELECT ord, CAST(generate_subscripts(p,1)-1 AS BIGINT) AS turn, regexp_extract(unnest(p),'(?s)^([0-9A-Za-z_]+)\n(.*?)<\|im_end\|>',1) AS role, regexp_extract(unnest(p),'(?s)^([0-9A-Za-z_]+)\n(.*?)<\|im_end\|>',2) AS content
FROM (SELECT ord, list_filter(string_split(text,'<|im_start|>'), lambda x: regexp_matches(x,'(?s)^[0-9A-Za-z_]+\n(.*?)<\|im_end\|>')) AS p FROM transcripts WHERE text IS NOT NULL)"""


@R.add("arr3_turns", TURNS)
def _(s, d):
    return chatml.parse(texts(s, d))


@R.add("arr3_compose", f"SELECT ord, md5(string_agg('<|im_start|>'||role||chr(10)||content||'<|im_end|>', chr(10) ORDER BY turn)) AS digest FROM ({TURNS}) GROUP BY ord")
def _(s, d):
    return chatml.compose(chatml.parse(texts(s, d))).select("ord", F.md5("text").alias("digest"))


FLAGS = "ord, had_controls, had_wide_tags, tag_mismatch, think_mismatch, no_assistant, empty_assistant, malformed, short, long, nonascii, translation, chars"


@R.add("flt1_flt7_flags", f"{BASE} SELECT {FLAGS} FROM marked")
def _(s, d):
    return clean.flags(texts(s, d)).withColumnRenamed("foreign", "nonascii").select(*FLAGS.split(", "))


@R.add("flt6_jn1_kept_by_quality", f"{BASE} SELECT ord, chars FROM good")
def _(s, d):
    return clean.keep_quality(clean.flags(texts(s, d))).select("ord", "chars")


@R.add("clean_kept", f"{BASE} SELECT ord, md5(text) AS digest FROM kept")
def _(s, d):
    return clean.cleaned(texts(s, d)).select("ord", F.md5("text").alias("digest"))


@R.add("win1_keep_first", "SELECT ord FROM transcripts WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY ord)=1")
def _(s, d):
    return clean.keep_first(texts(s, d)).select("ord")


@R.add("win2_keep_first_spaced", f"SELECT ord FROM transcripts WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY regexp_replace(text,'{WS}+',' ','g') ORDER BY ord)=1")
def _(s, d):
    return clean.keep_first(texts(s, d), T.collapse_space(F.col("text"))).select("ord")


@R.add("jn2_anti_duplicates", "SELECT ord FROM transcripts WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY ord)>1")
def _(s, d):
    every = texts(s, d)
    return every.select("ord").join(clean.keep_first(every).select("ord"), "ord", "left_anti")


@R.add("flt8_pii_flags", f"""{BASE} SELECT ord, regexp_matches(text,'{EMAIL}') AS email, regexp_matches(text,'{PHONE}') AS phone, {REAL} AS real_email, regexp_matches(text,'(?i)Premise:[^\\n]*hypothesis') AS inference, contains(text,'Available choices:') AS choice, NOT starts_with(text,'<|im_start|>system') AS no_system FROM kept""")
def _(s, d):
    return clean.survivor_flags(clean.cleaned(texts(s, d))).select("ord", "email", "phone", "real_email", "inference", "choice", "no_system")


MANIFEST = f"""{BASE}, b AS (SELECT count(*) AS raw_count, count_if(had_controls) AS control_rows, count_if(had_wide_tags) AS wide_tag_rows, count_if(nonascii) AS foreign_rows, count_if(nonascii AND translation) AS foreign_translation_rows,
 count_if(tag_mismatch) AS tag_mismatch_rows, count_if(think_mismatch) AS think_mismatch_rows, count_if(no_assistant OR empty_assistant) AS empty_assistant_rows, count_if(malformed) AS malformed_dropped, count_if(short AND NOT malformed) AS short_dropped,
 count_if(long AND NOT malformed AND NOT short) AS long_dropped, count_if(NOT malformed AND NOT short AND NOT long) AS rows_before_dedup FROM marked),
a AS (SELECT count(*) AS final_count, count_if(regexp_matches(text,'{EMAIL}')) AS email_rows, count_if(regexp_matches(text,'{PHONE}')) AS phone_rows, count_if({REAL}) AS real_email_rows, count_if(regexp_matches(text,'(?i)Premise:[^\\n]*hypothesis')) AS inference_rows,
 count_if(contains(text,'Available choices:')) AS choice_rows, round(avg(chars),1) AS mean_chars, CAST(trunc(median(chars)) AS BIGINT) AS median_chars, min(chars) AS min_chars, max(chars) AS max_chars, count_if(NOT starts_with(text,'<|im_start|>system')) AS no_system_rows FROM kept),
w AS (SELECT count(DISTINCT regexp_replace(text,'{WS}+',' ','g')) AS ds FROM good)
SELECT CAST(COLUMNS(* EXCLUDE (mean_chars, retention_pct)) AS BIGINT), mean_chars, retention_pct FROM (SELECT b.*, a.*, rows_before_dedup-final_count AS exact_duplicates, greatest(rows_before_dedup-ds-(rows_before_dedup-final_count),0) AS extra_spaced_duplicates, round(100.0*final_count/raw_count,2) AS retention_pct FROM b,a,w)"""


@R.add("snk2_manifest", MANIFEST)
def _(s, d):
    return clean.manifest(texts(s, d))


@R.add("agg8_prompt_counts", f"{BASE} SELECT prompt AS system_prompt, count(*) AS rows FROM (SELECT regexp_extract(text,'{SYSTEM}',1) AS prompt FROM kept WHERE regexp_matches(text,'{SYSTEM}')) GROUP BY 1")
def _(s, d):
    return clean.prompt_counts(clean.cleaned(texts(s, d)))


TREE = """, leaf AS (SELECT ord//4096 AS b, ord, sha256(text) AS h FROM kept), l1 AS (SELECT b, sha256(string_agg(h,'' ORDER BY ord)) AS h FROM leaf GROUP BY b), l2 AS (SELECT b//4096 AS c, sha256(string_agg(h,'' ORDER BY b)) AS h FROM l1 GROUP BY 1)
SELECT substring(sha256(string_agg(h,'' ORDER BY c)),1,16) AS content_hash FROM l2"""


@R.add("agg10_tree_hash", BASE + TREE)
def _(s, d):
    return clean.tree_hash(clean.cleaned(texts(s, d)))


@R.add("agg4_agg5_duplicates", f"SELECT count(*)-count(DISTINCT text) AS exact, greatest(count(*)-count(DISTINCT regexp_replace(text,'{WS}+',' ','g'))-(count(*)-count(DISTINCT text)),0) AS extra FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    e = texts(s, d).select(F.md5("text").alias("a2"), F.md5(T.collapse_space(F.col("text"))).alias("b"))
    got = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a2").alias("da"), F.count_distinct("b").alias("db"))
    exact = F.col("n") - F.col("da")
    return got.select(exact.alias("exact"), F.greatest(F.col("n") - F.col("db") - exact, F.lit(0)).alias("extra"))


@R.add("agg6_agg7_lengths", "SELECT source, count(*) AS n, round(avg(n_chars),1) AS mean_chars, CAST(trunc(median(n_chars)) AS BIGINT) AS median_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM documents WHERE n_chars IS NOT NULL GROUP BY source")
def _(s, d):
    return table(s, d, "documents").where("n_chars is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 1).alias("mean_chars"), F.median("n_chars").cast("bigint").alias("median_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))


@R.add("jsn2_meta_json", "SELECT lang, chars, title FROM corpus_meta")
def _(s, d):
    rows = table(s, d, "corpus_meta")
    packed = rows.select(F.to_json(F.struct("lang", "chars", "title")).alias("j"))
    return packed.select(F.from_json("j", "lang string, chars bigint, title string").alias("x")).select("x.*")


@R.add("jn4_placeholder_domains", f"SELECT ord, split_part(lower(e),'@',-1) IN {DOMAINS} AS placeholder, count(*) AS n FROM (SELECT ord, unnest(regexp_extract_all(text,'{EMAIL}')) AS e FROM transcripts WHERE text IS NOT NULL) GROUP BY 1,2")
def _(s, d):
    e = texts(s, d).select("ord", F.explode(T.emails(F.col("text"))).alias("e"))
    known = s.createDataFrame([(x,) for x in T.PLACEHOLDER_DOMAINS], "domain string").withColumn("placeholder", F.lit(True))
    j = e.withColumn("domain", F.element_at(F.split(F.lower("e"), "@"), -1)).join(F.broadcast(known), "domain", "left")  # 16 fixed rows
    return j.groupBy("ord", F.coalesce("placeholder", F.lit(False)).alias("placeholder")).agg(F.count(F.lit(1)).alias("n"))
