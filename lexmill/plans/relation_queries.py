"""The substrate on the star-schema and event tables: joins, windows, set operations; extensions named in the design."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import text as T
from lexmill.operators import similar
from lexmill.plans.common import BASE, UNIT, Registry, table, texts
from lexmill.sources import sinks
from lexmill.streaming import cleaning

R = Registry()


@R.add("agg1_agg2_counts", "SELECT count(*) AS n, CAST(count_if(lang_label IS NULL) AS BIGINT) AS unlabelled, CAST(count_if(text IS NULL) AS BIGINT) AS without_text, count(DISTINCT contributor) AS contributors FROM transcripts")
def _(s, d):
    return table(s, d, "transcripts").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang_label").isNull()).alias("unlabelled"), F.count_if(F.col("text").isNull()).alias("without_text"), F.count_distinct("contributor").alias("contributors"))


@R.add("agg8_value_counts", "SELECT lang_label, count(*) AS n FROM transcripts WHERE lang_label IS NOT NULL GROUP BY 1")
def _(s, d):
    return table(s, d, "transcripts").where("lang_label is not null").groupBy("lang_label").agg(F.count(F.lit(1)).alias("n"))


@R.add("agg9_retention", "SELECT source, round(100.0*count_if(n_chars BETWEEN 200 AND 20000)/count(*),2) AS retention_pct FROM documents WHERE source IS NOT NULL GROUP BY source")
def _(s, d):
    return table(s, d, "documents").where("source is not null").groupBy("source").agg(F.round(100.0 * F.count_if(F.col("n_chars").between(200, 20000)) / F.count(F.lit(1)), 2).alias("retention_pct"))


@R.add("jn_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>300000)")
def _(s, d):
    big = table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@R.add("jn_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>300000)")
def _(s, d):
    big = table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@R.add("jn_outer", "SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey GROUP BY n_name")
def _(s, d):
    return table(s, d, "nation").join(table(s, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@R.add("jn_star", "SELECT r_name, l_returnflag, count(*) AS n, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey GROUP BY 1,2")
def _(s, d):
    j = (
        table(s, d, "lineitem").join(table(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    return j.groupBy("r_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


BANDS = [(0, 0.0, 1000.0), (1, 1000.0, 100000.0), (2, 100000.0, 1e12)]


@R.add("jn_range", "SELECT band, count(*) AS n FROM orders JOIN (VALUES (0,0.0,1000.0),(1,1000.0,100000.0),(2,100000.0,1e12)) b(band,lo,hi) ON o_totalprice>=lo AND o_totalprice<hi GROUP BY band")
def _(s, d):
    b = s.createDataFrame(BANDS, "band int, lo double, hi double")
    return table(s, d, "orders").join(F.broadcast(b), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@R.add("set2_set3_unions", "SELECT lang, kind, count(*) AS n FROM (SELECT lang, source AS kind FROM documents UNION ALL SELECT lang, task FROM eval_items UNION ALL SELECT DISTINCT lang, variant FROM sweep_metrics) GROUP BY 1,2")
def _(s, d):
    named = lambda name, kind: table(s, d, name).select("lang", F.col(kind).alias("kind"))
    return named("documents", "source").unionByName(named("eval_items", "task")).unionByName(named("sweep_metrics", "variant").distinct()).groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


@R.add("arr1_arr2_map1", "SELECT event_type, count(*) AS n, round(sum(value),2) AS total FROM events GROUP BY 1")
def _(s, d):
    # the pairs as one map, and the map as rows again: a type of event is one of a few
    g = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    m = g.agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "total")))).alias("m"))
    return m.select(F.explode("m").alias("event_type", "v")).select("event_type", "v.n", "v.total")


@R.add("arr1_arr2_lines", "SELECT doc_id, CAST(len(l) AS BIGINT) AS lines, len(list_filter(l, lambda x: starts_with(x,'#')))>0 AS any_heading, len(list_filter(l, lambda x: length(x)>200))=0 AS all_short FROM (SELECT doc_id, string_split(text,chr(10)) AS l FROM documents WHERE text IS NOT NULL)")
def _(s, d):
    ls = F.split("text", "\n")
    return table(s, d, "documents").where("text is not null").select(
        "doc_id", F.size(ls).cast("bigint").alias("lines"), F.exists(ls, lambda x: x.startswith("#")).alias("any_heading"), F.forall(ls, lambda x: F.length(x) <= 200).alias("all_short")
    )


#: A tokenizer's document as a trainer leaves it: byte tokens marked special.
ADDED = ", ".join(f'{{"id":{k},"content":"{c}","special":true}}' for k, c in enumerate(["[UNK]", *(f"<0x{b:02X}>" for b in range(256)), "<0xZZ>", "<pad>"]))


@R.add("jsn1_patch_flags", f"""SELECT CAST(json_extract(t,'$.id') AS BIGINT) AS id, json_extract_string(t,'$.content') AS content, NOT regexp_matches(json_extract_string(t,'$.content'),'^<0x[0-9A-F]{{2}}>$') AS special, '1.0' AS version
FROM (SELECT unnest(CAST(json_extract('{{"version":"1.0","added_tokens":[{ADDED}]}}','$.added_tokens') AS JSON[])) AS t)""")
def _(s, d):
    schema = "version string, added_tokens array<struct<id: bigint, content: string, special: boolean>>"
    doc = s.createDataFrame([(f'{{"version":"1.0","added_tokens":[{ADDED}]}}',)], "j string")
    patched = doc.select(sinks.unspecial_bytes(F.col("j")).alias("j"))
    return patched.select(F.from_json("j", schema).alias("x")).select("x.version", F.inline("x.added_tokens"))


@R.add("stream_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value),2) AS total FROM events GROUP BY 1,2")
def _(s, d):
    folder, pattern = (f"{d}/events.parquet", "*.parquet") if _is_folder(s, f"{d}/events.parquet") else (d, "events.parquet")
    events = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    got = cleaning.upsert_once(cleaning.hourly(events), "hourly", ["start", "event_type"])
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@R.add("stream_kept", f"{BASE} SELECT DISTINCT md5(text) AS digest FROM good WHERE ord IN (SELECT ord FROM transcripts WHERE ingested_at IS NOT NULL)")
def _(s, d):
    # which of equal texts is the first follows arrival, so the texts that are kept are compared, not their rows
    folder, pattern = (f"{d}/transcripts.parquet", "*.parquet") if _is_folder(s, f"{d}/transcripts.parquet") else (d, "transcripts.parquet")
    return cleaning.append_once(cleaning.kept(cleaning.source(s, folder, pattern)), "kept").select(F.md5("text").alias("digest"))


def _is_folder(s, path: str) -> bool:
    jvm = s.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# What the design memo names and no problem covers.

SCRIPTS = {"latin": r"\p{IsLatin}", "devanagari": r"\p{IsDevanagari}", "telugu": r"\p{IsTelugu}", "tamil": r"\p{IsTamil}", "cyrillic": r"\p{IsCyrillic}", "han": r"\p{IsHan}"}


@R.add("x1_scripts", "SELECT doc_id, " + ", ".join(f"CAST(length(regexp_replace(text,'[^{p.replace('Is', '')}]','','g')) AS BIGINT) AS {n}" for n, p in SCRIPTS.items()) + " FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", *[T.chars(F.regexp_replace("text", f"[^{p}]", "")).alias(n) for n, p in SCRIPTS.items()])


#: Signs after which a joiner has a meaning: the viramas of the Indic scripts.
VIRAMAS = "\u094d\u09cd\u0a4d\u0acd\u0b4d\u0bcd\u0c4d\u0ccd\u0d4d"


@R.add("x2_joiners", f"SELECT doc_id, md5(regexp_replace(text,'(^|[^{VIRAMAS}\u200c\u200d])[\u200c\u200d]+','\\1','g')) AS digest, CAST(length(text)-length(regexp_replace(text,'[\u200c\u200d]','','g')) AS BIGINT) AS joiners FROM documents WHERE text IS NOT NULL")
def _(s, d):
    kept = F.regexp_replace("text", f"(^|[^{VIRAMAS}\u200c\u200d])[\u200c\u200d]+", "$1")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(kept).alias("digest"), (F.length("text") - F.length(F.regexp_replace("text", "[\u200c\u200d]", ""))).cast("bigint").alias("joiners"))


@R.add("x2_digits", "SELECT doc_id, md5(translate(text,'०१२३४५६७८९౦౧౨౩౪౫౬౭౮౯','01234567890123456789')) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(F.translate("text", "०१२३४५६७८९౦౧౨౩౪౫౬౭౮౯", "01234567890123456789")).alias("digest"))


@R.add("x6_heuristics", r"SELECT doc_id, CAST(len(string_split(text,chr(10))) AS BIGINT) AS lines, CAST(list_max(list_transform(string_split(text,chr(10)), lambda x: length(x))) AS BIGINT) AS longest_line, round(length(regexp_replace(text,'[\p{L}\p{M}\p{N}\s]','','g'))/greatest(length(text),1),6) AS symbol_ratio FROM documents WHERE text IS NOT NULL")
def _(s, d):
    ls = F.split("text", "\n")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(ls).cast("bigint").alias("lines"), F.array_max(F.transform(ls, F.length)).cast("bigint").alias("longest_line"), F.round(F.length(F.regexp_replace("text", r"[\p{L}\p{M}\p{N}\s]", "")) / F.greatest(F.length("text"), F.lit(1)), 6).alias("symbol_ratio"))


@R.add("x6_unigram_perplexity", r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text,'[\p{L}\p{M}]+')) AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT w, count(*) AS n FROM w GROUP BY w), a AS (SELECT sum(n) AS total FROM c), p AS (SELECT doc_id, round(exp(-avg(ln(n/total))),2) AS perplexity FROM w JOIN c USING (w), a GROUP BY doc_id) SELECT doc_id, perplexity FROM documents LEFT JOIN p USING (doc_id) WHERE text IS NOT NULL")
def _(s, d):
    # words of every script; a text without a word has no perplexity
    docs = table(s, d, "documents").where("text is not null")
    per = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("k"))
    c = per.groupBy("w").agg(F.sum("k").alias("n"))
    j = per.join(c, "w").crossJoin(F.broadcast(c.agg(F.sum("n").alias("total"))))  # one row
    p = j.groupBy("doc_id").agg(F.round(F.exp(-F.sum(F.col("k") * F.log(F.col("n") / F.col("total"))) / F.sum("k")), 2).alias("perplexity"))
    return docs.select("doc_id").join(p, "doc_id", "left")


@R.add("x6_boilerplate", "WITH l AS (SELECT doc_id, unnest(string_split(text,chr(10))) AS line FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, line FROM l WHERE line<>''), n AS (SELECT line, count(DISTINCT doc_id) AS docs FROM k GROUP BY line) SELECT doc_id, count(*) AS lines, CAST(count_if(docs>=10) AS BIGINT) AS repeated FROM k JOIN n USING (line) GROUP BY doc_id")
def _(s, d):
    # lines that stand in ten documents or more, as menus and footers do; only digests of lines are shuffled
    line = F.explode(F.split("text", "\n")).alias("line")
    k = table(s, d, "documents").where("text is not null").select("doc_id", line).where("line <> ''").select("doc_id", F.unhex(F.md5("line")).alias("line"))
    per = k.groupBy("line", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    n = per.groupBy("line").agg(F.count(F.lit(1)).alias("docs"))
    return per.join(n, "line").groupBy("doc_id").agg(F.sum("k").alias("lines"), F.sum(F.when(F.col("docs") >= 10, F.col("k")).otherwise(0)).alias("repeated"))


#: Names of permissive licences as files state them.
LICENCES = r"MIT License|Apache License|BSD [23]-Clause|ISC License|The Unlicense|Mozilla Public License|Boost Software License"
SECRET = r"(?i)(api[_-]?key|secret|password|token)[ ]*[=:]"


@R.add("x7_code_rules", rf"WITH c AS (SELECT doc_id, text, regexp_replace(text,'[ \t]+',' ','g') AS k FROM documents WHERE source='code_cells' AND text IS NOT NULL) SELECT doc_id, list_max(list_transform(string_split(text,chr(10)), lambda x: length(x)))>500 AS minified, regexp_matches(text,'{SECRET}') AS secret, regexp_matches(text,'{LICENCES}') AS permissive, min(doc_id) OVER (PARTITION BY k)=doc_id AS first_of_copies FROM c")
def _(s, d):
    c = table(s, d, "documents").where("source = 'code_cells' and text is not null")
    rules = c.select(
        "doc_id", (F.array_max(F.transform(F.split("text", "\n"), F.length)) > 500).alias("minified"), F.col("text").rlike(SECRET).alias("secret"), F.col("text").rlike(LICENCES).alias("permissive"),
        F.unhex(F.md5(F.regexp_replace("text", "[ \t]+", " "))).alias("k"),
    )
    first = rules.groupBy("k").agg(F.min("doc_id").alias("first"))
    return rules.join(first, "k").select("doc_id", "minified", "secret", "permissive", (F.col("first") == F.col("doc_id")).alias("first_of_copies"))


#: Shapes of Indian tax, identity and telephone numbers, and where each goes.
MASKS = (("[A-Z]{5}[0-9]{4}[A-Z]", "[PAN]"), ("[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", "[AADHAAR]"), (r"(\+91[ -]?|0)[6-9][0-9]{4}[ -]?[0-9]{5}", "[PHONE]"))


def _masked_sql(c: str) -> str:
    for pattern, to in MASKS:
        c = f"regexp_replace({c},'{pattern}','{to}','g')"
    return c


@R.add("x9_masks", f"SELECT ord, md5({_masked_sql('text')}) AS digest FROM transcripts WHERE text IS NOT NULL")
def _(s, d):
    c = F.col("text")
    for pattern, to in MASKS:
        c = F.regexp_replace(c, pattern, to.replace("$", r"\$"))
    return texts(s, d).select("ord", F.md5(c).alias("digest"))


QUOTA = "WITH n AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), q AS (SELECT source, target_share*100 AS exact, floor(target_share*100) AS base FROM mix_targets), r AS (SELECT *, row_number() OVER (ORDER BY exact-base DESC, source) AS k, 100-sum(base) OVER () AS left_ FROM q)"


@R.add("x11_quotas", QUOTA + " SELECT source, CAST(base+CASE WHEN k<=left_ THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r")
def _(s, d):
    q = table(s, d, "mix_targets").select("source", (F.col("target_share") * 100).alias("exact")).withColumn("base", F.floor("exact"))
    k = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("base")), "source"))  # a row a source
    r = q.withColumn("k", k).withColumn("rest", 100 - F.sum("base").over(Window.partitionBy()))
    return r.select("source", (F.col("base") + (F.col("k") <= F.col("rest")).cast("int")).cast("bigint").alias("quota"))


#: The memo's vocabulary budget, and its target fertilities by group of languages (tokens a word).
BUDGET = [("latin", 42000), ("tier 1 scripts", 90000), ("tier 2 languages", 26000), ("code", 38000), ("math", 10000), ("world languages", 8000), ("reserved", 2000), ("bytes", 256)]
TARGETS = [("en", 1.15, 1.30), ("hi", 1.4, 1.6), ("te", 1.4, 1.6), ("ta", 1.4, 1.6), ("sa", 1.8, 2.2), ("mai", 1.8, 2.2)]


@R.add("x12_vocabulary_budget", f"SELECT CAST(sum(n) AS BIGINT) AS raw, CAST(ceil(sum(n)/32000)*32000+32000 AS BIGINT) AS rounded, CAST(pow(2,ceil(log2(ceil(sum(n)/32000)*32000+32000))) AS BIGINT) AS padded FROM (VALUES {', '.join(f'({n!r},{k})' for n, k in BUDGET)}) b(part,n)")
def _(s, d):
    # the raw sum, a step of 32,000 more than the next such multiple for growth, the next power of two
    b = s.createDataFrame(BUDGET, "part string, n bigint").agg(F.sum("n").alias("raw")).withColumn("rounded", (F.ceil(F.col("raw") / 32000) * 32000 + 32000).cast("bigint"))
    return b.withColumn("padded", F.pow(F.lit(2), F.ceil(F.log2("rounded"))).cast("bigint"))


@R.add("x13_kpi_bands", f"WITH f AS (SELECT run_id, lang, sum(tokens)/sum(wordish_units) AS ratio FROM sweep_metrics GROUP BY 1,2) SELECT run_id, lang, CASE WHEN ratio<lo THEN 'below' WHEN ratio>hi THEN 'above' ELSE 'within' END AS band FROM f JOIN (VALUES {', '.join(f'({n!r},{a},{b})' for n, a, b in TARGETS)}) t(lang,lo,hi) USING (lang)")
def _(s, d):
    t = s.createDataFrame(TARGETS, "lang string, lo double, hi double")
    f = table(s, d, "sweep_metrics").groupBy("run_id", "lang").agg((F.sum("tokens") / F.sum("wordish_units")).alias("ratio"))
    band = F.when(F.col("ratio") < F.col("lo"), "below").when(F.col("ratio") > F.col("hi"), "above").otherwise("within")
    return f.join(F.broadcast(t), "lang").select("run_id", "lang", band.alias("band"))  # a row a language


@R.add("x14_tiers", "SELECT coalesce(tier,3) AS tier, count(*) AS n FROM documents LEFT JOIN (VALUES ('en',0),('hi',1),('te',1),('ta',1),('mai',2),('sa',2)) v(lang,tier) USING (lang) GROUP BY 1")
def _(s, d):
    v = s.createDataFrame([("en", 0), ("hi", 1), ("te", 1), ("ta", 1), ("mai", 2), ("sa", 2)], "lang string, tier int")
    return table(s, d, "documents").join(F.broadcast(v), "lang", "left").groupBy(F.coalesce("tier", F.lit(3)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@R.add("x15_digit_split", r"SELECT doc_id, CAST(len(regexp_extract_all(text,'\p{Nd}|[\p{L}\p{M}]+')) AS BIGINT) AS pieces FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.regexp_count("text", F.lit(r"\p{Nd}|[\p{L}\p{M}]+")).cast("bigint").alias("pieces"))


LINKED = r"""WITH RECURSIVE d AS (SELECT doc_id, {group} AS g, regexp_extract_all(lower(text),'[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT g, w, min(doc_id) AS o, count(*) AS copies FROM d WHERE len(w)>0 GROUP BY g, w),
s AS (SELECT o, list_distinct(list_transform(range(1,greatest(len(w)-3,2)), lambda k: array_to_string(w[k:k+4],' '))) AS s, g FROM t),
e AS (SELECT o, unnest(s) AS x, g FROM s), n AS (SELECT o, len(s) AS n FROM s),
c AS (SELECT a.o AS a, b.o AS b, count(*) AS c FROM e a JOIN e b ON a.x=b.x AND a.g IS NOT DISTINCT FROM b.g AND a.o<b.o GROUP BY 1,2),
l AS (SELECT a, b FROM c JOIN n na ON na.o=a JOIN n nb ON nb.o=b WHERE c>=0.8*(na.n+nb.n-c))"""
WORDS5 = LINKED + """, k AS (SELECT o, count(*) AS links FROM (SELECT a AS o FROM l UNION ALL SELECT b FROM l) GROUP BY o)
SELECT doc_id, coalesce(links,0) AS links, copies FROM d JOIN t ON t.w=d.w AND t.g IS NOT DISTINCT FROM d.g LEFT JOIN k USING (o)"""


@R.add("x3_near_duplicates", WORDS5.format(group="CAST(NULL AS VARCHAR)"))
def _(s, d):
    return similar.near_duplicates(table(s, d, "documents")).select("doc_id", "links", "copies")


@R.add("x3_classes", LINKED.format(group="CAST(NULL AS VARCHAR)") + """, b AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(o, c) AS (SELECT o, o FROM t UNION SELECT r.o, b.b FROM r JOIN b ON b.a=r.c), k AS (SELECT o, min(c) AS class_id FROM r GROUP BY o)
SELECT doc_id, class_id FROM d JOIN t ON t.w=d.w AND t.g IS NOT DISTINCT FROM d.g JOIN k USING (o)""")
def _(s, d):
    return similar.near_duplicates(table(s, d, "documents")).select("doc_id", "class_id")


@R.add("x4_near_duplicates_by_language", WORDS5.format(group="lang"))
def _(s, d):
    return similar.near_duplicates(table(s, d, "documents"), within="lang").select("doc_id", "links", "copies")


@R.add("x5_alike_across_labels", "SELECT q.vec_id, e.vec_id AS other, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])),5) AS similarity FROM embeddings q JOIN embeddings e ON CAST(q.label AS VARCHAR)<>CAST(e.label AS VARCHAR) WHERE q.vec_id%20=0 AND list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))>=0.25")
def _(s, d):
    # a label stands for a language, as the vectors have none; queries are every id divisible by 20
    e = table(s, d, "embeddings")
    return similar.alike_vectors(e.where("vec_id % 20 = 0"), e, 0.25).withColumn("similarity", F.round("similarity", 5))


@R.add("x4_language_duplicates", "SELECT lang, count(*)-count(DISTINCT text) AS copies FROM documents WHERE text IS NOT NULL GROUP BY lang")
def _(s, d):
    return table(s, d, "documents").where("text is not null").groupBy("lang").agg((F.count(F.lit(1)) - F.count_distinct(F.md5("text"))).alias("copies"))


@R.add("x1_units_by_language", f"SELECT lang, CAST(sum(len(regexp_extract_all(text,'{UNIT}'))) AS BIGINT) AS units FROM documents WHERE text IS NOT NULL GROUP BY lang")
def _(s, d):
    return table(s, d, "documents").where("text is not null").groupBy("lang").agg(F.sum(T.units(F.col("text"))).alias("units"))
