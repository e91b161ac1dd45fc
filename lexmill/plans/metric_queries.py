"""Fertility, tokenizers, vocabularies and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import text as T
from lexmill.functions import vectors as V
from lexmill.operators import bpe, metrics, numeric
from lexmill.plans.common import UNIT, WS, Registry, table
from lexmill.sources import readers, sinks

R = Registry()
#: Fixed value: the published vocabulary size.
VOCAB = 10_000

LATEST = """WITH latest AS (SELECT * FROM sweep_metrics WHERE ratio IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, lang ORDER BY logged_at DESC, tokens DESC, wordish_units DESC, unk DESC, weight DESC, variant DESC, ratio DESC)=1)"""


@R.add("agg11_agg13_fertility", "SELECT lang, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(wordish_units) AS BIGINT) AS wordish_units, CAST(sum(unk) AS BIGINT) AS unk, round(sum(tokens)/sum(wordish_units),6) AS ratio FROM sweep_metrics GROUP BY lang")
def _(s, d):
    return metrics.fertility(table(s, d, "sweep_metrics")).withColumn("ratio", F.round("ratio", 6))


SPREAD = LATEST + """, r AS (SELECT run_id, min(ratio) AS min_ratio, max(ratio) AS max_ratio, arg_min(lang, (ratio, lang)) AS min_lang, arg_max(lang, (ratio, lang)) AS max_lang FROM latest GROUP BY run_id)"""


@R.add("agg14_agg15_spread", SPREAD + " SELECT run_id, min_lang, max_lang, round(max_ratio-min_ratio,6) AS spread, round(CASE WHEN max_ratio>min_ratio THEN 1000/(max_ratio-min_ratio) END,3) AS score FROM r")
def _(s, d):
    got = metrics.spread(metrics.latest_runs(table(s, d, "sweep_metrics")), "run_id")
    return got.select("run_id", "min_lang", "max_lang", F.round("spread", 6).alias("spread"), F.round("score", 3).alias("score"))


@R.add("agg16_penalty", SPREAD + ", p AS (SELECT run_id, exp(greatest(0, max(ratio)/1.2-1)) AS penalty FROM latest WHERE lang='hi' GROUP BY run_id) SELECT run_id, round(penalty,6) AS penalty, round(CASE WHEN max_ratio>min_ratio THEN 1000/(max_ratio-min_ratio) END/penalty,3) AS adjusted_score FROM r LEFT JOIN p USING (run_id)")
def _(s, d):
    got = metrics.penalised(metrics.latest_runs(table(s, d, "sweep_metrics")), "hi", "run_id")
    return got.select("run_id", F.round("penalty", 6).alias("penalty"), F.round("adjusted_score", 3).alias("adjusted_score"))


@R.add("srt2_flt9_sweep_ranking", SPREAD + " SELECT run_id, round(1000/(max_ratio-min_ratio),3) AS score, round(min_ratio,6) AS min_ratio FROM r WHERE min_ratio<1.19 ORDER BY 1000/(max_ratio-min_ratio) DESC NULLS LAST, run_id LIMIT 12")
def _(s, d):
    return metrics.sweep_ranking(table(s, d, "sweep_metrics")).select("run_id", F.round("score", 3).alias("score"), F.round("min_ratio", 6).alias("min_ratio"))


@R.add("flt10_feasible", SPREAD + " SELECT run_id, min_ratio<1.2 AS feasible FROM r")
def _(s, d):
    return metrics.spread(metrics.latest_runs(table(s, d, "sweep_metrics")), "run_id").select("run_id", (F.col("min_ratio") < metrics.FEASIBLE_BELOW).alias("feasible"))


@R.add("srt1_t12_report", "SELECT lang, round(sum(tokens)/sum(wordish_units),6) AS ratio, rank() OVER (ORDER BY sum(tokens)/sum(wordish_units)) AS place FROM sweep_metrics GROUP BY lang")
def _(s, d):
    r = metrics.fertility(table(s, d, "sweep_metrics"))
    return r.select("lang", F.round("ratio", 6).alias("ratio"), F.rank().over(Window.orderBy("ratio")).cast("bigint").alias("place"))  # a row a language


@R.add("jn3_weighted_units", f"SELECT c.lang, c.variant, CAST(len(regexp_extract_all(c.text,'{UNIT}'))*coalesce(w.weight,1) AS BIGINT) AS weighted FROM corpus c LEFT JOIN bpe_weights w USING (lang)")
def _(s, d):
    w = table(s, d, "bpe_weights")
    return table(s, d, "corpus").join(w, "lang", "left").select("lang", "variant", (T.units(F.col("text")) * F.coalesce("weight", F.lit(1))).alias("weighted"))


@R.add("jn8_src13_grid", "SELECT CAST(a.x AS INT) AS en, CAST(b.x AS INT) AS hi, CAST(c.x AS INT) AS te, CAST(e.x AS INT) AS sa FROM range(2,6) a(x), range(5,8) b(x), range(8,11) c(x), range(9,12) e(x)")
def _(s, d):
    return metrics.parameter_grid(s, readers.SWEEP)


@R.add("src8_literals", "SELECT * FROM (VALUES ('en','English'),('hi','Hindi'),('te','Telugu'),('sa','Sanskrit'),('mai','Maithili')) v(lang,name)")
def _(s, d):
    return readers.language_names(s)


@R.add("snk4_meta_agreement", f"SELECT DISTINCT m.lang, m.variant, m.chars=length(c.text) AS chars_agree, m.wordish_units=len(regexp_extract_all(c.text,'{UNIT}')) AS units_agree FROM corpus_meta m JOIN corpus c USING (lang, variant)")
def _(s, d):
    c = table(s, d, "corpus").select("lang", "variant", T.chars(F.col("text")).alias("c"), T.units(F.col("text")).alias("u"))
    return table(s, d, "corpus_meta").join(c, ["lang", "variant"]).select("lang", "variant", (F.col("chars") == F.col("c")).alias("chars_agree"), (F.col("wordish_units") == F.col("u")).alias("units_agree")).distinct()


PRE = "CASE WHEN text='' THEN [] ELSE regexp_extract_all(CASE WHEN starts_with(replace(text,' ','▁'),'▁') THEN replace(text,' ','▁') ELSE '▁'||replace(text,' ','▁') END,'▁[^▁]*') END"


@R.add("t3_space_pretokens", f"SELECT doc_id, CAST(len({PRE}) AS BIGINT) AS n, md5(array_to_string({PRE},chr(1))) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", bpe.space_pretokens(F.col("text")).alias("p")).select("doc_id", F.size("p").cast("bigint").alias("n"), F.md5(F.array_join("p", "\x01")).alias("digest"))


#: A sample after it was cut into pre-tokens and put together again.
BACK = f"regexp_replace(replace(array_to_string({PRE},''),'▁',' '),'^ ','')"


@R.add("agg17_gate", f"SELECT text AS sample, md5({BACK}) AS back, regexp_replace({BACK},'{WS}','','g')=regexp_replace(text,'{WS}','','g') AS same FROM (SELECT sample AS text FROM gate_samples UNION ALL SELECT text FROM corpus)")
def _(s, d):
    texts = table(s, d, "gate_samples").select(F.col("sample").alias("text")).unionByName(table(s, d, "corpus").select("text"))
    back = F.regexp_replace(F.replace(F.array_join(bpe.space_pretokens(F.col("text")), ""), F.lit(bpe.SPACE), F.lit(" ")), "^ ", "")
    return texts.select(F.col("text").alias("sample"), F.md5(back).alias("back"), (T.visible(back) == T.visible(F.col("text"))).alias("same"))


@R.add("agg17_all_pass", f"SELECT bool_and(regexp_replace({BACK},'{WS}','','g')=regexp_replace(text,'{WS}','','g')) AS passed FROM documents WHERE text IS NOT NULL AND NOT contains(text,'▁')")
def _(s, d):
    texts = table(s, d, "documents").where("text is not null and not contains(text, '▁')")
    back = F.regexp_replace(F.replace(F.array_join(bpe.space_pretokens(F.col("text")), ""), F.lit(bpe.SPACE), F.lit(" ")), "^ ", "")
    return metrics.gate(texts.select(F.col("text").alias("before"), back.alias("after")))


PIECES = f"regexp_extract_all(text,'[{bpe.WORD}]+|[^{bpe.WORD}{bpe.BLANK}]+')"


@R.add("t1_word_pretokens", f"SELECT doc_id, CAST(len({PIECES}) AS BIGINT) AS n, md5(array_to_string({PIECES},chr(1))) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    p = table(s, d, "documents").where("text is not null").select("doc_id", bpe.word_pretokens(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("bigint").alias("n"), F.md5(F.array_join("p", "\x01")).alias("digest"))


@R.add("t1_lossy_pretokens")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", bpe.lossy_pretokens(F.col("text")).alias("tokens"))


COUNTS = f"""WITH l AS (SELECT lang, coalesce(weight,1) AS weight, unnest(regexp_extract_all(text,'[^\\n]*\\n|[^\\n]+')) AS text FROM corpus LEFT JOIN bpe_weights USING (lang)),
counts AS (SELECT word, CAST(sum(weight) AS BIGINT) AS n FROM (SELECT weight, unnest({PRE}) AS word FROM l) GROUP BY word)"""


@R.add("t4_agg23_word_counts", COUNTS + " SELECT word, n FROM counts")
def _(s, d):
    return bpe.word_counts(table(s, d, "corpus"), table(s, d, "bpe_weights"))


@R.add("t5_agg24_pair_counts", COUNTS + ", p AS (SELECT n, string_split(word,'') AS c FROM counts), e AS (SELECT n, c, unnest(range(1,len(c))) AS i FROM p WHERE len(c)>1) SELECT c[i] AS left_, c[i+1] AS right_, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY 1,2")
def _(s, d):
    got = bpe.pair_counts(bpe.word_counts(table(s, d, "corpus"), table(s, d, "bpe_weights")))
    return got.select(F.col("left").alias("left_"), F.col("right").alias("right_"), "n")


RANKS = ", p AS (SELECT n, string_split(word,'') AS c FROM counts), e AS (SELECT n, c, unnest(range(1,len(c))) AS i FROM p WHERE len(c)>1), pc AS (SELECT c[i] AS l, c[i+1] AS r, sum(n) AS n FROM e GROUP BY 1,2), ranks AS (SELECT l, r, row_number() OVER (ORDER BY n DESC, l, r)-1 AS rank FROM pc QUALIFY rank<2000)"


@R.add("jn5_srt6_best_merge", COUNTS + RANKS + ", w AS (SELECT word, string_split(word,'') AS c FROM counts WHERE length(word)>1), q AS (SELECT word, c, unnest(range(1,len(c))) AS place FROM w), j AS (SELECT word, place, rank FROM q JOIN ranks ON l=c[place] AND r=c[place+1]) SELECT word, CAST(arg_min(place, (rank, place)) AS BIGINT) AS place, CAST(min(rank) AS BIGINT) AS rank FROM j GROUP BY word")
def _(s, d):
    # the most frequent pairs as a merge table, and each word's first merge by it
    counts = bpe.word_counts(table(s, d, "corpus"), table(s, d, "bpe_weights"))
    ranked = bpe.pair_counts(counts).select("left", "right", (F.row_number().over(Window.orderBy(F.desc("n"), "left", "right")) - 1).alias("rank"))  # as many rows as pairs of characters
    got = bpe.best_merges(counts, F.broadcast(ranked.where("rank < 2000")))
    return got.select("word", F.col("at").cast("bigint").alias("place"), F.col("rank").cast("bigint").alias("rank"))


@R.add("set1_replication", "SELECT lang, CAST(sum(weight) AS BIGINT) AS copies FROM (SELECT lang, weight, unnest(range(weight)) AS k FROM bpe_weights WHERE weight IS NOT NULL) GROUP BY lang, weight")
def _(s, d):
    copies = table(s, d, "bpe_weights").where("weight is not null").select("lang", "weight", F.explode(F.sequence(F.lit(1), "weight")))
    return copies.groupBy("lang", "weight").agg(F.sum("weight").alias("copies")).select("lang", "copies")


def _lossless(s, d, size=VOCAB):
    corpus = table(s, d, "corpus").where("variant = 'lossless'")
    return corpus, bpe.train(corpus, table(s, d, "bpe_weights"), size)


@R.add("t5_vocabulary")
def _(s, d):
    return bpe.vocabulary(s, _lossless(s, d)[1])


@R.add("t5_merges")
def _(s, d):
    return bpe.merge_table(s, _lossless(s, d)[1])


@R.add("t6_t8_encoded")
def _(s, d):
    corpus, e = _lossless(s, d)
    return bpe.encode(corpus.select("lang", "text"), e).select("lang", F.size("tokens").alias("n_tokens"), "tokens")


@R.add("t9_t11_round_trip")
def _(s, d):
    corpus, e = _lossless(s, d)
    samples = table(s, d, "gate_samples").select(F.col("sample").alias("text")).unionByName(corpus.select("text"))
    return metrics.gate(bpe.encode(samples, e), "text", "decoded")


@R.add("t12_measured")
def _(s, d):
    corpus, e = _lossless(s, d)
    return metrics.fertility(bpe.measured(corpus, e))


@R.add("t12_lossy_measured")
def _(s, d):
    corpus = table(s, d, "corpus").where("variant = 'lossy'")
    e = bpe.train(corpus, readers.weights(s, "lossy"), VOCAB, bpe.lossy_pretokens, ["[UNK]"])
    return metrics.penalised(metrics.fertility(bpe.measured(corpus, e, bpe.lossy_pretokens)), "hi")


@R.add("t13_sweep")
def _(s, d):
    grid = metrics.parameter_grid(s, readers.SWEEP)
    config = grid.select("*", (((F.col("en") * 100 + F.col("hi")) * 100 + F.col("te")) * 100 + F.col("sa")).cast("bigint").alias("config"))
    return metrics.spread(bpe.sweep(table(s, d, "corpus").where("variant = 'lossless'"), config, VOCAB), "config")


ALPHABET = "SELECT CAST(row_number() OVER (ORDER BY unicode(c))-1 AS BIGINT) AS id, c AS token FROM (SELECT DISTINCT unnest(string_split(text,'')) AS c FROM corpus) WHERE c<>''"


def _alphabet(s, d):
    cs = table(s, d, "corpus").select(F.explode(F.split("text", "")).alias("token")).where("token <> ''").distinct()
    code = F.ascii("token")  # the code point of the first character
    return cs.select((F.row_number().over(Window.orderBy(code)) - 1).cast("bigint").alias("id"), "token")  # one row a character


@R.add("win5_t14_alphabet_ids", ALPHABET)
def _(s, d):
    return _alphabet(s, d)


@R.add("win6_srt5_pages", f"WITH v AS ({ALPHABET}) SELECT id, token, CAST(floor(id/250) AS BIGINT) AS page FROM v ORDER BY id LIMIT 250 OFFSET 100")
def _(s, d):
    return _alphabet(s, d).orderBy("id").offset(100).limit(250).select("id", "token", F.floor(F.col("id") / 250).cast("bigint").alias("page"))


@R.add("snk7_srt3_vocabulary_lines", f"WITH v AS ({ALPHABET}) SELECT id||chr(9)||token AS line FROM v")
def _(s, d):
    return sinks.vocabulary_lines(_alphabet(s, d))


@R.add("jn6_jn9_token_ids", f"WITH v AS ({ALPHABET}) SELECT g.sample, CAST(count(v.id) AS BIGINT) AS known, CAST(sum(v.id) AS BIGINT) AS id_sum FROM (SELECT sample, unnest(string_split(sample,'')) AS c FROM gate_samples) g LEFT JOIN v ON v.token=g.c WHERE g.c<>'' GROUP BY 1")
def _(s, d):
    g = table(s, d, "gate_samples").select("sample", F.explode(F.split("sample", "")).alias("token")).where("token <> ''")
    return g.join(_alphabet(s, d), "token", "left").groupBy("sample").agg(F.count("id").alias("known"), F.sum("id").alias("id_sum"))


@R.add("arr4_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)*x))),5) AS norm FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"))


Q20 = "SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id%20=0"


@R.add("n10_jn7_win3_neighbours", f"SELECT q AS vec_id, v AS neighbour, CAST(k AS INT) AS rank, round(sim,5) AS similarity FROM (SELECT q, vec_id AS v, list_cosine_similarity(a, CAST(embedding AS DOUBLE[])) AS sim, row_number() OVER (PARTITION BY q ORDER BY list_cosine_similarity(a, CAST(embedding AS DOUBLE[])) DESC, vec_id) AS k FROM ({Q20}), embeddings WHERE vec_id<>q) WHERE k<=2")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return numeric.neighbours(e.where("vec_id % 20 = 0 and embedding is not null"), e).withColumn("similarity", F.round("similarity", 5))


@R.add("agg20_covariance", "SELECT i, j, round(covar_samp(x,y),4)+0.0 AS cov FROM (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) a JOIN (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS j, CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings) b USING (vec_id) GROUP BY i, j")
def _(s, d):
    return numeric.covariance(table(s, d, "embeddings")).select("i", "j", (F.round("cov", 4) + 0.0).alias("cov"))


#: Power iteration on the covariances as a list of rows; the second direction without the first one's part.
PRINCIPAL = """WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT vec_id, unnest(range(len(e))) AS i, unnest(e) AS x FROM x),
c AS (SELECT a.i, b.i AS j, covar_samp(a.x,b.x) AS c FROM l a JOIN l b USING (vec_id) GROUP BY 1,2),
m AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM c GROUP BY i)),
mean AS (SELECT list(a ORDER BY i) AS mean FROM (SELECT i, avg(x) AS a FROM l GROUP BY i)),
p(k, v) AS (SELECT 0, list_transform(range(len(m)), lambda t: CASE WHEN t=0 THEN 1.0::DOUBLE ELSE 0.13::DOUBLE END) FROM m
 UNION ALL SELECT k+1, list_transform(w, lambda t: t/sqrt(list_dot_product(w,w))) FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r,v)) AS w FROM p, m WHERE k<80)),
one AS (SELECT v AS v1, list_dot_product(list_transform(m, lambda r: list_dot_product(r,v)),v) AS top FROM p, m WHERE k=80),
q(k, v) AS (SELECT 0, list_transform(range(len(m)), lambda t: CASE WHEN t=1 THEN 1.0::DOUBLE ELSE -0.07::DOUBLE END) FROM m
 UNION ALL SELECT k+1, list_transform(y, lambda t: t/sqrt(list_dot_product(y,y))) FROM (SELECT k, list_transform(list_zip(w,v1), lambda t: t[1]-d*t[2]) AS y FROM (SELECT k, v1, w, list_dot_product(w,v1) AS d FROM
 (SELECT k, v1, list_transform(list_zip(list_transform(m, lambda r: list_dot_product(r,v)),v1), lambda t: t[1]-g*t[2]) AS w FROM (SELECT k, v, m, v1, top*list_dot_product(v1,v) AS g FROM q, m, one WHERE k<80))))),
two AS (SELECT v AS v2 FROM q WHERE k=80)
SELECT vec_id, round(list_dot_product(z,v1),3)+0.0 AS pc1, round(list_dot_product(z,v2),3)+0.0 AS pc2 FROM (SELECT vec_id, list_transform(list_zip(e,mean), lambda t: t[1]-t[2]) AS z FROM x, mean), one, two"""


@R.add("n9_principal_two", PRINCIPAL)
def _(s, d):
    got = numeric.principal_two(table(s, d, "embeddings").where("embedding is not null"), "vec_id")
    return got.select("vec_id", (F.round("pc1", 3) + 0.0).alias("pc1"), (F.round("pc2", 3) + 0.0).alias("pc2"))


@R.add("arr6_softmax", "SELECT vec_id, round(list_max(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)-list_max(embedding))))/list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)-list_max(embedding)))),6) AS top FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(F.array_max(V.softmax(F.transform("embedding", lambda x: x.cast("double")))), 6).alias("top"))


@R.add("arr7_arr8_activations", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: 1/(1+exp(-greatest(-40,least(40,CAST(x AS DOUBLE))))))),4) AS sigmoids, round(list_sum(list_transform(embedding, lambda x: greatest(0,CAST(x AS DOUBLE)))),4) AS relus FROM embeddings")
def _(s, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", F.round(V.total(F.transform(e, V.sigmoid)), 4).alias("sigmoids"), F.round(V.total(V.relu(e)), 4).alias("relus"))


@R.add("arr5_mat_vec", "SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), list_transform(range(len(embedding)), lambda k: CAST(k AS DOUBLE))),4) AS first, round(list_sum(CAST(embedding AS DOUBLE[])),4) AS second FROM embeddings")
def _(s, d):
    e = F.col("embedding")
    rows = F.array(F.transform(e, lambda x, k: k.cast("double")), F.transform(e, lambda x: F.lit(1.0)))
    got = V.mat_vec(rows, e)
    return table(s, d, "embeddings").select("vec_id", F.round(got[0], 4).alias("first"), F.round(got[1], 4).alias("second"))


@R.add("snk9_report", "SELECT printf('%-10s%9d%10d%11.4f', lang, tokens, units, ratio) AS line FROM (SELECT lang, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(wordish_units) AS BIGINT) AS units, sum(tokens)/sum(wordish_units) AS ratio FROM sweep_metrics GROUP BY lang)")
def _(s, d):
    r = metrics.fertility(table(s, d, "sweep_metrics")).orderBy("ratio")
    return r.select(F.format_string("%-10s%9d%10d%11.4f", "lang", "tokens", "wordish_units", "ratio").alias("line"))


@R.add("agg12_unknown", "SELECT variant, CAST(sum(unk) AS BIGINT) AS unk, CAST(count_if(unk>0) AS BIGINT) AS rows_with FROM sweep_metrics GROUP BY variant")
def _(s, d):
    return table(s, d, "sweep_metrics").groupBy("variant").agg(F.sum("unk").alias("unk"), F.count_if(F.col("unk") > 0).alias("rows_with"))


@R.add("snk5_metrics_json", "SELECT lang, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(wordish_units) AS BIGINT) AS wordish_units FROM sweep_metrics GROUP BY lang")
def _(s, d):
    packed = metrics.fertility(table(s, d, "sweep_metrics")).select(F.to_json(F.struct("lang", "tokens", "wordish_units")).alias("j"))
    return packed.select(F.from_json("j", "lang string, tokens bigint, wordish_units bigint").alias("x")).select("x.*")


BYTE_SQL = "SELECT DISTINCT c AS token, array_to_string(list_transform(regexp_extract_all(hex(encode(c)),'..'), lambda h: '<0x'||h||'>'),'') AS fallback FROM (SELECT unnest(string_split(sample,'')) AS c FROM gate_samples) WHERE c<>''"


@R.add("t7_byte_fallback", BYTE_SQL)
def _(s, d):
    cs = table(s, d, "gate_samples").select(F.explode(F.split("sample", "")).alias("token")).where("token <> ''").distinct()
    pairs = F.regexp_extract_all(F.hex(F.encode("token", "UTF-8")), F.lit(".."), F.lit(0))
    return cs.select("token", F.array_join(F.transform(pairs, lambda h: F.concat(F.lit("<0x"), h, F.lit(">"))), "").alias("fallback"))


@R.add("t10_byte_flags", "SELECT CAST(i AS INT) AS id, '<0x'||lpad(upper(to_hex(i)),2,'0')||'>' AS token, true AS is_byte FROM range(256) r(i)")
def _(s, d):
    return bpe.vocabulary(s, bpe.Encoder(bpe.BYTES, []))
