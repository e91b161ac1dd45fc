"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import format_duplicates, garbled, languages, leaks, lookalikes, mixing, pairs, personal, tokens
from lexmill.session import read_spread

#: Tables of long texts, with their key.
KEYS = {"transcripts": "ord", "documents": "doc_id"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_spread(spark, path, KEYS[name]) if name in KEYS else spark.read.parquet(path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: languages.found(_table(s, d, "transcripts")),
        "p1_segments": lambda s, d: languages.segments(t := _table(s, d, "transcripts"), languages.train(t)),
        "p1_documents": lambda s, d: languages.documents(t := _table(s, d, "transcripts"), languages.train(t)),
        "p2_found": lambda s, d: pairs.check(_table(s, d, "transcripts")),
        "p3_found": lambda s, d: lookalikes.found(_table(s, d, "transcripts")),
        "p3_normalised": lambda s, d: lookalikes.normalise(_table(s, d, "transcripts")),
        "p4_found": lambda s, d: leaks.found(_table(s, d, "transcripts"), _table(s, d, "eval_items")),
        "p4_overlaps": lambda s, d: leaks.overlaps(_table(s, d, "transcripts"), _table(s, d, "eval_items")),
        "p5_found": lambda s, d: personal.found(_table(s, d, "transcripts")),
        "p5_redacted": lambda s, d: personal.redact(t := _table(s, d, "transcripts"), personal.train(t)),
        "p6_found": lambda s, d: format_duplicates.found(_table(s, d, "transcripts")),
        "p6_collapsed": lambda s, d: format_duplicates.collapse(_table(s, d, "transcripts")),
        "p7_ids": lambda s, d: tokens.encode(_table(s, d, "documents")),
        "p8_mixture": lambda s, d: mixing.mixture(_table(s, d, "documents"), _table(s, d, "mix_targets")),
        "p7_decoded": lambda s, d: tokens.decode(tokens.encode(_table(s, d, "documents"))),
        "p8_shares": lambda s, d: mixing.shares(_table(s, d, "documents"), _table(s, d, "mix_targets")),
        "p9_found": lambda s, d: garbled.found(_table(s, d, "documents")),
        "p9_restored": lambda s, d: garbled.restored(_table(s, d, "documents")),
    }


#: A word: letters, marks and digits in a row.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def _grams_sql(key: str, name: str, n: int) -> str:
    return f"""(SELECT DISTINCT {key}, array_to_string(w[k:k+{n - 1}],' ') AS s FROM (SELECT {key}, w, unnest(range(1,len(w)-{n - 2})) AS k
 FROM (SELECT {key}, regexp_extract_all(lower(text),'{WORD}') AS w FROM {name} WHERE text IS NOT NULL) WHERE len(w)>={n}))"""


def _format_sql() -> str:
    """Copies by canonical turns and fields; the engine's upper knows no letters that become two, so the sharp s does."""
    d = format_duplicates
    between = d.BETWEEN.replace(r"\s", r"\t-\r ")
    form = lambda c: f"trim(lower(regexp_replace(upper(replace({c},'ß','ss')),'{between}',' ','g')))"
    line = f"^{d.LINE}$"
    return rf"""WITH b AS (SELECT ord, translate(text,'{d.KEPT}','{d.FOR}') AS text FROM transcripts WHERE regexp_matches(text,'\S')),
t AS (SELECT ord, generate_subscripts(p,1) AS turn, unnest(p) AS t FROM (SELECT ord, list_filter(string_split(text,'<|im_start|>'), lambda x: regexp_matches(x,'\S')) AS p FROM b)),
r AS (SELECT ord, turn, t, regexp_extract(t,'^\s*(\w+)[ \t\r]*\n',1) AS role FROM t),
i AS (SELECT ord, turn, lower(role) AS role, contains(t,'<|im_end|>') AS ended, replace(CASE WHEN role<>'' THEN regexp_replace(t,'^\s*\w+[ \t\r]*\n','') ELSE t END,'<|im_end|>',' ') AS x FROM r),
k AS (SELECT *, regexp_matches(x,'^\s*\{{') AND regexp_matches(regexp_replace(x,'{d.PAIR}','','g'),'^[^\p{{L}}\p{{N}}\[\]]*$') AS json, list_filter(string_split(x,chr(10)), lambda l: regexp_matches(l,'[\p{{L}}\p{{N}}]')) AS ls FROM i),
m AS (SELECT *, contains(x,':') AND NOT starts_with(x,'<think>') AND len(ls)>1 AND len(list_filter(ls, lambda l: NOT regexp_matches(l,'{line}')))=0 AS keyed FROM k),
v AS (SELECT ord, turn, role, ended, CASE WHEN json THEN list_sort(list_transform(list_zip(regexp_extract_all(x,'{d.PAIR}',1),regexp_extract_all(x,'{d.PAIR}',2)), lambda z: {form('z[1]')}||chr(1)||{form('z[2]')}))
 WHEN keyed THEN list_sort(list_transform(ls, lambda l: {form(f"regexp_extract(l,'{line}',1)")}||chr(1)||{form(f"regexp_extract(l,'{line}',2)")})) ELSE [{form('x')}] END AS vals FROM m),
g AS (SELECT ord, CAST(list((role, ended, vals) ORDER BY turn) AS VARCHAR) AS k FROM v GROUP BY ord)
SELECT f AS ord_first, ord AS ord_copy FROM (SELECT ord, min(ord) OVER (PARTITION BY k) AS f FROM g) WHERE ord<>f"""


def oracle_sql() -> dict[str, str]:
    """Problems that SQL can express; the others are tested against brute force in tests/llm."""
    return {
        "p4_found": f"SELECT DISTINCT item_id, ord FROM {_grams_sql('item_id', 'eval_items', leaks.SPAN)} JOIN {_grams_sql('ord', 'transcripts', leaks.SPAN)} USING (s)",
        "p6_found": _format_sql(),
    }
