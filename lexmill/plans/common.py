"""Pieces that the query modules share: table access and the SQL spelling of the same classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.functions import text as T
from lexmill.operators import clean
from lexmill.session import read_spread

#: Tables of long texts, with their key.
KEYS = {"transcripts": "ord", "documents": "doc_id"}

#: White space for RE2.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
UNIT, EMAIL = T.UNIT, T.EMAIL
#: The same shape without a look-ahead, which RE2 lacks.
PHONE = T.PHONE.replace(r"(?![\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])")
DOMAINS = f"({', '.join(repr(x) for x in T.PLACEHOLDER_DOMAINS)})"
NORM = r"regexp_replace(replace(replace(nfc_normalize(text),'＜think＞','<think>'),'＜/think＞','</think>'),'[\x00-\x08\x0b\x0c\x0e-\x1f]','','g')"


def count_sql(marker: str, col: str = "text") -> str:
    return f"CAST((length({col})-length(replace({col},'{marker}','')))//{len(marker)} AS BIGINT)"


#: Rows with a text, raw and normalised, and every flag of the pipeline.
BASE = rf"""
WITH base AS (SELECT ord, text AS raw, {NORM} AS text FROM transcripts WHERE text IS NOT NULL),
flag AS (SELECT ord, raw, text,
  regexp_matches(raw,'[\x00-\x08\x0b\x0c\x0e-\x1f]') AS had_controls, contains(raw,'＜think＞') AS had_wide_tags,
  length(regexp_replace(text,'[^\x00-\x7F]','','g'))/greatest(length(text),1) AS ascii_ratio,
  regexp_matches(text,'(?i)(^|[^\p{{L}}\p{{N}}_])translat(e|ion)($|[^\p{{L}}\p{{N}}_])') AS translation,
  {count_sql('<|im_start|>')} <> {count_sql('<|im_end|>')} AS tag_mismatch, {count_sql('<think>')} <> {count_sql('</think>')} AS think_mismatch,
  NOT contains(text,'<|im_start|>assistant') AS no_assistant, regexp_matches(text,'<\|im_start\|>assistant{WS}*<\|im_end\|>') AS empty_assistant,
  CAST(length(text) AS BIGINT) AS chars FROM base),
marked AS (SELECT *, tag_mismatch OR think_mismatch OR no_assistant OR empty_assistant AS malformed, chars<200 AS short, chars>20000 AS long, ascii_ratio<0.9 AS nonascii FROM flag),
good AS (SELECT * FROM marked WHERE NOT malformed AND NOT short AND NOT long),
kept AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY text ORDER BY ord)=1)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_spread(spark, path, KEYS[name]) if name in KEYS else spark.read.parquet(path)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, text) of transcripts that have a text."""
    return clean.scan(table(spark, sf_dir, "transcripts"))


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return put
