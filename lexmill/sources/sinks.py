"""Sinks: tables, manifests, texts by language, vocabularies, whole tokenizers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.bpe import BYTES, Encoder, merge_table, vocabulary


def write_table(df: DataFrame, path: str, drop: tuple[str, ...] = ("ord",)) -> None:
    df.drop(*drop).write.mode("overwrite").parquet(path)


def write_manifest(one_row: DataFrame, path: str) -> None:
    """The manifest as JSON lines; null fields are kept."""
    one_row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_texts(df: DataFrame, path: str, by: str = "lang", text: str = "text") -> None:
    df.select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    """(line): id and token, tab-separated, in order of id."""
    return vocab.orderBy("id").select(F.concat_ws("\t", F.col("id").cast("string"), "token").alias("line"))


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocabulary_lines(vocab).coalesce(1).write.mode("overwrite").text(path)


def unspecial_bytes(document: Column) -> Column:
    """A tokenizer's document in which byte tokens are no special ones, so that decoding keeps them; the rest stays."""
    schema = "version string, added_tokens array<struct<id: bigint, content: string, special: boolean>>"
    x = F.from_json(document, schema)
    tokens = F.transform(x["added_tokens"], lambda t: t.withField("special", t["special"] & ~t["content"].rlike("^<0x[0-9A-F]{2}>$")))
    return F.to_json(x.withField("added_tokens", tokens))


def tokenizer_json(e: Encoder) -> str:
    """One document with vocabulary and merges; byte tokens are not special, so decoding keeps them."""
    added = [{"id": e.id[b], "content": b, "special": False} for b in BYTES if b in e.id]
    return json.dumps({"added_tokens": added, "model": {"type": "BPE", "vocab": e.id, "merges": [list(m) for m in e.rank]}}, ensure_ascii=False)


def write_tokenizer(spark, e: Encoder, path: str) -> None:
    vocabulary(spark, e).write.mode("overwrite").parquet(f"{path}/vocab")
    merge_table(spark, e).write.mode("overwrite").parquet(f"{path}/merges")


def read_tokenizer(spark, path: str, most_tokens: int = 2_000_000) -> Encoder:
    vocab = spark.read.parquet(f"{path}/vocab").orderBy("id").limit(most_tokens).collect()
    merges = spark.read.parquet(f"{path}/merges").orderBy("rank").limit(most_tokens).collect()
    tokens = [r.token for r in vocab]
    return Encoder(tokens, [(r.left, r.right) for r in merges], "[UNK]" if "[UNK]" in tokens else None)
