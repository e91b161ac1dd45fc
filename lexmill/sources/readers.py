"""Sources: tables, whole files, JSON, literal relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names and published weights of the two tokenizer variants' languages.
NAMES = {"en": "English", "hi": "Hindi", "te": "Telugu", "sa": "Sanskrit", "mai": "Maithili"}
WEIGHTS = {"lossy": {"en": 3, "hi": 4, "te": 4, "mai": 2}, "lossless": {"en": 2, "hi": 6, "te": 9, "sa": 10}}
SWEEP = {"en": (2, 5), "hi": (5, 7), "te": (8, 10), "sa": (9, 11)}


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, only the columns asked for."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): a row a file, with universal line ends."""
    d = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return d.select("name", F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def json_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def language_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NAMES.items()), "lang string, name string")


def weights(spark: SparkSession, variant: str) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS[variant].items()), "lang string, weight int")
