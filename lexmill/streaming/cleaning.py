"""The cleaning pipeline over a stream of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import clean
from lexmill.session import step_path, until_end


def source(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of transcripts as a stream."""
    schema = "ord bigint, text string, lang_label string, contributor string, created_at timestamp, ingested_at timestamp"
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(folder)


def kept(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """(ord, text, ingested_at) of the rows that pass the quality rules, the first arrived of each equal text within
    the watermark. Which one that is follows arrival, not ord."""
    t = F.col("text")
    d = stream.where("text is not null").withColumn("text", T.normalise(t)).withWatermark("ingested_at", late)
    bad = (
        (T.occurrences(t, T.IM_START) != T.occurrences(t, T.IM_END)) | (T.occurrences(t, T.THINK) != T.occurrences(t, T.UNTHINK))
        | ~t.contains(f"{T.IM_START}assistant") | T.empty_assistant(t) | (T.chars(t) < clean.MIN_CHARS) | (T.chars(t) > clean.MAX_CHARS)
    )
    return d.where(~bad).withColumn("digest", F.sha2(t, 256)).dropDuplicatesWithinWatermark(["digest"]).select("ord", "text", "ingested_at")


def hourly(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by window and type, with late rows admitted up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def append_once(stream: DataFrame, name: str) -> DataFrame:
    """Everything that is there now, through the stream, into a table of the shared folder."""
    out, state = (step_path(stream.sparkSession, n) for n in (name, f"{name}-state"))
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    until_end(stream.sparkSession, out, state)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def upsert_once(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Everything that is there now, through an aggregating stream: each batch appends the groups it changed, and the
    last word on a group counts. Unlike in append mode, groups whose window the watermark has not closed are there. A
    batch that is run again replaces its own part."""
    out, state = (step_path(stream.sparkSession, n) for n in (name, f"{name}-state"))
    put = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    until_end(stream.sparkSession, out, state)
    rest = [c for c in stream.columns if c not in keys]
    got = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).option("basePath", out).parquet(out)
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")
