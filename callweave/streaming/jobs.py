"""Structured Streaming forms of ingest, assignment, status and growth jobs.

Every job reads a file stream, runs until the available input is used up and keeps its progress in the ``checkpoint`` folder it is
given; its results are under ``out``.  Started again with the same two folders it goes on where it stopped and reads new files
only.  Rows go to parquet sinks, whose log holds each batch once; what a job has to remember of a key is in the state store
(``streaming.state``), and leaves it when the watermark says that it can't matter any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callweave import constants as C
from callweave.functions.clean import trim_blank
from callweave.operators.asof import asof
from callweave.operators.vectors import assign
from callweave.sources.readers import BUNDLE, call_id_of, transcript_turns
from callweave.streaming.state import ExpiringEntries, OpenWindows, with_state


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, partition_by: str | None = None) -> None:
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query = (writer.partitionBy(partition_by) if partition_by else writer).trigger(availableNow=True).start()
    query.awaitTermination()


def written(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """What a parquet sink holds so far; it may hold nothing yet."""
    try:
        return spark.read.schema(schema).parquet(out)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# --- ingest ------------------------------------------------------------------------
def usable_key(key) -> F.Column:
    """Trimmed idempotency key; blank or over-long keys do not count."""
    text = F.nullif(trim_blank(key), F.lit(""))
    return F.when(F.length(text) <= C.IDEMPOTENCY_MAX_KEY, text)


KEY_BUCKETS = 1024  # a checkpoint keeps the number it began with


def dedupe_requests(stream: DataFrame, out: str, checkpoint: str, late_hours: int = C.IDEMPOTENCY_HOURS) -> DataFrame:
    """First request per (route, key) within 24 hours, over all micro-batches and runs; requests without a usable key all pass.

    The earliest request of a batch that no window covers opens one.  The store holds the start of a key's open window until the
    watermark, ``late_hours`` behind the newest request, has passed its end.  Keyed requests that come later than that are not
    taken (the query's progress counts them); how far apart they lie in the files of one batch makes no difference.  Keys share
    ``KEY_BUCKETS`` entries of the store.
    """
    rows = stream.select("request_id", "route", F.col("ts").cast("timestamp").alias("ts"), usable_key(F.col("key")).alias("key"))
    keyed = rows.where("key is not null").withWatermark("ts", f"{late_hours} hours")
    buckets = keyed.withColumn("bucket", F.pmod(F.xxhash64("route", "key"), F.lit(KEY_BUCKETS)))
    accepted = with_state(buckets.groupBy("bucket"), OpenWindows(C.IDEMPOTENCY_HOURS), "request_id string, route string, ts timestamp, key string")
    found = rows.where("key is null").select("request_id", "route", "ts", "key").unionByName(accepted)
    run_to_parquet(found, out, checkpoint)
    return written(stream.sparkSession, out, found.schema)


def dedupe_arrivals(stream: DataFrame) -> DataFrame:
    """Native form for unbounded streams: any one row per (route, key) within the delay (streaming frame)."""
    keyed = stream.withColumn("key", usable_key(F.col("key")))
    loose = keyed.where("key is null")
    return keyed.where("key is not null").withWatermark("ts", f"{C.IDEMPOTENCY_HOURS} hours").dropDuplicatesWithinWatermark(
        ["route", "key"]).unionByName(loose.withWatermark("ts", f"{C.IDEMPOTENCY_HOURS} hours"))


def stream_transcripts(spark: SparkSession, path: str, out: str, checkpoint: str, bundled: bool = False) -> DataFrame:
    """Transcript files, or bundles of them, turned into utterances once each; later runs read new files only."""
    if bundled:
        files = spark.readStream.schema(BUNDLE).json(path)
    else:
        files = spark.readStream.option("recursiveFileLookup", "true").option("wholetext", "true").format("text").schema("value string").load(path)
        files = files.select(call_id_of(F.col("_metadata.file_path")).alias("call_id"), "value")
    turns = transcript_turns(files)
    run_to_parquet(turns.where("reject is null").drop("reject"), out, checkpoint)
    return spark.read.schema(turns.drop("reject").schema).parquet(out)


# --- clusters ------------------------------------------------------------------------
def assign_stream(stream: DataFrame, clusters: Callable[[], DataFrame], out: str, checkpoint: str,
                  threshold: float = C.ASSIGN_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, deferred): new vectors assigned to the clusters as they are at each batch.

    A batch fills its own partition of the table and overwrites it when it is run again.
    """
    spark = stream.sparkSession
    schema = "question_id string, cluster_id string, similarity double, batch bigint"

    def handle(batch: DataFrame, number: int) -> None:
        placed = assign(batch.select("question_id", "vector"), clusters(), threshold).select("question_id", "cluster_id", "similarity")
        placed.withColumn("batch", F.lit(number).cast("bigint")).write.partitionBy("batch").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").parquet(out)

    query = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start())
    query.awaitTermination()
    rows = written(spark, out, spark.createDataFrame([], schema).schema).drop("batch")
    return rows.where("cluster_id is not null"), rows.where("cluster_id is null").drop("cluster_id")


def touched_clusters(stream: DataFrame, out: str, checkpoint: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Refresh requests: the clusters that memberships touched in each interval (start, cluster_id, n), once the watermark has closed it."""
    spans = stream.withColumn("ts", F.col("assigned_at").cast("timestamp")).withWatermark("ts", late)
    counts = spans.groupBy(F.window("ts", every).alias("w"), "cluster_id").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "cluster_id", "n")
    run_to_parquet(counts, out, checkpoint)
    return written(stream.sparkSession, out, counts.schema)


# --- status and growth ------------------------------------------------------------------
def call_status(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Current status per call from an event stream, safe against late and shuffled events.

    The state store is the table: it holds the newest event of every call and nothing else, and is read back from the checkpoint.  ``out``
    is not used, as no log of changes is kept.
    """
    spark = stream.sparkSession
    events = stream.withColumn("call_id", F.col("call_id").cast("string"))
    newest = events.groupBy("call_id").agg(F.max(F.struct(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("event_id"), "status", "error")).alias("s"))
    query = (newest.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    held = spark.read.format("statestore").load(checkpoint)
    (newest_event,) = held.schema["value"].dataType.fieldNames()
    return held.select(F.col("key").getField("call_id").alias("call_id"), F.col("value").getField(newest_event).alias("s")).select("call_id", "s.*")


def daily_counts(stream: DataFrame, out: str, checkpoint: str, late: str = "1 day") -> DataFrame:
    """Touched and churned counts per day, one row per day, written once the day is closed.

    A day closes when the watermark, ``late`` behind the newest row of the batches before, has passed its end; rows of closed days that
    come after that no longer count.
    """
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("touched"), F.count_if(~F.col("is_stable")).alias("churned")).select(F.col("w.start").alias("day"), "touched", "churned")
    run_to_parquet(days, out, checkpoint)
    return written(stream.sparkSession, out, days.schema)


def cache_hits(lookups: DataFrame, puts: DataFrame, days: int = C.CACHE_TTL_DAYS) -> DataFrame:
    """Was there an entry younger than the limit at each lookup?  (key, ts, id) in, ``hit`` added."""
    found = asof(lookups.select("key", "ts", F.col("id").alias("tie")),
                 puts.select("key", "ts", F.col("id").alias("tie"), F.col("id").alias("value")))
    alive = F.col("found_ts") > F.col("ts") - F.make_dt_interval(F.lit(days))
    return found.select(F.col("tie").alias("id"), "key", F.coalesce(alive, F.lit(False)).alias("hit"))


def cache_stream(stream: DataFrame, out: str, checkpoint: str, days: int = C.CACHE_TTL_DAYS, late: str = "1 day") -> DataFrame:
    """Stream form of ``cache_hits`` over rows (key, ts, id, is_put): each lookup is answered once the watermark has passed it.

    The store holds a key's newest entry until it expires, and the rows that wait for the watermark; rows later than ``late`` are not taken.
    """
    timed = stream.select("key", F.col("ts").cast("timestamp").alias("ts"), "id", "is_put").withWatermark("ts", late)
    answers = with_state(timed.groupBy("key"), ExpiringEntries(days), "id string, key string, hit boolean")
    run_to_parquet(answers, out, checkpoint)
    return written(stream.sparkSession, out, answers.schema)


TRANSIENT = r"(?i)timeout|connection|rate.?limit|operationalerror|transport"


def error_class(error) -> F.Column:
    return F.when(error.rlike(TRANSIENT), F.lit("transient")).otherwise(F.lit("permanent"))


def dead_letters(stream: DataFrame, out: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead): failed rows go aside with their error and its class, good rows go on.  One sink, a folder per outcome."""
    outcome = F.when(F.col("error").isNull(), F.lit("good")).otherwise(error_class(F.col("error")))
    marked = stream.withColumn("error_class", outcome)
    run_to_parquet(marked, out, checkpoint, "error_class")
    rows = written(stream.sparkSession, out, marked.schema)
    return rows.where("error_class = 'good'").drop("error_class"), rows.where("error_class <> 'good'")
