"""Filters, projections, joins, top-k and sampling over the store tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callweave import constants as C
from callweave.functions.clean import map_literal
from callweave.functions.text import first_text, like_escape


def json_field(column: str, name: str, kind: str = "string") -> Column:
    """One member of a JSON text column."""
    return F.try_variant_get(F.try_parse_json(column), f"$.{name}", kind)


def search_calls(calls: DataFrame, needle: str) -> DataFrame:
    """Case-blind contains over call id, agent id and customer id, newest first."""
    pattern = f"%{like_escape(needle.lower())}%"
    found = calls.withColumn("agent_id", json_field("metadata", "agent_id")).withColumn(
        "customer_id", json_field("metadata", "customer_id"))
    hit = F.col("id").ilike(pattern) | F.col("agent_id").ilike(pattern) | F.col("customer_id").ilike(pattern)
    return found.where(hit).orderBy(F.desc("created_at"), "id")


def flag_calls(calls: DataFrame, hits: DataFrame, keep: str = "all") -> DataFrame:
    """Calls with their number of personal-data hits, unordered; ``keep`` is all, flagged or clean."""
    totals = hits.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("violation_count"))
    joined = calls.join(totals, "id", "left").withColumn(
        "violation_count", F.coalesce("violation_count", F.lit(0).cast("bigint")))
    if keep == "flagged":
        joined = joined.where(F.col("violation_count") > 0)
    elif keep == "clean":
        joined = joined.where(F.col("violation_count") == 0)
    return joined


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def list_questions(questions: DataFrame, call_id=None, intent=None, language=None, limit=50, offset=0) -> DataFrame:
    for name, value in (("call_id", call_id), ("intent", intent), ("language", language)):
        if value is not None:
            questions = questions.where(F.col(name) == value)
    return page(questions, [F.desc_nulls_last("extracted_at"), F.asc("id")], limit, offset)


def transcript(utterances: DataFrame, call_id: str | None = None) -> DataFrame:
    """Speaker-labelled segments in start order, one call or all of them."""
    if call_id is not None:
        utterances = utterances.where(F.col("call_id") == call_id)
    return utterances.orderBy("call_id", "start_ts", "utterance_id").select(
        "call_id", "speaker", "text", "start_ts", "end_ts")


def calls_in_status(calls: DataFrame, statuses: list[str]) -> DataFrame:
    return calls.where(F.col("status").isin(statuses)).orderBy("created_at", "id")


def search_clusters(clusters: DataFrame, needle: str, limit: int, offset: int = 0) -> DataFrame:
    hit = F.lower("canonical_question").contains(needle.strip().lower())
    return page(clusters.where(hit), [F.desc("frequency"), F.asc("id")], limit, offset)


def gloss(width: int = 120) -> Column:
    return F.substring(first_text(F.col("english_gloss"), F.col("normalized_text")), 1, width)


def duration_slice(calls: DataFrame, least: float, buckets: list[str] | None = None) -> DataFrame:
    """Calls of at least ``least`` seconds; an empty bucket list means every bucket.

    A missing duration counts as 0.  The bare comparison reaches the file scan.
    """
    long = F.col("duration_seconds") >= least
    kept = calls.where(long if least > 0 else long | (F.col("duration_seconds").isNull() & F.lit(least <= 0)))
    return kept.where(F.col("bucket").isin(buckets)) if buckets else kept


def heaviest_edges(edges: DataFrame, least: float, limit: int, offset: int = 0) -> DataFrame:
    order = [F.desc("weight"), F.asc("source"), F.asc("target"), F.asc("relation")]
    return page(edges.where(F.col("weight") >= least), order, limit, offset)


def questions_with_vectors(questions: DataFrame, embeddings: DataFrame) -> DataFrame:
    return questions.withColumnRenamed("id", "question_id").join(
        embeddings.select("question_id", "vector"), "question_id")


def questions_with_cluster(questions: DataFrame, members: DataFrame) -> DataFrame:
    return questions.withColumnRenamed("id", "question_id").join(members, "question_id", "left")


def cluster_examples(members: DataFrame, questions: DataFrame, n: int) -> DataFrame:
    """Best ``n`` questions per cluster.

    The rank filter reaches both sides of the shuffle (Spark limits every group
    before it), so a huge cluster ships at most ``n`` rows per task.
    """
    order = W.partitionBy("cluster_id").orderBy(F.round("similarity", 9).desc(), F.asc("question_id"))
    joined = members.join(questions.withColumnRenamed("id", "question_id"), "question_id")
    return joined.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n).withColumn(
        "position", F.col("position").cast("bigint"))


def list_faqs(faqs: DataFrame, clusters: DataFrame, language=None, intent=None, limit=50) -> DataFrame:
    if language is not None:
        faqs = faqs.where(F.col("language") == language)
    side = clusters.select(F.col("id").alias("cluster_id"), "frequency", "dominant_intents")
    joined = faqs.join(side, "cluster_id")
    if intent is not None:
        joined = joined.where(F.array_contains("dominant_intents", intent))
    return page(joined, [F.desc("frequency"), F.asc("id")], limit)


def questions_of_clusters(questions: DataFrame, members: DataFrame, clusters: list[str]) -> DataFrame:
    wanted = members.where(F.col("cluster_id").isin(clusters)).select(F.col("question_id").alias("id"))
    return questions.join(wanted, "id", "left_semi")


def empty_clusters(clusters: DataFrame, members: DataFrame) -> DataFrame:
    return clusters.join(members.select(F.col("cluster_id").alias("id")), "id", "left_anti")


def pending(items: DataFrame, outputs: DataFrame, key: str, output_key: str) -> DataFrame:
    """Items that have no output yet."""
    return items.join(outputs.select(F.col(output_key).alias(key)), key, "left_anti")


def not_superseded(df: DataFrame, key: str, version: str) -> DataFrame:
    """Rows for which no newer version of the key exists (a max per key, not a self inequality join)."""
    newest = df.groupBy(key).agg(F.max(version).alias("_newest"))
    return df.join(newest, key).where(F.col(version) >= F.col("_newest")).drop("_newest")


def call_spans(utterances: DataFrame) -> DataFrame:
    """Length of every call in seconds, taken from its last utterance."""
    return utterances.groupBy("call_id").agg(F.max("end_ts").alias("duration"))


def bars_touched(utterances: DataFrame, spans: DataFrame, bars: int = C.WAVEFORM_BARS) -> DataFrame:
    """Utterance x time bar, for the bars of its call it overlaps (strictly).

    The bar range of an utterance follows from its own times, so the rows are
    exploded from the utterance and checked; there is no range join.
    """
    length = F.when(F.coalesce("duration", F.lit(1.0)) <= 0, F.lit(1.0)).otherwise(F.coalesce("duration", F.lit(1.0)))
    step = F.col("step")
    low = F.greatest(F.lit(0), F.floor(F.col("start_ts") / step) - 1).cast("int")
    high = F.least(F.lit(bars - 1), F.floor(F.col("end_ts") / step) + 1).cast("int")
    wide = utterances.select("call_id", "utterance_id", "start_ts", "end_ts", "confidence").join(spans, "call_id")
    wide = wide.withColumn("step", length / F.lit(float(bars))).withColumn("low", low).withColumn("high", high)
    hits = wide.where("low <= high").withColumn("bar", F.explode(F.sequence("low", "high")))
    return hits.where((F.col("start_ts") < (F.col("bar") + 1) * step) & (F.col("end_ts") > F.col("bar") * step)).select(
        "call_id", "bar", "utterance_id", "confidence")


def assign_turns(utterances: DataFrame, turns: DataFrame, slot: float = 60.0) -> DataFrame:
    """Each utterance takes the speaker of the turn it overlaps most (earliest turn on ties).

    Both sides are cut into time slots and joined on (call, slot), so even a very
    long call spreads over many tasks.
    """

    def slots(start: str, stop: str) -> Column:
        first, last = F.floor(F.col(start) / slot), F.floor(F.col(stop) / slot)
        return F.explode(F.sequence(first, F.greatest(first, last)))

    left = utterances.select("utterance_id", "call_id", "start_ts", "end_ts").withColumn("slot", slots("start_ts", "end_ts"))
    right = turns.select("call_id", "start", "stop", F.col("speaker_id").alias("turn_speaker")).withColumn("slot", slots("start", "stop"))
    overlap = F.least("end_ts", "stop") - F.greatest("start_ts", "start")
    pairs = left.join(right, ["call_id", "slot"]).withColumn("overlap", overlap).where("overlap > 0")
    best = pairs.groupBy("utterance_id").agg(
        F.min_by("turn_speaker", F.struct(-F.col("overlap"), F.col("start"), F.col("turn_speaker"))).alias("speaker_id"))
    return utterances.drop("speaker_id").join(best, "utterance_id", "left")


def daily_growth(clusters: DataFrame, as_of: str, days: int) -> DataFrame:
    """Clusters touched and clusters churned per day of a trailing window, zero-filled."""
    last = F.to_date(F.lit(as_of))
    spine = clusters.sparkSession.range(days).select(F.date_sub(last, F.col("id").cast("int")).alias("day"))
    counted = (
        clusters.where((F.to_date("last_updated") > F.date_sub(last, days)) & (F.to_date("last_updated") <= last))
        .groupBy(F.to_date("last_updated").alias("day"))
        .agg(F.count("*").alias("n"), F.count_if(~F.col("is_stable")).alias("m")))
    return spine.join(counted, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("new_clusters"),
        F.coalesce("m", F.lit(0)).cast("bigint").alias("churned_clusters"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def incident_clusters(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    return clusters.join(endpoints(edges), "id", "left_semi")


def top(df: DataFrame, measure: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(measure), F.asc(key)).limit(n)


def emerging(clusters: DataFrame, as_of: str, days: int, limit: int) -> DataFrame:
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return top(clusters.where(F.col("last_updated") >= since), "frequency", "id", limit)


def questions_in_order(questions: DataFrame) -> DataFrame:
    """Questions call by call in extraction order, undated ones first."""
    return questions.orderBy("call_id", F.asc_nulls_first("extracted_at"), "id")


def hashed_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """At most ``n`` rows in a reproducible pseudo-random order of their key."""
    return df.orderBy(F.md5(F.concat(F.col(key), F.lit(f"|{seed}"))), key).limit(n)


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def graph_view(clusters: DataFrame, edges: DataFrame, least: float, fallback: int = 50) -> DataFrame:
    """Clusters touched by strong edges, or the most frequent ones when no edge is strong enough."""
    kept = edges.where(F.col("weight") >= least)
    touched = incident_clusters(clusters, kept)
    strong = kept.agg(F.count("*").alias("n")).scalar()
    return touched.unionByName(top(clusters, "frequency", "id", fallback).where(strong == 0))


def by_severity(segments: DataFrame) -> DataFrame:
    """Hits, worst severity first and then by position."""
    severity = F.coalesce(F.try_element_at(map_literal(C.PII_SEVERITY), F.col("type")), F.lit("low"))
    rank = F.try_element_at(map_literal(C.SEVERITY_RANK), F.col("severity")).cast("bigint")
    return segments.withColumn("severity", severity).withColumn("severity_rank", rank).orderBy(
        "severity_rank", "start_idx", "doc_id", "type")
