"""Call-detail records, join phones and the one-row-per-mobile call summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import constants as C
from callweave.functions.clean import (
    clean_na, clamp_unit, descending_date, map_literal, normalize_mobile, normalize_product,
    parse_direction, parse_started_at, trim_blank)
from callweave.functions.numbers import round_exact


def conform_cdr(raw: DataFrame, columns: dict[str, str] = C.CDR_COLUMNS) -> DataFrame:
    """Typed call-detail rows; headers that are absent become null, rows without id go."""

    def field(name: str) -> Column:
        header = columns[name]
        return F.col(header) if header in raw.columns else F.lit(None).cast("string")

    extra = ["ordinal"] if "ordinal" in raw.columns else []
    typed = raw.select(
        clean_na(field("crux_call_id")).alias("crux_call_id"),
        normalize_mobile(field("caller_phone")).alias("caller_phone"),
        clean_na(field("agent_id")).alias("agent_id"),
        clean_na(field("campaign")).alias("campaign"),
        parse_started_at(field("started_at")).alias("started_at"),
        parse_direction(field("direction")).alias("direction"),
        *extra)
    return typed.where(F.col("crux_call_id").isNotNull())


def cdr_quality(raw: DataFrame, columns: dict[str, str] = C.CDR_COLUMNS) -> DataFrame:
    """Per campaign: how many cells of each dirty column were valid, missing or unreadable."""
    cells = raw.select(
        F.coalesce(clean_na(F.col(columns["campaign"])), F.lit("(none)")).alias("campaign"),
        clean_na(F.col(columns["caller_phone"])).alias("phone_text"),
        normalize_mobile(F.col(columns["caller_phone"])).alias("phone"),
        clean_na(F.col(columns["started_at"])).alias("start_text"),
        parse_started_at(F.col(columns["started_at"])).alias("start"))
    counts = []
    for name in ("phone", "start"):
        value, text = F.col(name), F.col(f"{name}_text")
        counts += [
            F.count_if(value.isNotNull()).alias(f"{name}_valid"),
            F.count_if(text.isNull()).alias(f"{name}_missing"),
            F.count_if(text.isNotNull() & value.isNull()).alias(f"{name}_invalid"),
        ]
    return cells.groupBy("campaign").agg(F.count("*").alias("n_rows"), *counts)


def last_wins(df: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Last row per key in file order, as an aggregate that combines before the shuffle: one row per key and task travels."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def calls_with_cdr(analyses: DataFrame, cdr: DataFrame) -> DataFrame:
    """Every analysed call, enriched with the last call-detail row of its recording id.

    Fields that ``cdr`` does not hold are left out, so a caller who needs few of them has only those cleaned and carried.
    """
    fields = [c for c in ("caller_phone", "agent_id", "campaign", "started_at", "direction") if c in cdr.columns]
    side = last_wins(cdr, "crux_call_id").select(F.col("crux_call_id").alias("call_id"), *fields, F.lit(True).alias("has_cdr"))
    return analyses.join(side, "call_id", "left").withColumn(
        "has_cdr", F.coalesce("has_cdr", F.lit(False)))


def with_join_phone(calls: DataFrame) -> DataFrame:
    """Adds ``join_phone``, ``phone_source`` and ``phone_mismatch``.

    The call-detail number wins when it is valid; the number heard in the call
    counts only when it is marked as grounded.
    """
    grounded = F.when(F.array_contains("grounded_fields", "phone"), normalize_mobile(F.col("phone")))
    dialled = normalize_mobile(F.col("caller_phone"))
    return (
        calls.withColumn("cdr_phone", dialled).withColumn("grounded_phone", grounded)
        .withColumn("join_phone", F.coalesce("cdr_phone", "grounded_phone"))
        .withColumn("phone_source", F.when(F.col("cdr_phone").isNotNull(), F.lit("cdr"))
                    .when(F.col("grounded_phone").isNotNull(), F.lit("lead")).otherwise(F.lit("none")))
        .withColumn("phone_mismatch", F.coalesce(F.col("cdr_phone") != F.col("grounded_phone"), F.lit(False)))
    )


def phone_coverage(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("phone_source").agg(
        F.count("*").alias("n_calls"), F.count_if("phone_mismatch").alias("n_mismatch"))


def disposition_rank(c: Column) -> Column:
    ranks = map_literal({d: i for i, d in enumerate(C.DISPOSITION_SIGNIFICANCE)})
    return F.coalesce(F.try_element_at(ranks, c), F.lit(len(C.DISPOSITION_SIGNIFICANCE)))


def _winner_key() -> Column:
    confidence = F.coalesce(F.col("disposition_confidence"), F.lit(0.0))
    return F.struct(disposition_rank(F.col("disposition")).alias("rank"),
                    descending_date(F.col("call_date")).alias("day"),
                    (-confidence).alias("conf"), F.col("call_id").alias("id"))


def call_winner(resolved: DataFrame) -> DataFrame:
    """Winning call per mobile: most significant, newest, most confident, smallest id."""
    fields = ["call_id", "disposition", "disposition_confidence", "sentiment", "call_date"]
    return (
        resolved.where(F.col("join_phone").isNotNull()).groupBy("join_phone")
        .agg(F.min_by(F.struct(*fields), _winner_key()).alias("w"))
        .select(F.col("join_phone").alias("phone"), *[F.col(f"w.{f}").alias(f) for f in fields]))


def first_filled(resolved: DataFrame, fields=tuple(C.SUMMARY_LEAD_FIELDS.values())) -> DataFrame:
    """First non-blank value of each lead field, newest call first."""
    order = F.struct(descending_date(F.col("call_date")), F.col("call_id"))
    return (
        resolved.where(F.col("join_phone").isNotNull()).groupBy(F.col("join_phone").alias("phone"))
        .agg(*[F.min_by(f, F.when(trim_blank(F.col(f)) != "", order)).alias(f) for f in fields]))


def call_summary(resolved: DataFrame) -> DataFrame:
    """One row of text columns per mobile.

    Two steps, so that a mobile holding a large share of all calls is never
    gathered in one go: calls are first folded per (mobile, day) — every part
    combines map-side — and the much smaller day rows then per mobile.  Only the
    id list, which the result itself asks for, grows with the group.
    """
    lead_fields = list(C.SUMMARY_LEAD_FIELDS.values())
    calls = resolved.where(F.col("join_phone").isNotNull()).select(
        F.col("join_phone").alias("phone"), F.coalesce("call_date", F.lit("")).alias("call_date"),
        "call_id", _winner_key().alias("key"),
        F.struct(F.col("disposition"), F.col("sentiment"),
                 F.coalesce("disposition_confidence", F.lit(0.0)).alias("confidence")).alias("outcome"),
        F.coalesce("escalation", F.lit(False)).alias("escalation"),
        *[F.when(trim_blank(F.col(f)) != "", F.col(f)).alias(f) for f in lead_fields])
    per_day = calls.groupBy("phone", "call_date").agg(
        F.min("key").alias("key"), F.min_by("outcome", "key").alias("outcome"),
        F.bool_or("escalation").alias("escalation"), F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_list("call_id")), ",").alias("ids"),
        *[F.min(F.when(F.col(f).isNotNull(), F.struct(F.col("call_id").alias("i"), F.col(f).alias("v")))).alias(f)
          for f in lead_fields])
    day = descending_date(F.col("call_date"))
    per_phone = per_day.groupBy("phone").agg(
        F.min_by("outcome", "key").alias("outcome"), F.bool_or("escalation").alias("escalation"),
        F.sum("n").alias("n"), F.max("call_date").alias("last_date"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(day.alias("d"), F.col("ids")))),
                                 lambda x: x["ids"]), ",").alias("ids"),
        *[F.min_by(F.col(f"{f}.v"), F.when(F.col(f).isNotNull(), day)).alias(f) for f in lead_fields])
    named = {v: k for k, v in C.SUMMARY_LEAD_FIELDS.items()}
    text = per_phone.select(
        F.col("phone").alias("PHONE_NUMBER"),
        F.coalesce("outcome.disposition", F.lit("")).alias("CALL_DISPOSITION"),
        F.coalesce("outcome.sentiment", F.lit("")).alias("CALL_SENTIMENT"),
        F.col("escalation").cast("string").alias("CALL_ESCALATION"),
        F.col("n").cast("string").alias("CALL_N_CALLS"),
        F.col("last_date").alias("CALL_LAST_DATE"),
        F.col("ids").alias("CALL_SOURCE_CALL_IDS"),
        round_exact(F.col("outcome.confidence"), 3).cast("string").alias("CALL_CONFIDENCE"),
        *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(named[f]) for f in lead_fields])
    return text.select(*C.CALL_SUMMARY_COLUMNS).orderBy("PHONE_NUMBER")


def crosswalk_table(spark) -> DataFrame:
    """Free-text disposition dimension (27 fixed rows)."""
    return spark.createDataFrame(
        [(k.lower(), v) for k, v in C.LMS_CROSSWALK.items()], "lms_key string, disposition string")


def map_lms(df: DataFrame, column: str) -> DataFrame:
    """Adds ``disposition``; unknown, blank or null text maps to 'other'."""
    dim = F.broadcast(crosswalk_table(df.sparkSession).where(F.col("disposition").isin(C.DISPOSITIONS)))
    keyed = df.withColumn("lms_key", F.lower(trim_blank(F.col(column))))
    return keyed.join(dim, "lms_key", "left").withColumn(
        "disposition", F.coalesce("disposition", F.lit("other")))


def match_leads(resolved: DataFrame, leads: DataFrame) -> DataFrame:
    """Per call with a join phone: distinct lead numbers and products in first-seen order.

    Leads are folded per mobile before the join, so the call table is shuffled
    once and a busy mobile never multiplies rows.  First-seen order is the least
    ordinal of each distinct value.
    """
    base = leads.select(
        normalize_mobile(F.col("MOBILE_NO")).alias("join_phone"), "ordinal",
        clean_na(F.col("LEAD_NO")).alias("lead_no"), normalize_product(F.col("PRODUCT_TYPE")).alias("product"))
    values = F.array(F.struct(F.lit("lead_no").alias("kind"), F.col("lead_no").alias("v")),
                     F.struct(F.lit("product").alias("kind"), F.col("product").alias("v")))
    seen = (
        base.where(F.col("join_phone").isNotNull()).select("join_phone", "ordinal", F.inline(values)).where(F.col("v").isNotNull())
        .groupBy("join_phone", "kind", "v").agg(F.min("ordinal").alias("o")))

    def ordered(kind: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("o", "v")))), lambda x: x["v"])

    folded = seen.groupBy("join_phone").agg(ordered("lead_no").alias("lead_nos"), ordered("product").alias("products"))
    none = F.expr("cast(array() as array<string>)")
    return (
        # A call without a phone gets a key of its own, which meets nothing: such calls do not gather in one task.
        resolved.withColumn("_lead_key", F.coalesce("join_phone", F.concat(F.lit("none:"), "call_id")))
        .join(folded.withColumnRenamed("join_phone", "_lead_key"), "_lead_key", "left").drop("_lead_key")
        .withColumn("lead_nos", F.coalesce("lead_nos", none)).withColumn("products", F.coalesce("products", none)))


def call_quality(analyses: DataFrame) -> DataFrame:
    base = F.col("sentiment_confidence") * 0.4 + F.col("disposition_confidence") * 0.4
    score = F.when(F.col("escalation"), base * 0.6).otherwise(base)
    return analyses.select("call_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("quality_score"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


__all__ = [n for n in dir() if not n.startswith("_")]
