"""Call metadata held as JSON text: flattening and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import constants as C
from callweave.operators.relational import json_field


def numeric_stem(name: Column) -> Column:
    """Digits-only file stem of a path or name, else null."""
    flat = F.trim(F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1))
    return F.nullif(F.regexp_extract(flat, r"^\s*(\p{Nd}+)\s*(?:\.[^.]*)?$", 1), F.lit(""))


def call_fields(calls: DataFrame) -> DataFrame:
    """Call metadata as columns; the recogniser falls back to the default one."""
    plain = ["agent_id", "customer_id", "campaign", "channel"]
    provider = F.coalesce(F.nullif(json_field("metadata", "stt_provider"), F.lit("")), F.lit(C.DEFAULT_STT_PROVIDER))
    return calls.select("id", *[json_field("metadata", f).alias(f) for f in plain], provider.alias("stt_provider"),
                        numeric_stem(F.col("source_uri")).alias("recording_id"))


def field_nulls(calls: DataFrame, fields: list[str]) -> DataFrame:
    return calls.agg(F.count("*").alias("n"),
                     *[F.count_if(json_field("metadata", f).isNull()).alias(f"{f}_nulls") for f in fields])


def with_analysis(calls: DataFrame, limit: int) -> DataFrame:
    """Newest calls whose metadata holds an analysis document, date as YYYY-MM-DD."""
    analysis = F.try_variant_get(F.try_parse_json("metadata"), "$.analysis", "variant")
    kept = calls.withColumn("analysis", analysis).where(F.col("analysis").isNotNull())
    return kept.orderBy(F.desc("created_at"), "id").limit(limit).select(
        "id", "analysis", F.date_format("created_at", "yyyy-MM-dd").alias("call_date"))
