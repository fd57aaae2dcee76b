"""Keyed merges between table versions, and deletes that follow references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.aggregates import recount


def keyed_merge(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace by key; ``incoming`` holds one row per key.

    Old rows survive through an anti join against the incoming keys only: when
    the batch is small Spark broadcasts it and the large table is not shuffled.
    """
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def latest_per_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key of a change batch."""
    rest = [c for c in batch.columns if c not in keys]
    best = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def merge_members(members: DataFrame, updates: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with updates applied, and clusters whose frequency is recounted where touched."""
    merged = keyed_merge(members, updates, ["question_id"])
    moved = members.join(updates.select("question_id"), "question_id", "left_semi").select(F.col("cluster_id").alias("id"))
    touched = moved.unionByName(updates.select(F.col("cluster_id").alias("id"))).distinct()
    return merged, recount(clusters, merged, touched)


def merge_edges(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert by (source, target, relation); weight and reason are replaced."""
    return keyed_merge(edges, updates, ["source", "target", "relation"])


def partial_update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Overwrite only the fields a change row supplies (its non-null ones)."""
    fields = [c for c in changes.columns if c != key]
    side = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = table.join(side, key, "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(f"_{f}", f))
    return joined.select(*table.columns)


def set_status(calls: DataFrame, changes: DataFrame, as_of: str, width: int | None = None) -> DataFrame:
    """Set status and error of changed calls; the error is overwritten even with null, and cut only if a ``width`` is asked for."""
    error = F.col("error") if width is None else F.substring("error", 1, width)
    side = changes.select("id", F.col("status").alias("_status"),
                          F.nullif(error, F.lit("")).alias("_error"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    joined = calls.join(side, "id", "left")
    return joined.withColumn("status", F.when(hit, F.col("_status")).otherwise(F.col("status"))).withColumn(
        "error_message", F.when(hit, F.col("_error")).otherwise(F.col("error_message"))).withColumn(
        "updated_at", F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at"))).select(*calls.columns)


def set_json_member(table: DataFrame, values: DataFrame, key: str, column: str, member: str) -> DataFrame:
    """Put a JSON document under one member of a JSON column, keeping the other members.

    ``values`` holds ``key`` and ``document`` (JSON text).
    """
    side = values.select(key, F.col("document").alias("_doc"))
    members = F.from_json(F.coalesce(column, F.lit("{}")), "map<string,variant>")
    others = F.map_filter(members, lambda k, v: k != member)
    fresh = F.to_json(F.map_concat(others, F.create_map(F.lit(member), F.try_parse_json("_doc"))))
    # What is no JSON object, in the table or in the values, changes nothing.
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json(F.coalesce(column, F.lit("{}")))).startswith("OBJECT"), F.lit(False))
    usable = whole & F.try_parse_json("_doc").isNotNull()
    joined = table.join(side, key, "left")
    return joined.withColumn(column, F.when(usable, fresh).otherwise(F.col(column))).select(*table.columns)


def rejected_json(table: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose JSON column holds text that is no JSON object: ``key`` and the text as it stands."""
    kind = F.schema_of_variant(F.try_parse_json(column))
    return table.where(F.col(column).isNotNull() & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))).select(key, column)


def backfill_faq_labels(clusters: DataFrame, faqs: DataFrame, fresh: DataFrame, as_of: str, width: int = 120) -> tuple[DataFrame, DataFrame]:
    """Insert FAQ rows and copy their text to the cluster unless a newer version exists.

    The English text is preferred for the label; blank labels change nothing.
    """
    stored = faqs.unionByName(fresh)
    newest = stored.groupBy("cluster_id").agg(F.max("version").alias("newest"))
    label = F.substring(F.coalesce(F.nullif("canonical_question_en", F.lit("")), F.nullif("canonical_question", F.lit("")), F.lit("")), 1, width)
    change = (
        latest_per_key(fresh, ["cluster_id"], ["version", "created_at"]).join(newest, "cluster_id")
        .where("version >= newest").select(F.col("cluster_id").alias("id"), label.alias("_label"), F.col("canonical_question").alias("_question"))
        .where(F.trim("_label") != ""))
    joined = clusters.join(change, "id", "left")
    hit = F.col("_label").isNotNull()
    updated = joined.withColumn("label", F.coalesce("_label", "label")).withColumn(
        "canonical_question", F.coalesce("_question", "canonical_question")).withColumn(
        "last_updated", F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_updated")))
    return stored, updated.select(*clusters.columns)


def cascade_delete(tables: dict[str, DataFrame], doomed_calls: DataFrame) -> dict[str, DataFrame]:
    """Remove calls and everything that hangs from them.

    calls -> utterances, questions; questions -> embeddings, members.
    """
    calls = doomed_calls.select(F.col("id").alias("call_id")).distinct()
    questions = tables["questions"].join(calls, "call_id", "left_semi").select(F.col("id").alias("question_id"))
    return {
        "calls": tables["calls"].join(calls.select(F.col("call_id").alias("id")), "id", "left_anti"),
        "utterances": tables["utterances"].join(calls, "call_id", "left_anti"),
        "questions": tables["questions"].join(calls, "call_id", "left_anti"),
        "embeddings": tables["embeddings"].join(questions, "question_id", "left_anti"),
        "members": tables["members"].join(questions, "question_id", "left_anti"),
    }


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    tagged = [df.select(F.lit(name).alias("table_name")) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged).groupBy("table_name").agg(F.count("*").alias("n"))


def table_keys(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(table_name, row_key, n): how often each key stands in each table."""
    tagged = [df.select(F.lit(name).alias("table_name"), F.col(keys[name]).cast("string").alias("row_key")) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged).groupBy("table_name", "row_key").agg(F.count("*").alias("n"))
