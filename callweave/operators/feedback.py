"""Human feedback applied as set jobs, and re-extraction maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.clean import map_literal
from callweave.operators.aggregates import recount
from callweave.operators.asof import asof
from callweave.operators.density import NOISE, density_cluster
from callweave.operators.merges import cascade_delete, keyed_merge, latest_per_key
from callweave.operators.relational import empty_clusters, json_field
from callweave.session import cut

TASKS = {
    "merge_clusters": "merge", "split_cluster": "split", "relabel_intent": "relabel",
    "reassign_question": "reassign", "regenerate_faq": "canonicalize",
}
TARGETS = {
    "merge_clusters": "target_id", "split_cluster": "cluster_id", "relabel_intent": "cluster_id",
    "reassign_question": "question_id", "regenerate_faq": "cluster_id",
}


def payload(name: str, kind: str = "string") -> Column:
    return json_field("payload", name, kind)


def route(feedback: DataFrame) -> DataFrame:
    """Feedback rows with the job that handles them and its target; unknown actions are rejected."""
    target = F.lit(None).cast("string")
    for action, field in TARGETS.items():
        target = F.when(F.col("action") == action, payload(field)).otherwise(target)
    task = F.try_element_at(map_literal(TASKS), F.col("action"))
    return feedback.select("id", "action", task.alias("task"), target.alias("target"), task.isNotNull().alias("is_accepted"))


def _merges(feedback: DataFrame) -> DataFrame:
    return feedback.where("action = 'merge_clusters'").select(
        "id", F.col("created_at").alias("ts"), payload("source_id").alias("source"), payload("target_id").alias("target"))


def merge_targets(feedback: DataFrame) -> DataFrame:
    """Where each cluster's members end after all merges, in the order they were given.

    Every merge points at the next later merge away from its target; the chains
    are closed by pointer doubling, so the number of rounds is the logarithm of
    the longest chain and each round is one join of the (narrow) merge table.
    """
    moves = cut(_merges(feedback).where("source <> target"), "merges")
    following = asof(
        moves.select(F.col("target").alias("key"), "ts", F.col("id").alias("tie"), F.col("target").alias("final")),
        moves.select(F.col("source").alias("key"), "ts", F.col("id").alias("tie"), F.col("id").alias("value")), forward=True)
    state = cut(following.select(F.col("tie").alias("event"), F.col("found").alias("next"), "final"), "chain")
    while not state.where("next is not null").isEmpty():
        hop = state.select(F.col("event").alias("next"), F.col("next").alias("next_hop"), F.col("final").alias("final_hop"))
        state = cut(state.join(hop, "next", "left").select(
            "event", F.col("next_hop").alias("next"), F.coalesce("final_hop", "final").alias("final")), "chain")
    first = moves.groupBy("source").agg(F.min_by("id", F.struct("ts", "id")).alias("event"))
    return first.join(state, "event").select(F.col("source").alias("cluster_id"), F.col("final").alias("target_id"))


def apply_merges(feedback, members, clusters, questions, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members moved, sources unstable and recounted, members of merge targets marked gold."""
    targets = merge_targets(feedback)
    moved = members.join(targets, "cluster_id", "left")
    named = _merges(feedback).select(F.explode(F.array("source", "target")).alias("cluster_id")).distinct()
    gold = members.join(named, "cluster_id", "left_semi").select(F.col("question_id").alias("id"), F.lit(True).alias("_gold"))
    new_members = moved.withColumn("cluster_id", F.coalesce("target_id", "cluster_id")).select(*members.columns)
    sources = _merges(feedback).select(F.col("source").alias("id")).distinct().withColumn("_gone", F.lit(True))
    marked = clusters.join(sources, "id", "left")
    gone = F.coalesce("_gone", F.lit(False))
    marked = marked.withColumn("is_stable", F.col("is_stable") & ~gone).withColumn(
        "last_updated", F.when(gone, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_updated"))).select(*clusters.columns)
    return new_members, recount(marked, new_members), _mark_gold(questions, gold)


def _mark_gold(questions: DataFrame, gold: DataFrame) -> DataFrame:
    joined = questions.join(gold, "id", "left")
    return joined.withColumn("human_override", F.col("human_override") | F.coalesce("_gold", F.lit(False))).select(*questions.columns)


def apply_relabels(feedback, members, clusters, questions, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Last given intent per cluster onto its questions (gold), last given label onto the cluster."""
    rows = feedback.where("action = 'relabel_intent'").select(
        payload("cluster_id").alias("cluster_id"), payload("intent").alias("intent"), payload("label").alias("label"),
        F.struct("created_at", "id").alias("o"))
    last = rows.groupBy("cluster_id").agg(
        F.max_by("intent", F.when(F.col("intent").isNotNull(), F.col("o"))).alias("_intent"),
        F.max_by("label", F.when(F.col("label").isNotNull(), F.col("o"))).alias("_label"))
    touched = members.join(last.where("_intent is not null"), "cluster_id").select(F.col("question_id").alias("id"), "_intent")
    new_questions = questions.join(touched, "id", "left").withColumn(
        "human_override", F.col("human_override") | F.col("_intent").isNotNull()).withColumn(
        "intent", F.coalesce("_intent", "intent")).select(*questions.columns)
    side = last.where("_label is not null").select(F.col("cluster_id").alias("id"), "_label")
    joined = clusters.join(side, "id", "left")
    new_clusters = joined.withColumn("label", F.coalesce("_label", "label")).withColumn(
        "last_updated", F.when(F.col("_label").isNotNull(), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_updated"))).select(*clusters.columns)
    return new_questions, new_clusters


def apply_reassigns(feedback, members, questions, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Move single questions; the last action per question wins, similarity defaults to 1."""
    rows = feedback.where("action = 'reassign_question'").select(
        payload("question_id").alias("question_id"), payload("cluster_id").alias("cluster_id"),
        F.coalesce(payload("similarity", "double"), F.lit(1.0)).alias("similarity"), "created_at", "id")
    last = latest_per_key(rows, ["question_id"], ["created_at", "id"]).select(
        "question_id", "cluster_id", "similarity", F.lit(as_of).cast("timestamp_ntz").alias("assigned_at"))
    gold = last.select(F.col("question_id").alias("id"), F.lit(True).alias("_gold"))
    return keyed_merge(members, last, ["question_id"]), _mark_gold(questions, gold)


def split_clusters(feedback, members, embeddings, similarity: float, **tuning) -> DataFrame:
    """Re-cluster the members of every cluster marked for splitting, each among themselves.

    Pieces get ids below their cluster's; members that turn out as noise lose
    their place (null cluster).
    """
    marked = feedback.where("action = 'split_cluster'").select(payload("cluster_id").alias("cluster_id")).distinct()
    inside = members.select("question_id", "cluster_id").join(marked, "cluster_id", "left_semi")
    pieces = density_cluster(embeddings.select("question_id", "vector").join(inside, "question_id"), similarity, group="cluster_id", **tuning)
    return inside.join(pieces, "question_id").select(
        "question_id", "cluster_id", F.when(F.col("cluster") != NOISE, F.concat("cluster_id", F.lit("/"), "cluster")).alias("piece"))


def reextract(tables: dict[str, DataFrame], statuses: list[str], as_of: str) -> dict[str, DataFrame]:
    """Purge the questions of selected calls with all that hangs from them, prune clusters left
    empty, and put the calls back to the stage before extraction."""
    picked = tables["calls"].where(F.col("status").isin(statuses)).select("id")
    after = cascade_delete(tables, picked)
    hit = F.col("status").isin(statuses)
    calls = tables["calls"].withColumn("updated_at", F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at"))).withColumn(
        "status", F.when(hit, F.lit("diarization_done")).otherwise(F.col("status")))
    gone = empty_clusters(tables["clusters"], after["members"]).select("id")
    return {"calls": calls, "questions": after["questions"], "embeddings": after["embeddings"], "members": after["members"],
            "clusters": tables["clusters"].join(gone, "id", "left_anti")}


