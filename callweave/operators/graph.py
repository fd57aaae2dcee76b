"""Cluster relation graph: candidate pairs, views and co-occurrence evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave import constants as C
from callweave.operators.relational import heaviest_edges, incident_clusters
from callweave.operators.vectors import cluster_neighbors


def edge_candidates(clusters: DataFrame, k: int = C.EDGE_TOP_K, least: float = C.EDGE_MIN_SIMILARITY) -> DataFrame:
    """Neighbour pairs worth asking about: among the ``k`` nearest and similar enough."""
    return cluster_neighbors(clusters, k).where(F.col("cosine") >= least)


def memory_view(clusters: DataFrame, edges: DataFrame, least: float = 0.5, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """Heaviest edges and the clusters they touch."""
    kept = heaviest_edges(edges, least, limit)
    return incident_clusters(clusters, kept), kept


def evidence(members: DataFrame, questions: DataFrame) -> DataFrame:
    """How often two clusters meet in a call (co_occurs) and in which order (leads_to).

    Calls are first reduced to their sequence of distinct clusters and equal
    sequences are counted together; pairs are then listed once per distinct
    sequence, not once per call.
    """
    when = F.struct(F.col("extracted_at").isNotNull().alias("dated"), "extracted_at", F.col("id").alias("q"))
    visits = (
        questions.select("id", "call_id", "extracted_at")
        .join(members.select(F.col("question_id").alias("id"), "cluster_id"), "id")
        .groupBy("call_id", "cluster_id").agg(F.min(when).alias("first")))
    paths = visits.groupBy("call_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("first", "cluster_id"))), lambda x: x["cluster_id"]).alias("path"))
    counted = paths.groupBy("path").agg(F.count("*").alias("n"))
    per_cluster = visits.groupBy("cluster_id").agg(F.count("*").alias("calls"))
    total = visits.select("call_id").distinct().agg(F.count("*").alias("total"))
    steps = counted.select("n", "path", F.posexplode("path").alias("i", "source"))
    ordered = steps.select("n", "source", F.explode(F.slice("path", F.col("i") + 2, F.size("path"))).alias("target")).groupBy(
        "source", "target").agg(F.sum("n").alias("support"))
    together = ordered.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "support").groupBy(
        "source", "target").agg(F.sum("support").alias("support"))
    rows = ordered.withColumn("relation", F.lit("leads_to")).unionByName(together.withColumn("relation", F.lit("co_occurs")))
    a = per_cluster.select(F.col("cluster_id").alias("source"), F.col("calls").alias("calls_a"))
    b = per_cluster.select(F.col("cluster_id").alias("target"), F.col("calls").alias("calls_b"))
    return (
        rows.join(a, "source").join(b, "target")
        .select("relation", "source", "target", "support",
                (F.col("support") * total.scalar() / (F.col("calls_a") * F.col("calls_b"))).alias("lift")))
