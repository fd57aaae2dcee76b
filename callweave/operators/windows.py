"""Best-per-group choices around cluster centroids and candidate edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callweave import constants as C
from callweave.functions import vec as V


def centrality(members: DataFrame, embeddings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cosine of every member to its own centroid."""
    joined = members.select("question_id", "cluster_id").join(
        embeddings.select("question_id", "vector"), "question_id").join(
        clusters.select(F.col("id").alias("cluster_id"), "centroid"), "cluster_id")
    return joined.select("cluster_id", "question_id", F.round(V.cosine(F.col("vector"), F.col("centroid")), 9).alias("sim"))


def _first_k(df: DataFrame, k: int, *order) -> DataFrame:
    ranked = df.withColumn("position", F.row_number().over(W.partitionBy("cluster_id").orderBy(*order)))
    return ranked.where(F.col("position") <= k).withColumn("position", F.col("position").cast("bigint"))


def central_examples(members, embeddings, clusters, questions, k: int = C.FAQ_EXAMPLES) -> DataFrame:
    """The ``k`` members nearest to the centroid; longer text first among equals."""
    text = F.coalesce(F.nullif("normalized_text", F.lit("")), F.nullif("raw_text", F.lit("")), F.lit(""))
    side = questions.select(F.col("id").alias("question_id"), text.alias("text"))
    scored = centrality(members, embeddings, clusters).join(side, "question_id")
    return _first_k(scored, k, F.desc("sim"), F.length("text").desc(), F.asc("question_id"))


def representatives(members, embeddings, clusters, k: int = 6) -> DataFrame:
    return _first_k(centrality(members, embeddings, clusters), k, F.desc("sim"), F.asc("question_id"))


def cap_edges(edges: DataFrame, most: int = C.EDGE_MAX_PER_SOURCE) -> DataFrame:
    """At most ``most`` accepted edges per source, most similar first."""
    order = W.partitionBy("source").orderBy(F.round("cosine", 9).desc(), F.asc("target"))
    return edges.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).withColumn(
        "position", F.col("position").cast("bigint"))


def accept_verdicts(verdicts: DataFrame, least: float = C.EDGE_MIN_WEIGHT) -> DataFrame:
    """Relation verdicts that become edges: related, heavy enough, known relation."""
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("weight").try_cast("double"), F.lit(0.0))))
    shaped = verdicts.withColumn("weight", weight).withColumn("relation", F.lower(F.trim("relation"))).withColumn(
        "reason", F.when(F.coalesce("reason", F.lit("")) != "", F.trim("reason")))
    return shaped.where(F.col("has_relation") & (F.col("weight") >= least) & F.col("relation").isin(C.EDGE_RELATIONS)
                        & (F.col("source") != F.col("target")))
