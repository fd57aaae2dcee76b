"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows its predecessor kept.  All but the last return the columns of ``documents`` (the last adds what the
mix takes of each row).  Rows are found again by a 64-bit hash of all their columns; equal rows share it and are told apart
by their number where that matters.  Null texts, sources and ids, repeated rows and empty tables pass as the operators define.
Further columns of any name are carried along; the mixture puts its own ``size``, ``source_size``, ``target`` and ``taken`` in the place
of columns with those names.  Names starting with ``_pipeline_`` or ``_line_dedup_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm import decontaminate, line_dedup, minhash, mixing, quality_rules
from callweave.session import cut, ship_package

POLICY = 3
KEY, COPY, ROW, TAKEN, OWN = "_pipeline_key", "_pipeline_copy", "_pipeline_row", "_pipeline_taken", "_pipeline_own"
MIXED = ["size", "source_size", "target", "taken"]


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in docs.columns], *[F.col(c).isNull() for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the full quality policy accepts."""
    book = quality_rules.ledger(docs.select(F.struct(*docs.columns).alias(ROW), "text"), [ROW])
    # Exploding a list of one keeps the optimiser from copying every rule into the filter, to be evaluated there again.
    bits = book.select(ROW, F.explode(F.array("fail_bits")).alias(KEY))
    return bits.where(quality_rules.passes(F.col(KEY), POLICY)).select(f"{ROW}.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each source; all documents stay, ``n_chars`` follows the text.

    A group of near copies counts as one page, so that a text which is copied often survives for the next stage.
    """
    found = minhash.grouped(docs, key=line_dedup.row_key("source", "text"))
    copies = cut(found.select("key", F.col("component").alias("page")).distinct(), "copies")
    clean = line_dedup.cleaned(docs, "source", "text", copies=copies)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8) stays: the one with the smallest id (ties by content).

    SimHash groups first, as op6 does (fingerprints within two bits), and its links are verified; bands find the copies further apart.
    """
    found = minhash.grouped(docs, key=_key(docs), simhash=True)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("key").alias("key"))).alias("first"))
    kept = first.select(F.col("first.key").alias(KEY))
    rows = docs.withColumn(KEY, _key(docs)).join(kept, KEY, "left_semi")
    again = Window.partitionBy(KEY).orderBy(F.lit(0))
    return rows.withColumn(COPY, F.row_number().over(again)).where(F.col(COPY) == 1).select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share a twentieth of their words or more with benchmark passages."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontaminate.verdicts(docs.select(_key(docs).alias("doc_id"), "text"), items)
    tainted = found.where("contaminated").select(F.col("doc_id").alias(KEY))
    return docs.withColumn(KEY, _key(docs)).join(tainted, KEY, "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, source_size, target and taken: how many words of each the mix takes, repeats counted."""
    found = mixing.taken(docs, _key(docs)).groupBy(F.col("key").alias(KEY)).agg(
        F.sort_array(F.collect_list(F.struct("taken", "size", "source_size", "target"))).alias(TAKEN))
    rows = docs.withColumn(KEY, _key(docs)).join(found, KEY)
    again = Window.partitionBy(KEY).orderBy(F.lit(0))
    rows = rows.withColumn(COPY, F.row_number().over(again)).withColumn(OWN, F.element_at(TAKEN, F.col(COPY)))
    return rows.select(*[c for c in docs.columns if c.lower() not in MIXED], *[F.col(f"{OWN}.{c}").alias(c) for c in MIXED])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("benchmark_decontamination", benchmarks),
    ("mixing", mixture),
]
ORACLE_SQL = None  # near-copy groups have no SQL form; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
