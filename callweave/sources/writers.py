"""Sinks: call summary CSV, graph JSON, notes, findings and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave import constants as C
from callweave.session import FREE_SHUFFLES, set_for

FOLDER_WRITERS = 32  # files a task of notes has open at once, more than there are folders


def write_call_summary(summary: DataFrame, path: str) -> None:
    """CSV with the fixed columns in order; null cells become empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in C.CALL_SUMMARY_COLUMNS]
    summary.select(*cells).write.csv(path, header=True, emptyValue="", escape='"')


def read_call_summary(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in C.CALL_SUMMARY_COLUMNS])


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two JSON folders with source/target names."""
    nodes.select("id", "type", "label", "attrs").write.json(f"{path}/nodes")
    edges.select(F.col("src_id").alias("source"), F.col("dst_id").alias("target"), "relation", "weight", "reason").write.json(f"{path}/edges")


def write_notes(notes: DataFrame, path: str) -> None:
    """Notes partitioned by folder; every row is one line of a note.

    Lines repeat each other, so files are compressed.  A task has a file open for each folder, as sorting rows by their folder
    would spill them, and the shuffles behind the notes go once they are written.
    """
    with set_for(notes.sparkSession, {FREE_SHUFFLES: "true", "spark.sql.maxConcurrentOutputFileWriters": str(FOLDER_WRITERS)}):
        notes.select("folder", "name", "section", "line", "text").write.partitionBy("folder").json(path, compression="gzip")


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.json(path)


# --- tables ----------------------------------------------------------------
def save_table(df: DataFrame, root: str, name: str) -> None:
    """The table as plain parquet, replaced as a whole.  ``df`` must not read the table it replaces."""
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")
