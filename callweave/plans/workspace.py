"""Tables and input views of one data folder as Spark DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callweave.plans.views import VIEWS, SparkDialect, ordered_closure
from callweave.session import ship_package


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)

    def table(self, name: str) -> DataFrame:
        """A driver table, split as the session's file settings say.

        A file with one row group is read by one task.  A session that sets ``spark.callweave.spreadTables`` (local ones do) has
        tables dealt out to its cores; by default they are left as they are.
        """
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if self.spark.conf.get("spark.callweave.spreadTables", "false") == "true":
            return df.repartition(self.spark.sparkContext.defaultParallelism)
        return df

    def __getitem__(self, name: str) -> DataFrame:
        """A driver table or an input view, built once per workspace."""
        for item in [*self._missing(name)]:
            if item in VIEWS:
                df = self.spark.sql(VIEWS[item].sql(SparkDialect()))
            else:
                df = self.table(item)
            df.createOrReplaceTempView(item)
            self._frames[item] = df
        return self._frames[name]

    def _missing(self, name: str) -> list[str]:
        needed: list[str] = []
        for item in ordered_closure([name]) or [name]:
            needed += [dep for dep in VIEWS[item].deps if dep not in VIEWS] if item in VIEWS else []
            needed.append(item)
        seen: list[str] = []
        for item in needed:
            if item not in seen and item not in self._frames:
                seen.append(item)
        return seen
