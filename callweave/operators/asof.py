"""As-of lookups that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof(lookups: DataFrame, events: DataFrame, forward: bool = False) -> DataFrame:
    """Adds ``found``: the nearest event ``value`` of the same ``key`` strictly on one side of ``ts``.

    ``lookups``: key, ts, tie, plus any columns; ``events``: key, ts, tie, value.
    (ts, tie) orders rows; an event at exactly the same (ts, tie) does not count.
    Each (key, day) is scanned on its own; days without a match inside them take
    the edge event of the closest other day, from a table of one row per key and
    day.  No task ever sorts a whole key.
    """
    day = F.to_date("ts")
    extra = [c for c in lookups.columns if c not in ("key", "ts", "tie")]
    left = lookups.select("key", day.alias("day"), F.struct("ts", "tie").alias("o"), F.lit(None).cast(events.schema["value"].dataType).alias("value"),
                          F.lit(False).alias("is_event"), F.struct(*[F.col(c) for c in extra]).alias("x"))
    right = events.select("key", day.alias("day"), F.struct("ts", "tie").alias("o"), "value", F.lit(True).alias("is_event"),
                          F.lit(None).cast(left.schema["x"].dataType).alias("x"))
    rows = left.unionByName(right)
    order = F.desc("o") if forward else F.asc("o")
    inside = W.partitionBy("key", "day").orderBy(order, F.asc("is_event")).rowsBetween(W.unboundedPreceding, -1)
    kept = F.struct(F.col("o"), F.col("value"))
    marked = rows.withColumn("near", F.last(F.when(F.col("is_event"), kept), ignorenulls=True).over(inside)).where("not is_event")

    edge = F.min if forward else F.max
    per_day = right.groupBy("key", "day").agg(edge(kept).alias("edge"))
    days = per_day.unionByName(lookups.select("key", day.alias("day")).distinct().withColumn("edge", F.lit(None).cast(per_day.schema["edge"].dataType)))
    merged = days.groupBy("key", "day").agg(F.max("edge").alias("edge"))
    across = W.partitionBy("key").orderBy(F.desc("day") if forward else F.asc("day")).rowsBetween(W.unboundedPreceding, -1)
    carried = merged.select("key", "day", F.last("edge", ignorenulls=True).over(across).alias("far"))
    joined = marked.join(carried, ["key", "day"], "left")
    near_ok = F.col("near.o") != F.col("o")
    found = F.when(F.col("near").isNotNull() & near_ok, F.col("near")).otherwise(F.col("far"))
    return joined.select("key", F.col("o.ts").alias("ts"), F.col("o.tie").alias("tie"), *[F.col(f"x.{c}").alias(c) for c in extra],
                         found["value"].alias("found"), found["o"]["ts"].alias("found_ts"))
