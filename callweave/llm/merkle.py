"""Merkle manifest of a table: one hash tree per group, one tree over the groups, and a proof for every row.

A leaf is the SHA-256 of a row's fields.  The leaves of a group ascend by id; while a group has more than one node, every
``FAN`` consecutive ones become their hash (the last run may be shorter, even one).  The last node of a group is its subroot;
the subroots, null group first, then bytewise, make a tree of the same form, whose last node is the root.

Levels are lag/lead windows: the window of a block of ``BLOCK`` consecutive slots carries ``DEPTH`` levels at once.  At level k the
node rows stand ``FAN ** k`` slots apart, so fixed offsets of lag and lead, masked by the slot's place in its run and by the
length of the run, are the siblings, and the first child of a run hashes the parent.  First rows of blocks go on to the next
round, so n leaves take log n / log BLOCK rounds, and a task holds one block whatever the size of a group.

Null fields hash as ``-``; an empty text is the value of length 0.  Rows of one id are ordered by their leaves, so repeated rows are
leaves of their own next to each other; a null id comes first.  Only the named fields are read, whatever else the table holds.  An
empty table gives no rows.  A text is hashed in one piece, however long.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.session import cut

FAN = 8
DEPTH = 4
BLOCK = FAN**DEPTH
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return digest(*[field(f) for f in fields])


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``slot`` (from 0, in the given order) and ``n`` (rows) within each group.

    Rows are laid out by range and numbered by their place in the partition; only the counts per partition and group are summed in
    order, so no group is ever in one task.
    """
    # Equal rows are told apart by their place in the table, so that a range may end among them.
    rows, keys = rows.withColumn("tie", F.monotonically_increasing_id()), [F.col(group), *order, F.col("tie")]
    laid = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).drop("tie")
    laid = cut(laid.withColumn("at", F.monotonically_increasing_id()), "laid")
    laid = laid.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    runs = laid.groupBy("part", group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
    whole = Window.partitionBy(group)
    before = F.sum("own").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", group, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("own").over(whole).alias("n"))
    return laid.join(runs, ["part", group]).withColumn("slot", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def within(nodes: DataFrame) -> DataFrame:
    """(g, slot, n, h) with ``block``, ``steps`` (siblings left and right, up to the block's top) and, on the first row of a block, ``peak``."""
    rows = nodes.withColumn("block", F.floor(F.col("slot") / BLOCK))
    block = Window.partitionBy("g", "block").orderBy("slot")
    up_to_here = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = []
    for level in range(DEPTH):
        wide, name = FAN**level, f"h{level}" if level else "h"
        place = F.floor(F.col("slot") / wide) % FAN
        starts, many = F.col("slot") % wide == 0, F.col("n") > wide
        lags = [F.when(place >= j, F.lag(name, j * wide).over(block)).alias(f"b{j}") for j in range(1, FAN)]
        leads = [F.when(place + j < FAN, F.lead(name, j * wide).over(block)).alias(f"a{j}") for j in range(1, FAN)]
        rows = rows.select("*", *lags, *leads)
        rows = rows.withColumn(f"left{level}", F.when(starts, F.concat_ws("", *[f"b{j}" for j in reversed(range(1, FAN))])))
        rows = rows.withColumn(f"right{level}", F.when(starts, F.concat_ws("", *[f"a{j}" for j in range(1, FAN)])))
        rows = rows.drop(*[f"{side}{j}" for side in "ab" for j in range(1, FAN)])
        parent = F.when(many, digest(F.col(name), F.col(f"right{level}"))).otherwise(F.col(name))
        rows = rows.withColumn(f"h{level + 1}", F.when(F.col("slot") % (wide * FAN) == 0, parent))
        if level:  # the siblings of a node hold for all leaves below it
            rows = rows.select("*", F.last(f"left{level}", True).over(up_to_here).alias("l"), F.last(f"right{level}", True).over(up_to_here).alias("r"))
            rows = rows.drop(f"left{level}", f"right{level}").withColumnsRenamed({"l": f"left{level}", "r": f"right{level}"})
        steps.append(F.when(many, F.struct(F.col(f"left{level}").alias("l"), F.col(f"right{level}").alias("r"))))
    return rows.select(*nodes.columns, "block", F.array_compact(F.array(*steps)).alias("steps"), F.col(f"h{DEPTH}").alias("peak"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the tops of their blocks, the tops of those, and so on to one node a group."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops = within(levels[-1]).where(F.col("slot") % BLOCK == 0)
        levels.append(cut(tops.select("g", F.col("block").alias("slot"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("peak").alias("h")), "tops"))
        most = -(-most // BLOCK)
        if most <= 1:
            return levels


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes with all steps to the root; ``above`` has the steps and whatever else belongs to the single last node of each group."""
    known = levels[-1].select("g", F.col("slot").alias("block"), F.col("h").alias("subroot")).join(above, "g")
    for nodes in reversed(levels[:-1]):
        known = within(nodes).join(known.drop("n", "h").withColumnRenamed("steps", "more"), ["g", "block"])
        known = known.withColumn("steps", F.concat("steps", "more")).drop("more", "peak", "block").withColumnRenamed("slot", "block")
    return known


def manifest(rows: DataFrame, ident: str = "doc_id", group: str = "lang", fields: list[str] | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: id, ``leaf``, ``subroot``, ``root``, ``steps`` (siblings left and right of the node, level by level) and ``other``.

    ``other`` is the leaf of the row as ``changed`` has it (column by column), for checking a copy of the table against the tree.
    """
    fields = fields or FIELDS
    changed = changed or {}
    leaves = rows.select(F.col(ident).alias("id"), F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n")).alias("g"),
                         leaf_of([F.col(f) for f in fields]).alias("h"), leaf_of([changed.get(f, F.col(f)) for f in fields]).alias("other"))
    leaves = numbered(cut(leaves, "leaves"), "g", [F.col("id").asc_nulls_first(), F.col("h")])
    levels = climb(leaves)
    subroots = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("group"), "h")
    tree = climb(numbered(subroots, "g", [F.col("group")]))
    nothing = levels[-1].select(F.array(F.struct(F.lit("").alias("l"), F.lit("").alias("r"))).alias("steps")).schema["steps"].dataType
    top = tree[-1].select("g", F.array().cast(nothing).alias("steps"))
    above = descend(tree, top).select(F.col("group").alias("g"), F.col("subroot").alias("root"), "steps")
    return descend(levels, above).select(F.col("id").alias(ident), F.col("h").alias("leaf"), "subroot", "root", "steps", "other")


def proof(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def folded(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(steps, start, lambda h, s: digest(s["l"], h, s["r"]))


def lower_az(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
