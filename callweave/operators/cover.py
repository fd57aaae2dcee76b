"""Ball cover: cells around pivots, and which cells can matter to each other.

Angles between unit vectors are a metric, so two cells whose pivots lie further apart than both radii and the wanted distance hold no
pair within it.  Pivots are a sample of bounded size, so the table of cells and of their pairs is bounded too, and the reasoning over
it is done where the plan is made; rows only ever go to the cells that can need them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import kernels
from callweave.session import cut

MOST_PIVOTS = 512
SAMPLE = 8
SLACK = 1e-4  # radians; scores are rounded to nine places, which near 1 is an angle of 5e-5

SIDE = "id string, v array<double>, cell int, angle double"


@dataclass(frozen=True)
class Cover:
    pivots: np.ndarray  # unit vectors, one a row
    names: list[str]  # ids of the rows that are pivots

    @property
    def odd(self) -> int:
        """The cell of vectors without direction; they are at a right angle to everything, so it is near every cell."""
        return len(self.names)


def cover(vectors: DataFrame, most: int = MOST_PIVOTS) -> Cover:
    """Pivots for a table (id, v): as many as the square root of its rows, at most ``most``.

    They are taken from a sample of ``SAMPLE`` rows a pivot, picked by a hash of the ids, each the furthest from those before it, so
    that small groups and strays have cells of their own and radii stay short.
    """
    n = min(most, max(1, int(np.ceil(np.sqrt(vectors.count())))))
    picked = vectors.where("exists(v, x -> x <> 0)").orderBy(F.xxhash64("id"), "id").limit(SAMPLE * n).collect()
    raw = np.array([r.v for r in picked], dtype=np.float64).reshape(len(picked), len(picked[0].v) if picked else 0)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    chosen, nearest = [0] if picked else [], np.full(len(picked), -1.0)
    while len(chosen) < min(n, len(picked)):
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
        chosen.append(int(nearest.argmin()))
    return Cover(unit[chosen], [picked[k].id for k in chosen])


def placed(vectors: DataFrame, over: Cover) -> DataFrame:
    """(id, v, cell, angle): each vector in the cell of its nearest pivot."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = kernels.matrix(batch.column("v"))
            cell, angle = np.full(len(m), over.odd), np.zeros(len(m))
            full = np.flatnonzero(np.linalg.norm(m, axis=1) > 0.5)
            if len(full) and over.odd:
                near = m[full] @ over.pivots.T
                cell[full] = near.argmax(axis=1)
                angle[full] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(angle)],
                                             names=["id", "v", "cell", "angle"])

    return cut(vectors.select("id", "v").mapInArrow(run, SIDE), "cells")


def cell_stats(side: DataFrame, over: Cover) -> tuple[np.ndarray, np.ndarray]:
    """Radius and number of rows of each cell (no radius: no rows); one row a cell is fetched."""
    radius, rows = np.full(over.odd + 1, -1.0), np.zeros(over.odd + 1, dtype=np.int64)
    for r in side.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():
        radius[r.cell], rows[r.cell] = r.radius, r.n
    return radius, rows


def bounds(over: Cover, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest angle between rows of any two cells with these radii."""
    between = np.full((over.odd + 1, over.odd + 1), np.pi / 2)
    between[:-1, :-1] = np.arccos(np.clip(over.pivots @ over.pivots.T, -1, 1))
    least = np.maximum(0.0, between - left[:, None] - right[None, :] - SLACK)
    most = np.minimum(np.pi, between + left[:, None] + right[None, :] + SLACK)
    for side in (least, most):
        side[-1, :] = side[:, -1] = np.pi / 2
    least[-1, :] = least[:, -1] = 0.0
    return least, most


def reach_of_nearest(over: Cover, left: tuple, right: tuple, k: int) -> np.ndarray:
    """Which right cells may hold one of the ``k`` nearest of a row of each left cell: those no further than some cells with k rows surely are."""
    least, most = bounds(over, left[0], right[0])
    most[:, right[1] == 0] = np.inf
    order = np.argsort(most, axis=1)
    enough = np.cumsum(right[1][order], axis=1) >= k
    limit = np.where(enough.any(axis=1), np.take_along_axis(most, order, 1)[np.arange(len(order)), enough.argmax(axis=1)], np.inf)
    return (least <= limit[:, None] + SLACK) & (left[1] > 0)[:, None] & (right[1] > 0)[None, :]


def reach_within(over: Cover, left: tuple, right: tuple, angle: float) -> np.ndarray:
    """Which right cells may hold a row within ``angle`` of a row of each left cell."""
    least, _ = bounds(over, left[0], right[0])
    return (least <= angle + SLACK) & (left[1] > 0)[:, None] & (right[1] > 0)[None, :]


def parts(rows: DataFrame, part_rows: int) -> DataFrame:
    """Placed rows with ``part``: each cell dealt into parts of about ``part_rows``, every row in one of them."""
    counts = rows.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / part_rows)).alias("parts"))
    return rows.join(counts, "cell").withColumn("part", F.concat_ws("/", "cell", F.pmod(F.xxhash64("id"), F.col("parts")))).drop("parts")


def tracts(stats: tuple, most: int = 32) -> np.ndarray:
    """A number for each cell: cells of like radius share one until they hold a share of all rows, so there are few for any number of cells."""
    order = np.argsort(stats[0], kind="stable")
    before = np.cumsum(stats[1][order]) - stats[1][order]
    tract = np.empty(len(order), dtype=np.int32)
    tract[order] = before * most // max(1, int(stats[1].sum()))
    return tract


def in_tracts(rows: DataFrame, tract: np.ndarray) -> DataFrame:
    return rows.select("id", "v", F.element_at(F.lit(tract.tolist()), F.col("cell") + 1).cast("int").alias("tract"))


def visits(rows: DataFrame, over: Cover, right: tuple, tract: np.ndarray) -> DataFrame:
    """Rows (id, v, limit), once for each tract with a cell that may hold a row within the angle ``limit`` of this row: (id, v, tract).

    A row is judged by its own angles to the pivots, so strays, whose cells are wide, go to few of the tight ones.
    """
    radius, filled = right[0], right[1] > 0
    member = tract[:, None] == np.arange(tract.max() + 1)[None, :]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m, limit = kernels.matrix(batch.column("v")), batch.column("limit").to_numpy()
            far = np.zeros((len(m), over.odd + 1))
            if over.odd:
                far[:, :-1] = np.arccos(np.clip(m @ over.pivots.T, -1, 1)) - radius[None, :-1]
            far[np.linalg.norm(m, axis=1) <= 0.5] = 0.0
            near = (far <= limit[:, None] + 2 * SLACK) & filled[None, :]
            row, to = np.nonzero(near.astype(np.float32) @ member.astype(np.float32))
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(taken), batch.column("v").take(taken), pa.array(to.astype(np.int32))],
                                             names=["id", "v", "tract"])

    return rows.select("id", "v", "limit").mapInArrow(run, "id string, v array<double>, tract int")


def sent(right: DataFrame, reach: np.ndarray) -> DataFrame:
    """Right rows, once for each left cell they can matter to: (id, v, ..., cell of the left)."""
    left, own = np.nonzero(reach)
    pairs = right.sparkSession.createDataFrame(pa.table({"cell": pa.array(own.astype(np.int32)), "to": pa.array(left.astype(np.int32))}))
    targets = pairs.groupBy("cell").agg(F.collect_list("to").alias("to"))
    return right.join(targets, "cell").drop("cell", "angle").withColumn("cell", F.explode("to")).drop("to")


def neighbourhoods(over: Cover, stats: tuple, least_rows: int, most: int = 32) -> np.ndarray:
    """A number for each cell: cells that lie one after the other on a way from pivot to nearest pivot share one until they hold a share of all rows."""
    way, left = [], set(range(over.odd))
    while left:
        rest = np.array(sorted(left))
        way.append(int(rest[(over.pivots[rest] @ over.pivots[way[-1]]).argmax()] if way else rest[0]))
        left.remove(way[-1])
    way = np.array([*way, over.odd])
    before = np.cumsum(stats[1][way]) - stats[1][way]
    total = int(stats[1].sum())
    tracts = min(most, max(1, -(-total // max(1, least_rows))))
    tract = np.empty(len(way), dtype=np.int32)
    tract[way] = np.minimum(before * tracts // max(1, total), tracts - 1)
    return tract


def gathered(left: DataFrame, right: DataFrame, reach: np.ndarray, tract: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Left rows with the tract of their cell, right rows once for each tract with a cell that they can matter to: (id, v, cell, tract)."""
    meets = np.zeros((tract.max() + 1, reach.shape[1]), dtype=bool)
    np.logical_or.at(meets, tract, reach)
    targets = [np.flatnonzero(meets[:, c]).tolist() for c in range(reach.shape[1])]
    to = F.element_at(F.lit(tract.tolist()), F.col("cell") + 1).cast("int")
    pairs = right.sparkSession.createDataFrame([(c, t) for c, t in enumerate(targets) if t], "cell int, to array<int>")
    return left.select("id", "v", "cell", to.alias("tract")), right.join(pairs, "cell").select("id", "v", "cell", F.explode("to").alias("tract"))
