"""Density hierarchy: minimum spanning tree over mutual reachability, merge tree, condensed tree, clusters by excess of mass.

The core distance of a vector is the distance to its ``min_samples``-th other vector, and two vectors reach each other at the greatest of
their distance and both core distances (Euclidean, between unit vectors).  The tree grows in rounds: every component takes its
lightest edge to another one, among them in the order (weight, ids), so that no cycle can close; the largest component takes none, as the
others reach it.  Candidates come from lists of nearest neighbours and from the pivots of a ball cover; they bound what is left to search, which
is done cell by cell, by products in single precision that say which rows need the exact one.

Merging goes up the tree in buckets of edges by weight, each component of a bucket on its own; edges of one weight count as one merge.
A cluster is born where at least ``min_size`` vectors are together, and ends where it meets another one.  Its mass is the sum over its vectors
of 1/distance where they leave it, less 1/distance where it ends; it is chosen when that is no less than the masses of the chosen
clusters inside it.  The cluster of everything is never chosen.

Equal vectors are one row with a count, so copies cost nothing; distances below ``CLOSEST`` count as that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave import constants as C
from callweave.functions import vec as V
from callweave.functions import kernels
from callweave.operators import cover as CV
from callweave.operators.density import NOISE, components
from callweave.operators.vectors import BLOCK_ROWS, block_product, nearest
from callweave.session import cut

CLOSEST = 1e-3
LIST_ROWS = 8  # neighbours kept for each vector, or ``min_samples`` if that is more
BUCKET_EDGES = 200_000

EDGE = "w double, lo bigint, hi bigint"


def _distance(score: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.round(score, 9)))


def _best(candidates: DataFrame) -> DataFrame:
    """The first edge of each component in the order (weight, ids)."""
    return candidates.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("comp", "e.*")


def distinct_vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, members): a number, unit vector and count for each distinct vector; the number of each question."""
    named = embeddings.select("question_id", F.col("vector").cast("array<double>").alias("vector"))
    once = named.groupBy("vector").agg(F.count("*").alias("n"))
    once = cut(once.withColumn("a", F.monotonically_increasing_id()), "vectors")
    return once.select("a", V.unit(F.col("vector")).alias("v"), "n"), named.join(once.select("vector", "a"), "vector").select("question_id", "a")


def neighbour_lists(vectors: DataFrame, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """(points, lists): core distance and the distance beyond which a list says nothing; the lists by mutual reachability."""
    table = vectors.select(F.col("a").cast("string").alias("id"), "v")
    near = nearest(table, table, max(min_samples, LIST_ROWS), left_id="id", left_vector="v", right_id="id", right_vector="v", skip_self=True, pruned=True)
    near = cut(near.select(F.col("left_id").cast("bigint").alias("a"), F.col("right_id").cast("bigint").alias("b"), "position",
                           F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("d")), "near")
    counts = vectors.select("a", "n")
    order = Window.partitionBy("a").orderBy("position")
    seen = near.join(counts.withColumnsRenamed({"a": "b", "n": "others"}), "b").withColumn("others", F.sum("others").over(order))
    lists = seen.groupBy("a").agg(F.max("d").alias("last"), F.count("*").alias("rows"), F.sort_array(F.collect_list(F.struct("d", "others"))).alias("l"))
    enough = F.filter("l", lambda x: x["others"] + F.col("n") - 1 >= min_samples)
    core = F.when(F.col("n") > min_samples, F.lit(0.0)).otherwise(F.coalesce(F.get(enough, F.lit(0))["d"], F.col("last"), F.lit(0.0)))
    full = F.col("rows") == max(min_samples, LIST_ROWS)
    points = vectors.join(lists, "a", "left").select("a", "v", "n", core.alias("core"), F.when(full, F.col("last")).otherwise(F.lit(float("inf"))).alias("beyond"))
    points = cut(points, "points")
    cores = points.select("a", "core")
    reach = near.join(cores, "a").join(cores.withColumnsRenamed({"a": "b", "core": "other"}), "b")
    return points, cut(reach.select("a", "b", F.greatest("d", "core", "other").alias("w")), "lists")


def spanning_tree(points: DataFrame, lists: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (w, lo, hi) of the minimum spanning tree of mutual reachability."""
    spark = points.sparkSession
    over = CV.cover(points.select(F.col("a").cast("string").alias("id"), "v"))
    cells = CV.placed(points.select(F.col("a").cast("string").alias("id"), "v"), over)
    fixed = cut(points.join(cells.select(F.col("id").cast("bigint").alias("a"), "cell", "angle"), "a"), "fixed")
    radius = CV.cell_stats(fixed, over)
    least, _ = CV.bounds(over, radius[0], radius[0])
    comps = fixed.select("a", F.col("a").alias("comp"))
    tree: list[DataFrame] = []
    while True:
        now = cut(fixed.join(comps, "a"), "round")
        most = now.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(2).collect()
        if len(most) < 2:
            break
        largest = most[0].comp
        own = now.select("a", "comp")
        lists = cut(lists.select("a", "b", "w").join(own, "a").join(own.withColumnsRenamed({"a": "b", "comp": "into"}), "b").where("comp <> into"), "lists")
        # An edge of a list is one of both its ends, so what a search can still find is in neither's list.
        from_lists = lists.select(F.explode(F.array("comp", "into")).alias("comp"), "w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        known = cut(_best(from_lists.where(F.col("comp") != largest).unionByName(_to_pivots(now, over, largest))), "bounds")
        found = known.unionByName(_search(spark, now, known, over, radius, least, block_rows, largest))
        chosen = cut(_best(found), "chosen")
        edges = cut(chosen.select("w", "lo", "hi").distinct(), "edges")
        tree.append(edges)
        ends = edges.join(own.withColumnsRenamed({"a": "lo", "comp": "x"}), "lo").join(own.withColumnsRenamed({"a": "hi", "comp": "y"}), "hi")
        steps = chosen.join(ends.select("lo", "hi", "x", "y"), ["lo", "hi"])
        steps = steps.select("comp", (F.col("x") + F.col("y") - F.col("comp")).alias("up")).unionByName(
            spark.createDataFrame([(largest, largest)], "comp bigint, up bigint"))
        comps = own.join(_roots(steps), "comp").select("a", F.col("up").alias("comp"))
    out = spark.createDataFrame([], EDGE)
    for edges in tree:
        out = out.unionByName(edges)
    return out


def _roots(steps: DataFrame) -> DataFrame:
    """(comp, up): where the way from each component ends, when each points to one other or itself and only pairs point to each other."""
    back = steps.select(F.col("comp").alias("up"), F.col("up").alias("back"))
    way = cut(steps.join(back, "up").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("up")), F.col("comp")).otherwise(F.col("up")).alias("up")), "way")
    while True:
        on = cut(way.join(way.select(F.col("comp").alias("up"), F.col("up").alias("on")), "up").select("comp", "up", "on"), "way")
        way = on.select("comp", F.col("on").alias("up"))
        if not on.where("up <> on").limit(1).count():
            return way


def _to_pivots(now: DataFrame, over: CV.Cover, largest: int) -> DataFrame:
    """The lightest edge from the vectors of each component but one to a pivot of another one, component by component and batch by batch."""
    wanted = now.sparkSession.createDataFrame([(int(n),) for n in over.names], "a bigint")
    rows = {r.a: r for r in now.join(F.broadcast(wanted), "a").select("a", "core", "comp").collect()} if over.names else {}
    names = np.array([int(n) for n in over.names], dtype=np.int64)
    cores, comps = (np.array([rows[int(n)][c] for n in over.names]) for c in ("core", "comp"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            a, comp, core = (batch.column(c).to_numpy() for c in ("a", "comp", "core"))
            m = np.array(batch.column("v").to_pylist())
            w = np.maximum(np.maximum(core[:, None], cores[None, :]), _distance(m @ over.pivots.T))
            w[comp[:, None] == comps[None, :]] = np.inf
            best = w.min(axis=1)
            to = np.where(w == best[:, None], names[None, :], np.iinfo(np.int64).max).min(axis=1)
            ok = np.isfinite(best)
            frame = pd.DataFrame({"comp": comp[ok], "w": best[ok], "lo": np.minimum(a, to)[ok], "hi": np.maximum(a, to)[ok]})
            yield pa.RecordBatch.from_pandas(frame.sort_values(["comp", "w", "lo", "hi"]).drop_duplicates("comp"), preserve_index=False)

    return now.where(F.col("comp") != largest).select("a", "comp", "core", "v").mapInArrow(run, f"comp bigint, {EDGE}")


def _search(spark, now: DataFrame, known: DataFrame, over: CV.Cover, radius: tuple, least: np.ndarray, block_rows: int,
            largest: int) -> DataFrame:
    """Edges no heavier than the known bounds of their components, all but the largest, in the cells that can hold one."""
    bounded = now.join(known.select("comp", F.col("w").alias("bound")), "comp", "left").withColumn("bound", F.coalesce("bound", F.lit(2.0)))
    open_ = bounded.where((F.col("comp") != largest) & F.expr("core <= bound and beyond <= bound"))  # all others have every such edge in their lists
    widest = -1.0
    limit, kinds = np.full(over.odd + 1, -1.0), np.zeros((over.odd + 1, 2), dtype=np.int64)
    for r in open_.groupBy("cell").agg(F.max("bound").alias("bound")).collect():
        limit[r.cell] = 2 * np.arcsin(min(1.0, r.bound / 2))
        widest = max(widest, r.bound)
    if limit.max() < 0:
        return spark.createDataFrame([], f"comp bigint, {EDGE}")
    for r in now.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).collect():
        kinds[r.cell] = r.a, r.b
    pure = kinds[:, 0] == kinds[:, 1]
    same = pure[:, None] & pure[None, :] & (kinds[:, None, 0] == kinds[None, :, 0])
    reach = (least <= limit[:, None] + CV.SLACK) & ~same & (limit[:, None] >= 0) & (radius[1] > 0)[None, :]
    # The product carries one list a row, which ends with core, component, and bound (left) or floor (right): no edge that the list of its row lacks is lighter.
    floor = F.greatest("core", "beyond")
    name, comp = F.lpad(F.col("a").cast("string"), 19, "0").alias("id"), F.col("comp").cast("double")
    left = open_.select(name, F.concat("v", F.array(F.col("core"), comp, F.col("bound"))).alias("v"), "cell")
    right = now.where(floor <= widest).select(name, F.concat("v", F.array(F.col("core"), comp, floor)).alias("v"), "cell")
    left, right = CV.gathered(left, right, reach, CV.neighbourhoods(over, radius, block_rows))

    def lightest(state, a, b):
        x, (core, comp, bound) = a[1][:, :-3], a[1][:, -3:].T
        best, names, limit = (np.full(len(x), np.inf), np.full(len(x), None, dtype=object), bound) if state is None else state
        kinds, kind = np.unique(comp, return_inverse=True)
        keep = b[1][:, -1] <= limit.max()
        if len(kinds) == 1:
            keep &= b[1][:, -2] != kinds[0]
        ids, m = np.asarray(b[0], dtype=object)[keep], b[1][keep]
        quick, slack = kernels.rough(x), kernels.rough_slack(x.shape[1])
        for at in range(0, len(m), kernels.ROUGH_COLUMNS):
            y, (cores, others, _) = m[at: at + kernels.ROUGH_COLUMNS, :-3], m[at: at + kernels.ROUGH_COLUMNS, -3:].T
            scores = quick @ kernels.rough(y).T
            if len(kinds) > 1:
                scores[comp[:, None] == others[None, :]] = -2.0
            rows = np.flatnonzero(scores.max(axis=1) >= 1 - limit ** 2 / 2 - slack)
            if not len(rows):
                continue
            w = np.maximum(np.maximum(core[rows, None], cores[None, :]), _distance(x[rows] @ y.T))
            w[comp[rows, None] == others[None, :]] = np.inf
            to = w.argmin(axis=1)  # right rows come in the order of their ids
            w = w[np.arange(len(w)), to]
            nearer = w < best[rows]
            best[rows[nearer]], names[rows[nearer]] = w[nearer], ids[at + to[nearer]]
            lowest = np.full(len(kinds), np.inf)
            np.minimum.at(lowest, kind, np.minimum(limit, best))
            limit = lowest[kind]  # one edge of each component is wanted; as light ones still are, for their ids
        return (best, names, limit), None

    def answer(state, a):
        if state is None:
            return None
        ok = np.isfinite(state[0])
        x, y = np.array(a[0], dtype=np.int64)[ok], state[1][ok].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[1][ok, -2].astype(np.int64)), pa.array(state[0][ok]), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))],
                                          names=["comp", "w", "lo", "hi"])

    return block_product(left, right, block_rows, lightest, answer, f"comp bigint, {EDGE}", unit=False, group="tract", reach=reach, apart=-2)


# --- merge tree ---------------------------------------------------------------------------
NODE = "node bigint, size bigint, members array<bigint>, cluster string, leaving double, inside double"
MERGED = f"kind string, {NODE}, parent string, mass double, wins boolean"


def _merge(edges: pd.DataFrame, nodes: pd.DataFrame, min_size: int) -> list[tuple]:
    """Merges the nodes of one component in the order of weights: node, home and cluster rows (see ``MERGED``)."""
    held = {r.node: [r.node, r.size, None if r.members is None else list(r.members), r.cluster if isinstance(r.cluster, str) else None, r.leaving, r.inside] for r in nodes.itertuples()}
    up = {k: k for k in held}
    out: list[tuple] = []

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for w, run in edges.sort_values("w").groupby("w", sort=True):
        density, groups = 1.0 / max(w, CLOSEST), {}
        for x, y in zip(run["x"], run["y"]):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                groups.setdefault(min(x, y), set()).update({x, y}, groups.pop(max(x, y), set()))
        for root, parts in groups.items():
            parts = [held.pop(p) for p in sorted(parts)]
            size, small, big = sum(p[1] for p in parts), [p for p in parts if p[3] is None], [p for p in parts if p[3] is not None]
            members = [m for p in small for m in p[2]]
            if not big and size < min_size:
                held[root] = [root, size, members, None, 0.0, 0.0]
                continue
            if len(big) == 1:
                cluster, leaving, inside = big[0][3], big[0][4] + density * (size - big[0][1]), big[0][5]
            else:
                cluster, leaving, inside = f"{root}@{w!r}", density * size, 0.0
                for _, n, _, own, left, below in big:
                    mass = left - density * n
                    out.append(("cluster", 0, 0, None, own, 0.0, 0.0, cluster, mass, mass >= below))
                    inside += max(mass, below)
            out += [("home", m, 0, None, cluster, 0.0, 0.0, None, 0.0, False) for m in members]
            held[root] = [root, size, None, cluster, leaving, inside]
    return out + [("node", *n, None, 0.0, False) for n in held.values()]


def condensed_tree(points: DataFrame, tree: DataFrame, min_size: int, bucket_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(homes, clusters): the cluster that each vector leaves last (a, cluster), and (cluster, parent, mass, wins)."""
    spark = points.sparkSession
    tree = cut(tree, "tree")
    buckets = max(1, -(-tree.count() // (bucket_edges or BUCKET_EDGES)))
    marks = tree.approxQuantile("w", [k / buckets for k in range(1, buckets)], 0.01 / buckets) if buckets > 1 else []
    marks = [float("-inf"), *sorted(set(marks)), float("inf")]
    size = F.col("n")
    few = size < min_size
    nodes = points.select(F.col("a").alias("node"), size.alias("size"), F.when(few, F.array("a")).alias("members"),
                          F.when(~few, F.concat(F.col("a").cast("string"), F.lit("@copies"))).alias("cluster"),
                          F.when(few, 0.0).otherwise(size / CLOSEST).alias("leaving"), F.lit(0.0).alias("inside"))
    place = points.select("a", F.col("a").alias("node"))
    homes = [nodes.where("members is null").select(F.col("node").alias("a"), "cluster")]
    clusters: list[DataFrame] = []
    fields = [f.split()[0] for f in MERGED.split(", ")]

    def merge(edges: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_merge(edges, own, min_size), columns=fields)

    for low, high in zip(marks[:-1], marks[1:]):
        ends = tree.where((F.col("w") > low) & (F.col("w") <= high))
        ends = ends.join(place.withColumnsRenamed({"a": "lo", "node": "x"}), "lo").join(place.withColumnsRenamed({"a": "hi", "node": "y"}), "hi").select("w", "x", "y")
        if buckets == 1:
            roots = nodes.select("node", F.lit(0).cast("bigint").alias("root"))
        else:
            ends = cut(ends, "ends")
            grouped = components(ends.select(F.col("x").cast("string").alias("a"), F.col("y").cast("string").alias("b")))
            roots = cut(grouped.select(F.col("id").cast("bigint").alias("node"), F.col("root").cast("bigint").alias("root")), "roots")
        edges = ends.join(roots.withColumnRenamed("node", "x"), "x")
        own = nodes.join(roots.withColumnRenamed("root", "group"), "node")
        merged = edges.groupBy("root").cogroup(own.groupBy("group")).applyInPandas(merge, MERGED)
        merged = cut(merged, "merged")
        homes.append(merged.where("kind = 'home'").select(F.col("node").alias("a"), "cluster"))
        clusters.append(merged.where("kind = 'cluster'").select("cluster", "parent", "mass", "wins"))
        fresh = merged.where("kind = 'node'").select(*[f.split()[0] for f in NODE.split(", ")])
        nodes = cut(nodes.join(roots, "node", "left_anti").unionByName(fresh), "nodes")
        least = roots.groupBy("root").agg(F.min("node").alias("to"))  # the number of a component's new node
        place = cut(place.join(roots.join(least, "root").select("node", "to"), "node", "left").select("a", F.coalesce("to", "node").alias("node")), "place")
    everything = nodes.where("cluster is not null").select("cluster", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("mass"), F.lit(False).alias("wins"))
    for part in clusters:
        everything = everything.unionByName(part)
    home = spark.createDataFrame([], "a bigint, cluster string")
    for part in homes:
        home = home.unionByName(part)
    return home, cut(everything, "clusters")


def chosen_clusters(clusters: DataFrame) -> DataFrame:
    """(cluster, top): the outermost winner among a cluster and those around it, by doubling the way up."""
    way = cut(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("wins"), F.col("cluster")).alias("top")), "way")
    while way.where("up is not null").limit(1).count():
        above = way.select(F.col("cluster").alias("up"), F.col("up").alias("further"), F.col("top").alias("outer"))
        way = cut(way.join(above, "up", "left").select("cluster", F.col("further").alias("up"), F.coalesce("outer", "top").alias("top")), "way")
    return way.select("cluster", "top")


def density_tree(embeddings: DataFrame, min_size: int = C.DENSITY_MIN_CLUSTER_SIZE, min_samples: int = C.DENSITY_MIN_SAMPLES,
                 block_rows: int = BLOCK_ROWS, bucket_edges: int | None = None) -> DataFrame:
    """(question_id, cluster): clusters of the density hierarchy by excess of mass, named by their smallest id; '-1' for noise."""
    vectors, members = distinct_vectors(embeddings)
    points, lists = neighbour_lists(vectors, min_samples)
    homes, clusters = condensed_tree(points, spanning_tree(points, lists, block_rows), max(2, min_size), bucket_edges)
    tops = homes.join(chosen_clusters(clusters).where("top is not null"), "cluster").select("a", "top")
    placed = cut(members.join(tops, "a", "left").select("question_id", "top"), "placed")
    names = placed.where("top is not null").groupBy("top").agg(F.min("question_id").alias("cluster"))
    return placed.join(names, "top", "left").select("question_id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
