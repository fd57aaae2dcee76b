"""Vector tables: normalising, search, nearest neighbours, centroids, assignment, quality."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callweave import constants as C
from callweave.functions import kernels
from callweave.functions import vec as V
from callweave.operators import cover as CV
from callweave.session import cut

BLOCK_ROWS = 1024  # left rows of one product
HELD_ROWS = 16384  # left rows a task holds at most; right rows are copied once for so many
SPREAD = 32  # blocks that left rows are dealt into while fewer than ``HELD_ROWS`` are in each
SCORES = 1 << 21  # entries of one product
APART_ROWS = 64  # left rows that each value of ``apart`` has in the mean, where pieces hold one
CELL_ROWS = 256  # left rows of one product where only some cells meet

NEAREST = "left_id string, right_id string, score double, position bigint"


def normalized(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Unit vectors next to the length they had; zero vectors stay zero."""
    return df.withColumn("norm", V.norm(F.col(vector))).withColumn(vector, V.unit(F.col(vector)))


def pair_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of every listed pair (``a``, ``b``)."""
    left = vectors.select(F.col("question_id").alias("a"), F.col("vector").alias("va"))
    right = vectors.select(F.col("question_id").alias("b"), F.col("vector").alias("vb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", V.cosine(F.col("va"), F.col("vb")).alias("cosine"))


# --- nearest neighbours ----------------------------------------------------------------
def _scores(left: np.ndarray, right: np.ndarray, left_ids, right_ids, skip_self: bool) -> np.ndarray:
    scores = np.round(left @ right.T, 9)
    both = set(left_ids).intersection(right_ids) if skip_self else ()
    if both:
        rows, cols = (np.array([k for k, i in enumerate(ids) if i in both]) for ids in (left_ids, right_ids))
        own = np.asarray(left_ids, dtype=object)[rows][:, None] == np.asarray(right_ids, dtype=object)[cols][None, :]
        row, col = np.nonzero(own)
        scores[rows[row], cols[col]] = -np.inf
    return scores


def _side(df: DataFrame, ident: str, vector: str) -> DataFrame:
    return df.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))


def nearest(left: DataFrame, right: DataFrame, k: int, *, left_id="question_id", left_vector="vector",
            right_id="question_id", right_vector="vector", skip_self=False, unit=True, block_rows: int = BLOCK_ROWS,
            pruned: bool = False) -> DataFrame:
    """Exact ``k`` nearest right rows of every left row by cosine (dot product if not ``unit``).

    With ``pruned`` both sides are laid out in cells first and a right row goes only to the cells where it can be among the nearest:
    for two large tables.  Without, it goes to every block of left rows: for a short right side such as centroids.
    """
    lhs, rhs = _side(left, left_id, left_vector), _side(right, right_id, right_vector)
    group = reach = None
    if pruned and unit:
        over = CV.cover(rhs)
        lhs, rhs = CV.placed(lhs, over), CV.placed(rhs, over)
        stats = CV.cell_stats(lhs, over)
        reach = CV.reach_of_nearest(over, stats, CV.cell_stats(rhs, over), k + skip_self)
        lhs, rhs = CV.gathered(lhs, rhs, reach, CV.neighbourhoods(over, stats, block_rows))
        group = "tract"
    return _top_k(lhs, rhs, k, block_rows, skip_self, unit, group, reach)


def _top_k(lhs: DataFrame, rhs: DataFrame, k: int, block_rows: int, skip_self: bool, unit: bool, group: str | None,
           reach: np.ndarray | None = None) -> DataFrame:
    """The best ``k`` right rows of each left row (id, v), within each group where one is given."""

    def merged(kept, block, batch, taken):
        """What is kept of the rows ``taken`` (all: None) with the best of this batch."""
        left, names = (block[1], block[0]) if taken is None else (block[1][taken], [block[0][i] for i in taken])
        scores = _scores(left, batch[1], names, batch[0], skip_self)
        rows, cols, _ = kernels.top_k(scores, k)
        fresh = (rows if taken is None else taken[rows], np.asarray(batch[0], dtype=object)[cols], scores[rows, cols])
        if kept is not None:
            fresh = tuple(np.concatenate(x) for x in zip(kept, fresh))
        order = np.lexsort((fresh[1].astype(str), -fresh[2], fresh[0]))
        rows, ids, scores = (x[order] for x in fresh)
        position = np.arange(len(rows)) - np.searchsorted(rows, rows)
        return rows[position < k], ids[position < k], scores[position < k]

    def best(kept, block, batch):
        if not unit:
            return merged(kept, block, batch, None), None
        # Once a row has k, a product in single precision tells whether anything here can come among them.
        left, n = kernels.rough(block[1]), len(block[0])
        for at in range(0, len(batch[0]), kernels.ROUGH_COLUMNS):
            part = batch[0][at: at + kernels.ROUGH_COLUMNS], batch[1][at: at + kernels.ROUGH_COLUMNS]
            if kept is None:
                kept = merged(None, block, part, None)
                continue
            first, count = np.searchsorted(kept[0], np.arange(n)), np.bincount(kept[0], minlength=n)
            least = np.full(n, -np.inf)
            full = count == k
            least[full] = kept[2][first[full] + k - 1] - kernels.rough_slack(left.shape[1])
            taken = np.flatnonzero((left @ kernels.rough(part[1]).T).max(axis=1) >= least)
            if len(taken):
                own = np.isin(kept[0], taken)
                fresh = merged(tuple(x[own] for x in kept), block, part, taken)
                fresh = tuple(np.concatenate((x[~own], y)) for x, y in zip(kept, fresh))
                order = np.argsort(fresh[0], kind="stable")
                kept = tuple(x[order] for x in fresh)
        return kept, None

    def answer(kept, block):
        if kept is None:
            return None
        rows, ids, scores = kept
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(block[0], dtype=object)[rows], pa.string()), pa.array(ids, pa.string()), pa.array(scores, pa.float64()),
             pa.array(np.arange(len(rows)) - np.searchsorted(rows, rows) + 1, pa.int64())], names=["left_id", "right_id", "score", "position"])

    return block_product(lhs, rhs, block_rows, best, answer, NEAREST, unit, group, reach)


def block_product(lhs: DataFrame, rhs: DataFrame, block_rows: int, step, end, schema: str, unit=True, group: str | None = None,
                  reach: np.ndarray | None = None, apart: int | None = None) -> DataFrame:
    """Every block of left rows against all right rows, streamed past it (tables (id, v), with ``group`` only rows of one group meet).

    Left rows are dealt into at most ``SPREAD`` blocks, or as many as it takes to have no more than ``HELD_ROWS`` in one, and never
    copied; right rows go to every block of their group.  A task holds one block and one Arrow batch at a time and multiplies
    them piece by piece, at most ``block_rows`` left rows and ``SCORES`` entries at once: ``step(state, (ids, matrix), (ids, matrix))
    -> (state, rows or None)``, with a state for each piece of left rows and right rows in the order of their ids, and
    ``end(state, (ids, matrix)) -> rows or None`` after the last.  With ``reach``, which left ``cell`` meets which right one, pieces
    are of neighbouring cells and right rows that none of them can need are left out.  With ``apart``, a column of the left matrix,
    pieces hold one value of it wherever a block has few of them.
    """
    both = dealt(lhs, rhs, block_rows, group, reach is not None)
    rows = block_rows if reach is None else min(block_rows, CELL_ROWS)

    def pieces(parts):
        """Pieces of a block, each with its state and the right cells it meets."""
        ids, m, cells = [i for part in parts for i in part[0]], np.concatenate([part[1] for part in parts]), np.concatenate([part[2] for part in parts])
        order, starts = np.argsort(cells, kind="stable"), np.arange(0, len(ids), rows)
        if apart is not None and len(ids) >= APART_ROWS * len(np.unique(m[:, apart])):
            order = np.lexsort((cells, m[:, apart]))
            runs = [0, *(np.flatnonzero(np.diff(m[order, apart])) + 1).tolist(), len(ids)]
            starts = np.concatenate([np.arange(first, last, rows) for first, last in zip(runs[:-1], runs[1:])])
        for at, to in zip(starts, [*starts[1:], len(ids)]):
            take = order[at:to]
            yield [None, ([ids[k] for k in take], m[take]), None if reach is None else reach[np.unique(cells[take])].any(axis=0)]

    def met(piece, side):
        """What a piece meets of some right rows, in their order."""
        ids, m, cells = side
        if piece[2] is not None:
            own = np.flatnonzero(piece[2][cells])
            ids, m = [ids[k] for k in own], m[own]
        width = max(1, SCORES // len(piece[1][0]))
        for at in range(0, len(ids), width):
            yield ids[at: at + width], m[at: at + width]

    def run(batches):
        key, block, held = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column("g").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy(), batch.column("side").to_numpy()]
            edges = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                part = batch.slice(first, last - first)
                own = (part.column("g")[0].as_py(), int(marks[1][first]))
                side = (part.column("id").to_pylist(), kernels.matrix(part.column("v"), unit), part.column("cell").to_numpy())
                if own != key:
                    yield from filter(None.__ne__, [end(state, left) for state, left, _ in block or []])
                    key, block, held = own, None, []
                if marks[2][first] == 0:
                    held.append(side)
                elif held:
                    block = [*pieces(held)] if block is None else block
                    for piece in block:
                        for right in met(piece, side):
                            piece[0], out = step(piece[0], piece[1], right)
                            if out is not None:
                                yield out
        yield from filter(None.__ne__, [end(state, left) for state, left, _ in block or []])

    return both.mapInArrow(run, schema)


def dealt(lhs: DataFrame, rhs: DataFrame, block_rows: int, group: str | None = None, cells: bool = False) -> DataFrame:
    """(g, block, side, id, v, cell) of both sides, each block in one partition and left rows (side 0) before right ones."""
    most = F.lit(max(HELD_ROWS, block_rows))

    def blocks(count: Column, total: Column) -> Column:
        shared = F.least(F.ceil(count / block_rows), F.ceil(count * SPREAD / F.greatest(total, F.lit(1))))
        return F.greatest(F.lit(1), F.ceil(count / most), shared)

    cell = F.col("cell") if cells else F.lit(0)
    if group is None:
        total = lhs.agg(F.count(F.lit(1))).scalar()
        a, b = (df.select(F.lit("").alias("g"), "id", "v", cell.alias("cell")).withColumn("n", blocks(total, total)) for df in (lhs, rhs))
    else:
        sizes = cut(lhs.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("rows")), "sizes")
        counts = sizes.select("g", blocks(F.col("rows"), sizes.agg(F.sum("rows")).scalar()).alias("n"))
        a, b = (df.select(F.col(group).alias("g"), "id", "v", cell.alias("cell")).join(counts, "g") for df in (lhs, rhs))
    both = a.select("g", F.pmod(F.xxhash64("id"), F.col("n")).alias("block"), F.lit(0).alias("side"), "id", "v", "cell").unionByName(
        b.select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("block"), F.lit(1).alias("side"), "id", "v", "cell"))
    return both.repartition("g", "block").sortWithinPartitions("g", "block", "side", "id")


def search(questions: DataFrame, embeddings: DataFrame, members: DataFrame, query: list[float], *,
           language: str | None = None, intents: list[str] | None = None, k: int = 10, floor: float = 0.0) -> DataFrame:
    """Top ``k`` questions for a query vector, with cluster; the score floor applies after the top k."""
    if language is not None:
        questions = questions.where(F.col("language") == language)
    if intents:
        questions = questions.where(F.col("intent").isin(intents))
    side = questions.select(F.col("id").alias("question_id"), "intent", "language")
    scored = side.join(embeddings.select("question_id", "vector"), "question_id").select(
        "question_id", "intent", "language",
        F.round(V.cosine(F.col("vector"), F.lit([float(x) for x in query])), 9).alias("score"))
    best = scored.orderBy(F.desc("score"), "question_id").limit(k)
    ranked = best.groupBy().agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("key"), "question_id", "intent", "language", "score"))).alias("hits")).select(
        F.posexplode("hits").alias("pos", "h"))
    hits = ranked.select((F.col("pos") + 1).cast("bigint").alias("rank"), "h.question_id", "h.intent", "h.language", "h.score")
    return hits.where(F.col("score") >= floor).join(members.select("question_id", "cluster_id"), "question_id", "left")


def cluster_neighbors(clusters: DataFrame, k: int) -> DataFrame:
    """``k`` nearest stable clusters of every cluster, itself excluded."""
    near = nearest(clusters, clusters.where("is_stable"), k, left_id="id", left_vector="centroid",
                   right_id="id", right_vector="centroid", skip_self=True)
    return near.select(F.col("left_id").alias("source"), F.col("right_id").alias("target"),
                       F.col("score").alias("cosine"), "position")


# --- centroids ------------------------------------------------------------------------
def vector_sums(df: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """Sum and count of unit vectors per group; partial sums combine before the shuffle."""
    summed = df.select(group, array_to_vector(V.unit(F.col(vector))).alias("_v")).groupBy(group).agg(
        Summarizer.metrics("sum", "count").summary(F.col("_v")).alias("_s"))
    return summed.select(group, vector_to_array("_s.sum").alias("total"), F.col("_s.count").alias("n"))


def centroids(df: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """Unit mean per group."""
    return vector_sums(df, group, vector).select(group, V.unit(F.col("total")).alias("centroid"), "n")


def update_centroids(clusters: DataFrame, additions: DataFrame) -> DataFrame:
    """Running mean of old centroid and new members, scaled to unit length.

    ``clusters``: id, centroid, frequency; ``additions``: cluster_id, vector.
    """
    sums = vector_sums(additions, "cluster_id").withColumnRenamed("cluster_id", "id").withColumnRenamed("n", "added")
    old = F.col("centroid")
    weight = F.greatest(F.lit(0), F.col("frequency"))
    joined = clusters.join(sums, "id", "left")
    fresh = (
        F.when(F.col("added").isNull(), old)
        .when(old.isNull() | (F.size(old) == 0), V.unit(F.col("total")))
        .otherwise(V.unit(F.zip_with(old, F.col("total"), lambda o, t: o * weight + t))))
    return joined.select("id", fresh.alias("centroid"),
                         (weight + F.coalesce("added", F.lit(0))).cast("bigint").alias("frequency"),
                         F.coalesce("added", F.lit(0)).cast("bigint").alias("added"))


def assign(embeddings: DataFrame, clusters: DataFrame, threshold: float = C.ASSIGN_THRESHOLD, **tuning) -> DataFrame:
    """Nearest stable cluster per new vector; below the threshold the cluster is null (deferred)."""
    near = nearest(embeddings, clusters.where("is_stable"), 1, right_id="id", right_vector="centroid", **tuning)
    side = near.select(F.col("left_id").alias("question_id"), "right_id", "score")
    accepted = F.col("score") >= threshold
    return embeddings.join(side, "question_id", "left").withColumn(
        "cluster_id", F.when(accepted, F.col("right_id"))).withColumnRenamed("score", "similarity").drop("right_id")


def reconcile(fresh: DataFrame, existing: DataFrame, threshold: float = C.MERGE_THRESHOLD) -> DataFrame:
    """Action rows for a batch result against the active clusters.

    ``fresh``: id, centroid, n.  A new cluster close to an existing centroid merges
    into it, others are created, existing clusters nobody merged into dissolve.
    """
    active = existing.where("is_stable")
    near = nearest(fresh, active, 1, left_id="id", left_vector="centroid", right_id="id", right_vector="centroid")
    best = near.select(F.col("left_id").alias("id"), "right_id", "score")
    merges = F.coalesce(F.col("score") >= threshold, F.lit(False))
    decided = fresh.join(best, "id", "left").select(
        F.when(merges, F.lit("merge")).otherwise(F.lit("create")).alias("action"),
        F.when(merges, F.col("right_id")).otherwise(F.concat(F.lit("new-"), F.col("id"))).alias("cluster_id"),
        F.col("id").alias("batch_label"), F.col("n").cast("bigint").alias("n_members"), F.col("score").alias("similarity"))
    touched = decided.where("action = 'merge'").select(F.col("cluster_id").alias("id"))
    gone = active.join(touched, "id", "left_anti").select(
        F.lit("dissolve").alias("action"), F.col("id").alias("cluster_id"), F.lit(None).cast("string").alias("batch_label"),
        F.lit(0).cast("bigint").alias("n_members"), F.lit(None).cast("double").alias("similarity"))
    return decided.unionByName(gone)


def silhouette(vectors: DataFrame, label: str) -> DataFrame:
    """Mean cosine silhouette and sample count, exact in one pass over cluster means.

    The mean cosine distance to a cluster is 1 - x . (mean of its unit vectors), so
    no pair of samples is ever formed.
    """
    sums = vector_sums(vectors, label)
    means = sums.select(F.col(label).alias("cluster"), F.transform("total", lambda t: t / F.col("n")).alias("mean"), "n")
    unit = vectors.select("question_id", F.col(label).alias("cluster"), V.unit(F.col("vector")).alias("vector"))
    near = nearest(unit, means, 2, right_id="cluster", right_vector="mean", unit=False)
    own = unit.join(means, "cluster").select(
        "question_id", "cluster", "n", (1.0 - V.dot(F.col("vector"), F.col("mean"))).alias("raw"))
    other = near.join(own.select(F.col("question_id").alias("left_id"), "cluster"), "left_id").where(
        F.col("right_id") != F.col("cluster")).groupBy(F.col("left_id").alias("question_id")).agg(
        F.max("score").alias("best"))
    a = F.col("raw") * F.col("n") / (F.col("n") - 1)
    b = 1.0 - F.col("best")
    value = F.when((F.col("n") <= 1) | F.col("best").isNull(), 0.0).otherwise(
        F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)))
    scored = own.join(other, "question_id", "left").select(
        F.when(F.col("n") <= 1, 0.0).otherwise(value).alias("s"), "cluster")
    return scored.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("silhouette"), F.count("*").alias("n_samples"))


# --- approximate search --------------------------------------------------------------------
def build_ivf(vectors: DataFrame, path: str, lists: int, seed: int = 7, part_rows: int = 65536) -> DataFrame:
    """Write vectors partitioned by coarse list; returns the list centres (id, centre, parts).

    A long list is dealt into parts of about ``part_rows``, so that a list with a third of all rows is many groups when it is searched.
    """
    from pyspark.ml.clustering import KMeans

    data = vectors.withColumn("features", array_to_vector(V.unit(F.col("vector"))))
    model = KMeans(k=lists, seed=seed, featuresCol="features", predictionCol="list", distanceMeasure="cosine", maxIter=10).fit(data)
    listed = model.transform(data).drop("features")
    parts = {r["list"]: -(-r["n"] // part_rows) for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    number = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(parts.items()) for x in pair]), F.col("list")) if parts else F.lit(1)
    listed.withColumn("part", F.pmod(F.xxhash64("question_id"), number)).write.partitionBy("list").mode("errorifexists").parquet(path)
    centres = [(str(i), [float(x) for x in c], int(parts.get(i, 0))) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(centres, "id string, centre array<double>, parts bigint")


def search_ivf(path: str, queries: DataFrame, centres: DataFrame, k: int, probes: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate top ``k`` per query: probe the nearest lists only, exact cosine inside them.

    Only the folders of probed lists are read (there are as many as the index has lists), and the queries of a list meet its parts as
    block products.
    """
    spark = queries.sparkSession
    side = _side(queries, "question_id", "vector")
    probed = nearest(queries, centres.where("parts > 0"), probes, right_id="id", right_vector="centre").select(
        F.col("left_id").alias("id"), F.col("right_id").alias("list"))
    probed = cut(probed.join(centres.select(F.col("id").alias("list"), "parts"), "list"), "probes")
    folders = [int(r["list"]) for r in probed.select("list").distinct().collect()]
    stored = spark.read.parquet(path).where(F.col("list").isin(folders))
    left = probed.join(side, "id").select("id", "v", "list", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    left = left.select("id", "v", F.concat_ws("/", "list", "part").alias("list"))
    right = stored.select(F.col("question_id").alias("id"), F.col("vector").cast("array<double>").alias("v"), F.concat_ws("/", "list", "part").alias("list"))
    return _first(_top_k(left, right, k, block_rows, True, True, "list"), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    """(query_id, question_id, score, position): the best ``k`` of what several groups found, each row once."""
    once = found.groupBy(F.col("left_id").alias("query_id"), F.col("right_id").alias("question_id")).agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("question_id"))
    return once.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= k)


def _signs(rows: DataFrame, planes: np.ndarray, flips: int) -> DataFrame:
    """(id, v, bucket): the bucket of a row in each table, and those that differ in one of its ``flips`` least certain bits."""
    tables, bits, _ = planes.shape

    def run(batches):
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = kernels.matrix(batch.column("v"))
            for t in range(tables):
                margin = m @ planes[t].T
                home = (margin >= 0) @ weight
                near = np.argsort(np.abs(margin), axis=1)[:, :flips]
                buckets = np.concatenate([home[:, None], home[:, None] ^ weight[near]], axis=1)
                names = [f"{t}/{b}" for b in buckets.ravel().tolist()]
                again = pa.array(np.repeat(np.arange(len(m)), buckets.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(again), batch.column("v").take(again), pa.array(names)], names=["id", "v", "bucket"])

    return rows.mapInArrow(run, "id string, v array<double>, bucket string")


def search_lsh(vectors: DataFrame, queries: DataFrame, k: int, tables: int = 12, bits: int = 8, flips: int = 4, seed: int = 7,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate top ``k`` of many queries at once: tables of random sign projections, joined on (table, bucket).

    A query also looks into the buckets across its least certain signs.  Queries that find fewer than ``k`` rows that way are searched
    exactly, so every query has ``k`` rows where there are as many.
    """
    stored, asked = _side(vectors, "question_id", "vector"), _side(queries, "question_id", "vector")
    size = asked.select(F.max(F.size("v"))).first()[0] or 1
    planes = np.random.default_rng(seed).normal(size=(tables, bits, size))
    probes = cut(_signs(asked, planes, flips), "probes")
    wanted = probes.select("bucket").distinct()
    inside = _signs(stored, planes, 0).join(wanted, "bucket", "left_semi")
    found = cut(_first(_top_k(probes, inside, k, block_rows, True, True, "bucket"), k), "found")
    full = found.where(F.col("position") == k).select(F.col("query_id").alias("question_id"))
    rest = nearest(queries.select("question_id", "vector").join(full, "question_id", "left_anti"), vectors, k, skip_self=True)
    return found.join(full.withColumnRenamed("question_id", "query_id"), "query_id", "left_semi").unionByName(rest.select(
        F.col("left_id").alias("query_id"), F.col("right_id").alias("question_id"), "score", "position"))


def recalled(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``found`` with ``recall``: the share of the exact neighbours (left_id, right_id) of all queries that it holds."""
    hits = exact.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("question_id")).join(
        found.select("query_id", "question_id", F.lit(1).alias("hit")), ["query_id", "question_id"], "left")
    share = hits.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall")).scalar()
    return found.withColumn("recall", share)


# --- embedding -----------------------------------------------------------------------------
def embed_misses(keys: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts with no stored vector under (key, model)."""
    stored = cache.where(F.col("model") == model).select("cache_key")
    return keys.join(stored, "cache_key", "left_anti")


def embed(keys: DataFrame, encoder, model: str, batch_rows: int = 512) -> DataFrame:
    """Vectors for the listed texts from a pluggable ``encoder(list[str]) -> (n, dim) array``.

    The encoder runs once per Arrow batch in the tasks; vectors come back at unit length.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                vectors = np.asarray(encoder(part.column("embed_text").to_pylist()), dtype=np.float64)
                vectors = vectors / np.clip(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12, None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cache_key"), pa.array([model] * part.num_rows, pa.string()),
                     pa.array([vectors.shape[1]] * part.num_rows, pa.int64()),
                     pa.array(list(vectors), pa.list_(pa.float64()))],
                    names=["cache_key", "model", "dim", "vector"])

    return keys.select("cache_key", "embed_text").mapInArrow(
        run, "cache_key string, model string, dim bigint, vector array<double>")


def hashing_encoder(dim: int = 64):
    """Offline stand-in encoder: hashed bag of words."""

    def encode(texts):
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                code = int(hashlib.md5(word.encode("utf-8"), usedforsecurity=False).hexdigest()[:8], 16)
                out[i, code % dim] += 1.0 if code & 0x10000 else -1.0
        return out

    return encode


def unit_column(c: Column) -> Column:
    return V.unit(c)
