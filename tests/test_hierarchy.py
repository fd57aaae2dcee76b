"""The density hierarchy against a plain top-down version over all pairs."""

import numpy as np
import pytest

from callweave.operators import hierarchy as H


def plain_clusters(m, min_size, min_samples):
    """Label per row (smallest index of its cluster, -1 for noise), from the components at every distance."""
    n = len(m)
    d = np.sqrt(np.maximum(0, 2 - 2 * np.round(m @ m.T, 9)))
    np.fill_diagonal(d, -1.0)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    np.fill_diagonal(d, 0.0)
    w = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    pairs = sorted((w[a, b], a, b) for a in range(n) for b in range(a))
    root, weights, levels = list(range(n)), [], []
    for weight, a, b in pairs:
        if root[a] != root[b]:
            if not weights or weights[-1] != weight:
                weights.append(weight)
                levels.append(None)
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
            levels[-1] = list(root)
    chosen = {}

    def judge(rows, k, birth):
        """(mass, clusters chosen within) of the cluster ``rows`` that is one component at level k and ended where density is ``birth``."""
        mass, whole = 0.0, list(rows)
        while True:
            density = 1 / max(weights[k], H.CLOSEST)
            parts = {}
            for r in rows:
                parts.setdefault(levels[k - 1][r] if k else r, []).append(r)
            big = [p for p in parts.values() if len(p) >= min_size]
            if len(big) == 1:
                mass += (len(rows) - len(big[0])) * (density - birth)
                rows, k = big[0], k - 1
                continue
            mass += len(rows) * (density - birth)
            below = [judge(p, k - 1, density) for p in big] if big else []
            inside = sum(x for x, _ in below)
            if mass >= inside:
                return mass, [whole]
            return inside, [c for _, x in below for c in x]

    # The cluster of everything counts from density 0 and is never chosen.
    rows, k = list(range(n)), len(weights) - 1
    while True:
        parts = {}
        for r in rows:
            parts.setdefault(levels[k - 1][r] if k else r, []).append(r)
        big = [p for p in parts.values() if len(p) >= min_size]
        if len(big) != 1:
            break
        rows, k = big[0], k - 1
    for p in big:
        for c in judge(p, k - 1, 1 / max(weights[k], H.CLOSEST))[1]:
            for r in c:
                chosen[r] = min(c)
    return [chosen.get(r, -1) for r in range(n)]


def nested(seed, n):
    """Groups of groups, copies, and strays."""
    rng = np.random.default_rng(seed)
    outer = rng.normal(size=(4, 10)) * 2
    inner = outer[rng.integers(0, 4, 9)] + rng.normal(size=(9, 10)) * 0.6
    m = inner[rng.integers(0, 9, n)] + rng.normal(size=(n, 10)) * rng.choice([0.08, 0.2], (n, 1))
    m[: n // 10] = rng.normal(size=(n // 10, 10))
    m[n // 3: n // 3 + 12] = m[n // 3]
    m[n // 2: n // 2 + 3] = m[n // 2]
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("seed,n,bucket,block", [(1, 500, None, 1024), (2, 120, 25, 30)])
def test_clusters_by_excess_of_mass(spark, seed, n, bucket, block):
    m = nested(seed, n)
    wanted = plain_clusters(m, 8, 4)
    df = spark.createDataFrame([(f"{k:05d}", [float(x) for x in r]) for k, r in enumerate(m)], "question_id string, vector array<double>").repartition(4)
    got = {r.question_id: r.cluster for r in H.density_tree(df, 8, 4, block, bucket).collect()}
    assert got == {f"{k:05d}": f"{c:05d}" if c >= 0 else "-1" for k, c in enumerate(wanted)} and len(set(wanted)) > 3


def test_few_vectors(spark):
    kind = "question_id string, vector array<double>"
    assert H.density_tree(spark.createDataFrame([], kind)).count() == 0
    one = H.density_tree(spark.createDataFrame([("a", [1.0, 0.0])], kind)).collect()
    assert [(r.question_id, r.cluster) for r in one] == [("a", "-1")]


def test_largest_component_is_not_searched(spark, monkeypatch):
    """Two groups far apart: when only they are left, the smaller one alone looks for the way to the other."""
    rng = np.random.default_rng(3)
    m = np.concatenate([np.eye(8)[0] + 0.05 * rng.standard_normal((60, 8)), np.eye(8)[1] + 0.05 * rng.standard_normal((20, 8))])
    df = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(m)], "question_id string, vector array<double>")
    searched, product = [], H.block_product

    def counted(left, right, *args, **kwargs):
        searched.append(left.count())
        return product(left, right, *args, **kwargs)

    monkeypatch.setattr(H, "block_product", counted)
    points, lists = H.neighbour_lists(H.distinct_vectors(df)[0], 3)
    tree = H.spanning_tree(points, lists).collect()
    assert searched and max(searched) <= 20
    rows = {r.a: (np.array(r.v), r.core) for r in points.collect()}
    names = sorted(rows)
    v, core = np.array([rows[a][0] for a in names]), np.array([rows[a][1] for a in names])
    w = np.maximum(np.maximum(core[:, None], core[None, :]), np.sqrt(np.maximum(0, 2 - 2 * np.round(v @ v.T, 9))))
    edges, up = [], list(range(len(names)))
    for x, lo, hi in sorted((w[i, j], i, j) for i in range(len(names)) for j in range(i + 1, len(names))):
        if up[lo] != up[hi]:
            up = [up[lo] if u == up[hi] else u for u in up]
            edges.append((round(x, 7), names[lo], names[hi]))
    assert sorted((round(r.w, 7), r.lo, r.hi) for r in tree) == sorted(edges)
