"""Vectors, density, feedback, as-of lookups, merges, sources and streams against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.operators import aggregates as A
from callweave.operators import cover as CV
from callweave.operators import density as D
from callweave.operators import feedback as FB
from callweave.operators import merges as M
from callweave.operators import relational as R
from callweave.operators import vectors as VX
from callweave.operators.asof import asof
from callweave.session import FREE_SHUFFLES, cut, scratch
from callweave.sources import readers as RD
from callweave.sources import writers as WR
from callweave.streaming import jobs as ST

DAY = datetime(2024, 1, 1)


def table(spark, vectors, start=0):
    return spark.createDataFrame([(f"{start + i:04d}", [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 "question_id string, vector array<double>")


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def planted(rng, sizes, spread=0.08, dim=8):
    centres = unit(rng.normal(size=(len(sizes), dim)))
    return np.vstack([unit(c + spread * rng.normal(size=(n, dim))) for c, n in zip(centres, sizes)])


# --- vectors -----------------------------------------------------------------------
def test_zero_vector_stays_zero(spark):
    row = VX.normalized(table(spark, [[0.0, 0.0], [3.0, 4.0]])).orderBy("question_id").collect()
    assert row[0]["vector"] == [0.0, 0.0] and row[1]["vector"] == [0.6, 0.8] and row[1]["norm"] == 5.0


@pytest.mark.parametrize("limits", [{}, {"block_rows": 16}])
def test_nearest_equals_brute_force(spark, limits):
    rng = np.random.default_rng(1)
    left, right = unit(rng.normal(size=(40, 8))), unit(rng.normal(size=(70, 8)))
    right[7] = right[3]  # a tie: the smaller id comes first
    got = {}
    for r in VX.nearest(table(spark, left), table(spark, right), 4, **limits).collect():
        got.setdefault(r.left_id, {})[r.position] = r.right_id
    scores = np.round(left @ right.T, 9)
    for i in range(40):
        order = sorted(range(70), key=lambda j: (-scores[i, j], j))[:4]
        assert [got[f"{i:04d}"][p + 1] for p in range(4)] == [f"{j:04d}" for j in order]


def clusters(spark, centroids, frequency=2, stable=True):
    return spark.createDataFrame([(f"k{i}", [float(x) for x in c], frequency, stable) for i, c in enumerate(centroids)],
                                 "id string, centroid array<double>, frequency bigint, is_stable boolean")


def test_assign_threshold_and_cold_start(spark):
    vectors = table(spark, [[1, 0], [0.9, 0.1], [-1, 0]])
    got = {r.question_id: r.cluster_id for r in VX.assign(vectors, clusters(spark, [[1, 0], [0, 1]])).collect()}
    assert got == {"0000": "k0", "0001": "k0", "0002": None}
    none = VX.assign(vectors, clusters(spark, [[1, 0]], stable=False)).collect()
    assert [r.cluster_id for r in none] == [None] * 3


def test_running_centroid(spark):
    added = spark.createDataFrame([("k0", [0.0, 1.0]), ("k0", [0.0, 1.0])], "cluster_id string, vector array<double>")
    got = {r.id: r for r in VX.update_centroids(clusters(spark, [[1, 0], [0, 1]]), added).collect()}
    assert np.allclose(got["k0"].centroid, [0.5 ** 0.5] * 2) and got["k0"].frequency == 4
    assert got["k1"].centroid == [0.0, 1.0] and got["k1"].added == 0


def test_silhouette_equals_pairwise(spark):
    rng = np.random.default_rng(2)
    m, lab = planted(rng, [12, 9, 1]), ["a"] * 12 + ["b"] * 9 + ["c"]
    dist = 1 - m @ m.T
    values = []
    for i in range(len(m)):
        own = [dist[i, j] for j in range(len(m)) if lab[j] == lab[i] and j != i]
        if not own:
            values.append(0.0)
            continue
        b = min(np.mean([dist[i, j] for j in range(len(m)) if lab[j] == o]) for o in set(lab) - {lab[i]})
        values.append((b - np.mean(own)) / max(np.mean(own), b))
    df = spark.createDataFrame([(f"{i}", [float(x) for x in v], lab[i]) for i, v in enumerate(m)], "question_id string, vector array<double>, label string")
    row = VX.silhouette(df, "label").first()
    assert abs(row.silhouette - np.mean(values)) < 1e-9 and row.n_samples == 22
    assert VX.silhouette(df.where("label = 'a'"), "label").first().silhouette == 0.0


def brute_density(m, sim, min_size, min_samples):
    close = np.round(m @ m.T, 9) >= sim
    core = close.sum(axis=1) >= min_samples
    label, out = {}, ["-1"] * len(m)
    for i in range(len(m)):
        if core[i] and i not in label:
            stack, label[i] = [i], i
            while stack:
                for j in np.nonzero(close[stack.pop()] & core)[0]:
                    if j not in label:
                        label[j] = i
                        stack.append(j)
    for i, root in label.items():
        if sum(1 for r in label.values() if r == root) >= min_size:
            out[i] = f"{root:04d}"
    return out


@pytest.mark.parametrize("block_rows", [2048, 20])
def test_density_equals_brute_force_with_one_hot_group(spark, block_rows):
    rng = np.random.default_rng(4)
    m = np.vstack([planted(rng, [90, 30, 12, 5]), unit(rng.normal(size=(25, 8)))])
    m[:40] = m[0]  # copies
    got = {r.question_id: r.cluster for r in D.density_cluster(table(spark, m), 0.93, 8, 4, block_rows).collect()}
    assert [got[f"{i:04d}"] for i in range(len(m))] == brute_density(m, 0.93, 8, 4)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)]
    star = [("s00", f"s{i:02d}") for i in range(1, 40)]
    got = {r.id: r.root for r in D.components(spark.createDataFrame(chain + star, "a string, b string")).collect()}
    assert {got[f"{i:03d}"] for i in range(61)} == {"000"} and {got[f"s{i:02d}"] for i in range(40)} == {"s00"}


def test_sweep_finds_planted_groups(spark):
    rng = np.random.default_rng(6)
    m = planted(rng, [20, 20, 20], spread=0.05)
    got = {r.question_id: r.cluster for r in D.density_sweep(table(spark, m), [0.85, 0.95]).collect()}
    groups = [{got[f"{i:04d}"] for i in range(s, s + 20)} for s in (0, 20, 40)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and "-1" not in set.union(*groups)


def test_split_stays_inside_each_cluster(spark):
    rng = np.random.default_rng(8)
    m = planted(rng, [20], spread=0.03)
    members = spark.createDataFrame([(f"{i:04d}", "A" if i < 10 else "B") for i in range(20)], "question_id string, cluster_id string")
    log = spark.createDataFrame([("1", "split_cluster", '{"cluster_id":"A"}'), ("2", "split_cluster", '{"cluster_id":"B"}')],
                                "id string, action string, payload string")
    got = {r.question_id: r.piece for r in FB.split_clusters(log, members, table(spark, m), 0.9).collect()}
    assert {got[f"{i:04d}"] for i in range(10)} == {"A/0000"} and {got[f"{i:04d}"] for i in range(10, 20)} == {"B/0010"}


def test_ivf_recall(spark):
    rng = np.random.default_rng(9)
    m = planted(rng, [60] * 5, spread=0.2)
    data = table(spark, m)
    path = scratch(spark, "ivf-test")
    centres = VX.build_ivf(data, path, lists=6)
    got = VX.search_ivf(path, data, centres, k=5, probes=3).select("query_id", "question_id")
    exact = VX.nearest(data, data, 5, skip_self=True).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("question_id"))
    assert got.intersect(exact).count() / exact.count() >= 0.9


def exact_hits(m, found, k):
    """Share of the exact ``k`` neighbours that ``found`` rows (query_id, question_id) hold."""
    m = m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), 1e-12, None)
    scores = np.round(m @ m.T, 9)
    np.fill_diagonal(scores, -9)
    asked = {r.query_id for r in found}
    wanted = {(q, f"{j:04d}") for q in asked for j in np.lexsort((np.arange(len(m)), -scores[int(q)]))[:k]}
    return len(wanted & {(r.query_id, r.question_id) for r in found}) / len(wanted)


def test_lists_are_dealt_into_parts(spark):
    m = planted(np.random.default_rng(8), [60, 300, 40, 50], spread=0.2)
    data = table(spark, m)
    path = scratch(spark, "ivf-parts")
    centres = VX.build_ivf(data, path, lists=5, part_rows=32)
    assert max(r.parts for r in centres.collect()) > 4
    exact = VX.search_ivf(path, data, centres, k=6, probes=5, block_rows=16).collect()
    assert exact_hits(m, exact, 6) == 1 and len(exact) == 6 * len(m)
    some = VX.search_ivf(path, data.where("question_id < '0100'"), centres, k=6, probes=2).collect()
    assert exact_hits(m, some, 6) >= 0.9


def test_lsh_answers_every_query_in_full(spark):
    m = np.vstack([planted(np.random.default_rng(9), [80, 200, 60], spread=0.15), np.eye(8)[:3], np.zeros((1, 8)), np.ones((30, 8))])
    data = table(spark, m)
    found = VX.search_lsh(data, data, 5, block_rows=32).collect()
    assert len(found) == 5 * len(m) and {r.position for r in found} == {1, 2, 3, 4, 5}
    assert exact_hits(m, [r for r in found if int(r.query_id) < 340], 5) >= 0.9
    three = table(spark, m[:3])
    few = VX.search_lsh(three, three, 5).collect()
    assert len(few) == 6 and VX.search_lsh(data.limit(0), data, 5).count() == 0


# --- state -------------------------------------------------------------------------
@pytest.mark.parametrize("forward", [False, True])
def test_asof_equals_brute_force_on_one_hot_key(spark, forward):
    rng = random.Random(2)
    ev = [("k" if rng.random() < 0.8 else "z", DAY + timedelta(hours=rng.randint(0, 200)), f"e{i:03d}") for i in range(80)]
    lk = [("k" if rng.random() < 0.8 else "y", DAY + timedelta(hours=rng.randint(0, 200)), f"l{i:03d}") for i in range(80)]
    schema = "key string, ts timestamp_ntz, tie string"
    events = spark.createDataFrame(ev, schema).withColumn("value", F.col("tie"))
    got = {r.tie: r.found for r in asof(spark.createDataFrame(lk, schema), events, forward).collect()}
    for key, ts, tie in lk:
        side = [(t, n) for k, t, n in ev if k == key and ((t, n) > (ts, tie) if forward else (t, n) < (ts, tie))]
        assert got[tie] == ((min(side) if forward else max(side))[1] if side else None)


def test_merge_log_is_applied_in_order(spark):
    rng = random.Random(7)
    moves = [(f"{i:03d}", DAY + timedelta(hours=rng.randint(0, 100)), rng.choice("ABCDEFGH"), rng.choice("ABCDEFGH")) for i in range(60)]
    log = spark.createDataFrame([(i, t, "merge_clusters", f'{{"source_id":"{a}","target_id":"{b}"}}') for i, t, a, b in moves],
                                "id string, created_at timestamp_ntz, action string, payload string")
    got = {r.cluster_id: r.target_id for r in FB.merge_targets(log).collect()}
    place = {c: c for c in "ABCDEFGH"}
    for _, _, a, b in sorted(moves, key=lambda m: (m[1], m[0])):
        place = {c: b if at == a else at for c, at in place.items()}
    assert {c: got.get(c, c) for c in place} == place


def test_keyed_merge_is_idempotent(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    new = spark.createDataFrame([("2", "c"), ("3", "d")], "k string, v string")
    once = M.keyed_merge(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [("1", "a"), ("2", "c"), ("3", "d")]
    assert sorted(map(tuple, M.keyed_merge(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_json_member_keeps_the_others(spark):
    t = spark.createDataFrame([("1", '{"a":1,"analysis":{"x":0}}'), ("2", None), ("3", '{"b":2}')], "id string, metadata string")
    v = spark.createDataFrame([("1", '{"x":1}'), ("2", '{"x":2}')], "id string, document string")
    got = {r.id: r.metadata for r in M.set_json_member(t, v, "id", "metadata", "analysis").collect()}
    assert got == {"1": '{"a":1,"analysis":{"x":1}}', "2": '{"analysis":{"x":2}}', "3": '{"b":2}'}


def test_drift_order_and_floor(spark):
    as_of = "2024-01-31 00:00:00"
    rows = [("A", 25, 20)] * 4 + [("A", 1, 0)] * 16 + [("B", 30, 0)] * 5 + [("C", 30, 0)] * 2 + [("D", 30, 0)] * 6 + [("D", 1, 0)] * 3
    members = spark.createDataFrame([(f"{i}", c, datetime(2024, 1, d)) for i, (c, d, _) in enumerate(rows)],
                                    "question_id string, cluster_id string, assigned_at timestamp_ntz")
    names = spark.createDataFrame([(c, c) for c in "ABCD"], "id string, label string")
    got = [(r.cluster_id, r.recent_size, r.growth_rate) for r in A.drift(members, names, as_of).collect()]
    assert got == [("B", 5, 5.0), ("D", 6, 2.0), ("A", 4, 0.25)]


def test_questions_without_a_date_come_first(spark):
    df = spark.createDataFrame([("1", "c", DAY), ("2", "c", None), ("3", "b", DAY)], "id string, call_id string, extracted_at timestamp_ntz")
    assert [r.id for r in R.questions_in_order(df).collect()] == ["3", "2", "1"]


def test_overlap_needs_more_than_a_touch(spark):
    u = spark.createDataFrame([("u1", "c", 0.0, 10.0), ("u2", "c", 100.0, 130.0), ("u3", "c", 20.0, 30.0)],
                              "utterance_id string, call_id string, start_ts double, end_ts double").withColumn("speaker_id", F.lit(None).cast("string"))
    t = spark.createDataFrame([("c", 10.0, 20.0, "x"), ("c", 100.0, 110.0, "y"), ("c", 110.0, 120.0, "z"), ("c", 119.0, 125.0, "w")],
                              "call_id string, start double, stop double, speaker_id string")
    assert {r.utterance_id: r.speaker_id for r in R.assign_turns(u, t).collect()} == {"u1": None, "u2": "y", "u3": None}


# --- sources and sinks ----------------------------------------------------------------
def test_transcript_files_on_disk(spark, tmp_path):
    (tmp_path / "call_7.json").write_text('[{"speaker":"cust","start_ts":"1.5","text":" kya hua ","language":"HI"},{"text":""},"x",'
                                          '{"text":"ok","confidence":2},{"text":"hello","words":[{"w":1}]}]', encoding="utf-8")
    (tmp_path / "bad.json").write_text('{"turns": []}', encoding="utf-8")
    good, rejects = RD.read_transcripts(spark, str(tmp_path))
    rows = good.orderBy("idx").collect()
    assert [(r.call_id, r.speaker, r.start_ts, r.text, r.language, r.confidence) for r in rows] == [
        ("call_7", "CUSTOMER", 1.5, "kya hua", "hi", 1.0), ("call_7", "UNKNOWN", 0.0, "hello", "en", 1.0)]
    assert rows[1].words == '[{"w":1}]'
    assert sorted((r.call_id, r.reject) for r in rejects.collect()) == [
        ("bad", "not_a_list"), ("call_7", "bad_confidence"), ("call_7", "empty_text"), ("call_7", "not_an_object")]


def test_line_transcripts(spark, tmp_path):
    (tmp_path / "a_transcript.txt").write_text("AGENT [00:05]: hi: there\n\nCUSTOMER [01:10]: yes\n", encoding="utf-8")
    got = [(r.speaker, r.start_ts, r.end_ts, r.text) for r in RD.read_line_transcripts(spark, str(tmp_path)).orderBy("idx").collect()]
    assert got == [("AGENT", 5.0, 70.0, "hi: there"), ("CUSTOMER", 70.0, 70.0, "yes")]


def test_upload_listing(spark, tmp_path):
    for name, text in (("123.WAV", "x"), ("b.txt", "x"), ("12a.mp3", "x" * 20)):
        (tmp_path / name).write_text(text)
    listing = RD.file_listing(spark, str(tmp_path)).union(spark.createDataFrame([("up/a.json", 0)], "path string, length bigint"))
    got = {r["name"]: (r.is_transcript, r.recording_id, r.reason) for r in RD.classify_uploads(listing, most_bytes=10).collect()}
    assert got == {"123.WAV": (False, "123", None), "a.json": (True, None, "empty_file"), "b.txt": (None, None, "unsupported_media_type"),
                   "12a.mp3": (False, None, "file_too_large")}


def test_tables_are_plain_parquet(spark):
    root = scratch(spark, "store-test")
    WR.save_table(spark.range(3), root, "t")
    WR.save_table(spark.range(5), root, "t")
    assert WR.load_table(spark, root, "t").count() == 5 and spark.read.parquet(f"{root}/t").count() == 5


# --- streams ----------------------------------------------------------------------------
def stream_of(spark, df, files=3, per_batch=1):
    path = scratch(spark, "stream-test")
    df.repartition(files).write.parquet(path)
    return ST.file_stream(spark, path, df.schema, per_batch)


def test_first_request_wins_and_windows_reopen(spark):
    hour = lambda h: DAY + timedelta(hours=h)
    rows = [("r1", "in", hour(0), "k"), ("r2", "in", hour(5), "k"), ("r3", "in", hour(25), " k "), ("r4", "in", hour(30), "k"),
            ("r5", "in", hour(50), "k"), ("r6", "in", hour(1), None), ("r7", "in", hour(1), " "), ("r8", "in", hour(2), "x" * 129),
            ("r9", "out", hour(1), "k")]
    df = spark.createDataFrame(rows, "request_id string, route string, ts timestamp_ntz, key string")
    kept = ST.first_requests(df, df.limit(0))
    assert sorted(r.request_id for r in kept.collect()) == ["r1", "r3", "r5", "r6", "r7", "r8", "r9"]
    later = spark.createDataFrame([("s1", "in", hour(60), "k"), ("s2", "in", hour(75), "k")], df.schema)
    assert [r.request_id for r in ST.first_requests(later, kept.where("key is not null")).collect()] == ["s2"]


def test_status_stream_ignores_arrival_order(spark):
    rng = random.Random(4)
    rows = [(f"e{i:03d}", f"c{rng.randint(0, 5)}", DAY + timedelta(minutes=rng.randint(0, 500)), rng.choice("abc"), None) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id string, call_id string, ts timestamp_ntz, status string, error string")
    got = {r.call_id: r.event_id for r in ST.call_status(stream_of(spark, df), scratch(spark, "status"), scratch(spark, "status-check")).collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        want[r[1]] = r[0]
    assert got == want


def test_assign_stream_equals_batch(spark):
    rng = np.random.default_rng(12)
    vectors, known = table(spark, planted(rng, [20, 20])), clusters(spark, unit(rng.normal(size=(3, 8))))
    members, deferred = ST.assign_stream(stream_of(spark, vectors), lambda: known, scratch(spark, "assigned"), scratch(spark, "assigned-check"), 0.2)
    batch = VX.assign(vectors, known, 0.2)
    assert sorted(map(tuple, members.select("question_id", "cluster_id").collect())) == sorted(
        map(tuple, batch.where("cluster_id is not null").select("question_id", "cluster_id").collect()))
    assert deferred.count() == batch.where("cluster_id is null").count()


def test_native_dedupe_keeps_one_per_key(spark):
    rows = [(f"r{i}", "in", DAY + timedelta(minutes=i), f"k{i % 4}" if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "request_id string, route string, ts timestamp, key string")
    out = scratch(spark, "dedupe-test")
    ST.run_to_parquet(ST.dedupe_arrivals(stream_of(spark, df)), out, scratch(spark, "dedupe-check"))
    got = spark.read.parquet(out)
    assert got.where("key is null").count() == 8 and got.where("key is not null").count() == 4


def clustered(n, dim=12, centres=20, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 3
    rows = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.25
    rows[5], rows[6], rows[n // 2] = rows[4], 2 * rows[4], 0.0  # ties, and a vector without direction
    return [(f"v{k:05d}", [float(x) for x in r]) for k, r in enumerate(rows)]


@pytest.mark.parametrize("skip_self", [True, False])
def test_pruned_neighbours_are_the_nearest(spark, skip_self):
    left = spark.createDataFrame(clustered(400) + [("far", [1.0] + [0.0] * 11)], "question_id string, vector array<double>").repartition(3)
    right = spark.createDataFrame(clustered(700), "question_id string, vector array<double>").repartition(4)
    wanted = VX.nearest(left, right, 5, skip_self=skip_self)
    got = VX.nearest(left, right, 5, skip_self=skip_self, pruned=True, block_rows=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert VX.nearest(left, right.limit(0), 5, pruned=True).count() == 0 and VX.nearest(left.limit(0), right, 5, pruned=True).count() == 0


def test_pruned_neighbours_move_few_rows(spark):
    moved, scored = {}, {}
    for n in (500, 2000):
        df = spark.createDataFrame(clustered(n), "id string, v array<double>")
        over = CV.cover(df)
        side = CV.placed(df, over)
        stats = CV.cell_stats(side, over)
        rows = CV.sent(side, CV.reach_of_nearest(over, stats, stats, 4))
        moved[n] = rows.count()
        scored[n] = rows.join(side.groupBy("cell").count(), "cell").agg({"count": "sum"}).first()[0]
    assert all(scored[n] < 0.1 * n**2 for n in scored) and moved[2000] < 12 * moved[500], (moved, scored)


def test_density_clusters_by_cells(spark):
    rows = clustered(600)
    df = spark.createDataFrame(rows, "question_id string, vector array<double>")
    got = {r.question_id: r.cluster for r in D.density_cluster(df, 0.97, 8, 4).collect()}
    m = np.array([v for _, v in rows])
    m = m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), 1e-12, None)
    close = np.round(m @ m.T, 9) >= 0.97
    core = close.sum(axis=1) >= 4
    root = np.arange(len(m))
    for _ in range(len(m)):
        low = np.array([min(root[np.flatnonzero(close[k] & core)]) if core[k] else k for k in range(len(m))])
        if (low == root).all():
            break
        root = low
    sizes = np.bincount(root[core], minlength=len(m))
    wanted = {rows[k][0]: rows[root[k]][0] if core[k] and sizes[root[k]] >= 8 else "-1" for k in range(len(m))}
    assert got == wanted and len(set(wanted.values())) > 5


def test_order_statistics_without_a_buffer(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 1, 1, rng.randint(0, 50), None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = A.ranked_values(df, "v", "g").collect()
    for group in ("a", "b", None):
        wanted = sorted(v for g, v in rows if g == group and v is not None)
        held = [r for r in got if r.by == group]
        assert {r.total for r in held} == {len(wanted)}
        listed = [r.value for r in sorted(held, key=lambda r: r.first) for _ in range(r.last - r.first + 1)]
        assert listed == wanted
    for values in ([], [4], [4, 1], [3, 1, 1, 1, 9, 2, 2], list(range(10)), [7] * 20):
        row = A.size_stats(spark.createDataFrame([(v,) for v in values], "size long")).first()
        s, n = sorted(values), len(values)
        wanted = (n, s[0], s[-1], round(sum(s) / n, 2), (s[(n - 1) // 2] + s[n // 2]) / 2, s[(9 * n + 9) // 10 - 1]) if s else (0, 0, 0, 0.0, 0.0, 0)
        assert tuple(row) == wanted
    assert "percentile" not in A.size_stats(df.select(F.col("v").alias("size")))._jdf.queryExecution().executedPlan().toString()


def test_density_steps_hold_in_parts(spark):
    """Rows settled in their part, counted out, linked by pivots and linked across cells give the answer of all pairs."""
    rng = np.random.default_rng(31)
    chain = unit(np.c_[np.cos(np.linspace(0, 2.5, 60)), np.sin(np.linspace(0, 2.5, 60)), np.zeros((60, 6))])
    m = np.concatenate([planted(rng, [40, 30], 0.05), chain, unit(rng.normal(size=(50, 8))), np.zeros((2, 8))])
    df = table(spark, m).select(F.col("question_id").alias("id"), F.col("vector").alias("v"))
    ids = [r.id for r in df.collect()]
    vectors = np.array([r.v for r in df.collect()])
    near = np.round(vectors @ vectors.T, 9) >= 0.97
    dense = {i for i, n in zip(ids, near.sum(axis=1)) if n >= 4}
    assert {r.id for r in D.dense_rows(df, 0.97, 4, 16).collect()} == dense
    core = df.where(F.col("id").isin(sorted(dense)))
    linked = {r.id: r.root for r in D.components(D.linking_edges(core, 0.97, 16)).collect()}
    want = {i: i for i in dense}
    while True:
        again = {i: min(want[j] for j, ok in zip(ids, near[k]) if ok and j in dense) for k, i in enumerate(ids) if i in dense}
        if again == want:
            break
        want = again
    assert {i: linked.get(i, i) for i in dense} == want


def test_bundled_transcripts_equal_files(spark, tmp_path):
    texts = {"call_7": '[{"text":" kya\\nhua ","language":"HI"},{"text":""},"x"]', "call_8": '{"turns": []}', "call_9": "AGENT [00:05]: hi\nCUSTOMER [01:10]: yes"}
    (tmp_path / "files").mkdir()
    for name, text in texts.items():
        (tmp_path / "files" / f"{name}.txt").write_text(text, encoding="utf-8")
    bundle, files = str(tmp_path / "bundle"), str(tmp_path / "files")
    spark.createDataFrame(list(texts.items()), RD.BUNDLE).write.json(bundle)
    for one, other in zip(RD.read_transcripts(spark, bundle, bundled=True), RD.read_transcripts(spark, files)):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    lines, plain = RD.read_line_transcripts(spark, bundle, bundled=True), RD.read_line_transcripts(spark, files)
    assert sorted(map(str, lines.collect())) == sorted(map(str, plain.collect())) and lines.count() == 2
    out, check = scratch(spark, "bundled"), scratch(spark, "bundled-check")
    assert [ST.stream_transcripts(spark, bundle, out, check, bundled=True).count() for _ in range(2)] == [1, 1]


def test_right_rows_are_copied_for_whole_blocks_and_for_tracts_of_cells(spark, monkeypatch):
    """Copies of right rows follow what a task can hold, not pieces of a product or single cells."""
    rng = np.random.default_rng(12)
    left, right = (table(spark, rng.normal(size=(n, 6))) for n in (900, 300))
    sides = [VX._side(x, "question_id", "vector") for x in (left, right)]
    assert VX.dealt(*sides, 4).where("side = 1").count() <= 300 * VX.SPREAD
    over = CV.cover(sides[1])
    lhs, rhs = (CV.placed(x, over) for x in sides)
    stats = CV.cell_stats(lhs, over)
    tract = CV.neighbourhoods(over, stats, 300)
    reach = CV.reach_of_nearest(over, stats, CV.cell_stats(rhs, over), 4)
    a, b = CV.gathered(lhs, rhs, reach, tract)
    assert len(set(tract.tolist())) <= 3 < over.odd and a.count() == 900 and b.count() <= 300 * 3
    key = lambda df: sorted((r.left_id, r.position, r.right_id) for r in df.collect())
    exact = key(VX.nearest(left, right, 4))
    monkeypatch.setattr(VX, "HELD_ROWS", 60)
    monkeypatch.setattr(VX, "SPREAD", 2)
    assert key(VX.nearest(left, right, 4, block_rows=20)) == exact and VX.dealt(*sides, 20).where("side = 1").count() == 300 * 15
    assert key(VX.nearest(left, right, 4, block_rows=20, pruned=True)) == exact


def test_cut_leaves_no_shuffle_files(spark):
    def files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {str(f) for f in list(manager.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}

    before = files()
    kept = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    left = {f for f in files() - before if f.endswith(".data")}
    assert left == set() and kept.count() == 7 and spark.conf.get(FREE_SHUFFLES) == "false"


def test_neighbours_closer_than_single_precision_keep_their_order(spark):
    """More right rows than one rough product holds, with scores that differ in the eighth place, and a vector that is no number."""
    rng = np.random.default_rng(5)
    m = rng.standard_normal((5000, 8))
    m[::500] = np.eye(8)[0]
    m[::500, 1] = 1e-4 + 1e-6 * np.arange(10)
    rows = [(f"{i:05d}", [float(x) for x in v]) for i, v in enumerate(m)]
    right = spark.createDataFrame([*rows, ("none", [float("nan")] * 8)], "question_id string, vector array<double>").coalesce(1)
    left = spark.createDataFrame([*rows[:300:50], rows[4500]], "question_id string, vector array<double>")
    found = {}
    for r in VX.nearest(left, right, 6, skip_self=True).collect():
        found.setdefault(r.left_id, []).append((r.position, r.right_id, r.score))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for ident in found:
        scores = np.round(unit @ unit[int(ident)], 9)
        scores[int(ident)] = -np.inf
        want = sorted(range(len(m)), key=lambda k: (-scores[k], k))[:6]
        assert [x[1] for x in sorted(found[ident])] == [f"{k:05d}" for k in want]
        assert [x[2] for x in sorted(found[ident])] == pytest.approx([scores[k] for k in want], abs=1e-12)
    assert len(found) == 7
