"""Vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import aggregates as A
from callweave.operators import density as D
from callweave.operators import hierarchy as HY
from callweave.operators import text as TX
from callweave.operators import vectors as VX
from callweave.plans.catalog import query
from callweave.plans.relational import r
from callweave.plans.text_jobs import EMBED_TEXTS
from callweave.session import scratch

RADIUS_COSINE = 0.8


def vec_text(c):
    """Vector as text of its rounded values, comparable across engines."""
    return F.array_join(F.transform(c, lambda x: F.format_string("%.4f", F.round(x, 4) + F.lit(0.0))), " ")


def vec_sql(c):
    return f"array_to_string(list_transform({c}, lambda x: printf('%.4f', round(x, 4) + 0e0)), ' ')"


@query("v_embeddings", """
select question_id, round(sqrt(list_dot_product(vector, vector)), 6) as norm,
       round(list_sum(list_transform(vector, lambda x: abs(x))) / sqrt(list_dot_product(vector, vector)), 6) as unit_l1
from v_embeddings""")
def vec_normalize(ws):
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x))
    return VX.normalized(ws["v_embeddings"]).select("question_id", r("norm").alias("norm"), r(size).alias("unit_l1"))


@query("v_embeddings", """
select a.question_id as a, b.question_id as b, round(list_cosine_similarity(a.vector, b.vector), 6) as cosine
from v_embeddings a join v_embeddings b on b.vec_id = a.vec_id + 1""")
def vec_pair_cosine(ws):
    pairs = ws["v_embeddings"].select(F.col("question_id").alias("a"), (F.col("vec_id") + 1).cast("string").alias("b"))
    return VX.pair_cosine(pairs, ws["v_embeddings"]).select("a", "b", r("cosine").alias("cosine"))


SEARCH = """
qv as (select vector as q from v_planted where question_id = '7'),
hits as (
  select * from (
    select qs.id as question_id, qs.intent, qs.language, round(list_cosine_similarity(p.vector, (select q from qv)), 9) as score,
           row_number() over (order by round(list_cosine_similarity(p.vector, (select q from qv)), 9) desc, qs.id) as rank
    from v_questions qs join v_planted p on p.question_id = qs.id where qs.language = 'en') s
  where rank <= 25 and score >= 0.3)
"""


def search_hits(ws):
    vector = ws["v_planted"].where("question_id = '7'").select("vector").first()["vector"]
    return VX.search(ws["v_questions"], ws["v_planted"], ws["v_members"], vector, language="en", k=25, floor=0.3)


@query("v_planted v_questions v_members", SEARCH + """
select h.question_id, h.intent, round(h.score, 6) as score, m.cluster_id, h.rank from hits h left join v_members m on m.question_id = h.question_id""")
def vec_search(ws):
    return search_hits(ws).select("question_id", "intent", r("score").alias("score"), "cluster_id", "rank")


@query("v_planted v_questions v_members", SEARCH + """,
j as (select h.*, m.cluster_id from hits h join v_members m on m.question_id = h.question_id),
i as (select cluster_id, intent, row_number() over (partition by cluster_id order by count(*) desc, min(rank)) as p from j group by 1, 2)
select j.cluster_id, count(*) as hit_count, round(max(score), 6) as max_score, round(avg(score), 6) as avg_score, max(i.intent) as top_intent
from j join i on i.cluster_id = j.cluster_id and i.p = 1 group by 1""")
def agg_search_clusters(ws):
    return A.search_clusters(search_hits(ws)).select(
        "cluster_id", "hit_count", r("max_score").alias("max_score"), r("avg_score").alias("avg_score"), "top_intent")


@query("v_embeddings v_planted", """
select question_id, neighbor_id, position, round(score, 6) as score from (
  select a.question_id, b.question_id as neighbor_id, round(list_cosine_similarity(a.vector, b.vector), 9) as score,
         row_number() over (partition by a.question_id order by round(list_cosine_similarity(a.vector, b.vector), 9) desc, b.question_id) as position
  from v_embeddings a join v_planted b on a.question_id <> b.question_id) x where position <= 3""")
def vec_knn_join(ws):
    near = VX.nearest(ws["v_embeddings"], ws["v_planted"], 3, skip_self=True, pruned=True)
    return near.select(F.col("left_id").alias("question_id"), F.col("right_id").alias("neighbor_id"), "position", r("score").alias("score"))


NEIGHBOURS = """
nb as (
  select * from (
    select a.id as source, b.id as target, round(list_cosine_similarity(a.centroid, b.centroid), 9) as cosine,
           row_number() over (partition by a.id order by round(list_cosine_similarity(a.centroid, b.centroid), 9) desc, b.id) as position
    from v_clusters a join v_clusters b on a.id <> b.id and b.is_stable) x where position <= {k})
"""


@query("v_clusters", NEIGHBOURS.format(k=4) + "select source, target, position, round(cosine, 6) as cosine from nb")
def vec_cluster_neighbors(ws):
    return VX.cluster_neighbors(ws["v_clusters"], 4).select("source", "target", "position", r("cosine").alias("cosine"))


@query("v_planted v_members", f"""
e as (select m.cluster_id, unnest(p.vector) as x, generate_subscripts(p.vector, 1) as pos from v_planted p join v_members m on m.question_id = p.question_id),
a as (select cluster_id, pos, avg(x) as v, count(*) as n from e group by 1, 2),
l as (select cluster_id, list(v order by pos) as m, max(n) as n from a group by 1)
select cluster_id, cast(n as bigint) as n, {vec_sql("list_transform(m, lambda x: x / sqrt(list_dot_product(m, m)))")} as centroid from l""")
def vec_centroids(ws):
    joined = ws["v_planted"].join(ws["v_members"].select("question_id", "cluster_id"), "question_id")
    return VX.centroids(joined, "cluster_id").select("cluster_id", "n", vec_text("centroid").alias("centroid"))


ASSIGNED = """
best as (
  select * from (
    select p.question_id, p.vector, c.id as cluster_id, round(list_cosine_similarity(p.vector, c.centroid), 9) as similarity,
           row_number() over (partition by p.question_id order by round(list_cosine_similarity(p.vector, c.centroid), 9) desc, c.id) as rn
    from v_planted p cross join v_clusters c where c.is_stable) x where rn = 1),
assigned as (select question_id, vector, case when similarity >= 0.78 then cluster_id end as cluster_id, similarity from best)
"""


@query("v_planted v_clusters", ASSIGNED + """,
s as (select cluster_id, pos, sum(x) as t, count(*) as n from (
  select cluster_id, unnest(vector) as x, generate_subscripts(vector, 1) as pos from assigned where cluster_id is not null) e group by 1, 2),
o as (select id, frequency, unnest(centroid) as x, generate_subscripts(centroid, 1) as pos from v_clusters),
u as (select o.id, o.frequency, coalesce(max(n), 0) as added, list(o.x * o.frequency + coalesce(t, 0) order by o.pos) as m, list(o.x order by o.pos) as old
      from o left join s on s.cluster_id = o.id and s.pos = o.pos group by 1, 2)
select id as cluster_id, cast(added as bigint) as added, cast(frequency + added as bigint) as frequency,
       """ + vec_sql("case when added = 0 then old else list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) end") + """ as centroid from u""")
def vec_update_centroid(ws):
    placed = VX.assign(ws["v_planted"], ws["v_clusters"]).where("cluster_id is not null")
    return VX.update_centroids(ws["v_clusters"], placed.select("cluster_id", "vector")).select(
        F.col("id").alias("cluster_id"), "added", "frequency", vec_text("centroid").alias("centroid"))


@query("v_planted v_clusters", ASSIGNED + "select question_id, cluster_id, round(similarity, 6) as similarity from assigned")
def vec_assign(ws):
    return VX.assign(ws["v_planted"], ws["v_clusters"]).select("question_id", "cluster_id", r("similarity").alias("similarity"))


DENSITY = """
pairs as (
  select a.question_id as a, b.question_id as b from v_planted a join v_planted b
  on round(list_cosine_similarity(a.vector, b.vector), 9) >= 0.8),
core as (select a from pairs group by a having count(*) >= 4),
links as (select p.a, p.b from pairs p where p.a in (select a from core) and p.b in (select a from core)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
comp as (select a, min(b) as root from reach group by a),
big as (select root from comp group by root having count(*) >= 8)
"""


@query("v_planted", DENSITY + """
select p.question_id, coalesce(c.root, '-1') as cluster from v_planted p
left join (select * from comp where root in (select root from big)) c on c.a = p.question_id""")
def vec_density_cluster(ws):
    return D.density_cluster(ws["v_planted"], RADIUS_COSINE)


def sweep_level(i: int, similarity: float) -> str:
    return f"""
pairs{i} as (
  select a.question_id as a, b.question_id as b from v_planted a join v_planted b
  on round(list_cosine_similarity(a.vector, b.vector), 9) >= {similarity}),
core{i} as (select a from pairs{i} group by a having count(*) >= 4),
links{i} as (select p.a, p.b from pairs{i} p where p.a in (select a from core{i}) and p.b in (select a from core{i})),
reach{i}(a, b) as (select a, b from links{i} union select r.a, l.b from reach{i} r join links{i} l on l.a = r.b),
comp{i} as (select a, min(b) as root from reach{i} group by a),
stage{i} as (select a as question_id, 'L{i}:' || root as node from comp{i} where root in (select root from comp{i} group by root having count(*) >= 8))"""


def sweep_own(i: int, grid: list[float]) -> str:
    inverse = [1.0 / (2 - 2 * s) ** 0.5 for s in grid] + [1.0 / 1e-3]
    return f"select node, count(*) * {min(inverse[i + 1], inverse[i] * 4) - inverse[i]!r} as own from stage{i} group by node"


def sweep_judged(i: int, grid: list[float]) -> str:
    return f"""
link{i} as (select distinct c.node, p.node as parent from stage{i + 1} c join stage{i} p on p.question_id = c.question_id),
below{i} as (select parent as node, count(*) as children, sum(mass) as mass_below, max(chain) as chain_below
             from judged{i + 1} j join link{i} l on l.node = j.node group by 1),
chained{i} as (select o.node, case when children = 1 then own + chain_below else own end as chain, coalesce(mass_below, 0) as mass_below
               from ({sweep_own(i, grid)}) o left join below{i} b on b.node = o.node),
judged{i} as (select node, greatest(chain, mass_below) as mass, chain, chain >= mass_below as keep from chained{i})"""


SWEEP = [0.7, 0.8, 0.88]


@query("v_planted", ",".join(sweep_level(i, s) for i, s in enumerate(SWEEP)) + f""",
judged2 as (select node, own as mass, own as chain, true as keep from ({sweep_own(2, SWEEP)}) o),""" + ",".join(sweep_judged(i, SWEEP) for i in (1, 0)) + """,
open1 as (select * from judged1 where node in (select node from link0 where parent in (select node from judged0 where not keep))),
open2 as (select * from judged2 where node in (select node from link1 where parent in (select node from open1 where not keep))),
placed as (select s.question_id, s.node from stage0 s join judged0 j on j.node = s.node and keep
           union all select s.question_id, s.node from stage1 s join open1 j on j.node = s.node and keep
           union all select s.question_id, s.node from stage2 s join open2 j on j.node = s.node and keep)
select v.question_id, coalesce(p.node, '-1') as cluster from v_planted v left join placed p on p.question_id = v.question_id""")
def vec_density_sweep(ws):
    return D.density_sweep(ws["v_planted"], SWEEP)


@query("v_planted v_clusters", """
e as (select label, unnest(vector) as x, generate_subscripts(vector, 1) as pos from v_planted),
a as (select label, pos, avg(x) as v, count(*) as n from e group by 1, 2),
fresh as (select cast(label as string) as id, list(v order by pos) as m, max(n) as n from a group by 1),
active as (select * from v_clusters where is_stable),
best as (select * from (
  select f.id, f.n, c.id as cid, round(list_cosine_similarity(f.m, c.centroid), 9) as score,
         row_number() over (partition by f.id order by round(list_cosine_similarity(f.m, c.centroid), 9) desc, c.id) as rn
  from fresh f cross join active c) x where rn = 1)
select case when score >= 0.9 then 'merge' else 'create' end as action, case when score >= 0.9 then cid else 'new-' || id end as cluster_id,
       id as batch_label, cast(n as bigint) as n_members, round(score, 6) as similarity from best
union all
select 'dissolve', id, null, 0, null from active where id not in (select cid from best where score >= 0.9)""")
def vec_reconcile(ws):
    fresh = VX.centroids(ws["v_planted"].withColumn("id", F.col("label").cast("string")), "id")
    return VX.reconcile(fresh, ws["v_clusters"]).select(
        "action", "cluster_id", "batch_label", "n_members", r("similarity").alias("similarity"))


@query("v_planted v_members", """
l as (select p.question_id, p.vector, m.cluster_id from v_planted p join v_members m on m.question_id = p.question_id),
d as (select a.question_id, a.cluster_id as own, b.cluster_id as other, sum(1 - list_cosine_similarity(a.vector, b.vector)) as s, count(*) as n
      from l a join l b on a.question_id <> b.question_id group by 1, 2, 3),
ab as (select question_id, max(case when own = other then s / n end) as a, min(case when own <> other then s / n end) as b from d group by 1)
select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette, count(*) as n_samples from ab""")
def vec_silhouette(ws):
    labelled = ws["v_planted"].join(ws["v_members"].select("question_id", "cluster_id"), "question_id")
    return VX.silhouette(labelled, "cluster_id").select(r("silhouette").alias("silhouette"), "n_samples")


@query("v_embeddings v_planted", """
select query_id, question_id, position, round(score, 6) as score from (
  select a.question_id as query_id, b.question_id, round(list_cosine_similarity(a.vector, b.vector), 9) as score,
         row_number() over (partition by a.question_id order by round(list_cosine_similarity(a.vector, b.vector), 9) desc, b.question_id) as position
  from v_embeddings a join v_planted b on a.question_id <> b.question_id) x where position <= 5""")
def vec_ann_ivf(ws):
    """All lists probed, which makes the answer exact."""
    path = scratch(ws.spark, "ivf")
    centres = VX.build_ivf(ws["v_planted"].select("question_id", "vector"), path, lists=12)
    queries = ws["v_embeddings"].select("question_id", "vector")
    return VX.search_ivf(path, queries, centres, k=5, probes=12).select("query_id", "question_id", F.col("position").cast("bigint").alias("position"), r("score").alias("score"))


def asked(ws):
    """The query set of the approximate searches: every vector whose id is divisible by 100, against all."""
    return ws["v_planted"].where("vec_id % 100 = 0").select("question_id", "vector"), ws["v_planted"].select("question_id", "vector")


@query("v_planted")
def vec_ann_ivf_recall(ws):
    """A third of the lists probed: ten neighbours of each query, and the share of the exact ones that all of them hold."""
    path = scratch(ws.spark, "ivf")
    queries, table = asked(ws)
    found = VX.search_ivf(path, queries, VX.build_ivf(table, path, lists=12), k=10, probes=4)
    return VX.recalled(found, VX.nearest(queries, table, 10, skip_self=True)).select("query_id", "question_id", "position", r("score").alias("score"), "recall")


@query("v_planted")
def vec_ann_lsh(ws):
    """Ten neighbours of each query from hashed buckets, and the share of the exact ones that all of them hold."""
    queries, table = asked(ws)
    found = VX.search_lsh(table, queries, 10)
    return VX.recalled(found, VX.nearest(queries, table, 10, skip_self=True)).select("query_id", "question_id", "position", r("score").alias("score"), "recall")


@query("v_planted")
def vec_density_tree(ws):
    """Clusters of the whole density hierarchy, no radius given."""
    return HY.density_tree(ws["v_planted"])


@query("v_questions", EMBED_TEXTS + """,
k as (select distinct embed_text, sha1(embed_text) as cache_key from texts),
w as (select cache_key, unnest(list_filter(string_split_regex(lower(embed_text), '\\s+'), lambda x: x <> '')) as word from k),
c as (select cache_key, ('0x' || substr(md5(word), 1, 8))::bigint as code from w),
s as (select cache_key, code % 64 as p, sum(case when (code >> 16) & 1 = 1 then 1e0 else -1e0 end) as x from c group by 1, 2),
g as (select cache_key, unnest(range(64)) as p from k),
m as (select g.cache_key, list(coalesce(x, 0e0) order by g.p) as v from g left join s on s.cache_key = g.cache_key and s.p = g.p group by 1)
select cache_key, 'hashing-64' as model, 64::bigint as dim, """ + vec_sql("list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))") + """ as vector from m""")
def vec_embed(ws):
    keys = TX.embed_keys(ws["v_questions"])
    return VX.embed(keys, VX.hashing_encoder(64), "hashing-64").select("cache_key", "model", "dim", vec_text("vector").alias("vector"))


@query("v_questions", EMBED_TEXTS + """,
keys as (select embed_text, sha1(embed_text) as cache_key, count(*) as n_questions from texts group by 1),
cache as (select distinct sha1(embed_text) as cache_key from texts where language = 'en')
select cache_key, n_questions from keys where cache_key not in (select cache_key from cache)""")
def vec_embed_misses(ws):
    keys = TX.embed_keys(ws["v_questions"])
    cached = TX.embed_keys(ws["v_questions"].where("language = 'en'")).select("cache_key", F.lit("m1").alias("model"))
    return VX.embed_misses(keys, cached, "m1").select("cache_key", "n_questions")
