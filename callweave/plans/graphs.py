"""Cluster graph and knowledge graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import graph as GR
from callweave.operators import knowledge as G
from callweave.operators import windows as WN
from callweave.plans.catalog import query
from callweave.plans.merges import KG_EDGES, KG_NODES, graph_calls
from callweave.plans.relational import r
from callweave.plans.vectors import NEIGHBOURS
from callweave.plans.windows import ACCEPT, NODE_NAMES  # noqa: F401
from callweave.session import cut


@query("v_clusters", NEIGHBOURS.format(k=8) + "select source, target, round(cosine, 6) as cosine from nb where cosine >= 0.05")
def graph_edge_candidates(ws):
    return GR.edge_candidates(ws["v_clusters"], 8, 0.05).select("source", "target", r("cosine").alias("cosine"))


@query("v_verdicts", ACCEPT + "select source, target, relation, round(weight, 6) as weight, reason from capped where position <= 6")
def graph_edge_accept(ws):
    return WN.cap_edges(WN.accept_verdicts(ws["v_verdicts"])).select("source", "target", "relation", r("weight").alias("weight"), "reason")


@query("v_edges v_clusters", """
kept as (select * from (select *, row_number() over (order by weight desc, source, target, relation) as rn
  from v_edges where weight >= 0.5) x where rn <= 5)
select id, frequency from v_clusters where id in (select source from kept union select target from kept)""")
def graph_memory_view(ws):
    nodes, _ = GR.memory_view(ws["v_clusters"], ws["v_edges"], 0.5, 5)
    return nodes.select("id", "frequency")


def kg_nodes(ws):
    return G.merge_nodes(G.call_nodes(graph_calls(ws)))


def kg_edges(ws):
    return G.merge_edges_by_weight(G.call_edges(graph_calls(ws)))


def kg_both(ws):
    """(nodes, edges) from one table of facts."""
    facts = cut(graph_calls(ws).select(*G.NEEDED), "facts")
    return G.merge_nodes(G.call_nodes(facts)), G.merge_edges_by_weight(G.call_edges(facts))


@query("v_analyses v_cdr v_leads", KG_NODES + "select id, type, label, attrs from nodes")
def graph_kg_nodes(ws):
    return kg_nodes(ws).select("id", "type", "label", G.attribute_text(F.col("attrs")).alias("attrs"))


@query("v_analyses v_cdr v_leads", KG_EDGES + "select src_id, src_type, dst_id, dst_type, relation, round(weight, 6) as weight, reason from edges")
def graph_kg_edges(ws):
    return kg_edges(ws).select("src_id", "src_type", "dst_id", "dst_type", "relation", r("weight").alias("weight"), "reason")


def slug_sql(c):
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled')"


RELATED = f"""
both_ways as (
  select src_id as node_id, 'out' as direction, relation, {slug_sql('dst_type')} || '-' || {slug_sql('dst_id')} as other, weight, reason, src_id, dst_id from edges
  union all
  select dst_id, 'in', relation, {slug_sql('src_type')} || '-' || {slug_sql('src_id')}, weight, reason, src_id, dst_id from edges where src_id <> dst_id),
related as (
  select node_id, direction, relation, other, regexp_replace(cast(weight as string), '\\.0$', '') as weight, coalesce(reason, '') as reason from (
    select *, row_number() over (partition by node_id, relation, other, direction order by src_id, dst_id) as rn from both_ways) x where rn = 1)
"""


@query("v_analyses v_cdr v_leads", KG_EDGES + "," + RELATED + "select node_id, direction, relation, other, weight, reason from related")
def graph_related(ws):
    return G.related(kg_edges(ws))


@query("v_members v_questions", """
visits as (
  select call_id, cluster_id, row_number() over (partition by call_id order by dated, moment, q) as o from (
    select q.call_id, m.cluster_id, 
           arg_min(q.extracted_at is not null, (q.extracted_at is not null, coalesce(q.extracted_at, timestamp '1970-01-01'), q.id)) as dated,
           arg_min(coalesce(q.extracted_at, timestamp '1970-01-01'), (q.extracted_at is not null, coalesce(q.extracted_at, timestamp '1970-01-01'), q.id)) as moment,
           arg_min(q.id, (q.extracted_at is not null, coalesce(q.extracted_at, timestamp '1970-01-01'), q.id)) as q
    from v_questions q join v_members m on m.question_id = q.id group by 1, 2) x),
n as (select cluster_id, count(*) as c from visits group by 1),
total as (select count(distinct call_id) as t from visits),
led as (select a.cluster_id as source, b.cluster_id as target, count(*) as support from visits a join visits b on a.call_id = b.call_id and a.o < b.o group by 1, 2),
met as (select least(source, target) as source, greatest(source, target) as target, cast(sum(support) as bigint) as support from led group by 1, 2),
u as (select 'leads_to' as relation, * from led union all select 'co_occurs', * from met)
select relation, source, target, support, round(support * t / (a.c * b.c), 6) as lift
from u join n a on a.cluster_id = source join n b on b.cluster_id = target cross join total""")
def graph_evidence(ws):
    return GR.evidence(ws["v_members"], ws["v_questions"]).select("relation", "source", "target", "support", r("lift").alias("lift"))
