"""Keyed merges and cascading deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import calls as K
from callweave.operators import knowledge as G
from callweave.operators import merges as M
from callweave.operators.relational import json_field
from callweave.plans.catalog import query
from callweave.plans.relational import LEADS, RESOLVED, r, ts_text
from callweave.plans.views import AS_OF
from callweave.session import cut

MOVES = f"""
updates as (select question_id, cast((vec_id + 1) % 9 as string) as cluster_id, 5e-1 as similarity, timestamp '{AS_OF}' as assigned_at
            from v_planted where label >= 6)
"""


def moves(ws):
    """A change batch: questions of three labels move and those without a cluster arrive."""
    return ws["v_planted"].where("label >= 6").select(
        "question_id", ((F.col("vec_id") + 1) % 9).cast("string").alias("cluster_id"), F.lit(0.5).alias("similarity"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("assigned_at"))


@query("v_planted v_members v_clusters", MOVES + """,
merged as (select * from v_members where question_id not in (select question_id from updates)
           union all select question_id, cluster_id, similarity, assigned_at from updates)
select question_id, cluster_id, round(similarity, 6) as similarity, strftime(assigned_at, '%Y-%m-%d %H:%M:%S') as assigned_at,
       (select count(*) from merged x where x.cluster_id = m.cluster_id) as frequency from merged m""")
def merge_members(ws):
    merged, clusters = M.merge_members(ws["v_members"], moves(ws), ws["v_clusters"])
    side = clusters.select(F.col("id").alias("cluster_id"), "frequency")
    return merged.join(side, "cluster_id").select(
        "question_id", "cluster_id", r("similarity").alias("similarity"), ts_text("assigned_at").alias("assigned_at"), "frequency")


@query("v_edges", """
select source, target, relation, weight, reason from v_edges where batch = 2
union all select source, target, relation, weight, reason from v_edges a where batch = 1
  and not exists (select 1 from v_edges b where b.batch = 2 and b.source = a.source and b.target = a.target and b.relation = a.relation)""")
def merge_edges(ws):
    edges = ws["v_edges"]
    return M.merge_edges(edges.where("batch = 1"), edges.where("batch = 2")).select("source", "target", "relation", "weight", "reason")


@query("v_clusters", """
select id, case when dominant_language = 'en' then 'fresh ' || id else label end as label,
       case when not is_stable then 'ta' else dominant_language end as dominant_language, frequency from v_clusters""")
def merge_partial_update(ws):
    changes = ws["v_clusters"].select(
        "id", F.when(F.col("dominant_language") == "en", F.concat(F.lit("fresh "), F.col("id"))).alias("label"),
        F.when(~F.col("is_stable"), F.lit("ta")).alias("dominant_language"))
    return M.partial_update(ws["v_clusters"], changes, "id").select("id", "label", "dominant_language", "frequency")


@query("v_calls v_stage_events", f"""
ch as (select * from (select *, row_number() over (partition by call_id order by ts desc, event_id desc) as rn from v_stage_events) x where rn = 1)
select c.id, coalesce(ch.status, c.status) as status,
       case when ch.call_id is not null then nullif(ch.error, '') else c.error_message end as error_message,
       strftime(case when ch.call_id is not null then timestamp '{AS_OF}' else c.updated_at end, '%Y-%m-%d %H:%M:%S') as updated_at
from v_calls c left join ch on ch.call_id = c.id""")
def merge_call_status(ws):
    changes = M.latest_per_key(ws["v_stage_events"], ["call_id"], ["ts", "event_id"]).withColumnRenamed("call_id", "id")
    return M.set_status(ws["v_calls"], changes, AS_OF).select("id", "status", "error_message", ts_text("updated_at").alias("updated_at"))


@query("v_calls v_analyses", """
select c.id, metadata->>'agent_id' as agent_id, metadata->'extra'->>'k' as extra_k, metadata->>'stt_provider' as stt_provider,
       a.disposition, a.phone as lead_phone
from v_calls c left join v_analyses a on a.call_id = c.id""")
def merge_json_set(ws):
    document = F.to_json(F.struct(
        F.struct("full_name", "phone", "email", "product_interest", "grounded_fields").alias("lead"),
        "disposition", "disposition_confidence", "sentiment", "sentiment_confidence", "escalation"))
    values = ws["v_analyses"].select(F.col("call_id").alias("id"), document.alias("document"))
    merged = M.set_json_member(ws["v_calls"], values, "id", "metadata", "analysis")
    return merged.select(
        "id", json_field("metadata", "agent_id").alias("agent_id"), json_field("metadata", "extra.k").alias("extra_k"),
        json_field("metadata", "stt_provider").alias("stt_provider"),
        json_field("metadata", "analysis.disposition").alias("disposition"),
        json_field("metadata", "analysis.lead.phone").alias("lead_phone"))


@query("v_clusters v_faqs", f"""
fresh as (select * from v_faqs where version = 2),
ch as (select cluster_id, substr(coalesce(nullif(canonical_question_en, ''), canonical_question), 1, 120) as l, canonical_question as q
       from fresh f where not exists (select 1 from v_faqs g where g.cluster_id = f.cluster_id and g.version > f.version))
select c.id, coalesce(l, label) as label, coalesce(q, canonical_question) as canonical_question,
       strftime(case when l is not null then timestamp '{AS_OF}' else last_updated end, '%Y-%m-%d %H:%M:%S') as last_updated
from v_clusters c left join ch on ch.cluster_id = c.id""")
def merge_faq_backfill(ws):
    faqs = ws["v_faqs"]
    _, clusters = M.backfill_faq_labels(ws["v_clusters"], faqs.where("version <> 2"), faqs.where("version = 2"), AS_OF)
    return clusters.select("id", "label", "canonical_question", ts_text("last_updated").alias("last_updated"))


KG_FACTS = RESOLVED + LEADS + """,
facts as (
  select r.*, coalesce(lead_nos, []) as lead_nos, coalesce(cdr_phone <> grounded_phone, false) as mismatch,
         list_filter(list_prepend(lower(trim(product_interest)), list_filter(coalesce(products, []), lambda p: p <> lower(trim(product_interest)))),
                     lambda p: p is not null) as products
  from resolved r left join lead_nos n on n.phone = r.join_phone left join lead_products p on p.phone = r.join_phone)
"""
NODE_CTES = """,
occ as (
  select call_id as seq, 'call:' || call_id as id, 'call' as type, 'Call ' || call_id as label,
         'call_date=' || call_date || ';escalation=' || cast(escalation as string) || case when mismatch then ';phone_mismatch=true' else '' end as attrs from facts
  union all
  select call_id, 'lead:' || join_phone, 'lead', coalesce(nullif(trim(full_name), ''), join_phone),
         'lead_nos=' || array_to_string(lead_nos, ', ') || ';matched=' || cast(len(lead_nos) > 0 as string) || ';phone=' || join_phone
  from facts where join_phone is not null
  union all select call_id, 'disposition:' || disposition, 'disposition', disposition, '' from facts where disposition is not null
  union all select call_id, 'sentiment:' || sentiment, 'sentiment', sentiment, '' from facts where sentiment is not null
  union all select call_id, 'agent:' || agent_id, 'agent', agent_id, '' from facts where agent_id is not null
  union all select call_id, 'campaign:' || campaign, 'campaign', campaign, '' from facts where campaign is not null
  union all select seq, 'product:' || p, 'product', p, '' from (select call_id as seq, unnest(products) as p from facts) u),
nodes as (select id, type, label, attrs from (select *, row_number() over (partition by id order by seq) as rn from occ) x where rn = 1)
"""
KG_NODES = KG_FACTS + NODE_CTES
KG_EDGES = KG_FACTS + """,
pr as (select call_id, join_phone, unnest(products) as p from facts),
eocc as (
  select call_id as seq, 'lead:' || join_phone as src_id, 'lead' as src_type, 'call:' || call_id as dst_id, 'call' as dst_type,
         'received_call' as relation, 1e0 as weight, cast(null as string) as reason from facts where join_phone is not null
  union all select call_id, 'call:' || call_id, 'call', 'disposition:' || disposition, 'disposition', 'has_disposition',
         greatest(0, least(1, disposition_confidence)), disposition_rationale from facts where disposition is not null
  union all select call_id, 'call:' || call_id, 'call', 'sentiment:' || sentiment, 'sentiment', 'has_sentiment',
         greatest(0, least(1, sentiment_confidence)), null from facts where sentiment is not null
  union all select call_id, 'call:' || call_id, 'call', 'agent:' || agent_id, 'agent', 'handled_by', 1e0, null from facts where agent_id is not null
  union all select call_id, 'lead:' || join_phone, 'lead', 'campaign:' || campaign, 'campaign', 'in_campaign', 1e0, null
         from facts where join_phone is not null and campaign is not null
  union all select call_id, 'call:' || call_id, 'call', 'product:' || p, 'product', 'about_product', 1e0, null from pr
  union all select call_id, 'lead:' || join_phone, 'lead', 'product:' || p, 'product', 'interested_in', 1e0, null from pr where join_phone is not null),
edges as (select src_id, src_type, dst_id, dst_type, relation, weight, reason from (
  select *, row_number() over (partition by src_id, dst_id, relation order by weight desc, seq) as rn from eocc) x where rn = 1)
"""


def graph_calls(ws):
    cdr = K.conform_cdr(ws["v_cdr"]).drop("started_at", "direction")  # no part of the graph: not parsed
    return K.match_leads(K.with_join_phone(K.calls_with_cdr(ws["v_analyses"], cdr)), ws["v_leads"])


@query("v_analyses v_cdr v_leads", KG_NODES + "select id, type, label, attrs from nodes")
def merge_graphs(ws):
    calls = cut(graph_calls(ws), "facts")
    first, second = calls.where("has_cdr"), calls.where("not has_cdr")
    nodes = G.merge_nodes(G.call_nodes(first.unionByName(second).unionByName(first)))
    return nodes.select("id", "type", "label", G.attribute_text(F.col("attrs")).alias("attrs"))


@query("v_calls v_utterances v_questions v_embeddings v_members", """
doomed as (select id as call_id from v_calls where status in ('failed', 'pending')),
dq as (select id as question_id from v_questions where call_id in (select call_id from doomed))
select 'calls' as table_name, id as row_key, count(*) as n from v_calls where id not in (select call_id from doomed) group by 2
union all select 'utterances', utterance_id, count(*) from v_utterances where call_id not in (select call_id from doomed) group by 2
union all select 'questions', id, count(*) from v_questions where call_id not in (select call_id from doomed) group by 2
union all select 'embeddings', question_id, count(*) from v_embeddings where question_id not in (select question_id from dq) group by 2
union all select 'members', question_id, count(*) from v_members where question_id not in (select question_id from dq) group by 2""")
def set_cascade_delete(ws):
    tables = {n: ws[f"v_{n}"] for n in ("calls", "utterances", "questions", "embeddings", "members")}
    doomed = ws["v_calls"].where(F.col("status").isin("failed", "pending"))
    keys = {"calls": "id", "utterances": "utterance_id", "questions": "id", "embeddings": "question_id", "members": "question_id"}
    return M.table_keys(M.cascade_delete(tables, doomed), keys)
