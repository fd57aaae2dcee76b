"""Windowed choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import aggregates as A
from callweave.operators import calls as K
from callweave.operators import knowledge as G
from callweave.operators import text as TX
from callweave.operators import windows as WN
from callweave.plans.aggregates import RANKED, SCORED, STATS, WINNER_ORDER, _first
from callweave.plans.catalog import query
from callweave.plans.relational import r, resolved


@query("v_faqs", "select cluster_id, arg_max(id, version) as id, max(version) as version from v_faqs group by 1")
def win_latest_faq(ws):
    return A.latest_faq(ws["v_faqs"]).select("cluster_id", "id", "version")


@query("v_analyses v_cdr", RANKED + f"""
select phone_key as phone, call_id, disposition, sentiment from (
  select *, row_number() over (partition by phone_key order by {WINNER_ORDER}) as rn from ranked) x where rn = 1""")
def win_call_winner(ws):
    return K.call_winner(resolved(ws)).select("phone", "call_id", "disposition", "sentiment")


@query("v_analyses v_cdr", RANKED + f"""
select phone_key as phone, nullif({_first('full_name')}, '') as full_name, nullif({_first('email')}, '') as email,
       nullif({_first('income_band')}, '') as income_band from ranked group by 1""")
def win_first_non_null(ws):
    return K.first_filled(resolved(ws)).select("phone", "full_name", "email", "income_band")


PARITY = """
anchor as (
  select call_id, coalesce(min(idx) filter (where greeting), arg_max(idx, words * 1000 - idx)) as anchor from scored group by 1),
p as (select s.*, case when abs(s.idx - a.anchor) % 2 = 0 then 'AGENT' else 'CUSTOMER' end as base
      from scored s join anchor a on a.call_id = s.call_id),
parity as (select *, case when words >= 25 and base = 'CUSTOMER' then 'AGENT'
      when interrog >= 2 and words <= 30 and base = 'AGENT' then 'CUSTOMER' else base end as label from p)
"""


@query("v_utterances", SCORED + "," + PARITY + "select utterance_id, label as speaker from parity")
def win_speaker_parity(ws):
    return TX.label_by_parity(TX.scored(ws["v_utterances"])).select("utterance_id", "speaker")


@query("v_utterances", STATS + "," + PARITY + """,
agent as (select call_id, speaker_id as agent_id from (
  select *, row_number() over (partition by call_id order by round(score, 9) desc, speaker_id) as rn from rated) x where rn = 1)
select p.utterance_id, case when a.agent_id is null then p.label when p.speaker_id is null then 'UNKNOWN'
       when p.speaker_id = a.agent_id then 'AGENT' else 'CUSTOMER' end as speaker
from parity p left join agent a on a.call_id = p.call_id""")
def win_speaker_roles(ws):
    return TX.label_speakers(ws["v_utterances"]).select("utterance_id", "speaker")


@query("v_utterances", """
sized as (select call_id, idx, len(text) + len(speaker) + 10 as size,
                 row_number() over (partition by call_id order by idx) as n from v_utterances),
walk as (
  select call_id, idx, n, size as filled, 0 as chunk from sized where n = 1
  union all
  select s.call_id, s.idx, s.n, case when w.filled + s.size > 600 then s.size else w.filled + s.size end,
         case when w.filled + s.size > 600 then w.chunk + 1 else w.chunk end
  from walk w join sized s on s.call_id = w.call_id and s.n = w.n + 1)
select call_id, idx, cast(chunk as bigint) as chunk from walk""")
def win_turn_chunks(ws):
    return TX.turn_chunks(ws["v_utterances"], 600).select("call_id", "idx", "chunk")


CENTRAL = """
sims as (
  select m.cluster_id, m.question_id, round(list_cosine_similarity(p.vector, c.centroid), 9) as sim
  from v_members m join v_planted p on p.question_id = m.question_id join v_clusters c on c.id = m.cluster_id),
central as (
  select * from (select s.*, coalesce(nullif(q.normalized_text, ''), q.raw_text, '') as text,
    row_number() over (partition by s.cluster_id order by s.sim desc, len(coalesce(nullif(q.normalized_text, ''), q.raw_text, '')) desc, s.question_id) as position
    from sims s join v_questions q on q.id = s.question_id) x where position <= 12)
"""


@query("v_members v_planted v_clusters v_questions", CENTRAL + "select cluster_id, question_id, position from central")
def win_central_examples(ws):
    return WN.central_examples(ws["v_members"], ws["v_planted"], ws["v_clusters"], ws["v_questions"]).select(
        "cluster_id", "question_id", "position")


@query("v_members v_planted v_clusters v_questions", CENTRAL + """
select cluster_id, question_id, position from (
  select *, row_number() over (partition by cluster_id order by sim desc, question_id) as position from sims) x where position <= 6""")
def win_representatives(ws):
    return WN.representatives(ws["v_members"], ws["v_planted"], ws["v_clusters"]).select("cluster_id", "question_id", "position")


ACCEPT = """
shaped as (
  select source, target, cosine, has_relation, lower(trim(relation)) as relation, cached_at,
         greatest(0e0, least(1e0, coalesce(try_cast(weight as double), 0e0))) as weight,
         case when reason <> '' then trim(reason) end as reason from v_verdicts),
accepted as (
  select * from shaped where has_relation and weight >= 0.5 and source <> target
    and relation in ('leads_to', 'related_to', 'subset_of', 'opposes', 'caused_by', 'co_occurs', 'received_call',
      'handled_by', 'has_disposition', 'has_sentiment', 'about_product', 'interested_in', 'in_campaign', 'similar_to')),
capped as (select * from (
  select *, row_number() over (partition by source order by round(cosine, 9) desc, target) as position from accepted) x)
"""


@query("v_verdicts", ACCEPT + "select source, target, position from capped where position <= 3")
def win_edge_cap(ws):
    return WN.cap_edges(WN.accept_verdicts(ws["v_verdicts"]), 3).select("source", "target", "position")


@query("v_cdr", """
select crux_call_id, ordinal, caller_number from (
  select *, row_number() over (partition by crux_call_id order by ordinal desc) as rn from v_cdr) x where rn = 1""")
def win_last_wins(ws):
    return K.last_wins(ws["v_cdr"], "crux_call_id").select("crux_call_id", "ordinal", "caller_number")


NODE_NAMES = """
based as (select *, type || '-' || regexp_replace(regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as base from {source}),
named as (select *, case when row_number() over (partition by base order by id) = 1 then base
          else base || '-' || substr(sha1(type || '|' || id), 1, 6) end as name from based)
"""


@query("v_leads", """
prod as (select distinct 'product' as type,
         'product:' || PRODUCT_TYPE || case when ordinal % 4 < 2 then ' ' else '_' end || cast(ordinal // 4 % 40 as string) as id from v_leads),
""" + NODE_NAMES.format(source="prod") + "select id, name from named")
def win_name_collision(ws):
    raw = F.concat(F.lit("product:"), F.col("PRODUCT_TYPE"), F.when(F.col("ordinal") % 4 < 2, F.lit(" ")).otherwise(F.lit("_")),
                   (F.floor(F.col("ordinal") / 4) % 40).cast("string"))
    nodes = ws["v_leads"].select(raw.alias("id"), F.lit("product").alias("type")).distinct()
    return G.note_names(nodes).select("id", "name")


@query("v_edges", """
select source, target, relation, round(weight, 6) as weight, reason from (
  select *, row_number() over (partition by source, target, relation order by weight desc, batch) as rn from v_edges) x where rn = 1""")
def win_edge_best(ws):
    edges = ws["v_edges"].withColumn("seq", F.col("batch"))
    return G.merge_edges_by_weight(edges, ("source", "target", "relation")).select(
        "source", "target", "relation", r("weight").alias("weight"), "reason")
