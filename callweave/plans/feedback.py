"""Feedback and maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import feedback as FB
from callweave.operators import merges as M
from callweave.plans.catalog import query
from callweave.plans.relational import r, ts_text
from callweave.plans.views import AS_OF


@query("v_feedback", """
select id, action, case action when 'merge_clusters' then 'merge' when 'split_cluster' then 'split' when 'relabel_intent' then 'relabel'
         when 'reassign_question' then 'reassign' when 'regenerate_faq' then 'canonicalize' end as task,
       case action when 'merge_clusters' then payload->>'target_id' when 'reassign_question' then payload->>'question_id'
         when 'split_cluster' then payload->>'cluster_id' when 'relabel_intent' then payload->>'cluster_id'
         when 'regenerate_faq' then payload->>'cluster_id' end as target,
       action in ('merge_clusters', 'split_cluster', 'relabel_intent', 'reassign_question', 'regenerate_faq') as is_accepted
from v_feedback""")
def fb_route(ws):
    return FB.route(ws["v_feedback"])


MERGED = """
ev as (select row_number() over (order by created_at, id) as n, payload->>'source_id' as source, payload->>'target_id' as target
       from v_feedback where action = 'merge_clusters'),
walk as (
  select id as start, id as cur, cast(0 as bigint) as n from v_clusters
  union all
  select w.start, case when w.cur = e.source then e.target else w.cur end, e.n from walk w join ev e on e.n = w.n + 1),
final as (select start, cur from walk where n = (select count(*) from ev)),
moved as (select m.question_id, m.cluster_id as old, f.cur as cluster_id from v_members m join final f on f.start = m.cluster_id)
"""


@query("v_feedback v_members v_clusters v_questions", MERGED + """
select m.question_id, m.cluster_id, q.human_override or m.old in (select source from ev union select target from ev) as human_override
from moved m join v_questions q on q.id = m.question_id""")
def fb_merge(ws):
    members, _, questions = FB.apply_merges(ws["v_feedback"], ws["v_members"], ws["v_clusters"], ws["v_questions"], AS_OF)
    side = questions.select(F.col("id").alias("question_id"), "human_override")
    return members.join(side, "question_id").select("question_id", "cluster_id", "human_override")


@query("v_feedback v_members v_clusters v_questions", MERGED + """
select c.id, c.is_stable and c.id not in (select source from ev) as is_stable, (select count(*) from moved m where m.cluster_id = c.id) as frequency
from v_clusters c""")
def fb_merge_clusters(ws):
    _, clusters, _ = FB.apply_merges(ws["v_feedback"], ws["v_members"], ws["v_clusters"], ws["v_questions"], AS_OF)
    return clusters.select("id", "is_stable", "frequency")


@query("v_feedback v_members v_planted", """
marked as (select distinct payload->>'cluster_id' as cluster_id from v_feedback where action = 'split_cluster'),
ins as (select m.question_id, m.cluster_id, p.vector from v_members m join v_planted p on p.question_id = m.question_id
        where m.cluster_id in (select cluster_id from marked)),
pairs as (select a.question_id as a, b.question_id as b from ins a join ins b on a.cluster_id = b.cluster_id
          and round(list_cosine_similarity(a.vector, b.vector), 9) >= 0.9),
core as (select a from pairs group by a having count(*) >= 4),
links as (select p.a, p.b from pairs p where p.a in (select a from core) and p.b in (select a from core)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
comp as (select a, min(b) as root from reach group by a),
big as (select root from comp group by root having count(*) >= 8)
select i.question_id, i.cluster_id, case when c.root in (select root from big) then i.cluster_id || '/' || c.root end as piece
from ins i left join comp c on c.a = i.question_id""")
def fb_split(ws):
    return FB.split_clusters(ws["v_feedback"], ws["v_members"], ws["v_planted"], 0.9)


RELABEL = """
rl as (select payload->>'cluster_id' as cluster_id, payload->>'intent' as intent, payload->>'label' as label, created_at, id
       from v_feedback where action = 'relabel_intent'),
li as (select cluster_id, intent from (select *, row_number() over (partition by cluster_id order by created_at desc, id desc) as rn from rl where intent is not null) x where rn = 1),
ll as (select cluster_id, label from (select *, row_number() over (partition by cluster_id order by created_at desc, id desc) as rn from rl where label is not null) x where rn = 1)
"""


@query("v_feedback v_members v_questions", RELABEL + """
select q.id, coalesce(li.intent, q.intent) as intent, q.human_override or li.intent is not null as human_override
from v_questions q left join v_members m on m.question_id = q.id left join li on li.cluster_id = m.cluster_id""")
def fb_relabel(ws):
    questions, _ = FB.apply_relabels(ws["v_feedback"], ws["v_members"], ws["v_clusters"], ws["v_questions"], AS_OF)
    return questions.select("id", "intent", "human_override")


@query("v_feedback v_clusters", RELABEL + f"""
select c.id, coalesce(ll.label, c.label) as label,
       strftime(case when ll.label is not null then timestamp '{AS_OF}' else c.last_updated end, '%Y-%m-%d %H:%M:%S') as last_updated
from v_clusters c left join ll on ll.cluster_id = c.id""")
def fb_relabel_clusters(ws):
    _, clusters = FB.apply_relabels(ws["v_feedback"], ws["v_members"], ws["v_clusters"], ws["v_questions"], AS_OF)
    return clusters.select("id", "label", ts_text("last_updated").alias("last_updated"))


@query("v_feedback v_members", """
ra as (select * from (select payload->>'question_id' as question_id, payload->>'cluster_id' as cluster_id, coalesce(cast(payload->>'similarity' as double), 1e0) as similarity,
         row_number() over (partition by payload->>'question_id' order by created_at desc, id desc) as rn
       from v_feedback where action = 'reassign_question') x where rn = 1)
select question_id, cluster_id, round(similarity, 6) as similarity from ra
union all select question_id, cluster_id, round(similarity, 6) from v_members where question_id not in (select question_id from ra)""")
def fb_reassign(ws):
    members, _ = FB.apply_reassigns(ws["v_feedback"], ws["v_members"], ws["v_questions"], AS_OF)
    return members.select("question_id", "cluster_id", r("similarity").alias("similarity"))


@query("v_calls v_questions v_embeddings v_members v_clusters", """
picked as (select id from v_calls where status in ('clustered', 'extraction_done', 'embedding_done')),
dq as (select id from v_questions where call_id in (select id from picked)),
left_members as (select * from v_members where question_id not in (select id from dq))
select 'calls' as table_name, count(*) filter (where status = 'diarization_done' or id in (select id from picked)) as n from v_calls
union all select 'questions', count(*) from v_questions where id not in (select id from dq)
union all select 'embeddings', count(*) from v_embeddings where question_id not in (select id from dq)
union all select 'members', count(*) from left_members
union all select 'clusters', count(*) from v_clusters where id in (select cluster_id from left_members)""")
def mnt_reextract(ws):
    tables = {n: ws[f"v_{n}"] for n in ("calls", "utterances", "questions", "embeddings", "members", "clusters")}
    after = FB.reextract(tables, ["clustered", "extraction_done", "embedding_done"], AS_OF)
    after["calls"] = after["calls"].where("status = 'diarization_done'")
    return M.table_counts(after)
