"""Filters, joins, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import calls as K
from callweave.operators import relational as R
from callweave.operators import text as TX
from callweave.plans import pii_sql
from callweave.plans.catalog import query
from callweave.plans.views import AS_OF

R6 = 6


def r(c):
    return F.round(F.col(c) if isinstance(c, str) else c, R6)


def ts_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- filters -------------------------------------------------------------------
@query("v_calls", """
select id, metadata->>'agent_id' as agent_id, metadata->>'customer_id' as customer_id
from v_calls
where id ilike '%aG1%' or metadata->>'agent_id' ilike '%aG1%' or metadata->>'customer_id' ilike '%aG1%'""")
def flt_call_search(ws):
    return R.search_calls(ws["v_calls"], "aG1").select("id", "agent_id", "customer_id")


@query("v_calls v_docs_pii", pii_sql.hits() + """
, totals as (select doc_id, count(*) as n from hits group by doc_id)
select id, coalesce(n, 0) as violation_count from v_calls left join totals on doc_id = id where coalesce(n, 0) > 0""")
def flt_call_flagged(ws):
    hits = TX.pii_hits(ws["v_docs_pii"], "doc_id", "text")
    return R.flag_calls(ws["v_calls"], hits, "flagged").select("id", "violation_count")


@query("v_questions", """
select id, call_id, intent, language from (
  select *, row_number() over (order by extracted_at desc nulls last, id) as rn
  from v_questions where language = 'en') q where rn > 10 and rn <= 60""")
def flt_questions(ws):
    found = R.list_questions(ws["v_questions"], language="en", limit=50, offset=10)
    return found.select("id", "call_id", "intent", "language")


@query("v_utterances", """
select call_id, speaker, text, start_ts, end_ts from v_utterances""")
def prj_transcript(ws):
    return R.transcript(ws["v_utterances"])


@query("v_calls", """
select id, status from v_calls where status in ('clustered', 'extraction_done', 'embedding_done')""")
def flt_status_in(ws):
    return R.calls_in_status(ws["v_calls"], ["clustered", "extraction_done", "embedding_done"]).select(
        "id", "status")


@query("v_clusters", """
select id, canonical_question from (
  select *, row_number() over (order by frequency desc, id) as rn from v_clusters
  where contains(lower(canonical_question), 'claim')) c where rn <= 20""")
def flt_clusters_text(ws):
    return R.search_clusters(ws["v_clusters"], "Claim", limit=20).select("id", "canonical_question")


@query("v_questions", """
select id, substr(coalesce(nullif(english_gloss, ''), nullif(normalized_text, ''), ''), 1, 120) as gloss from v_questions""")
def prj_gloss(ws):
    return ws["v_questions"].select("id", R.gloss(120).alias("gloss"))


@query("v_calls", """
select id, duration_seconds, bucket from v_calls where duration_seconds >= 4 and bucket in ('0-5s', '15-30s')""")
def flt_duration_slice(ws):
    return R.duration_slice(ws["v_calls"], 4.0, ["0-5s", "15-30s"]).select("id", "duration_seconds", "bucket")


@query("v_edges", """
select source, target, relation, weight from (
  select *, row_number() over (order by weight desc, source, target, relation) as rn
  from v_edges where weight >= 0.5) e where rn <= 12""")
def flt_edges_weight(ws):
    return R.heaviest_edges(ws["v_edges"], 0.5, 12).select("source", "target", "relation", "weight")


# --- joins -----------------------------------------------------------------------
@query("v_questions v_embeddings", """
select q.id as question_id, q.call_id, len(e.vector) as dim, round(e.vector[1], 6) as first_value
from v_questions q join v_embeddings e on e.question_id = q.id""")
def join_question_embedding(ws):
    return R.questions_with_vectors(ws["v_questions"], ws["v_embeddings"]).select(
        "question_id", "call_id", F.size("vector").cast("bigint").alias("dim"), r(F.col("vector")[0]).alias("first_value"))


@query("v_questions v_members", """
select q.id as question_id, m.cluster_id from v_questions q left join v_members m on m.question_id = q.id""")
def join_question_cluster(ws):
    return R.questions_with_cluster(ws["v_questions"], ws["v_members"]).select("question_id", "cluster_id")


@query("v_questions v_members", """
select cluster_id, question_id, position, round(similarity, 6) as similarity from (
  select m.cluster_id, m.question_id, m.similarity,
         row_number() over (partition by m.cluster_id order by round(m.similarity, 9) desc, m.question_id) as position
  from v_members m join v_questions q on q.id = m.question_id) x where position <= 10""")
def join_cluster_examples(ws):
    return R.cluster_examples(ws["v_members"], ws["v_questions"], 10).select(
        "cluster_id", "question_id", "position", r("similarity").alias("similarity"))


@query("v_faqs v_clusters", """
select id, cluster_id, frequency from (
  select f.id, f.cluster_id, c.frequency, row_number() over (order by c.frequency desc, f.id) as rn
  from v_faqs f join v_clusters c on c.id = f.cluster_id
  where f.language = 'en' and list_contains(c.dominant_intents, 'renewal')) x where rn <= 50""")
def join_faq_cluster(ws):
    return R.list_faqs(ws["v_faqs"], ws["v_clusters"], language="en", intent="renewal", limit=50).select(
        "id", "cluster_id", "frequency")


CLEAN = """
clean_cdr as (
  select crux_call_id, ordinal,
         nullif(case when upper(trim(agent_id)) in ('', 'NA') then '' else trim(agent_id) end, '') as agent_id,
         trim(campaign) as campaign, trim(start_time) as start_text, lower(trim(direction)) as token,
         case when upper(trim(caller_number)) in ('', 'NA') then null
              else regexp_replace(regexp_replace(trim(caller_number), '\\.0$', ''), '[^0-9]', '', 'g') end as digits
  from v_cdr),
cdr as (
  select crux_call_id, ordinal, agent_id, campaign, start_text,
         case when token in ('in', 'inbound', 'mt') then 'inbound'
              when token in ('out', 'outbound', 'mo') then 'outbound' else 'unknown' end as direction,
         case when regexp_full_match(d, '[6-9][0-9]{9}') then d end as caller_phone,
         coalesce(try_strptime(start_text, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d',
             '%d-%m-%Y %H:%M:%S', '%d/%m/%Y %H:%M:%S', '%d-%m-%Y', '%d/%m/%Y'])) as started_at
  from (select *, case when len(digits) = 12 and digits like '91%' then substr(digits, 3)
                       when len(digits) = 11 and digits like '0%' then substr(digits, 2) else digits end as d
        from clean_cdr) x),
last_cdr as (select * exclude (rn) from (
  select *, row_number() over (partition by crux_call_id order by ordinal desc) as rn from cdr) x where rn = 1)
"""
RESOLVED = CLEAN + """,
resolved as (
  select a.*, c.crux_call_id is not null as has_cdr, c.agent_id, c.campaign, c.started_at, c.direction,
         c.caller_phone as cdr_phone,
         case when list_contains(a.grounded_fields, 'phone') then a.phone end as grounded_phone,
         coalesce(c.caller_phone, case when list_contains(a.grounded_fields, 'phone') then a.phone end) as join_phone
  from v_analyses a left join last_cdr c on c.crux_call_id = a.call_id)
"""


@query("v_analyses v_cdr", RESOLVED + """
select call_id, has_cdr, cdr_phone as caller_phone, agent_id, campaign,
       strftime(started_at, '%Y-%m-%d %H:%M:%S') as started_at, direction from resolved""")
def join_calls_cdr(ws):
    return K.calls_with_cdr(ws["v_analyses"], K.conform_cdr(ws["v_cdr"])).select(
        "call_id", "has_cdr", "caller_phone", "agent_id", "campaign", ts_text("started_at").alias("started_at"),
        "direction")


def resolved(ws):
    return K.with_join_phone(K.calls_with_cdr(ws["v_analyses"], K.conform_cdr(ws["v_cdr"])))


LEADS = """,
lead_base as (
  select case when len(MOBILE_NO) = 11 then substr(MOBILE_NO, 2) else MOBILE_NO end as phone, ordinal,
         nullif(LEAD_NO, 'NA') as lead_no, lower(trim(PRODUCT_TYPE)) as product from v_leads),
lead_nos as (select phone, list(lead_no order by o) as lead_nos from (
  select phone, lead_no, min(ordinal) as o from lead_base where lead_no is not null group by all) x group by phone),
lead_products as (select phone, list(product order by o) as products from (
  select phone, product, min(ordinal) as o from lead_base where product is not null group by all) x group by phone)
"""


@query("v_analyses v_cdr v_leads", RESOLVED + LEADS + """
select call_id, join_phone, coalesce(array_to_string(lead_nos, ','), '') as lead_nos,
       coalesce(array_to_string(products, ','), '') as products
from resolved left join lead_nos n on n.phone = join_phone left join lead_products p on p.phone = join_phone""")
def join_calls_leads(ws):
    return K.match_leads(resolved(ws), ws["v_leads"]).select(
        "call_id", "join_phone", F.array_join("lead_nos", ",").alias("lead_nos"),
        F.array_join("products", ",").alias("products"))


@query("v_lms", """
select call_id, coalesce(case lower(trim(lms_text))
   when 'ringing' then 'no_response' when 'call not connected/beep tone' then 'no_response'
   when 'ivr tone' then 'no_response' when 'short hang up' then 'no_response'
   when 'call back - ringing' then 'no_response' when 'call back later' then 'callback_requested'
   when 'buy later' then 'callback_requested' when 'just browsing' then 'not_interested'
   when 'ni - due to service' then 'not_interested' when 'ni - due to product' then 'not_interested'
   when 'ni - due to price' then 'not_interested' when 'ni - need offline policy' then 'not_interested'
   when 'ne - ne due to income' then 'not_eligible'
   when 'ne - ne due to documents not avaible(education)' then 'not_eligible'
   when 'ne - ne due to documents not avaible' then 'not_eligible'
   when 'ne - ne due to medical history' then 'not_eligible'
   when 'nw - incorrect request' then 'wrong_number' when 'incorrect request' then 'wrong_number'
   when 'nw - never left name and number' then 'wrong_number'
   when 'never left name and number' then 'wrong_number' when 'nw - dnc' then 'dnd'
   when 'nw - service request' then 'service_request'
   when 'nw - duplicate sale closed(already assisted)' then 'service_request'
   when 'follow up for payment' then 'follow_up_payment'
   when 'looking for other product(health or loan)' then 'not_interested'
   when 'loan requirement' then 'not_interested' end, 'other') as disposition
from v_lms""")
def join_crosswalk(ws):
    return K.map_lms(ws["v_lms"], "lms_text").select("call_id", "disposition")


@query("v_questions v_members", """
select id, intent from v_questions where id in (select question_id from v_members where cluster_id in ('1', '3', '5'))""")
def join_semi_members(ws):
    return R.questions_of_clusters(ws["v_questions"], ws["v_members"], ["1", "3", "5"]).select("id", "intent")


@query("v_clusters v_members", """
select id, frequency from v_clusters where id not in (select cluster_id from v_members)""")
def join_anti_empty_clusters(ws):
    return R.empty_clusters(ws["v_clusters"], ws["v_members"]).select("id", "frequency")


@query("v_calls v_stage_events", """
select id from v_calls where id not in (select call_id from v_stage_events where stage = 'embed')""")
def join_anti_pending(ws):
    done = ws["v_stage_events"].where("stage = 'embed'")
    return R.pending(ws["v_calls"], done, "id", "call_id").select("id")


@query("v_faqs", """
select f.id, f.cluster_id, f.version from v_faqs f
where not exists (select 1 from v_faqs g where g.cluster_id = f.cluster_id and g.version > f.version)""")
def join_not_newer(ws):
    return R.not_superseded(ws["v_faqs"], "cluster_id", "version").select("id", "cluster_id", "version")


BARS = """
spans as (select call_id, max(end_ts) as duration from v_utterances group by call_id),
hits as (
  select u.call_id, b.bar, u.utterance_id, u.confidence
  from v_utterances u join spans s using (call_id), range(72) b(bar)
  where u.start_ts < (b.bar + 1) * (s.duration / 72e0) and u.end_ts > b.bar * (s.duration / 72e0))
"""


@query("v_utterances", BARS + "select call_id, bar, utterance_id from hits")
def join_interval_bars(ws):
    return R.bars_touched(ws["v_utterances"], R.call_spans(ws["v_utterances"])).select(
        "call_id", F.col("bar").cast("bigint").alias("bar"), "utterance_id")


@query("v_utterances v_turns", """
best as (
  select u.utterance_id, t.speaker_id, row_number() over (partition by u.utterance_id
           order by least(u.end_ts, t.stop) - greatest(u.start_ts, t.start) desc, t.start, t.speaker_id) as rn
  from v_utterances u join v_turns t on t.call_id = u.call_id
  where least(u.end_ts, t.stop) - greatest(u.start_ts, t.start) > 0)
select u.utterance_id, b.speaker_id from v_utterances u left join best b on b.utterance_id = u.utterance_id and rn = 1""")
def join_max_overlap(ws):
    return R.assign_turns(ws["v_utterances"], ws["v_turns"]).select("utterance_id", "speaker_id")


@query("v_clusters", f"""
days as (select cast(timestamp '{AS_OF}' as date) - cast(i as int) as day from range(30) t(i)),
touched as (select cast(last_updated as date) as day, count(*) as c,
                   count(*) filter (where not is_stable) as d from v_clusters group by 1)
select strftime(days.day, '%Y-%m-%d') as date, coalesce(c, 0) as new_clusters, coalesce(d, 0) as churned_clusters
from days left join touched on touched.day = days.day""")
def join_day_spine(ws):
    return R.daily_growth(ws["v_clusters"], AS_OF, 30)


@query("v_edges v_clusters", """
select id, frequency from v_clusters where id in (
  select source from v_edges where weight >= 0.7 union select target from v_edges where weight >= 0.7)""")
def join_incident_nodes(ws):
    return R.incident_clusters(ws["v_clusters"], ws["v_edges"].where("weight >= 0.7")).select("id", "frequency")


# --- sort, limit, sample --------------------------------------------------------------
@query("v_clusters", """
select id, label, frequency from (select *, row_number() over (order by frequency desc, id) as rn from v_clusters) c where rn <= 5""")
def top_clusters(ws):
    return R.top(ws["v_clusters"], "frequency", "id", 5).select("id", "label", "frequency")


@query("v_clusters", f"""
select id, frequency from (
  select *, row_number() over (order by frequency desc, id) as rn from v_clusters
  where last_updated >= timestamp '{AS_OF}' - interval 3 days) c where rn <= 10""")
def top_emerging(ws):
    return R.emerging(ws["v_clusters"], AS_OF, days=3, limit=10).select("id", "frequency")


@query("v_calls", """
select id from (select id, row_number() over (order by created_at desc, id) as position from v_calls) c
where position > 50 and position <= 100""")
def top_page_calls(ws):
    return R.page(ws["v_calls"], [F.desc("created_at"), F.asc("id")], limit=50, offset=50).select("id")


@query("v_questions", """
select call_id, id, cast(extracted_at is not null as bigint) as null_rank from v_questions""")
def sort_nulls_first(ws):
    return R.questions_in_order(ws["v_questions"]).select(
        "call_id", "id", F.col("extracted_at").isNotNull().cast("bigint").alias("null_rank"))


@query("v_calls", """
select id from (select id, row_number() over (order by md5(id || '|42'), id) as rn from v_calls
  where duration_seconds >= 2 and bucket in ('5-15s', '15-30s')) c where rn <= 100""")
def sample_slice(ws):
    eligible = R.duration_slice(ws["v_calls"], 2.0, ["5-15s", "15-30s"])
    return R.hashed_sample(eligible, "id", 42, 100).select("id")


@query("v_questions", """
select intent, n from (select intent, count(*) as n, row_number() over (order by count(*) desc, intent) as rn
  from v_questions where intent is not null group by intent) x where rn <= 8""")
def top_intents(ws):
    return R.top(R.distribution(ws["v_questions"], "intent"), "n", "intent", 8).select("intent", "n")


@query("v_edges v_clusters", """
kept as (select * from v_edges where weight >= 0.95),
top50 as (select * from (select *, row_number() over (order by frequency desc, id) as rn from v_clusters) c where rn <= 50)
select id, frequency from v_clusters where id in (select source from kept union select target from kept)
union all
select id, frequency from top50 where not exists (select 1 from kept)""")
def top_graph_view(ws):
    return R.graph_view(ws["v_clusters"], ws["v_edges"], 0.95).select("id", "frequency")


@query("v_docs_pii", pii_sql.kept() + """
select doc_id, type, start_idx, case type when 'PHONE' then 'medium' when 'EMAIL' then 'low' else 'high' end as severity,
       cast(case type when 'PHONE' then 2 when 'EMAIL' then 3 else 1 end as bigint) as severity_rank from kept""")
def sort_severity(ws):
    segments = TX.pii_segments(ws["v_docs_pii"], "doc_id", "text")
    return R.by_severity(segments).select("doc_id", "type", "start_idx", "severity", "severity_rank")
