"""Model request and response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave import constants as C
from callweave.operators import graph as GR
from callweave.operators import model_jobs as MJ
from callweave.operators import windows as WN
from callweave.plans.catalog import query
from callweave.plans.relational import r
from callweave.plans.text_jobs import bucket_sql, detected_sql
from callweave.plans.vectors import NEIGHBOURS
from callweave.plans.views import AS_OF
from callweave.plans.windows import CENTRAL


def chunked_sql(budget: int) -> str:
    """CTEs: the chunk of every turn (walk) beside its row (sized)."""
    return f"""
sized as (select *, len(text) + len(speaker) + 10 as size, row_number() over (partition by call_id order by idx) as n from v_utterances),
walk as (
  select call_id, n, size as filled, 0 as chunk from sized where n = 1
  union all
  select s.call_id, s.n, case when w.filled + s.size > {budget} then s.size else w.filled + s.size end,
         case when w.filled + s.size > {budget} then w.chunk + 1 else w.chunk end
  from walk w join sized s on s.call_id = w.call_id and s.n = w.n + 1),
blocks as (
  select w.call_id, cast(w.chunk as bigint) as chunk,
         string_agg('[' || printf('%.1f', s.start_ts) || 's] ' || s.speaker || ': ' || s.text, chr(10) order by s.idx) as block
  from walk w join sized s on s.call_id = w.call_id and s.n = w.n group by 1, 2)"""


@query("v_utterances", chunked_sql(600) + f""",
words as (select call_id, coalesce(string_agg(text, ' ' order by idx) filter (where speaker = 'CUSTOMER'), string_agg(text, ' ' order by idx)) as t
          from v_utterances group by 1),
buckets as (select call_id, {bucket_sql('t', "'en'")} as bucket from words)
select w.call_id, w.chunk, b.bucket, w.block from blocks w join buckets b on b.call_id = w.call_id""")
def llm_requests_extract(ws):
    return MJ.extract_requests(ws["v_utterances"], 600)


@query("v_utterances", chunked_sql(C.ANALYSIS_BUDGET) + """
select call_id, chunk, call_id || '#' || chunk as request, block from blocks""")
def llm_requests_analyze(ws):
    return MJ.analyze_requests(ws["v_utterances"])


@query("v_utterances", chunked_sql(900) + """
select call_id, chunk, call_id || '#' || chunk as request, block from blocks""")
def llm_requests_analyze_long(ws):
    return MJ.analyze_requests(ws["v_utterances"], 900)


@query("v_clusters v_members v_planted v_questions", CENTRAL + """,
l as (select cluster_id, count(*) as n, string_agg('- ' || text, chr(10) order by position) as examples from central group by 1)
select c.id as cluster_id, c.dominant_language as language, array_to_string(c.dominant_intents, ', ') as intents, coalesce(n, 0) as n,
       (select count(*) from v_members m where m.cluster_id = c.id) as total, examples, case when n is null then 'no_examples' else 'ok' end as status
from v_clusters c left join l on l.cluster_id = c.id""")
def llm_requests_faq(ws):
    return MJ.faq_requests(ws["v_clusters"], ws["v_members"], ws["v_planted"], ws["v_questions"])


@query("v_clusters v_members v_questions v_verdicts", NEIGHBOURS.format(k=8) + f""",
ex as (select cluster_id, string_agg('  - ' || t, chr(10) order by position) as examples from (
  select m.cluster_id, coalesce(nullif(q.normalized_text, ''), q.raw_text) as t,
         row_number() over (partition by m.cluster_id order by round(m.similarity, 9) desc, m.question_id) as position
  from v_members m join v_questions q on q.id = m.question_id) x where position <= 4 group by 1)
select nb.source, nb.target, round(nb.cosine, 3) as cosine, a.canonical_question as a_canonical, b.canonical_question as b_canonical,
       a.dominant_intents[1] as a_intent, coalesce(ea.examples, '  (none)') as a_examples, coalesce(eb.examples, '  (none)') as b_examples
from nb join v_clusters a on a.id = nb.source join v_clusters b on b.id = nb.target
left join ex ea on ea.cluster_id = nb.source left join ex eb on eb.cluster_id = nb.target
where nb.cosine >= 0.05 and not exists (select 1 from v_verdicts v where v.source = nb.source and v.target = nb.target
  and v.cached_at > timestamp '{AS_OF}' - interval 7 days)""")
def llm_requests_relation(ws):
    pairs = GR.edge_candidates(ws["v_clusters"], 8, 0.05)
    return MJ.relation_requests(pairs, ws["v_clusters"], ws["v_members"], ws["v_questions"], ws["v_verdicts"], AS_OF).select(
        "source", "target", "cosine", "a_canonical", "b_canonical", "a_intent", "a_examples", "b_examples")


def echo_model(text: str) -> str:
    """Deterministic stand-in: answers with the text length, refuses lengths divisible by seven."""
    if len(text) % 7 == 0:
        raise TimeoutError("upstream timed out")
    return f'{{"length":{len(text)}}}'


INFER = chunked_sql(C.ANALYSIS_BUDGET) + """,
b as (select call_id || '#' || chunk as request, length(block) as n from blocks)
select request, case when n % 7 <> 0 then '{"length":' || n || '}' end as response,
       case when n % 7 = 0 then 'TimeoutError: upstream timed out' end as error, case when n % 7 = 0 then 3 else 1 end::bigint as attempts from b"""


@query("v_utterances", INFER)
def llm_infer(ws):
    return MJ.infer(MJ.analyze_requests(ws["v_utterances"]), "request", "block", echo_model)


@query("v_utterances", INFER)
def llm_infer_batches(ws):
    return MJ.infer_batches(MJ.analyze_requests(ws["v_utterances"]), "request", "block", lambda texts: [echo_model(t) for t in texts])


RECOVER = r"""
cand as (
  select call_id, response, list_concat(list_transform(regexp_extract_all(response, '(?is)```(?:json)?\s*(.*?)```', 1), lambda x: trim(x, ' ' || chr(10) || chr(13) || chr(9))),
    [case when instr(response, '{') > 0 and instr(response, '}') > 0 then substr(response, instr(response, '{'), len(response) - instr(reverse(response), '}') + 2 - instr(response, '{')) end,
     case when instr(response, '[') > 0 and instr(response, ']') > 0 then substr(response, instr(response, '['), len(response) - instr(reverse(response), ']') + 2 - instr(response, '[')) end,
     trim(response)]) as cands
  from v_responses),
picked as (select call_id, list_filter(cands, lambda c: c is not null and json_valid(c))[1] as doc from cand),
docs as (
  select call_id, case json_type(doc) when 'OBJECT' then cast(doc as json) when 'ARRAY' then cast('{"questions":' || doc || '}' as json) end as document from picked)
"""


@query("v_responses", RECOVER + """
select call_id, document is not null as is_valid, coalesce(cast(json_array_length(document, '$.questions') as bigint), 0) as n_items,
       document->'questions'->0->>'intent' as first_intent from docs""")
def llm_recover_json(ws):
    docs = MJ.recover_json(ws["v_responses"])
    items = F.try_variant_get(F.try_parse_json("document"), "$.questions", "array<variant>")
    return docs.select("call_id", "is_valid", F.coalesce(F.size(items), F.lit(0)).cast("bigint").alias("n_items"),
                       F.try_variant_get(F.try_parse_json("document"), "$.questions[0].intent", "string").alias("first_intent"))


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


COERCE = RECOVER + f""",
items as (select call_id, unnest(from_json(document->'questions', '["json"]')) as item,
                 unnest(range(0, cast(json_array_length(document, '$.questions') as bigint))) as position from docs where document is not null),
named as (
  select call_id, position, item,
         coalesce(nullif(item->>'raw_text', ''), nullif(item->>'query', ''), nullif(item->>'question', ''), nullif(item->>'text', ''),
                  nullif(item->>'utterance', ''), nullif(item->>'normalized_text', '')) as raw_text from items),
texts as (select *, coalesce(nullif(item->>'normalized_text', ''), raw_text) as normalized_text from named),
coerced as (
  select call_id, position, call_id || '#' || position as item_id, raw_text, normalized_text,
         coalesce(item->>'question_type', 'question') as question_type, coalesce(item->>'intent', 'other') as intent,
         case when item->>'language' in {_in(C.LANGUAGES)} then item->>'language' else {detected_sql('normalized_text')} end as language,
         coalesce(try_cast(item->>'confidence' as double), 0e0) as confidence,
         case when raw_text is null or not coalesce(item->>'question_type', 'question') in {_in(C.QUESTION_TYPES)}
                or not coalesce(item->>'intent', 'other') in {_in(C.INTENTS)}
                or not coalesce(try_cast(item->>'confidence' as double), 0e0) between 0 and 1 then 'invalid'
              when item->>'intent' is null or item->>'confidence' is null or coalesce(item->>'english_gloss', '') = '' then 'degraded'
              else 'ok' end as status
  from texts)
"""


@query("v_responses", COERCE + """
select call_id, position, raw_text, normalized_text, question_type, intent, language, round(confidence, 6) as confidence, status from coerced""")
def llm_coerce_questions(ws):
    return MJ.coerce_questions(MJ.recover_json(ws["v_responses"])).select(
        "call_id", "position", "raw_text", "normalized_text", "question_type", "intent", "language", r("confidence").alias("confidence"), "status")


GROUND = COERCE + """,
pairs as (
  select c.item_id, u.utterance_id, row_number() over (partition by c.item_id order by
           case when contains(lower(trim(u.text, ' ' || chr(10))), lower(trim(c.raw_text, ' ' || chr(10)))) then 1 else 2 end, u.idx) as rn
  from coerced c join v_utterances u on u.call_id = c.call_id
  where c.status <> 'invalid' and (contains(lower(trim(u.text, ' ' || chr(10))), lower(trim(c.raw_text, ' ' || chr(10))))
     or contains(lower(trim(c.raw_text, ' ' || chr(10))), lower(trim(u.text, ' ' || chr(10)))))),
matched as (select item_id, utterance_id from pairs where rn = 1)
"""


def coerced(ws):
    return MJ.coerce_questions(MJ.recover_json(ws["v_responses"]))


@query("v_responses v_utterances", GROUND + """
select c.item_id, m.utterance_id from coerced c left join matched m on m.item_id = c.item_id where c.status <> 'invalid'""")
def join_grounding(ws):
    return MJ.ground(coerced(ws).where("status <> 'invalid'"), ws["v_utterances"]).select("item_id", "utterance_id")


@query("v_responses v_utterances", GROUND + """
select c.item_id, m.utterance_id, c.intent, c.status from coerced c join matched m on m.item_id = c.item_id""")
def llm_ground_questions(ws):
    return MJ.ground_questions(coerced(ws), ws["v_utterances"]).select("item_id", "utterance_id", "intent", "status")


@query("v_responses v_utterances", GROUND + """
select case when c.status <> 'invalid' and m.item_id is null then 'ungrounded' else c.status end as status, count(*) as n
from coerced c left join matched m on m.item_id = c.item_id group by 1""")
def agg_extract_status(ws):
    return MJ.extract_status(coerced(ws), ws["v_utterances"])


@query("v_analyses v_utterances", """
turns as (
  select call_id, idx, text from v_utterances
  union all
  select call_id, 1000, 'this is ' || full_name || ' reach me at ' || substr(phone, 1, 5) || ' ' || substr(phone, 6) from v_analyses where sentiment = 'negative'
  union all
  select call_id, 1001, 'policy ' || lower(policy_no) from v_analyses where escalation),
said as (select call_id, lower(string_agg(text, ' ' order by idx)) as said from turns group by 1),
m as (
  select a.*, coalesce(full_name <> '' and contains(said, lower(full_name)), false) as n_ok, coalesce(email <> '' and contains(said, lower(email)), false) as e_ok,
         coalesce(policy_no <> '' and contains(said, lower(policy_no)), false) as p_ok,
         coalesce(contains(regexp_replace(said, '[^0-9]', '', 'g'), a.phone), false) as ph_ok
  from v_analyses a left join said s on s.call_id = a.call_id)
select call_id, case when n_ok or full_name = '' then full_name end as full_name, case when e_ok then email end as email,
       case when p_ok then policy_no end as policy_no, case when ph_ok then phone end as phone,
       array_to_string(list_filter([case when n_ok then 'full_name' end, case when e_ok then 'email' end, case when p_ok then 'policy_no' end,
                        case when ph_ok then 'phone' end], lambda x: x is not null), ',') as grounded_fields
from m""")
def llm_ground_lead(ws):
    a = ws["v_analyses"]
    intro = a.where("sentiment = 'negative'").select("call_id", F.lit(1000).cast("bigint").alias("idx"), F.concat(
        F.lit("this is "), "full_name", F.lit(" reach me at "), F.substring("phone", 1, 5), F.lit(" "), F.substring("phone", 6, 5)).alias("text"))
    policy = a.where("escalation").select("call_id", F.lit(1001).cast("bigint").alias("idx"),
                                                               F.concat(F.lit("policy "), F.lower("policy_no")).alias("text"))
    turns = ws["v_utterances"].select("call_id", "idx", "text").unionByName(intro).unionByName(policy)
    return MJ.ground_lead(a, turns).select("call_id", "full_name", "email", "policy_no", "phone",
                                           F.array_join("grounded_fields", ",").alias("grounded_fields"))


@query("v_faq_responses v_clusters v_members v_planted v_questions v_faqs", CENTRAL + """
select f.cluster_id, coalesce(nullif(trim(f.response::json->>'canonical_question'), ''), c.text) as canonical_question,
       nullif(trim(f.response::json->>'canonical_question_en'), '') as canonical_question_en, nullif(trim(f.response::json->>'suggested_answer'), '') as suggested_answer,
       k.dominant_language as language, greatest(0e0, least(1e0, coalesce(try_cast(f.response::json->>'confidence' as double), 0e0))) as confidence,
       coalesce((select max(version) from v_faqs v where v.cluster_id = f.cluster_id), 0) + 1 as version
from v_faq_responses f join v_clusters k on k.id = f.cluster_id left join central c on c.cluster_id = f.cluster_id and c.position = 1""")
def llm_faq_rows(ws):
    central = WN.central_examples(ws["v_members"], ws["v_planted"], ws["v_clusters"], ws["v_questions"], 1)
    requests = ws["v_clusters"].select(F.col("id").alias("cluster_id"), F.col("dominant_language").alias("language"))
    return MJ.faq_rows(ws["v_faq_responses"], requests, ws["v_faqs"], central)
