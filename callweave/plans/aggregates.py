"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave import constants as C
from callweave.operators import aggregates as A
from callweave.operators import calls as K
from callweave.operators import relational as R
from callweave.operators import text as TX
from callweave.plans import pii_sql
from callweave.plans.catalog import query
from callweave.plans.relational import BARS, CLEAN, RESOLVED, r, resolved, ts_text
from callweave.plans.views import AS_OF


@query("v_calls v_questions v_clusters", """
select (select count(*) from v_calls) as total_calls, (select count(*) from v_questions) as total_questions,
       (select count(*) from v_clusters) as total_clusters""")
def agg_totals(ws):
    return A.totals(ws["v_calls"], ws["v_questions"], ws["v_clusters"])


@query("v_questions", "select language, count(*) as n from v_questions where language is not null group by 1")
def agg_language_dist(ws):
    return R.distribution(ws["v_questions"], "language")


@query("v_questions", "select intent, count(*) as n from v_questions where intent is not null group by 1")
def agg_intent_dist(ws):
    return R.distribution(ws["v_questions"], "intent")


@query("v_questions", "select question_type, count(*) as n from v_questions where question_type is not null group by 1")
def agg_qtype_dist(ws):
    return R.distribution(ws["v_questions"], "question_type")


WINNER_ORDER = "rank, day, conf desc, call_id"
RANKED = RESOLVED + """,
ranked as (
  select *, join_phone as phone_key,
    case disposition when 'escalation' then 0 when 'complaint' then 1 when 'follow_up_payment' then 2
      when 'callback_requested' then 3 when 'service_request' then 4 when 'not_eligible' then 5
      when 'not_interested' then 6 when 'dnd' then 7 when 'wrong_number' then 8 when 'resolved' then 9
      when 'info_provided' then 10 when 'no_response' then 11 when 'other' then 12 else 13 end as rank,
    case when call_date = '' then -1000000 else -epoch_us(cast(call_date as timestamp)) // 86400000000 end as day,
    disposition_confidence as conf
  from resolved where join_phone is not null)
"""


def _first(field):
    return (f"coalesce((list({field} order by day, call_id) filter (where trim(coalesce({field}, '')) <> ''))[1], '')")


SUMMARY = RANKED + f""",
winners as (select phone_key, disposition, sentiment, conf from (
  select *, row_number() over (partition by phone_key order by {WINNER_ORDER}) as rn from ranked) x where rn = 1),
grouped as (
  select phone_key, bool_or(escalation) as escalation, count(*) as n, max(call_date) as last_date,
         string_agg(call_id, ',' order by day, call_id) as ids,
         {_first('full_name')} as full_name, {_first('email')} as email, {_first('occupation')} as occupation,
         {_first('income_band')} as income_band, {_first('product_interest')} as product_interest,
         {_first('pincode')} as pincode
  from ranked group by phone_key)
"""
SUMMARY_SELECT = """
select g.phone_key as "PHONE_NUMBER", w.disposition as "CALL_DISPOSITION", w.sentiment as "CALL_SENTIMENT",
       case when g.escalation then 'true' else 'false' end as "CALL_ESCALATION", cast(g.n as string) as "CALL_N_CALLS",
       g.last_date as "CALL_LAST_DATE", g.full_name as "CALL_LEAD_NAME", g.email as "CALL_LEAD_EMAIL",
       g.occupation as "CALL_LEAD_OCCUPATION", g.income_band as "CALL_LEAD_INCOME_BAND",
       g.product_interest as "CALL_LEAD_PRODUCT_INTEREST", g.pincode as "CALL_LEAD_PINCODE",
       g.ids as "CALL_SOURCE_CALL_IDS", cast(round(w.conf, 3) as string) as "CALL_CONFIDENCE"
from grouped g join winners w on w.phone_key = g.phone_key"""


@query("v_analyses v_cdr", SUMMARY + SUMMARY_SELECT)
def agg_call_summary(ws):
    return K.call_summary(resolved(ws))


@query("v_calls v_docs_pii v_utterances", pii_sql.hits() + """,
flagged as (select distinct doc_id from hits)
select count(*) as total, (select round(avg(confidence) * 100, 6) from v_utterances) as avg_confidence,
       round(100.0 * count(doc_id) / count(*), 6) as flagged_percent
from v_calls left join flagged on doc_id = id""")
def agg_call_stats(ws):
    hits = TX.pii_hits(ws["v_docs_pii"], "doc_id", "text")
    return A.call_stats(ws["v_calls"], hits, ws["v_utterances"]).select(
        "total", r("avg_confidence").alias("avg_confidence"), r("flagged_percent").alias("flagged_percent"))


@query("v_analyses", """
select call_id, round(greatest(0, least(1, (sentiment_confidence * 4e-1 + disposition_confidence * 4e-1)
       * case when escalation then 6e-1 else 1e0 end)), 6) as quality_score from v_analyses""")
def agg_call_quality(ws):
    return K.call_quality(ws["v_analyses"]).select("call_id", r("quality_score").alias("quality_score"))


@query("v_questions", """
best as (select *, row_number() over (partition by call_id order by confidence desc, id) as rn from v_questions qualify rn <= 10),
votes as (
  select call_id, intent as v from best where rn > 1
  union all select call_id, unnest(secondary_intents) as v from best),
ranked as (
  select call_id, v, row_number() over (partition by call_id order by count(*) desc, v) as p from votes group by call_id, v),
sec as (select call_id, string_agg(v, ',' order by p) as s from ranked where p <= 2 group by call_id)
select b.call_id, string_agg(substr(b.normalized_text, 1, 50), '|' order by b.rn) filter (where b.rn <= 5) as keywords,
       max(case when b.rn = 1 then b.intent end) as primary_intent, coalesce(max(sec.s), '') as secondary_intents
from best b left join sec on sec.call_id = b.call_id group by b.call_id""")
def agg_call_keywords(ws):
    return A.call_keywords(ws["v_questions"]).select(
        "call_id", F.array_join("keywords", "|").alias("keywords"), "primary_intent",
        F.array_join("secondary_intents", ",").alias("secondary_intents"))


EXAMPLES = """
ex as (select * from (
  select m.cluster_id, m.question_id, q.intent, q.language,
         row_number() over (partition by m.cluster_id order by round(m.similarity, 9) desc, m.question_id) as position
  from v_members m join v_questions q on q.id = m.question_id) x where position <= 20)
"""


@query("v_clusters v_faqs v_members v_questions", EXAMPLES + """,
faq as (select cluster_id, arg_max(id, version) as faq_id from v_faqs group by 1),
listed as (select cluster_id, string_agg(question_id, ',' order by position) as examples from ex group by 1),
i as (select cluster_id, string_agg(intent || ':' || n, ',' order by intent) as intents from (
  select cluster_id, intent, count(*) as n from ex group by 1, 2) a group by 1),
l as (select cluster_id, string_agg(language || ':' || n, ',' order by language) as languages from (
  select cluster_id, language, count(*) as n from ex group by 1, 2) a group by 1)
select c.id as cluster_id, c.frequency, faq_id, coalesce(examples, '') as examples,
       coalesce(intents, '') as intents, coalesce(languages, '') as languages
from v_clusters c left join faq on faq.cluster_id = c.id left join listed on listed.cluster_id = c.id
left join i on i.cluster_id = c.id left join l on l.cluster_id = c.id""")
def agg_cluster_detail(ws):
    def flat(name):
        entries = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
        return F.coalesce(F.array_join(entries, ","), F.lit("")).alias(name)

    return A.cluster_detail(ws["v_clusters"], ws["v_faqs"], ws["v_members"], ws["v_questions"]).select(
        "cluster_id", "frequency", "faq_id", F.coalesce(F.array_join("examples", ","), F.lit("")).alias("examples"),
        flat("intents"), flat("languages"))


@query("v_members v_questions", """
j as (select m.cluster_id, q.language, q.intent from v_members m join v_questions q on q.id = m.question_id),
l as (select cluster_id, language, row_number() over (partition by cluster_id order by count(*) desc, language) as p from j group by 1, 2),
i as (select cluster_id, intent, row_number() over (partition by cluster_id order by count(*) desc, intent) as p from j group by 1, 2)
select l.cluster_id, max(language) filter (where l.p = 1) as dominant_language,
       (select string_agg(intent, ',' order by p) from i where i.cluster_id = l.cluster_id and p <= 3) as dominant_intents
from l group by l.cluster_id""")
def agg_cluster_dominants(ws):
    return A.cluster_dominants(ws["v_members"], ws["v_questions"]).select(
        "cluster_id", "dominant_language", F.array_join("dominant_intents", ",").alias("dominant_intents"))


@query("v_clusters v_members", """
select c.id, (select count(*) from v_members m where m.cluster_id = c.id) as frequency from v_clusters c""")
def agg_frequency_recount(ws):
    return A.recount(ws["v_clusters"], ws["v_members"]).select("id", "frequency")


SPREAD = """
lab as (select m.cluster_id, q.intent, count(*) as n from v_members m join v_questions q on q.id = m.question_id group by 1, 2),
tot as (select cluster_id, sum(n) as total, max(n) as top, count(*) as kinds from lab group by 1),
ent as (select lab.cluster_id, sum(-(n / total) * log2(n / total)) as h from lab join tot using (cluster_id) group by 1),
spread as (
  select c.id as cluster_id, cast(coalesce(total, 0) as bigint) as size, coalesce(top / total, 1e0) as purity,
         case when kinds > 1 then h / log2(kinds) else 0e0 end as entropy
  from v_clusters c left join tot on tot.cluster_id = c.id left join ent on ent.cluster_id = c.id)
"""


@query("v_members v_questions v_clusters", SPREAD + "select cluster_id, round(entropy, 6) as entropy from spread")
def agg_entropy(ws):
    return A.label_spread(ws["v_members"], ws["v_questions"], ws["v_clusters"]).select("cluster_id", r("entropy").alias("entropy"))


@query("v_members v_questions v_clusters", SPREAD + "select cluster_id, size, round(purity, 6) as purity from spread")
def agg_purity(ws):
    return A.label_spread(ws["v_members"], ws["v_questions"], ws["v_clusters"]).select("cluster_id", "size", r("purity").alias("purity"))


@query("v_members v_questions v_clusters", SPREAD + """,
o as (select size, row_number() over (order by size) as rn, count(*) over () as n from spread)
select count(*) as count, min(size) as min, max(size) as max, round(avg(size), 2) as mean, cast(median(size) as double) as median,
       max(case when rn = ceil(0.9 * n) then size end) as p90 from o""")
def agg_size_stats(ws):
    return A.size_stats(A.label_spread(ws["v_members"], ws["v_questions"], ws["v_clusters"]).select("size"))


DISPERSION = """
disp as (
  select m.cluster_id, avg(1 - greatest(-1, least(1, list_cosine_similarity(p.vector, c.centroid)))) as dispersion
  from v_members m join v_planted p on p.question_id = m.question_id join v_clusters c on c.id = m.cluster_id group by 1)
"""


@query("v_members v_planted v_clusters", DISPERSION + "select cluster_id, round(dispersion, 6) as dispersion from disp")
def agg_dispersion(ws):
    return A.dispersion(ws["v_members"], ws["v_planted"], ws["v_clusters"]).select("cluster_id", r("dispersion").alias("dispersion"))


FINDINGS = SPREAD + "," + DISPERSION + """,
g as (select cluster_id, string_agg(gloss, '|' order by question_id) as sample_glosses from (
  select m.cluster_id, m.question_id, substr(coalesce(nullif(q.english_gloss, ''), nullif(q.normalized_text, ''), ''), 1, 120) as gloss,
         row_number() over (partition by m.cluster_id order by m.question_id) as rn
  from v_members m join v_questions q on q.id = m.question_id) x where rn <= 5 group by 1),
findings as (
  select s.cluster_id, c.label, c.frequency, s.size, round(s.purity, 3) as intent_purity, s.purity, round(s.entropy, 3) as intent_entropy,
         round(d.dispersion, 3) as dispersion, coalesce(g.sample_glosses, '') as sample_glosses
  from spread s join v_clusters c on c.id = s.cluster_id left join disp d on d.cluster_id = s.cluster_id left join g on g.cluster_id = s.cluster_id)
"""
FINDING_COLUMNS = ["cluster_id", "label", "frequency", "size", "intent_purity", "intent_entropy", "dispersion"]


@query("v_members v_questions v_clusters v_planted", FINDINGS + """
select cluster_id, label, frequency, size, intent_purity, intent_entropy, dispersion, sample_glosses
from findings where size >= 10 and purity < 0.95""")
def agg_coarse_clusters(ws):
    found = A.cluster_findings(ws["v_clusters"], ws["v_members"], ws["v_questions"], ws["v_planted"])
    return A.coarse_clusters(found, 10, 0.95).select(
        *FINDING_COLUMNS, F.array_join("sample_glosses", "|").alias("sample_glosses"))


@query("v_clusters", f"""
days as (select cast(timestamp '{AS_OF}' as date) - cast(i as int) as day from range(14) t(i))
select strftime(day, '%Y-%m-%d') as date,
       (select count(*) from v_clusters where cast(last_updated as date) = day) as new_clusters,
       (select count(*) from v_clusters where cast(last_updated as date) = day and not is_stable) as churned_clusters
from days""")
def agg_cluster_growth(ws):
    return R.daily_growth(ws["v_clusters"], AS_OF, 14)


@query("v_members v_clusters", f"""
g as (select cluster_id, min(assigned_at) as first_seen, count(*) as current_size,
             count(*) filter (where assigned_at >= timestamp '{AS_OF}' - interval 7 days) as recent_size from v_members group by 1),
k as (select *, current_size - recent_size as baseline_size,
      case when current_size = recent_size then cast(recent_size as double) else recent_size / (current_size - recent_size) end as growth_rate
      from g where recent_size >= 3)
select cluster_id, label, strftime(first_seen, '%Y-%m-%d %H:%M:%S') as first_seen, current_size, recent_size, baseline_size,
       round(growth_rate, 6) as growth_rate
from (select k.*, c.label, row_number() over (order by growth_rate desc, recent_size desc, cluster_id) as rn
      from k left join v_clusters c on c.id = k.cluster_id) z where rn <= 20""")
def agg_drift(ws):
    return A.drift(ws["v_members"], ws["v_clusters"], AS_OF).select(
        "cluster_id", "label", ts_text("first_seen").alias("first_seen"), "current_size", "recent_size", "baseline_size",
        r("growth_rate").alias("growth_rate"))


@query("v_docs_pii", pii_sql.hits() + """
select doc_id, count(*) filter (where type = 'SSN') as ssn, count(*) filter (where type = 'PHONE') as phone,
       count(*) filter (where type = 'EMAIL') as email, count(*) filter (where type = 'AADHAR') as aadhar,
       count(*) filter (where type = 'PAN') as pan, count(*) as total from hits group by doc_id""")
def agg_pii_counts(ws):
    return TX.pii_counts(ws["v_docs_pii"], "doc_id", "text")


def _tokens(words):
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"[{quoted}]"


SCORED = f"""
scored as (
  select *, len(list_filter({_tokens(C.GREETING_TOKENS)}, lambda w: contains(lower(text), w))) > 0 as greeting,
         cast(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_](?:[\\p{{L}}\\p{{N}}_'']*[\\p{{L}}\\p{{N}}_])?')) as bigint) as words,
         cast(list_sum(list_transform({_tokens(C.INTERROGATIVE_TOKENS)},
              lambda w: (len(lower(text)) - len(replace(lower(text), w, ''))) // len(w))) as bigint) as interrog
  from v_utterances)
"""
STATS = SCORED + """,
opener as (select call_id, arg_min(coalesce(speaker_id, ''), start_ts) as first_id from scored group by 1),
stats as (
  select s.call_id, s.speaker_id, count(*) filter (where greeting) as greeting_turns, cast(sum(words) as bigint) as words,
         cast(sum(interrog) as bigint) as interrog, bool_or(s.speaker_id = o.first_id) as opens_call
  from scored s join opener o on o.call_id = s.call_id where s.speaker_id is not null group by 1, 2),
rated as (select *, greeting_turns * 100e0 + words * 1e-1 - interrog * 2e0 + case when opens_call then 10e0 else 0e0 end as score from stats)
"""


@query("v_utterances", STATS + """
select call_id, speaker_id, greeting_turns, words, interrog, opens_call, round(score, 6) as score from rated""")
def agg_speaker_stats(ws):
    return TX.speaker_stats(TX.scored(ws["v_utterances"])).select(
        "call_id", "speaker_id", "greeting_turns", "words", "interrog", "opens_call", r("score").alias("score"))


@query("v_stage_events", """
bounds(i, le) as (values (0, 5e-2), (1, 1e-1), (2, 25e-2), (3, 5e-1), (4, 1e0), (5, 25e-1), (6, 5e0), (7, 10e0), (8, 30e0),
                         (9, 60e0), (10, 120e0), (11, 300e0)),
h as (select stage, i, le, count(*) filter (where duration <= le) as n, count(*) as total
      from v_stage_events cross join bounds group by stage, i, le),
w as (select *, coalesce(lag(n) over (partition by stage order by i), 0) as below,
             coalesce(lag(le) over (partition by stage order by i), 0e0) as low from h),
p as (select stage, arg_min(low + (le - low) * (total * 95e-2 - below) / (n - below), i) filter (where n >= total * 95e-2) as p95 from w group by stage)
select h.stage, h.total, h.le, h.n, round(coalesce(p95, 300e0), 6) as p95,
       case h.stage when 'embed' then coalesce(p95, 300e0) < 4 when 'cluster' then coalesce(p95, 300e0) < 6 end as within_slo
from h join p on p.stage = h.stage""")
def agg_stage_histogram(ws):
    return A.stage_histogram(ws["v_stage_events"]).select("stage", "total", "le", "n", r("p95").alias("p95"), "within_slo")


@query("v_utterances", BARS + """,
f as (select call_id, bar, avg(confidence) as conf, count(*) as n from hits group by 1, 2)
select s.call_id, b.bar, cast(coalesce(least(30, greatest(1, floor(1 + conf * 15 + n * 3))), 1) as bigint) as height
from spans s cross join range(72) b(bar) left join f on f.call_id = s.call_id and f.bar = b.bar""")
def agg_waveform(ws):
    return A.waveform(ws["v_utterances"])


@query("v_calls v_questions", """
picked as (select id from v_calls where status in ('clustered', 'extraction_done', 'embedding_done'))
select (select count(*) from picked) as n_calls, count(*) as n_questions, count(*) filter (where human_override) as n_gold
from v_questions where call_id in (select id from picked)""")
def agg_reextract_plan(ws):
    return A.reextract_plan(ws["v_calls"], ws["v_questions"], ["clustered", "extraction_done", "embedding_done"])


@query("v_cdr", CLEAN + """
select crux_call_id, caller_phone, agent_id, campaign, strftime(started_at, '%Y-%m-%d %H:%M:%S') as started_at, direction from cdr""")
def conform_cdr(ws):
    return K.conform_cdr(ws["v_cdr"]).select(
        "crux_call_id", "caller_phone", "agent_id", "campaign", ts_text("started_at").alias("started_at"), "direction")


@query("v_cdr", CLEAN + """
select coalesce(campaign, '(none)') as campaign, count(*) as n_rows,
       count(caller_phone) as phone_valid, count(*) filter (where digits is null) as phone_missing,
       count(*) filter (where digits is not null and caller_phone is null) as phone_invalid,
       count(started_at) as start_valid, count(*) filter (where start_text is null) as start_missing,
       count(*) filter (where start_text is not null and started_at is null) as start_invalid
from cdr join (select crux_call_id as cid, ordinal as o, digits from clean_cdr) d on d.cid = crux_call_id and d.o = ordinal
group by 1""")
def conform_cdr_quality(ws):
    return K.cdr_quality(ws["v_cdr"])


@query("v_analyses v_cdr", RESOLVED + """
select call_id, join_phone, case when cdr_phone is not null then 'cdr' when grounded_phone is not null then 'lead' else 'none' end as phone_source,
       coalesce(cdr_phone <> grounded_phone, false) as phone_mismatch from resolved""")
def resolve_join_phone(ws):
    return resolved(ws).select("call_id", "join_phone", "phone_source", "phone_mismatch")


@query("v_analyses v_cdr", RESOLVED + """
select case when cdr_phone is not null then 'cdr' when grounded_phone is not null then 'lead' else 'none' end as phone_source,
       count(*) as n_calls, count(*) filter (where cdr_phone <> grounded_phone) as n_mismatch from resolved group by 1""")
def resolve_join_phone_coverage(ws):
    return K.phone_coverage(resolved(ws))
