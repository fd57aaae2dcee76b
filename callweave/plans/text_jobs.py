"""Text jobs over whole documents and utterances."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave import constants as C
from callweave.functions.text import language_bucket as bucket
from callweave.operators import calls_metadata as CM
from callweave.operators import text as TX
from callweave.plans import pii_sql
from callweave.plans.aggregates import SCORED, _tokens
from callweave.plans.catalog import query
from callweave.plans.relational import r

REPLACED = """,
masked as (select *, case type when 'SSN' then '***-**-' || right(value, 4) when 'PHONE' then '***-***-' || right(value, 4)
    when 'EMAIL' then substr(value, 1, 1) || '***@' || string_split(value, '@')[2]
    when 'AADHAR' then '****-****-' || right(value, 4) else substr(value, 1, 2) || '***' || right(value, 2) end as replacement from kept)
"""


@query("v_docs_pii", pii_sql.kept() + REPLACED + "select doc_id, type, value, start_idx, end_idx, replacement from masked")
def pii_scan(ws):
    return TX.pii_segments(ws["v_docs_pii"], "doc_id", "text")


@query("v_docs_pii", pii_sql.kept() + REPLACED + """,
cuts as (select *, coalesce(lag(end_idx) over (partition by doc_id order by start_idx), 0) as prev from masked),
heads as (select d.doc_id, string_agg(substr(d.text, c.prev + 1, c.start_idx - c.prev) || c.replacement, '' order by c.start_idx) as head,
                 max(c.end_idx) as last_end, count(*) as n_segments
          from cuts c join v_docs_pii d on d.doc_id = c.doc_id group by 1)
select d.doc_id, coalesce(head, '') || substr(d.text, coalesce(last_end, 0) + 1) as redacted, coalesce(n_segments, 0) as n_segments
from v_docs_pii d left join heads h on h.doc_id = d.doc_id""")
def pii_redact(ws):
    return TX.pii_redact(ws["v_docs_pii"], "doc_id", "text")


@query("v_docs_pii", pii_sql.kept() + """,
cuts as (select *, coalesce(lag(end_idx) over (partition by doc_id order by start_idx), 0) as prev from kept),
heads as (select d.doc_id, string_agg(substr(d.text, c.prev + 1, c.start_idx - c.prev), '' order by c.start_idx) as head, max(c.end_idx) as last_end
          from cuts c join v_docs_pii d on d.doc_id = c.doc_id group by 1)
select d.doc_id, coalesce(head, '') || substr(d.text, coalesce(last_end, 0) + 1) as redacted
from v_docs_pii d left join heads h on h.doc_id = d.doc_id""")
def pii_redact_remove(ws):
    return TX.pii_redact(ws["v_docs_pii"], "doc_id", "text", "remove").select("doc_id", "redacted")


def detected_sql(text: str) -> str:
    tokens = f"regexp_extract_all(lower({text}), '[a-z]+')"
    ratio = f"len(list_filter({tokens}, lambda t: list_contains({_tokens(C.ROMAN_HINDI_TOKENS)}, t))) / len({tokens})"
    return f"""case when trim(coalesce({text}, '')) = '' then 'other'
       when regexp_matches({text}, '[஀-௿]') then 'ta' when regexp_matches({text}, '[ఀ-౿]') then 'te'
       when regexp_matches({text}, '[ऀ-ॿ]') and regexp_matches({text}, '[A-Za-z]') then 'hi-en'
       when regexp_matches({text}, '[ऀ-ॿ]') then 'hi'
       when regexp_matches({text}, '[A-Za-z]') then
         case when {ratio} >= 0.20 then case when len(list_filter({tokens}, lambda t: len(t) > 2)) > 0 then 'hi-en' else 'hi-roman' end
              when {ratio} >= 0.10 then 'hi-en' else 'en' end
       else 'other' end"""


@query("v_multilang", f"""
labels as (select supplied, {detected_sql('text')} as detected from v_multilang)
select supplied, detected, count(*) as n from labels group by 1, 2""")
def language_profile(ws):
    return TX.language_profile(TX.language_labels(ws["v_multilang"], "doc_id", "text", "supplied"))


def bucket_sql(text: str, code: str) -> str:
    s = text
    tokens = f"list_filter(string_split_regex({s}, '\\s+'), lambda t: t <> '')"
    hits = (f"len(list_filter({tokens}, lambda t: list_contains({_tokens(C.HINGLISH_MARKERS)}, trim(lower(t), '.,?!\"'''))))")
    return f"""case when trim(coalesce({text}, '')) = '' then 'en'
       when len(regexp_extract_all({s}, '[ऀ-ॿ]')) >= greatest(20, len({s}) // 50) then 'hi'
       when len(regexp_extract_all({s}, '[؀-ۿ]')) >= greatest(20, len({s}) // 50) then 'ur'
       when {code} = 'hi' then 'hi' when {code} in ('ur', 'ar', 'fa') then 'ur'
       when {hits} >= greatest(3, len({tokens}) // 25) then 'hi'
       when coalesce({code}, 'en') = 'en' then 'en' else 'other' end"""


@query("v_multilang", f"select doc_id, {bucket_sql('call_text', 'supplied')} as bucket from v_multilang")
def language_bucket(ws):
    return ws["v_multilang"].select("doc_id", bucket(F.col("call_text"), F.col("supplied")).alias("bucket"))


@query("v_utterances", SCORED + """
select call_id, speaker, count(*) as n, round(avg(words), 6) as avg_words, round(avg(interrog), 6) as avg_interrog,
       round(avg(case when greeting then 1e0 else 0e0 end), 6) as greeting_share from scored group by 1, 2""")
def text_token_profile(ws):
    return TX.token_profile(ws["v_utterances"]).select(
        "call_id", "speaker", "n", *[r(c).alias(c) for c in ("avg_words", "avg_interrog", "greeting_share")])


@query("v_utterances", """
select call_id, string_agg('[' || printf('%.1f', start_ts) || 's] ' || speaker || ': ' || text, chr(10) order by idx) as block
from v_utterances group by 1""")
def text_transcript_block(ws):
    return TX.transcript_block(ws["v_utterances"])


EMBED_TEXTS = """
texts as (select id, language, 'passage: ' || trim(coalesce(nullif(normalized_text, ''), nullif(raw_text, ''), '')
         || case when coalesce(english_gloss, '') <> '' then ' || ' || english_gloss else '' end, ' ') as embed_text from v_questions)
"""


@query("v_questions", EMBED_TEXTS + "select embed_text, sha1(embed_text) as cache_key, count(*) as n_questions from texts group by 1")
def text_embed_keys(ws):
    return TX.embed_keys(ws["v_questions"])


@query("v_calls", """
select id, metadata->>'agent_id' as agent_id, metadata->>'customer_id' as customer_id, metadata->>'campaign' as campaign,
       metadata->>'channel' as channel, coalesce(nullif(metadata->>'stt_provider', ''), 'sarvam') as stt_provider,
       nullif(regexp_extract(source_uri, '(?:^|/)([0-9]+)\\.[^./]*$', 1), '') as recording_id from v_calls""")
def json_call_fields(ws):
    return CM.call_fields(ws["v_calls"])


@query("v_calls", """
select count(*) as n, count(*) filter (where metadata->>'agent_id' is null) as agent_id_nulls,
       count(*) filter (where metadata->>'campaign' is null) as campaign_nulls,
       count(*) filter (where metadata->>'stt_provider' is null) as stt_provider_nulls from v_calls""")
def json_call_field_nulls(ws):
    return CM.field_nulls(ws["v_calls"], ["agent_id", "campaign", "stt_provider"])
